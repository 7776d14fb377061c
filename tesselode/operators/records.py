"""Writers of records: what each operation appends to the graph, as rows of nodes and edges.

A record operation takes rows with named columns and a seq, checks them, and gives a node log, edges and the
rows it refuses. Ids are hashes of kind and identity, so that a rerun appends the same rows. store.merged() is the state.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselode.operators.graph import union_all
from tesselode.operators.store import PROPS, entries, joined, linked

# The roles an agent may have.
ROLES = ["project_manager", "tech_lead", "frontend_dev", "backend_dev", "ux_designer", "qa_engineer", "devops_engineer", "researcher"]
# The states a task may go to from each state.
TASK_STEPS = {
    "UNKNOWN": ["DISCOVERING", "BLOCKED"],
    "DISCOVERING": ["ANALYZING", "HYPOTHESISING", "BLOCKED", "STALE"],
    "ANALYZING": ["DISCOVERING", "HYPOTHESISING", "IMPLEMENTING", "BLOCKED", "STALE"],
    "HYPOTHESISING": ["DISCOVERING", "ANALYZING", "IMPLEMENTING", "BLOCKED", "STALE"],
    "IMPLEMENTING": ["ANALYZING", "VERIFYING", "BLOCKED", "STALE"],
    "VERIFYING": ["IMPLEMENTING", "ANALYZING", "VALIDATED", "BLOCKED", "STALE"],
    "VALIDATED": ["STALE"],
    "BLOCKED": ["DISCOVERING", "ANALYZING", "HYPOTHESISING", "IMPLEMENTING", "VERIFYING"],
    "STALE": ["DISCOVERING", "ANALYZING", "BLOCKED"],
}
# The same of a hypothesis.
HYPOTHESIS_STEPS = {
    "UNKNOWN": ["SUSPECTED"],
    "SUSPECTED": ["SUPPORTED", "PARTIAL", "CONTRADICTED"],
    "SUPPORTED": ["CONFIRMED", "PARTIAL", "CONTRADICTED", "SUSPECTED"],
    "PARTIAL": ["SUPPORTED", "CONFIRMED", "CONTRADICTED", "SUSPECTED"],
    "CONFIRMED": ["CONTRADICTED"],
    "CONTRADICTED": ["SUSPECTED"],
}


@dataclass(frozen=True)
class Link:
    """An edge of each row; an end is a column, or "" for the record's own node. Rows with a null end have none."""

    kind: str
    source: str
    target: str
    props: dict[str, str] = field(default_factory=dict)  # property: column
    fixed: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Record:
    """What an operation writes: identity and state columns of its node (kind "" for none), fixed properties, edges."""

    kind: str
    identity: tuple[str, ...] = ()
    state: tuple[str, ...] = ()
    links: tuple[Link, ...] = ()
    fixed: dict[str, str] = field(default_factory=dict)
    defaults: dict[str, str] = field(default_factory=dict)


_SUSPECTED = {"equivalence_status": "SUSPECTED"}
_MAPPED = Link("EQUIVALENT_TO", "binary_function_id", "source_function_id", {"confidence": "confidence", "validation_method": "method"}, _SUSPECTED)
_AT = ("project_id", "binary_id", "function_addr")

#: What each operation writes.
RECORDS = {
    "record_evidence": Record("Evidence", ("project_id", "subject_id", "description", "source"), ("state", "confidence", "agent", "method"), (Link("REFERENCES", "subject_id", "", fixed={"role": "evidence"}), Link("SUPPORTED_BY", "supports_hypothesis_id", "", {"confidence": "confidence"})), defaults={"state": "OBSERVATION", "source": "manual", "method": "manual", "confidence": "1.00"}),
    "record_observation": Record("Evidence", ("project_id", "subject_id", "description", "source"), ("confidence", "agent", "method"), (Link("REFERENCES", "subject_id", "", fixed={"role": "evidence"}),), {"state": "OBSERVATION"}, {"source": "manual", "method": "manual", "confidence": "1.00"}),
    "record_hypothesis": Record("Hypothesis", ("project_id", "subject_id", "claim"), ("state", "confidence", "agent"), (Link("SUSPECTED_AS", "subject_id", "", {"confidence": "confidence"}),), defaults={"state": "SUSPECTED"}),
    "map_binary_function": Record("", links=(_MAPPED,)),
    "map_source_function": Record("", links=(_MAPPED,)),
    "record_port": Record("", links=(Link("PORTED_TO", "binary_function_id", "implementation_id", {"language": "language", "confidence": "confidence"}, _SUSPECTED),)),
    "record_validation": Record("Test", ("project_id", "test_name"), ("status", "method"), (Link("VALIDATED_BY", "implementation_id", "", {"confidence": "confidence", "status": "status"}), Link("EQUIVALENT_TO", "binary_function_id", "implementation_id", {"confidence": "confidence", "validation_method": "method", "equivalence_status": "verdict", "test_reference": ""}))),
    "record_semantic_mapping": Record("SemanticMapping", (*_AT, "target_construct"), ("source_construct", "semantic_meaning", "translation_rule", "compatibility_issue", "confidence"), (Link("HAS_MAPPING", "function_id", ""),)),
    "record_porting_decision": Record("PortingDecision", (*_AT, "language"), ("original_construct", "target_construct", "reason", "confidence"), (Link("PORTING_DECISION", "function_id", ""),)),
    "record_known_difference": Record("KnownDifference", (*_AT, "diff_type"), ("description", "severity", "impact"), (Link("HAS_DIFFERENCE", "function_id", ""),)),
    "record_verification_test": Record("VerificationTest", (*_AT, "test_name"), ("input", "binary_output", "ported_output", "match"), (Link("VERIFIED_BY", "function_id", ""),)),
    "team_create": Record("Team", ("project_id", "team"), ("owner_agent",)),
    "team_member": Record("Agent", ("project_id", "team_id", "agent"), ("role", "owner_agent"), (Link("HAS_MEMBER", "team_id", "agent", {"role": "role"}),)),
    "assign_task": Record("Task", ("project_id", "team_id", "title"), ("description", "assignee", "role", "priority"), (Link("ASSIGNED_TO", "team_id", "", {"role": "role", "assignee": "assignee"}),), {"status": "todo"}),
    "share_knowledge": Record("SharedKnowledge", ("project_id", "from_agent", "to_agent", "to_role"), ("title", "content"), (Link("SHARED_WITH", "", "to_agent", fixed={"type": "agent"}), Link("SHARED_WITH_ROLE", "", "to_role", fixed={"type": "role"}), Link("SHARED_BY", "", "from_agent")), {"version": "1"}),
}


def record_id(kind: str, identity: tuple[str, ...]) -> Column:
    """The hash of kind and identity; a missing value counts as empty."""
    return F.sha2(joined(F.lit(kind), *[F.col(c) for c in identity]), 256)


def _map(pairs: list[Column]) -> Column:
    entries = F.array(*[F.struct(k.alias("key"), v.cast("string").alias("value")) for k, v in pairs]) if pairs else F.expr("cast(array() as array<struct<key:string,value:string>>)")
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def refused(op: str, rows: DataFrame) -> Column:
    """Why a row is not written, or null: a confidence outside 0 to 1, an unknown role, a missing identity or seq."""
    spec, out = RECORDS[op], F.lit(None).cast("string")
    if "role" in rows.columns and "role" in spec.state:
        out = F.when(~F.coalesce(F.col("role").isin(ROLES), F.lit(False)), F.lit("role")).otherwise(out)
    if "confidence" in rows.columns:
        out = F.when(F.col("confidence").isNotNull() & ~F.col("confidence").cast("double").between(0, 1), F.lit("confidence")).otherwise(out)
    if "project_id" in spec.identity:
        out = F.when(F.col("project_id").isNull(), F.lit("project_id")).otherwise(out)
    return F.when(F.col("seq").isNull(), F.lit("seq")).otherwise(out)


def _judged(op: str, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to write, with every column that the operation knows as text and defaults put in; refused rows with `why`."""
    spec = RECORDS[op]
    judged = rows.withColumn("why", refused(op, rows))
    good = judged.where("why IS NULL").drop("why")
    wanted = [*spec.identity, *spec.state, *[c for x in spec.links for c in (x.source, x.target, *x.props.values()) if c]]
    for c in dict.fromkeys(wanted):
        value = F.col(c).cast("string") if c in good.columns else F.lit(None).cast("string")
        good = good.withColumn(c, F.coalesce(value, F.lit(spec.defaults[c])) if c in spec.defaults else value)
    return good, judged.where("why IS NOT NULL")


def _named(edges: DataFrame) -> DataFrame:
    """edges(kind, from_id, to_id, props) with the hash of all these as id."""
    told = F.transform(entries(F.col("props")), lambda e: joined(e["key"], e["value"]))
    return edges.withColumn("id", F.sha2(joined(F.col("kind"), F.col("from_id"), F.col("to_id"), F.array_join(told, "")), 256)).select("id", "kind", "from_id", "to_id", "props")


def record(op: str, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node log, edges, refused rows with `why`) of an operation over rows(seq, ...). Columns it does not know are left alone; those it misses are null."""
    spec = RECORDS[op]
    good, bad = _judged(op, rows)
    good = good.withColumn("node_id", record_id(spec.kind, spec.identity))
    props = [(F.lit(c), F.col(c)) for c in (*spec.identity, *spec.state)] + [(F.lit(k), F.lit(v)) for k, v in spec.fixed.items()]
    log = good.select("seq", F.lit(spec.kind).alias("kind"), F.col("node_id").alias("id"), _map(props).alias("props"))
    parts = []
    for x in spec.links:
        ends = [F.col(c or "node_id") for c in (x.source, x.target)]
        pairs = [(F.lit(k), F.col(c or "node_id")) for k, c in x.props.items()] + [(F.lit(k), F.lit(v)) for k, v in x.fixed.items()]
        own = good.where(ends[0].isNotNull() & ends[1].isNotNull()).select(F.lit(x.kind).alias("kind"), ends[0].alias("from_id"), ends[1].alias("to_id"), _map(pairs).alias("props"))
        parts.append(own)
    edges = union_all(parts) if parts else rows.sparkSession.createDataFrame([], f"kind string, from_id string, to_id string, props {PROPS}")
    return (log if spec.kind else log.where("false")), _named(edges), bad


def state(op: str, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, refused rows): the same as store.merged() of record()'s log, store.linked() of its edges and its refused rows.

    A node is shuffled as one partial row with its identity, and an edge with the columns it is made of; hashes and maps, of
    several times their size, are made of what is left. A missing identity value counts as empty, as in the node's hash.
    """
    spec = RECORDS[op]
    good, bad = _judged(op, rows)
    own = [f"_i{i}" for i in range(len(spec.identity))]
    keys = [F.coalesce(c, F.lit("")).alias(k) for k, c in zip(own, spec.identity, strict=True)]
    hashed = F.sha2(joined(F.lit(spec.kind), *[F.col(k) for k in own]), 256)
    if spec.kind:
        other = [c for c in dict.fromkeys(spec.state) if c not in spec.identity]
        has = [F.max(F.col(c).isNotNull()).alias(f"_h{i}") for i, c in enumerate(spec.identity)]
        last = [F.max(F.when(F.col(c).isNotNull(), F.struct("seq", F.col(c).alias("value")))).alias(f"_s{i}") for i, c in enumerate(other)]
        latest = good.groupBy(*keys).agg(*has, *last)
        props = [(F.lit(c), F.when(F.col(f"_h{i}"), F.col(k))) for i, (k, c) in enumerate(zip(own, spec.identity, strict=True))]
        props += [(F.lit(c), F.col(f"_s{i}.value")) for i, c in enumerate(other)] + [(F.lit(k), F.lit(v)) for k, v in spec.fixed.items()]
        nodes = latest.select(F.lit(spec.kind).alias("kind"), hashed.alias("id"), _map(props).alias("props"))
    else:
        nodes = rows.sparkSession.createDataFrame([], f"kind string, id string, props {PROPS}")
    parts = []
    for x in spec.links:
        wanted = [x.source, x.target, *x.props.values()]
        made = dict(zip(own, keys, strict=True)) if "" in wanted else {}
        # an end is never null, so one of the identity is its key
        at = [own[spec.identity.index(c)] if made and c in spec.identity else f"_e{i}" for i, c in enumerate(wanted[:2])] + [f"_p{i}" for i in range(len(x.props))]
        made |= {a: F.col(c).alias(a) for a, c in zip(at, wanted, strict=True) if c and a not in made}
        each = good.dropna(subset=[c for c in wanted[:2] if c]).select(*made.values()).distinct()
        from_id, to_id, *values = [F.col(a) if c else hashed for a, c in zip(at, wanted, strict=True)]
        pairs = [(F.lit(k), v) for k, v in zip(x.props, values, strict=True)] + [(F.lit(k), F.lit(v)) for k, v in x.fixed.items()]
        parts.append(each.select(F.lit(x.kind).alias("kind"), from_id.alias("from_id"), to_id.alias("to_id"), _map(pairs).alias("props")))
    edges = _named(union_all(parts) if parts else rows.sparkSession.createDataFrame([], f"kind string, from_id string, to_id string, props {PROPS}"))
    return nodes, edges if len({x.kind for x in spec.links}) == len(spec.links) else linked(edges), bad


def advance(requests: DataFrame, steps: dict[str, list[str]], start: str = "UNKNOWN") -> DataFrame:
    """requests(key, seq, wanted) with from_state, accepted, state: each key's requests in order of seq, ties by state, taken up where the steps allow it.

    Whether a step is legal hangs on all before it, so a key's requests pass one task in order; the task holds one state
    for the key at hand and no list. Null keys are one key; a null wanted state is never legal.
    """
    allowed = {k: set(v) for k, v in steps.items()}
    names = ["key", "seq", "wanted", "from_state", "accepted", "state"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, state = object(), start
        for batch in batches:
            rows = []
            for key, seq, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != before:
                    before, state = key, start
                ok = wanted in allowed.get(state, ())
                rows.append((key, seq, wanted, state, ok, wanted if ok else state))
                state = rows[-1][-1]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    own = requests.select(F.col("key").cast("string"), F.col("seq").cast("long"), F.col("wanted").cast("string"))
    ordered = own.repartition("key").sortWithinPartitions("key", "seq", "wanted")
    return ordered.mapInArrow(run, "key string, seq long, wanted string, from_state string, accepted boolean, state string")
