"""Property-graph operators over nodes(id, kind, name) and edges(id, kind, from_id, to_id)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselode.sources.tables import settle


def neighbors(nodes: DataFrame, edges: DataFrame, node_id: str, direction: str = "out", kinds: list[str] | None = None) -> DataFrame:
    """Neighbour nodes with the edge that leads to them; a self-loop shows twice for both directions."""
    if direction == "both":
        return neighbors(nodes, edges, node_id, "out", kinds).unionByName(neighbors(nodes, edges, node_id, "in", kinds))
    near, far = ("from_id", "to_id") if direction == "out" else ("to_id", "from_id")
    e = edges.where(F.col(near) == node_id)
    if kinds:
        e = e.where(F.col("kind").isin(kinds))
    e = e.select(F.col("id").alias("edge_id"), F.col("kind").alias("edge_kind"), F.col(far).alias("id"))
    return e.join(nodes, "id").select("edge_id", "edge_kind", F.lit(direction).alias("direction"), "id", "kind", "name")


def reach(edges: DataFrame, starts: DataFrame, depth: int, inbound: bool = True) -> DataFrame:
    """(id, distance, via) within depth steps; via is the least edge id at the least distance. starts(id) are not part of it."""
    near, far = ("to_id", "from_id") if inbound else ("from_id", "to_id")
    step = edges.select(F.col(near).alias("id"), F.col(far).alias("next"), F.col("id").alias("edge"))
    frontier = starts.select("id")
    seen = frontier.select("id", F.lit(0).alias("distance"), F.lit(None).cast(edges.schema["id"].dataType).alias("via"))
    for d in range(1, depth + 1):
        hop = frontier.join(step, "id").groupBy(F.col("next").alias("id")).agg(F.min("edge").alias("via"))
        new = settle(hop.join(seen.select("id"), "id", "left_anti").select("id", F.lit(d).alias("distance"), "via"))
        if not new.take(1):
            break
        seen = seen.unionByName(new)
        frontier = new.select("id")
    return seen.where("distance > 0")


#: Edge kinds along which a change spreads to what points at it.
IMPACT_KINDS = ["CALLS", "REFERENCES", "USES", "HAS_TYPE", "IMPORTS", "DEPENDS_ON", "DATA_FLOW"]
#: Fixed limits: depth, edges looked at for each node, nodes by default and at most, edges in all.
MAX_DEPTH, FAN_OUT, NODES, MAX_NODES, MAX_EDGES = 64, 1024, 1000, 10_000, 100_000


def impact(edges: DataFrame, node_id: str, depth: int, limit: int = NODES, kinds: list[str] | None = None, fan_out: int = FAN_OUT) -> DataFrame:
    """(id, distance, via) of what a change of node_id reaches over inbound edges; via is the kind of the first edge to it by id.

    Depth is held to 0..64 and limit to 1..10,000, as the feature's own bounds: of each node the first fan_out inbound
    edges by (id, from_id) are looked at, of whatever kind, and those of the kinds followed; the nearest nodes stay,
    ties by id. Walking ends when MAX_EDGES edges were looked at. The frontier is never longer than the limit, and is broadcast.
    """
    depth, limit = min(max(depth, 0), MAX_DEPTH), min(limit if limit > 0 else NODES, MAX_NODES)
    spark = edges.sparkSession
    first = Window.partitionBy("to_id").orderBy("id", "from_id")
    seen, frontier, looked, found = {node_id}, [node_id], 0, []
    for d in range(1, depth + 1):
        if not frontier or len(found) >= limit or looked >= MAX_EDGES:
            break
        near = F.broadcast(spark.createDataFrame([(x,) for x in frontier], "to_id string"))
        step = edges.join(near, "to_id", "left_semi").withColumn("r", F.row_number().over(first)).where(F.col("r") <= fan_out)
        step = step.orderBy("to_id", "id", "from_id").limit(MAX_EDGES - looked)
        hop = step.groupBy("from_id").agg(F.min(F.when(F.col("kind").isin(kinds or IMPACT_KINDS), F.struct("id", "kind"))).alias("x"), F.count("*").alias("n"))
        rows = hop.collect()  # at most MAX_EDGES
        looked += sum(r["n"] for r in rows)
        new = sorted((r["from_id"], r["x"]["kind"]) for r in rows if r["x"] is not None and r["from_id"] not in seen)[: limit - len(found)]
        found += [(i, d, k) for i, k in new]
        frontier = [i for i, _ in new]
        seen.update(frontier)
    return spark.createDataFrame(found, "id string, distance int, via string")


def impact_whole(edges: DataFrame, node_id: str, depth: int, kinds: list[str] | None = None) -> DataFrame:
    """(id, distance, via) of all that a change of node_id reaches over inbound edges of the kinds, without impact's limits on nodes and edges.

    via is the kind of the first edge by id that leads to a node one step nearer. Frontiers stay on the cluster.
    """
    step = edges.where(F.col("kind").isin(kinds or IMPACT_KINDS)).withColumn("id", F.struct("id", "kind"))
    start = edges.sparkSession.range(1).select(F.lit(node_id).alias("id"))
    return reach(step, start, depth).select("id", "distance", F.col("via.kind").alias("via"))


def closure(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """All (src, dst) with a path of one step or more; paths double each round, so rounds grow with the log of the longest."""
    out = settle(edges.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")).distinct())
    size = out.count()
    for _ in range(rounds):
        longer = out.alias("x").join(out.alias("y"), F.col("x.dst") == F.col("y.src")).select("x.src", "y.dst")
        out = settle(out.unionByName(longer).distinct())
        now = out.count()
        if now == size:
            return out
        size = now
    raise RuntimeError("the closure did not settle")


def shortest_path(edges: DataFrame, source: str, target: str, max_depth: int) -> DataFrame:
    """One row (path, hops): the least of the shortest paths, as ids joined by '>'; none if there is none."""
    spark = edges.sparkSession
    step = edges.select("from_id", "to_id")
    now = spark.createDataFrame([(source, source)], "id string, path string")
    seen = now.select("id")
    for hops in range(max_depth + 1):
        hit = now.where(F.col("id") == target).select("path", F.lit(hops).alias("hops"))
        if hops == max_depth or hit.take(1) or not now.take(1):
            return hit
        grown = now.join(step, now["id"] == step["from_id"]).select(F.col("to_id").alias("id"), F.concat_ws(">", "path", "to_id").alias("path"))
        now = settle(grown.groupBy("id").agg(F.min("path").alias("path")).join(seen, "id", "left_anti"))
        seen = seen.unionByName(now.select("id"))
    return hit


#: Edges of a rest that one task finishes; above it the rounds go on over the cluster.
SMALL = 200_000
#: Nodes without edges out that are broadcast.
SINKS = 1_000_000


def _ids(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("from_id").alias("id")).unionByName(edges.select(F.col("to_id").alias("id"))).distinct()


def _in_one_task(rest: DataFrame, solve: Callable[[list[int], list[tuple[int, int]]], list[int]]) -> DataFrame:
    """(id, value) of solve(ids, edges as positions) over a rest that was counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[int, int] = {}
        pairs = [(at.setdefault(a, len(at)), at.setdefault(b, len(at))) for batch in batches for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        names = list(at)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(solve(names, pairs), pa.int64())], names=["id", "value"])

    return rest.select("from_id", "to_id").coalesce(1).mapInArrow(run, "id long, value long")


def _successors(n: int, pairs: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(n)]
    for a, b in pairs:
        out[a].append(b)
    return out


def _least_of_cycle(names: list[int], pairs: list[tuple[int, int]]) -> list[int]:
    """The least name of each one's strong component, by an order of finishing times and a walk against the edges."""
    n = len(names)
    ahead, back = _successors(n, pairs), _successors(n, [(b, a) for a, b in pairs])
    seen, order = [False] * n, []
    for root in range(n):
        if seen[root]:
            continue
        seen[root], stack = True, [(root, iter(ahead[root]))]
        while stack:
            node, left = stack[-1]
            following = next((x for x in left if not seen[x]), None)
            if following is None:
                order.append(node)
                stack.pop()
            else:
                seen[following] = True
                stack.append((following, iter(ahead[following])))
    out: list[int | None] = [None] * n
    for root in reversed(order):
        if out[root] is None:
            group, todo, out[root] = [root], [root], -1
            while todo:
                for x in back[todo.pop()]:
                    if out[x] is None:
                        out[x] = -1
                        group.append(x)
                        todo.append(x)
            least = min(names[x] for x in group)
            for x in group:
                out[x] = least
    return out


def _chain_below(names: list[int], pairs: list[tuple[int, int]]) -> list[int]:
    """Longest chain below each node of an acyclic rest."""
    n = len(names)
    ahead, back = _successors(n, pairs), _successors(n, [(b, a) for a, b in pairs])
    left, out = [len(x) for x in ahead], [0] * n
    todo = [i for i in range(n) if not left[i]]
    while todo:
        node = todo.pop()
        for x in back[node]:
            out[x] = max(out[x], out[node] + 1)
            left[x] -= 1
            if not left[x]:
                todo.append(x)
    if any(left):
        raise ValueError("the graph has a cycle")
    return out


def _numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, n), numbered in order of their ids, and the edges (from_id, to_id) as numbers; null ends are left out."""
    told = edges.select("from_id", "to_id").where("from_id IS NOT NULL AND to_id IS NOT NULL")
    nodes = settle(_ids(told).orderBy("id").select("id", F.monotonically_increasing_id().alias("n")))
    for end in ("from_id", "to_id"):
        told = told.join(nodes.select(F.col("id").alias(end), F.col("n").alias(f"n_{end}")), end).drop(end)
    return nodes, settle(told.select(F.col("n_from_id").alias("from_id"), F.col("n_to_id").alias("to_id")))


def _spread(labels: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, label): the least label that reaches each node along edges. sources(id, label) are those of labels that may lessen others.

    In as many rounds as the longest way of a label; a round sends only labels that moved in the last one.
    """
    moved = sources
    while True:
        told = edges.join(moved.withColumnRenamed("id", "from_id"), "from_id").groupBy(F.col("to_id").alias("id")).agg(F.min("label").alias("told"))
        moved = settle(told.join(labels, "id").where("told < label").select("id", F.col("told").alias("label")))
        n = moved.count()
        if not n:
            return labels
        # a few labels are laid over the table at once, many go through one shuffle
        newer = moved.withColumnRenamed("label", "newer")
        labels = settle(labels.join(F.broadcast(newer) if n <= SMALL else newer, "id", "left").select("id", F.coalesce("newer", "label").alias("label")))


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(id, component) of every node on an edge: the least id of its strong component, its own if it is on no cycle.

    On numbers in order of ids: nodes with edges both ways between them are one; then rounds over the cluster: nodes
    without edges in, or out, are on no cycle and go, as long as PEEL of the edges go with them; the least id that
    reaches a node colours it; what reaches the colour's own node within the colour is its component and goes, and so do
    edges between colours. A rest of `small` edges or fewer is finished by one task. Repeated edges and loops change
    nothing; null ends are left out.
    """
    nodes, numbers = _numbered(edges)
    other, _ = contracted(numbers, small)
    # only nodes that another one stands for have to look up a name
    other = other.toDF("n", "c").join(nodes.select(F.col("n").alias("c"), F.col("id").alias("component")), "c").select("n", "component")
    return settle(nodes.join(other, "n", "left").select("id", F.coalesce("component", "id").alias("component")))


#: The part of the edges that a round has to take off for peeling to go on.
PEEL = 0.05


def _mutual(edges: DataFrame, rank: Callable[[Column], Column]) -> DataFrame:
    """(id, component) of nodes that have edges both ways with nodes of lower rank: the lowest of these."""
    a, b = F.col("from_id"), F.col("to_id")
    both = edges.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.when(a < b, 1).otherwise(2).alias("way"))
    both = settle(both.groupBy("a", "b").agg(F.bit_or("way").alias("way")).where("way = 3").select("a", "b"))
    near = both.toDF("id", "near").unionByName(both.toDF("near", "id"))
    least = near.groupBy("id").agg(F.min(F.struct(rank(F.col("near")).alias("rank"), "near")).alias("x"))
    return settle(least.where(F.col("x.rank") < rank(F.col("id"))).select("id", F.col("x.near").alias("component")))


def _renamed(edges: DataFrame, other: DataFrame) -> DataFrame:
    """Edges between the components of other(id, component); nodes that it lacks stand for themselves."""
    for end in ("from_id", "to_id"):
        edges = edges.join(other.select(F.col("id").alias(end), F.col("component").alias("c")), end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
    return edges.where("from_id <> to_id").select("from_id", "to_id")


def contracted(edges: DataFrame, small: int = SMALL, rank: Callable[[Column], Column] = lambda n: n) -> tuple[DataFrame, DataFrame]:
    """For numbered edges the (id, component) of nodes that another one stands for, the lowest by rank of its strong component, and the edges between components, which may repeat.

    A node's lowest neighbour by edges both ways stands for it first, which makes stars one node; the lowest of a component is never replaced.
    """
    first = _mutual(edges, rank)
    stars = not first.isEmpty()
    rest = settle(_renamed(edges, first)) if stars else edges.where("from_id <> to_id")
    found = _components(rest, small)
    if found is None:
        return first, rest
    groups = settle(found.where("id <> component"))
    # the numbers' least stands for a component so far, and need not be the lowest
    heads = groups.select("component").distinct().select(F.col("component").alias("id"), "component").unionByName(groups.select("id", "component"))
    lowest = heads.groupBy("component").agg(F.min(F.struct(rank(F.col("id")).alias("rank"), "id")).alias("x")).select("component", F.col("x.id").alias("head"))
    later = settle(heads.join(lowest, "component").where("id <> head").select("id", F.col("head").alias("component")))
    if later.isEmpty():
        return first, rest
    if not stars:
        return later, _renamed(rest, later)
    moved = first.join(later.toDF("component", "head"), "component", "left").select("id", F.coalesce("head", "component").alias("component"))
    return settle(moved.unionByName(later.join(first.select("id"), "id", "left_anti"))), _renamed(rest, later)


def _components(edges: DataFrame, small: int) -> DataFrame | None:
    """(id, component) of numbered edges for nodes that were on an edge when their component was found; a node left out is its own."""
    found, rest = [], edges.where("from_id <> to_id")
    n = rest.count()
    while n > small:
        before = n
        for end, other in (("from_id", "to_id"), ("to_id", "from_id")):
            rest = settle(rest.join(rest.select(F.col(other).alias(end)).distinct(), end, "left_semi").select("from_id", "to_id"))
            n = rest.count()
            if n < (1 - PEEL) * before:
                break
        if n < (1 - PEEL) * before or n <= small:
            continue
        labels = settle(_ids(rest).withColumn("label", F.col("id")))
        colour = _spread(labels, rest, labels)
        tint = lambda df, end: df.join(colour.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label")), end)
        within = settle(tint(tint(rest, "from_id"), "to_id").where("from_id_label = to_id_label").select("from_id", "to_id", F.col("from_id_label").alias("label")))
        # against the edges, from each colour's own node; all others start from a label above it
        turned = within.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))
        start = settle(colour.select("id", F.when(F.col("id") == F.col("label"), F.lit(0)).otherwise(1).alias("label")))
        own = _spread(start, turned, start.where("label = 0")).where("label = 0").select("id")
        got = settle(own.join(colour, "id").select("id", F.col("label").alias("component")))
        found.append(got)
        gone = got.select("id")
        rest = settle(within.select("from_id", "to_id").join(gone.withColumnRenamed("id", "from_id"), "from_id", "left_anti").join(gone.withColumnRenamed("id", "to_id"), "to_id", "left_anti").select("from_id", "to_id"))
        n = rest.count()
    if n:
        found.append(_in_one_task(rest, _least_of_cycle).withColumnRenamed("value", "component"))
    return union_all(found) if found else None


def strong_components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(id, component, size) of nodes on cycles of two nodes or more; component is its least id."""
    of = components(edges, small)
    size = of.groupBy("component").agg(F.count("*").alias("size")).where("size > 1")
    return of.join(size, "component").select("id", "component", "size")


def condensed(edges: DataFrame, of: DataFrame) -> DataFrame:
    """Edges between the components of(id, component), each once: an acyclic graph."""
    out = edges.select("from_id", "to_id").where("from_id IS NOT NULL AND to_id IS NOT NULL")
    return _renamed(out, of.where("id <> component")).distinct()


def layers(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(id, component, level): the longest chain of components below a node's own; sinks are 0, a cycle is one step."""
    nodes, numbers = _numbered(edges)
    found = layers_of_numbers(numbers, small)
    name = lambda c: nodes.select(F.col("n").alias(c), F.col("id").alias(f"{c}_name"))
    return found.join(name("id"), "id").join(name("component"), "component").select(F.col("id_name").alias("id"), F.col("component_name").alias("component"), "level")


def layers_of_numbers(edges: DataFrame, small: int = SMALL, rank: Callable[[Column], Column] = lambda n: n) -> DataFrame:
    """layers for numbered edges, where a component is the lowest by rank of its nodes.

    Round k keeps the edges to nodes that have an edge out in round k - 1; a node has level k if it is a start of edges in k rounds.
    The rest shrinks until one task can finish it.
    """
    other, rest = contracted(edges, small, rank)
    rest, told, k = settle(rest), [], 0
    while rest.count() > small:
        k += 1
        starts = settle(rest.select(F.col("from_id").alias("id")).distinct())
        told.append(starts.select("id", F.lit(k).cast("long").alias("value")))
        sinks = settle(rest.select(F.col("to_id").alias("id")).distinct().join(starts, "id", "left_anti"))
        # few sinks are laid over the edges, which then need no shuffle
        few = sinks.count() <= SINKS
        kept = rest.join(F.broadcast(sinks.withColumnRenamed("id", "to_id")), "to_id", "left_anti") if few else rest.join(starts.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
        rest = settle(kept.select("from_id", "to_id"))
    told.append(_in_one_task(rest.distinct(), _chain_below).select("id", (F.col("value") + k).alias("value")))
    level = union_all(told).groupBy(F.col("id").alias("component")).agg(F.max("value").alias("level"))
    of = _ids(edges).join(other, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    return of.join(level, "component", "left").select("id", "component", F.coalesce("level", F.lit(0)).cast("int").alias("level"))


def label_propagation(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(id, label): synchronous rounds, the commonest neighbour label, ties to the least; the least of the last two rounds."""
    both = edges.select("from_id", "to_id").unionByName(edges.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id")))
    label = both.select(F.col("from_id").alias("id"), F.col("from_id").alias("label")).distinct()
    before = label
    for _ in range(rounds):
        votes = both.join(label, both["to_id"] == label["id"]).groupBy("from_id", "label").agg(F.count("*").alias("n"))
        best = F.row_number().over(Window.partitionBy("from_id").orderBy(F.desc("n"), "label"))
        before, label = label, settle(votes.withColumn("r", best).where("r = 1").select(F.col("from_id").alias("id"), "label"))
        if not label.exceptAll(before).take(1):
            break
    return label.join(before.withColumnRenamed("label", "old"), "id").select("id", F.least("label", "old").alias("label"))


def degrees(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("from_id").alias("id")).unionByName(edges.select(F.col("to_id").alias("id")))
    return both.groupBy("id").agg(F.count("*").alias("degree"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
