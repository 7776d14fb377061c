"""The pipeline's stages against plain versions, and what they do with odd rows."""

import random
import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as pipeline  # noqa: E402

from test_minhash import brute as groups  # noqa: E402
from test_repeats import brute as repeats  # noqa: E402

STAGE = dict(pipeline.STAGES)
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder of tables with planted copies, passages, benchmark items and toxic texts."""
    r = random.Random(21)
    words = ["w%d" % i for i in range(3000)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, text(40) + ". " + text(8) + ".") for i in range(5)]
    passage = text(70)
    rows, toxic = [], set()
    for i in range(0, 240):
        t = text(r.randint(30, 120))
        if i % 8 == 0:
            t, toxic = t + " vile scum moron " * 3, toxic | {i}
        elif i % 20 == 1:
            t = f"{t} {passage} {text(20)}"
        elif i % 30 == 2:
            t = f"{t} {items[i % 5][1]} {text(20)}"
        rows.append((i, t))
    copies = [(300 + k, rows[3 + 16 * k][1] + (" extra" if k % 2 else "")) for k in range(8)]
    odd = [(400, None), (401, ""), (402, " \n "), (403, "few words"), (404, "few words"), (405, "x" * 300_000), (None, rows[5][1]), (5, rows[5][1])]
    rows = [(i, t, "en", "s%d" % (k % 3), None if t is None else len(t)) for k, (i, t) in enumerate(rows + copies + odd)]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(0, 200)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows, items, toxic


def test_names_and_order():
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "packing"] and pipeline.ORACLE_SQL is None


def test_each_stage_equals_a_plain_version(spark, corpus):
    folder, rows, items, toxic = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = STAGE["toxicity"](spark, docs, folder)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} == {x[0] for x in rows} - toxic

    out = STAGE["near_dedup"](spark, docs, folder)
    want = groups([(i, t) for i, t, *_ in rows])
    assert out.columns == docs.columns and sorted(str(r["doc_id"]) for r in out.collect()) == sorted(["None"] + [str(i) for i, v in want.items() if v[2]])

    out = STAGE["substring_dedup"](spark, docs, folder)
    cut = repeats([(i, t, None) for i, t, *_ in rows], lambda t: t.encode().split(), 13, True)
    left = {str(i): b" ".join(k).decode() if gone else t for (i, t), (n, gone, _, k) in cut.items() if not gone or gone < n}
    got = {str(r["doc_id"]): r for r in out.collect()}
    assert out.columns == docs.columns and {i: r["text"] for i, r in got.items()} == left
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got.values())

    out = STAGE["decontamination"](spark, docs, folder)
    grams = lambda t: {tuple(w[k : k + 5]) for w in [re.findall("[0-9a-z]+", (t or "").lower())] for k in range(len(w) - 4)}
    bench = [grams(t) for _, t in items]
    leak = {i for i, t, *_ in rows if i is not None and any(len(g & grams(t)) >= 0.75 * len(g) for g in bench)}
    assert leak and out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == {x[0] for x in rows} - leak


def test_the_run_is_its_stages_one_after_the_other(spark, corpus):
    folder, rows, items, toxic = corpus
    pieces = pipeline.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), DOCS)
    kept = {r["doc_id"] for r in docs.collect()}
    assert {p["doc_id"] for p in pieces} == kept and not kept & toxic and {400, 401, 402, 403} <= kept
    whole = {}
    for p in pieces:
        whole.setdefault((p["doc_id"], p["doc_tokens"]), []).append((p["start"], p["length"]))
    for (i, n), x in whole.items():
        if i is not None:
            at = 0
            for start, length in sorted(x):
                assert start == at
                at += length
            assert at == n


def test_clashing_columns_and_empty_tables(spark, corpus):
    folder, rows, *_ = corpus
    names = ["score", "evidence", "n_tokens", "n_removed", "n_spans", "kept_sha256", "part", "__done", "__leak", "__key", "component_id", "item_id"]
    docs = spark.createDataFrame([(*x, *range(len(names))) for x in rows[:60]], DOCS + "".join(f", `{n}` int" for n in names))
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert {tuple(r[n] for n in names) for r in out.collect()} == {tuple(range(len(names)))}, name
    empty = docs.where("false")
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0, name
    assert {p["doc_id"] for p in STAGE["packing"](spark, docs, folder).collect()} == {x[0] for x in rows[:60]}
