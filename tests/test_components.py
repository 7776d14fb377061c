"""Components, condensation and layers against plain walks, over the cluster and in one task; identities with odd characters."""

import random

import pytest

from tesselode.operators import graph as G
from tesselode.operators import records as R
from tesselode.operators import resolve as V
from tesselode.operators import store as S

EDGE = "from_id string, to_id string"


def reachable(pairs):
    out = {}
    for x in {x for p in pairs for x in p}:
        todo, seen = [x], {x}
        while todo:
            a = todo.pop()
            for b in (t for f, t in pairs if f == a and t not in seen):
                seen.add(b)
                todo.append(b)
        out[x] = seen
    return out


def plain(pairs):
    to = reachable(pairs)
    of = {x: min(y for y in to[x] if x in to[y]) for x in to}
    dag, level = {(of[a], of[b]) for a, b in pairs if of[a] != of[b]}, {}

    def below(c):
        if c not in level:
            level[c] = max((1 + below(t) for f, t in dag if f == c), default=0)
        return level[c]

    return of, {x: below(of[x]) for x in to}


@pytest.mark.parametrize("seed, small", [(1, 0), (2, 1000), (3, 8)])
def test_against_plain(spark, seed, small):
    r = random.Random(seed)
    pairs = [(f"n{r.randrange(24)}", f"n{r.randrange(24)}") for _ in range(34)] + [("loop", "loop"), ("x", "y"), ("x", "y")]
    of, level = plain(pairs)
    edges = spark.createDataFrame([*pairs, (None, "n1"), ("n1", None)], EDGE)
    assert {x["id"]: x["component"] for x in G.components(edges, small).collect()} == of
    assert {x["id"]: (x["component"], x["level"]) for x in G.layers(edges, small).collect()} == {x: (of[x], level[x]) for x in of}


def test_long_chain_and_ring(spark):
    chain = [(f"f{i:04}", f"f{i + 1:04}") for i in range(1000)]
    got = {x["id"]: x["level"] for x in G.layers(spark.createDataFrame(chain, EDGE)).collect()}
    assert got == {f"f{i:04}": 1000 - i for i in range(1001)}
    assert G.strong_components(spark.createDataFrame(chain, EDGE)).count() == 0
    ring = [(f"f{i:03}", f"f{(i + 1) % 400:03}") for i in range(400)]
    assert {(x["component"], x["size"]) for x in G.strong_components(spark.createDataFrame(ring, EDGE)).collect()} == {("f000", 400)}
    none = spark.createDataFrame([], EDGE)
    assert G.components(none).count() == 0 and G.layers(none).count() == 0


def test_peeling_stops_when_little_goes(spark, monkeypatch):
    """A ring with a short tail: the tail's nodes would go one in a round over all edges."""
    ring = [(f"r{i}", f"r{(i + 1) % 40}") for i in range(40)] + [(f"r{i}", f"r{(i + 7) % 40}") for i in range(40)]
    tail = [("r0", "t0"), ("t0", "t1"), ("t1", "t2"), ("t2", "t3")]
    colours, spread = [], G._spread
    monkeypatch.setattr(G, "_spread", lambda labels, edges, *rest: colours.append(edges.count()) or spread(labels, edges, *rest))
    got = {x["id"]: x["component"] for x in G.components(spark.createDataFrame(ring + tail, EDGE), 0).collect()}
    assert got == {x: "r0" if x[0] == "r" else x for p in ring + tail for x in p}
    assert colours[0] == 83


def test_properties_and_identities_do_not_melt(spark):
    edges = spark.createDataFrame([("1", "C", "a", "b", {"a": "1;b=2"}), ("2", "C", "a", "b", {"a": "1", "b": "2"}), ("3", "C", "a", "b", {"b": "2", "a": "1"}), ("4", "C", "a", "b", None), ("5", "C", "a", "b", {})], "id string, kind string, from_id string, to_id string, props map<string,string>")
    assert sorted(x["id"] for x in S.linked(edges).collect()) == ["1", "2", "4"]
    rows = spark.createDataFrame([(1, "p", "x|y", "z"), (2, "p", "x", "y|z"), (3, "p|x", "y", "z"), (4, "p", None, "1:z")], "seq long, project_id string, subject_id string, description string")
    log, _, _ = R.record("record_evidence", rows)
    assert S.merged(log).count() == 4
    told = spark.createDataFrame([(1, "p", "t", "b", "i", 0.5, "m"), (2, "p", "t", "b", "i", 0.6, "m")], "seq long, project_id string, test_name string, binary_function_id string, implementation_id string, confidence double, method string")
    _, links, _ = R.record("record_validation", told)
    assert len({x["id"] for x in links.where("kind = 'EQUIVALENT_TO'").collect()}) == 2


def test_a_name_that_all_hold_is_one_row(spark):
    n = 3000
    rows = [(str(i), "init", "", f"f{i}.go", ["init", "solo"]) for i in range(n)] + [("x", "solo", "", "x.go", [])]
    got = V.resolve_calls(spark.createDataFrame(rows, "id string, name string, owner string, path string, calls array<string>"))
    assert got.count() == n and {x["to_id"] for x in got.collect()} == {"x"}


def test_tasks_follow_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 7)
    monkeypatch.setattr(V, "TASK_PAIRS", 40)
    left = spark.createDataFrame([(i, f"k{i % 3}") for i in range(60)] + [(99, None), (98, "lone")], "a int, k string")
    right = spark.createDataFrame([(i, f"k{i % 2}") for i in range(40)] + [(99, None)], "b int, k string")
    got = V.paired(left, right, ["k"])
    want = sorted(tuple(x) for x in left.join(right, "k").collect())
    assert sorted((x["k"], x["a"], x["b"]) for x in got.collect()) == want
    assert got.rdd.getNumPartitions() == len(want) // 40
    assert V.paired(left.limit(0), right, ["k"]).count() == 0


def test_pairs_of_a_file_are_not_shuffled(spark):
    """A name that all of a file hold: its pairs are told as they meet, and no aggregate stands over them."""
    n = 300
    rows = [(str(i), "init", "A" if i % 2 else "", "f.go", ["init", "A.init", "B.init"]) for i in range(n)]
    columns = "id string, name string, owner string, path string, calls array<string>"
    top = lambda df: df._jdf.queryExecution().optimizedPlan().toString().split()[0]
    got = V.resolve_calls(spark.createDataFrame(rows, columns))
    told = [(x["from_id"], x["to_id"]) for x in got.collect()]
    assert top(got) == "Union" and len(told) == len(set(told)) == n * (n - 1) and {x["confidence"] for x in got.collect()} == {0.9}
    # an id that stands twice is still told once
    assert V.resolve_calls(spark.createDataFrame([*rows, ("1", "init", "B", "f.go", ["init"])], columns)).count() == n * (n - 1)
    types = spark.createDataFrame([(str(i), "T" if i % 2 else "S", "f.go") for i in range(n)], "id string, name string, path string")
    told = spark.createDataFrame([("f.go", "S", "extends", "T"), ("g.go", "S", "extends", "T")], "path string, sub string, rel string, super string")
    got = V.resolve_inheritance(types, told)
    assert top(got) == "Union" and got.count() == got.distinct().count() == n * n // 4


def layered(n):
    """A graph like the key graph: hubs that spokes point back at, spokes to leaves, leaves to a few ends."""
    out = [(f"hub{i % n}", f"spoke{i}") for i in range(8 * n)] + [(f"spoke{i}", f"hub{i % n}") for i in range(0, 8 * n, 3)]
    return out + [(f"spoke{i}", f"leaf{j % (2 * n)}") for i in range(8 * n) for j in (i * 7, i * 5 + 1)] + [(f"leaf{i}", f"end{i % 3}") for i in range(2 * n)]


def test_stars_and_layers_need_no_colours(spark, monkeypatch):
    def stop(*_):
        raise AssertionError("a colour was spread")

    monkeypatch.setattr(G, "_spread", stop)
    pairs = layered(6)
    of, level = plain(pairs)
    edges = spark.createDataFrame(pairs, EDGE)
    assert {x["id"]: x["component"] for x in G.components(edges, 0).collect()} == of
    assert {x["id"]: (x["component"], x["level"]) for x in G.layers(edges, 0).collect()} == {x: (of[x], level[x]) for x in of}


@pytest.mark.parametrize("small", [0, 1000])
def test_the_lowest_by_rank_stands_for_a_component(spark, small):
    """Numbers whose texts stand in another order, with stars, rings and a ring through a star."""
    pairs = [(2, 10), (10, 2), (10, 33), (33, 10), (5, 40), (40, 6), (6, 5), (100, 7), (7, 100), (7, 8), (8, 9), (9, 100), (2, 5), (5, 7), (3, 3)]
    of, level = plain([(str(a), str(b)) for a, b in pairs])
    edges = spark.createDataFrame(pairs, "from_id long, to_id long")
    rank = lambda n: n.cast("string")
    got = G.layers_of_numbers(edges, small, rank).collect()
    assert {str(x["id"]): (str(x["component"]), x["level"]) for x in got} == {x: (of[x], level[x]) for x in of}
    other, between = G.contracted(edges, small, rank)
    assert {str(x["id"]): str(x["component"]) for x in other.collect()} == {x: c for x, c in of.items() if x != c}
    assert {(str(x["from_id"]), str(x["to_id"])) for x in between.collect()} == {(of[str(a)], of[str(b)]) for a, b in pairs if of[str(a)] != of[str(b)]}
