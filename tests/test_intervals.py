"""Points and spans against plain loops."""

import random

from tesselode.operators import intervals as N

SPAN = "path string, start long, end long, id long, note string"
POINT = "path string, at long, point_id long, note2 string"


def rows():
    r = random.Random(3)
    spans = [(r.choice("ab"), s := r.randrange(60), r.choice([None, s - 1, s, s + r.randrange(40), s + 10**6]), i, "x") for i in range(60)]
    spans += [(None, 1, 2, 100, "x"), ("a", None, 2, 101, "x"), ("a", -5, 3, 102, "x"), ("b", 0, None, 103, "x"), ("b", 7, 7, 104, None), ("b", 7, 7, 104, None), ("c", 0, 2**40, 105, "x")]
    points = [(r.choice("abc"), r.randrange(-2, 110), i, "y") for i in range(80)] + [(None, 3, 900, "y"), ("a", None, 901, "y"), ("c", 2**31 - 1, 902, "y"), ("c", 2**31, 903, "y")]
    return spans, points


def ends(s):
    p, start, end, i, _ = s
    last = 2**31 - 1
    return None if p is None or start is None else (p, max(start, 0), min(last if end is None else end, last), i)


def test_against_loops(spark):
    spans, points = rows()
    own = [e for e in map(ends, spans) if e and e[1] <= e[2]]
    s, p = spark.createDataFrame(spans, SPAN), spark.createDataFrame(points, POINT)
    got = sorted((x["point_id"], x["id"], x["note"] or "", x["note2"]) for x in N.within(p, s).collect())
    assert len(got) == sum(a == q[0] and q[1] is not None and b <= q[1] <= c and q[1] < 2**31 for a, b, c, _ in own for q in points)
    want = {}
    for path, at, i, _ in points:
        held = [(c - b, -b, k) for a, b, c, k in own if a == path and at is not None and b <= at <= c]
        if held:
            want[i] = min(held)[2]
    assert {x["point_id"]: x["span_id"] for x in N.innermost(p, s).collect()} == want
    pairs = sorted((a[0], a[3], b[3], max(a[1], b[1]), min(a[2], b[2])) for a in own for b in own if a[0] == b[0] and a[1] <= b[2] and b[1] <= a[2])
    assert sorted(tuple(x) for x in N.overlaps(s, s).collect()) == pairs
    assert N.within(p.limit(0), s).count() == 0 and N.overlaps(s, s.limit(0)).count() == 0


def test_no_side_is_broadcast(spark):
    spans, points = rows()
    s, p = spark.createDataFrame(spans, SPAN), spark.createDataFrame(points, POINT)
    for df in (N.within(p, s), N.innermost(p, s), N.overlaps(s, s), N.touched(s, s)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_touched_counts_what_overlaps_pairs(spark):
    s = spark.createDataFrame(rows()[0] + [("d", 0, None, 200, "x"), ("d", 1000, 1023, 201, "x"), ("d", 1024, 5000, 202, "x"), ("e", 3, 4, 203, "x")], SPAN)
    want = {}
    for x in N.overlaps(s, s).collect():
        n, lines = want.get(x["left_id"], (0, 0))
        want[x["left_id"]] = n + 1, lines + x["last"] - x["first"] + 1
    assert {x["id"]: (x["hunks"], x["lines"]) for x in N.touched(s, s).collect()} == want
    assert N.touched(s, s.limit(0)).count() == 0
