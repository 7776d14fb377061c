"""URL verdicts: rules by host and path, gradient-boosted trees for what no rule fits. DataFrame functions only.

Trees are grown level by level from histograms: one aggregation sums gradients and curvatures by
(node, feature, bin) over the labelled sample; the driver sees these sums alone and picks the splits.
Gradients are rounded to integers, so sums, and with them the trees, do not depend on the order of
rows. A finished tree is a nested CASE over the feature columns, part of the plan that scores all rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import materialise

#: Labelled URLs that a model is fitted on, about; all others are only scored.
SAMPLE = 32768
ROUNDS, DEPTH, BINS, RATE, L2 = 8, 3, 16, 0.4, 1.0
#: Labels of a host whose statistics are features: the last one, two and three.
SUFFIXES = (1, 2, 3)
#: Rows by which a suffix's share of blocked URLs is pulled towards the share of all.
PRIOR = 10.0
#: Rules that are tested one by one in a CASE; more meet the URLs by the suffixes of their hosts in a join.
INLINE = 64
_UNIT = 1 << 20
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEXICAL = ["length", "host_length", "depth", "digit_ratio", "entropy", "params", "labels", "hyphens"]
NAMES = LEXICAL + [f"suffix{k}_{what}" for k in SUFFIXES for what in ("seen", "share")]


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path; both empty for null and for what has no `://`."""
    pattern = "(?s)://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), _CAPITALS, _CAPITALS.lower()), F.regexp_extract(url, pattern, 2)


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def apply_rules(rows: DataFrame, rules: Sequence[Rule], inline: int = INLINE) -> DataFrame:
    """rows (with host and path) plus rule and rule_verdict of the longest rule that fits (of equal ones the longer host), else null."""
    if len({r.text for r in rules}) < len(rules):
        raise ValueError("two rules have the same host and path")
    order = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.text))
    if len(order) <= inline:
        rule = verdict = F.lit(None).cast("string")
        for r in reversed(order):
            hit = fits(r, F.col("host"), F.col("path"))
            rule, verdict = F.when(hit, r.text).otherwise(rule), F.when(hit, r.verdict).otherwise(verdict)
        return rows.withColumns({"rule": rule, "rule_verdict": verdict})
    spark = rows.sparkSession
    listed = spark.createDataFrame([(i, r.host, r.path, r.text, r.verdict) for i, r in enumerate(order)], "at int, rule_host string, rule_path string, rule string, rule_verdict string")
    # URLs meet rules once a pair of host and path, so a host with most rows counts once for each of its paths
    pairs = rows.select("host", "path").distinct()
    labels = F.split("host", "\\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = pairs.select("host", "path", F.explode(tails).alias("rule_host")).join(listed, "rule_host").where("startswith(path, rule_path)")
    best = met.groupBy("host", "path").agg(F.min(F.struct("at", "rule", "rule_verdict")).alias("best")).select("host", "path", "best.rule", "best.rule_verdict")
    return rows.join(best, ["host", "path"], "left")


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.translate(text, what, ""))


def lexical(rows: DataFrame) -> DataFrame:
    """rows (url, host, path and others) with the columns LEXICAL and a key for each of SUFFIXES."""
    url, host, path = F.coalesce(F.col("url"), F.lit("")), F.col("host"), F.col("path")
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    query = F.regexp_extract(url, "(?s)\\?([^#]*)", 1)
    chars = F.split(url, "")
    # Shannon entropy of the characters: their counts are the differences in length without them
    seen = F.transform(F.array_distinct(F.filter(chars, lambda c: c != "")), lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))).cast("double") / n)
    entropy = F.aggregate(seen, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    labels = F.split(host, "\\.")
    out = rows.withColumns(
        {
            "length": F.length(url).cast("double"),
            "host_length": F.length(host).cast("double"),
            "depth": F.size(F.filter(F.split(path, "/"), lambda s: s != "")).cast("double"),
            "digit_ratio": _count(url, "0123456789") / n,
            "entropy": F.round(entropy, 6),
            "params": F.size(F.filter(F.split(query, "&"), lambda s: s != "")).cast("double"),
            "labels": F.size(labels).cast("double"),
            "hyphens": _count(url, "-_").cast("double"),
        }
    )
    return out.withColumns({f"key{k}": F.array_join(F.slice(F.reverse(labels), 1, k), ".") for k in SUFFIXES})


@dataclass
class Model:
    """Trees as (feature, threshold, left, right) or a leaf's value; statistics of host suffixes; the margin to start from."""

    trees: list
    base: float
    suffixes: DataFrame | None
    share: float


def _with_statistics(rows: DataFrame, suffixes: DataFrame | None, share: float, folds: bool) -> DataFrame:
    """Columns suffix*_seen and suffix*_share, of half the sample: of a row's other fold with folds (no row sees its own label), else of the mean of both."""
    for k in SUFFIXES:
        seen, bad = F.lit(0.0), F.lit(0.0)
        if suffixes is not None:
            # suffixes come from SAMPLE URLs, so there are len(SUFFIXES) * SAMPLE of them at most
            own = [F.col(c).alias(f"_{c}") for c in ("seen0", "seen1", "bad0", "bad1")]
            mine = F.broadcast(suffixes.where(F.col("k") == k).select(F.col("key").alias(f"key{k}"), *own))
            rows = rows.join(mine, f"key{k}", "left")
            pick = lambda c: F.when(F.col("fold") == 0, F.col(f"_{c}1")).otherwise(F.col(f"_{c}0")) if folds else (F.col(f"_{c}0") + F.col(f"_{c}1")) / 2
            seen, bad = F.coalesce(pick("seen"), F.lit(0)), F.coalesce(pick("bad"), F.lit(0))
        rows = rows.withColumns({f"suffix{k}_seen": seen.cast("double"), f"suffix{k}_share": F.round((bad + PRIOR * share) / (seen + PRIOR), 6)}).drop("_seen0", "_seen1", "_bad0", "_bad1")
    return rows


def _tree_sql(tree, at: Sequence[str]) -> str:
    if not isinstance(tree, tuple):
        return f"{tree!r}D"
    feature, cut, left, right = tree
    return f"CASE WHEN {at[feature]} <= {cut!r}D THEN {_tree_sql(left, at)} ELSE {_tree_sql(right, at)} END"


def _node_sql(level: dict[int, tuple[int, int]], depth: int) -> str:
    """Number of the node a row of bins is in, after splits {node: (feature, bin)}; -1 behind a node that is not split."""
    out = "0"
    for d in range(depth):
        here = [(n, s) for n, s in level.items() if 2**d <= n + 1 < 2 ** (d + 1)]
        cases = " ".join(f"WHEN {n} THEN IF(b{f} <= {b}, {2 * n + 1}, {2 * n + 2})" for n, (f, b) in here)
        out = f"CASE {out} {cases} ELSE -1 END" if cases else "-1"
    return out


def _grow(cells: DataFrame, margin: str, cuts: list[list[float]]) -> tuple[object, object]:
    """One tree over cells (b0.., n, pos): over thresholds, and over bins as SQL reads it."""
    p = f"(1D / (1D + exp(-({margin}))))"
    rows = cells.selectExpr("*", f"CAST(round((pos - n * {p}) * {_UNIT}) AS LONG) AS g", f"CAST(round(n * {p} * (1D - {p}) * {_UNIT}) AS LONG) AS h")
    splits: dict[int, tuple[int, int]] = {}
    sums: dict[int, tuple[int, int]] = {}
    bins = F.posexplode(F.array(*[F.col(f"b{i}") for i in range(len(cuts))])).alias("f", "b")
    gain = lambda g, h: g * g / (h + L2 * _UNIT) / _UNIT
    for d in range(DEPTH):
        at = rows.withColumn("node", F.expr(_node_sql(splits, d))).where("node >= 0")
        found: dict[tuple[int, int], list] = {}
        for node, f, b, g, h in at.select("node", "g", "h", bins).groupBy("node", "f", "b").agg(F.sum("g"), F.sum("h")).collect():
            found.setdefault((node, f), []).append((b, g, h))
        best: dict[int, tuple] = {}
        for (node, f), hist in sorted(found.items()):
            hist.sort()
            g, h = sum(x[1] for x in hist), sum(x[2] for x in hist)
            sums[node] = (g, h)
            left_g = left_h = 0
            for b, bg, bh in hist[:-1]:
                left_g, left_h = left_g + bg, left_h + bh
                won = gain(left_g, left_h) + gain(g - left_g, h - left_h) - gain(g, h)
                if won > 1e-6 and (node not in best or won > best[node][0] + 1e-12):
                    best[node] = (won, f, b, left_g, left_h)
        for node, (_, f, b, left_g, left_h) in best.items():
            splits[node] = (f, b)
            g, h = sums[node]
            sums[2 * node + 1], sums[2 * node + 2] = (left_g, left_h), (g - left_g, h - left_h)
        if not best:
            break

    def build(node: int, threshold: bool):
        if node not in splits:
            g, h = sums.get(node, (0, 0))
            return round(RATE * g / (h + L2 * _UNIT), 9)
        f, b = splits[node]
        return (f, cuts[f][b] if threshold else float(b), build(2 * node + 1, threshold), build(2 * node + 2, threshold))

    return build(0, True), build(0, False)


def fit(labelled: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    """A model from rows (url, blocked), of which about `sample` distinct URLs are used: those with the least hashes.

    blocked: boolean or 0/1; a null label or URL is left out, of a URL with several labels the commoner counts (blocked if
    equal). Without rows every URL is as likely as not; with one kind of label the answer is that label's.
    """
    rows = labelled.where("url is not null and blocked is not null").select("url", F.col("blocked").cast("int").alias("y"))
    total = rows.agg(F.approx_count_distinct("url", 0.02)).first()[0]
    if not total:
        return Model([], 0.0, None, 0.5)
    if total > sample:
        rows = rows.where(F.pmod(F.xxhash64("url"), F.lit(1 << 31)) < int(sample / total * (1 << 31)))
    rows = rows.groupBy("url").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    host, path = parts(F.col("url"))
    rows = lexical(rows.withColumns({"host": host, "path": path})).drop("path")
    rows = materialise(rows.withColumn("fold", F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(2))))
    n, bad = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    share = (bad + 1) / (n + 2)
    stacked = None
    for k in SUFFIXES:
        sums = [F.sum(F.when(F.col("fold") == f, x).otherwise(0)).alias(f"{name}{f}") for name, x in (("seen", F.lit(1)), ("bad", F.col("y"))) for f in (0, 1)]
        one = rows.groupBy(F.col(f"key{k}").alias("key")).agg(*sums).select(F.lit(k).alias("k"), "key", "seen0", "seen1", "bad0", "bad1")
        stacked = one if stacked is None else stacked.unionByName(one)
    suffixes = materialise(stacked)
    rows = _with_statistics(rows, suffixes, share, True)
    marks = [i / BINS for i in range(1, BINS)]
    found = rows.agg(*[F.percentile_approx(c, marks, 10000) for c in NAMES]).first()
    cuts = [sorted(set(x or [])) for x in found]
    binned = [F.expr(" + ".join([f"IF({c} > {v!r}D, 1, 0)" for v in cut] or ["0"])).alias(f"b{i}") for i, (c, cut) in enumerate(zip(NAMES, cuts, strict=True))]
    # rows alike in every bin are one cell; the sample bounds their number, so one task reads them at each level
    cells = rows.select("y", *binned).groupBy(*[f"b{i}" for i in range(len(NAMES))]).agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    cells = materialise(cells).coalesce(1)
    base = math.log(share / (1 - share))
    trees, margin = [], f"{base!r}D"
    for _ in range(rounds):
        tree, over_bins = _grow(cells, margin, cuts)
        trees.append(tree)
        margin += " + " + _tree_sql(over_bins, [f"b{i}" for i in range(len(NAMES))])
    return Model(trees, base, suffixes, share)


def score(rows: DataFrame, model: Model) -> DataFrame:
    """rows (url, host, path and others) with `score`, the probability of being blocked; null and empty URLs have one too."""
    kept = rows.columns
    wide = _with_statistics(lexical(rows), model.suffixes, model.share, False)
    margin = " + ".join([f"{model.base!r}D", *[_tree_sql(t, NAMES) for t in model.trees]])
    return wide.select(*kept, F.expr(f"round(1D / (1D + exp(-({margin}))), 9)").alias("score"))


def url_filter(pages: DataFrame, rules: Sequence[Rule], labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", sample: int = SAMPLE, inline: int = INLINE) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row of pages.

    verdict: the longest fitting rule's, else `block` where the trees give 0.5 or more. The trees learn from `labelled`
    (url, blocked), or else from those pages that a rule fits, with the rule's verdict as label. Null URLs, and those
    without `://`, have an empty host and path; no rule fits them, the trees judge them. Repeated rows come out alike.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    host, path = parts(F.col("url"))
    rows = apply_rules(rows.withColumns({"host": host, "path": path}), rules, inline)
    if labelled is None:
        labelled = rows.where("rule is not null").select("url", (F.col("rule_verdict") == "block").alias("blocked"))
    model = fit(labelled, sample)
    scored = score(rows, model)
    verdict = F.coalesce(F.col("rule_verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
