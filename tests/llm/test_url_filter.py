import random

import pytest

from tesselode.llm import url_filter as U
from tesselode.llm.queries import URL_RULES, op13_url_filter

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "page_id long, url string, host string, RULE string, b0 int"


def plain(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut].translate(AZ), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    hits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(hits, key=lambda r: len(r.text), default=None)
    return host, path, best.text if best else None, best.verdict if best else None


def urls():
    r = random.Random(4)
    hosts = ["EXAMPLE.org", "www.example.org", "notexample.org", "a.b.example.com", "com", "org", "x.net", "é.de", "h:80", "", "borg"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/15/x", "/fr/7", "/de/", "/de/9.html", "?q=/fr/", "#/de/", "/fr/a?b=1&c=2#d", "/a\nb/"]
    out = [f"{r.choice(['http', 'https', ''])}://{r.choice(hosts)}{r.choice(paths)}" for _ in range(400)]
    return out + [None, "", "no scheme", "http:/x", "a://b://c/d", "://org/"]


@pytest.mark.parametrize("inline", [64, 0])
def test_rules_against_plain(spark, inline):
    data = [(i, u, "h", "r", i) for i, u in enumerate(urls())] + [(3, "http://org/", None, None, None)] * 2 + [(None, "http://x.com/de/", "h", "r", 0)]
    got = U.url_filter(spark.createDataFrame(data, SCHEMA), URL_RULES, inline=inline).collect()
    assert len(got) == len(data)
    want = {(i, *plain(u, URL_RULES)) for i, u, *_ in data}
    for g in got:
        if g.rule is None:
            assert (g.page_id, g.host, g.path, None, None) in want and g.verdict == ("block" if g.score >= 0.5 else "allow")
        else:
            assert (g.page_id, g.host, g.path, g.rule, g.verdict) in want


def labelled(spark, seed, n):
    r = random.Random(seed)

    def one():
        bad = r.random() < 0.4
        host = f"{r.choice(['www', 'm', 'blog'])}.{r.choice(['win', 'bet', 'free'])}-{r.randrange(99)}.{r.choice(['xyz', 'top', 'com'])}" if bad else f"{r.choice(['www', 'news'])}.{r.choice(['paper', 'school', 'city'])}.{r.choice(['org', 'edu', 'com'])}"
        path = "/".join(str(r.randrange(10**6)) if bad else r.choice(["about", "history", "page"]) for _ in range(r.randrange(1, 4)))
        return f"http://{host}/{path}" + (f"?id={r.randrange(10**5)}&x=1&y=2" if bad and r.random() < 0.5 else ""), int(bad if r.random() > 0.02 else not bad)

    return spark.createDataFrame([one() for _ in range(n)], "url string, blocked int")


def test_trees_on_urls_held_out(spark):
    train, rest = labelled(spark, 1, 3000), labelled(spark, 2, 1000)
    model = U.fit(train)
    host, path = U.parts(rest.url)
    got = U.score(rest.withColumns({"host": host, "path": path}), model).collect()
    assert sum((g.score >= 0.5) == bool(g.blocked) for g in got) > 0.93 * len(got)
    # the same trees however the rows are dealt, and from a sample
    assert U.fit(train.repartition(7)).trees == model.trees
    assert U.fit(train, sample=500).trees


def test_labels_of_one_kind_none_and_native(spark, sf):
    data = spark.createDataFrame([(1, "http://a.b/c", "h", "r", 0), (2, None, "h", "r", 0)], SCHEMA)
    for labels, want in (([], 0.5), ([("http://a.b/c", 1)] * 3 + [("u", None), (None, 1)], None)):
        got = {g.page_id: g for g in U.url_filter(data, [], spark.createDataFrame(labels, "url string, blocked int")).collect()}
        assert len(got) == 2 and got[1].verdict == "block"
        assert want is None or got[1].score == want
    assert U.url_filter(data.limit(0), URL_RULES).collect() == []
    with pytest.raises(ValueError):
        U.url_filter(data, URL_RULES + URL_RULES[:1])
    text = op13_url_filter(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text
