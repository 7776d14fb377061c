"""Memories folded and linked against plain loops."""

import random

from tesselode.operators import memory as M

ROW = "project string, id string, title string, content string, kind string, agent string, created string, archived boolean, entity_ids array<string>, entities array<string>, member_ids array<string>, n int"


def plain(rows, least):
    olds, groups, names = {}, {}, {}
    for p, i, title, content, kind, agent, created, archived, ids, ents, members, _ in sorted(rows, key=lambda r: r[1]):
        if kind == M.FOLDED:
            for e in ids or []:
                olds[p, e] = (title, content or "", len(members or []))
        elif ids and not archived:
            name, key = min(((ents or [])[k] if k < len(ents or []) else "", e) for k, e in enumerate(ids))
            groups.setdefault((p, key), []).append((created or "", i, title or "", agent or "", content or ""))
            names[p, key] = min(names.get((p, key), name), name)
    out = {}
    for g, members in groups.items():
        if len(members) < max(2, least) and g not in olds:
            continue
        seen, parts = set(), []
        if g in olds:
            parts.append((None, olds[g][1]))
            seen = {" ".join(x.lower().split()) for x in olds[g][1].split("\n")}
        for created, i, title, agent, content in sorted(members):
            lines = []
            for line in content.split("\n"):
                norm = " ".join(line.lower().split())
                if norm and norm not in seen:
                    seen.add(norm)
                    lines.append(line.rstrip(" \t"))
            parts.append((i, f"## {title} ({agent}, {created})\n" + "\n".join(lines or [M.COVERED])))
        name = names[g] or (olds[g][0] or "").removeprefix(M.TITLE) if g in olds else names[g]
        out[g] = (parts, f"{M.TITLE}{name} [{g[1][:8]}]", (olds[g][2] if g in olds else 0) + len(members), sum(len(m[2].encode()) + len(m[4].encode()) for m in members))
    return out


def test_folding_equals_a_plain_loop(spark):
    r = random.Random(6)
    lines = ["a b", "A  b ", "c", "", "  ", "d\t", "É x", "## old"]
    rows = []
    for i in range(150):
        ids = r.choice([None, [], [f"entity-number-{r.randrange(12)}" for _ in range(r.randrange(1, 4))]])
        text = r.choice([None, "\n".join(r.choice(lines) + str(r.choice(["", "", i])) for _ in range(r.randrange(6)))])
        kind = r.choice(["note"] * 9 + [M.FOLDED, None])
        rows.append((r.choice("ppq"), f"m{i:03}", r.choice([f"t{i}", None]), text, kind, r.choice([None, "bot"]), r.choice([None, "1", "2"]), r.choice([None, False, False, True]), ids, None if ids is None else [f"n{x[-1]}" for x in ids][: r.randrange(4)], ["z"] if kind == M.FOLDED else None, 1))
    rows.append((None, "x", "t", "a", "note", "b", "1", False, ["entity-number-1"], ["n"], None, 1))
    df = spark.createDataFrame(rows, ROW)
    for least in (0, 4):
        got, want = M.compacted(df, least), plain([x for x in rows if x[0]], least)
        parts = {}
        for x in sorted(got.parts.collect(), key=lambda x: (x.id is not None, x.created or "", x.id or "")):
            parts.setdefault((x.project, x.key), []).append((x.id, x.text))
        assert parts == {g: w[0] for g, w in want.items()} and len(parts) > 3
        assert {(x.project, x.key): (x.title, x.compacted_count) for x in got.summaries.collect()} == {g: w[1:3] for g, w in want.items()}
        assert {(x.project, x.key, x.id) for x in got.folded.collect()} == {(*g, i) for g, w in want.items() for i, _ in w[0] if i}
        for x in got.report.collect():
            own = [w for g, w in want.items() if g[0] == x.project]
            assert (x.summaries_updated, x.chars_before, x.chars_after) == (len(own), sum(w[3] for w in own), sum(len("\n\n".join(t for _, t in w[0]).encode()) for w in own))
    assert M.compacted(df.limit(0)).report.count() == 0


def test_links_and_versions(spark):
    log = [("p", "T", "old callme", "k", "a", "1", 1), ("p", "T", "uses callme, Box and callme2; abc", "k", None, "2", 2), ("q", "T", None, None, None, None, 1), (None, "x", "callme", "k", "a", "1", 1), ("p", None, "callme", "k", "a", "1", 1), ("p", "callme", "Wide", "k", "a", "1", 1)]
    entities = [("p", f"c{i}", "Class", "callme") for i in range(7)] + [("p", "f", "Function", "callme"), ("p", "b", "Class", "Box"), ("p", "a", "Class", "abc"), ("p", "w", "Struct", "Wide"), ("p", "v", "Module", "Wide"), ("q", "q", "Class", "callme"), (None, "n", "Class", None)]
    e = spark.createDataFrame(entities, "project string, id string, kind string, name string")
    df = M.stored(spark.createDataFrame(log, "project string, title string, content string, kind string, agent string, created string, seq int"), e)
    got = {(x.project, x.title): (x.content, x.kind, x.agent, x.entity_ids, x.entities) for x in df.collect()}
    assert got == {
        ("p", "T"): ("uses callme, Box and callme2; abc", "k", "unknown", ["f", "c0", "c1", "c2", "c3"], ["callme"] * 5),
        ("q", "T"): ("", "note", "unknown", [], []),
        ("p", "callme"): ("Wide", "k", "a", ["f", "c0", "c1", "c2", "c3", "w"], ["callme"] * 5 + ["Wide"]),
    }
    assert [x.id for x in M.find(df, "wide boxes", 5).collect()] and M.find(df.limit(0), "wide", 5).count() == 0
