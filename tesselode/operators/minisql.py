"""The guarded single-table query language: SELECT * FROM Kind WHERE a = 'x' AND b LIKE :p LIMIT n."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_LIMIT = 1000
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^']|'')*')|(?P<param>:[A-Za-z_]\w*)|(?P<word>[A-Za-z_]\w*)|(?P<num>\d+)|(?P<op>=|\*|,|&&))")


class QueryError(ValueError):
    """A query outside the grammar."""


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError(f"cannot read {text[at : at + 20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


def run(nodes: DataFrame, text: str, params: Mapping[str, str] | None = None) -> DataFrame:
    """Rows of nodes(kind, id, ...) by id. Values compare as strings, a missing one as ''; OR and NOT are refused."""
    params, toks = params or {}, _tokens(text)
    words = [v.upper() if k == "word" else v for k, v in toks]
    if not words or words[0] not in ("SELECT", "MATCH"):
        raise QueryError("a query starts with SELECT or MATCH")
    pos, df, limit = 1, nodes, DEFAULT_LIMIT
    while pos < len(words) and words[pos] not in ("FROM", "WHERE", "LIMIT"):
        pos += 1
    if pos < len(words) and words[pos] == "FROM":
        if pos + 1 >= len(toks) or toks[pos + 1][0] != "word":
            raise QueryError("FROM needs a kind")
        df, pos = df.where(F.col("kind") == toks[pos + 1][1]), pos + 2
    if pos < len(words) and words[pos] == "WHERE":
        pos += 1
        while True:
            if pos + 2 >= len(toks) or toks[pos][0] != "word" or words[pos + 1] not in ("=", "LIKE"):
                raise QueryError("a condition is: name = value, or name LIKE value")
            kind, raw = toks[pos + 2]
            if kind == "param":
                if raw[1:] not in params:
                    raise QueryError(f"no value for {raw}")
                value = str(params[raw[1:]])
            elif kind == "str":
                value = raw[1:-1].replace("''", "'")
            else:
                raise QueryError("a value is a literal in quotes or a parameter")
            if toks[pos][1] not in nodes.columns:
                raise QueryError(f"no property {toks[pos][1]}")
            own = F.coalesce(F.col(toks[pos][1]).cast("string"), F.lit(""))
            df, pos = df.where(own == value if words[pos + 1] == "=" else own.like(value)), pos + 3
            if pos < len(words) and words[pos] in ("AND", "&&"):
                pos += 1
                continue
            break
    if pos < len(words) and words[pos] == "LIMIT":
        if pos + 1 >= len(toks) or toks[pos + 1][0] != "num":
            raise QueryError("LIMIT needs a number")
        limit, pos = int(toks[pos + 1][1]), pos + 2
    if pos != len(words):
        raise QueryError(f"cannot go on at {toks[pos][1]!r}")
    return df.orderBy("id").limit(limit)
