"""Text rules as column expressions: secrets, log lines, templates, complexity, task classes.

Patterns keep to what RE2 and Java both read: no lookaround, explicit classes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Secret kinds and patterns, in the order they apply.
SECRET_PATTERNS = [
    ("api_key", r"""(?i)(api[_-]?key\s*[:=]\s*["']?)([A-Za-z0-9_\-]{16,})"""),
    ("password", r"""(?i)(password\s*[:=]\s*["']?)([^"'\s]{8,})"""),
    ("token", r"""(?i)(token\s*[:=]\s*["']?)([A-Za-z0-9_\-\.]{16,})"""),
    ("private_key", r"""(?i)(-----BEGIN (RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----)"""),
    ("aws_secret", r"""(?i)(aws_secret_access_key\s*[:=]\s*["']?)([A-Za-z0-9/+=]{40})"""),
    ("connection_string", r"""(?i)((?:postgres|mysql|mongodb|redis)://[^\s"']+)"""),
    ("jwt", r"""(?i)(eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,})"""),
    ("github_token", r"""(?i)(gh[pousr]_[A-Za-z0-9]{20,})"""),
]
#: Kinds whose match starts with the name of a key, which stays; of the others nothing does.
KEYED = ["api_key", "password", "token", "aws_secret"]
MARK = "***REDACTED***"
#: The same with the blanks that RE2 knows spelt out, as Java's include the vertical tab.
SECRETS = [(kind, p.replace(r"\s*", r"[\t\n\f\r ]*").replace(r"\s", r"\t\n\f\r ")) for kind, p in SECRET_PATTERNS]
# A word in a line, the severity it gives, in order of precedence.
SEVERITIES = [("FATAL", "fatal"), ("ERROR", "error"), ("WARN", "warning"), ("INFO", "info"), ("DEBUG", "debug")]
# What adds to the complexity of code, each time it occurs.
BRANCHES = ["if", "for", "while", "case", "catch"]
BOOLEANS = r"&&|\|\|"


def redact(text: Column) -> Column:
    """text without its secrets: of a keyed one the key stays, then a mark. Null: null."""
    for kind, pattern in SECRETS:
        text = F.regexp_replace(text, pattern, ("$1" if kind in KEYED else "") + MARK)
    return text


def secret_kinds(text: Column) -> Column:
    """Kinds found, joined by commas; '' for none."""
    return F.concat_ws(",", *[F.when(text.rlike(p), F.lit(k)) for k, p in SECRETS])


def secret_hits(text: Column) -> Column:
    """An array of (rule, line) of the first match of each kind; one look at the text for all."""

    def hit(kind: str, pattern: str) -> Column:
        before = F.split_part(text, F.regexp_extract(text, pattern, 0), F.lit(1))
        line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
        return F.when(text.rlike(pattern), F.struct(F.lit(kind).alias("rule"), line.cast("long").alias("line")))

    return F.filter(F.array(*[hit(k, p) for k, p in SECRETS]), lambda x: x.isNotNull())


def severity(line: Column) -> Column:
    out = F.lit("unknown")
    for word, name in reversed(SEVERITIES):
        out = F.when(line.contains(word), F.lit(name)).otherwise(out)
    return out


def template(line: Column) -> Column:
    """A log line with its numbers as %."""
    return F.regexp_replace(line, "[0-9]+", "%")


def complexity(text: Column) -> Column:
    """1 plus how often branching words, whole and in lower case, and boolean operators occur."""
    out = 1 + F.regexp_count(text, F.lit(BOOLEANS))
    for w in BRANCHES:
        out = out + F.regexp_count(text, F.lit(rf"(?<![0-9A-Za-z_]){w}(?![0-9A-Za-z_])"))
    return out


def risk_level(changed: Column, untested: Column, fan_in: Column, wide: Column, stale: Column) -> Column:
    """Risk of a change from counts: functions changed, of them untested, with many callers, of wide impact, and stale notes."""
    score = F.when(changed > 25, 2).when(changed > 0, 1).otherwise(0) + 2 * F.least(fan_in, F.lit(2)) + 2 * F.least(wide, F.lit(2)) + F.least(untested, F.lit(3)) + F.when(stale > 0, 1).otherwise(0)
    return F.when(score >= 6, "high").when(score >= 2, "medium").otherwise("low")
