"""The security rules over files built from the documents, each with a line that a rule looks for."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselode.functions.security_rules import RULES, WEAKNESSES
from tesselode.operators import security as S
from tesselode.sources.tables import table

from .catalog import query

#: A line for each rule, in the order of the rules.
PLANTED = [
    "subprocess.run(cmd, shell=True)", 'system("ls");', 'popen("ls", "r");', 'exec.Command("/bin/sh", x)', 'exec.Command("sh", "-c", x)', "require('child_process').exec('ls')",
    'cursor.execute("SELECT a WHERE b = %s" % x)', 'db.Query(fmt.Sprintf("SELECT %s", x))', 'sprintf(buf, "SELECT %s", x);', 'Statement.execute("SELECT " + x)', 'query("SELECT " + x + " FROM t")', 'mysql_query("SELECT $_GET[a]")',
    "mark_safe(x)", 'render_to_string("t.html", request)', "dangerouslySetInnerHTML={x}", "el.innerHTML = x", '<% a <%= request.getParameter("x")', "strcpy(a, b);", "strcat(a, b);", 'sprintf(a, "%d", b);', "gets(a);", 'scanf("%s", a);',
    "arr[i] = 1;", "memcpy(a, b, n);", "free(p);", "open(request.args)", 'fopen(getenv("X"), "r");', "os.Open(request.Path)", "require(req.params.x)", 'include($_GET["x"]);', "pickle.loads(x)", "yaml.load(x)", "yaml.load_all(x)",
    "new ObjectInputStream(x)", "deserialize(x)", "malloc(n * 4);", "a.unchecked_add(b)", "eval(x)", "exec(x)", "eval(x)", "eval($x);", "(a+b)*", 'RegExp("(a+)+b")', "int main(int argc, char **argv)", '@app.route("/x")\ndef f():\n    return request.get(1)',
    "fetch(url)", '@app.route("/x", methods=["POST", "GET"])', 'http.HandleFunc("/x", func(w, r) {', 'password = "hunter22"', 'api_key = "abcdefgh1"', 'SECRET_KEY = "x"', '"password": "abcd"', 'user = "admin"', 'requests.get(request.args["u"])', "http.Get(request.URL)",
    "fetch(base + req.q)", "new URL(request.x)", "md5(x)", "sha1(x)", "cipher = rc4", 'MessageDigest.getInstance("md5")', "md5.Sum(x)", 'crypto.createCipher("aes")', "rand();", "User.objects.get(id=request.user)", "findById(req.params.id)", "JSON.parse(req.body)",
    "(*p)", "unsafe {", "x = rand() % 10", "verify_ssl = false", "XMLParser(LOAD_DTD, entity)", "redirect = req.params.to",
]
assert len(PLANTED) == len(RULES)


def _quoted(text: str) -> str:
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in text.split("\n"))


#: Every 80th file has one rule's line, in upper case in every other round; seven kinds have none. The others are of the rule's language or of the next one.
_RULE = "doc_id % 80"
_LANGUAGE = f"CASE {_RULE} " + " ".join(f"WHEN {i} THEN '{r[1] if r[1] != 'all' else 'python'}'" for i, r in enumerate(RULES)) + " ELSE 'go' END"
_LINE = f"CASE {_RULE} " + " ".join(f"WHEN {i} THEN {_quoted(p)}" for i, p in enumerate(PLANTED)) + " ELSE '' END"
FILES = f"SELECT 'src/' || CAST(doc_id AS VARCHAR(20)) AS path, CASE WHEN doc_id % 11 = 0 THEN 'rust' ELSE {_LANGUAGE} END AS language, text || chr(10) || CASE WHEN doc_id % 160 < 80 THEN {_LINE} ELSE upper({_LINE}) END || chr(10) || 'end' || chr(10) || text AS content FROM "


def files(spark, d):
    text = FILES.replace("{", "{{").replace("}", "}}")
    return spark.sql(text + "{documents}", documents=table(spark, d, "documents"))


_RULES_SQL = "rules(rule, cwe, lang, name, pattern, confidence) AS (VALUES " + ", ".join(f"({i}, '{r[0]}', '{r[1]}', '{r[2]}', '{r[3].replace(chr(39), chr(39) * 2)}', CAST({r[4]} AS DOUBLE))" for i, r in enumerate(RULES)) + ")"
_WEAK_SQL = "weak(cwe, title, description, severity, rules) AS (VALUES " + ", ".join(f"('{w[0]}', '{w[1]}', '{w[2]}', '{w[3]}', {sum(r[0] == w[0] for r in RULES)})" for w in WEAKNESSES) + ")"
SQL = f"WITH f AS MATERIALIZED ({FILES} documents), {_RULES_SQL}, {_WEAK_SQL}, hit AS MATERIALIZED (SELECT path, language, rule, cwe, name, confidence, regexp_extract(content, '^((?s:.*?))(?:' || pattern || ')', 1) AS head, content FROM f JOIN rules ON lang = 'all' OR lang = language WHERE regexp_matches(content, pattern)), found AS MATERIALIZED (SELECT path, language, CAST(rule AS INTEGER) AS rule, cwe, name, confidence, CAST(length(head) - length(replace(head, chr(10), '')) + 1 AS INTEGER) AS line, substr(array_to_string(list_slice(string_split(content, chr(10)), length(head) - length(replace(head, chr(10), '')) + 1, length(head) - length(replace(head, chr(10), '')) + 3), chr(10)), 1, 200) AS snippet FROM hit), graded AS MATERIALIZED (SELECT found.*, severity FROM found LEFT JOIN weak ON weak.cwe = found.cwe)"


@query("audit_findings", f"{SQL} SELECT * FROM found")
def audit_findings(spark, d):
    return S.findings(files(spark, d))


@query("findings_high", f"{SQL} SELECT path, cwe, name, line, confidence, severity FROM graded WHERE severity = 'HIGH' AND confidence >= 0.8")
def findings_high(spark, d):
    return S.select_findings(S.findings(files(spark, d)), severity="HIGH", least=0.8).select("path", "cwe", "name", "line", "confidence", "severity")


@query("findings_top", f"{SQL} SELECT path, cwe, rule, line, confidence, severity FROM graded ORDER BY confidence DESC, path, line, rule LIMIT {S.TOP}")
def findings_top(spark, d):
    return S.select_findings(S.findings(files(spark, d)), limit=S.TOP).select("path", "cwe", "rule", "line", "confidence", "severity")


@query("findings_metrics", f"{SQL} SELECT 'total' AS what, '' AS key, count(*) AS n FROM graded UNION ALL SELECT 'cwe', cwe, count(*) FROM graded GROUP BY cwe UNION ALL SELECT 'severity', s, (SELECT count(*) FROM graded WHERE severity = s) FROM (VALUES ('HIGH'), ('MEDIUM'), ('LOW')) t(s) UNION ALL SELECT 'language', language, count(*) FROM graded GROUP BY language")
def findings_metrics(spark, d):
    return S.metrics(S.findings(files(spark, d)))


@query("cwe_details", f"{SQL} SELECT w.*, count(g.cwe) AS findings FROM weak w LEFT JOIN graded g ON g.cwe = w.cwe GROUP BY ALL")
def cwe_details(spark, d):
    n = S.findings(files(spark, d)).groupBy("cwe").agg(F.count("*").alias("findings"))
    return S.weaknesses(spark).join(n, "cwe", "left").fillna(0, ["findings"])
