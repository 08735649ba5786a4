"""Queries of what stands around the detectors: files, reports, globs, placeholders, contexts, searches, models.

Inputs are SQL expressions over the given tables that Spark and DuckDB both read; what is expected is stated by
construction. Imported by the catalogue.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import detectors as D
from ..functions import globs
from ..functions import spans as S
from ..functions.classify import Model, detector
from ..functions.tokens import Template
from ..operators import detection, documents, redaction, scan, search
from ..rules import engine
from ..sources import files, reports
from . import generated as G
from . import oracles as O
from .catalogue import PII, _chars, _read, query

_STRING = "CAST({} AS STRING)".format


def _rows(spark, sf_dir, table, **columns):
    return _read(spark, sf_dir, table).select(*[F.expr(x).alias(k) for k, x in columns.items()])


def _customers(spark, sf_dir, **columns):
    """Documents made of customers' keys, for work that costs far more than to read these."""
    return files.dealt(_read(spark, sf_dir, "customer").select("c_custkey")).select(*[F.expr(x).alias(k) for k, x in columns.items()])


def _sql(table, **columns):
    return "SELECT " + ", ".join(f"{x} AS {k}" for k, x in columns.items()) + f" FROM {table}"


def _values(rows, *names):
    text = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + f") AS t({', '.join(names)})"


def _listed(spark, sf_dir, rows, *names):
    """A fixed list beside each nation, so that it is a table of its own size."""
    items = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows])
    return _read(spark, sf_dir, "nation").select("n_nationkey", F.explode(items).alias("x")).select("n_nationkey", "x.*")


# -- files ---------------------------------------------------------------------------------------------------------
_PATH = f"'r' || {_STRING('c_custkey % 3')} || '/s' || {_STRING('c_custkey % 5')} || '/t' || {_STRING('c_custkey % 2')} || '/' || {_STRING('c_custkey')} || '.txt'"
_CONFIGS = [("", "top"), ("r0", "zero"), ("r0/s1", "one"), ("r1/s2/t1", "deep")]


@query(f"""SELECT path, CASE WHEN path LIKE 'r0/s1/%' THEN 'one' WHEN path LIKE 'r0/%' THEN 'zero' WHEN path LIKE 'r1/s2/t1/%' THEN 'deep' ELSE 'top' END AS config FROM ({_sql('customer', path=_PATH)})""")
def nearest_config(spark, sf_dir):
    return files.nearest(_rows(spark, sf_dir, "customer", path=_PATH), spark.createDataFrame(_CONFIGS, "folder string, config string"))


_NAME = f"'d' || {_STRING('c_custkey % 9')} || '/' || CASE c_custkey % 4 WHEN 0 THEN '.env' WHEN 1 THEN 'k' || {_STRING('c_custkey')} || '.pem' WHEN 2 THEN 'id_rsa' ELSE 'notes.txt' END"


@query(f"""WITH f AS ({_sql('customer', relative=_NAME)}), m AS (SELECT '.env' AS pattern, relative FROM f WHERE relative LIKE '%/.env' UNION ALL SELECT '*.env', relative FROM f WHERE relative LIKE '%/.env' UNION ALL SELECT '*.pem', relative FROM f WHERE relative LIKE '%.pem' UNION ALL SELECT 'id_rsa', relative FROM f WHERE relative LIKE '%/id_rsa')
SELECT pattern, count(*) AS n, list_slice(list_sort(list(relative)), 1, 3) AS examples FROM m GROUP BY pattern""")
def candidate_files(spark, sf_dir):
    return scan.candidates(_rows(spark, sf_dir, "customer", relative=_NAME))


_FILE = {"relative": _NAME, "size": "c_custkey * 10", "content": f"CASE WHEN c_custkey % 6 = 0 THEN 'a' || chr(0) || 'b' ELSE 'text' END", "error": "CASE WHEN c_custkey % 11 = 0 THEN 'gone' END"}


@query(f"""SELECT count(*) FILTER (WHERE fate = 'scan') AS scanned, count(*) FILTER (WHERE fate = 'skip') AS skipped, count(*) FILTER (WHERE fate = 'protected') AS protected_unread, count(*) FILTER (WHERE fate = 'error') AS errors FROM (
 SELECT CASE WHEN relative LIKE '%.pem' AND relative NOT LIKE 'd1/%' THEN 'protected' WHEN size > 1000 THEN 'skip' WHEN error IS NOT NULL THEN 'error' WHEN k % 6 = 0 THEN 'skip' ELSE 'scan' END AS fate FROM ({_sql('customer', k='c_custkey', **{x: _FILE[x] for x in ('relative', 'size', 'error')})}))""")
def scan_fates(spark, sf_dir):
    """Files by what a scan does with them: protected ones but for an excluded folder, large, unreadable and binary ones."""
    rows = _rows(spark, sf_dir, "customer", **(_FILE | {"content": f"CAST({_FILE['content'].replace('chr(0)', 'char(0)')} AS BINARY)"}))
    return scan.totals(scan.splits(rows, globs.FileGlobs(("*.pem",), ("d1/",)), True, 1000))


@query(f"SELECT relative FROM ({_sql('customer', relative=_PATH)}) ORDER BY string_split(relative, '/') LIMIT 40")
def first_files(spark, sf_dir):
    """A walk's limit on files takes the first in its order."""
    return files.limited(_rows(spark, sf_dir, "customer", relative=_PATH), files.WalkOptions(max_files=40))


# -- globs, placeholders, keys -------------------------------------------------------------------------------------
_GLOBS = [
    ("a.*", ".", "a.b", True), ("a.*", ".", "a.b.c", False), ("a.**", ".", "a", True), ("a.**", ".", "a.b.c", True), ("**.k", ".", "k", True), ("**.k", ".", "x.y.k", True), ("a?c", ".", "a.c", False), ("**", ".", "", True),
    ("a/*.py", "/", "a/x.py", True), ("a/*.py", "/", "a/b/x.py", False), ("a/**/b", "/", "a/b", True), ("git-*", "", "git-a.b/c", True), ("git-?", "", "git-ab", False), ("x.y", "", "xzy", False),
]


@query(f"SELECT n_nationkey, pattern, path, want AS hit FROM nation, {_values([(g, p, w) for g, _, p, w in _GLOBS], 'pattern', 'path', 'want')}")
def glob_matches(spark, sf_dir):
    rows = _listed(spark, sf_dir, [(g, globs.glob(g, sep or None), p) for g, sep, p, _ in _GLOBS], "pattern", "expression", "path")
    return rows.select("n_nationkey", "pattern", "path", F.rlike("path", F.col("expression")).alias("hit"))


_PLACES = [("", True), ("  ", True), ("<password>", True), ("${DB_PASS}", True), ("changeme", True), ("XXXX", True), ("****", True), ("[REDACTED-1]", True), ("'secret'", True), ("Your_Password", True), ("<a>", False), ("xx", False), ("hunter2", False), ("passwords", False), ("x*x", False), ("<pass word>", False)]


@query(f"SELECT n_nationkey, v, want AS placeholder, v <> '' AND NOT want AS is_real FROM nation, {_values(_PLACES, 'v', 'want')}")
def placeholder_values(spark, sf_dir):
    v = F.col("v")
    return _listed(spark, sf_dir, [(x,) for x, _ in _PLACES], "v").select("n_nationkey", "v", D.is_placeholder(v).alias("placeholder"), D.has_real_value(v).alias("is_real"))


_PW = f"('q' || {_STRING('c_custkey')} || 'z')"
_CONTEXT = '{"env": {"DB_PASSWORD": "{p}", "REDIS_PASSWORD": "changeme"}, "db": {"host": "h", "user": "u", "password": "{p}9", "in": {"password": "{p}8"}}, "app": {"user": "u", "password": "{p}7"}, "mysql.root.password": "{p}6"}'


@query(f"SELECT {_STRING('c_custkey')} AS doc_id, replace(replace(replace(replace(text, '\"' || p || '\"', '\"[REDACTED-1]\"'), p || '9', '[REDACTED-2]'), p || '8', '[REDACTED-3]'), p || '6', '[REDACTED-4]') AS content FROM (SELECT c_custkey, {_PW} AS p, {G.sql_text(_CONTEXT, p=_PW)} AS text FROM customer)")
def credential_fields(spark, sf_dir):
    """Password fields by their key, or by host and user beside or above them."""
    docs = _customers(spark, sf_dir, doc_id=_STRING("c_custkey"), path="'a.json'", content=f"CAST({G.sql_text(_CONTEXT, p=_PW)} AS BINARY)")
    return documents.redact_all(docs, ["credential_key"]).select("doc_id", F.decode("content", "UTF-8").alias("content"))


# -- tokens, labels, reports ---------------------------------------------------------------------------------------
@query(O.spans(r"\[REDACTED-[1-9][0-9]*\]", "token", O.redacted([O.spans(O.EMAIL, "pii:email", **_chars)]).replace("AS redacted", "AS text")))
def find_tokens(spark, sf_dir):
    """Tokens of redacted texts; redacting these again changes nothing."""
    done = redaction.redact(_read(spark, sf_dir).select("doc_id", "text"), ["pii:email"]).select("doc_id", F.col("redacted").alias("text"))
    again = redaction.redact(done, ["pii:email"]).select("doc_id", F.col("redacted").alias("text"))
    found = S.find(F.coalesce("text", F.lit("")), Template.parse().pattern, "token")
    return again.select("doc_id", F.explode(S.with_secrets(F.col("text"), found)).alias("s")).select("doc_id", "s.start", "s.end", "s.label", "s.secret")


@query(f"""SELECT doc_id, 'mine:token' AS label, count(*) AS n FROM (SELECT o_orderkey AS doc_id FROM orders WHERE o_orderkey % 5 <> 0) GROUP BY doc_id""")
def relabelled(spark, sf_dir):
    """Findings of a rule under another label, each secret once."""
    own = engine.ruleset([G.RULES["match"]]).labelled("mine")
    return redaction.occurrences(G.rule_texts(spark, sf_dir, "match"), [own]).groupBy("doc_id", "label").agg(F.count_distinct("secret").alias("n"))


@query(f"""SELECT doc_id, 1 AS id, '[REDACTED-1]' AS token, detector, CAST(first_at AS STRING) AS "start", '32' AS len, CAST(occurrences AS STRING) AS count, '"' || secret || '"' AS value, '' AS allowed FROM (SELECT f.*, md5(split_part(doc_id, '-', 1)) AS secret FROM ({G.expected_findings()}) f)""")
def finding_table(spark, sf_dir):
    """The table of findings, values shown."""
    return reports.finding_cells(documents.redact_all(G.formatted(spark, sf_dir)), show_value=True).drop("location")


_MANY = "CASE c_custkey % 3 WHEN 0 THEN repeat('ab', 40) WHEN 1 THEN 'a\"b' ELSE 'plain' END"


@query(f"""SELECT doc_id, (CASE k WHEN 0 THEN '"' || repeat('ab', 30) || '"…' WHEN 1 THEN '"a\\"b"' ELSE '"plain"' END) || ', "two"' || CASE WHEN d > 0 THEN ', "x"' ELSE '' END || CASE WHEN d > 1 THEN ', +' || CAST(d - 1 AS STRING) || ' more' ELSE '' END AS cell FROM (SELECT c_custkey AS doc_id, c_custkey % 3 AS k, c_custkey % 4 AS d FROM customer)""")
def value_cells(spark, sf_dir):
    """Values of a table's cell: three at most, long ones cut, the rest counted."""
    rows = _rows(spark, sf_dir, "customer", doc_id="c_custkey", many=f"concat(array({_MANY}, 'two'), array_repeat('x', CAST(c_custkey % 4 AS INT)))")
    return rows.select("doc_id", scan.value_cell(F.transform("many", lambda v: F.struct(v.alias("value")))).alias("cell"))


_STAGED = f"'first' || chr(10) || 'set DB_PASSWORD=' || {_PW} || chr(10) || 'x' || chr(10) || 'again ' || {_PW}"


@query("SELECT CAST(c_custkey AS STRING) AS doc_id, 'credential_assignment' AS detector, 2 AS line FROM customer WHERE c_custkey % 4 + 1 <= 2 AND c_custkey % 4 + 2 >= 2")
def staged_lines(spark, sf_dir):
    """Findings on added lines."""
    from ..cli import staged_findings

    docs = _customers(spark, sf_dir, doc_id=_STRING("c_custkey"), path="'a.txt'", content=f"CAST({_STAGED} AS BINARY)")
    added = _rows(spark, sf_dir, "customer", doc_id=_STRING("c_custkey"), first="CAST(c_custkey % 4 + 1 AS INT)", last="CAST(c_custkey % 4 + 2 AS INT)")
    found = documents.redact_all(docs, ["credential_assignment"]).select("doc_id", F.explode("findings").alias("f"))
    return staged_findings(found, docs.select("doc_id", "content"), added)


# -- searches ------------------------------------------------------------------------------------------------------
_LINES = f"SELECT doc_id, unnest(range(len(l))) + 1 AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(CASE WHEN ends_with(t, chr(10)) THEN t[1:-2] ELSE t END, chr(10)) AS l FROM (SELECT doc_id, redacted AS t FROM ({O.redacted([O.spans(O.EMAIL, 'pii:email', **_chars), O.spans(O.PHONE, 'pii:phone', **_chars)])})))"


@query(f"SELECT doc_id, line_no, i AS nr, m[i + 1] AS match FROM (SELECT doc_id, line_no, m, unnest(range(len(m))) AS i FROM (SELECT doc_id, line_no, regexp_extract_all(line, 'licen[a-z]+|under the') AS m FROM ({_LINES})))")
def grep_only_matching(spark, sf_dir):
    return search.only_matching(_read(spark, sf_dir).select("doc_id", "text"), "licen[a-z]+|under the", PII)


@query(f"SELECT DISTINCT doc_id FROM ({_LINES}) WHERE regexp_matches(line, '(?i)(^|[^A-Za-z0-9_])(under the|key)([^A-Za-z0-9_]|$)')")
def grep_files_with(spark, sf_dir):
    """Files with a line that holds one of two whole words, in whatever case; a word may be whole by redaction alone."""
    pattern = search.matcher(["under the", "key"], fixed=True, ignore_case=True, word=True)
    return search.with_match(_read(spark, sf_dir).select("doc_id", "text"), pattern, PII, probe=False)


@query(f"""SELECT doc_id, line_no, '{{"type":"match","path":"' || CAST(doc_id AS STRING) || '","line_number":' || CAST(line_no AS STRING) || ',"text":' || to_json(line) || '}}' AS json FROM ({_LINES}) WHERE contains(line, 'licensed')""")
def grep_json_lines(spark, sf_dir):
    return search.json_lines(search.grep(_read(spark, sf_dir).select("doc_id", "text"), "licensed", PII))


# -- documents as a whole, token classification --------------------------------------------------------------------
_PAIR = '{"a": "{x}", "b": "{y}", "c": ["{x}", "lone"]}'
_X, _Y = f"'v' || {_STRING('c_custkey % 10')}", f"'v' || {_STRING('c_custkey % 4')}"


def _repeated(leaves):
    """Values that stand more than once in a document."""
    from collections import Counter

    n = Counter(x.value for x in leaves)
    return [[(0, len(x.value.encode()), "repeated")] if n[x.value] > 1 else [] for x in leaves]


@query(f"SELECT {_STRING('c_custkey')} AS doc_id, replace({G.sql_text(_PAIR, x=_X, y=_Y)}, '\"' || {_X} || '\"', '\"[repeated#1]\"') AS content FROM customer")
def document_detector(spark, sf_dir):
    """A detector that sees a document as a whole."""
    docs = _customers(spark, sf_dir, doc_id=_STRING("c_custkey"), path="'a.json'", content=f"CAST({G.sql_text(_PAIR, x=_X, y=_Y)} AS BINARY)")
    done = documents.redact_all(docs, [detection.Detector("repeated", document=_repeated)], documents.Options(template=Template.parse("[{reason}#{n}]")))
    return done.select("doc_id", F.decode("content", "UTF-8").alias("content"))


def _word_model() -> Model:
    """A stand-in for a trained model: words in capitals are names, and go on over several words."""
    import re

    import numpy as np

    labels = ("O", "B-name", "I-name", "E-name", "S-name")

    def tokenize(text):
        found = list(re.finditer(r"\s*[^\s]+", text))
        return [int(bool(re.fullmatch("[A-Z]+", m[0].strip()))) for m in found], [m.span() for m in found]

    def scores(ids):
        caps = np.array(ids, bool)
        before, after = np.r_[False, caps[:-1]], np.r_[caps[1:], False]
        out = np.zeros((len(ids), 5))
        for k, on in enumerate((~caps, caps & ~before & after, caps & before & after, caps & before & ~after, caps & ~before & ~after)):
            out[:, k] = np.where(on, 9.0, 0.0)
        return out

    return Model(labels, tokenize, scores)


_PEOPLE = "'nation of ' || n_name || ' and ' || n_name || ' is number ' || CAST(n_nationkey AS STRING)"


@query(f"SELECT CAST(n_nationkey AS STRING) AS doc_id, 'nation of [REDACTED-1] and [REDACTED-1] is number ' || CAST(n_nationkey AS STRING) AS content FROM nation WHERE regexp_full_match(n_name, '[A-Z]+( [A-Z]+)*') UNION ALL SELECT CAST(n_nationkey AS STRING), {_PEOPLE} FROM nation WHERE NOT regexp_full_match(n_name, '[A-Z]+( [A-Z]+)*')")
def token_classes(spark, sf_dir):
    """Token classification over windows that overlap, with names cut by none of them."""
    own = detector(_word_model, max_tokens=6, overlap=2, min_score=0.9)
    docs = _rows(spark, sf_dir, "nation", doc_id=_STRING("n_nationkey"), path="'a.txt'", content=f"CAST({_PEOPLE} AS BINARY)")
    return documents.redact_all(docs, [own]).select("doc_id", F.decode("content", "UTF-8").alias("content"))
