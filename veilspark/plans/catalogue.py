"""Queries of the redaction engine over the driver's tables, each with the DuckDB statement it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import detectors as D
from ..functions import patterns as P
from ..functions import spans as S
from ..functions.globs import glob
from ..functions.tokens import Template
from ..operators import detection, documents, redaction, scan, search
from ..rules import engine
from ..sources import files
from . import generated as G
from . import oracles as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
PII = ("pii:email", "pii:phone")
TOKEN = r'token = "([0-9a-f]{40})"'
_chars = {"unit": "length"}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spans(df: DataFrame, found: Column, text: str = "text") -> DataFrame:
    rows = df.select("doc_id", F.explode(S.with_secrets(F.col(text), found)).alias("s"))
    return rows.select("doc_id", "s.start", "s.end", "s.label", "s.secret")


@query(O.spans(O.EMAIL, "pii:email"))
def email_spans(spark, sf_dir):
    return _spans(_read(spark, sf_dir), D.email(F.col("text")))


@query(f"SELECT * FROM ({O.spans(O.EMAIL, 'pii:email')}) WHERE NOT ends_with(lower(secret), '@mail1.example.com')")
def email_allowlist(spark, sf_dir):
    return _spans(_read(spark, sf_dir), D.email(F.col("text"), ["@mail1.example.com"]))


@query(O.spans(O.PHONE, "pii:phone"))
def phone_spans(spark, sf_dir):
    return _spans(_read(spark, sf_dir), D.phone(F.col("text")))


@query(O.spans(O.ADDRESS, "pii:address", f"SELECT c_custkey AS doc_id, {G.ADDRESS_TEXT} AS text FROM customer"))
def address_spans(spark, sf_dir):
    rows = files.dealt(_read(spark, sf_dir, "customer").select("c_custkey")).select(F.col("c_custkey").alias("doc_id"), F.expr(G.ADDRESS_TEXT).alias("text"))
    return _spans(rows, D.address(F.col("text")))


@query(O.redacted([O.spans(O.EMAIL, "pii:email", unit="length")], token="'<mail ' || id || '>'"))
def redact_email_text(spark, sf_dir):
    from ..api import RedactorBuilder

    redactor = RedactorBuilder().detector("pii:email").replacement("<mail {n}>").build()
    return redactor.table(_read(spark, sf_dir).select("doc_id", "text")).select("doc_id", "redacted")


@query(O.redacted([O.spans(O.EMAIL, "pii:email", **_chars), O.spans(O.PHONE, "pii:phone", **_chars)]))
def redact_numbered(spark, sf_dir):
    return redaction.redact(_read(spark, sf_dir).select("doc_id", "text"), PII).select("doc_id", "redacted")


_TOKENS = "SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9+_=-]{10,}')) AS token FROM documents"


@query(f"SELECT doc_id, token, {O.entropy('token')} AS bits FROM ({_TOKENS})")
def token_entropy(spark, sf_dir):
    rows = _read(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(P.ENTROPY_TOKEN + "{10,}"), F.lit(0))).alias("token"))
    return rows.select("doc_id", "token", F.round(S.entropy(F.col("token")), 6).alias("bits"))


@query(f"SELECT doc_id, \"start\", \"end\", label, secret FROM ({O.spans('[A-Za-z0-9+_=-]{10,}', 'entropy')}) WHERE {O.entropy('secret')} > 3.5")
def entropy_over_threshold(spark, sf_dir):
    return _spans(_read(spark, sf_dir), D.entropy(F.col("text"), threshold=3.5))


@query("""SELECT src, id, token FROM (SELECT 'documents' AS src, doc_id AS id, unnest(regexp_extract_all(text, '[A-Za-z0-9+_=-]{10,}')) AS token FROM documents
 UNION ALL SELECT 'pages', page_id, unnest(regexp_extract_all(html, '[A-Za-z0-9+_=-]{10,}')) FROM pages) WHERE length(token) IN (32, 40, 64) AND regexp_full_match(token, '[0-9A-Fa-f]+')""")
def hex_digest_tokens(spark, sf_dir):
    def side(name, key, text):
        rows = _read(spark, sf_dir, name).select(F.lit(name).alias("src"), F.col(key).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(P.ENTROPY_TOKEN + "{10,}"), F.lit(0))).alias("token"))
        return rows.filter(F.length("token").isin(*P.HEX_LENGTHS) & F.col("token").rlike(r"\A[0-9A-Fa-f]+\z"))

    return side("documents", "doc_id", "text").unionByName(side("pages", "page_id", "html"))


_KEYS = {"apiKey": True, "AWSSecretKey": True, "API_KEY": True, "keyboard": False, "public_key": False, "my-public-key": False, "db.password": True, "monkey": False, "session token": True, "PWD": True, "passport": False, "idempotency_key": False, "k": False}


@query("SELECT doc_id, k AS key, s AS sensitive FROM (SELECT n_nationkey AS doc_id FROM nation), (VALUES " + ", ".join(f"('{k}', {s})" for k, s in _KEYS.items()) + ") AS t(k, s)")
def sensitive_key_hits(spark, sf_dir):
    keys = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.explode(F.array(*map(F.lit, _KEYS))).alias("key"))
    return keys.withColumn("sensitive", D.is_sensitive_key(F.col("key")))


_LEAVES = "SELECT event_id, key AS path, json_extract_string(props, '$.' || key) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)"


@query(_LEAVES)
def json_leaves(spark, sf_dir):
    leaves = F.from_json("props", "map<string,string>")
    return _read(spark, sf_dir, "events").select("event_id", F.explode(leaves).alias("path", "value"))


@query(f"SELECT event_id, path, value, regexp_matches(path, '^k$') AS hit FROM ({_LEAVES}) WHERE path <> 'session_id'")
def path_detector(spark, sf_dir):
    leaves = json_leaves(spark, sf_dir).filter(~F.col("path").rlike(glob("session*")))
    return leaves.withColumn("hit", F.size(D.path(F.col("value"), F.col("path"), ["k", "**.secret"])) > 0)


@query(f"SELECT doc_id, unnest(regexp_extract_all(text, {O.quote(TOKEN)}, 1)) AS token FROM documents")
def token_assignment(spark, sf_dir):
    return _read(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(1))).alias("token"))


@query(O.spans("red|gear|bolt|small", "value", "SELECT p_partkey AS doc_id, p_name AS text FROM part"))
def value_detector(spark, sf_dir):
    parts = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text"))
    return redaction.occurrences(parts, detection.values(["red", "gear", "bolt", "small"]))


_BOTH = [O.spans(O.EMAIL, "pii:email", **_chars), O.spans("[0-9a-f]{20,}", "hex", **_chars), O.spans(r'token = "[0-9a-f]+', "assign", **_chars)]


@query(f'SELECT doc_id, strlen(substr(text, 1, "start")) AS "start", strlen(substr(text, 1, "end")) AS "end", label FROM ({O.merged(_BOTH)}) JOIN documents USING (doc_id)')
def span_union_merge(spark, sf_dir):
    text = F.col("text")
    found = F.concat(D.email(text), S.find(text, "[0-9a-f]{20,}", "hex"), S.find(text, 'token = "[0-9a-f]+', "assign"))
    return _read(spark, sf_dir).select("doc_id", "text", found.alias("found")).select("doc_id", F.explode(S.merge(F.col("found"))).alias("s")).select("doc_id", "s.start", "s.end", "s.label")


_OCC = " UNION ALL ".join([O.spans(O.EMAIL, "pii:email"), O.spans(O.PHONE, "pii:phone")])
_FINDINGS = f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY min("start")) AS id, secret, min_by(label, "start") AS detector, '[REDACTED-' || row_number() OVER (PARTITION BY doc_id ORDER BY min("start")) || ']' AS token, strlen(secret) AS len, list("start" ORDER BY "start") AS offsets, count(*) AS occurrences FROM ({_OCC}) GROUP BY doc_id, secret"""


def _found(spark, sf_dir):
    return redaction.findings(redaction.occurrences(_read(spark, sf_dir), PII))


@query(_FINDINGS)
def finding_groups(spark, sf_dir):
    return _found(spark, sf_dir)


@query(f"SELECT secret, count(DISTINCT doc_id) AS docs, min(doc_id) AS first_doc FROM ({_OCC}) GROUP BY secret HAVING count(DISTINCT doc_id) > 1")
def cross_doc_secrets(spark, sf_dir):
    pairs = redaction.occurrences(_read(spark, sf_dir), PII).select("secret", "doc_id").distinct()
    return pairs.groupBy("secret").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc")).filter("docs > 1")


@query(f"""WITH o AS (SELECT *, 1 + strlen(substr(text, 1, p)) - strlen(replace(substr(text, 1, p), chr(10), '')) AS line, strlen(substr(text, 1, p)) AS b FROM (SELECT doc_id, "start" AS p, secret FROM ({O.spans(O.EMAIL, 'pii:email', **_chars)})) JOIN documents USING (doc_id))
SELECT doc_id, b AS "start", line, strlen(list_last(string_split(substr(text, 1, p), chr(10)))) + 1 AS col FROM o""")
def line_col(spark, sf_dir):
    rows = _read(spark, sf_dir).select("doc_id", "text", F.explode(D.email(F.col("text"))).alias("s"))
    at = F.col("s.start")
    return rows.select("doc_id", at.alias("start"), S.line_of(F.col("text"), at).alias("line"), S.column_of(F.col("text"), at).alias("col"))


_REPORT = f"SELECT source AS path, detector, min(doc_id * 1000 + id) AS first_at, count(*) AS n FROM ({_FINDINGS}) JOIN documents USING (doc_id) GROUP BY ALL"


@query(f"SELECT path, sum(n)::BIGINT AS findings, list(detector ORDER BY first_at) AS detectors FROM ({_REPORT}) GROUP BY path")
def scan_report(spark, sf_dir):
    return redaction.scan_report(_read(spark, sf_dir), _found(spark, sf_dir), "source")


@query(f"SELECT count(*) AS scanned, count(n) AS with_findings, coalesce(sum(n), 0)::BIGINT AS findings, count(*) FILTER (WHERE strlen(coalesce(text, '')) > 10485760) AS skipped FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({_FINDINGS}) GROUP BY doc_id) USING (doc_id)")
def scan_totals(spark, sf_dir):
    """One pass: distinct secrets are counted per text, without a shuffle of findings."""
    docs = redaction.with_spans(_read(spark, sf_dir).select("doc_id", "text"), PII)
    n = F.size(F.array_distinct(S.secrets(F.col("text"), F.col("spans"))))
    return docs.agg(F.count("*").alias("scanned"), F.count_if(F.size("spans") > 0).alias("with_findings"), F.coalesce(F.sum(F.when(F.size("spans") > 0, n)), F.lit(0)).alias("findings"), F.count_if(F.octet_length("text") > 10485760).alias("skipped"))


_LINES = "SELECT doc_id, unnest(range(len(l))) + 1 AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(CASE WHEN ends_with(t, chr(10)) THEN t[1:-2] ELSE t END, chr(10)) AS l FROM (SELECT doc_id, redacted AS t FROM ({src})))"
_LINES = _LINES.format(src=O.redacted([O.spans(O.EMAIL, "pii:email", **_chars), O.spans(O.PHONE, "pii:phone", **_chars)]))
_HIT = "licensed|License|REDACTED"


@query(f"SELECT doc_id, line_no, line, true AS is_match FROM ({_LINES}) WHERE regexp_matches(line, '{_HIT}') AND doc_id IN (SELECT doc_id FROM documents WHERE regexp_matches(text, '{_HIT}'))")
def grep_lines(spark, sf_dir):
    return search.grep(_read(spark, sf_dir).select("doc_id", "text"), _HIT, PII)


@query(f"SELECT doc_id, count(*) AS n FROM ({_LINES}) WHERE regexp_matches(line, 'the ') GROUP BY doc_id")
def grep_count(spark, sf_dir):
    return search.counts(_read(spark, sf_dir).select("doc_id", "text"), "the ", PII)


@query(f"SELECT doc_id, count(*) AS n FROM ({_LINES}) WHERE NOT regexp_matches(line, 'e') GROUP BY doc_id")
def grep_invert(spark, sf_dir):
    """Lines without an e after redaction, which may take the only one away; so every text is redacted."""
    return search.counts(_read(spark, sf_dir).select("doc_id", "text"), "e", PII, invert=True, probe=False)


@query(f"SELECT doc_id FROM (SELECT doc_id, bool_or(regexp_matches(line, '@')) AS hit FROM ({_LINES}) GROUP BY doc_id) WHERE NOT hit")
def grep_files_without(spark, sf_dir):
    return search.without_match(_read(spark, sf_dir).select("doc_id", "text"), "@", PII)


_M = f"SELECT doc_id, line_no, line, regexp_matches(line, 'licensed') AND sum(regexp_matches(line, 'licensed')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) <= 2 AS is_match FROM ({_LINES})"


@query(f"SELECT doc_id, line_no, line, is_match, sum(gap) OVER (PARTITION BY doc_id ORDER BY line_no)::BIGINT AS island FROM (SELECT *, coalesce((line_no - lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) > 1)::INT, 0) AS gap FROM (SELECT * FROM ({_M}) QUALIFY max(is_match::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) = 1))")
def grep_context(spark, sf_dir):
    rows = search.grep(_read(spark, sf_dir).select("doc_id", "text"), "licensed", PII, before=1, after=2, max_count=2)
    return search.context_groups(rows)


_LEAD = O.spans(O.EMAIL, "pii:email")


@query(O.redacted([O.spans(O.EMAIL, "pii:email", **_chars)], token="CASE WHEN regexp_full_match(secret, '[a-h].*') THEN secret ELSE '[REDACTED-' || id || ']' END"))
def allow_regexes(spark, sf_dir):
    """Numbered addresses, of which those that an allow pattern fits stay and keep their number."""
    return redaction.redact(_read(spark, sf_dir).select("doc_id", "text"), ["pii:email"], allow_regexes=["[a-h].*"]).select("doc_id", "redacted")


@query(f"""SELECT h.doc_id, h."start", h."end", h.label, h.secret FROM ({O.spans('[0-9a-f]{20,}', 'regex')}) h WHERE NOT EXISTS (SELECT 1 FROM ({O.spans(r'token = "[0-9][0-9a-f]+"', 'within')}) w WHERE w.doc_id = h.doc_id AND w."start" <= h."start" AND w."end" >= h."end")""")
def allow_within(spark, sf_dir):
    found = redaction.with_spans(_read(spark, sf_dir).select("doc_id", "text"), detection.regex(["[0-9a-f]{20,}"]), within=['token = "[0-9][0-9a-f]+"'])
    return _spans(found, F.col("spans"))


@query(f"""SELECT DISTINCT a.doc_id, a."start", a."end" FROM ({O.spans('[0-9a-f]{20,}', 'hex')}) a WHERE EXISTS (SELECT 1 FROM ({O.spans('[Tt]oken|[Kk]ey', 'word')}) b WHERE b.doc_id = a.doc_id AND b."start" BETWEEN a."start" - 80 AND a."end" + 80)""")
def component_within(spark, sf_dir):
    """A band semi-join inside each text: long hex runs with a word within 80 bytes."""
    text = F.col("text")
    near = lambda a, words: F.exists(words, lambda b: b["start"].between(a["start"] - 80, a["end"] + 80))
    words = F.when(text.rlike("[0-9a-f]{20,}"), S.find(text, "[Tt]oken|[Kk]ey", "word")).otherwise(S.none())
    rows = _read(spark, sf_dir).select("doc_id", S.find(text, "[0-9a-f]{20,}", "hex").alias("h"), words.alias("w"))
    return rows.select("doc_id", F.explode(F.filter("h", lambda a: near(a, F.col("w")))).alias("s")).select("doc_id", "s.start", "s.end")


_RULES = [("aws", "akia"), ("generic-token", "token"), ("license", "license"), ("mail", "@")]


@query("SELECT rule, count(*) AS docs FROM documents, (VALUES " + ", ".join(f"('{r}', '{k}')" for r, k in _RULES) + ") AS r(rule, keyword) WHERE contains(lower(text), keyword) GROUP BY rule")
def keyword_candidates(spark, sf_dir):
    """Rules whose keyword a text holds, by the rule engine's first pass."""
    source = "\n".join(f"[[rules]]\nid = '{r}'\nregex = 'x'\nkeywords = ['{k}']" for r, k in _RULES)
    return engine.candidate_rules(_read(spark, sf_dir), [source]).groupBy("rule").agg(F.count("*").alias("docs"))


@query(f"""SELECT doc_id, secret, 'ruleset:' || label AS label, count(*) AS n FROM (SELECT *, min(label) OVER (PARTITION BY doc_id, secret) AS first FROM ({O.spans('[0-9a-f]{40}', 'a-hex40')} UNION ALL {O.spans('[0-9a-z]{24,}', 'b-long')})) WHERE label = first GROUP BY ALL""")
def rule_dedup(spark, sf_dir):
    """The first rule in file order wins per distinct secret of a text, and reports each of its occurrences."""
    own = engine.ruleset(["[[rules]]\nid = 'a-hex40'\nregex = '[0-9a-f]{40}'\n[[rules]]\nid = 'b-long'\nregex = '[0-9a-z]{24,}'"])
    found = _read(spark, sf_dir).select("doc_id", "text").withColumn("found", own.column(detection.Leaf(F.coalesce("text", F.lit("")))))
    raw = _spans(found, F.col("found"))
    return raw.groupBy("doc_id", "secret", "label").agg(F.count("*").alias("n"))


_CONV = "SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations"


@query(O.redacted([O.spans(O.EMAIL, "pii:email", _CONV, **_chars), O.spans(O.PHONE, "pii:phone", _CONV, **_chars)], _CONV))
def pii_redact_conversations(spark, sf_dir):
    rows = _read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return redaction.redact(rows, PII).select("doc_id", "redacted")


@query(f"SELECT lang, detector, sum(occurrences)::BIGINT AS n, count(*) AS secrets, grouping(lang) + 0 AS all_langs, grouping(detector) + 0 AS all_detectors FROM ({_FINDINGS}) JOIN documents USING (doc_id) GROUP BY CUBE (lang, detector)")
def findings_cube(spark, sf_dir):
    rows = _read(spark, sf_dir).select("doc_id", "lang").join(_found(spark, sf_dir), "doc_id")
    return rows.cube("lang", "detector").agg(F.sum("occurrences").alias("n"), F.count("*").alias("secrets"), F.grouping("lang").cast("int").alias("all_langs"), F.grouping("detector").cast("int").alias("all_detectors"))


@query(f"""WITH added AS (SELECT doc_id, doc_id % 4 + 1 AS first, doc_id % 4 + 4 AS last FROM documents)
SELECT o.doc_id, o."start", 1 + strlen(h) - strlen(replace(h, chr(10), '')) AS line FROM (SELECT s.doc_id, strlen(substr(text, 1, s."start")) AS "start", substr(text, 1, s."start") AS h FROM ({O.spans(O.EMAIL, 'e', **_chars)}) s JOIN documents USING (doc_id)) o JOIN added a ON a.doc_id = o.doc_id WHERE 1 + strlen(h) - strlen(replace(h, chr(10), '')) BETWEEN a.first AND a.last""")
def diff_lines(spark, sf_dir):
    """Addresses on added lines, which are four of each text."""
    docs = _read(spark, sf_dir)
    rows = docs.select("doc_id", "text", F.explode(D.email(F.col("text"))).alias("s")).select("doc_id", "s.start", S.line_of(F.col("text"), F.col("s.start")).alias("line"))
    added = docs.select("doc_id", (F.col("doc_id") % 4 + 1).alias("first"), (F.col("doc_id") % 4 + 4).alias("last"))
    return search.in_lines(rows, added)


@query("SELECT doc_id, strlen(text) AS size, doc_id % 3 = 0 AS is_binary FROM documents WHERE strlen(text) <= 2000")
def size_and_binary_filter(spark, sf_dir):
    """A size limit that leaves texts out, and a NUL put into every third text."""
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("ab\0"), "text")).otherwise(F.col("text"))
    rows = _read(spark, sf_dir).select("doc_id", F.octet_length("text").alias("size"), F.encode(text, "UTF-8").alias("content"))
    return files.within_size(rows, 2000).select("doc_id", "size", files.is_binary("content").alias("is_binary"))


@query(G.credential_spans())
def default_detectors(spark, sf_dir):
    """All default detectors over texts with credentials of each kind."""
    return redaction.occurrences(G.credentials(spark, sf_dir), D.DEFAULT)


@query(O.redacted([O.spans(O.EMAIL, "pii:email", **_chars), O.spans(O.PHONE, "pii:phone", **_chars)], token="'[' || label || '#' || id || ']'"))
def labelled_redaction(spark, sf_dir):
    """Personal data beside the default detectors, which find nothing in these texts."""
    docs = _read(spark, sf_dir).select("doc_id", "text")
    return redaction.redact(docs, [*D.DEFAULT, *PII], template=Template.parse("[{reason}#{n}]")).select("doc_id", "redacted")


@query("""WITH n AS (SELECT n_regionkey::VARCHAR AS doc_id, n_name, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rn FROM nation)
SELECT doc_id, 0 AS leaf_idx, NULL AS key, 'name' AS value FROM n GROUP BY doc_id UNION ALL SELECT doc_id, 1, NULL, 'number' FROM n GROUP BY doc_id
UNION ALL SELECT doc_id, 2 * rn, 'name', n_name FROM n UNION ALL SELECT doc_id, 2 * rn + 1, 'number', n_nationkey::VARCHAR FROM n""")
def csv_leaves(spark, sf_dir):
    """Nations of each region written as a CSV document and read back as leaves."""
    rows = F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))
    body = F.concat(F.lit("name,number\n"), F.array_join(F.transform(rows, lambda r: F.concat(r["n_name"], F.lit(","), r["n_nationkey"].cast("string"), F.lit("\r\n"))), ""))
    docs = _read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("doc_id")).agg(F.encode(body, "UTF-8").alias("content"))
    return documents.leaves(docs.select("doc_id", F.lit("nations.csv").alias("path"), "content")).select("doc_id", "leaf_idx", "key", "value")


@query(f"SELECT doc_id::VARCHAR AS doc_id, 'json' AS format, '{{\"text\":' || to_json(redacted) || '}}' AS content FROM ({O.redacted([O.spans(O.EMAIL, 'pii:email', **_chars), O.spans(O.PHONE, 'pii:phone', **_chars)])}) WHERE regexp_matches(redacted, 'REDACTED')")
def structured_roundtrip(spark, sf_dir):
    """Documents wrapped as JSON, parsed, redacted at their leaves and rewritten; those with findings."""
    docs = _read(spark, sf_dir).select("doc_id", F.lit("d.json").alias("path"), F.encode(F.to_json(F.struct("text")), "UTF-8").alias("content"))
    rendered, _ = documents.redact_documents(docs, PII)
    out = rendered.select("doc_id", "format", F.decode("content", "UTF-8").alias("content"))
    return out.filter(F.contains("content", F.lit("REDACTED")))


@query(G.expected_leaves())
def format_leaves(spark, sf_dir):
    """Leaves of a document in each format, with keys that hold dots and keys that are skipped."""
    return documents.leaves(G.formatted(spark, sf_dir)).select("doc_id", "format", "leaf_idx", "key", "path", "value")


@query(G.expected_documents())
def format_redaction(spark, sf_dir):
    """The same documents redacted: a token by its key, and its other occurrences because it is known."""
    done = documents.redact_all(G.formatted(spark, sf_dir))
    return done.select("doc_id", "format", F.decode("content", "UTF-8").alias("content"))


@query(G.expected_findings())
def format_findings(spark, sf_dir):
    found = documents.redact_all(G.formatted(spark, sf_dir)).select("doc_id", F.explode("findings").alias("f"))
    return found.select("doc_id", "f.id", "f.detector", "f.field", "f.path", "f.occurrences", F.get("f.offsets", F.lit(0)).alias("first_at"))


@query(G.expected_allowed())
def allow_lists(spark, sf_dir):
    """Allowed paths, files, paths of some files, patterns, and objects left alone for their type."""
    from ..functions.globs import FileGlobs, FileKeyPaths

    options = documents.Options(allow_paths=("keep",), file_paths=FileKeyPaths.of(["web/*.json#css_token"]), files=FileGlobs(("lib/",)), allow=documents.Allow(regexes=["u1.*"]))
    done = documents.redact_all(G.allow_documents(spark, sf_dir), ["entropy", "pii:email"], options)
    return done.select("doc_id", F.decode("content", "UTF-8").alias("content"))


def _ruled(spark, sf_dir, kind):
    return redaction.occurrences(G.rule_texts(spark, sf_dir, kind), [engine.ruleset([G.RULES[kind]])])


_RULE = lambda kind: f"SELECT o_orderkey AS doc_id, {G.RULE_TEXTS[kind]} AS text, md5(CAST(o_orderkey AS STRING)) AS h, o_orderkey % 60 AS k FROM orders"


@query(f"""SELECT doc_id, position('tok=' IN text) + 3 AS "start", position('tok=' IN text) + 35 AS "end", 'ruleset:token' AS label, h AS secret FROM ({_RULE('match')}) WHERE k % 5 <> 0
 UNION ALL SELECT doc_id, position('again ' IN text) + 5, position('again ' IN text) + 37, 'ruleset:token', h FROM ({_RULE('match')}) WHERE k % 5 <> 0""")
def rule_occurrences(spark, sf_dir):
    """A rule's secret wherever it stands, but for lines that are marked as allowed."""
    return _ruled(spark, sf_dir, "match")


@query(f"""SELECT doc_id, count(*) AS n FROM ({_RULE('match')}) WHERE k % 5 <> 0 GROUP BY doc_id""")
def rule_match(spark, sf_dir):
    """Distinct secrets by rule."""
    return _ruled(spark, sf_dir, "match").groupBy("doc_id").agg(F.count_distinct("secret").alias("n"))


@query(f"""SELECT doc_id, position('key=' IN text) + 3 AS "start", position('key=' IN text) + 35 AS "end", 'ruleset:key' AS label, h AS secret FROM ({_RULE('component')}) WHERE k % 6 <= 3""")
def rule_components(spark, sf_dir):
    """Keys with an id at most three lines above."""
    return _ruled(spark, sf_dir, "component")


@query(f"""SELECT doc_id, 4 AS "start", length(text) AS "end", 'ruleset:token' AS label, substr(text, 5) AS secret FROM ({_RULE('filter')}) WHERE NOT contains(lower(substr(text, 5)), 'test') AND list_aggregate(string_split(substr(text, 5), ''), 'entropy') > 2.0""")
def rule_filters(spark, sf_dir):
    """Tokens that neither the file's filter nor the rule's entropy discards."""
    return _ruled(spark, sf_dir, "filter")


_AT = "'d' || CAST({id} % 7 AS STRING) || '/' || CAST({id} AS STRING) || '.txt'"


@query(f"""SELECT path, count(*) AS count, list(label ORDER BY "start") AS labels, starts_with(path, 'd3/') AS protected FROM (SELECT {_AT.format(id='doc_id')} AS path, * FROM ({G.credential_spans()})) GROUP BY path""")
def scan_files(spark, sf_dir):
    """What a scan reports of a file for each customer, of which one folder is protected."""
    from ..functions.globs import FileGlobs

    docs = G.credentials(spark, sf_dir).select(F.expr(_AT.format(id="doc_id")).alias("doc_id"), F.lit("d.txt").alias("path"), F.encode("text", "UTF-8").alias("content"))
    report = scan.scanned(documents.redact_all(docs), FileGlobs(("d3/",)))
    return report.select("path", "count", F.col("detectors").alias("labels"), "protected")


@query("""SELECT n, w, greatest(w * 6 - 2, 0) AS first, least(w * 6 + 8, n) AS "end", w * 6 AS owned_from, least(w * 6 + 6, n) AS owned_to FROM (SELECT n, unnest(range((n + 5) // 6)) AS w FROM (SELECT DISTINCT length(text) % 50 + 11 AS n FROM documents))""")
def token_windows(spark, sf_dir):
    """Windows of at most ten tokens with two of context, for several lengths."""
    from ..functions.classify import windows_column

    lengths = _read(spark, sf_dir).filter("text is not null").select((F.length("text") % 50 + 11).alias("n")).distinct()
    return lengths.select("n", F.posexplode(windows_column(F.col("n"), 10, 2)).alias("w", "x")).select("n", "w", "x.*")


from . import surface  # noqa: E402, F401
