"""Inputs made from the given tables for queries whose detectors find nothing in the tables themselves.

Each is a SQL expression that Spark and DuckDB both read, so that a query and the statement it is held against have the
same input; what is expected of them is stated apart, by construction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import dealt

#: The password of a customer, and the text it stands in, by kind.
PASSWORD = "('p' || CAST(c_custkey AS STRING) || 'w')"
TOKEN = "('sb_secret_' || substr(md5(CAST(c_custkey AS STRING)), 1, 24))"
_TEXTS = [
    ("'see postgres://u:' || {p} || '@db/x or postgres://u:changeme@db/x now'", [("credentialed_uri", "'postgres://u:' || {p} || '@db/x'")]),
    ("'set DB_PASSWORD=' || {p} || ' PWD=/tmp'", [("credential_assignment", "{p}")]),
    ("'host=h user=u password=' || {p} || ' rest'", [("connection_string", "'host=h user=u password=' || {p}")]),
    ("'Server=db;User Id=sa;Password=' || {p} || '; end'", [("connection_string", "'Server=db;User Id=sa;Password=' || {p}")]),
    ("'use jdbc:mysql://h/d?user=a&password=' || {p} || '.'", [("connection_string", "'jdbc:mysql://h/d?user=a&password=' || {p}")]),
    ("'mysql://h/d?password=' || {p} || ' and ' || {t}", [("connection_string", "'mysql://h/d?password=' || {p}"), ("provider_token", "{t}")]),
    ("'nothing of note, password=changeme'", []),
]
_fill = lambda s: s.format(p=PASSWORD, t=TOKEN)
CREDENTIAL_TEXT = "CASE c_custkey % 7 " + " ".join(f"WHEN {i} THEN {_fill(text)}" for i, (text, _) in enumerate(_TEXTS)) + " END"


def credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) with a credential in six of seven texts."""
    rows = dealt(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"))
    return rows.select(F.col("c_custkey").alias("doc_id"), F.expr(CREDENTIAL_TEXT).alias("text"))


def credential_spans() -> str:
    """(doc_id, start, end, label, secret) that are expected of those texts."""
    parts = [f"SELECT c_custkey AS doc_id, '{label}' AS label, {_fill(secret)} AS secret, {CREDENTIAL_TEXT} AS text FROM customer WHERE c_custkey % 7 = {i}" for i, (_, found) in enumerate(_TEXTS) for label, secret in found]
    return f'SELECT doc_id, position(secret IN text) - 1 AS "start", position(secret IN text) - 1 + length(secret) AS "end", label, secret FROM ({" UNION ALL ".join(parts)})'


#: An address line of a customer.
ADDRESS_TEXT = "'send it to ' || CAST(c_custkey % 900 + 1 AS STRING) || ' Old ' || CASE c_custkey % 3 WHEN 0 THEN 'Mill Street' WHEN 1 THEN 'Main Road.' ELSE 'main road' END || ', thanks'"

#: Documents in each format: path and body. {x} is a plain value, {y} the secret, {z} one under a key that is skipped, {q}
#: the secret as a plain YAML scalar, which comes back in quotes. Leaves are (index, key, path, value).
BODIES = {
    "json": ("a.json", '{"db": {"name": "{x}", "token": "{y}", "note": "{y}"}, "session_id": "{z}"}', [(0, "name", "db.name", "{x}"), (1, "token", "db.token", "{y}"), (2, "note", "db.note", "{y}")]),
    "jsonl": ("a.jsonl", '{"name": "{x}", "token": "{y}"}\n{"note": "{y}"}\n', [(0, "name", "name", "{x}"), (1, "token", "token", "{y}"), (2, "note", "note", "{y}")]),
    "yaml": ("a.yml", 'db:\n  name: {x}\n  token: {q}\n  note: "{y}"\n', [(0, "name", "db.name", "{x}"), (1, "token", "db.token", "{y}"), (2, "note", "db.note", "{y}")]),
    "toml": ("a.toml", '[db]\nname = "{x}"\ntoken = "{y}"\n"a.path" = "{y}"\n', [(0, "name", "db.name", "{x}"), (1, "token", "db.token", "{y}"), (2, "a.path", "db.a.path", "{y}")]),
    "xml": ("a.xml", '<db a="{y}"><name>{x}</name><token>{y}</token></db>', [(0, "a", "db.a", "{y}"), (1, "name", "db.name", "{x}"), (2, "token", "db.token", "{y}")]),
    "hcl": ("a.tf", 'db {\n  name = "{x}"\n  token = "{y}"\n}\n', [(0, "name", "db.name", "{x}"), (1, "token", "db.token", "{y}")]),
    "ini": ("a.ini", "[db]\nname={x}\ntoken={y}\nnote={y}\n", [(0, "name", "db.name", "{x}"), (1, "token", "db.token", "{y}"), (2, "note", "db.note", "{y}")]),
    "dotenv": (".env", 'export name={x}\ntoken="{y}"\n', [(0, "name", "name", "{x}"), (1, "token", "token", "{y}")]),
    "properties": ("a.properties", "db.name={x}\ndb.token={y}\nlog.path.note={y}\nuser.id={z}\n", [(0, "db.name", "db.name", "{x}"), (1, "db.token", "db.token", "{y}"), (2, "log.path.note", "log.path.note", "{y}")]),
    "tsv": ("a.tsv", "name\ttoken\tuser_id\n{x}\t{y}\t{z}\n", [(0, None, "", "name"), (1, None, "", "token"), (2, None, "", "user_id"), (3, "name", "name", "{x}"), (4, "token", "token", "{y}")]),
    "psv": ("a.psv", "name|token\n{x}|{y}\n", [(0, None, "", "name"), (1, None, "", "token"), (2, "name", "name", "{x}"), (3, "token", "token", "{y}")]),
}
SECRET = "md5(CAST(n_nationkey AS STRING))"
NAME = "n_name"


def sql_text(template: str, **values: str) -> str:
    """A template as a SQL expression; values are expressions themselves."""
    import re

    parts = []
    for piece in re.split(r"(\{[a-z]\}|\n|\t)", template):
        if re.fullmatch(r"\{[a-z]\}", piece) and piece[1] in values:
            parts.append(values[piece[1]])
        elif piece in ("\n", "\t"):
            parts.append(f"chr({ord(piece)})")
        elif piece:
            parts.append("'" + piece.replace("'", "''") + "'")
    return "(" + " || ".join(parts) + ")"


def formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, content): a document of each nation in each format."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    one = lambda name, path, body: F.struct(F.expr(f"CAST(n_nationkey AS STRING) || '-{name}'").alias("doc_id"), F.lit(path).alias("path"), F.encode(F.expr(sql_text(body, x=NAME, y=SECRET, z=SECRET, q=SECRET)), "UTF-8").alias("content"))
    return nation.select(F.explode(F.array(*[one(n, path, body) for n, (path, body, _) in BODIES.items()])).alias("d")).select("d.*")


def expected_leaves() -> str:
    quote = lambda s: "NULL" if s is None else sql_text(s, x=NAME, y=SECRET) if s else "''"
    return " UNION ALL ".join(
        f"SELECT CAST(n_nationkey AS STRING) || '-{name}' AS doc_id, '{name}' AS format, {i} AS leaf_idx, {quote(key)} AS \"key\", {quote(path)} AS path, {quote(value)} AS value FROM nation"
        for name, (_, _, found) in BODIES.items() for i, key, path, value in found
    )


def expected_documents() -> str:
    token = "'[REDACTED-1]'"
    return " UNION ALL ".join(f"SELECT CAST(n_nationkey AS STRING) || '-{name}' AS doc_id, '{name}' AS format, {sql_text(body, x=NAME, y=token, z=SECRET, q=chr(39) + chr(34) + '[REDACTED-1]' + chr(34) + chr(39))} AS content FROM nation" for name, (_, body, _) in BODIES.items())


def expected_findings() -> str:
    """(doc_id, id, detector, field, path, occurrences, first_at) of the one secret in each document."""
    rows = []
    for name, (_, body, found) in BODIES.items():
        mine = [(i, k, p) for i, k, p, v in found if v == "{y}"]
        # an attribute or another key may hold the secret before the key for which it is found
        first = next(x for x in mine if "token" in (x[1] or ""))
        text = sql_text(body, x=NAME, y=SECRET, z=SECRET, q=SECRET)
        rows.append(f"SELECT CAST(n_nationkey AS STRING) || '-{name}' AS doc_id, 1 AS id, 'entropy' AS detector, '{first[1]}' AS field, '{first[2]}' AS path, {len(mine)} AS occurrences, position({SECRET} IN {text}) - 1 AS first_at FROM nation")
    return " UNION ALL ".join(rows)


#: JSON of a customer for allow lists: an allowed path, an image, a listed file, a key path of some files, allowed values.
ALLOW_BODY = '{"keep": {"token": "{k}"}, "pic": {"type": "image/png", "token": "{i}"}, "css_token": "{c}", "mail": "{m}", "token": "{t}"}'
ALLOW_PATH = "CASE c_custkey % 3 WHEN 0 THEN 'lib/a.json' WHEN 1 THEN 'web/b.json' ELSE 'src/c.json' END"
_h = lambda tag: f"md5('{tag}' || CAST(c_custkey AS STRING))"
ALLOW_VALUES = {"k": _h("k"), "i": _h("i"), "c": _h("c"), "m": "('u' || CAST(c_custkey AS STRING) || '@x.example.com')", "t": _h("t")}


def allow_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dealt(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"))
    return rows.select(F.col("c_custkey").cast("string").alias("doc_id"), F.expr(ALLOW_PATH).alias("path"), F.encode(F.expr(sql_text(ALLOW_BODY, **ALLOW_VALUES)), "UTF-8").alias("content"))


def expected_allowed() -> str:
    """Ids count what is found, allowed or not: css_token (where its path is scanned), mail, token."""
    css = "CASE WHEN c_custkey % 3 = 1 THEN {c} WHEN c_custkey % 3 = 0 THEN {c} ELSE '[REDACTED-1]' END".format(c=ALLOW_VALUES["c"])
    shift = "CASE WHEN c_custkey % 3 = 1 THEN 0 ELSE 1 END"
    token = lambda n: f"'[REDACTED-' || CAST({shift} + {n} AS STRING) || ']'"
    mail = f"CASE WHEN c_custkey % 3 = 0 OR CAST(c_custkey AS STRING) LIKE '1%' THEN {ALLOW_VALUES['m']} ELSE {token(1)} END"
    last = f"CASE WHEN c_custkey % 3 = 0 THEN {ALLOW_VALUES['t']} ELSE {token(2)} END"
    return f"SELECT CAST(c_custkey AS STRING) AS doc_id, {sql_text(ALLOW_BODY, **(ALLOW_VALUES | {'c': f'({css})', 'm': f'({mail})', 't': f'({last})'}))} AS content FROM customer"


#: Texts for rules: a token that is assigned and stands again, an id some lines above a key, a secret that filters judge.
RULE_TEXTS = {
    "match": "'n' || CAST(o_orderkey AS STRING) || ' tok=' || md5(CAST(o_orderkey AS STRING)) || '; again ' || md5(CAST(o_orderkey AS STRING)) || CASE WHEN o_orderkey % 5 = 0 THEN ' # gitleaks:allow' ELSE ' end' END",
    "component": "'id:' || CAST(o_orderkey AS STRING) || repeat(chr(10), CAST(o_orderkey % 6 AS INT)) || ' key=' || md5(CAST(o_orderkey AS STRING))",
    "filter": "'tok=' || CASE o_orderkey % 4 WHEN 0 THEN repeat('ab', 12) WHEN 1 THEN 'test' || substr(md5(CAST(o_orderkey AS STRING)), 1, 24) ELSE md5(CAST(o_orderkey AS STRING)) END",
}
RULES = {
    "match": "[[rules]]\nid = 'token'\nregex = '''tok=([a-z0-9]+)'''\nkeywords = ['TOK=']\n",
    "component": "[[rules]]\nid = 'key'\nregex = '''key=(\\w+)'''\n[[rules.components]]\nid = 'part'\nwithin = '4L'\n[[rules]]\nid = 'part'\nregex = '''id:(\\d+)'''\nskipReport = true\n",
    "filter": "filter = '''containsAny(finding[\"secret\"], [\"TEST\"])'''\n[[rules]]\nid = 'token'\nregex = '''tok=([a-z0-9]+)'''\nentropy = 2.0\n",
}


def rule_texts(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")).select(F.col("o_orderkey").alias("doc_id"), F.expr(RULE_TEXTS[kind]).alias("text"))
