"""The redaction engine: queries against DuckDB, formats, templates, globs, detectors, streams."""

import json
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from veilspark.functions import detectors as D
from veilspark.functions import globs
from veilspark.functions import patterns as P
from veilspark.functions import spans as S
from veilspark.functions.literals import find_literals
from veilspark.functions.tokens import Template
from veilspark.operators import documents, redaction, search
from veilspark.plans import catalogue
from veilspark.sources import formats
from veilspark.streaming.redact import redact_stream

SECRET = "q7Zp2LmX9vRt4KsW" + "8nBc1YdF6hGj3TaE" + "5uQoVxNz"


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return int(v) if isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents pages benchmark labels conversations").split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(catalogue.ORACLE_SQL[name]).df()
    got = catalogue.QUERIES[name](spark, sf_dir).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)
    assert rows(got) == rows(want)


def redact_all(spark, texts, names=D.DEFAULT, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.redacted for r in redaction.redact(df, names, **options).orderBy("doc_id").collect()]


def test_text(spark):
    texts = [
        f"key {SECRET} and {SECRET} end", f"café {SECRET}", "postgres://u:hunter2x@db/x and postgres://u:changeme@db/x", "DB_PASSWORD='s3cr3t value' PWD=/tmp",
        "host=h user=u password=pw1234567 rest", "Server=db;User Id=sa;Password=abcdEf1;", "jdbc:mysql://h/d?user=a&password=zz9zz9.", "mysql://h/d?password=q%41w", "[REDACTED-1] stays", None, "",
        "sb_secret_" + "a1B2" * 6,
    ]
    got = redact_all(spark, texts)
    assert got[0] == "key [REDACTED-1] and [REDACTED-1] end"
    assert got[1] == "café [REDACTED-1]"
    assert got[2] == "[REDACTED-1] and postgres://u:changeme@db/x"
    assert got[3] == "DB_PASSWORD='[REDACTED-1]' PWD=/tmp"
    assert got[4].startswith("[REDACTED-1]") and "pw1234567" not in got[4]
    assert got[5] == "[REDACTED-1];" and got[6] == "[REDACTED-1]." and got[7] == "[REDACTED-1]"
    assert got[8:11] == ["[REDACTED-1] stays", None, ""] and got[11] == "[REDACTED-1]"
    again = redact_all(spark, got)
    assert again == got


@pytest.mark.parametrize("key", "DB_PASSWORD PGPASSWORD REDIS_PASSWORD database_password APP_DB_PASSWORD PROD_MYSQL_PWD MYSQL_ROOT_PASSWORD MARIADB_ROOT_PASSWORD MONGO_INITDB_ROOT_PASSWORD MSSQL_SA_PASSWORD DB__PASSWORD".split())
def test_database_keys(key):
    assert re.fullmatch(P.DATABASE_KEY, key.lower())


@pytest.mark.parametrize("key", ["pwd", "key", "password_reset", "db_password_hash", "mysql_user_id", "password"])
def test_other_keys(key):
    assert not re.fullmatch(P.DATABASE_KEY, key)


def test_allow_and_labels(spark):
    text = f"a@b.com c@d.org {SECRET}"
    assert redact_all(spark, [text], ["pii:email"], allow_values=["a@b.com"]) == [f"a@b.com [REDACTED-2] {SECRET}"]
    assert redact_all(spark, [text], ["pii:email"], allow_regexes=["c@.*"]) == [f"[REDACTED-1] c@d.org {SECRET}"]
    assert redact_all(spark, [text], ["pii:email"], within=["a@b.com c"]) == [f"a@b.com [REDACTED-1] {SECRET}"]
    assert redact_all(spark, [text], ["pii:email"], template=Template.parse("<{reason} {n}>")) == [f"<pii:email 1> <pii:email 2> {SECRET}"]


def test_templates():
    t = Template.parse("{{x}}[{reason}#{n}]")
    assert t.token(3, "a:b") == "{x}[a:b#3]" and t.is_token("{x}[a:b#3]") and not t.is_token("{x}[a:b#0]")
    assert Template.parse().find_tokens("é [REDACTED-12] [REDACTED-0]") == [(3, 16)]
    for bad in ("", "x", "{n}", "a{n}{n}b", "a{n", "a{x}{n}b", "a{reason}:{n}]", "a{n}{reason}b", "a}{n}b"):
        with pytest.raises((ValueError, IndexError)):
            Template.parse(bad)


def test_placeholders(spark):
    yes = ["", "  ", "<password>", "${DB_PASS}", "changeme", "XXXX", "****", "[REDACTED-1]", "'secret'", "Your_Password"]
    no = ["<a>", "xx", "hunter2", "passwords", "x*x", "<pass word>"]
    df = spark.createDataFrame([(v,) for v in yes + no], "v string")
    assert [r.p for r in df.select(D.is_placeholder(F.col("v")).alias("p")).collect()] == [True] * len(yes) + [False] * len(no)


def test_sensitive_keys(spark):
    want = {"apiKey": True, "AWSSecretKey": True, "API_KEY": True, "keyboard": False, "public_key": False, "my-public-key": False, "db.password": True, "monkey": False, None: False}
    df = spark.createDataFrame([(k,) for k in want], "k string")
    assert {r.k: r.s for r in df.select("k", D.is_sensitive_key(F.col("k")).alias("s")).collect()} == want


def test_globs():
    hit = lambda expression, text: bool(globs.python(expression).search(text))
    dotted = [("a.*", "a.b", 1), ("a.*", "a.b.c", 0), ("a.**", "a", 1), ("a.**", "a.b.c", 1), ("**.k", "k", 1), ("**.k", "x.y.k", 1), ("**", "", 1), ("a?c", "abc", 1), ("a?c", "a.c", 0),
              ("a.**.z", "a.z", 1), ("a.**.z", "a.b.c.z", 1), ("a.**.z", "az", 0), ("**.**", "", 1), ("x**.y", "xa.y", 1), ("x**.y", "xy", 1), ("a.b**", "a.bc.d", 1), ("a+b", "a+b", 1), ("a+b", "aab", 0), ("***.x", "q.x", 1), ("a\nb", "a\nb", 1)]
    for g, text, ok in dotted:
        assert hit(globs.glob(g), text) == bool(ok), (g, text)
    for g, text, ok in [("github-*", "github-pat", 1), ("*", "a.b/c", 1), ("a?", "a.", 1), ("a*", "ba", 0)]:
        assert hit(globs.glob(g, None), text) == bool(ok), (g, text)
    for g, path, ok in [("*.env", "x/y/.env", 1), ("/a/", "a/b/c", 1), ("a/*.py", "b/a/x.py", 0), ("logs/", "x/logs/y", 1), ("a/**/b", "a/b", 1), ("a/**/b", "a/x/y/b", 1)]:
        assert hit(globs.file_glob(g), path) == bool(ok), (g, path)
    assert globs.normalize("/a/./b/../c//d") == "/a/c/d" and globs.normalize("../a/..") == ".."


def test_file_globs(spark, tmp_path):
    (tmp_path / "real").mkdir()
    (tmp_path / "real" / "x.pem").write_text("")
    (tmp_path / "link").symlink_to(tmp_path / "real")
    some = globs.FileGlobs.of(["*.env", "/real/", "!b.env"], str(tmp_path))
    assert some.matches("a.env") and some.matches("sub/a.env") and not some.matches("b.env") and some.matches("link/x.pem")
    assert some.matches(str(tmp_path / "x" / "a.env")) and not some.matches("/elsewhere/a.env") and not some.matches("../a.env")
    df = spark.createDataFrame([("a.env",), ("sub/b.env",), ("real/x",), (None,)], "p string")
    assert [r.m for r in df.select(some.column(F.col("p")).alias("m")).collect()] == [True, False, True, False]
    keys = globs.FileKeyPaths.of(["conf/*.json#a.b", "*.yml#**"], str(tmp_path))
    assert keys.for_file("conf/x.json") == ["a.b"] and keys.for_file("z/q.yml") == ["**"] and keys.for_file("other") == []
    with pytest.raises(ValueError, match="FILE#KEY"):
        globs.FileKeyPaths.of(["nothing"])


def test_patterns_to_java(spark):
    df = spark.createDataFrame([("éa.1@b.com x",)], "t string")
    assert df.select(F.regexp_extract("t", P.to_java(r"\b[a-z0-9.]+@b\.com"), 0)).first()[0] == "a.1@b.com"
    assert P.to_java("[[:alpha:]$]$").endswith(r"[A-Za-z$]\z")
    with pytest.raises(P.PatternError):
        P.to_java("(?U)a+")


def test_literals():
    assert find_literals("abcd", ["ab", "abcd"]) == [(0, 2)]
    assert find_literals("abcde", ["bcd", "abcde"]) == [(1, 4)]
    assert find_literals("é ab cab", ["ab", "cab"]) == [(3, 5), (6, 9)]


def test_value_detector_with_overlaps(spark):
    df = spark.createDataFrame([("abcd é ab",)], "t string")
    assert [tuple(s) for s in df.select(D.values(F.col("t"), ["ab", "abcd"])).first()[0]] == [(0, 2, "value"), (8, 10, "value")]


def test_merge(spark):
    df = spark.sql("SELECT array(named_struct('start',5,'end',9,'label','b'), named_struct('start',0,'end',3,'label','a'), named_struct('start',3,'end',4,'label','c'), named_struct('start',5,'end',12,'label','z')) AS s")
    assert [tuple(x) for x in df.select(S.merge(F.col("s"))).first()[0]] == [(0, 4, "a"), (5, 12, "z")]


CASES = [
    ("json", '{"a": "SECRET", // c\n \'b\': ["x", "SECRET"], k: 1, "t": "q\\u0041 SECRET",}', 3),
    ("jsonl", '{"a": "SECRET"}\r\nnot json SECRET\n\n{"b": ["SECRET"]}\n', 3),
    ("yaml", "a: x SECRET\nb:\n  - 'SECRET'\n  - \"y SECRET\"\nc: |\n  line SECRET\n  more\n", 4),
    ("toml", 't = "SECRET" # c\n[x."y z"]\nk = [\'SECRET\', """m\nSECRET"""]\ni = { q = "SECRET", n = 1 }\n', 4),
    ("xml", '<?xml version="1.0"?><r a="SECRET"><b>x &amp; SECRET</b><![CDATA[SECRET]]><dict><key>k</key><string>SECRET</string></dict></r>', 4),
    ("hcl", 'resource "a" "b" {\n  k = "SECRET"\n  i = "${var.x}"\n  h = <<EOT\nSECRET\nEOT\n  l = ["SECRET", "y"]\n}\n', 3),
    ("ini", "; c\n[s]\nk = SECRET\nq='SECRET'\nloose SECRET\n", 3),
    ("dotenv", "export A=SECRET\nB=\"SECRET\"\n# SECRET\n", 2),
    ("properties", "a=SECRET\nb : x\\\n   SECRET\n", 2),
    ("csv", 'n,v\r\n1,SECRET\r\n2,"a ""SECRET"""\r\n', 2),
    ("tsv", "n\tv\n1\tSECRET\n", 1),
    ("text", "free SECRET text", 1),
]


@pytest.mark.parametrize("name,body,n", CASES)
def test_formats(name, body, n):
    data = body.replace("SECRET", SECRET).encode()
    chosen, leaves, warning = formats.parse(data, name=name)
    assert warning is None and formats.rewrite(data, chosen, leaves, {}) == data
    edits = {}
    for i, x in enumerate(leaves):
        if (at := x.value.encode().find(SECRET.encode())) >= 0:
            edits[i] = [(at, at + len(SECRET), "[REDACTED-1]")]
    assert len(edits) == n
    out = formats.rewrite(data, chosen, leaves, edits)
    again = [x.value for x in formats.parse(out, name=name)[1]]
    want = [formats.edit(x.value, edits.get(i, [])) for i, x in enumerate(leaves)]
    assert [w.rstrip("\n") for w in want] == [a.rstrip("\n") for a in again]
    if name not in ("yaml", "properties"):
        assert out == body.replace("// SECRET", "//").replace("# SECRET", "# " + SECRET).replace("SECRET", "[REDACTED-1]").encode().replace(SECRET.encode(), SECRET.encode()) or name in ("dotenv", "json")


def test_format_choice():
    assert formats.choose(b"", "x/.env.local") == "dotenv" and formats.choose(b"", "a.TF") == "hcl" and formats.choose(b"", "Cargo.lock") == "toml"
    assert formats.choose(b'{"a": 1}') == "json" and formats.choose(b'{"a": 1}\n{"b": 2}') == "jsonl" and formats.choose(b"<?xml ?><a/>") == "xml" and formats.choose(b"hi") == "text"
    chosen, leaves, warning = formats.parse(b'{"a": ', "x.json")
    assert chosen == "text" and "plain text" in warning and leaves[0].value == '{"a": '
    with pytest.raises(formats.FormatError):
        formats.parse(b'{"a": ', name="json")
    data = b"\xff\xfe ok"
    assert formats.rewrite(data, *formats.parse(data)[:2], {0: [(3, 5, "T")]}) == b"\xff\xfe T"


def test_bplist():
    import plistlib

    data = plistlib.dumps({"k": "secret", "n": 3, "l": ["x"]}, fmt=plistlib.FMT_BINARY)
    chosen, leaves, _ = formats.parse(data)
    assert chosen == "bplist" and [x.path for x in leaves] == ["k", "l"]
    assert plistlib.loads(formats.rewrite(data, chosen, leaves, {0: [(0, 6, "T")]})) == {"k": "T", "n": 3, "l": ["x"]}


def test_documents(spark):
    env = {"env": {"DB_PASSWORD": "p4ss", "note": "p4ss", "REDIS_PASSWORD": "changeme"}, "db": {"password": "hunter2", "host": "h", "user": "u"}, "session_id": SECRET, "m": f"x {SECRET}", "again": "hunter2"}
    rows = [("1", "a.json", json.dumps(env).encode()), ("2", "b.txt", b"nothing here"), ("3", "c.csv", f"id,v\n7,{SECRET}\n".encode()), ("4", None, None)]
    docs = spark.createDataFrame(rows, "doc_id string, path string, content binary")
    rendered, found = documents.redact_documents(docs)
    out = {r.doc_id: bytes(r.content) for r in rendered.collect()}
    got = json.loads(out["1"])
    assert got["env"] == {"DB_PASSWORD": "[REDACTED-1]", "note": "[REDACTED-1]", "REDIS_PASSWORD": "changeme"}
    assert got["session_id"] == SECRET and got["m"] == "x [REDACTED-3]"
    assert got["db"]["password"] == got["again"] == "[REDACTED-2]"
    assert out["2"] == b"nothing here" and out["3"] == b"id,v\n7,[REDACTED-1]\n" and out["4"] == b""
    assert {(r.doc_id, r.id) for r in found.collect()} >= {("1", 1), ("3", 1)}


def test_search(spark):
    df = spark.createDataFrame([(1, f"one\ntwo {SECRET}\nthree\nfour"), (2, "none")], "doc_id long, text string")
    assert search.grep(df, SECRET).count() == 0
    assert [r.doc_id for r in search.without_match(df, SECRET).orderBy("doc_id").collect()] == [1, 2]
    assert [(r.line_no, r.line) for r in search.grep(df, "two", after=1).orderBy("line_no").collect()] == [(2, "two [REDACTED-1]"), (3, "three")]
    assert search.matcher(["a.b"], fixed=True, line=True) == r"(?du)\A(?:(?:a\.b))\z"
    assert re.search(search.matcher(["Foo", "bar"], ignore_case=True).replace("(?diu)", "(?i)"), "xBAR")


def test_search_by_redaction_alone(spark, tmp_path):
    """Lines that match only once redacted, and nulls, as the statements have them."""
    rows = [(1, "joe@x.com"), (2, "joe@x.com e\nann@bee.org"), (3, None), (4, ""), (5, "e\n"), (6, "key555-123-4567")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.n for r in catalogue.QUERIES["grep_invert"](spark, str(tmp_path)).collect()} == {1: 1, 2: 1, 4: 1}
    assert [r.doc_id for r in catalogue.QUERIES["grep_files_with"](spark, str(tmp_path)).collect()] == [6]
    assert {r.doc_id for r in catalogue.QUERIES["grep_files_without"](spark, str(tmp_path)).collect()} == {1, 2, 4, 5, 6}


def test_stream(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    spark.read.parquet(f"{sf_dir}/documents.parquet").write.parquet(f"{tmp_path}/in")
    stream = redact_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), catalogue.PII)
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.doc_id: r.redacted for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {r.doc_id: r.redacted for r in catalogue.redact_numbered(spark, sf_dir).collect()}
