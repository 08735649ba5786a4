"""Command line: redact, list, grep, scan, githook, agent, init, formats, detectors, config.

Exit codes: redact and list 0, with --check 1 where a secret is left; grep 0 found, 1 not; scan and githook 1 found,
0 clean; 2 for errors.
"""

from __future__ import annotations

import argparse
import json
import os
import shlex
import sys
from dataclasses import replace

from pyspark.sql import functions as F

from .api import exit_status
from .config import DETECTOR_NAMES, FILE_NAMES, Config, discover, load
from .functions.globs import FileGlobs
from .operators import scan, search
from .operators.documents import Allow
from .sources import files, formats, reports


class Usage(Exception):
    """Something about the call that is wrong."""


def shell_quote(text: str) -> str:
    return shlex.quote(text)


def display_path(path: str, base: str = ".") -> str:
    """The path as seen from base where it lies below it."""
    rest = os.path.relpath(path, base)
    return path if rest.startswith("..") else rest


def confirm(question: str, yes: bool = False) -> bool:
    """Ask on a terminal; without one nothing is confirmed."""
    if yes or not sys.stdin.isatty():
        return yes
    return input(f"{question} [y/N] ").strip().lower() in ("y", "yes")


def _spark():
    from pyspark.sql import SparkSession

    active = SparkSession.getActiveSession()
    if active:
        return active
    spark = SparkSession.builder.master(os.environ.get("MASTER", "local[*]")).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _config(args, start: str = ".") -> Config:
    out = load(start, args.config)
    if args.detector:
        out, unlisted = out.enable_detectors(args.detector)
        for name in unlisted:
            print(f"warning: the configuration lists no detector {name!r}", file=sys.stderr)
    if getattr(args, "comments", False):
        out = replace(out, comments=True)
    return out


def _redactor(config: Config):
    redactor, warnings = config.redactor()
    for w in warnings:
        print(f"warning: {w}", file=sys.stderr)
    return replace(redactor, options=replace(config.options()))


def _one(args):
    """(config, redactor, its redaction of the input)."""
    config = _config(args, os.path.dirname(args.file) or "." if args.file else ".")
    redactor = _redactor(config)
    data = sys.stdin.buffer.read() if args.file in (None, "-") else open(args.file, "rb").read()
    name = "text" if getattr(args, "raw", False) else args.format
    done = redactor.redact(_spark(), data, None if args.file == "-" else args.file, name)
    for w in done.warnings:
        print(f"warning: {w}", file=sys.stderr)
    return config, done


def _checked(args, findings) -> int:
    return int(bool(args.check and any(not f.allowed for f in findings)))


def cmd_redact(args) -> int:
    if args.in_place and args.file in (None, "-"):
        raise Usage("--in-place needs a file")
    config, done = _one(args)
    allow = Allow.all() if not config.allowed_files().is_empty and args.file and config.allowed_files().matches(os.path.abspath(args.file)) else config.allow_rules()
    out = done.render(allow)
    if args.in_place or args.output:
        spark = _spark()
        to = os.path.abspath(args.file if args.in_place else args.output)
        reports.write_files(spark.createDataFrame([("-", to, bytearray(out))], "doc_id string, path string, content binary")).collect()
    else:
        sys.stdout.buffer.write(out)
        sys.stdout.flush()
    return _checked(args, done.findings)


def cmd_list(args) -> int:
    _, done = _one(args)
    spark = _spark()
    rows = [(f.id, f.secret, f.detector, f.field, f.path, f.token, f.len, list(f.offsets), f.line, f.column, f.occurrences, f.allowed) for f in done.findings]
    from .operators.documents import FINDING

    table = spark.createDataFrame([("-", done.format, done.warnings[0] if done.warnings else None, rows)], f"doc_id string, format string, warning string, findings array<{FINDING}>")
    if args.json:
        print(reports.pretty(reports.finding_json(table, args.show_value).first().json))
    elif not done.findings:
        print("no redactions")
    else:
        cells = reports.finding_cells(table, args.show_value).orderBy("id").drop("doc_id", "id")
        print(reports.table([c.upper() if c != "allowed" else "" for c in cells.columns], cells.collect()))
    return _checked(args, done.findings)


def _walk_options(args, **more) -> files.WalkOptions:
    size = files.parse_size(args.max_filesize) if getattr(args, "max_filesize", None) else files.DEFAULT_MAX_SIZE
    return files.WalkOptions(tuple(args.glob or ()), not args.skip_hidden, args.skip_ignored, args.follow, args.max_depth, args.all_dirs, size, **more)


def _files(spark, root: str, options: files.WalkOptions):
    return files.read(files.within_size(files.walk(spark, root, replace(options, max_size=None)), 1 << 60))


def cmd_scan(args) -> int:
    spark, found = _spark(), False
    documents, lists, totals = [], [], {"scanned": 0, "skipped": 0, "protected_unread": 0, "errors": 0}
    hits = 0
    for root in args.path or ["."]:
        config = _config(args, root if os.path.isdir(root) else os.path.dirname(root) or ".")
        options = _walk_options(args)
        guard = replace(config.agent_policy().protected, base="")
        some = scan.splits(_files(spark, root, options), guard, args.unprotected, options.max_size).persist()
        docs = some.filter("fate = 'scan'").select(F.col("relative").alias("doc_id"), "path", "content")
        redactor = _redactor(config)
        report = files.in_order(scan.scanned(redactor.documents(docs), guard), "path").persist()
        if args.unprotected:
            report = report.filter("not protected")
        hits += report.count()
        found |= not report.limit(1).isEmpty()
        for k, v in scan.totals(some).first().asDict().items():
            totals[k] += v
        at = lambda p, root=root: p if root == "." or os.path.isfile(root) else os.path.join(root, p)
        if args.json:
            documents += [json.loads(r.json) | {"path": at(r.path)} for r in reports.scan_json(report, args.show_value).toLocalIterator()]
        elif args.files_with_matches:
            for r in report.select("path").toLocalIterator():
                print(at(r.path))
        else:
            cells = reports.scan_cells(report, args.show_value)
            lists += [[at(r[0]), *r[1:]] for r in cells.toLocalIterator()]
            header = [c.upper() if c != "protected" else "" for c in cells.columns]
        some.unpersist()
    if args.json:
        print(json.dumps({"files": documents, **totals}, indent=2, ensure_ascii=False))
    elif not args.files_with_matches:
        if lists:
            print(reports.table(header, lists))
        unread = f", {totals['protected_unread']} protected and not read" if args.unprotected else ""
        print(f"scanned {totals['scanned']} files: {hits} {'unprotected ' if args.unprotected else ''}with secrets, {totals['skipped']} skipped as binary or over --max-filesize{unread}", file=sys.stderr)
    return 2 if totals["errors"] and not found else int(found)


def cmd_grep(args) -> int:
    spark = _spark()
    patterns = list(args.regexp or [])
    paths = list(args.path)
    if not patterns:
        if not paths:
            raise Usage("a pattern is needed")
        patterns.append(paths.pop(0))
    pattern = search.matcher(patterns, args.fixed_strings, args.ignore_case, args.smart_case, args.word_regexp, args.line_regexp)
    found = False
    if not paths and not sys.stdin.isatty():
        paths = ["-"]
    for root in paths or ["."]:
        if root == "-":
            docs = files.standard_input(spark)
        else:
            kinds = files.file_types(args.type or ())
            options = _walk_options(args)
            docs = files.documents(spark, root, replace(options, globs=(*options.globs, *kinds)))
        config = _config(args, root if os.path.isdir(root) else os.path.dirname(root) or ".")
        texts = search.until_nul(docs.select("doc_id", "path", F.decode("content", "UTF-8").alias("text")))
        raw = F.exists(F.split("text", "\n", -1), lambda x: ~x.rlike(pattern) if args.invert_match else x.rlike(pattern))
        done = _redactor(config).documents(texts.filter(raw).select("doc_id", "path", F.encode("text", "UTF-8").alias("content")))
        clean = done.select("doc_id", F.decode("content", "UTF-8").alias("text"))
        rows = search.grep(clean, pattern, [], args.invert_match, args.max_count, args.context or args.before_context, args.context or args.after_context)
        ordered = rows.orderBy(F.split("doc_id", "/"), "line_no")
        many = root != "-" and os.path.isdir(root) and not args.no_filename
        if args.quiet:
            if not rows.filter("is_match").limit(1).isEmpty():
                return 0
        elif args.files_with_matches:
            for r in files.in_order(rows.filter("is_match").select("doc_id").distinct(), "doc_id").toLocalIterator():
                print(r.doc_id)
                found = True
        elif args.files_without_match:
            without = texts.select("doc_id").join(rows.filter("is_match").select("doc_id").distinct(), "doc_id", "left_anti")
            for r in files.in_order(without, "doc_id").toLocalIterator():
                print(r.doc_id)
                found = True
        elif args.count:
            for r in files.in_order(rows.filter("is_match").groupBy("doc_id").count(), "doc_id").toLocalIterator():
                print(f"{r.doc_id}:{r['count']}" if many else r["count"])
                found = True
        elif args.json:
            for r in search.json_lines(ordered).toLocalIterator():
                print(r.json)
                found = True
        elif args.only_matching:
            for r in search.only_matching(clean, pattern, []).orderBy(F.split("doc_id", "/"), "line_no", "nr").toLocalIterator():
                print(f"{r.doc_id}:{r.line_no}:{r.match}" if many else r.match)
                found = True
        else:
            before = None
            for r in ordered.toLocalIterator():
                if before and (args.context or args.before_context or args.after_context) and (before[0] != r.doc_id or before[1] + 1 != r.line_no):
                    print("--")
                mark = ":" if r.is_match else "-"
                print((f"{r.doc_id}{mark}" if many else "") + (f"{r.line_no}{mark}" if args.line_number else "") + r.line)
                before, found = (r.doc_id, r.line_no), True
    return int(not found)


def cmd_githook(args) -> int:
    spark = _spark()
    root = files._git(".", "rev-parse", "--show-toplevel").decode().strip()
    docs, added = files.staged(spark, root)
    redactor = _redactor(_config(args, root))
    found = redactor.documents(docs).select("doc_id", F.explode("findings").alias("f")).filter("not f.allowed")
    near = staged_findings(found, docs, added)
    rows = near.orderBy("doc_id", "line").collect()
    for r in rows:
        print(f"{r.doc_id}:{r.line}: {r.detector}", file=sys.stderr)
    return int(bool(rows))


def staged_findings(found, docs, added):
    """(doc_id, detector, line) of findings on added lines: the first such line of each.

    One that stands nowhere as it is counts where the added text holds its secret.
    """
    text = docs.select("doc_id", F.col("content").alias("raw"))
    places = found.join(text, "doc_id").select("doc_id", "f", "raw", F.explode_outer("f.offsets").alias("at"))
    lines = lambda: F.split(F.decode("raw", "UTF-8"), "\n", -1)
    line = F.when(F.col("at").isNotNull(), F.size(F.split(F.decode(F.substring("raw", F.lit(1), F.col("at").cast("int")), "UTF-8"), "\n", -1)))
    rows = places.select("doc_id", F.col("f.id").alias("id"), F.col("f.detector").alias("detector"), F.col("f.secret").alias("secret"), line.alias("line"), F.when(F.col("at").isNull(), F.col("raw")).alias("raw"))
    near = rows.join(added, "doc_id").filter(F.col("line").between(F.col("first"), F.col("last")) | (F.col("line").isNull() & F.contains(F.array_join(F.slice(lines(), F.col("first"), F.col("last") - F.col("first") + 1), "\n"), F.col("secret"))))
    return near.groupBy("doc_id", "id", "detector").agg(F.min(F.coalesce("line", "first")).alias("line")).select("doc_id", "detector", "line")


def cmd_agent(args) -> int:
    config = load(args.path or ".", args.config)
    policy = config.agent_policy()
    if args.action == "check":
        return int(any(policy.is_protected(os.path.abspath(p)) for p in args.files))
    spark = _spark()
    options = files.WalkOptions(max_depth=files.PROJECT_MAX_DEPTH, max_size=files.PROJECT_MAX_SIZE, max_files=files.PROJECT_MAX_FILES)
    some = files.walk(spark, args.path or ".", options)
    if config.agent is None:
        print("no agent section; these files look as if they held credentials:")
        for r in scan.candidates(some).orderBy("pattern").collect():
            print(f"  {r.pattern}: {r.n} ({', '.join(r.examples)})")
        return 0
    guarded = replace(policy.protected, base="")
    print(f"protected: {some.filter(guarded.column(F.col('relative'))).count()} files, {'enforced' if policy.enforce else 'not enforced'}")
    if not args.no_scan:
        report = scan.scanned(_redactor(config).documents(files.documents(spark, args.path or ".", options)), guarded).filter("not protected")
        for r in files.in_order(report, "path").limit(scan.LISTED_SECRETS).collect():
            print(f"  not protected: {r.path} ({', '.join(r.detectors)})")
    return 0


def cmd_init(args) -> int:
    to = os.path.join(args.path or ".", FILE_NAMES[0])
    if any(os.path.exists(os.path.join(args.path or ".", n)) for n in FILE_NAMES):
        raise Usage(f"{to} exists already")
    if not confirm(f"write {display_path(to)}?", args.yes):
        print("nothing written", file=sys.stderr)
        return 0
    with open(to, "w", encoding="utf-8") as f:
        f.write(Config.builtin_source())
    return 0


def cmd_config(args) -> int:
    path = discover(".", args.config)
    if args.action == "location":
        print(path or "built in")
    elif args.action == "show":
        sys.stdout.write(open(path, encoding="utf-8").read() if path else Config.builtin_source())
    else:
        errors, warnings = (Config.from_path(path) if path else Config.builtin()).validate()
        for kind, some in (("warning", warnings), ("error", errors)):
            for x in some:
                print(f"{kind}: {x}", file=sys.stderr)
        return 2 if errors else 0
    return 0


def cmd_formats(args) -> int:
    print("\n".join(formats.ALL_NAMES))
    return 0


def cmd_detectors(args) -> int:
    print("\n".join(DETECTOR_NAMES))
    return 0


def cmd_man(args) -> int:
    parser().print_help()
    for name, p in _commands(parser()).items():
        print(f"\n{name}\n{'-' * len(name)}")
        p.print_help()
    return 0


def _commands(p: argparse.ArgumentParser) -> dict[str, argparse.ArgumentParser]:
    return next(a for a in p._actions if isinstance(a, argparse._SubParsersAction)).choices


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="veilspark", description="Find and redact secrets and personal data.")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, run, help_: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=help_, add_help=True)
        p.set_defaults(run=run)
        p.add_argument("-c", "--config", metavar="FILE") if name != "grep" else p.add_argument("--config", metavar="FILE")
        p.add_argument("--detector", action="append", metavar="NAME", help="run a detector that the configuration leaves off")
        return p

    for name, run in (("redact", cmd_redact), ("list", cmd_list)):
        p = add(name, run, {"redact": "write the input with its secrets replaced", "list": "list what was found"}[name])
        p.add_argument("file", nargs="?")
        kind = p.add_mutually_exclusive_group()
        kind.add_argument("-f", "--format", choices=formats.ALL_NAMES)
        kind.add_argument("--raw", action="store_true", help="take the input as plain text")
        p.add_argument("--comments", action="store_true")
        p.add_argument("--check", action="store_true", help="exit 1 where a secret is found that isn't allowed")
        if name == "redact":
            to = p.add_mutually_exclusive_group()
            to.add_argument("-o", "--output", metavar="FILE")
            to.add_argument("-i", "--in-place", action="store_true")
        else:
            p.add_argument("--json", action="store_true")
            p.add_argument("--show-value", action="store_true")

    def walking(p: argparse.ArgumentParser) -> None:
        p.add_argument("-g", "--glob", action="append")
        p.add_argument("--skip-hidden", action="store_true")
        p.add_argument("--skip-ignored", action="store_true")
        p.add_argument("--all-dirs", action="store_true")
        p.add_argument("-L", "--follow", action="store_true")
        p.add_argument("-d", "--max-depth", type=int)
        p.add_argument("--max-filesize", metavar="SIZE")
        p.add_argument("--comments", action="store_true")
        p.add_argument("--json", action="store_true")

    p = add("scan", cmd_scan, "report files that hold secrets")
    p.add_argument("path", nargs="*")
    p.add_argument("--unprotected", action="store_true")
    p.add_argument("-l", "--files-with-matches", action="store_true")
    p.add_argument("--show-value", action="store_true")
    walking(p)
    p = add("grep", cmd_grep, "search redacted text")
    p.add_argument("path", nargs="*")
    p.add_argument("-e", "--regexp", action="append")
    for short, long in (("-F", "fixed-strings"), ("-i", "ignore-case"), ("-S", "smart-case"), ("-w", "word-regexp"), ("-x", "line-regexp"), ("-v", "invert-match"), ("-l", "files-with-matches"), ("-c", "count"), ("-q", "quiet"), ("-o", "only-matching"), ("-n", "line-number"), ("-I", "no-filename")):
        p.add_argument(short, f"--{long}", action="store_true")
    p.add_argument("--files-without-match", action="store_true")
    for short, long in (("-A", "after-context"), ("-B", "before-context"), ("-C", "context")):
        p.add_argument(short, f"--{long}", type=int, default=0)
    p.add_argument("-m", "--max-count", type=int)
    p.add_argument("-t", "--type", action="append")
    walking(p)
    add("githook", cmd_githook, "look for secrets in staged changes")
    p = add("agent", cmd_agent, "files that must only be read redacted")
    p.add_argument("action", choices=("status", "check"))
    p.add_argument("files", nargs="*")
    p.add_argument("--path")
    p.add_argument("--no-scan", action="store_true")
    p = add("init", cmd_init, "write a configuration to start from")
    p.add_argument("path", nargs="?")
    p.add_argument("-y", "--yes", action="store_true")
    p = add("config", cmd_config, "the configuration in use")
    p.add_argument("action", choices=("show", "location", "validate"))
    for name, run, help_ in (("formats", cmd_formats, "list the formats"), ("detectors", cmd_detectors, "list the detectors"), ("man", cmd_man, "all help texts")):
        add(name, run, help_)
    return top


def main(arguments: list[str] | None = None) -> int:
    args = parser().parse_args(arguments)
    try:
        return args.run(args)
    except (Usage, ValueError, RuntimeError, OSError) as x:
        print(f"error: {x}", file=sys.stderr)
        return 2


__all__ = ["FileGlobs", "exit_status", "main"]
