"""Files as tables: directory walks with ignore files, size and binary filters, staged changes, standard input.

A walk lists directories on the executors, one round per level, and gives (path, relative, size). Contents are read by
the tasks that need them, so a tree is never listed or read by the driver alone. All paths must be visible to the
executors.
"""

from __future__ import annotations

import json
import os
import re
import subprocess
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.globs import any_of, file_glob, python

#: Directories that a walk passes by unless asked for, and one that it always does.
SKIPPED_DIRS = ("node_modules", "target", "dist", "build", "vendor", "venv", ".venv", "__pycache__")
ALWAYS_SKIPPED = (".git",)
IGNORE_FILES = (".gitignore", ".ignore")
#: Sizes, and limits of a walk over a whole project.
DEFAULT_MAX_SIZE = 10 << 20
PROJECT_MAX_SIZE, PROJECT_MAX_FILES, PROJECT_MAX_DEPTH = 1 << 20, 50_000, 8
BINARY_PROBE = 8192


def parse_size(text: str) -> int:
    """Bytes of `10M`, `64k`, `1G` or a plain number; units are powers of 1024."""
    m = re.fullmatch(r"(\d+)\s*([KkMmGg]?)[Bb]?", text.strip())
    if not m:
        raise ValueError(f"{text!r} is not a size; write a number with K, M or G")
    return int(m[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[m[2].lower()]


@dataclass(frozen=True)
class WalkOptions:
    globs: tuple[str, ...] = ()  # `!glob` leaves out; with others, only files that one of them names
    hidden: bool = True
    ignore_files: bool = True
    follow: bool = False
    max_depth: int | None = None
    all_dirs: bool = False
    max_size: int | None = DEFAULT_MAX_SIZE
    max_files: int | None = None


def _ignore_rules(folder: str, at: str) -> list[tuple[str, bool, bool]]:
    """(expression over paths from the root of the walk, negated, directories only) of a folder's ignore files."""
    out = []
    for name in IGNORE_FILES:
        try:
            with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                lines = f.read().splitlines()
        except OSError:
            continue
        for line in lines:
            line = line.rstrip()
            if not line or line[0] == "#":
                continue
            negated = line[0] == "!"
            body = line[1:] if negated else line
            only_dirs = body.endswith("/")
            body = body.rstrip("/")
            inner = file_glob(body)
            head = re.escape(at + "/") if at else ""
            out.append((inner.replace(r"\A(?s:", rf"\A(?s:{head}", 1), negated, only_dirs))
    return out


def _ignored(rules: list, path: str, is_dir: bool) -> bool:
    """The last rule that a path fits decides."""
    for expression, negated, only_dirs in reversed(rules):
        if (is_dir or not only_dirs) and python(expression).search(path):
            return not negated
    return False


def _list(root: str, at: str, depth: int, rules: list, options: WalkOptions) -> Iterator[tuple[str, str, int | None, bool, int, list]]:
    """(path, relative path, size, is directory, depth, rules) of a folder's entries that the walk takes."""
    folder = os.path.join(root, at) if at else root
    if options.ignore_files:
        rules = [*rules, *_ignore_rules(folder, at)]
    wanted = [g for g in options.globs if not g.startswith("!")]
    yes, no = any_of(map(file_glob, wanted)), any_of(file_glob(g[1:]) for g in options.globs if g.startswith("!"))
    try:
        entries = sorted(os.scandir(folder), key=lambda e: os.fsencode(e.name))
    except OSError:
        return
    for e in entries:
        relative = f"{at}/{e.name}" if at else e.name
        try:
            is_dir, is_file = e.is_dir(follow_symlinks=options.follow), e.is_file(follow_symlinks=options.follow)
            size = e.stat(follow_symlinks=options.follow).st_size if is_file else None
        except OSError:
            continue
        if not (is_dir or is_file) or e.name in ALWAYS_SKIPPED and is_dir or (not options.hidden and e.name.startswith(".")):
            continue
        if is_dir and (e.name in SKIPPED_DIRS and not options.all_dirs or options.max_depth is not None and depth >= options.max_depth):
            continue
        if options.ignore_files and _ignored(rules, relative, is_dir) or no and python(no).search(relative):
            continue
        if is_file and yes and not python(yes).search(relative):
            continue
        yield os.path.join(folder, e.name), relative, size, is_dir, depth, rules


def walk(spark: SparkSession, root: str, options: WalkOptions | None = None) -> DataFrame:
    """(path, relative, size) of the files below root, or of root itself where it is a file.

    Each task walks one of the folders that lie just below root, depth first.
    """
    options = options or WalkOptions()
    root = os.path.abspath(root)
    schema = "path string, relative string, size long"
    if os.path.isfile(root):
        return spark.createDataFrame([(root, os.path.basename(root), os.path.getsize(root))], schema)
    if not os.path.isdir(root):
        raise FileNotFoundError(f"{root}: no such file or directory")
    top = list(_list(root, "", 1, [], options))
    files = spark.createDataFrame([(p, r, s) for p, r, s, is_dir, _, _ in top if not is_dir], schema)
    folders = [(r, d, json.dumps(rules)) for _, r, _, is_dir, d, rules in top if is_dir]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, depth, rules in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                stack, found = [(at, depth, json.loads(rules))], []
                seen = {os.path.realpath(root)}
                while stack:
                    here, level, known = stack.pop()
                    if options.follow:
                        real = os.path.realpath(os.path.join(root, here))
                        if real in seen:  # a link back to where the walk has been
                            continue
                        seen.add(real)
                    inner = []
                    for path, relative, size, is_dir, _, more in _list(root, here, level + 1, known, options):
                        if is_dir:
                            inner.append((relative, level + 1, more))
                        else:
                            found.append((path, relative, size))
                    stack += reversed(inner)
                    if len(found) > 5000:
                        yield _entries(found)
                        found = []
                if found:
                    yield _entries(found)

    if folders:
        below = spark.createDataFrame(folders, "at string, depth int, rules string").repartition(max(1, min(len(folders), 200)), "at").mapInArrow(run, schema)
        files = files.unionByName(below)
    return limited(files, options)


def _entries(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], ["path", "relative", "size"])


def limited(files: DataFrame, options: WalkOptions) -> DataFrame:
    """Only as many files as the options ask for, the first in the order of a walk."""
    return in_order(files).limit(options.max_files) if options.max_files is not None else files


def in_order(files: DataFrame, path_col: str = "relative") -> DataFrame:
    """Sorted as a walk goes: by the bytes of each name along the path."""
    return files.orderBy(F.split(path_col, "/"))


def within_size(files: DataFrame, most: int = DEFAULT_MAX_SIZE, size_col: str = "size") -> DataFrame:
    """Files of at most that many bytes; where the size is a file source's own column, the filter reaches the listing."""
    return files.filter(F.col(size_col) <= most)


def is_binary(content: str | Column) -> Column:
    """Whether there is a NUL among the first bytes of a binary or text column."""
    raw = F.col(content) if isinstance(content, str) else content
    return F.coalesce(F.position(F.lit(b"\x00"), F.substring(raw.cast("binary"), F.lit(1), F.lit(BINARY_PROBE))) > 0, F.lit(False))


def text_only(files: DataFrame, content_col: str = "content") -> DataFrame:
    """Files that aren't binary."""
    return files.filter(~is_binary(content_col))


def read(files: DataFrame) -> DataFrame:
    """files with `content`; null, and `error` set, where a file can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("path")
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                data, error = None, None
                try:
                    with open(one.column(at)[0].as_py(), "rb") as f:
                        data = f.read()
                except OSError as x:
                    error = x.strerror or "cannot be read"
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([data], pa.binary()), pa.array([error], pa.string())], [*batch.schema.names, "content", "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields) + ", content binary, error string"
    return files.mapInArrow(run, schema)


def documents(spark: SparkSession, root: str, options: WalkOptions | None = None) -> DataFrame:
    """(doc_id, path, content, error) of a walk's files, within its size limit and not binary; doc_id is the path from root."""
    options = options or WalkOptions()
    files = walk(spark, root, options)
    if options.max_size is not None:
        files = within_size(files, options.max_size)
    some = read(files).filter(F.col("error").isNotNull() | ~is_binary("content"))
    return some.select(F.col("relative").alias("doc_id"), "path", "content", "error")


#: Input bytes for which a task is worth its start where rows are dear, and the most that one takes.
LEAST_DEALT, MOST_DEALT = 8 << 10, 1 << 20


def dealt(rows: DataFrame) -> DataFrame:
    """Narrow rows dealt evenly over tasks, for work that costs far more than to read them.

    A file is cut into tasks by its bytes and row groups, so a small one with much work for each row runs in one task.
    """
    size = float(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = int(max(min(size / LEAST_DEALT, most), size / MOST_DEALT))
    return rows.repartition(tasks) if tasks > 1 else rows


def standard_input(spark: SparkSession, data: bytes | None = None) -> DataFrame:
    """One document from the given bytes, or all of standard input."""
    body = sys.stdin.buffer.read() if data is None else data
    return spark.createDataFrame([("-", None, bytearray(body))], "doc_id string, path string, content binary")


def _git(repository: str, *arguments: str) -> bytes:
    done = subprocess.run(["git", "-C", repository, *arguments], capture_output=True, check=False)
    if done.returncode:
        raise RuntimeError(f"git {arguments[0]}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout


def staged(spark: SparkSession, repository: str = ".", max_size: int = DEFAULT_MAX_SIZE) -> tuple[DataFrame, DataFrame]:
    """(documents, added): what is staged for the next commit, and the line ranges (doc_id, first, last) it adds.

    Regular files only; deleted ones are left out, and so are those over max_size.
    """
    raw = _git(repository, "diff", "--cached", "--raw", "-z", "--no-renames", "--diff-filter=d", "--abbrev=64").split(b"\0")
    rows, ranges = [], []
    for head, name in zip(raw[::2], raw[1::2], strict=False):
        _, mode, _, blob, *_ = head.decode().split(" ")
        if not mode.startswith("100"):
            continue
        path = name.decode("utf-8", "surrogateescape")
        if int(_git(repository, "cat-file", "-s", blob)) > max_size:
            continue
        rows.append((path, path, bytearray(_git(repository, "cat-file", "blob", blob))))
        ranges += [(path, a, b) for a, b in added_lines(_git(repository, "diff", "--cached", "--unified=0", "--no-color", "--no-ext-diff", "--no-renames", "--", path).decode("utf-8", "replace"))]
    return spark.createDataFrame(rows, "doc_id string, path string, content binary"), spark.createDataFrame(ranges, "doc_id string, first int, last int")


def added_lines(diff: str) -> list[tuple[int, int]]:
    """First and last line of each stretch that a diff without context adds."""
    out = []
    for m in re.finditer(r"^@@ -\S+ \+(\d+)(?:,(\d+))? @@", diff, re.M):
        first, n = int(m[1]), int(m[2] or 1)
        if n:
            out.append((first, first + n - 1))
    return out


def nearest(paths: DataFrame, configs: DataFrame) -> DataFrame:
    """(path, config) with the config of the nearest folder at or above each path's own; configs: (folder, config).

    An equi-join on the folders above, listed once per distinct folder; null where none lies above.
    """
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    files = paths.withColumn("__folder", folder)
    parts = F.split("__folder", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("folder")))
    dirs = files.select("__folder").distinct().select("__folder", F.explode(above).alias("a")).select("__folder", "a.depth", "a.folder")
    best = dirs.join(configs.select("folder", "config"), "folder").groupBy("__folder").agg(F.max_by("config", "depth").alias("config"))
    return files.join(best, "__folder", "left").drop("__folder")


def file_types(names: Iterable[str]) -> list[str]:
    """Globs of named kinds of files."""
    out = []
    for n in names:
        if n not in TYPES:
            raise ValueError(f"unknown file type {n!r}; known are {', '.join(sorted(TYPES))}")
        out += TYPES[n]
    return out


#: Kinds of files for searches, by this library's choice.
TYPES = {
    "py": ["*.py", "*.pyi"], "rust": ["*.rs"], "js": ["*.js", "*.jsx", "*.mjs", "*.cjs"], "ts": ["*.ts", "*.tsx"], "java": ["*.java"], "go": ["*.go"], "c": ["*.c", "*.h"], "cpp": ["*.cpp", "*.hpp", "*.cc", "*.hh"],
    "sh": ["*.sh", "*.bash"], "json": ["*.json", "*.jsonl"], "yaml": ["*.yml", "*.yaml"], "toml": ["*.toml"], "md": ["*.md"], "txt": ["*.txt"], "xml": ["*.xml"], "html": ["*.html", "*.htm"], "css": ["*.css"], "sql": ["*.sql"], "log": ["*.log"], "env": [".env", ".env.*", "*.env"],
}
