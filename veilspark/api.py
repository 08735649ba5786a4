"""The library's front: build a redactor, redact texts, documents and tables, and look at what was found."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import DetectorError, ReplacementError, UnknownFormatError
from .functions.tokens import Template
from .operators import redaction
from .operators.detection import Detector, _checked, resolve
from .operators.documents import Allow, Options, redact_all
from .sources import formats

DEFAULT = ("entropy", "ruleset", "provider_token", "credentialed_uri", "connection_string", "credential_assignment", "credential_key")


@dataclass(frozen=True)
class Finding:
    """A distinct secret of a document."""

    id: int
    secret: str
    detector: str
    field: str | None
    path: str
    token: str
    len: int
    offsets: tuple[int, ...]
    line: int | None
    column: int | None
    occurrences: int
    allowed: bool

    def offset(self) -> int | None:
        """Where it first stands, if it stands in the document as it is."""
        return self.offsets[0] if self.offsets else None

    def location(self) -> str:
        place = f"{self.line}:{self.column}" if self.line is not None else ""
        name = self.path or self.field
        return " ".join(x for x in (place, f"[{name}]" if name else "") if x)


@dataclass(frozen=True)
class Redaction:
    """One redacted document."""

    format: str
    findings: tuple[Finding, ...]
    warnings: tuple[str, ...]
    source: bytes
    _redactor: Redactor = field(repr=False)
    _hint: tuple[str | None, str | None] = field(repr=False)
    _spark: SparkSession = field(repr=False)

    def line_col(self, offset: int) -> tuple[int, int]:
        """1-based line and byte column of an offset."""
        return self.source.count(b"\n", 0, offset) + 1, offset - (self.source.rfind(b"\n", 0, offset) + 1) + 1

    def render(self, allow: Allow | None = None) -> bytes:
        """The document with its secrets replaced but for the allowed ones; numbers don't depend on what is allowed."""
        tester = (allow or Allow.none()).tester()
        if all(tester(f.secret) for f in self.findings):
            return self.source
        return self._redactor.with_allow(allow or Allow.none())._run(self._spark, self.source, *self._hint)["content"]


@dataclass(frozen=True)
class Redactor:
    """Detectors and options; immutable, and the same for tables, streams and single documents."""

    detectors: tuple[Detector, ...]
    options: Options = field(default_factory=Options)
    formats: tuple[str, ...] = formats.ALL_NAMES

    @staticmethod
    def builder() -> RedactorBuilder:
        """A builder with the detectors and formats of the built-in configuration."""
        return RedactorBuilder.defaults()

    @property
    def replacement(self) -> Template:
        return self.options.template

    def with_allow_paths(self, paths: Iterable[str]) -> Redactor:
        return replace(self, options=replace(self.options, allow_paths=(*self.options.allow_paths, *paths)))

    def with_allow(self, allow: Allow) -> Redactor:
        return replace(self, options=replace(self.options, allow=allow))

    def for_format(self, name: str | None) -> Redactor:
        if name is not None and name not in (*self.formats, "text"):
            raise UnknownFormatError(f"unknown format {name!r}; known are {', '.join(self.formats)}")
        return replace(self, options=replace(self.options, format=name))

    def table(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """df with `redacted`; each row's text is a document of its own. One stage, no shuffle; streams too."""
        o = self.options
        return redaction.redact(df, self.detectors, text_col, o.template, o.within, sorted(o.allow.values), o.allow.regexes)

    def documents(self, docs: DataFrame) -> DataFrame:
        """(doc_id, path, format, content, warning, findings) of (doc_id, path, content) documents."""
        return redact_all(docs, self.detectors, self.options)

    def redact_str(self, spark: SparkSession, text: str) -> str:
        return self.for_format("text")._run(spark, text.encode("utf-8", "surrogatepass"), None, "text")["content"].decode("utf-8", "replace")

    def redact(self, spark: SparkSession, data: bytes, path: str | None = None, name: str | None = None) -> Redaction:
        """One document; its format is the named one, or goes by its path and content."""
        row = self._run(spark, data, path, name)
        found = tuple(Finding(**{k: tuple(v) if k == "offsets" else v for k, v in f.asDict().items()}) for f in row["findings"])
        return Redaction(row["format"], found, (row["warning"],) if row["warning"] else (), data, self, (path, name), spark)

    def _run(self, spark: SparkSession, data: bytes, path: str | None, name: str | None) -> dict:
        own = self.for_format(name)
        docs = spark.createDataFrame([("1", path, bytearray(data))], "doc_id string, path string, content binary")
        try:
            row = own.documents(docs).first()
        except Exception as x:
            raise _plain(x) from None
        return row.asDict() | {"content": bytes(row.content)}


def _plain(x: Exception) -> Exception:
    """A worker's error without its trace, as one of the library's."""
    text = str(x)
    for kind, made in (("FormatError", formats.FormatError), ("DetectorError", DetectorError)):
        if f"{kind}: " in text:
            return made(text.split(f"{kind}: ", 1)[1].split("\n", 1)[0])
    return x


@dataclass(frozen=True)
class RedactorBuilder:
    """Step by step; each call gives a new builder. An empty one has no detectors."""

    _detectors: tuple[Detector, ...] = ()
    _options: Options = field(default_factory=Options)
    _formats: tuple[str, ...] = ()

    @classmethod
    def defaults(cls) -> RedactorBuilder:
        return cls(tuple(resolve(DEFAULT)), Options(), formats.ALL_NAMES)

    def _with(self, **options) -> RedactorBuilder:
        return replace(self, _options=replace(self._options, **options))

    def detector(self, *items: str | Detector) -> RedactorBuilder:
        return replace(self, _detectors=(*self._detectors, *resolve(items)))

    def format(self, fmt: str | formats.Format) -> RedactorBuilder:
        """A format by name, or a new one, which is then known everywhere; a later one of a name goes last."""
        if isinstance(fmt, formats.Format):
            formats.register(fmt)
            fmt = fmt.name
        if fmt not in formats.FORMATS:
            raise UnknownFormatError(f"unknown format {fmt!r}")
        return replace(self, _formats=(*(f for f in self._formats if f != fmt), fmt))

    def policy(self, policy: formats.Policy) -> RedactorBuilder:
        return self._with(policy=policy)

    def comments(self, on: bool = True) -> RedactorBuilder:
        return self._with(comments=on)

    def allow_paths(self, globs: Iterable[str]) -> RedactorBuilder:
        return self._with(allow_paths=(*self._options.allow_paths, *globs))

    def allow_within(self, patterns: Iterable[str]) -> RedactorBuilder:
        return self._with(within=(*self._options.within, *_checked(patterns)))

    def allow(self, allow: Allow) -> RedactorBuilder:
        return self._with(allow=allow)

    def replacement(self, template: str | Template) -> RedactorBuilder:
        try:
            return self._with(template=template if isinstance(template, Template) else Template.parse(template))
        except (ValueError, IndexError) as x:
            raise ReplacementError(str(x) or "replacement: it is empty") from None

    def build(self) -> Redactor:
        known = self._formats or ("text",)
        return Redactor(self._detectors, replace(self._options, formats=known), known)


def document_detector(name: str, find) -> Detector:
    """A detector over whole documents: find(list of leaves) gives a list of spans for each. An error fails the document."""

    def guarded(leaves):
        try:
            out = find(leaves)
        except Exception as x:
            raise DetectorError(f"{name}: {x}") from x
        if len(out) != len(leaves):
            raise DetectorError(f"{name}: {len(out)} lists of spans for {len(leaves)} values")
        return out

    return Detector(name, document=guarded)


def exit_status(findings: DataFrame) -> bool:
    """Whether any finding is left that isn't allowed; stops at the first."""
    return not findings.filter(~F.col("allowed")).limit(1).isEmpty()
