"""Rule sets: load and check rule files, and find their secrets in values.

One pass of an automaton over a value gives the rules whose keyword it holds; the patterns without keywords are tried
on every value. Matches are trimmed, filtered, and held to their components; of equal secrets the first rule in file
order reports, and every occurrence of a secret in the value is a span. Values are matched as bytes.
"""

from __future__ import annotations

import re
import tomllib
from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from pathlib import Path

from ..functions.globs import glob, python
from ..functions.patterns import MASKS, PLACEHOLDERS, to_python
from ..functions.tokens import Template
from ..operators.detection import Detector, Leaf
from . import filters, windows
from .errors import RuleError

#: Marks of lines that are meant to hold a secret.
ALLOW_SIGNATURES = ("betterleaks:allow", "gitleaks:allow")
_FIELDS = {"id": str, "regex": str, "path": str, "secretGroup": int, "keywords": list, "filter": str, "entropy": (int, float), "tokenEfficiency": bool, "skipReport": bool, "components": list, "required": list}


@dataclass(frozen=True)
class Component:
    rule: str
    window: windows.Window
    optional: bool = False


@dataclass
class Rule:
    """A rule; without a pattern it finds nothing (rules that are tied to file paths)."""

    id: str
    pattern: object = None
    group: int = 0
    keywords: tuple[str, ...] = ()
    silent: bool = False
    components: tuple[Component, ...] = ()
    filter: object = None


@dataclass(frozen=True)
class Match:
    secret: bytes
    start: int
    end: int
    line: int
    last_line: int
    column: int


@dataclass(frozen=True)
class Placeholder:
    """The test of functions.detectors.is_placeholder for one value in Python."""

    words: tuple[str, ...] = PLACEHOLDERS
    masks: str = MASKS
    mask_min: int = 3
    bracket_min: int = 5
    template: Template = field(default_factory=Template.parse)

    @cached_property
    def _whole(self) -> re.Pattern:
        masks = "|".join(rf"{re.escape(c)}{{{self.mask_min},}}" for c in self.masks)
        return re.compile(rf"(?s)\$\{{.*\}}|{masks}")

    def __call__(self, value: str) -> bool:
        bare = value.strip().strip("\"'")
        low = bare.lower()
        return not bare or low in self.words or (len(bare) >= self.bracket_min and bool(re.fullmatch("<[a-z0-9_-]+>", bare))) or self.template.is_token(bare) or bool(self._whole.fullmatch(low))


def compile_pattern(pattern: str):
    """A pattern over bytes, where letters and digits are ASCII; one that needs Unicode classes is one over text."""
    import regex

    ours = to_python(pattern)
    if re.search(r"\\[pP]", ours):
        return regex.compile(ours, regex.V1)
    return regex.compile(ours.encode(), regex.V1)


def read(source: str) -> dict:
    """A rule file's tables, with the types of what this library uses checked; other fields are passed over."""
    try:
        raw = tomllib.loads(source)
    except tomllib.TOMLDecodeError as x:
        raise RuleError(f"not TOML: {x}") from None
    for n, rule in enumerate(raw.get("rules", []), 1):
        name = f"rule {rule['id']!r}" if isinstance(rule.get("id"), str) else f"rule {n}"
        if "id" not in rule:
            raise RuleError(f"{name}: id is missing")
        for k, kind in _FIELDS.items():
            if k in rule and (not isinstance(rule[k], kind) or kind is int and isinstance(rule[k], bool)):
                raise RuleError(f"{name}: {k} has the wrong type")
    return raw


def merged(files: list[dict]) -> dict:
    """Several files as one: a later rule takes the place of an earlier one of its id, at the end; filters add up."""
    rules: dict[str, dict] = {}
    for f in files:
        mine = f.get("rules", [])
        for r in mine:
            rules.pop(r["id"], None)
        rules |= {r["id"]: r for r in mine}
    some = [f["filter"] for f in files if f.get("filter", "").strip()]
    return {"rules": list(rules.values()), "filter": _either(some)}


def _either(parts: list[str]) -> str:
    return parts[0] if len(parts) == 1 else " || ".join(f"({p})" for p in parts)


def _needs(raw: dict) -> list[tuple[str, str, bool]]:
    """(rule, distance, optional) of components in both spellings."""
    new = [(c["id"], c.get("within", ""), bool(c.get("optional", False))) for c in raw.get("components", [])]
    size = lambda r: ",".join(f"{r[k]}{unit}" for k, unit in (("withinLines", "L"), ("withinColumns", "C")) if k in r)
    return new + [(r["id"], size(r), False) for r in raw.get("required", [])]


def _rule(raw: dict, known: set[str]) -> Rule:
    if "regex" not in raw or "path" in raw:
        return Rule(raw["id"], silent=True)
    try:
        pattern = compile_pattern(raw["regex"])
    except Exception as x:
        raise RuleError(f"invalid pattern: {getattr(x, 'msg', 'it cannot be compiled')}") from None
    group = raw.get("secretGroup", 0)
    if not 0 <= group <= pattern.groups:
        raise RuleError(f"secretGroup {group} exceeds the number of capture groups")
    needs = _needs(raw)
    if missing := [i for i, _, _ in needs if i not in known]:
        raise RuleError(f"unknown component rule {missing[0]!r}")
    tests = [f'entropy(finding["secret"]) <= {float(raw["entropy"])!r}'] if raw.get("entropy") else []
    tests += ['failsTokenEfficiency(finding["secret"])'] if raw.get("tokenEfficiency") else []
    tests += [raw["filter"]] if raw.get("filter", "").strip() else []
    return Rule(
        raw["id"], pattern, group, tuple(k.lower() for k in raw.get("keywords", [])), raw.get("skipReport", False),
        tuple(Component(i, windows.parse(w), optional) for i, w, optional in needs), filters.parse(_either(tests)) if tests else None,
    )


class _Lines:
    """Line numbers of a value's bytes."""

    def __init__(self, data: bytes):
        self.size = len(data)
        self.starts = [0, *(m.end() for m in re.finditer(b"\n", data))]

    def of(self, at: int) -> int:
        return bisect_right(self.starts, at) - 1

    def span(self, start: int, end: int) -> tuple[int, int]:
        """From the start of the first line a stretch touches to the end of its last."""
        last = self.of(max(end - 1, start))
        return self.starts[self.of(start)], self.starts[last + 1] - 1 if last + 1 < len(self.starts) else self.size


class Ruleset:
    """Rules in file order, ready to search values."""

    def __init__(self, sources: Iterable[str], allow_signatures: Iterable[str] = ALLOW_SIGNATURES, exclude_rules: Iterable[str] = (), placeholder: Placeholder | None = None, functions: filters.Functions | None = None):
        files = []
        for s in sources:
            raw = read(s)
            if raw.get("extend", {}).get("useDefault"):
                files.append(read(starter_source()))
            files.append(raw)
        whole = merged(files)
        known = {r["id"] for r in whole["rules"]}
        self.rules: list[Rule] = []
        for raw in whole["rules"]:
            try:
                self.rules.append(_rule(raw, known))
            except RuleError as x:
                raise RuleError(f"rule {raw['id']!r}: {x}") from None
        try:
            self.filter = filters.parse(whole["filter"]) if whole["filter"] else None
        except RuleError as x:
            raise RuleError(f"global filter: {x}") from None
        self.by_id = {r.id: r for r in self.rules}
        self.signatures = [s.encode() for s in allow_signatures]
        excluded = [python(glob(g, None)) for g in exclude_rules]
        self.reporting = [r for r in self.rules if not r.silent and not any(x.search(r.id) for x in excluded)]
        self.placeholder = placeholder or Placeholder()
        self.functions = functions or filters.Functions()
        self._automaton = self._by_keyword()

    @property
    def rule_ids(self) -> list[str]:
        return [r.id for r in self.rules]

    def _by_keyword(self):
        import ahocorasick

        rules: dict[str, list[int]] = {}
        for n, r in enumerate(self.reporting):
            for k in r.keywords:
                rules.setdefault(k, []).append(n)
        rules.pop("", None)
        if not rules:
            return None
        machine = ahocorasick.Automaton()
        for k, numbers in rules.items():
            machine.add_word(k, tuple(numbers))
        machine.make_automaton()
        return machine

    def candidates(self, value: str) -> list[Rule]:
        """Rules to try on a value, in file order: those without keywords, and those with one that it holds."""
        hit = {n for n, r in enumerate(self.reporting) if not r.keywords or "" in r.keywords}
        if self._automaton is not None:
            low = value.translate(_ASCII_LOWER)
            for _, numbers in self._automaton.iter(low):
                hit.update(numbers)
        return [self.reporting[n] for n in sorted(hit)]

    def find(self, value: str) -> list[tuple[int, int, str]]:
        """(start, end, label) of every occurrence of every secret in a value, in bytes."""
        data = value.encode("utf-8", "surrogateescape")
        lines: _Lines | None = None
        secrets: dict[bytes, str] = {}
        for rule in self.candidates(value) if value else ():
            lines = lines or _Lines(data)
            for m in self.matches(rule, value, data, lines):
                secrets.setdefault(m.secret, rule.id)
        out = []
        for secret, rule_id in secrets.items():
            try:
                text = secret.decode()
            except UnicodeDecodeError:
                continue
            if not text or self.placeholder(text):
                continue
            at = data.find(secret)
            while at >= 0:
                out.append((at, at + len(secret), f"ruleset:{rule_id}"))
                at = data.find(secret, at + len(secret))
        return out

    def matches(self, rule: Rule, value: str, data: bytes, lines: _Lines) -> list[Match]:
        """Matches of a rule whose components are near."""
        own = self._own(rule, value, data, lines)
        if not own or not rule.components:
            return own
        needed = [(c.window, self._own(self.by_id[c.rule], value, data, lines)) for c in rule.components if not c.optional]
        return [m for m in own if all(any(w.holds(m, x, len(data)) for x in found) for w, found in needed)]

    def _own(self, rule: Rule, value: str, data: bytes, lines: _Lines) -> list[Match]:
        if rule.pattern is None:
            return []
        as_bytes = isinstance(rule.pattern.pattern, bytes)
        found = (m for m in rule.pattern.finditer(data if as_bytes else value))
        return [x for m in found if (x := self._match(rule, m, value, data, lines, as_bytes))]

    def _match(self, rule: Rule, m, value: str, data: bytes, lines: _Lines, as_bytes: bool) -> Match | None:
        raw = (lambda x: x) if as_bytes else (lambda x: x.encode("utf-8", "surrogateescape"))
        matched = raw(m[0]).strip(b"\n")
        if not matched:
            return None
        start = m.start() if as_bytes else len(raw(value[: m.start()]))
        end = start + len(matched)
        a, b = lines.span(start, end)
        line = data[a:b]
        if any(s in line for s in self.signatures):
            return None
        groups = [raw(g) for g in m.groups() if g]
        secret = raw(m[rule.group] or m[0][:0]) if rule.group else groups[0] if groups else matched
        if (self.filter or rule.filter) and self._filtered(rule, m, value, data, (start, end, start + len(raw(m[0]))), matched, secret, line, raw):
            return None
        first = lines.of(start)
        return Match(secret, start, end, first, lines.of(max(end - 1, start)), start - lines.starts[first])

    def _filtered(self, rule: Rule, m, value: str, data: bytes, at: tuple[int, int, int], matched: bytes, secret: bytes, line: bytes, raw) -> bool:
        text = lambda x: x.decode("utf-8", "replace")
        start, _, whole = at
        ends = [i for i in (data.find(b"\n", whole), data.find(b"\r", whole)) if i >= 0]
        finding = {
            "secret": text(secret), "match": text(matched), "line": text(line), "rule_id": rule.id, "description": "", "context": "", "entropy": str(filters.byte_entropy(secret)),
            "captures": {k: text(raw(v)) for k, v in m.groupdict().items() if v}, "fragment_raw": value, "match_start_idx": start, "match_end_idx": whole,
            "match_line_start_idx": max(data.rfind(b"\n", 0, start), data.rfind(b"\r", 0, start)) + 1, "match_line_end_idx": min(ends, default=len(data)),
        }
        scope = {"finding": finding, "attributes": {}}
        return any(filters.discards(f, scope, self.functions) for f in (self.filter, rule.filter) if f)


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


@lru_cache(maxsize=1)
def starter_source() -> str:
    return (Path(__file__).parent / "starter.toml").read_text("utf-8")


def token_counter(ranks_path: str, pattern: str):
    """Counts tokens by a file of byte-pair ranks (base64 and number a line)."""
    import base64

    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("rules", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(coder.encode_ordinary(text))


@dataclass(frozen=True)
class RulesetOptions:
    """What a rule set is made of; small and picklable, so that each worker makes its own once."""

    sources: tuple[str, ...]
    allow_signatures: tuple[str, ...] = ALLOW_SIGNATURES
    exclude_rules: tuple[str, ...] = ()
    placeholder: Placeholder = field(default_factory=Placeholder)
    ranks_path: str | None = None
    token_pattern: str = ""
    words: frozenset[str] = frozenset()


@lru_cache(maxsize=8)
def made(options: RulesetOptions) -> Ruleset:
    counter = token_counter(options.ranks_path, options.token_pattern) if options.ranks_path else None
    return Ruleset(options.sources, options.allow_signatures, options.exclude_rules, options.placeholder, filters.Functions(counter, options.words))


def ruleset(sources: Iterable[str], **options) -> Detector:
    """A detector of rule files, given as their texts. They are loaded here as well, so a bad one fails at once."""
    given = RulesetOptions(tuple(sources), **{k: tuple(v) if isinstance(v, list) else v for k, v in options.items()})
    made(given)
    return Detector("ruleset", python=lambda leaf: made(given).find(leaf.value))


def candidate_rules(df, sources: Iterable[str], id_col: str = "doc_id", text_col: str = "text"):
    """(doc_id, rule) of the rules that each text would be tried on, before any pattern runs."""
    from collections.abc import Iterator

    import pyarrow as pa
    from pyspark.sql import functions as F

    given = RulesetOptions(tuple(sources))
    made(given)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = made(given)
        for batch in batches:
            rows = [(i, r.id) for i, t in zip(batch.column(0), batch.column(1).to_pylist(), strict=True) if t for r in own.candidates(t)]
            yield pa.RecordBatch.from_arrays([pa.array([i.as_py() for i, _ in rows], batch.schema.field(0).type), pa.array([r for _, r in rows], pa.string())], ["doc_id", "rule"])

    some = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return some.mapInArrow(run, f"doc_id {some.schema[0].dataType.simpleString()}, rule string")


def from_paths(paths: Iterable[str], **options) -> Detector:
    return ruleset([Path(p).read_text("utf-8") for p in paths], **options)


def starter() -> Detector:
    """The rules that this library brings along."""
    return ruleset([starter_source()])


__all__ = ["Leaf", "RuleError", "Ruleset", "RulesetOptions", "from_paths", "made", "ruleset", "starter"]
