"""Configuration files: strict YAML that replaces the built-in settings as a whole.

The sections that decide what is scanned must be there, since leaving one out would weaken redaction without a word.
Relative paths in a file are taken from the file's own folder.
"""

from __future__ import annotations

import os
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import lru_cache
from pathlib import Path

from .errors import ConfigError, PatternError, RuleError
from .functions import classify
from .functions.globs import FileGlobs, FileKeyPaths
from .functions.tokens import Template
from .operators import detection
from .operators.detection import Detector, Placeholders
from .operators.documents import Allow, Options
from .rules import engine
from .sources import formats

ENV = "VEILSPARK_CONFIG"
FILE_NAMES = ("veilspark.yml", "VEILSPARK.yml")
DETECTOR_NAMES = ("entropy", "ruleset", "regex", "value", "path", "credentialed_uri", "connection_string", "credential_assignment", "credential_key", "pii:email", "pii:phone", "pii:address", "privacy_filter")
BUILTIN_RULES = "builtin:starter"

_NEEDED, _TEXTS, _TEXT, _NUMBER, _WHOLE, _TRUTH, _MAP, _ANY = object(), "a list of texts", "a text", "a number", "a whole number", "true or false", "a section", "anything"
#: Fields of each section: kind, and default or _NEEDED.
_CONFIG = {"comments": (_TRUTH, False), "replacement": (_TEXT, "[REDACTED-{n}]"), "formats": (_TEXTS, _NEEDED), "policy": (_MAP, _NEEDED), "placeholder": (_MAP, _NEEDED), "detectors": (_ANY, _NEEDED), "allow": (_MAP, {}), "agent": (_MAP, None)}
_POLICY = {"skip_key_suffixes": (_TEXTS, _NEEDED), "skip_keys": (_TEXTS, _NEEDED), "skip_object": (_MAP, _NEEDED), "credential_context": (_MAP, _NEEDED)}
_SKIP_OBJECT = {"key": (_TEXT, _NEEDED), "prefixes": (_TEXTS, []), "values": (_TEXTS, [])}
_CONTEXT = {"host_keys": (_TEXTS, _NEEDED), "user_keys": (_TEXTS, _NEEDED)}
_PLACEHOLDER = {"values": (_TEXTS, _NEEDED), "mask_characters": (_TEXT, _NEEDED), "mask_min_length": (_WHOLE, _NEEDED), "bracket_min_length": (_WHOLE, _NEEDED)}
_ALLOW = {k: (_TEXTS, []) for k in ("values", "regexes", "within", "paths", "files", "file_paths")}
_AGENT = {"protected": (_TEXTS, []), "exclude": (_TEXTS, []), "enforce": (_TRUTH, False)}
_SETTINGS: dict[str, dict] = {name: {} for name in DETECTOR_NAMES} | {
    "entropy": {"threshold": (_NUMBER, _NEEDED), "sensitive_threshold": (_NUMBER, _NEEDED), "min_token_length": (_WHOLE, _NEEDED), "sensitive_segments": (_TEXTS, _NEEDED), "structural_keys": (_TEXTS, _NEEDED), "hex_digest_lengths": (_ANY, _NEEDED)},
    "ruleset": {"rules": (_TEXTS, _NEEDED), "allow_signatures": (_TEXTS, list(engine.ALLOW_SIGNATURES)), "exclude_rules": (_TEXTS, [])},
    "regex": {"patterns": (_TEXTS, _NEEDED)},
    "value": {"values": (_TEXTS, _NEEDED)},
    "path": {"paths": (_TEXTS, _NEEDED)},
    "pii:email": {"allowlist": (_TEXTS, [])},
    "privacy_filter": {"model_dir": (_TEXT, _NEEDED), "categories": (_TEXTS, None), "min_score": (_NUMBER, 0.5), "max_tokens": (_WHOLE, 1024), "overlap": (_WHOLE, 128), "context": (_TEXT, "key"), "viterbi": (_ANY, "default")},
}


def _fits(kind: str, x: object) -> bool:
    number = isinstance(x, (int, float)) and not isinstance(x, bool)
    return {
        _TEXTS: isinstance(x, list) and all(isinstance(t, str) for t in x), _TEXT: isinstance(x, str), _NUMBER: number,
        _WHOLE: number and isinstance(x, int), _TRUTH: isinstance(x, bool), _MAP: isinstance(x, dict), _ANY: True,
    }[kind]


def _section(where: str, raw: object, fields: dict) -> dict:
    """The section with its defaults; unknown, missing and misshapen fields are errors."""
    if not isinstance(raw, dict):
        raise ConfigError(f"{where}: it must be a section")
    if unknown := [k for k in raw if k not in fields]:
        raise ConfigError(f"{where}: unknown field {unknown[0]!r}; expected one of {', '.join(fields)}")
    out = {}
    for name, (kind, default) in fields.items():
        if name not in raw or raw[name] is None and default is None:
            if default is _NEEDED:
                raise ConfigError(f"{where}: missing field {name!r}")
            out[name] = default
        elif not _fits(kind, raw[name]):
            raise ConfigError(f"{where}: {name} must be {kind}")
        else:
            out[name] = raw[name]
    return out


@dataclass(frozen=True)
class DetectorEntry:
    """One item of the list of detectors."""

    id: str
    settings: dict = field(default_factory=dict)
    enabled: bool = True
    label: str | None = None

    @classmethod
    def of(cls, raw: object, number: int) -> DetectorEntry:
        """From a bare name, or a map of one name to its settings."""
        where = f"detectors: entry {number}"
        if isinstance(raw, str):
            name, body = raw, {}
        elif isinstance(raw, dict) and len(raw) == 1:
            name, body = next(iter(raw.items()))
            body = {} if body is None else body
        else:
            raise ConfigError(f"{where}: it must be a name, or one name with settings")
        if name not in DETECTOR_NAMES:
            raise ConfigError(f"{where}: unknown detector {name!r}; expected one of {', '.join(DETECTOR_NAMES)}")
        if not isinstance(body, dict):
            raise ConfigError(f"{where}: {name}: settings must be a section")
        rest = {k: v for k, v in body.items() if k not in ("enabled", "label")}
        enabled, label = body.get("enabled", True), body.get("label")
        if not isinstance(enabled, bool) or label is not None and not isinstance(label, str):
            raise ConfigError(f"{where}: {name}: enabled must be true or false, and label a text")
        return cls(name, _section(f"{where}: {name}", rest, _SETTINGS[name]), enabled, label)

    def matches(self, name: str) -> bool:
        return name in (self.label or self.id, self.id)

    def resolve_paths(self, base: str) -> DetectorEntry:
        at = lambda p: p if os.path.isabs(p) or p.startswith("builtin:") else os.path.join(base, p)
        fixed = {k: [at(p) for p in v] if k == "rules" else at(v) if k == "model_dir" else v for k, v in self.settings.items()}
        return replace(self, settings=fixed)

    def detectors(self, placeholders: Placeholders) -> list[Detector]:
        """The detectors of this entry under its label. None for an empty list of values or paths."""
        made = self._made(placeholders)
        return [d.labelled(self.label) for d in made] if self.label and self.label != self.id else made

    def _made(self, p: Placeholders) -> list[Detector]:
        s = self.settings
        if self.id == "entropy":
            return [detection.entropy(**s)]
        if self.id == "ruleset":
            return [_ruleset(s, p)]
        if self.id == "regex":
            return detection.regex(s["patterns"])
        if self.id == "value":
            return detection.values(s["values"])
        if self.id == "path":
            return detection.paths(s["paths"])
        if self.id == "pii:email":
            return [detection.email(s["allowlist"])]
        if self.id == "privacy_filter":
            return [_privacy(s)]
        return [(detection.SIMPLE | detection.credentials(p))[self.id]]


def _ruleset(s: dict, p: Placeholders) -> Detector:
    def text(source: str) -> str:
        if source.startswith("builtin:"):
            if source != BUILTIN_RULES:
                raise RuleError(f"{source!r} is not built in; {BUILTIN_RULES} is")
            return engine.starter_source()
        try:
            return Path(source).read_text("utf-8")
        except OSError as x:
            raise RuleError(f"{source}: {x.strerror}") from None

    same = engine.Placeholder(p.words, p.masks, p.mask_min, p.bracket_min, p.template or Template.parse())
    return engine.ruleset([text(x) for x in s["rules"]], allow_signatures=s["allow_signatures"], exclude_rules=s["exclude_rules"], placeholder=same)


def _privacy(s: dict) -> Detector:
    folder = s["model_dir"]
    if not os.path.isdir(folder):
        raise ConfigError(f"privacy_filter: {folder}: no such folder")
    if s["context"] not in ("none", "key", "path"):
        raise ConfigError("privacy_filter: context must be none, key or path")
    biases = classify.Biases.of(s["viterbi"], os.path.join(folder, "viterbi_calibration.json"))
    return classify.detector(lambda: classify.onnx_model(folder), biases=biases, **{k: s[k] for k in ("max_tokens", "overlap", "min_score", "categories", "context")})


@dataclass(frozen=True)
class AgentPolicy:
    """Files that must only be read redacted."""

    protected: FileGlobs
    enforce: bool = False

    def is_protected(self, path: str) -> bool:
        return self.protected.matches(path)


@dataclass(frozen=True)
class Config:
    comments: bool
    replacement: str
    formats: tuple[str, ...]
    policy: dict
    placeholder: dict
    detectors: tuple[DetectorEntry, ...]
    allow: dict
    agent: dict | None = None
    base: str = ""  # the folder that file globs are relative to

    @classmethod
    def builtin(cls) -> Config:
        return _builtin()

    @staticmethod
    def builtin_source() -> str:
        return (Path(__file__).parent / "default.yml").read_text("utf-8")

    @classmethod
    def from_yaml(cls, source: str) -> Config:
        import yaml

        try:
            raw = yaml.load(source, Loader=_strict_loader())
        except yaml.YAMLError as x:
            mark = getattr(x, "problem_mark", None)
            raise ConfigError(f"not YAML{f': line {mark.line + 1}' if mark else ''}: {getattr(x, 'problem', '') or ''}") from None
        top = _section("configuration", raw, _CONFIG)
        if not isinstance(top["detectors"], list):
            raise ConfigError("configuration: detectors must be a list")
        policy = _section("policy", top["policy"], _POLICY)
        policy |= {"skip_object": _section("policy.skip_object", policy["skip_object"], _SKIP_OBJECT), "credential_context": _section("policy.credential_context", policy["credential_context"], _CONTEXT)}
        try:
            Template.parse(top["replacement"])
        except (ValueError, IndexError) as x:
            raise ConfigError(str(x) or "replacement: it is empty") from None
        entries = tuple(DetectorEntry.of(x, n) for n, x in enumerate(top["detectors"], 1))
        agent = None if top["agent"] is None else _section("agent", top["agent"], _AGENT)
        return cls(top["comments"], top["replacement"], tuple(top["formats"]), policy, _section("placeholder", top["placeholder"], _PLACEHOLDER), entries, _section("allow", top["allow"], _ALLOW), agent)

    @classmethod
    def from_path(cls, path: str) -> Config:
        try:
            source = Path(path).read_text("utf-8")
        except (OSError, UnicodeDecodeError) as x:
            raise ConfigError(f"reading {path}: {getattr(x, 'strerror', None) or 'not UTF-8'}") from None
        try:
            out = cls.from_yaml(source)
        except ConfigError as x:
            raise ConfigError(f"{path}: {x}") from None
        return out.resolve_paths(os.path.dirname(os.path.abspath(path)))

    def resolve_paths(self, base: str) -> Config:
        return replace(self, detectors=tuple(d.resolve_paths(base) for d in self.detectors), base=base)

    def enable_detectors(self, names: Iterable[str]) -> tuple[Config, list[str]]:
        """(configuration with the entries of these names or labels enabled, names that no entry has). A name that is no
        detector at all is an error."""
        names = list(names)
        known = lambda n: any(d.matches(n) for d in self.detectors)
        if wrong := [n for n in names if not known(n) and n not in DETECTOR_NAMES]:
            raise ConfigError(f"unknown detector {wrong[0]!r}")
        on = tuple(replace(d, enabled=d.enabled or any(map(d.matches, names))) for d in self.detectors)
        return replace(self, detectors=on), [n for n in names if not known(n)]

    @property
    def template(self) -> Template:
        return Template.parse(self.replacement)

    @property
    def placeholders(self) -> Placeholders:
        p = self.placeholder
        return Placeholders(tuple(x.lower() for x in p["values"]), p["mask_characters"], p["mask_min_length"], p["bracket_min_length"], self.template)

    @property
    def leaf_policy(self) -> formats.Policy:
        p, lower = self.policy, lambda xs: tuple(x.lower() for x in xs)
        return formats.Policy(
            lower(p["skip_keys"]), lower(p["skip_key_suffixes"]), lower(p["skip_object"]["values"]), lower(p["skip_object"]["prefixes"]),
            tuple(p["credential_context"]["host_keys"]), tuple(p["credential_context"]["user_keys"]), p["skip_object"]["key"].lower(),
        )

    def allowed_files(self) -> FileGlobs:
        return FileGlobs(tuple(self.allow["files"]), (), self.base)

    def allowed_file_paths(self) -> FileKeyPaths:
        return FileKeyPaths.of(self.allow["file_paths"], self.base)

    def allow_rules(self) -> Allow:
        return Allow(self.allow["values"], self.allow["regexes"])

    def agent_policy(self) -> AgentPolicy:
        a = self.agent or {"protected": [], "exclude": [], "enforce": False}
        return AgentPolicy(FileGlobs(tuple(a["protected"]), tuple(a["exclude"]), self.base), a["enforce"])

    def validate(self) -> tuple[list[str], list[str]]:
        """(errors, warnings): all that is wrong, part by part."""
        errors, warnings = [], []

        def tried(f, prefix: str = "") -> None:
            try:
                f()
            except (ValueError, OSError) as x:
                errors.append(prefix + str(x))

        p = self.placeholder
        if p["mask_min_length"] < 1 or p["bracket_min_length"] < 2:
            errors.append("placeholder: lengths must be at least 1 and 2")
        for name in self.formats:
            if name not in formats.ALL_NAMES:
                errors.append(f"unknown format {name!r}")
            elif name not in formats.FORMATS or not formats.usable(name):
                warnings.append(f"format {name!r} can't be read in this installation; skipping it")
        for d in self.detectors:
            if d.enabled:
                tried(lambda d=d: d.detectors(self.placeholders), f"{d.label or d.id}: ")
        tried(self.allow_rules, "allow.regexes: ")
        tried(lambda: detection._checked(self.allow["within"]), "allow.within: ")
        tried(self.allowed_file_paths)
        if self.agent is not None and not self.agent["protected"]:
            warnings.append("the agent section protects no files")
        return errors, warnings

    def redactor(self):
        """(Redactor, warnings)."""
        from .api import RedactorBuilder

        warnings: list[str] = []
        return self.apply(RedactorBuilder(), warnings).build(), warnings

    def apply(self, builder, warnings: list[str]):
        """Add all that this configuration says to a builder."""
        builder = builder.policy(self.leaf_policy).comments(self.comments).replacement(self.replacement).allow_paths(self.allow["paths"]).allow_within(self.allow["within"])
        for name in self.formats:
            if name not in formats.ALL_NAMES:
                raise ConfigError(f"unknown format {name!r}")
            if name in formats.FORMATS and formats.usable(name):
                builder = builder.format(name)
            else:
                warnings.append(f"format {name!r} can't be read in this installation; skipping it")
        for entry in self.detectors:
            if entry.enabled:
                for d in entry.detectors(self.placeholders):
                    builder = builder.detector(d)
        return builder

    def options(self) -> Options:
        return Options(self.template, self.comments, self.leaf_policy, None, tuple(f for f in self.formats if f in formats.FORMATS and formats.usable(f)), tuple(self.allow["paths"]), self.allowed_file_paths(), self.allowed_files(), tuple(self.allow["within"]), self.allow_rules())


def _strict_loader():
    import yaml

    class Strict(yaml.SafeLoader):
        """Keys that repeat are errors."""

    def mapping(loader, node, deep=False):
        seen = set()
        for k, _ in node.value:
            name = loader.construct_object(k, deep=True)
            if name in seen:
                raise yaml.constructor.ConstructorError(None, None, f"duplicate field {name!r}", k.start_mark)
            seen.add(name)
        return yaml.SafeLoader.construct_mapping(loader, node, deep)

    Strict.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    return Strict


@lru_cache(maxsize=1)
def _builtin() -> Config:
    return Config.from_yaml(Config.builtin_source())


def discover(start: str = ".", flag: str | None = None) -> str | None:
    """The configuration file to use: the flag's, the environment's, or one in start or a folder above it; None for the
    built-in one."""
    if flag or os.environ.get(ENV):
        return flag or os.environ[ENV]
    at = os.path.abspath(start)
    while True:
        for name in FILE_NAMES:
            if os.path.isfile(os.path.join(at, name)):
                return os.path.join(at, name)
        if os.path.dirname(at) == at:
            return None
        at = os.path.dirname(at)


def load(start: str = ".", flag: str | None = None) -> Config:
    path = discover(start, flag)
    return Config.from_path(path) if path else Config.builtin()


__all__ = ["AgentPolicy", "Config", "DetectorEntry", "PatternError", "discover", "load"]
