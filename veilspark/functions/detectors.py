"""Native detectors: text column (and key columns) to an array of byte spans."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .globs import glob
from .spans import entropy as entropy_bits
from .spans import find, let, none
from .tokens import Template


def normalize_key(key: Column) -> Column:
    return F.translate(F.lower(key), "- .", "___")


def plain_key(key: str) -> str:
    """normalize_key of one key."""
    return key.lower().translate(str.maketrans("- .", "___"))


def split_camel(key: Column) -> Column:
    return F.regexp_replace(key, r"(?<=\p{javaLowerCase})(?=\p{javaUpperCase})|(?s)(?<=.)(?=\p{javaUpperCase}\p{javaLowerCase})", "_")


def is_sensitive_key(key: Column, segments: Iterable[str] = P.SENSITIVE_SEGMENTS, structural: Iterable[str] = P.STRUCTURAL_KEYS) -> Column:
    """Whether a segment of the key names a secret and the key isn't of a structural kind."""
    veto = "(?:^|_)(?:" + "|".join(map(re.escape, structural)) + r")\z"
    named = lambda name: ~name.rlike(veto) & F.arrays_overlap(F.split(name, "_"), F.array(*map(F.lit, segments)))
    return F.coalesce(let(normalize_key(split_camel(key)), named), F.lit(False))


def is_placeholder(value: Column, template: Template | None = None, words: Iterable[str] = P.PLACEHOLDERS, masks: str = P.MASKS, mask_min: int = 3, bracket_min: int = 5) -> Column:
    """Stand-ins such as `<password>`, `${DB}`, `changeme`, `xxxx` and this library's own tokens."""
    template = template or Template.parse()
    stripped = F.regexp_replace(F.regexp_replace(value, r"\A[\s\x85\p{Z}]+|[\s\x85\p{Z}]+\z", ""), r"""\A["']+|["']+\z""", "")
    mask = "|".join(rf"{re.escape(c)}{{{mask_min},}}" for c in masks)

    def stands_in(bare: Column) -> Column:
        return (
            (bare == "")
            | (bare.rlike(r"\A<[a-z0-9_-]+>\z") & (F.octet_length(bare) >= bracket_min))
            | bare.rlike(rf"\A(?:{template.pattern})\z")
            | let(F.lower(bare), lambda low: low.rlike(rf"(?s)\A(?:\$\{{.*\}}|{mask})\z") | low.isin(*words))
        )

    return let(stripped, stands_in)


def has_real_value(value: Column, template: Template | None = None) -> Column:
    return let(value, lambda v: (v != "") & ~is_placeholder(v, template))


def unquote(value: Column) -> Column:
    return let(value, lambda v: F.when(v.rlike(r"""(?s)\A(?:"[^"]*"|'[^']*')\z""") & (F.length(v) >= 2), v.substr(F.lit(2), F.length(v) - 2)).otherwise(v))


def entropy(text: Column, key: Column | None = None, threshold: float = 4.5, sensitive_threshold: float = 3.5, min_length: int = 10, hex_lengths: Iterable[int] = P.HEX_LENGTHS, segments: Iterable[str] = P.SENSITIVE_SEGMENTS, structural: Iterable[str] = P.STRUCTURAL_KEYS) -> Column:
    """Tokens above the threshold; under a sensitive key the lower one holds, and hex digests count whatever theirs is."""
    if key is None:
        if threshold >= math.log2(66):  # more than the alphabet of tokens can hold
            return none()
        least = max(min_length, math.ceil(2 ** (threshold - 1e-9)))  # n characters hold log2(n) bits at most
        return find(text, f"{P.ENTROPY_TOKEN}{{{least},}}", "entropy", lambda m: entropy_bits(m) > threshold)
    pattern = f"{P.ENTROPY_TOKEN}{{{min_length},}}"
    sensitive = is_sensitive_key(key, segments, structural)
    digest = lambda m: m.rlike(r"\A[0-9A-Fa-f]+\z") & F.length(m).isin(*hex_lengths)
    return find(text, pattern, "entropy", lambda m: F.when(sensitive, digest(m) | (entropy_bits(m) > sensitive_threshold)).otherwise(entropy_bits(m) > threshold))


def regex(text: Column, expressions: Iterable[str], label: str = "regex", java: bool = False) -> Column:
    """Every non-empty match of each pattern."""
    found = [find(text, p if java else P.to_java(p), label, lambda m: m != "") for p in expressions]
    return F.concat(*found) if found else none()


def provider_token(text: Column) -> Column:
    return regex(text, P.PROVIDER_TOKENS, "provider_token", java=True)


def path(text: Column, key_path: Column, globs: Iterable[str]) -> Column:
    """The whole value where its key path matches a glob."""
    rules = "|".join(f"(?:{glob(g)})" for g in globs)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.octet_length(text).alias("end"), F.lit("path").alias("label")))
    return F.when(F.lit(bool(rules)) & key_path.rlike(rules or "$.") & (text != ""), whole).otherwise(none())


def email(text: Column, allow: Iterable[str] = ()) -> Column:
    """E-mail addresses; allow holds `@suffix`, `prefix@` or whole addresses, compared in lower case."""

    def keep(m: Column) -> Column:
        out, low = F.lit(True), F.lower(m)
        for a in map(str.lower, allow):
            out &= ~(F.endswith(low, F.lit(a)) if a[0] == "@" else F.startswith(low, F.lit(a)) if a[-1] == "@" else low == a)
        return out

    return F.when(F.contains(text, F.lit("@")), find(text, P.EMAIL, "pii:email", keep)).otherwise(none())


def phone(text: Column) -> Column:
    return find(text, P.PHONE, "pii:phone")


def address(text: Column) -> Column:
    return find(text, P.ADDRESS, "pii:address")


def credentialed_uri(text: Column, real_value: Callable[[Column], Column] = has_real_value) -> Column:
    """URLs with a password that isn't a placeholder."""
    real = lambda m: real_value(F.regexp_extract(m, P.CREDENTIALED_URI, 1))
    return F.when(F.contains(text, F.lit("://")), find(text, P.CREDENTIALED_URI, "credentialed_uri", real)).otherwise(none())


def _assigns_password(candidate: Column, real: Callable) -> Column:
    return F.exists(F.regexp_extract_all(candidate, F.lit(P.PASSWORD_ASSIGNMENT), F.lit(1)), lambda v: real(unquote(v)))


def _url_password(candidate: Column, real: Callable) -> Column:
    pairs = F.split(F.regexp_extract(candidate, r"\A[^?#]*\?([^#]*)", 1), "&")
    pairs = F.filter(pairs, lambda p: F.lower(F.substring_index(p, "=", 1)).isin("password", "pwd") & F.contains(p, F.lit("=")))
    value = lambda p: F.coalesce(F.try_url_decode(F.regexp_replace(p, r"\A[^=]*=", "")), F.regexp_replace(p, r"\A[^=]*=", ""))
    return candidate.rlike(r"\A[^/]*//(?:[^/?#]*@)?[^/?#:@]") & F.exists(pairs, lambda p: real(value(p)))


def connection_string(text: Column, real: Callable[[Column], Column] = has_real_value) -> Column:
    """JDBC and database URLs, keyword and semicolon strings with a password; closing punctuation is left out."""
    strip = lambda m: F.regexp_replace(m, r"[.,;:!?)\]]+\z", "")
    part = lambda m: (F.lit(0), F.octet_length(strip(m)))
    kinds: list[tuple[str, Callable]] = [
        (P.JDBC, _assigns_password),
        (P.DATABASE_URL, _url_password),
        (P.KEYWORD_DSN, lambda c, real: c.rlike(P.KEYWORD_HOST) & c.rlike(P.KEYWORD_USER) & _assigns_password(c, real)),
        (P.SEMICOLON, lambda c, real: c.rlike(P.SEMICOLON_SERVER) & c.rlike(P.SEMICOLON_USER) & _assigns_password(c, real)),
    ]
    found = [find(text, p, "connection_string", lambda m, ok=ok: let(strip(m), lambda c: ok(c, real)), part) for p, ok in kinds]
    return F.when(text.rlike("(?i)(?:password|pwd)="), F.concat(*found)).otherwise(none())


def credential_assignment(text: Column, real: Callable[[Column], Column] = has_real_value) -> Column:
    """The value of `KEY=value` in free text where KEY names a database password."""
    value = lambda m: F.regexp_replace(m, r"\A[^=]*=", "")
    quoted = lambda m: value(m).rlike(r"""\A["']""").cast("int")
    part = lambda m: (F.octet_length(m) - F.octet_length(value(m)) + quoted(m), F.octet_length(m) - quoted(m))
    return F.when(F.contains(text, F.lit("=")), find(text, P.CREDENTIAL_ASSIGNMENT, "credential_assignment", lambda m: real(unquote(value(m))), part)).otherwise(none())


def credential_key(text: Column, key: Column, context: Column | None = None, real: Callable[[Column], Column] = has_real_value) -> Column:
    """The whole value of a field whose key names a database password, or `password` where host and user stand beside it."""
    name = normalize_key(key)
    ok = name.rlike(rf"\A{P.DATABASE_KEY}\z") | (F.coalesce(context, F.lit(False)) & (name == "password")) if context is not None else name.rlike(rf"\A{P.DATABASE_KEY}\z")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.octet_length(text).alias("end"), F.lit("credential_key").alias("label")))
    return F.when(F.coalesce(ok & real(text), F.lit(False)), whole).otherwise(none())


#: Lists of more literals than this are always matched by the automaton; shorter ones are tested for overlaps first.
FEW_LITERALS = 40


def _may_overlap(words: list[str]) -> bool:
    ends = {w[i:] for w in words for i in range(1, len(w))}
    heads = {w[:i] for w in words for i in range(1, len(w) + 1)}
    return bool(ends & heads) or any(a != b and a in b for a in words for b in words)


def values(text: Column, words: Iterable[str], label: str = "value") -> Column:
    """Listed literals. Where one overlaps another the match that ends first must win, which a native alternation can't
    promise; those lists take the automaton in `functions.literals`."""
    words = sorted({w for w in words if w})
    if not words:
        return none()
    if len(words) > FEW_LITERALS or _may_overlap(words):
        from .literals import spans_udf

        return spans_udf(words, label)(text)
    return find(text, "|".join(re.escape(w) for w in words), label)


DEFAULT = ("entropy", "provider_token", "credentialed_uri", "connection_string", "credential_assignment")
def relabel(spans: Column, name: str, label: str) -> Column:
    """Own labels get the new prefix; a `:suffix` stays."""
    own = lambda s: (s["label"] == name) | F.startswith(s["label"], F.lit(name + ":"))
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(own(s), F.concat(F.lit(label), F.substring(s["label"], len(name) + 1, 10_000))).otherwise(s["label"]).alias("label")))
