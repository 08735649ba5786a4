"""Structured text formats: leaves with the places of their values, and byte-preserving rewriting.

A parser yields leaves (value, key, path, place in the text, style). Rewriting touches only the places of changed
leaves: an unescaped value is edited in place, an escaped one where the edited text is unique, any other is encoded anew.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

from ..functions.patterns import HOST_KEYS, SKIP_KEYS, SKIP_SUFFIXES, SKIP_TYPE_PREFIXES, SKIP_TYPES, USER_KEYS


class FormatError(ValueError):
    """Input that isn't of the format; the message shows a place, never a value."""


class Keys(list):
    """Keys of an object as they are read, and the text values of its fields."""

    def __init__(self, keys=()):
        super().__init__(keys)
        self.fields: list[tuple[str, str]] = []


@dataclass
class Leaf:
    value: str
    key: str | None
    path: str
    start: int
    end: int
    style: str = "raw"
    around: tuple = ()  # the Keys of the objects it lies in, outermost first
    comment: bool = False
    keys: tuple[str, ...] | None = None  # the keys of its path, each whole; None where the path's dots are the only dots


_AS_WORD = str.maketrans("- .", "___")


@dataclass(frozen=True)
class Policy:
    """Which leaves are scanned. A subclass may answer each question in its own way."""

    skip_keys: tuple[str, ...] = SKIP_KEYS
    skip_suffixes: tuple[str, ...] = SKIP_SUFFIXES
    skip_types: tuple[str, ...] = SKIP_TYPES
    skip_type_prefixes: tuple[str, ...] = SKIP_TYPE_PREFIXES
    host_keys: tuple[str, ...] = HOST_KEYS
    user_keys: tuple[str, ...] = USER_KEYS
    type_key: str = "type"

    def skip_key(self, key: str) -> bool:
        """Whether a key's value, and all below it, is left alone."""
        low = key.lower()
        return low in self.skip_keys or low.endswith(self.skip_suffixes)

    def skip_object(self, keys: Keys) -> bool:
        """Whether an object is left alone for its type, such as an image's."""
        kinds = [v.lower() for k, v in keys.fields if k.lower() == self.type_key]
        return any(x in self.skip_types or x.startswith(self.skip_type_prefixes) for x in kinds)

    def credential_context(self, keys: Keys) -> bool:
        """Whether an object names a host and a user; a bare `password` in it or below is then a credential."""
        names = {k.lower().translate(_AS_WORD) for k in keys if k}
        return not names.isdisjoint(self.host_keys) and not names.isdisjoint(self.user_keys)

    def lets_through(self, leaf: Leaf) -> bool:
        keys = leaf.keys if leaf.keys is not None else leaf.path.split(".")
        return not any(self.skip_key(k) for k in keys if k) and not any(self.skip_object(x) for x in leaf.around)


class ScanAll(Policy):
    """Every leaf is scanned."""

    def skip_key(self, key: str) -> bool:
        return False

    def skip_object(self, keys: Keys) -> bool:
        return False


class Judged:
    """A policy's answers about the leaves of one document, each question asked once for each key and object."""

    def __init__(self, policy: Policy):
        self.policy, self.own = policy, type(policy).lets_through is not Policy.lets_through
        self.keys: dict[str, bool] = {}
        self.objects: dict[int, bool] = {}
        self.contexts: dict[int, bool] = {}
        self.around: dict[int, tuple[tuple, bool]] = {}  # of the tuples of objects, one for all leaves beside each other

    def lets_through(self, leaf: Leaf) -> bool:
        if self.own:
            return self.policy.lets_through(leaf)
        for k in leaf.keys if leaf.keys is not None else leaf.path.split("."):
            if k:
                if (out := self.keys.get(k)) is None:
                    out = self.keys[k] = self.policy.skip_key(k)
                if out:
                    return False
        for x in leaf.around:
            if self._answer(self.objects, id(x), self.policy.skip_object, x):
                return False
        return True

    def credential_context(self, leaf: Leaf) -> bool:
        known = self.around.get(id(leaf.around))
        if known is None:  # the tuple is kept, so that its id stays its own
            known = self.around[id(leaf.around)] = leaf.around, any(self._answer(self.contexts, id(x), self.policy.credential_context, x) for x in leaf.around)
        return known[1]

    @staticmethod
    def _answer(known: dict, name, ask: Callable, about) -> bool:
        if (out := known.get(name)) is None:
            out = known[name] = ask(about)
        return out


def skipped(key: str) -> bool:
    return Policy().skip_key(key)


def _join(path: str, key: str | None) -> str:
    return path if key is None else f"{path}.{key}" if path else key


def _down(names: tuple[str, ...], key: str | None) -> tuple[str, ...]:
    return names if key is None else (*names, key)


# -- JSON with comments, single quotes, bare keys and trailing commas ------------------------------------------
_JSON_TOKEN = re.compile(r"""\s*+(\Z|//[^\n]*|/\*.*?\*/|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|[{}\[\]:,]|[^\s{}\[\]:,"'/]+|.)""", re.S)
_JSON_BARE = re.compile(r"[-+]?(?:0x[0-9A-Fa-f]+|[0-9.]+(?:[eE][-+]?[0-9]+)?|Infinity|NaN)|true|false|null")
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|(\r\n|.))", re.S)
_SIMPLE = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r\n": ""}


def _unescape(body: str) -> str:
    if "\\" not in body:
        return body
    out = _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _SIMPLE.get(m[3], m[3]), body)
    return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def json_leaves(text: str, base: int = 0, comments: bool = False) -> Iterator[Leaf]:
    """Leaves of a JSON text, in order; duplicate keys are all kept."""
    stack: list[tuple[str, str, tuple, Keys]] = []  # open containers: what closes them, path, keys of the path, own keys
    close, above, names, mine, around = "", "", (), None, ()  # those of the innermost, and the keys of all
    state, key, done = "value", None, False
    for m in _JSON_TOKEN.finditer(text):
        t = m[1]
        if not t:
            break
        c = t[0]
        if c == "/" and t[:2] in ("//", "/*"):
            if comments:
                yield Leaf(t, None, above, base + m.start(1), base + m.end(1), "raw", (), True)
            continue
        if done:
            raise FormatError(f"text after the value at {m.start(1)}")
        if t == close and state != "colon" and not (state == "value" and t == "}"):
            stack.pop()
            close, above, names, mine = stack[-1] if stack else ("", "", (), None)
            around = around[:-1]
            state, done = "next", not stack
            continue
        if state == "next":
            if t != "," or not stack:
                raise FormatError(f"a comma is missing at {m.start(1)}")
            state = "key" if close == "}" else "value"
        elif state == "key":
            if c in "{}[]:," or (c in "\"'" and len(t) < 2) or t == "/":
                raise FormatError(f"a key is missing at {m.start(1)}")
            key, state = (_unescape(t[1:-1]) if c in "\"'" else t), "colon"
        elif state == "colon":
            if t != ":":
                raise FormatError(f"a colon is missing at {m.start(1)}")
            mine.append(key)
            state = "value"
        elif c in "{[":
            own = key if close == "}" else None
            above, names, mine = _join(above, own), _down(names, own), Keys()
            close, state = ("}", "key") if c == "{" else ("]", "value")
            stack.append((close, above, names, mine))
            around = (*around, mine)
        else:
            if c in "}]:,/" or (c in "\"'" and len(t) < 2):
                raise FormatError(f"a value is missing at {m.start(1)}")
            if c in "\"'":
                own = key if close == "}" else None
                yield Leaf(_unescape(t[1:-1]), own, _join(above, own), base + m.start(1), base + m.end(1), "json" + c, around, False, _down(names, own))
            elif not _JSON_BARE.fullmatch(t):
                raise FormatError(f"not a value at {m.start(1)}")
            state, done = "next", not stack
    if stack or not done:
        raise FormatError("the text ends inside a value")


def jsonl_leaves(text: str, comments: bool = False) -> Iterator[Leaf]:
    """Leaves line by line; a line that isn't JSON is one text leaf."""
    at = 0
    for line in text.split("\n"):
        body = line.rstrip("\r")
        if body.strip():
            try:
                yield from list(json_leaves(body, at))
            except FormatError:
                yield Leaf(body, None, "", at, at + len(body))
        at += len(line) + 1


def text_leaves(text: str, comments: bool = False) -> Iterator[Leaf]:
    if text:
        yield Leaf(text, None, "", 0, len(text))


def _line_leaves(text: str, sections: bool, comments: bool, export: bool) -> Iterator[Leaf]:
    section, at = "", 0
    for line in text.splitlines(keepends=True):
        body = line.rstrip("\r\n")
        s = body.strip()
        start, at = at, at + len(line)
        if not s:
            continue
        if s[0] in "#;":
            if comments:
                yield Leaf(s, None, section, start + body.index(s), start + body.index(s) + len(s), "raw", (), True)
            continue
        if sections and (m := re.fullmatch(r"\[([^\]]*)\]\s*(?:[#;].*)?", s)):
            section = m[1].strip()
            continue
        m = re.match(r"\s*" + (r"(?:export\s+)?" if export else "") + r"([^=:\s][^=:]*?|)\s*" + ("=" if export else "[=:]") + r"[ \t]*", body)
        if not m:
            a = start + body.index(s)
            yield Leaf(s, None, section, a, a + len(s))
            continue
        value = body[m.end() :].rstrip()
        a = start + m.end()
        if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
            value, a = value[1:-1], a + 1
        if value:
            yield Leaf(value, m[1], _join(section, m[1]), a, a + len(value), keys=tuple(x for x in (section, m[1]) if x))


def ini_leaves(text: str, comments: bool = False) -> Iterator[Leaf]:
    return _line_leaves(text, True, comments, False)


def dotenv_leaves(text: str, comments: bool = False) -> Iterator[Leaf]:
    return _line_leaves(text, False, comments, True)


def properties_leaves(text: str, comments: bool = False) -> Iterator[Leaf]:
    """Logical lines with continuations; keys and values are unescaped."""
    for m in re.finditer(r"[^\r\n\\]*(?:\\(?:\r\n|.|$)[^\r\n\\]*)*", text, re.S):
        line = m[0]
        lead = len(line) - len(line.lstrip(" \t\f"))
        if not line.strip():
            continue
        if line[lead] in "#!":
            if comments:
                yield Leaf(line[lead:], None, "", m.start() + lead, m.end(), "raw", (), True)
            continue
        k = re.match(r"(?:[^\\\s=:]|\\.)*", line[lead:], re.S)
        sep = re.compile(r"[ \t\f]*[=:]?[ \t\f]*").match(line, lead + k.end())
        plain = lambda s: _ESCAPE.sub(lambda x: chr(int(x[1], 16)) if x[1] else _SIMPLE.get(x[3] or x[0][1], x[3] or x[0][1:]) if (x[3] or "x") in "ntrf" else (x[3] or x[0][1:]), re.sub(r"\\\r?\n[ \t\f]*", "", s))
        key, raw = plain(k[0]), line[sep.end() :]
        yield Leaf(plain(raw), key, key, m.start() + sep.end(), m.end(), "properties", keys=(key,))


def dsv_leaves(delimiter: str) -> Callable[..., Iterator[Leaf]]:
    cell = re.compile(rf'"((?:[^"]|"")*)"(?=[{re.escape(delimiter)}\r\n]|\Z)|[^{re.escape(delimiter)}\r\n]*')

    def leaves(text: str, comments: bool = False) -> Iterator[Leaf]:
        """Cells by row; the first row names the others and has no keys."""
        header: list[str] | None = None
        at = 0
        while at < len(text):
            row = []
            while True:
                m = cell.match(text, at)
                quoted = m[1] is not None
                row.append((m[1].replace('""', '"') if quoted else m[0], m.start(), m.end(), f"dsv{delimiter}" if not quoted else "dsv\""))
                at = m.end()
                if text[at : at + 1] == delimiter:
                    at += 1
                    continue
                break
            at += 2 if text[at : at + 2] == "\r\n" else 1
            names = Keys(header or ())
            for i, (value, a, b, style) in enumerate(row):
                key = names[i] if i < len(names) else None
                yield Leaf(value, key, key or "", a, b, style, (names,), False, _down((), key))
            header = header if header is not None else [v for v, *_ in row]

    return leaves


def _yaml_comments(text: str) -> Iterator[Leaf]:
    """What follows a `#` at a line's start or behind white space, outside scalars."""
    import yaml

    scalars = [(t.start_mark.index, t.end_mark.index) for t in yaml.scan(text, Loader=yaml.SafeLoader) if isinstance(t, yaml.ScalarToken)]
    starts = [a for a, _ in scalars]
    for m in re.finditer(r"(?<![^\s])#[^\n]*", text):
        i = bisect_right(starts, m.start()) - 1
        if i < 0 or m.start() >= scalars[i][1]:
            body = m[0].rstrip("\r")
            yield Leaf(body, None, "", m.start(), m.start() + len(body), "raw", (), True)


def yaml_leaves(text: str, comments: bool = False) -> Iterator[Leaf]:
    """Every scalar as it stands, by the event marks of the YAML library; aliases are passed over."""
    if not comments:
        return _yaml_values(text)
    values = list(_yaml_values(text))
    return iter(sorted([*values, *_yaml_comments(text)], key=lambda x: x.start))


def _yaml_values(text: str) -> Iterator[Leaf]:
    import yaml

    stack: list[dict] = []
    try:
        for e in yaml.parse(text, Loader=yaml.SafeLoader):
            top = stack[-1] if stack else None
            mapping = top is not None and top["kind"] == "map"
            if isinstance(e, (yaml.MappingStartEvent, yaml.SequenceStartEvent)):
                path, names = (top["path"], top["names"]) if top else ("", ())
                if mapping:
                    path, names = _join(path, top["key"]), _down(names, top["key"])
                    top["want"] = "key"
                stack.append({"kind": "map" if isinstance(e, yaml.MappingStartEvent) else "seq", "path": path, "names": names, "want": "key", "key": None, "keys": Keys()})
            elif isinstance(e, (yaml.MappingEndEvent, yaml.SequenceEndEvent)):
                stack.pop()
            elif isinstance(e, (yaml.ScalarEvent, yaml.AliasEvent)):
                if mapping and top["want"] == "key":
                    top["key"] = e.value if isinstance(e, yaml.ScalarEvent) else None
                    top["keys"].append(top["key"] or "")
                    top["want"] = "value"
                    continue
                key = None
                if mapping:
                    key, top["want"] = top["key"], "key"
                if isinstance(e, yaml.ScalarEvent) and e.value != "":
                    style = {"'": "yaml'", '"': "yaml\"", "|": "yaml|", ">": "yaml|"}.get(e.style or "", "yaml")
                    yield Leaf(e.value, key, _join(top["path"] if top else "", key), e.start_mark.index, e.end_mark.index, style, tuple(c["keys"] for c in stack), False, _down(top["names"] if top else (), key))
    except yaml.YAMLError as x:
        raise FormatError("not YAML") from x


_TOML_STRING = re.compile(r'"""(?:\\.|[^\\])*?"""(?!")|\'\'\'.*?\'\'\'|"(?:[^"\\\n]|\\.)*"|\'[^\'\n]*\'', re.S)


def toml_leaves(text: str, comments: bool = False) -> Iterator[Leaf]:
    """Strings of a text that tomllib accepts."""
    import tomllib

    try:
        tomllib.loads(text)
    except tomllib.TOMLDecodeError as x:
        raise FormatError("not TOML") from x
    token = re.compile(rf"#[^\n]*|(?P<s>{_TOML_STRING.pattern})|\[\[?|\]\]?|[{{}}=,\n]|[^\s#\"'\[\]{{}}=,]+|\s", re.S)
    table, line, scopes = "", [], [("", "key")]

    def name(parts: list[str]) -> str:
        return ".".join(p for raw in parts for p in ([_unescape(raw[1:-1]).replace(".", "\x1f")] if raw[0] in "\"'" else [x for x in raw.split(".") if x]))

    depth: list[str] = []
    for m in token.finditer(text):
        t = m[0]
        base, mode = scopes[-1]
        if t[0] == "#":
            if comments:
                yield Leaf(t, None, base, m.start(), m.end(), "raw", (), True)
        elif t == "\n":
            if mode == "head":
                table = name(line)
                scopes = [(table, "key")]
            elif mode == "value" and not depth:
                scopes[-1:] = [(table, "key")]
            line = line if depth else []
        elif t.isspace():
            continue
        elif mode == "key" and t in ("[", "[[") and not line and not depth:
            scopes, line = [("", "head")], []
        elif mode == "head":
            line += [t] if t not in ("]", "]]") else []
        elif mode == "key" and t == "=":
            scopes[-1] = (_join(base, name(line)), "value")
            line = []
        elif mode == "key" and t not in "},":
            line.append(t)
        elif t in ("[", "[["):
            depth += ["["] * len(t)
        elif t in ("]", "]]"):
            del depth[-len(t) :]
        elif t == "{":
            depth.append("{")
            scopes.append((base, "key"))
            line = []
        elif t == "}":
            depth.pop()
            scopes.pop()
        elif t == ",":
            if depth and depth[-1] == "{":
                scopes[-1] = (scopes[-2][0], "key")
                line = []
        elif m["s"]:
            q = 3 if t[:3] in ('"""', "'''") else 1
            body = t[q:-q]
            body = body[1:] if q == 3 and body[:1] == "\n" else body
            names = tuple(k.replace("\x1f", ".") for k in base.split(".") if k)
            yield Leaf(body if t[0] == "'" else _unescape(body), names[-1] if names else None, ".".join(names), m.start(), m.end(), "toml", keys=names)
    if scopes[-1][1] == "head":
        return


_XML_TOKEN = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<![^>]*>|</[^>]*>|<(?:[^>\"']|\"[^\"]*\"|'[^']*')*>|[^<]+", re.S)
_XML_ATTR = re.compile(r"""([^\s=<>/"']+)\s*=\s*("[^"]*"|'[^']*')""")


def _xml_text(s: str) -> str:
    import html

    return re.sub(r"&(?:#x?[0-9A-Fa-f]+|lt|gt|amp|quot|apos);", lambda m: html.unescape(m[0]), s)


def xml_leaves(text: str, comments: bool = False) -> Iterator[Leaf]:
    """Text, CDATA and attributes; the values of a property-list dict take the <key> before them as theirs."""
    stack: list[dict] = []
    for m in _XML_TOKEN.finditer(text):
        t = m[0]
        path = ".".join(s["name"] for s in stack)
        if t.startswith("<!--"):
            if comments and t[4:-3].strip():
                yield Leaf(t[4:-3], None, path, m.start() + 4, m.end() - 3, "raw", (), True)
        elif t.startswith("<![CDATA["):
            if t[9:-3]:
                yield Leaf(t[9:-3], stack[-1]["name"] if stack else None, path, m.start() + 9, m.end() - 3, "cdata")
        elif t.startswith(("<?", "<!")):
            continue
        elif t.startswith("</"):
            if not stack or stack[-1]["tag"] != t[2:-1].strip():
                raise FormatError(f"an end tag without its start at {m.start()}")
            stack.pop()
        elif t[0] == "<":
            tag = re.match(r"<([^\s/>]+)", t)
            if not tag:
                raise FormatError(f"not a tag at {m.start()}")
            parent = stack[-1] if stack else None
            label = parent.get("next") if parent and parent["tag"] == "dict" and tag[1] != "key" else None
            here = {"tag": tag[1], "name": label or tag[1]}
            attributes = list(_XML_ATTR.finditer(t))
            for a in attributes:
                if a[2][1:-1]:
                    yield Leaf(_xml_text(a[2][1:-1]), a[1], _join(_join(path, here["name"]), a[1]), m.start() + a.start(2), m.start() + a.end(2), "attr", (Keys(x[1] for x in attributes),))
            if not t.endswith("/>"):
                stack.append(here)
        elif t.strip():
            if not stack:
                raise FormatError("text outside the root")
            if stack[-1]["tag"] == "key" and len(stack) > 1 and stack[-2]["tag"] == "dict":
                stack[-2]["next"] = _xml_text(t).strip()
                continue
            a, b = len(t) - len(t.lstrip()), len(t.rstrip())
            yield Leaf(_xml_text(t[a:b]), stack[-1]["name"], path, m.start() + a, m.start() + b, "xml")
    if stack:
        raise FormatError("an element is not closed")


_HCL_TOKEN = re.compile(r'#[^\n]*|//[^\n]*|/\*.*?\*/|<<-?(?P<tag>\w+)\n(?P<doc>.*?)\n[ \t]*(?P=tag)\b|"(?:[^"\\$%]|\\.|\$\$\{|%%\{|[$%](?!\{)|[$%]\{[^}]*\})*"|[{}\[\]=,:\n]|[A-Za-z_][\w.-]*|\s|.', re.S)


def hcl_leaves(text: str, comments: bool = False) -> Iterator[Leaf]:
    """String literals of attributes; labels, keys and interpolated templates stay."""
    stack, words, key = [], [], None
    for m in _HCL_TOKEN.finditer(text):
        t = m[0]
        path = ".".join(stack)
        if t[0] == "#" or t[:2] in ("//", "/*"):
            if comments:
                yield Leaf(t, None, path, m.start(), m.end(), "raw", (), True)
        elif t == "\n":
            words, key = ([], None) if not (key and text[: m.start()].rstrip()[-1:] in "[,") else (words, key)
        elif t in ("=", ":"):
            key, words = (words[-1] if words else key), []
        elif t == "{":
            stack.append(key or (words[0] if words else ""))
            words, key = [], None
        elif t == "}":
            if not stack:
                raise FormatError("a brace has no partner")
            stack.pop()
            words, key = [], None
        elif m["tag"] and key:
            yield Leaf(m["doc"], key, _join(path.strip("."), key), m.start("doc"), m.end("doc"))
        elif t[0] == '"' and len(t) > 1:
            if key is None:
                words.append(t[1:-1])
            elif not re.search(r"(?<![$%])[$%]\{", t):
                yield Leaf(_unescape(t[1:-1]).replace("$${", "${").replace("%%{", "%{"), key, _join(path.strip("."), key), m.start(), m.end(), "hcl")
        elif re.match(r"\w", t):
            words.append(t)
    if stack:
        raise FormatError("a block is not closed")


def _bplist(data: bytes):
    import plistlib

    return plistlib.loads(data, fmt=plistlib.FMT_BINARY)


def bplist_leaves(data: bytes) -> list[Leaf]:
    out: list[Leaf] = []

    def walk(x, key, names, around=()):
        if isinstance(x, dict):
            inner = Keys(x)
            for k, v in x.items():
                walk(v, k, (*names, k), (*around, inner))
        elif isinstance(x, list):
            for v in x:
                walk(v, None, names, around)
        elif isinstance(x, str):
            out.append(Leaf(x, key, ".".join(names), len(out), len(out), "bplist", around, False, names))

    try:
        walk(_bplist(data), None, ())
    except Exception as x:
        raise FormatError("not a binary property list") from x
    return out


def _bplist_render(data: bytes, values: dict[int, str]) -> bytes:
    import plistlib

    n = -1

    def walk(x):
        nonlocal n
        if isinstance(x, dict):
            return {k: walk(v) for k, v in x.items()}
        if isinstance(x, list):
            return [walk(v) for v in x]
        if isinstance(x, str):
            n += 1
            return values.get(n, x)
        return x

    return plistlib.dumps(walk(_bplist(data)), fmt=plistlib.FMT_BINARY, sort_keys=False)


@dataclass
class Format:
    name: str
    leaves: Callable
    extensions: tuple[str, ...] = ()
    names: tuple[str, ...] = ()
    sniff: Callable[[bytes], bool] = field(default=lambda _data: False)


def _parses(data: bytes, leaves: Callable) -> bool:
    try:
        list(leaves(data.decode()))
        return True
    except ValueError:
        return False


def _is_jsonl(data: bytes) -> bool:
    rows = [x for x in data.splitlines() if x.strip()]
    return len(rows) > 1 and rows[0].lstrip()[:1] in (b"{", b"[") and _parses(rows[0], json_leaves) and not _parses(data, json_leaves)


#: How formats are known by extension, file name and content.
FORMATS = {
    f.name: f
    for f in (
        Format("json", json_leaves, tuple("json jsonc json5 geojson har ipynb sarif code-workspace webmanifest".split()), tuple(".babelrc .eslintrc .prettierrc .jshintrc composer.lock flake.lock".split()), lambda d: d.lstrip()[:1] in (b"{", b"[") and _parses(d, json_leaves)),
        Format("jsonl", jsonl_leaves, ("jsonl", "ndjson", "jsonlines"), (), _is_jsonl),
        Format("yaml", yaml_leaves, ("yaml", "yml"), (".clang-format", ".clang-tidy")),
        Format("toml", toml_leaves, ("toml",), ("cargo.lock", "pipfile", "poetry.lock", "uv.lock", "pdm.lock")),
        Format("xml", xml_leaves, tuple("xml plist svg xsd xsl xslt csproj vbproj fsproj props targets config resx xaml pom wsdl rss atom xhtml".split()), ("pom.xml", "web.config", "app.config", "nuget.config"), lambda d: d.lstrip().startswith(b"<?xml")),
        Format("hcl", hcl_leaves, ("hcl", "tf", "tfvars", "nomad", "pkr.hcl"), (".terraform.lock.hcl", ".terraformrc", "terraform.rc")),
        Format("ini", ini_leaves, tuple("ini cfg conf cnf inf desktop service editorconfig".split()), tuple(".npmrc .yarnrc .gitconfig .gitmodules .editorconfig .pypirc .pgpass .my.cnf .s3cfg .boto credentials config setup.cfg tox.ini pip.conf".split())),
        Format("dotenv", dotenv_leaves, ("env",), (".env", ".envrc", ".flaskenv")),
        Format("properties", properties_leaves, ("properties",), ("gradle.properties", "local.properties")),
        Format("csv", dsv_leaves(","), ("csv",)),
        Format("tsv", dsv_leaves("\t"), ("tsv", "tab")),
        Format("psv", dsv_leaves("|"), ("psv",)),
        Format("bplist", bplist_leaves, (), (), lambda d: d.startswith(b"bplist00")),
        Format("text", text_leaves, ("txt", "log", "md", "text")),
    )
}


ALL_NAMES = tuple(FORMATS)


def usable(name: str) -> bool:
    """Whether what a format needs is installed."""
    if name == "yaml":
        try:
            import yaml  # noqa: F401
        except ImportError:
            return False
    return True


def register(fmt: Format) -> None:
    """Add a format; one of the same name is replaced and asked last when sniffing, first by extension."""
    FORMATS.pop(fmt.name, None)
    FORMATS[fmt.name] = fmt
    _by_name.cache_clear()


def choose(data: bytes, path: str | None = None, among: tuple[str, ...] | None = None) -> str:
    """Format by file name, then extension, then content; else text. With `among`, only those, content in their order."""
    name = (path or "").rsplit("/", 1)[-1].lower()
    return _by_name(name, among) or next((f.name for f in _known(among) if f.sniff(data)), "text")


def _known(among: tuple[str, ...] | None) -> list[Format]:
    return list(FORMATS.values()) if among is None else [FORMATS[n] for n in among if n in FORMATS]


@lru_cache(maxsize=1024)
def _by_name(name: str, among: tuple[str, ...] | None) -> str | None:
    for by in (lambda f: name in f.names, lambda f: f.name == "dotenv" and name.startswith(".env."), lambda f: "." in name and name.rsplit(".", 1)[-1] in f.extensions):
        if name and (hit := [f.name for f in _known(among) if by(f)]):
            return hit[-1]
    return None


def _surround(leaves: list[Leaf]) -> None:
    """Give leaves of formats without nesting of their own the objects that their paths name."""
    objects: dict[tuple[str, ...], Keys] = {}
    for leaf in leaves:
        if leaf.key is None or leaf.comment:
            continue
        names = leaf.keys if leaf.keys is not None else tuple(leaf.path.split("."))
        objects.setdefault(names[:-1], Keys()).append(leaf.key)
        leaf.around = tuple(objects.setdefault(names[:i], Keys()) for i in range(len(names)))


def parse(data: bytes, path: str | None = None, name: str | None = None, comments: bool = False, among: tuple[str, ...] | None = None) -> tuple[str, list[Leaf], str | None]:
    """(format, leaves, warning). A format that was only guessed falls back to text; a named one fails."""
    if name and name not in FORMATS:
        raise FormatError(f"unknown format {name!r}; known are {', '.join(FORMATS)}")
    chosen = name or choose(data, path, among)
    try:
        if chosen == "bplist":
            leaves = bplist_leaves(data)
        else:
            leaves = list(FORMATS[chosen].leaves(data.decode("utf-8", "surrogateescape" if chosen == "text" else "strict"), comments=comments))
    except (FormatError, UnicodeDecodeError, ImportError) as x:
        if name:
            raise FormatError(f"{chosen}: {x if isinstance(x, FormatError) else 'cannot be read'}") from None
        text = data.decode("utf-8", "surrogateescape")
        return "text", list(text_leaves(text)), f"{x if isinstance(x, FormatError) else 'not UTF-8'}; treating input as plain text"
    if chosen in ("toml", "ini", "dotenv", "properties", "hcl"):
        _surround(leaves)
    for leaf in leaves:
        if leaf.key is not None and leaf.around and not leaf.comment and len(leaf.value) < 200:
            leaf.around[-1].fields.append((leaf.key, leaf.value))
    return chosen, leaves, None


def encode(style: str, new: str) -> str:
    """A whole scalar for a new value."""
    if style in ('json"', "yaml", 'yaml"', "toml", "json'", "yaml'"):
        return json.dumps(new, ensure_ascii=False)
    if style == "hcl":
        return json.dumps(new, ensure_ascii=False).replace("${", "$${").replace("%{", "%%{")
    if style in ("xml", "attr"):
        body = new.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
        return f'"{body}"' if style == "attr" else body
    if style == "yaml|":
        return json.dumps(new, ensure_ascii=False) + "\n"
    if style == "properties":
        return re.sub(r"^ ", r"\\ ", new.replace("\\", "\\\\").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t").replace("\f", "\\f"))
    if style.startswith("dsv"):
        return '"' + new.replace('"', '""') + '"' if style == 'dsv"' or any(c in new for c in '"\r\n' + style[3:]) else new
    return new


def edit(value: str, edits: list[tuple[int, int, str]]) -> str:
    """A value with disjoint byte spans replaced."""
    raw, parts, at = value.encode("utf-8", "surrogateescape"), [], 0
    for a, b, token in sorted(edits):
        if a >= at:
            parts += [raw[at:a], token.encode()]
            at = b
    return b"".join([*parts, raw[at:]]).decode("utf-8", "surrogateescape")


def rewrite(data: bytes, chosen: str, leaves: list[Leaf] | dict[int, Leaf], edits: dict[int, list[tuple[int, int, str]]]) -> bytes:
    """The document with the edits of its leaves (by index); without edits, the very same bytes."""
    if not edits:
        return data
    if chosen == "bplist":
        return _bplist_render(data, {i: edit(leaves[i].value, e) for i, e in edits.items()})
    text = data.decode("utf-8", "surrogateescape" if chosen == "text" else "strict")
    parts, at = [], 0
    for i in sorted((i for i in edits if edits[i]), key=lambda i: leaves[i].start):
        leaf = leaves[i]
        raw, value = text[leaf.start : leaf.end], leaf.value
        new = edit(value, edits[i])
        inner = raw.find(value)
        if inner >= 0 and len(raw) - len(value) <= 2 and leaf.style != "yaml":
            out = raw[:inner] + new + raw[inner + len(value) :]
        else:
            out, whole = raw, leaf.style != "yaml"
            bytes_of = value.encode("utf-8", "surrogateescape")
            for a, b, token in edits[i]:
                old = bytes_of[a:b].decode("utf-8", "surrogateescape")
                whole &= raw.count(old) == 1 and value.count(old) == 1 and "\n" not in old
                out = out.replace(old, token, 1)
            out = out if whole else encode(leaf.style, new)
        parts += [text[at : leaf.start], out]
        at = leaf.end
    return "".join([*parts, text[at:]]).encode("utf-8", "surrogateescape")
