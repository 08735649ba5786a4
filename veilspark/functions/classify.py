"""Detection by token classification: pack a document's values, run a model over windows, decode its labels.

The model is any function from token ids to a row of scores per token; nothing is downloaded. Labels are `O` and, for
each category, B, I, E and S (begin, inside, end, single), in an order that the label list gives.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, fields
from itertools import accumulate
from pathlib import Path

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\n\n"
NAME = "privacy_filter"


@dataclass(frozen=True)
class Biases:
    """Added to the transitions of decoding: staying outside, going in, going on, ending, and what follows an end."""

    transition_bias_background_stay: float = 0.0
    transition_bias_background_to_start: float = 0.0
    transition_bias_inside_to_continue: float = 0.0
    transition_bias_inside_to_end: float = 0.0
    transition_bias_end_to_background: float = 0.0
    transition_bias_end_to_start: float = 0.0

    @classmethod
    def named(cls, point: str, calibration: str | None = None) -> Biases:
        """An operating point of a calibration file; the default one has none where there is no file."""
        if calibration is None or not Path(calibration).exists():
            if point == "default":
                return cls()
            raise ValueError(f"operating point {point!r}: there is no calibration file")
        points = json.loads(Path(calibration).read_text("utf-8")).get("operating_points", {})
        if point not in points:
            raise ValueError(f"operating point {point!r} is not in the calibration file")
        return cls(**points[point].get("biases", points[point]))

    @classmethod
    def of(cls, given: str | dict, calibration: str | None = None) -> Biases:
        if isinstance(given, str):
            return cls.named(given, calibration)
        names = {f.name for f in fields(cls)}
        if set(given) != names:
            raise ValueError(f"viterbi: needs exactly {', '.join(sorted(names))}")
        return cls(**{k: float(v) for k, v in given.items()})


def split_label(label: str) -> tuple[str, str]:
    """(B, I, E, S or O; category)."""
    tag, _, category = label.partition("-")
    return (tag, category) if tag in ("B", "I", "E", "S") and category else ("O", "")


def transitions(labels: list[str], biases: Biases) -> tuple[np.ndarray, np.ndarray]:
    """(score of going from label to label, score of beginning with a label); forbidden ones are minus infinity."""
    parts = [split_label(x) for x in labels]
    open_ = np.array([t in ("B", "I") for t, _ in parts])
    inner = np.array([t in ("I", "E") for t, _ in parts])
    start = np.array([t in ("B", "S") for t, _ in parts])
    outside = np.array([t == "O" for t, _ in parts])
    same = np.array([[a[1] == b[1] for b in parts] for a in parts])
    ends = np.array([t == "E" for t, _ in parts])
    b = biases
    inside = np.where(ends[None, :], b.transition_bias_inside_to_end, b.transition_bias_inside_to_continue)
    table = np.where(open_[:, None], np.where(inner[None, :] & same, inside, -np.inf), np.where(inner[None, :], -np.inf, 0.0))
    free = ~open_[:, None]
    table = np.where(free & outside[:, None] & outside[None, :], b.transition_bias_background_stay, table)
    table = np.where(free & outside[:, None] & start[None, :], b.transition_bias_background_to_start, table)
    table = np.where(free & ~outside[:, None] & outside[None, :], b.transition_bias_end_to_background, table)
    table = np.where(free & ~outside[:, None] & start[None, :], b.transition_bias_end_to_start, table)
    return table, np.where(inner, -np.inf, 0.0)


def viterbi(scores: np.ndarray, labels: list[str], biases: Biases | None = None) -> list[int]:
    """The best lawful sequence of labels for a row of scores per token. A span may not be left open at the end."""
    n = len(scores)
    if not n:
        return []
    table, first = transitions(labels, biases or Biases())
    last_ok = np.array([0.0 if split_label(x)[0] in ("O", "E", "S") else -np.inf for x in labels])
    logs = scores - np.logaddexp.reduce(scores, axis=1, keepdims=True)
    best, back = logs[0] + first, np.empty((n, len(labels)), np.int64)
    for t in range(1, n):
        ways = best[:, None] + table
        back[t] = ways.argmax(axis=0)
        best = ways.max(axis=0) + logs[t]
    path = [int((best + last_ok).argmax())]
    for t in range(n - 1, 0, -1):
        path.append(int(back[t, path[-1]]))
    return path[::-1]


@dataclass(frozen=True)
class Span:
    category: str
    score: float
    start: int
    end: int


def decode(path: list[int], scores: np.ndarray, labels: list[str]) -> list[Span]:
    """Spans of tokens by their labels, with the mean probability of those labels. An inside or end without a begin is
    passed over."""
    if not path:
        return []
    top = scores.max(axis=1, keepdims=True)
    chosen = np.exp(scores - top)
    chosen = chosen[np.arange(len(path)), path] / chosen.sum(axis=1)
    tags = [split_label(labels[i]) for i in path]
    out: list[Span] = []
    open_at: int | None = None
    done: list[tuple[int, int]] = []
    for t, (tag, category) in enumerate([*tags, ("O", "")]):
        goes_on = open_at is not None and tag in ("I", "E") and category == tags[open_at][1]
        if open_at is not None and not goes_on:
            done.append((open_at, t))
            open_at = None
        if goes_on and tag == "E":
            done.append((open_at, t + 1))
            open_at = None
        elif tag == "B":
            open_at = t
        elif tag == "S":
            done.append((t, t + 1))
    for a, b in done:
        out.append(Span(tags[a][1], float(chosen[a:b].mean()), a, b))
    return out


def windows(n: int, size: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(first, end, owned from, owned to) of windows over n tokens; each token is owned by one window, and seen with
    `overlap` tokens on both sides of what is owned."""
    if n <= size:
        return [(0, n, 0, n)]
    step = size - 2 * overlap
    if step < 1:
        raise ValueError("windows: the overlap leaves no room")
    return [(max(a - overlap, 0), min(a + step + overlap, n), a, min(a + step, n)) for a in range(0, n, step)]


def windows_column(n: Column, size: int, overlap: int) -> Column:
    """The same as an array of structs, natively, for token counts in a column."""
    step = size - 2 * overlap
    if step < 1:
        raise ValueError("windows: the overlap leaves no room")
    named = lambda a, b, c, d: F.struct(a.cast("int").alias("first"), b.cast("int").alias("end"), c.cast("int").alias("owned_from"), d.cast("int").alias("owned_to"))
    one = F.array(named(F.lit(0), n, F.lit(0), n))
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))
    many = F.transform(starts, lambda a: named(F.greatest(a - overlap, F.lit(0)), F.least(a + step + overlap, n), a, F.least(a + step, n)))
    return F.when(n <= size, one).otherwise(many)


@dataclass
class Packed:
    """A document's values as one text, each behind its key or path, and where in characters each stands."""

    text: str = ""
    values: list[tuple[int, int]] = field(default_factory=list)

    @classmethod
    def of(cls, values: Iterable[tuple[str, str | None, str]], context: str = "key") -> Packed:
        """From (value, key, path) of each; context is none, key or path."""
        parts, ranges, at = [], [], 0
        for value, key, path in values:
            name = {"none": None, "key": key, "path": path or key}[context]
            lead = (SEPARATOR if at else "") + (f"{name}: " if name is not None else "")
            ranges.append((at + len(lead), at + len(lead) + len(value)))
            parts += [lead, value]
            at = ranges[-1][1]
        return cls("".join(parts), ranges)

    def locate(self, start: int, end: int) -> list[tuple[int, int, int]]:
        """(value number, start, end within it) of the parts of a stretch that fall inside values."""
        first = bisect_right([b for _, b in self.values], start)
        out = []
        for i in range(first, len(self.values)):
            a, b = self.values[i]
            if a >= end:
                break
            if max(a, start) < min(b, end):
                out.append((i, max(a, start) - a, min(b, end) - a))
        return out


def trimmed(value: str, start: int, end: int) -> tuple[int, int]:
    """The stretch without white space at its ends."""
    part = value[start:end]
    head = len(part) - len(part.lstrip())
    return start + head, max(start + head, end - (len(part) - len(part.rstrip())))


@dataclass(frozen=True)
class Model:
    """tokenize(text) -> (ids, (start, end) character offsets); scores(ids) -> array of tokens x labels."""

    labels: tuple[str, ...]
    tokenize: Callable[[str], tuple[list[int], list[tuple[int, int]]]]
    scores: Callable[[list[int]], np.ndarray]


def detect(model: Model, values: list[tuple[str, str | None, str]], max_tokens: int = 1024, overlap: int = 128, min_score: float = 0.5, categories: Iterable[str] | None = None, context: str = "key", biases: Biases | None = None) -> list[list[tuple[int, int, str]]]:
    """Spans (start, end, label) in bytes for each of a document's values (value, key, path)."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in values]
    packed = Packed.of(values, context)
    if not packed.text:
        return out
    wanted = None if categories is None else set(categories)
    ids, offsets = model.tokenize(packed.text)
    labels = list(model.labels)
    for first, end, low, high in windows(len(ids), max_tokens, overlap):
        scores = np.asarray(model.scores(ids[first:end]), np.float64)
        for s in decode(viterbi(scores, labels, biases), scores, labels):
            if not low <= first + s.start < high or s.score < min_score or wanted is not None and s.category not in wanted:
                continue
            for i, a, b in packed.locate(offsets[first + s.start][0], offsets[first + s.end - 1][1]):
                a, b = trimmed(values[i][0], a, b)
                if a < b:
                    size = list(accumulate(len(values[i][0][x:y].encode()) for x, y in ((0, a), (a, b))))
                    out[i].append((size[0], size[1], f"{NAME}:{s.category}"))
    return out


_models: dict[str, Model] = {}


def detector(load: Callable[[], Model], **options):
    """A detector over whole documents; load() is called once in each worker."""
    from ..operators.detection import Detector

    key = uuid.uuid4().hex

    def find(leaves: list) -> list[list[tuple[int, int, str]]]:
        if key not in _models:
            _models[key] = load()
        return detect(_models[key], [(x.value, x.key, x.path) for x in leaves], **options)

    return Detector(NAME, document=find)


def onnx_model(folder: str) -> Model:
    """A model folder: model.onnx, tokenizer.json and config.json with id2label. The file is the user's own."""
    import onnxruntime
    from tokenizers import Tokenizer

    at = Path(folder)
    config = json.loads((at / "config.json").read_text("utf-8"))
    labels = tuple(config["id2label"][str(i)] for i in range(len(config["id2label"])))
    coder = Tokenizer.from_file(str(at / "tokenizer.json"))
    session = onnxruntime.InferenceSession(str(at / "model.onnx"))
    names = [x.name for x in session.get_inputs()]

    def tokenize(text: str) -> tuple[list[int], list[tuple[int, int]]]:
        e = coder.encode(text, add_special_tokens=False)
        return e.ids, e.offsets

    def scores(ids: list[int]) -> np.ndarray:
        given = {n: np.array([ids], np.int64) if n == "input_ids" else np.ones((1, len(ids)), np.int64) for n in names}
        return session.run(None, given)[0][0]

    return Model(labels, tokenize, scores)
