"""Language-model scores from a subword lattice.

A text is its words, each with a word mark before it, then an end. The model draws pieces of a given vocabulary
independently; a word's probability is the sum over all segmentations into pieces, by forward recursion in log
space, so the document's is the marginal over every path through the lattice. (Pieces don't span words, so the
lattice of a document falls into those of its words.) The pieces and their first weights are an existing
vocabulary's. Where its scores are merge ranks and not log-probabilities, as in BPE files, Zipf's law makes weights of
them. One round over the training texts then replaces the weights by expected counts over all segmentations
(forward-backward), so no segmentation is singled out and the model follows the corpus.

Each distinct word goes once from each chunk of texts to the key range of its hash, where its count is summed and its
lattice is run once for the whole corpus: for the expected counts, and for the score that every chunk is answered.
The sorted distinct words of a range are walked as a trie, so words share the recursion of what they begin with.

Base scores are smoothed unigram word probabilities with counts over all training tokens.

Null and empty texts have only the end token. Repeated rows count as often as they occur; rows without an id train. A table without training
rows scores with smoothing alone; an empty table gives no rows. Columns other than the id and the text are not read.
Words and texts are taken whole, however long.
"""

from __future__ import annotations

import math
import uuid
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks, common

SCALE = 1e6  # expected counts travel as whole millionths, so their sums don't depend on the order


def held_out(doc_id: int | None) -> bool:
    """The fold of an id; a row without one is a training row."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


class Lattice:
    """Sums over segmentations of words into pieces with given natural log weights."""

    def __init__(self, pieces: dict[bytes, float]):
        self.pieces = pieces
        self.logs = list(pieces.values())
        #: Trie of the pieces read backwards: nodes of (children by byte, piece that ends there or -1).
        self.root: list = [{}, -1]
        for i, p in enumerate(pieces):
            node = self.root
            for byte in reversed(p):
                node = node[0].setdefault(byte, [{}, -1])
            node[1] = i

    def _walk(self, words: Iterable[bytes], leave=None) -> Iterator[tuple[bytes, array]]:
        """(word, forward sums) of sorted words, one prefix after the other.

        With leave, leave(i, sums, arcs) is called as node i of a path goes; arcs holds (start, piece) by turns.
        """
        alpha, before = array("d", [0.0]), b""
        arcs, ends = array("q"), array("q", [0])  # of the path's nodes, and where those of each node end
        exp, log, logs, root, none = math.exp, math.log, self.logs, self.root, -math.inf
        for word in words:
            shared, limit = 0, min(len(word), len(before))
            if before[:limit] == word[:limit]:
                shared = limit
            else:
                while word[shared] == before[shared]:
                    shared += 1
            if leave:
                for i in range(len(before), shared, -1):
                    leave(i, alpha, arcs[ends[i - 1] : ends[i]])
                del ends[shared + 1 :], arcs[ends[shared] :]
            del alpha[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                node, terms = root, []
                for j in range(i - 1, -1, -1):
                    node = node[0].get(word[j])
                    if node is None:
                        break
                    piece = node[1]
                    if piece >= 0:
                        terms.append(alpha[j] + logs[piece])
                        if leave:
                            arcs.append(j)
                            arcs.append(piece)
                if len(terms) == 1:
                    alpha.append(terms[0])
                elif terms and (top := max(terms)) > none:
                    alpha.append(top + log(sum([exp(t - top) for t in terms])))
                else:
                    alpha.append(none)
                if leave:
                    ends.append(len(arcs))
            before = word
            yield word, alpha
        if leave:
            for i in range(len(before), 0, -1):
                leave(i, alpha, arcs[ends[i - 1] : ends[i]])

    def score(self, words: list[bytes]) -> np.ndarray:
        """log10 marginal probability of each word."""
        order = sorted(range(len(words)), key=words.__getitem__)
        out = np.empty(len(words))
        for k, (_, alpha) in zip(order, self._walk(words[i] for i in order), strict=True):
            out[k] = alpha[-1]
        return out / math.log(10)

    def expected(self, counts: dict[bytes, int]) -> np.ndarray:
        """Expected number of each piece in words that occur so often.

        Paths are followed back from the ends of words: of what arrives at a node, a piece that ends there passes on its
        share of the forward sum, so nothing under- or overflows.
        """
        out = [0.0] * len(self.pieces)
        here = array("d", [0.0])
        exp, logs = math.exp, self.logs

        def leave(i: int, alpha: array, arcs: array) -> None:
            arrived = here.pop()
            if arrived:
                whole = alpha[i]
                for k in range(0, len(arcs), 2):
                    start, piece = arcs[k], arcs[k + 1]
                    share = arrived * exp(alpha[start] + logs[piece] - whole)
                    out[piece] += share
                    here[start] += share

        for word, alpha in self._walk(sorted(counts), leave):
            here.extend([0.0] * (len(alpha) - len(here)))
            if alpha[-1] > -math.inf:
                here[-1] += counts[word]
        return np.array(out)


def _piece_bytes(tok, i: int) -> bytes | None:
    """Bytes of piece i with the word mark as a space; None for control pieces and pieces no single word holds."""
    if tok.is_control(i) or tok.is_unknown(i) or tok.is_unused(i):
        return None
    if tok.is_byte(i):
        return bytes([int(tok.id_to_piece(i)[1:-1], 16)])
    raw = tok.id_to_piece(i).replace("▁", " ").encode()
    return raw if b" " not in raw[1:] else None


def first_weights(tok) -> dict[bytes, float]:
    """Weight of each piece's bytes from the vocabulary's scores: exp of a log-probability, or by rank 1 / (rank + 1).

    Pieces for single bytes, which have no rank, come last. Equal bytes add up.
    """
    every = [i for i in range(tok.get_piece_size()) if _piece_bytes(tok, i) is not None]
    scores = {i: tok.get_score(i) for i in every if not tok.is_byte(i)}
    ranked = all(s == int(s) for s in scores.values())
    least = min(scores.values(), default=0.0)
    weight: dict[bytes, float] = {}
    for i in every:
        score = scores.get(i, least)
        raw = _piece_bytes(tok, i)
        weight[raw] = weight.get(raw, 0.0) + (1 / (2 - score) if ranked else math.exp(score))
    weight.setdefault(b" ", min(weight.values()))
    for b in range(256):  # every word has a path
        weight.setdefault(bytes([b]), min(weight.values()))
    total = sum(weight.values())
    return {k: v / total for k, v in weight.items()}


def first_lattice(model_path: str) -> Lattice:
    import sentencepiece

    tok = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return Lattice({k: math.log(v) for k, v in first_weights(tok).items()})


def learnt_lattice(first: Lattice, counts: np.ndarray, ends: int) -> tuple[Lattice, float]:
    """Lattice and log10 probability of the end, from expected counts (in units of 1 / SCALE) plus one half."""
    weights = np.full(len(first.pieces), 0.5)
    weights[: len(counts)] += counts / SCALE
    total = float(weights.sum()) + ends + 0.5
    return Lattice({p: math.log(w / total) for p, w in zip(first.pieces, weights.tolist(), strict=True)}), math.log10((ends + 0.5) / total)


def _ordered(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Distinct words in order of hash, and the hashes. Words of one hash go by their bytes."""
    keys = np.array(list(map(xxhash.xxh64_intdigest, words)), np.uint64)
    order = np.argsort(keys)
    if (keys[order][1:] == keys[order][:-1]).any():
        order = np.array(sorted(range(len(words)), key=lambda i: (keys[i], words[i])))
    return [words[i] for i in order.tolist()], keys[order]


def _counted(ids: list[int], texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, int]:
    """Distinct words of a chunk in order of hash, the hashes, their training counts (0 for words of held-out texts
    only) and the number of training texts."""
    train: Counter = Counter()
    others: set[bytes] = set()
    ends = 0
    for doc, text in zip(ids, texts, strict=True):
        split = text.lower().split()
        if held_out(doc):
            others.update(split)
        else:
            train.update(split)
            ends += 1
    words, keys = _ordered([*train, *(others - train.keys())])
    return words, keys, np.fromiter((train.get(w, 0) for w in words), np.int64, len(words)), ends


def _pack(*parts: bytes) -> bytes:
    return zstandard.compress(np.array([len(parts), *map(len, parts)], np.int64).tobytes() + b"".join(parts), 1)


def _unpack(data: bytes) -> list[bytes]:
    raw = zstandard.decompress(data)
    n = int.from_bytes(raw[:8], "little")
    ends = np.cumsum(np.frombuffer(raw, np.int64, n, 8)) + 8 * (n + 1)
    return [raw[a:b] for a, b in zip([8 * (n + 1), *ends.tolist()], ends.tolist(), strict=False)]


def _batch(rows: list) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["kind", "part", "chunk", "data"])


ROWS = "kind int, part int, chunk long, data binary"


def _requests(table: DataFrame, parts: int) -> DataFrame:
    """kind 0: (range, chunk, distinct words and their training counts); kind 1: the number of a task's training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.held("lm")
        total = 0
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words, keys, counts, ends = _counted(*chunks.unpack(data.as_py()))
                total += ends
                rows = [(0, p, chunk, _pack(b" ".join(words[s]), counts[s].astype(np.uint32).tobytes())) for p, s in chunks.deal(keys, parts)]
                if rows:
                    yield _batch(rows)
        yield _batch([(1, -1, -1, np.array([0, total], np.int64).tobytes())])

    return common.materialize(table.mapInArrow(run, ROWS), "requests")


def _ranges(requests: DataFrame, model_path: str) -> DataFrame:
    """Of each key range, kind 0: its distinct words, their totals, and which of them each chunk asked for; kind 1:
    (tokens, distinct training words); kind 2: expected counts of pieces over its training words."""

    def handle(part: int, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        first = common.held(("lm", model_path), lambda: first_lattice(model_path))
        index: dict[bytes, int] = {}
        total, asked, sizes, places = np.zeros(1024, np.int64), [], [], []
        for chunk, data in rows:
            body, counts = _unpack(data)
            words = body.split(b" ")
            at = np.fromiter([index.setdefault(w, len(index)) for w in words], np.int32, len(words))
            if len(index) > len(total):
                total = np.concatenate([total, np.zeros(2 * len(index) - len(total), np.int64)])
            total[at] += np.frombuffer(counts, np.uint32)  # a chunk's words are distinct
            asked.append(chunk)
            sizes.append(len(at))
            places.append(at)
        total = total[: len(index)]
        expected = np.rint(first.expected({b" " + w: n for w, n in zip(index, total.tolist(), strict=True) if n}) * SCALE).astype(np.int64)
        at = np.flatnonzero(expected)
        numbers = [np.array(asked, np.int64), np.array(sizes, np.int64), np.concatenate(places)]
        yield _batch([
            (0, part, -1, _pack(b" ".join(index), total.tobytes(), *(x.tobytes() for x in numbers))),
            (1, part, -1, np.array([total.sum(), np.count_nonzero(total)], np.int64).tobytes()),
            (2, part, -1, at.astype(np.int64).tobytes() + expected[at].tobytes()),
        ])

    rows = requests.filter("kind = 0").select("part", "chunk", "data")
    return common.materialize(chunks.by_group(rows, "part", handle, ROWS, chunks.ranges(requests)), "ranges")


def _answers(ranges: DataFrame, model_path: str, learnt) -> DataFrame:
    """(chunk, data): range number, total and score of each word that a chunk asked a range for, in the order asked."""
    name, shared = learnt

    def make() -> tuple[Lattice, float]:
        return learnt_lattice(first_lattice(model_path), *shared.value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, _ = common.held(("lm", name), make)
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body, total, asked, sizes, places = _unpack(data.as_py())
                score = lattice.score([b" " + w for w in body.split(b" ")])
                total, places = np.frombuffer(total, np.int64), np.frombuffer(places, np.int32)
                ends = np.cumsum(np.frombuffer(sizes, np.int64))
                for chunk, a, b in zip(np.frombuffer(asked, np.int64).tolist(), [0, *ends.tolist()], ends.tolist(), strict=False):
                    at = places[a:b]
                    head = np.array([part], np.int64).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([head + _pack(total[at].tobytes(), score[at].tobytes())], pa.binary())], ["chunk", "data"])

    rows = ranges.filter("kind = 0").select("part", "data").repartition(chunks.ranges(ranges), "part")
    return rows.mapInArrow(run, "chunk long, data binary")


def _expected(ranges: DataFrame) -> np.ndarray:
    """Expected counts of all ranges, added up in tasks of which each hands on one array of the vocabulary's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                at, n = np.frombuffer(data, np.int64).reshape(2, -1)
                if len(at) and at[-1] >= len(total):
                    total = np.concatenate([total, np.zeros(at[-1] + 1 - len(total), np.int64)])
                total[at] += n
        if len(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["data"])

    tasks = max(4, math.isqrt(chunks.ranges(ranges)))
    parts = [np.frombuffer(r.data, np.int64) for r in ranges.filter("kind = 2").select("data", "part").repartition(tasks, "part").select("data").mapInArrow(run, "data binary").collect()]
    out = np.zeros(max(map(len, parts), default=0), np.int64)
    for part in parts:
        out[: len(part)] += part
    return out


def _sums(df: DataFrame, kind: int) -> DataFrame:
    """(a, b) pairs of the packed int64 halves of rows of a kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                both = np.frombuffer(data, np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    return df.filter(F.col("kind") == kind).select("data").mapInArrow(run, "a long, b long")


def score(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row; scores are log10."""
    docs = common.id_text(df, id_col, text_col)
    table = chunks.build(docs, "lm-chunks")
    requests = _requests(table, chunks.ranges(docs, 8))
    ends = _sums(requests, 1).agg(F.sum("b")).first()[0] or 0
    ranges = _ranges(requests, model_path)
    common.discard(requests)
    tokens, distinct = (x or 0 for x in _sums(ranges, 1).agg(F.sum("a"), F.sum("b")).first())
    tokens, distinct = tokens + ends, distinct + (ends > 0)
    counts = _expected(ranges)  # a number per piece
    learnt = uuid.uuid4().hex, df.sparkSession.sparkContext.broadcast((counts, ends))
    _, end_score = learnt_lattice(first_lattice(model_path), counts, ends)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    floor = math.log10(tokens + 0.1 * (distinct + 1))

    def handle(_chunk: int, data: bytes, got: list[bytes]) -> Iterator[pa.RecordBatch]:
        ids, texts = chunks.unpack(data)
        split = [text.lower().split() for text in texts]
        words, _ = _ordered(list(set().union(*split)))
        told = [_unpack(x[8:]) for x in sorted(got, key=lambda x: int.from_bytes(x[:8], "little"))]
        seen = np.append(np.frombuffer(b"".join(t for t, _ in told), np.int64), ends)
        base = np.log10(seen + 0.1) - floor
        marginal = np.append(np.frombuffer(b"".join(s for _, s in told), np.float64), end_score)
        index = {w: i for i, w in enumerate(words)}
        sizes = np.fromiter(map(len, split), np.int64, len(split)) + 1
        first = np.cumsum(sizes) - sizes
        at = np.full(int(sizes.sum()), len(words), np.int64)  # every text's last token is the end
        inside = np.ones(len(at), bool)
        inside[first + sizes - 1] = False
        at[inside] = np.fromiter(map(index.__getitem__, chain.from_iterable(split)), np.int64, len(at) - len(split))
        known = np.add.reduceat((seen > 0)[at], first, dtype=np.int64)
        columns = [ids, list(map(held_out, ids)), sizes, known, np.full(len(ids), tokens), np.add.reduceat(base[at], first), np.add.reduceat(marginal[at], first)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names)

    return chunks.with_answers(table, _answers(ranges, model_path, learnt), handle, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
