"""BPE encoding and decoding by a prefix-sharing trie.

Byte-pair encodings have a property that makes them linear to compute: each prefix of a word has one last
token, and a token t that ends at position i is that token exactly if (last token of the prefix before t, t)
is a pair that merging leaves apart. The distinct words of a batch are laid out as a trie (in sorted order a
depth-first walk of it); every node gets its last token from the states of the nodes above it, so a prefix that
many words share is encoded once. A word's encoding is read by following last tokens back to the root.

Null and empty texts have no tokens. Repeated rows give repeated rows; columns other than the id and the text
are not read. A text is encoded whole, however long; memory is bounded by the slices of `common.texts_of`, one
text, and word caches that keep what is in use when they are full. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from . import common

#: Fixed value: how byte-level vocabularies of this kind cut texts into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes that a cache takes up before what isn't in use is let go of, twice that in all; pairs known to stay apart.
CHUNK_CACHE, WORD_CACHE, PAIRS = 40 << 20, 20 << 20, 300_000
ENTRY = 180  # bytes of a cache entry besides its key and its ids
SLICE_BYTES = 4 << 20


class Cache(dict):
    """Encodings by key. When full it becomes the older one, from which what is asked for moves over."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.used, self.older = most, 0, {}

    def turn(self) -> None:
        """Called between batches, so that nothing is lost within one."""
        if self.used > self.most:
            self.older = dict(self)
            self.clear()
            self.used = 0

    def missing(self, keys: set) -> set:
        """The keys that aren't known; those of the older cache are taken over."""
        new = keys.difference(self)
        if self.older:
            for k in new & self.older.keys():
                self.put(k, self.older[k])
            new = {k for k in new if k not in self}
        return new

    def put(self, key, ids: bytes | None) -> None:
        self[key] = ids
        self.used += ENTRY + len(key[0] if isinstance(key, tuple) else key) + len(ids or b"")


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins that byte-level vocabularies write for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieBpe:
    """Encoder and decoder for a byte-level vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        raw = lambda s: bytes(map(alphabet.__getitem__, s))
        vocab = spec["model"]["vocab"]
        self.ids = {raw(k): v for k, v in vocab.items() if all(c in alphabet for c in k)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for content in self.special:
            self.ids.pop(content.encode(), None)
        top = max([*vocab.values(), *self.special.values()])
        self.bytes_of = [b""] * (top + 1)
        for k, v in self.ids.items():
            self.bytes_of[v] = k
        for k, v in self.special.items():
            self.bytes_of[v] = k.encode()
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.made = {new: (rank, a, b) for (a, b), (rank, new) in reversed(self.merges.items())}
        #: Trained merges only join what earlier ones made; then a token's edge nodes come and go in rank order.
        self.ordered = all(self.made.get(x, (-1,))[0] < rank for rank, a, b in self.made.values() for x in (a, b))
        self.left: dict[int, list[tuple[int, float]]] = {}
        self.right: dict[int, list[tuple[int, float]]] = {}
        self.longest = max(map(len, self.ids))
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        self.decimal = [str(i) for i in range(top + 1)]
        self.words = regex.compile(PATTERN).findall
        self.specials = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.apart: dict[int, bool] = {}
        self.cache, self.word_cache = Cache(CHUNK_CACHE), Cache(WORD_CACHE)  # ids as packed 32-bit numbers
        self.whole: dict[int, bool] = {}

    # -- the merge rule, used to judge pairs ------------------------------------------------------------
    def merge(self, data: bytes) -> list[int]:
        """Plain byte-pair merging of a short byte string: lowest rank first, leftmost first."""
        ids = [self.byte_ids[b] for b in data]
        while len(ids) > 1:
            best = min(((self.merges.get(p, (1 << 60,))[0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False))))
            if best[0] == 1 << 60:
                break
            i = best[1]
            ids[i : i + 2] = [self.merges[ids[i], ids[i + 1]][1]]
        return ids

    def edge(self, t: int, side: int) -> list[tuple[int, float]]:
        """Nodes on the left (1) or right (2) edge of t's merge tree, lowest first, each with the rank that ends it."""
        nodes, ends = [t], [float("inf")]
        while (m := self.made.get(nodes[-1])) is not None:
            nodes.append(m[side])
            ends.append(m[0])
        return list(zip(nodes, ends, strict=True))[::-1]

    def never_joined(self, a: int, b: int) -> bool:
        """Follow the two nodes beside the boundary through time: they join if their merge comes before the merge
        that takes a's node away (which lies to the left and wins a tie) and not after the one that takes b's."""
        if (right := self.right.get(a)) is None:
            right = self.right[a] = self.edge(a, 2)
        if (left := self.left.get(b)) is None:
            left = self.left[b] = self.edge(b, 1)
        i = j = 0
        merged = self.merges.get
        while True:
            (x, x_ends), (y, y_ends) = right[i], left[j]
            r = merged((x, y))
            if r is not None and r[0] < x_ends and r[0] <= y_ends:
                return False
            if x_ends <= y_ends:
                if x_ends == float("inf"):
                    return True
                i += 1
            else:
                j += 1

    def stays_apart(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) > PAIRS:
                self.apart.clear()
            known = self.is_whole(b) and self.never_joined(a, b) if self.ordered else self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
            self.apart[key] = known
        return known

    def is_whole(self, t: int) -> bool:
        """Whether merging t's own bytes gives t; other tokens never come out of merging."""
        known = self.whole.get(t)
        if known is None:
            known = self.whole[t] = self.merge(self.bytes_of[t]) == [t]
        return known

    # -- the trie ---------------------------------------------------------------------------------------
    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """Encodings of distinct words, packed. The sorted words are the trie's leaves in depth-first order; `last`
        and `start` hold the states of the current path, of which the shared prefix is kept."""
        out: dict[bytes, bytes] = {}
        get, apart, whole, longest, known = self.ids.get, self.stays_apart, self.is_whole, self.longest, self.apart
        before = b""
        last: list[int] = [-1]
        start: list[int] = [0]
        for word in sorted(words):
            n, shared = len(word), 0
            limit = min(n, len(before))
            if word[:limit] == before[:limit]:
                shared = limit
            else:
                while word[shared] == before[shared]:
                    shared += 1
            del last[shared + 1 :], start[shared + 1 :]
            for i in range(shared + 1, n + 1):
                # one start fits, so the likely ones come first: the token before grows, or a byte stands alone
                grow = j = start[i - 1]
                t = get(word[j:i])
                ok = t is not None and ((x if (x := known.get(last[j] << 32 | t)) is not None else apart(last[j], t)) if j else whole(t))
                if not ok:
                    j = i - 1
                    t = get(word[j:i])
                    ok = (x if (x := known.get(last[j] << 32 | t)) is not None else apart(last[j], t)) if j else whole(t)
                if not ok:
                    for j in chain(range(i - longest if i > longest else 0, grow), range(grow + 1, i - 1)):
                        t = get(word[j:i])
                        if t is not None and (apart(last[j], t) if j else whole(t)):
                            break
                last.append(t)
                start.append(j)
            ids, i = [], n
            while i:
                ids.append(last[i])
                i = start[i]
            out[word] = array("i", ids[::-1]).tobytes()
            before = word
        return out

    # -- texts ------------------------------------------------------------------------------------------
    def _plain(self, text: str) -> bytes:
        words = [w.encode() for w in self.words(text)]
        known = self.encode_words(set(words))
        return b"".join(map(known.__getitem__, words))

    def _slow(self, text: str) -> bytes:
        """Any text: special tokens first, then the word pattern over what lies between them."""
        parts = self.specials.split(text) if self.specials else [text]
        return b"".join(array("i", [self.special[p]]).tobytes() if p in self.special else self._plain(p) for p in parts if p)

    def _learn(self, chunks: set[str], spaced: bool) -> None:
        """Cache the ids of space-separated chunks; None marks one whose words depend on what precedes it."""
        parts: dict[str, list[bytes]] = {}
        lead = " " if spaced else ""
        for c in chunks:
            if spaced and (not c or c[0].isspace()):
                self.cache.put(c, None)
            elif c.isalpha():
                parts[c] = [(lead + c).encode()]
            else:
                parts[c] = [w.encode() for w in self.words(lead + c)]
        known = self.word_cache
        for w, ids in self.encode_words(known.missing({w for words in parts.values() for w in words})).items():
            known.put(w, ids)
        for c, words in parts.items():
            self.cache.put(c if spaced else (c,), b"".join(map(known.__getitem__, words)))

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """A word never spans the gap before a space that a non-space follows, so texts are split at spaces
        and whole chunks are looked up; texts with runs of white space or special tokens take the word pattern."""
        self.cache.turn()
        self.word_cache.turn()
        split = [None if any(s in t for s in self.special) else t.split(" ") for t in texts]
        rest: set[str] = set()
        first: set[tuple[str]] = set()
        for parts in split:
            if parts:
                first.add((parts[0],))
                rest.update(parts[1:])
        self._learn({c for (c,) in self.cache.missing(first)}, False)
        self._learn(self.cache.missing(rest), True)
        out, get = [], self.cache.__getitem__
        for text, parts in zip(texts, split, strict=True):
            try:
                if parts is None:
                    raise TypeError
                ids = self.cache[(parts[0],)] + b"".join(map(get, parts[1:]))
            except TypeError:  # a chunk that is None
                ids = self._slow(text)
            out.append(np.frombuffer(ids, np.int32))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def digest(self, ids: Iterable[int]) -> str:
        return hashlib.sha256(",".join(map(self.decimal.__getitem__, ids)).encode()).hexdigest()


def bpe(path: str) -> TrieBpe:
    """One encoder per vocabulary and Python worker."""
    return common.held(("bpe", path), lambda: TrieBpe(path))


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    """Arrow lists of packed ids, without a Python object per token."""
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int64).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, token_ids array<int>) of each row. No shuffle; the vocabulary path must exist on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(vocabulary)
        for ids, texts in common.texts_of(batches, SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _lists(coder.encode_batch(texts))], ["doc_id", "token_ids"])

    return common.id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, token_ids array<int>")


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """(doc_id, text) of each row of token ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(vocabulary)
        for batch in batches:
            texts = [coder.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return df.select(id_col, ids_col).toDF("doc_id", "token_ids").mapInArrow(run, "doc_id long, text string")


def add_tokens(df: DataFrame, vocabulary: str, text_col: str = "text", token_col: str = "token_ids", count_col: str = "n_tokens") -> DataFrame:
    """df with the token ids of each text and their number; a text that doesn't decode to itself again is an error."""
    at, taken = df.schema.fieldNames().index(text_col), {c.lower() for c in df.columns}
    while taken & {token_col.lower(), count_col.lower()}:  # columns of these names pass through
        token_col, count_col = f"{token_col}_", f"{count_col}_"
    schema = StructType([*df.schema.fields, StructField(token_col, ArrayType(IntegerType())), StructField(count_col, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(vocabulary)
        for batch in batches:
            for part in common.slices(batch, at, SLICE_BYTES):
                texts = [t or "" for t in part.column(at).to_pylist()]
                ids = coder.encode_batch(texts)
                for text, tokens in zip(texts, ids, strict=True):
                    if coder.decode(tokens.tolist()) != text:
                        raise ValueError("a text does not come back from its tokens")
                extra = [_lists(ids), pa.array(list(map(len, ids)), pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], [*part.schema.names, token_col, count_col])

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: (doc_id, n_tokens, ids_sha256, decoded_sha256, n_chars, is_lossless)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(vocabulary)
        for ids, texts in common.texts_of(batches, SLICE_BYTES):
            rows = []
            for doc, text, packed in zip(ids, texts, coder.encode_batch(texts), strict=True):
                tokens = packed.tolist()
                back = coder.decode(tokens)
                rows.append((doc, len(tokens), coder.digest(tokens), hashlib.sha256(back.encode()).hexdigest(), len(back), back == text))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_chars", "is_lossless"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
    return common.id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_chars long, is_lossless boolean")
