"""BPE encoding and decoding with forced boundaries.

A pair of adjacent bytes that occurs inside no vocabulary token can never be
joined by a merge, so a cut between them is certain.  Texts are cut at all such
pairs, the fragments are encoded independently (each distinct one once, from a
bounded memo), and the ids are concatenated.

The vocabulary file's splitting pattern looks at the characters around a place,
so on the text a certain cut must also be one that the pattern agrees with:
the byte before it is not white space, the place is a character boundary, and
no contraction starts there.  Inside a fragment the pattern is applied, and its
pieces are cut again at every forced pair of bytes, characters or not, before
the merges.

Defined results: a NULL text counts as empty, an empty text has no ids; repeated
rows and NULL ids are kept row by row; texts of any length are encoded whole;
the result has the id and the columns named below, so clashes cannot arise; an
empty table gives no rows.  Ids outside the vocabulary are an error on decoding.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Splitting pattern of byte-level vocabulary files.  Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space beyond ASCII; a text with any is not cut after bytes beyond ASCII.
WIDE_SPACE = regex.compile(r"[^\x00-\x7F&&\s]", regex.V1)
#: Distinct fragments that a worker keeps; beyond it the memo starts anew.
MEMO = 500_000


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabulary files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Memo(dict):
    """A dict that makes its missing values and keeps those of short keys."""

    def __init__(self, make: Callable):
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= 128:
            self[key] = value
        return value


class Vocabulary:
    """Tokens, merges and the table of certain cuts of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_alphabet()
        raw = lambda s: bytes(to_byte[c] for c in s)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.added}
        self.ids = {raw(t): i for t, i in vocab.items()}
        self.size = max([*vocab.values(), *self.added.values()]) + 1
        self.tokens: list[bytes | None] = [None] * self.size
        for t, i in self.ids.items():
            self.tokens[i] = t
        for t, i in self.added.items():
            self.tokens[i] = t.encode()
        # rank of each pair (left id * size + right id), and the token that each rank makes
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for m in spec["model"]["merges"]:
            a, b = map(raw, m.split(" ") if isinstance(m, str) else m)
            self.rank[self.ids[a] * self.size + self.ids[b]] = len(self.merged)
            self.merged.append(self.ids[a + b])
        self.single = [self.ids[bytes([b])] for b in range(256)]
        # pairs that stand inside some token; all others are forced
        inside = np.zeros(1 << 16, bool)
        for t in self.ids:
            v = np.frombuffer(t, np.uint8).astype(np.int32)
            inside[v[:-1] << 8 | v[1:]] = True
        self.forced = ~inside
        self.forced_bytes = self.forced.tobytes()
        first, second = np.arange(1 << 16) >> 8, np.arange(1 << 16) & 255
        space = np.isin(first, [0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)])
        # on the text: after no white space, at a character, before no contraction
        self.text_cut = self.forced & ~space & ((second < 0x80) | (second >= 0xC0)) & (second != 0x27)
        self.ascii_cut = self.text_cut & (first < 0x80)
        self.added_split = regex.compile("(" + "|".join(map(regex.escape, sorted(
            self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pattern = regex.compile(PATTERN)
        self.memo = Memo(self.encode_fragment)

    def fragments(self, text: str) -> list[bytes]:
        """The text cut at every place where the cut is certain."""
        data = text.encode("utf-8", "surrogatepass")
        if len(data) < 2:
            return [data] if data else []
        v = np.frombuffer(data, np.uint8).astype(np.uint16)
        table = self.text_cut if text.isascii() or not WIDE_SPACE.search(text) else self.ascii_cut
        cuts = np.flatnonzero(table[v[:-1] << 8 | v[1:]]) + 1
        at = [0, *cuts.tolist(), len(data)]
        return [data[a:b] for a, b in zip(at, at[1:])]

    def encode_fragment(self, fragment: bytes) -> bytes:
        """Ids of one fragment as little-endian 32-bit integers."""
        body = fragment[1:] if fragment[:1] == b" " else fragment
        if body.isalpha():  # ASCII letters only: one piece of the pattern
            pieces = [fragment]
        else:
            pieces = [p.encode("utf-8", "surrogatepass")
                      for p in self.pattern.findall(fragment.decode("utf-8", "surrogatepass"))]
        out: list[int] = []
        forced = self.forced_bytes
        for raw in pieces:
            if len(raw) > 32:
                v = np.frombuffer(raw, np.uint8).astype(np.uint16)
                cuts = (np.flatnonzero(self.forced[v[:-1] << 8 | v[1:]]) + 1).tolist()
            else:
                cuts = [i + 1 for i in range(len(raw) - 1) if forced[raw[i] << 8 | raw[i + 1]]]
            if cuts:
                at = [0, *cuts, len(raw)]
                for a, b in zip(at, at[1:]):
                    out += self.merge(raw[a:b])
            else:
                out += self.merge(raw)
        return array("I", out).tobytes()

    def merge(self, raw: bytes) -> list[int]:
        """Byte pair merges, lowest rank first and leftmost among equals."""
        single, rank, merged, size = self.single, self.rank.get, self.merged, self.size
        ids = [single[b] for b in raw]
        if len(ids) > 48:
            return self._merge_long(ids)
        none = len(merged)
        near = [rank(a * size + b, none) for a, b in zip(ids, ids[1:])]
        while near:
            low = min(near)
            if low == none:
                break
            i = near.index(low)
            ids[i] = new = merged[low]
            del ids[i + 1], near[i]
            if i:
                near[i - 1] = rank(ids[i - 1] * size + new, none)
            if i < len(near):
                near[i] = rank(new * size + ids[i + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same for long fragments, with a heap over a linked list."""
        n, rank, merged, size = len(ids), self.rank.get, self.merged, self.size
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := rank(a * size + b)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or rank(ids[i] * size + ids[j]) != r:
                continue
            ids[i], ids[j] = merged[r], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (r := rank(ids[left] * size + ids[right])) is not None:
                    heapq.heappush(heap, (r, left))
        return [i for i in ids if i >= 0]

    def segments(self, text: str) -> list[str]:
        """Texts and added tokens in turn: the odd places hold added tokens."""
        if self.added_split is None or not any(t in text for t in self.added):
            return [text]
        return self.added_split.split(text)

    def encode(self, text: str) -> bytes:
        out = []
        for i, part in enumerate(self.segments(text)):
            if i % 2:
                out.append(np.uint32(self.added[part]).tobytes())
                continue
            fragments = self.fragments(part)
            out += map(self.memo.__getitem__, fragments)
            if len(self.memo) > MEMO:
                self.memo.clear()
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, loaded once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def encode_texts(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids) of every text; a text that its ids do not decode to is an error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocab_path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [t.as_py() or "" for t in part.column(1)]
                raw = [v.encode(t) for t in texts]
                for t, r in zip(texts, raw, strict=True):
                    if v.decode(r) != t:
                        raise ValueError("the ids of a text do not decode to it")
                flat = np.frombuffer(b"".join(raw), "<u4").astype(np.int32)
                n = np.array([len(r) // 4 for r in raw], np.int64)
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.ListArray.from_arrays(
                    pa.array(offsets), pa.array(flat))], ["id", "n_tokens", "ids"])
    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run,
                     "id long, n_tokens long, ids array<int>").withColumnRenamed("id", id_col)


def decode_ids(rows: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the text of every list of ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocab_path)
        for b in batches:
            texts = [v.decode(np.array(x.as_py() or [], "<u4").tobytes()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])
    return map_arrow(rows.select(F.col(id_col).cast("long"), F.col(ids_col).cast("array<int>")), run,
                     "id long, text string").withColumnRenamed("id", id_col)


def encode_digests(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Round trip of every text in one pass: n_tokens, ids_sha256, decoded_sha256."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocab_path)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                n, a, d = [], [], []
                for t in part.column(1):
                    ids = v.encode(t.as_py() or "")
                    n.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest())
                    d.append(hashlib.sha256(v.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())],
                    ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run,
                     "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
                     ).withColumnRenamed("id", id_col)
