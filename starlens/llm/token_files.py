"""Token ids in bit-packed binary files.

Each id takes the least number of bits that the vocabulary needs.  Ids are
packed in blocks: 64 ids fill ``bits`` 64-bit words, so packing and unpacking
are ``64`` vector steps over all groups of a block, and every block starts at a
byte offset that the file lists.  A file holds a run of documents in ascending
order of their ids:

    header    magic, version, bits, ids in a block, ids, documents, blocks
    blocks    packed ids, little-endian 64-bit words; the last block is padded
    index     block offsets, then document ids, their NULL marks and first ids

and the header is followed by nothing that needs a second file to be read.
Files of one run are listed in a Parquet table that only names files of tasks
that succeeded, with the number of ids before each file; a file that a lost
task left behind is named nowhere and is never read.

Defined results: a NULL text counts as empty and holds the end id alone; NULL
document ids come first; rows with the same id stand in the order of their
texts' hashes, repeated rows side by side; texts of any length are written
whole (blocks, not documents, bound the memory of a reader); an empty table
gives no file and no rows; other columns are not read.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import Memo
from .common import map_arrow, shared_folder

MAGIC, VERSION = b"TOKBITS\x00", 1
HEADER = struct.Struct("<8sIIIQQQQ")  # magic, version, bits, block ids, ids, documents, blocks, index offset
BLOCK_IDS = 1 << 16
#: Texts of about this many bytes go into one file (and one task).
FILE_BYTES = 32 << 20
#: Pieces of text that a worker keeps ids for; beyond it the older ones go.
MEMO = 700_000
#: Latin letters, in the order of their code points.
LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha())


def bits_for(vocab_size: int) -> int:
    return max(1, int(vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as ``bits`` bits each; 64 ids make ``bits`` words, the last group is padded with zeros."""
    lanes = np.zeros((-(-len(ids) // 64) * 64,), np.uint64)
    lanes[: len(ids)] = ids
    lanes = lanes.reshape(-1, 64)
    words = np.zeros((len(lanes), bits), np.uint64)
    for i in range(64):
        w, s = divmod(i * bits, 64)
        words[:, w] |= lanes[:, i] << np.uint64(s)
        if s + bits > 64:
            words[:, w + 1] |= lanes[:, i] >> np.uint64(64 - s)
    return words.astype("<u8").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of a packed block."""
    words = np.frombuffer(data, "<u8").reshape(-1, bits)
    out = np.empty((len(words), 64), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for i in range(64):
        w, s = divmod(i * bits, 64)
        v = words[:, w] >> np.uint64(s)
        if s + bits > 64:
            v = v | words[:, w + 1] << np.uint64(64 - s)
        out[:, i] = v & mask
    return out.reshape(-1)[:n]


class TokenWriter:
    """Writes one file, block by block."""

    def __init__(self, stream, bits: int, block_ids: int = BLOCK_IDS):
        self.out, self.bits, self.block_ids = stream, bits, block_ids
        self.offsets: list[int] = []
        self.docs: list[int | None] = []
        self.starts: list[int] = []
        self.rest: list[np.ndarray] = []
        self.waiting = self.n = 0
        self.at = 0

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.starts.append(self.n)
        self.rest.append(ids)
        self.waiting += len(ids)
        self.n += len(ids)
        if self.waiting >= self.block_ids:
            flat = np.concatenate(self.rest)
            full = len(flat) // self.block_ids * self.block_ids
            for a in range(0, full, self.block_ids):
                self.offsets.append(self.at)
                self._put(pack(flat[a:a + self.block_ids], self.bits))
            self.rest, self.waiting = [flat[full:]], len(flat) - full

    def close(self) -> None:
        if self.waiting:
            self.offsets.append(self.at)
            self._put(pack(np.concatenate(self.rest), self.bits))
        index = self.at
        self._put(np.array(self.offsets, "<u8").tobytes())
        self._put(np.array([d or 0 for d in self.docs], "<i8").tobytes())
        self._put(np.array([d is None for d in self.docs], "<u1").tobytes())
        self._put(np.array(self.starts, "<u8").tobytes())
        # the header stands at the end, as streams cannot go back
        self._put(HEADER.pack(MAGIC, VERSION, self.bits, self.block_ids, self.n, len(self.docs),
                              len(self.offsets), index))
        self.out.close()


class TokenFile:
    """Random access to one file: any run of ids costs the blocks that hold it."""

    def __init__(self, path: str):
        fs, name = pafs.FileSystem.from_uri(path)
        self.f = fs.open_input_file(name)
        size = self.f.size()
        head = HEADER.unpack(self._read(size - HEADER.size, HEADER.size))
        magic, version, self.bits, self.block_ids, self.n, self.n_docs, blocks, index = head
        if magic != MAGIC or version != VERSION:
            raise ValueError(f"{path} is not a token file of this version")
        self.index = index
        raw = self._read(index, size - HEADER.size - index)
        self.offsets = np.frombuffer(raw, "<u8", blocks)
        at = 8 * blocks
        self.docs = np.frombuffer(raw, "<i8", self.n_docs, at)
        self.null = np.frombuffer(raw, "<u1", self.n_docs, at + 8 * self.n_docs).astype(bool)
        self.starts = np.frombuffer(raw, "<u8", self.n_docs, at + 9 * self.n_docs).astype(np.int64)

    def _read(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def block(self, k: int) -> np.ndarray:
        end = int(self.offsets[k + 1]) if k + 1 < len(self.offsets) else self.index
        n = min(self.block_ids, self.n - k * self.block_ids)
        return unpack(self._read(int(self.offsets[k]), end - int(self.offsets[k])), self.bits, n)

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids from ``a`` up to ``b`` of the file."""
        if a >= b:
            return np.zeros(0, np.uint32)
        first = a // self.block_ids
        parts = [self.block(k) for k in range(first, (b - 1) // self.block_ids + 1)]
        return np.concatenate(parts)[a - first * self.block_ids: b - first * self.block_ids]

    def document(self, k: int) -> np.ndarray:
        """Ids of the ``k``-th document of the file."""
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]) if k + 1 < self.n_docs else self.n)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first id, ids) in order; each block is unpacked once."""
        ends = np.append(self.starts[1:], self.n)
        held, low, k = np.zeros(0, np.uint32), 0, 0
        for d in range(self.n_docs):
            a, b = int(self.starts[d]), int(ends[d])
            parts = [held[a - low:]]
            have = low + len(held)
            while have < b:
                nxt = self.block(k)
                parts.append(nxt)
                k, have = k + 1, have + len(nxt)
            held, low = np.concatenate(parts) if len(parts) > 1 else parts[0], a
            yield (None if self.null[d] else int(self.docs[d])), a, held[: b - a]
        self.f.close()


class Uncertain(Exception):
    """White space that is no certain boundary."""


class TextEncoder:
    """Whole texts through the tokenizers library, each distinct piece once.

    A single space or line feed between two characters that are no white space
    is a certain boundary of byte-level vocabularies: the splitting pattern
    stops before the space, which belongs to the next piece, and on either side
    of the line feed.  Texts with any other white space go to the library whole;
    a piece is searched for such white space when it is first met.

    A piece of Latin letters alone goes straight to the library's model, where
    its splitting step would leave such a piece whole (asked once, of all these
    letters); ASCII punctuation at the end of a piece, behind a letter, is a
    piece of its own where that step says so (asked once too).  All other
    pieces go through the whole library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.vocab_size = self.tok.get_vocab_size(with_added_tokens=True)
        self.specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        split = self.tok.pre_tokenizer
        ask = (lambda text: [x for x, _ in split.pre_tokenize_str(text)]) if split is not None and self.tok.normalizer is None else list
        # the byte symbols of each letter, and of a space
        self.symbols = {ord(c): "".join(ask(c)) for c in LETTERS}
        sample = ask(" " + LETTERS)
        self.space = sample[0][0] if len(sample) == 1 and sample[0][1:] == LETTERS.translate(self.symbols) else None
        self.tail = punctuation if len(ask("aZ" + punctuation)) == 2 else ",."
        self.model = self.tok.model
        self.first = Memo(lambda piece: self.piece(self.first, "", piece))
        # behind a space, or with the line feed that starts a line
        self.rest = Memo(lambda piece: self.feed + self.first[piece[1:]] if piece[:1] == "\n" else self.piece(self.rest, " ", piece))
        self.feed, self.tails = self.whole("\n"), Memo(self.whole)

    def whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, memo: Memo, before: str, piece: str) -> bytes:
        """Ids of a piece of a text that holds no special token."""
        if piece.isalpha():  # neither white space nor punctuation
            plain = piece.isascii()
            if self.space and (plain or max(piece) <= LETTERS[-1]):
                symbols = piece if plain else piece.translate(self.symbols)
                return array("I", [t.id for t in self.model.tokenize(self.space + symbols if before else symbols)]).tobytes()
            return self.whole(before + piece)
        if piece.split() != [piece]:
            raise Uncertain
        # between a letter and the punctuation that ends the piece lies a boundary too
        core = piece.rstrip(self.tail)
        if core != piece and core[-1:].isalpha():
            return memo[core] + self.tails[piece[len(core):]]
        return self.whole(before + piece)

    def encode(self, text: str) -> bytes:
        for memo in (self.first, self.rest):
            if len(memo) > MEMO // 2:  # the older half goes
                for piece in list(islice(memo, len(memo) // 2)):
                    del memo[piece]
        if any(t in text for t in self.specials):
            return self.whole(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        try:
            return b"".join([self.first[first], *map(self.rest.__getitem__, rest)])
        except Uncertain:
            return self.whole(text)


_ENCODERS: dict[str, TextEncoder] = {}


def text_encoder(path: str) -> TextEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def write_token_files(docs: DataFrame, vocab_path: str, folder: str, end_id: int | None = None,
                      id_col: str = "doc_id", text_col: str = "text", vocab_size: int | None = None) -> DataFrame:
    """Encode all texts into files under ``folder``; the table of files, with the ids before each.

    Rows are dealt by ranges of the document id (then of the text's hash, so one
    repeated id is spread too) and sorted within a file.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn(
        "h", F.xxhash64("text"))
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions())
    order = [F.asc_nulls_first("id"), F.asc("h")]
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = text_encoder(vocab_path)
        bits = bits_for(vocab_size or enc.vocab_size)
        end = np.array([] if end_id is None else [end_id], "<u4")
        task = TaskContext.get()
        fs, base = pafs.FileSystem.from_uri(folder)
        out, n_files = [], 0
        writer, name, size = None, "", 0
        for b in batches:
            ids = b.column(0).to_pylist()
            for i in range(b.num_rows):
                if i % 256 == 0:
                    texts = b.column(1).slice(i, 256).to_numpy(zero_copy_only=False)
                if writer is None:
                    name = f"part-{task.partitionId():05d}-{n_files:04d}-{task.taskAttemptId()}.tok"
                    writer, size = TokenWriter(fs.open_output_stream(f"{base}/{name}"), bits), 0
                t = texts[i % 256]
                writer.add(ids[i], np.concatenate([np.frombuffer(enc.encode(t), "<u4"), end]))
                size += len(t)
                if size >= FILE_BYTES:
                    writer.close()
                    out.append((task.partitionId(), n_files, name, len(writer.docs), writer.n))
                    writer, n_files = None, n_files + 1
        if writer is not None:
            writer.close()
            out.append((task.partitionId(), n_files, name, len(writer.docs), writer.n))
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()),
             pa.array([f"{folder}/{o[2]}" for o in out], pa.string()), pa.array([o[3] for o in out], pa.int64()),
             pa.array([o[4] for o in out], pa.int64())], ["part", "seq", "path", "n_docs", "n_ids"])

    spark = docs.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)
    listed = f"{folder}/files"
    map_arrow(ranged, run, "part int, seq int, path string, n_docs long, n_ids long").write.parquet(listed)
    # one row for each file of about FILE_BYTES: the only frame that is ordered as a whole
    before = W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)
    files = spark.read.parquet(listed).withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    files.write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files under ``folder``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = ([], [], [], [])
                for doc, first, ids in TokenFile(path).documents():
                    crc = zlib.crc32(ids.astype("<u4").tobytes())
                    for col, x in zip(rows, (doc, before + first, len(ids), crc), strict=True):
                        col.append(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r, pa.int64()) for r in rows], ["doc_id", "start", "n_tokens", "ids_crc32"])
    files = spark.read.parquet(f"{folder}/index").select("path", "start")
    dealt = files.repartition(max(spark.sparkContext.defaultParallelism, files.rdd.getNumPartitions()), "path")
    return map_arrow(dealt, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, vocab_path: str, end_id: int | None = 2, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Write all texts as token files into the shared folder and read the documents back."""
    folder = shared_folder(docs.sparkSession, "tokens")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}"
    write_token_files(docs, vocab_path, folder, end_id, id_col, text_col)
    return read_token_files(docs.sparkSession, folder)
