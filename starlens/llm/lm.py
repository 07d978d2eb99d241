"""Language-model scoring with a probabilistic suffix tree over words.

A text is read as its lower-cased words and an end mark, after a start mark.
Contexts are the up to ``DEPTH`` words (or start mark) before a symbol.  The tree grows
from the root: a context is a candidate if it stands at ``min_count`` training
places or more, the context without its last word is a candidate too and its
longest proper suffix is kept; it is kept itself if its next-symbol
distribution diverges from that of this suffix (Kullback-Leibler divergence, and its
likelihood-ratio statistic against the number of symbols).  The root is the unigram
base with one added to each count; a kept context is smoothed towards its suffix by
as many virtual counts as it has distinct symbols (Witten-Bell).  Each symbol is
scored in the state of its longest kept context.

The count is the same for a corpus of any size, so the tree grows with the corpus and is
a table, never gathered or broadcast, and no filter of a fixed size stands before it.
Texts are staged in blocks of about ``BLOCK_BYTES`` (up to a third more).  Each level of the tree is one pass:
a block sends its distinct sequences with their counts, a shuffle adds them up, and the
totals return in the order in which the block sent them, without codes.  From totals and
kept contexts of the levels before, a block knows exactly which of its places the next level
counts (not those whose context cannot be kept and whose sequence cannot be a candidate), and which of its sequences stand in no other block: a sequence whose suffix stands in one
block alone does too.  Such ones only join the sums of their context, and a context of one
block alone is judged there and not sent.

The first pass tells words apart by the xxHash64 of each and numbers all words of several
blocks; in later ones, which no longer carry these codes, a symbol is its number and a context a
64-bit polynomial of the numbers of its words (chance of any two of s codes alike: s * s / 2^65).
Counts meet in buckets, packed; there are about as many as blocks, and the symbols of a
context of over ``SPLIT`` training places are dealt over as many buckets as its places need.

Defined results: a NULL text counts as empty and holds the end mark alone; NULL
ids and repeated rows are scored row by row; a text of any length is read whole
(one longer than a block is a block); with no training text every count and
every score is zero; an empty table gives no rows; columns other than id, text and the
training mark are not read.
"""

from __future__ import annotations

from array import array
from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, ship, staged

DEPTH = 3
BLOCK_BYTES = 8 << 20
#: Training places of a candidate context, in a corpus of any size.
MIN_COUNT = 20
START, END = b"\n\n", b"\n"  # never words
FACTOR = np.uint64(0x9E3779B97F4A7C15)  # odd: 2^64 over the golden ratio
#: A context of so many training places at most is summed up in one bucket; a larger one is split by its symbols.
SPLIT = 100_000
#: A block's part of the sum of a context travels as a whole number of this fraction (error of the sum: blocks / 2^31).
UNITS = 1 << 30
BLOCK = ("block long, ids array<long>, train array<boolean>, sizes array<long>, symbols binary, codes binary, "
         "counts binary, often binary")
SENT = "bucket long, block long, contexts binary, pack binary"
ANSWER = "block long, bucket long, totals binary, states binary, ctx long, n long, symbols long, s double"
WORDS = "block long, bucket long, totals binary, n long, symbols long"


def normal(text: str | None) -> bytes:
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())

def stage_blocks(docs: DataFrame, id_col: str, text_col: str, train: Column) -> DataFrame:
    """A row per block, as written files: (block, ids, train, sizes, symbols, codes, counts, often).

    ``sizes`` are the texts' symbols with the end mark; ``symbols`` of all texts, each behind a start mark, stand
    compressed as 32-bit numbers within the block: 0 the start mark, 1 the end mark, then its words, the most frequent
    first, equally frequent ones by code.  ``codes`` of the words, their training ``counts`` and how ``often`` they stand
    in the block (255 at most) are in ascending order of the codes, so that ``often`` alone tells the numbers.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        press = zstandard.ZstdCompressor()
        texts, held = deque(), 0

        def flush(size: int) -> pa.RecordBatch:
            """The block of the first texts of up to ``size`` bytes, one at least."""
            nonlocal block, held
            ids, marks, sizes, symbols, index, left = [], [], [], array("i"), {START: 0, END: 1}, size
            while texts and (not ids or len(texts[0][2]) < left):
                doc, mark, seq = texts.popleft()
                words = seq.split()
                symbols.append(0)
                symbols.extend([index.setdefault(w, len(index)) for w in words])
                symbols.append(1)
                ids.append(doc)
                marks.append(mark)
                sizes.append(len(words) + 1)
                left -= len(seq) + 1
            held -= size - left
            block += 1
            sent = np.frombuffer(symbols, np.int32)
            counts = np.bincount(sent[np.repeat(np.array(marks, bool), np.array(sizes) + 1)], minlength=len(index))
            codes = np.fromiter(map(xxhash.xxh64_intdigest, index), np.uint64, len(index))
            by_code = np.argsort(codes[2:]) + 2
            often = np.minimum(np.bincount(sent, minlength=len(index))[by_code], 255).astype(np.uint8)
            number = np.arange(len(index), dtype=np.int32)
            number[by_code[by_frequency(often)]] = np.arange(2, len(index))
            return pa.RecordBatch.from_pydict({
                "block": pa.array([block - 1], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())),
                "train": pa.array([marks], pa.list_(pa.bool_())), "sizes": pa.array([sizes], pa.list_(pa.int64())),
                "symbols": pa.array([press.compress(planes(number[sent]))], pa.binary()),
                "codes": pa.array([packed(codes[by_code])], pa.binary()),
                "counts": pa.array([packed(counts[by_code])], pa.binary()),
                "often": pa.array([press.compress(often.tobytes())], pa.binary())})
        for b in batches:
            for doc, text, mark in zip(*b.columns, strict=True):
                texts.append((doc.as_py(), mark.as_py(), normal(text.as_py())))
                held += len(texts[-1][2]) + 1
                while held > BLOCK_BYTES + BLOCK_BYTES // 3 and len(texts) > 1:
                    yield flush(BLOCK_BYTES)
        if texts:  # a short rest joins the last block, as each block sends its sequences
            yield flush(held)
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"),
                       F.coalesce(train, F.lit(False)).alias("train"))
    return staged(map_arrow(rows, run, BLOCK), "lm-blocks")


class Level(NamedTuple):
    """The places of a block that one level of the tree counts, and their distinct sequences of context and symbol.

    Sequences are in ascending order of context and symbol number.
    """
    places: np.ndarray
    group: np.ndarray   # number of the sequence at each place
    ctx: np.ndarray     # number of the context of each sequence
    first: np.ndarray   # first sequence of each context
    sent: np.ndarray    # per sequence: whether other blocks hold its context
    known: np.ndarray   # per sequence: whether its total is the block's own count
    args: tuple         # arguments of ``send`` behind the buckets, for the sequences that are sent
    counts: np.ndarray  # training places of each sequence in this block
    ctx_total: np.ndarray  # training places in all blocks of the context of each sequence


class Block:
    """The symbols of one block's texts, one after another, each text behind a start mark."""

    def __init__(self, row: pa.Table, found: pa.Table, ends: int, buckets: int, split: int):
        """``found`` holds the answers to the block."""
        take = lambda c: row.column(c).combine_chunks().flatten()
        expand = lambda c: zstandard.ZstdDecompressor().decompress(row.column(c)[0].as_py())
        symbols = unplaned(expand("symbols"), np.int32)
        self.sizes = take("sizes").to_numpy()
        self.starts = np.cumsum([0, *(self.sizes[:-1] + 1)])
        self.trained = np.repeat(take("train").to_numpy(zero_copy_only=False), self.sizes + 1)
        self.at = np.arange(len(symbols)) - np.repeat(self.starts, self.sizes + 1) - 1  # -1: the start mark
        self.found, self.buckets, self.split = found.sort_by("bucket"), buckets, split
        # of each word: places in other blocks, number among all words (0: the block's own)
        more, number = unpacked(self.answers(0).column("totals"), 2)[:, by_frequency(np.frombuffer(expand("often"), np.uint8))]
        shared = np.concatenate([[True, True], number > 0])
        ids = np.concatenate([[0, 1], number])
        ids[~shared] = ids.max() + 1 + np.arange((~shared).sum())
        total = np.bincount(symbols[self.trained], minlength=len(ids)) + np.concatenate([[0, 0], more])
        total[:2] = ends
        order = np.argsort(ids)  # from here on the block's numbers are in order of those among all words
        mine = np.empty(len(ids), np.int64)
        mine[order] = np.arange(len(ids))
        self.symbol, self.ids = mine[symbols], ids[order]
        self.total, self.shared, self.code = total[symbols], shared[symbols], mixed(ids.astype(np.uint64))[symbols]

    def answers(self, k: int) -> pa.Table:
        return self.found.filter(pc.equal(self.found.column("k"), k))

    def levels(self, depth: int, min_count: int, n: int, min_divergence: float,
               counting: int = 0) -> Iterator[tuple[Level, np.ndarray, np.ndarray]]:
        """Levels 1 to ``depth``; each with the total of the sequence, and the distinct symbols of the kept context (0: not
        kept), at each place.  Level ``counting`` has not been answered; it comes without these, as the last.
        """
        code, total, shared, no, counted = self.code, self.total, self.shared, self.symbol, np.ones(len(self.code), bool)
        suffix_kept, suffix_total = counted, np.full(len(self.code), n)
        before = lambda x: np.concatenate([x[:1], x[:-1]])
        for k in range(1, depth + 1):
            ctx_total, ctx_code = before(total), before(code)
            may = may_keep(ctx_total, suffix_total, min_divergence)
            places = np.flatnonzero((self.at >= k - 1) & before(counted) & (ctx_total >= min_count) & suffix_kept
                                    & (may | ((k < depth) & (total >= min_count))))
            keys, first, group = distinct(before(no)[places] << 32 | self.symbol[places])
            counts = np.bincount(group[self.trained[places]], minlength=len(keys))
            at = places[first]
            symbol, up = self.ids[keys & 0xFFFFFFFF], total[at]
            new = np.append(True, keys[1:] >> 32 != keys[:-1] >> 32)[:len(keys)]
            sent = before(shared)[at]
            known = ~sent | ~shared[at] | (up == 0)
            level = Level(places, group, np.cumsum(new) - 1, np.flatnonzero(new), sent, known, tuple(x[sent] for x in (
                ctx_code[at], ctx_total[at], suffix_total[at], up, symbol.astype(np.uint64), counts, known)),
                counts, ctx_total[at])
            if k == counting:
                yield level, None, None
                return
            totals, elsewhere, states = self.answered(level, k)
            own = ~sent[level.first]
            n_of, symbols_of, s = judged(level.ctx, counts, counts, up, suffix_total[at], len(level.first))
            of_own = np.where(keeps(n_of, symbols_of, s - xlogx(n_of), min_divergence), symbols_of, 0)
            of_kept = np.where(own, of_own, states)[level.ctx[group]] * may[places]
            level_total = totals[group]
            suffix_total = ctx_total
            code = self.code + FACTOR * ctx_code
            total, no = np.zeros((2, len(code)), np.int64)
            shared, counted, suffix_kept = np.zeros((3, len(code)), bool)
            total[places], no[places], shared[places] = level_total, group, elsewhere[group]
            counted[places], suffix_kept[places] = True, of_kept > 0
            yield level, level_total, of_kept

    def answered(self, level: Level, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each sequence its total and whether other blocks hold it, of each context its symbols if it is kept."""
        mine = self.answers(k)
        packs = mine.filter(pc.is_valid(mine.column("totals")))
        totals, elsewhere = level.counts.copy(), np.zeros(len(level.counts), bool)
        states = np.zeros(len(level.first), np.int64)
        ctx_code, ctx_total, _, _, symbol, _, known = level.args
        _, order, unit = dealt(self.buckets, ctx_code, ctx_total, symbol, known, self.split)
        rows = np.flatnonzero(level.sent)[order]
        listed = rows[~level.known[rows]]
        more, = unpacked(packs.column("totals"), 1)
        totals[listed] += np.maximum(more - 1, 0)
        elsewhere[listed] = more > 0
        of_unit, = unpacked(packs.column("states"), 1)
        states[level.ctx[rows[unit]]] = of_unit
        large = mine.filter(pc.is_valid(mine.column("ctx")))
        symbols = dict(zip(large.column("ctx").to_pylist(), large.column("symbols").to_pylist(), strict=True))
        parts = ctx_code[order][unit].view(np.int64)
        at = np.flatnonzero(np.isin(parts, np.array([*symbols], np.int64)))
        states[level.ctx[rows[unit[at]]]] = [symbols[c] for c in parts[at].tolist()]
        return totals, elsewhere, states


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct codes in ascending order, a place of each, and the number of the one at each place."""
    order = np.argsort(codes)
    inorder = codes[order]
    new = np.append(True, inorder[1:] != inorder[:-1])[:len(codes)]
    group = np.empty(len(codes), np.int64)
    group[order] = np.cumsum(new) - 1
    return inorder[new], order[new], group


def by_frequency(often: np.ndarray) -> np.ndarray:
    """Words (as places in the order of their codes) in the order of their numbers."""
    return np.argsort(255 - often, kind="stable")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads neighbours (SplitMix64)."""
    x = (x + np.uint64(1)) * FACTOR
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def planes(x: np.ndarray) -> bytes:
    """All first bytes, then all second ones and so on: these compress far better than whole numbers."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def unplaned(x: bytes, dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def packed(*columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(planes(np.concatenate([c.view(np.int64) for c in columns])))


def unpacked(packs: pa.ChunkedArray, width: int) -> np.ndarray:
    """``width`` columns, the rows of all packs one after another."""
    expand = zstandard.ZstdDecompressor()
    parts = [unplaned(expand.decompress(x), np.int64).reshape(width, -1) for x in packs.to_pylist() if x]
    return np.concatenate([np.zeros((width, 0), np.int64), *parts], axis=1)


def by_block(blocks: DataFrame, answers: DataFrame, run, schema: str) -> DataFrame:
    """Each block beside the answers to it."""
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each finished query go: what later ones need has been written as a table by then."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def dealt(buckets: int, ctx: np.ndarray, ctx_total: np.ndarray, code: np.ndarray,
          known: np.ndarray, split: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of each sequence, their order by bucket, and where in this order a context's part of a bucket begins.

    All sequences of a context meet in one bucket; where it has ``split`` training places or more they
    are dealt by their codes to as many buckets as these places need.
    """
    pieces = (ctx_total // split + 1).astype(np.uint64)
    piece = np.where(known, np.uint64(0), (code * FACTOR >> np.uint64(20)) % pieces)
    place = ctx + piece * FACTOR  # buckets are ranges of these
    bucket = ((place >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    heads = np.flatnonzero(np.append(True, (ctx[1:] != ctx[:-1]) | (piece[1:] != piece[:-1]))[:len(ctx)])
    runs = np.argsort(place[heads], kind="stable")
    size = np.diff(np.append(heads, len(ctx)))[runs]
    order = np.arange(len(ctx)) + np.repeat(heads[runs] - (np.cumsum(size) - size), size)
    b, c = bucket[order], ctx[order]
    return bucket, order, np.flatnonzero(np.append(True, (b[1:] != b[:-1]) | (c[1:] != c[:-1]))[:len(order)])


def send(block: int, buckets: int, ctx: np.ndarray, ctx_total: np.ndarray, suffix: np.ndarray, up: np.ndarray,
         code: np.ndarray, n: np.ndarray, known: np.ndarray | None = None, split: int = SPLIT) -> pa.Table:
    """A block's sequences by bucket: (bucket, block, contexts, pack).

    Sequences come ordered by context and code.  ``contexts`` are the step to the code of a context, whether it is split,
    how many of its sequences are in ``pack``, and of those that are not, as no other block holds them (``known``), the
    symbols and training places; last its sum of n * log(n) of these less that of n * log(up / suffix) of all, in units
    of 1 / ``UNITS``.  ``pack`` has the steps from code to code and the counts.
    """
    known = np.zeros(len(ctx), bool) if known is None else known
    bucket, order, unit = dealt(buckets, ctx, ctx_total, code, known, split)
    ctx, ctx_total, suffix, up, code, n, known, bucket = (
        x[order] for x in (ctx, ctx_total, suffix, up, code.view(np.int64), n, known, bucket))
    of = np.repeat(np.arange(len(unit)), np.diff(np.append(unit, len(order))))
    listed = np.bincount(of[~known], minlength=len(unit))
    known_n, known_symbols, s = judged(of, n, n * known, up, suffix, len(unit))
    ctx = ctx[unit].view(np.int64)
    contexts = [(ctx_total[unit] >= split).astype(np.int64), listed, known_symbols, known_n,
                np.rint(s * UNITS).astype(np.int64)]
    code, n, first = code[~known], n[~known], (np.cumsum(listed) - listed)[listed > 0]
    step = np.diff(code, prepend=0)
    step[first] = code[first]
    ends = np.append(np.flatnonzero(np.diff(bucket[unit])) + 1, len(unit))[:len(unit)]
    begins = np.append(0, ends[:-1])[:len(ends)]
    upto = np.append(0, np.cumsum(listed))
    return pa.table({"bucket": pa.array(bucket[unit][begins], pa.int64()),
                     "block": pa.array([block] * len(ends), pa.int64()),
                     "contexts": pa.array([packed(np.diff(ctx[i:j], prepend=0), *(x[i:j] for x in contexts))
                                           for i, j in zip(begins, ends, strict=True)], pa.binary()),
                     "pack": pa.array([packed(step[upto[i]:upto[j]], n[upto[i]:upto[j]])
                                       for i, j in zip(begins, ends, strict=True)], pa.binary())})


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def judged(of: np.ndarray, n: np.ndarray, closed: np.ndarray, up: np.ndarray, suffix: np.ndarray,
           size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per context, of the ``closed`` counts (0: open): their sum, the symbols, and their n * log(n) less n * log(up / suffix)
    of all counts ``n``."""
    s = xlogx(closed) - n * (np.log(np.maximum(up, 1)) - np.log(np.maximum(suffix, 1)))
    add = lambda x: np.bincount(of, weights=x, minlength=size)
    return add(closed).astype(np.int64), add(closed > 0).astype(np.int64), add(s)


def counter(k: int, depth: int, min_count: int, n: int, ends: int, buckets: int, min_divergence: float, split: int):
    """For a block and its answers: its sequences of level ``k``, to be sent."""
    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        block = Block(texts, found, ends, buckets, split)
        *_, (level, _, _) = block.levels(depth, min_count, n, min_divergence, counting=k)
        return send(texts.column("block")[0].as_py(), buckets, *level.args, split)
    return run


def add_up(min_divergence: float, in_order: bool = False):
    """For the packs of one bucket: what returns to each block, and the sums of split contexts (rows without a block).

    ``totals`` are the sequences whose count over all blocks is not the block's own, ``states`` the kept contexts of
    the block with their distinct symbols.  With ``in_order`` both come without codes, for all that was sent in the order
    sent: the places in other blocks and one more (0: no other block holds it), and the symbols (0: not kept).
    A split context's blocks are rows with that context.
    """
    def run(sent: pa.Table) -> pa.Table:
        one = lambda c, i: sent.column(c)[i:i + 1]
        units = [unpacked(one("contexts", i), 6) for i in range(sent.num_rows)]
        packs = [unpacked(one("pack", i), 2) for i in range(sent.num_rows)]
        ctx = np.concatenate([np.cumsum(x[0]) for x in units])
        _, is_split, listed, symbols, n_known, s = np.concatenate(units, axis=1)
        code, n = np.concatenate(packs, axis=1)
        contexts, lead, unit_of = distinct(ctx.view(np.uint64))
        first = (np.cumsum(listed) - listed)[listed > 0]
        code = np.cumsum(code)  # of steps: less what stood before the context
        code -= np.repeat(np.append(0, code)[first], listed[listed > 0])
        of = np.repeat(unit_of, listed)
        order = np.lexsort((code, of))
        new = np.append(True, (np.diff(code[order]) != 0) | (np.diff(of[order]) != 0))[:len(order)]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        total = np.bincount(group, weights=n).astype(np.int64)
        at = of[order][new]
        add = lambda of, x: np.bincount(of, weights=x, minlength=len(contexts))
        sums = (add(at, total) + add(unit_of, n_known)).astype(np.int64)
        symbols = (add(at, total > 0) + add(unit_of, symbols)).astype(np.int64)
        s = add(at, xlogx(total)) + add(unit_of, s / UNITS)
        split = is_split[lead] > 0
        kept = keeps(sums, symbols, s - xlogx(sums), min_divergence) & ~split
        more = total[group] - n
        back = np.where(np.bincount(group)[group] > 1, more + 1, 0)
        out = {c.split()[0]: [] for c in ANSWER.split(", ")}

        def row(**values) -> None:
            for c, x in out.items():
                x.append(values.get(c))
        blocks, bucket = sent.column("block").to_pylist(), sent.column("bucket")[0].as_py()
        cuts, ends = np.cumsum([0, *(x.shape[1] for x in units)]), np.cumsum([0, *(x.shape[1] for x in packs)])
        for i, no in enumerate(blocks):
            here, rows = unit_of[cuts[i]:cuts[i + 1]], slice(ends[i], ends[i + 1])
            if in_order:
                row(block=no, bucket=bucket, totals=packed(back[rows]), states=packed(symbols[here] * kept[here]))
            else:
                d, known = more[rows] != 0, here[kept[here]]
                row(block=no, bucket=bucket, totals=packed(code[rows][d], total[group[rows]][d]),
                    states=packed(contexts[known], symbols[known]))
            for j in here[split[here]].tolist():
                row(block=no, ctx=int(contexts[j].view(np.int64)))
        for j in np.flatnonzero(split).tolist():
            row(ctx=int(contexts[j].view(np.int64)), n=int(sums[j]), symbols=int(symbols[j]), s=float(s[j]))
        types = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
        return pa.table(out, schema=pa.schema([(c, types[t]) for c, t in map(str.split, ANSWER.split(", "))]))
    return run


def send_words(buckets: int):
    """For blocks (block, codes, counts): their words by bucket; buckets are ranges of codes, in ascending order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                codes, n = (unpacked(b.column(c)[i:i + 1], 1)[0] for c in (1, 2))
                codes = codes.view(np.uint64)
                cuts = np.searchsorted((codes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32),
                                       np.arange(buckets + 1, dtype=np.uint64))
                full = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array(full, pa.int64()), "block": pa.array([b.column(0)[i].as_py()] * len(full), pa.int64()),
                    "contexts": pa.array([None] * len(full), pa.binary()),
                    "pack": pa.array([packed(np.diff(codes[cuts[x]:cuts[x + 1]], prepend=np.uint64(0)), n[cuts[x]:cuts[x + 1]])
                                      for x in full], pa.binary())})
    return run


def add_words(buckets: int):
    """For the words of one bucket: to each block, in the order sent, their training places in other blocks and their number
    among all words (0: no other block holds it); and a row without a block, the sum of the places and the words trained on.

    Numbers begin above those of the start and end marks; the most frequent words of a bucket have its least ones.
    """
    def run(sent: pa.Table) -> pa.Table:
        bucket = sent.column("bucket")[0].as_py()
        packs = [unpacked(sent.column("pack")[i:i + 1], 2) for i in range(sent.num_rows)]
        code, n = np.concatenate([np.cumsum(x[0]) for x in packs]), np.concatenate([x[1] for x in packs])
        _, _, group = distinct(code)
        total = np.bincount(group, weights=n).astype(np.int64)
        number = np.empty(len(total), np.int64)
        number[np.argsort(-total, kind="stable")] = np.arange(len(total)) * buckets + bucket + 2
        number[np.bincount(group) < 2] = 0
        ends = np.cumsum([0, *(x.shape[1] for x in packs)])
        back = [packed((total[group] - n)[i:j], number[group][i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
        no = len(back)
        return pa.table({"block": pa.array([*sent.column("block").to_pylist(), None], pa.int64()),
                         "bucket": pa.array([bucket] * (no + 1), pa.int64()), "totals": pa.array([*back, None], pa.binary()),
                         "n": pa.array([None] * no + [int(total.sum())], pa.int64()),
                         "symbols": pa.array([None] * no + [int((total > 0).sum())], pa.int64())})
    return run


def keeps(n, symbols, gain, min_divergence: float):
    """Whether a context of ``n`` places and so many distinct symbols diverges from its suffix."""
    return (gain >= n * min_divergence) & (gain * 2 >= symbols * 3 + 30)


def may_keep(n: np.ndarray, suffix: np.ndarray, min_divergence: float) -> np.ndarray:
    """Whether ``keeps`` can hold for a context, from its places and those of its suffix alone.

    No symbol stands more often behind the context than behind its suffix, so the gain is n * log(suffix / n) at most.
    """
    most = n * np.log(np.maximum(suffix, 1) / np.maximum(n, 1))
    return keeps(n, 1, most + 1e-6 * (1 + n), min_divergence)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each finished query go: what later ones need has been written as a table by then."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def level_sums(sent: DataFrame, k: int, min_divergence: float) -> DataFrame:
    """The written results of ``add_up`` for level ``k``."""
    return staged(sent.groupBy("bucket").applyInArrow(add_up(min_divergence, in_order=True), ANSWER), f"lm-level-{k}")


def level_answers(level: DataFrame, k: int, min_divergence: float) -> DataFrame:
    """(block, bucket, k, totals, states, ctx, symbols): what returns to the blocks from one level."""
    packs = level.filter("totals is not null").select("block", "bucket", F.lit(k).alias("k"), "totals", "states")
    sums = level.filter("block is null").groupBy("ctx").agg(
        F.sum("n").alias("n"), F.sum("symbols").alias("symbols"), F.sum("s").alias("s"))
    gain = F.col("s") - F.col("n") * F.log("n")
    kept = sums.filter(keeps(F.col("n"), F.col("symbols"), gain, min_divergence)).select("ctx", "symbols")
    large = level.filter("block is not null and ctx is not null").select("block", "ctx").distinct().join(kept, "ctx")
    return packs.unionByName(large.withColumn("k", F.lit(k)), allowMissingColumns=True)


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
                min_count: int = MIN_COUNT, min_divergence: float = 0.0002, depth: int = DEPTH) -> DataFrame:
    """Per document: n_tokens, n_known, train_tokens, base_score and score (log10).

    ``train`` marks the rows that the counts and the tree learn from; all rows are scored.
    """
    spark = docs.sparkSession
    ship(spark)
    split = SPLIT
    with shuffles_removed(spark):
        blocks = stage_blocks(docs, id_col, text_col, train)
        # the end mark is a token too, once for each training text; buckets are as many as keep each of one size
        ends, no = blocks.agg(F.coalesce(F.sum(F.size(F.filter("train", lambda x: x))), F.lit(0)),
                              F.count(F.lit(1))).first()
        buckets = no + 1
        words = map_arrow(blocks.select("block", "codes", "counts"), send_words(buckets), SENT)
        level = staged(words.groupBy("bucket").applyInArrow(add_words(buckets), WORDS), "lm-level-0")
        v, n = level.filter("block is null").agg(F.coalesce(F.sum("symbols"), F.lit(0)),
                                                 F.coalesce(F.sum("n"), F.lit(0))).first()
        v, n = v + (ends > 0), n + ends
        answers = level.filter("totals is not null").select(
            "block", "bucket", F.lit(0).alias("k"), "totals", F.lit(None).cast("binary").alias("states"),
            F.lit(None).cast("long").alias("ctx"), F.lit(None).cast("long").alias("symbols"))
        blocks = blocks.drop("codes", "counts")
        for k in range(1, depth + 1):
            count = counter(k, depth, min_count, n, ends, buckets, min_divergence, split)
            level = level_sums(by_block(blocks, answers, count, SENT), k, min_divergence)
            answers = answers.unionByName(level_answers(level, k, min_divergence))

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        block = Block(texts, found, ends, buckets, split)
        each = lambda x: np.add.reduceat(np.where(block.at < 0, 0, x), block.starts)
        p = (block.total + 1) / (n + v + 1)
        base, known = each(np.log10(p)), each((block.total > 0).astype(np.int64))
        for level, totals, symbols in block.levels(depth, min_count, n, min_divergence):
            here = symbols > 0
            at, t = level.places[here], symbols[here]
            p[at] = (totals[here] + t * p[at]) / (level.ctx_total[level.group[here]] + t)
        flat = lambda c, t: pa.array([x for xs in texts.column(c).to_pylist() for x in xs], t)
        return pa.table({"id": flat("ids", pa.int64()), "train": flat("train", pa.bool_()), "n_tokens": block.sizes,
                         "n_known": known, "base_score": base, "score": each(np.log10(p))})

    out = by_block(blocks, answers, run, "id long, train boolean, n_tokens long, n_known long, base_score double, "
                                        "score double")
    return out.select(F.col("id").alias(id_col), "train", "n_tokens", "n_known",
                      F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
