"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of at most 23 bits.  The binary
Golay code puts every 23-bit word within three bits of exactly one codeword, so
a segment decodes to one 12-bit codeword index.  A segment's *keys* are the
indices that it and the words one bit away decode to: one key, or about six.
Two segments that differ in one bit share the index of either one.

Pigeonhole over three segments and at most four (``max_bits``) errors: either
some segment has no error, and whole segments are joined; or every segment has
one or two errors, at least two of them exactly one.  Then triples of indices
are joined: one side has its own index in two segments and all keys in the
third, the other side all keys in all three (segments two bits apart share the
index of the word between them).  A triple has 36 bits, so fingerprints rarely
meet by chance.  All that meet are verified by their bit distance.

Equal fingerprints are one node.  The members of each whole segment are first
linked to its smallest member, which is linear in the members; the join then
only lets links between different components out.  A large group of near
copies is thus never expanded into all its pairs.

Defined results: a NULL or empty text has fingerprint zero and is linked like
any other; repeated rows and NULL ids are kept row by row (a component's id is
the smallest id in it, NULL only if all are NULL); texts of any length are read
whole; further columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, staged

#: Bits of the segments, from the low end.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code of length 23.  Fixed value.
GOLAY = 0xC75
MAX_BITS = 4


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Majority of the bits of the XXH64 hashes of all word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1:] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)),
                    np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        part = h[at:at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, seed: int,
                 row_key: str | None = None) -> DataFrame:
    """(id, fp): the fingerprint as a signed 64-bit integer; the text stays behind."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *b.columns[2:], pa.array(fp.view(np.int64))],
                ["id", *(["row"] if row_key else []), "fp"])
    cols = [F.col(id_col).cast("long"), F.col(text_col).cast("string"), *([F.col(row_key)] if row_key else [])]
    return map_arrow(docs.select(*cols), run, "id long" + (", row long" if row_key else "") + ", fp long")


_DECODE: list[np.ndarray] = []


def golay_decoder() -> np.ndarray:
    """Codeword index (12 bits) of each of the 2^23 words; built once in each Python worker."""
    if not _DECODE:
        data = np.arange(1 << 12, dtype=np.int64) << 11
        words = (data | _reduce(data)).astype(np.int64)
        table = np.zeros(1 << 23, np.int16)
        index = np.arange(1 << 12, dtype=np.int16)
        bits = [1 << i for i in range(23)]
        errors = [0, *bits, *(a | b for i, a in enumerate(bits) for b in bits[:i]),
                  *(a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j])]
        for e in errors:  # 2,048 error patterns of up to three bits fill the space exactly
            table[words ^ e] = index
        _DECODE.append(table)
    return _DECODE[0]


def _reduce(v: np.ndarray) -> np.ndarray:
    """Remainder of a 23-bit polynomial by the generator."""
    r = v.copy()
    for bit in range(22, 10, -1):
        r ^= np.where((r >> bit) & 1, GOLAY << (bit - 11), 0)
    return r


def segment_keys(fp: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Segments, their own index, and (n, 6) key indices with -1 where there are fewer."""
    table = golay_decoder()
    segs, own, keys = [], [], []
    for low, width in SEGMENTS:
        s = ((fp >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)
        near = np.stack([table[s], *(table[s ^ (1 << i)] for i in range(width))], axis=1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near = -np.sort(-near, axis=1)
        segs.append(s)
        own.append(table[s].astype(np.int64))
        keys.append(near[:, : max(1, int((near >= 0).sum(axis=1).max(initial=1)))].astype(np.int64))
    return segs, own, keys


def golay_keys(nodes: DataFrame, probe: bool) -> DataFrame:
    """(key, fp, comp) of nodes (fp, comp): whole segments and triples of key indices.

    A ``probe`` has its own index in two segments at least.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                fp = part.column(0).to_numpy(zero_copy_only=False)
                comp = part.column(1).to_numpy(zero_copy_only=False)
                segs, own, keys = segment_keys(fp.view(np.uint64))
                k = keys
                triple = (k[0][:, :, None, None] << 24) | (k[1][:, None, :, None] << 12) | k[2][:, None, None, :]
                ok = (k[0] >= 0)[:, :, None, None] & (k[1] >= 0)[:, None, :, None] & (k[2] >= 0)[:, None, None, :]
                if probe:
                    mine = [(x == o[:, None]).astype(np.int8) for x, o in zip(k, own, strict=True)]
                    ok &= (mine[0][:, :, None, None] + mine[1][:, None, :, None] + mine[2][:, None, None, :]) >= 2
                row = np.broadcast_to(np.arange(len(fp))[:, None, None, None], triple.shape)[ok]
                key = np.concatenate([*(np.int64(i) << 60 | x for i, x in enumerate(segs)),
                                      np.int64(3) << 60 | triple[ok]])
                rows = np.concatenate([*[np.arange(len(fp))] * 3, row])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(fp[rows]), pa.array(comp[rows])], ["key", "fp", "comp"])
    return map_arrow(nodes.select("fp", "comp"), run, "key long, fp long, comp long")


def _near(a: Column, b: Column, max_bits: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= max_bits


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(fp, comp) for every node: the smallest node reachable over ``links`` (a, b).

    Alternates large-star and small-star steps; each neighbourhood is only ever
    reduced to its minimum, which combines on the map side, so a node with very
    many links is never gathered.  Every step is written to the shared folder.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .filter("u != v").distinct(), "links")
    state = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # large-star points each neighbour above a node to the node's minimum
        large = large.filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # small-star: the neighbours below a node, and the node, point to its minimum
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", "m"))).filter("u != v").distinct()
        edges = staged(small, "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    return nodes.join(edges.select(F.col("u").alias("fp"), F.col("v").alias("m")), "fp", "left").select(
        "fp", F.coalesce("m", "fp").alias("comp"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                   seed: int = 42, max_bits: int = MAX_BITS, row_key: str | None = None) -> DataFrame:
    """Per document: its id, fingerprint (hex) and component_id.

    With a ``row_key`` the result also has that key and ``component``, which
    tells components apart even where all ids are NULL.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the segment scheme covers bit distances of 0 to 4")
    fps = staged(fingerprints(docs, id_col, text_col, shingle, seed, row_key), "fingerprints")
    # equal fingerprints are one node, with the smallest id of its documents
    nodes = staged(fps.groupBy("fp").agg(F.min("id").alias("id")), "nodes")

    # first pass, linear: the members of each whole segment to its smallest member
    segments = nodes.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1)).alias("s"))
        for i, (low, width) in enumerate(SEGMENTS)])).alias("k"))
    least = segments.groupBy("k").agg(F.min("fp").alias("m"), F.max("fp").alias("x")).filter("m != x").select("k", "m")
    star = segments.join(least, "k").filter((F.col("fp") != F.col("m")) & _near(F.col("fp"), F.col("m"), max_bits))
    comp = staged(components(nodes, star.select(F.col("fp").alias("a"), F.col("m").alias("b"))), "components")

    # second pass: all that share a key, only links between components leave the join
    a, b = golay_keys(comp, probe=False).alias("a"), golay_keys(comp, probe=True).alias("b")
    cross = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.comp") != F.col("b.comp"))
                   & _near(F.col("a.fp"), F.col("b.fp"), max_bits))
    links = staged(cross.select(F.least("a.comp", "b.comp").alias("a"), F.greatest("a.comp", "b.comp").alias("b"))
                   .distinct(), "links")
    merged = components(comp.select(F.col("comp").alias("fp")).distinct(), links).select(
        F.col("fp").alias("comp"), F.col("comp").alias("root"))
    rooted = nodes.join(comp.join(merged, "comp"), "fp").select("fp", "id", "root")
    ids = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    labels = staged(rooted.join(ids, "root").select("fp", "root", "component_id"), "components")
    return fps.join(labels, "fp").select(
        F.col("id").alias(id_col), *([F.col("row").alias(row_key)] if row_key else []),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
        *([F.col("root").alias("component")] if row_key else []))
