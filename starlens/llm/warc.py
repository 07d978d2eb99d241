"""WARC records in ZIP packages: a writer, and a reader that never extracts.

Each package is a ZIP file with two *stored* members: ``archive/data.warc.gz``
with one WARC record after another, each a gzip member of its own, and ``indexes/index.cdxj`` with one line for each
record (its offset and length in the archive).  The reader parses the end
record, the ZIP64 records if there are any and the central directory, finds
where the stored members begin, and reads single records by their byte ranges.

Records whose payload was seen before are ``revisit`` records that name the
response; the response of equal payloads is the one with the largest id.
Tasks write packages under names of their own and return them as rows; a
package of a lost task is in no row and is never read.

Defined results: a NULL payload counts as empty; equal rows (same id, same
payload) that carry the group's largest id are all responses; rows with a NULL
id refer to the largest id, and are responses if the group has none; payloads
of any length are written whole; an empty table gives no package and no rows;
other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import os
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, shared_folder

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Packages are closed at about this many bytes of records.
PACKAGE_BYTES = 64 << 20
#: Index lines that one reading task takes at a time.
RECORDS = 4096
#: Signatures and fixed parts of ZIP structures.  Fixed values.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"


def digest32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


# ------------------------------------------------------------------ records

def record_head(kind: str, page_id, url: str | None, digest: str, payload_bytes: int, refers_to, block: int) -> bytes:
    """Header of one WARC record; ``block`` is the length of what follows."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
             "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}",
             f"X-Payload-Length: {payload_bytes}"]
    if url is not None:
        # a line break in an address would end the header line
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {block}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass")


HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record at this place")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(headers["content-length"])]
    _, _, payload = block.partition(b"\r\n\r\n")
    return headers, payload


# ------------------------------------------------------------------ ZIP packages

class ZipReader:
    """Members of a ZIP file by byte range; sizes and offsets beyond 32 bits come from ZIP64 records."""

    def __init__(self, read, size: int):
        """``read(at, n)`` returns ``n`` bytes of the file from ``at`` on."""
        self.read = read
        tail_at = max(0, size - (1 << 16) - 22)
        tail = read(tail_at, size - tail_at)
        # the end record is the last one whose comment reaches exactly to the end of the file
        at = tail.rfind(END)
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(END, 0, at)
        if at < 0:
            raise ValueError("no ZIP end record")
        n, length, start = struct.unpack_from("<HII", tail, at + 10)
        end_at = tail_at + at
        if end_at >= 20 and (n == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF):
            locator = read(end_at - 20, 20)
            if locator[:4] == LOCATOR64:
                where = struct.unpack_from("<Q", locator, 8)[0]
                record = read(where, 56)
                if record[:4] != END64:
                    raise ValueError("no ZIP64 end record where the locator points")
                n, length, start = struct.unpack_from("<QQQ", record, 32)
        self.members: dict[str, tuple[int, int, int, int]] = {}
        directory, p = read(start, length), 0
        for _ in range(n):
            if directory[p:p + 4] != CENTRAL:
                raise ValueError("the central directory is damaged")
            method, = struct.unpack_from("<H", directory, p + 10)
            packed, plain, name_n, extra_n, note_n = struct.unpack_from("<IIHHH", directory, p + 20)
            offset, = struct.unpack_from("<I", directory, p + 42)
            name = directory[p + 46:p + 46 + name_n].decode("utf-8", "surrogateescape")
            extra = directory[p + 46 + name_n:p + 46 + name_n + extra_n]
            wide, e = b"", 0
            while e + 4 <= len(extra):
                tag, m = struct.unpack_from("<HH", extra, e)
                if tag == 1:
                    wide = extra[e + 4:e + 4 + m]
                e += 4 + m
            # the ZIP64 field holds only those values that did not fit, in this order
            w = 0
            if plain == 0xFFFFFFFF:
                plain, w = struct.unpack_from("<Q", wide, w)[0], w + 8
            if packed == 0xFFFFFFFF:
                packed, w = struct.unpack_from("<Q", wide, w)[0], w + 8
            if offset == 0xFFFFFFFF:
                offset = struct.unpack_from("<Q", wide, w)[0]
            self.members[name] = (offset, method, packed, plain)
            p += 46 + name_n + extra_n + note_n

    def locate(self, name: str) -> tuple[int, int]:
        """(first byte, bytes) of a stored member."""
        offset, method, packed, _ = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed: its records cannot be read by range")
        head = self.read(offset, 30)
        if head[:4] != LOCAL:
            raise ValueError("no local header where the directory points")
        name_n, extra_n = struct.unpack_from("<HH", head, 26)
        return offset + 30 + name_n + extra_n, packed


class PackageWriter:
    """One package on a stream that cannot go back."""

    def __init__(self, stream):
        self.zip = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.stream = stream
        self.archive = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.index: list[str] = []
        self.at = 0

    def add(self, page_id, url, payload: bytes, refers_to) -> None:
        digest = digest32(hashlib.sha1(payload).hexdigest())
        kind = "response" if refers_to is None else "revisit"
        body = HTTP + payload if kind == "response" else HTTP
        data = record_head(kind, page_id, url, digest, len(payload), refers_to, len(body)) + body + b"\r\n\r\n"
        data = gzip.compress(data, 3, mtime=0)
        self.archive.write(data)
        self.index.append(json.dumps({"id": page_id, "offset": self.at, "length": len(data)}))
        self.at += len(data)

    def close(self) -> int:
        self.archive.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(line + "\n" for line in self.index))
        self.zip.close()
        self.stream.close()
        return len(self.index)


def open_package(path: str):
    """(reader, file) of a package on any file system that pyarrow knows."""
    fs, name = pafs.FileSystem.from_uri(path)
    f = fs.open_input_file(name)

    def read(at: int, n: int) -> bytes:
        f.seek(at)
        return f.read(n)
    return ZipReader(read, f.size()), f


# ------------------------------------------------------------------ on Spark

def mark_revisits(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """(id, digest, refers_to) of the ids whose payload another, larger id has too."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    keys = (pages.select(F.col(id_col).cast("long").alias("id"), F.sha1(payload).alias("digest"),
                         F.octet_length(payload).alias("n"))
            .filter(F.col("n") >= min_bytes).select("id", "digest").distinct())
    most = (keys.groupBy("digest").agg(F.max("id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
            .filter("n > 1 and refers_to is not null").select("digest", "refers_to"))
    return keys.join(most, "digest").filter(~F.col("id").eqNullSafe(F.col("refers_to")))


def write_packages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str | None = "url",
                   payload_col: str = "html", min_revisit_bytes: int = 0,
                   package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write every row as a WARC record into packages under ``folder``; the table of packages."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    revisits = mark_revisits(pages, id_col, payload_col, min_revisit_bytes)
    rows = pages.select(F.col(id_col).cast("long").alias("id"),
                        (F.col(url_col).cast("string") if url_col else F.lit(None).cast("string")).alias("url"),
                        payload.alias("payload"), F.sha1(payload).alias("digest"))
    # ids are many and even, unlike payloads: pages are dealt by id, and text and all move once
    marked = rows.join(revisits.withColumnsRenamed({"id": "r_id", "digest": "r_digest"}),
                       F.col("id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left"
                       ).select("id", "url", "payload", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, base = pafs.FileSystem.from_uri(folder)
        writer, name, done = None, "", []
        for b in batches:
            ids, urls, payloads, refers = b.columns
            for i in range(b.num_rows):
                if writer is None:
                    name = f"part-{task.partitionId():05d}-{len(done):04d}-{task.taskAttemptId()}.zip"
                    writer = PackageWriter(fs.open_output_stream(f"{base}/{name}"))
                writer.add(ids[i].as_py(), urls[i].as_py(), payloads[i].as_py(), refers[i].as_py())
                if writer.at >= package_bytes:
                    done.append((f"{folder}/{name}", writer.close()))
                    writer = None
        if writer is not None:
            done.append((f"{folder}/{name}", writer.close()))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()),
                                          pa.array([d[1] for d in done], pa.int64())], ["path", "records"])

    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)
    map_arrow(marked, run, "path string, records long").write.parquet(f"{folder}/packages")
    return spark.read.parquet(f"{folder}/packages")


def read_packages(spark: SparkSession, packages: DataFrame, payloads: bool = False) -> DataFrame:
    """Every record: page_id, payload_bytes, payload_digest, record_type, refers_to (and its payload).

    Work is dealt in runs of index lines, so one large package is read by many
    tasks.  A response's payload is checked against its digest.
    """
    runs = packages.select("path", F.explode(F.sequence(
        F.lit(0).cast("long"), F.greatest(F.col("records") - 1, F.lit(0).cast("long")),
        F.lit(RECORDS).cast("long"))).alias("first"))
    dealt = runs.repartition(max(spark.sparkContext.defaultParallelism, runs.rdd.getNumPartitions()), "path", "first")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def number(urn: str | None):
            x = (urn or "").removeprefix("<urn:page:").removesuffix(">")
            return int(x) if x else None
        for b in batches:
            for path, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                reader, f = open_package(path)
                at, n = reader.locate(INDEX)
                lines = reader.read(at, n).decode().splitlines()[first:first + RECORDS]
                base, _ = reader.locate(ARCHIVE)
                out = [[], [], [], [], [], []]
                for line in map(json.loads, lines):
                    headers, payload = parse_record(
                        gzip.decompress(reader.read(base + line["offset"], line["length"])))
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    kind = headers["warc-type"]
                    if kind == "response" and digest32(hashlib.sha1(payload).hexdigest()) != digest:
                        raise ValueError(f"payload of {headers['warc-record-id']} does not match its digest")
                    size = len(payload) if kind == "response" else int(headers["x-payload-length"])
                    for col, x in zip(out, (number(headers["warc-record-id"]), size, digest, kind,
                                            number(headers.get("warc-refers-to")), payload), strict=True):
                        col.append(x)
                f.close()
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
                keep = 6 if payloads else 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out[:keep], types[:keep], strict=True)], names[:keep])
    return map_arrow(dealt, run, schema + (", payload binary" if payloads else ""))


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str | None = "url",
                    payload_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """Write all pages as packages into the shared folder and read their records back."""
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}"
    packages = write_packages(pages, folder, id_col, url_col, payload_col, min_revisit_bytes)
    return read_packages(spark, packages)
