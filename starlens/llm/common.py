"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Runs of characters that are not ASCII white space (space, tab to carriage return).
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a lambda variable, so ``body`` evaluates it once however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only (``lower`` would also change other alphabets)."""
    return F.translate(col, UPPER, LOWER)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new sub-folder of the shared checkpoint folder for one run of an operator."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Later passes then read fixed files (a lost executor costs one re-read, not
    the whole lineage) and see the same rows in the same splits every time.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; NULL ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so (Spark does not tell case apart)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_key(df: DataFrame, name: str) -> DataFrame:
    """A key per row, so that repeated rows and NULL ids stay apart.

    Only for frames that read files: their splits, and so the keys, are the
    same whenever a lost task is run again.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where they could not find it by themselves.

    Submitted with ``--py-files`` or run from the repository, nothing is done;
    otherwise Spark hands the package to every worker as a zip file.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    there = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    sc = spark.sparkContext
    if root in map(os.path.abspath, filter(None, there)) or ".zip" in root or getattr(sc, "_llm_shipped", False):
        return
    base = os.path.join(tempfile.mkdtemp(), "starlens")
    sc.addPyFile(shutil.make_archive(base, "zip", root, "starlens"))
    sc._llm_shipped = True


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` with the package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
