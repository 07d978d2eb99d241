"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as
Parquet and read again as the next stage's ``docs``.  All but the last keep the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starlens.llm.bpe import encode_texts
from starlens.llm.common import free_name, staged, table, with_row_key
from starlens.llm.decontaminate import decontaminate
from starlens.llm.quality import quality_rules, without_lines
from starlens.llm.queries import vocab_path
from starlens.llm.secrets import find_secrets, redact
from starlens.llm.simhash import simhash_groups


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key per row, under a name of its own."""
    row = free_name(docs, "__pipeline_row")
    return with_row_key(docs, row), row


def _without(docs: DataFrame, rejected: DataFrame, row: str) -> DataFrame:
    """``docs`` without the rows whose key is in ``rejected``: the few keys travel, not the texts."""
    return docs.join(rejected.select(row), row, "left_anti").drop(row)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines above the limit.

    NULL, empty and blank texts are rejected (too few words); repeated rows are judged each; further columns of any
    name are passed on; an empty table stays empty.
    """
    keyed, row = _keyed(docs)
    return without_lines(keyed, quality_rules(keyed, row_key=row), row,
                         length_col="n_chars" if "n_chars" in docs.columns else None).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id.

    Texts without words are one group; NULL ids come after all others; of repeated rows one stays; further columns of
    any name are passed on; an empty table stays empty.
    """
    keyed, row = _keyed(docs)
    groups = staged(simhash_groups(keyed, shingle=4, seed=42, max_bits=4, row_key=row), "groups")
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row))[row].alias(row))
    return _without(keyed, groups.join(first, row, "left_anti"), row)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item.

    NULL and empty texts have none and stay, and so do all documents where the benchmark is empty; repeated rows are
    judged each; further columns of any name are passed on.
    """
    keyed, row = _keyed(docs)
    found = decontaminate(keyed, table(spark, sf_dir, "benchmark"), window=10, row_key=row)
    return _without(keyed, found.filter("contaminated"), row)


def secret_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets are replaced by a mark, texts without any (NULL and empty ones too) are left as they are.

    Repeated rows are masked each; further columns of any name are passed on; an empty table stays empty.
    """
    keyed, row = _keyed(docs)
    found = find_secrets(keyed, row_key=row)
    return redact(keyed, found, row, length_col="n_chars" if "n_chars" in docs.columns else None).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document, checked by decoding them."""
    return encode_texts(docs, vocab_path())


STAGES = [("quality rules", quality), ("SimHash near-dedup", near_dedup),
          ("benchmark decontamination", benchmark_free), ("secret scans", secret_free),
          ("BPE encoding and decoding", encode)]

#: SQL cannot express SimHash components or BPE; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
