"""starlens: review analytics and rating prediction as Spark DataFrame operators.

Every operator takes a DataFrame plus column names and returns a DataFrame.
Sub-packages:

* ``sources``   – readers and writers (JSON lines, CSV, Parquet, word vectors)
* ``functions`` – Column-level expressions (tokenising, hours, tenure, ratios)
* ``operators`` – DataFrame -> DataFrame analytics (profiling, statistics,
  check-ins, enrichment joins, word counts, TF-IDF, sentiment, embeddings)
* ``plans``     – Spark ML pipelines: split, scale, fit, tune, evaluate
* ``streaming`` – incremental ingest and windowed check-in counts
"""

from starlens.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
