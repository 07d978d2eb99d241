from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def named(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def present(c) -> Column:
    """``c`` as double with NaN read as missing (NULL), as pandas does."""
    x = (named(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(x), x)
