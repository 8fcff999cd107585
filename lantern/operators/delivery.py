"""Records delivered several times by monthly loads: choosing one delivery per record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_delivery(df: DataFrame, keys: list[str], columns: list[str], stamp: str = "loaded_at") -> DataFrame:
    """keys and columns of the row with the greatest stamp for each key.

    One aggregation with a map-side part, so a key delivered very often sends one row per task.
    Rows without a key are dropped, a row without a stamp loses against any stamped one, and rows
    of one key and stamp that differ are resolved by the greatest values, so the result never
    depends on the order of rows. Only the named columns are read. An empty table gives no rows.
    """
    picked = F.max(F.struct(F.col(stamp).alias("_stamp"), *[F.col(c) for c in columns]))
    rows = df.dropna(subset=keys).groupBy(*keys).agg(picked.alias("_row"))
    return rows.select(*keys, *[F.col("_row")[c].alias(c) for c in columns])
