"""Top N items within every group (problem 7).

Method: row_number over the group ordered by score and identifier, with a filter on the rank. The
filter lets the optimiser place a group limit on both sides of the shuffle, so each task sends at
most N rows of a group and a group with millions of items never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, group: list[str], score: str, item: str, n: int, rank: str = "rank_no") -> DataFrame:
    """(group, rank, item): the n rows of highest score of each group, rank 1 the best.

    Among equal scores the smaller item comes first; a null score ranks below every other. Rows
    with a null group or item are no candidates. Rows that repeat an item of a group count each, so
    callers hand over one row per item. An empty table gives no rows.
    """
    order = Window.partitionBy(*group).orderBy(F.col(score).desc_nulls_last(), F.col(item).asc())
    rows = df.dropna(subset=[*group, item]).select(*group, item, score)
    return rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= n).select(*group, rank, item)
