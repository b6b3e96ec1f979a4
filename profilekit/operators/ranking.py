"""Top rows per key.

``row_number() <= n`` is planned as a group limit before and after the shuffle, so a key that holds a
third of all rows leaves each map task with at most ``n`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, position: str | None = None
) -> DataFrame:
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(
        F.col("_rn") <= n
    )
    return ranked.withColumnRenamed("_rn", position) if position else ranked.drop("_rn")


def pick_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_per_key(df, keys, order, 1)


def first_present(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """Per key and column, the first value that is not null in the given order.

    Aggregates combine before the shuffle, so long groups stay cheap. Null keys are dropped. ``order``
    entries must sort ascending with nulls first inside a struct; see ``nulls_last``.
    """
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    df = df.dropna(subset=list(keys))
    # the ordering key is nulled where the value is missing: min_by skips such rows
    picks = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(c) for c in columns]
    return df.groupBy(*keys).agg(*picks)


def nulls_last(col: Column) -> list[Column]:
    return [col.isNull(), col]

