"""Per-key running values in time order that survive very long keys.

A plain window would sort all rows of a key in one task. Here the rows are ranged by key, time and tie-breaker and
written once; a range holds about as many rows as any other, whatever the keys, days or missing times. Each (key,
range) piece is a window of its own, and a small table with one row per piece carries sums and last values from
range to range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def ranged(df: DataFrame, keys: Sequence[str], time: str, tie: str) -> DataFrame:
    """``df`` written with ``_part``, which never decreases along (keys, time nulls last, tie).

    There are as many ranges as shuffle partitions; adaptive execution joins neighbours that are measured to be small.
    """
    order = [*keys, F.col(time).asc_nulls_last(), F.col(tie)]
    return materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges", keep=True)


def running(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    tie: str,
    sums: dict[str, Column] | None = None,
    totals: dict[str, Column] | None = None,
    previous: dict[str, str] | None = None,
) -> DataFrame:
    """Adds running sums (current row included), whole-key sums and the previous row's time.

    ``sums`` / ``totals``: new column -> integer expression; ``previous``: new column -> time column
    (only the ordering column itself makes sense). Rows with a null key are dropped.
    """
    sums, totals, previous = sums or {}, totals or {}, previous or {}
    keys = list(keys)
    cut = [*keys, "_part"]
    sliced = ranged(df.dropna(subset=keys), keys, time, tie)

    inside = Window.partitionBy(*cut).orderBy(F.col(time).asc_nulls_last(), F.col(tie))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = sliced.withColumns(
        {
            **{name: F.sum(expr).over(upto) for name, expr in sums.items()},
            **{name: F.lag(col).over(inside) for name, col in previous.items()},
        }
    )

    per_slice = sliced.groupBy(*cut).agg(
        *[F.sum(e).alias(f"_s_{n}") for n, e in sums.items()],
        *[F.sum(e).alias(f"_t_{n}") for n, e in totals.items()],
        *[F.max(c).alias(f"_p_{n}") for n, c in previous.items()],
        F.count(F.lit(1)).alias("_rows"),
    )
    whole = Window.partitionBy(*keys)
    across = whole.orderBy("_part")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carry = per_slice.select(
        *cut,
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in sums],
        *[F.sum(f"_t_{n}").over(whole).alias(n) for n in totals],
        *[F.lag(f"_p_{n}").over(across).alias(f"_p_{n}") for n in previous],
    )
    joined = rows.join(carry, cut)
    return joined.select(
        *df.columns,
        *[(F.col(n) + F.col(f"_s_{n}")).alias(n) for n in sums],
        *totals,
        *[F.coalesce(F.col(n), F.col(f"_p_{n}")).alias(n) for n in previous],
    )
