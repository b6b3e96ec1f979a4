"""Named queries over the given tables and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import require_settings

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

DIGITS = 6
# added before rounding on both sides: exact ties would otherwise fall either way with the last bit of a sum
NUDGE = 1.234e-8


def query(name: str, check: str | None = None, raw: bool = False) -> Callable[[Query], Query]:
    """Registers a query; ``raw`` keeps doubles as they are, for values that are only passed through."""

    def add(run: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: plain(run(require_settings(spark), sf_dir), raw)
        if check is not None:
            CHECKS[name] = check
        return run

    return add


def plain(df: DataFrame, raw: bool = False) -> DataFrame:
    """Comparable types: times as microseconds, doubles rounded beyond summation noise."""
    out = {}
    for f in df.schema:
        if isinstance(f.dataType, T.TimestampNTZType):
            out[f.name] = F.unix_micros(F.col(f.name).cast("timestamp"))
        elif isinstance(f.dataType, T.TimestampType):
            out[f.name] = F.unix_micros(f.name)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)) and not raw:
            out[f.name] = F.round(F.col(f.name).cast("double") + F.lit(NUDGE), DIGITS)
    return df.withColumns(out) if out else df
