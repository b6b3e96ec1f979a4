"""Tolerant parsing and value repair as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_flag(col: Column) -> Column:
    """Text ``True`` / ``False`` or a real boolean; anything else is null."""
    text = F.lower(col.cast("string"))
    return F.when(text == "true", True).when(text == "false", False)


def parse_text_flag(col: Column) -> Column:
    """Exactly ``'True'`` / ``'False'``; anything else is null."""
    return F.when(col == "True", True).when(col == "False", False)


def parse_timestamp(col: Column) -> Column:
    """Naive timestamp, null when the text is not one."""
    return F.try_to_timestamp(col.cast("string")).cast("timestamp_ntz")


def null_outside(col: Column, low: float, high: float) -> Column:
    return F.when(col.between(low, high), col)


def finite(col: Column) -> Column:
    """NaN and infinities become null."""
    bad = F.isnan(col) | (col == float("inf")) | (col == float("-inf"))
    return F.when(~bad, col)


def safe_double(col: Column) -> Column:
    return F.coalesce(col.try_cast("double"), F.lit(0.0))


def safe_int(col: Column) -> Column:
    """Truncated towards zero; values that are no finite number count as 0."""
    return F.coalesce(finite(safe_double(col)).try_cast("bigint"), F.lit(0)).cast("bigint")


def safe_bool(col: Column) -> Column:
    return safe_int(col) != 0


def currency(col: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(col, 0))


def share(condition: Column) -> Column:
    """Share of rows where the condition holds; null counts as no but stays in the denominator."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def total(col: Column) -> Column:
    """Sum that is 0, not null, when there is nothing to add."""
    return F.coalesce(F.sum(col), F.lit(0.0))
