"""Cleaning of the four input tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import schemas
from ..functions import fixed_values as fv
from ..functions import values as v
from .ranking import pick_first


def fill_constants(df: DataFrame, constants: dict[str, object]) -> DataFrame:
    return df.na.fill({c: x for c, x in constants.items() if c in df.columns})


def parse_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text flags become booleans; columns that are boolean already stay."""
    todo = [c for c in columns if c in df.columns and isinstance(df.schema[c].dataType, StringType)]
    return df.withColumns({c: v.parse_text_flag(F.col(c)) for c in todo}) if todo else df


def impute_group_median(
    df: DataFrame, column: str, group: str, default: float, accuracy: int | None = None
) -> DataFrame:
    """Null becomes the median of its group, then the default. A null group gets the default.

    The exact median keeps one counter per distinct value and combines before the shuffle: right for scales
    such as 1 to 10. For a column with very many distinct values pass an ``accuracy`` (1 / relative error).
    The join is left unhinted: Spark broadcasts the medians only after checking their size.
    """
    middle = F.median(column) if accuracy is None else F.percentile_approx(column, 0.5, accuracy)
    medians = df.where(F.col(group).isNotNull()).groupBy(group).agg(middle.alias("_median"))
    return (
        df.join(medians, group, "left")
        .withColumn(column, F.coalesce(F.col(column), F.col("_median"), F.lit(float(default))))
        .select(*df.columns)
    )


def dedup_keep_first(df: DataFrame, key: str, time: str, ties: Sequence[str] | None = None) -> DataFrame:
    """Earliest row per id, rows without a time last; all null ids count as one id.

    Equal times go by ``ties``. Without them a hash of the other columns decides: it is taken before the
    shuffle, so columns that nobody reads later are not shuffled for the sake of the order.
    """
    if ties is not None:
        order = [F.col(c).asc_nulls_first() for c in ties]
        return pick_first(df, [key], [F.col(time).asc_nulls_last(), *order])
    others = [c for c in df.columns if c not in (key, time)]
    hashed = df.withColumn("_tie", F.xxhash64(*others) if others else F.lit(0))
    return pick_first(hashed, [key], [F.col(time).asc_nulls_last(), F.col("_tie")]).drop("_tie")


def dedup_report(df: DataFrame, key: str) -> DataFrame:
    """How many rows the de-duplication removes, via one combined count per id."""
    per_id = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_rows"),
        F.count(F.lit(1)).alias("n_kept"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("n_removed"),
    )


def clean_customers(df: DataFrame) -> DataFrame:
    if "sexo" in df.columns:
        df = df.withColumnRenamed("sexo", "genero")
    df = fill_constants(df, {"estado": "Desconocido", "ciudad": "Desconocido"})
    df = impute_group_median(df, "satisfaccion_1_10", "ocupacion", fv.DEFAULT_SATISFACTION)
    return parse_flags(df, fv.CUSTOMER_FLAGS)


def clean_products(df: DataFrame) -> DataFrame:
    dates = [c for c in ("fecha_apertura", "fecha_ultimo_movimiento") if c in df.columns]
    return df.withColumns(
        {
            **{c: v.parse_timestamp(F.col(c)) for c in dates},
            "utilizacion_pct": v.null_outside(F.col("utilizacion_pct"), 0, 1),
        }
    )


def clean_transactions(df: DataFrame) -> DataFrame:
    if isinstance(df.schema["fecha_hora"].dataType, StringType):
        df = df.withColumn("fecha_hora", v.parse_timestamp(F.col("fecha_hora")))
    df = dedup_keep_first(df, "transaccion_id", "fecha_hora")
    df = fill_constants(df, {"ciudad_transaccion": "Desconocida", "descripcion_libre": ""})
    return parse_flags(df, fv.TRANSACTION_FLAGS)


def clean_turns(df: DataFrame) -> DataFrame:
    df = df.dropna(subset=["input"])
    if isinstance(df.schema["date"].dataType, StringType):
        df = df.withColumn("date", v.parse_timestamp(F.col("date")))
    return df.withColumns(
        {
            "es_voz": F.coalesce(F.col("channel_source") == fv.VOICE_CHANNEL, F.lit(False)).cast("int"),
            "input_len": F.length("input"),
        }
    )


def declared(df: DataFrame, schema: str = schemas.CUSTOMERS) -> DataFrame:
    return schemas.with_columns_of(df, schema, schemas.OPTIONAL_CUSTOMER_COLUMNS)
