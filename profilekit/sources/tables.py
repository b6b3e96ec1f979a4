"""Readers and writers for the input tables, the result tables and the row store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import fixed_values as fv
from ..operators.ranking import pick_first


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = False) -> DataFrame:
    """CSV with header and quoted text, read against a declared schema (no inference pass).

    Large files are split among tasks, unless quoted texts may hold line breaks (``multi_line``): then one task reads a file.

    Columns are matched by position, so the file order has to be the schema order; ``enforceSchema``
    off makes Spark check the header against it. The usual spellings of a missing value become null.
    """
    df = (
        spark.read.schema(schema)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("enforceSchema", False)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .csv(path)
    )
    missing = {
        **{c: F.when(~F.col(c).isin(*fv.MISSING_TEXTS), F.col(c)) for c, t in df.dtypes if t == "string"},
        **{c: F.nanvl(F.col(c), F.lit(None)) for c, t in df.dtypes if t == "double"},
    }
    return df.withColumns(missing) if missing else df


def read_customers(spark: SparkSession, path: str, schema: T.StructType | str = schemas.CUSTOMERS) -> DataFrame:
    return read_csv(spark, path, schema)


def read_products(spark: SparkSession, path: str, schema: T.StructType | str = schemas.PRODUCTS) -> DataFrame:
    return read_csv(spark, path, schema)


def read_transactions(spark: SparkSession, path: str, schema: T.StructType | str = schemas.TRANSACTIONS) -> DataFrame:
    return read_csv(spark, path, schema)


def read_turns(spark: SparkSession, path: str, schema: T.StructType | str = schemas.TURNS) -> DataFrame:
    """Turns without a message are dropped; messages may hold line breaks."""
    return read_csv(spark, path, schema, multi_line=True).dropna(subset=["input"])


def with_turn_ids(turns: DataFrame, name: str = "message_id") -> DataFrame:
    """A repeatable integer id per turn, for files that bring none: it only decides between equal times.

    It is a hash of the row, so rereading or recomputing the table gives the same ids; rows that are equal in
    every column may share one, and swapping those changes nothing.
    """
    return turns.withColumn(name, F.xxhash64(*[c for c in turns.columns if c != name]))


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_csv_inferred(spark, path) if fmt == "csv" else spark.read.format(fmt).load(path)


def read_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """For small result files only: types are inferred with an extra pass."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        # blanks around a text are kept
        writer = writer.option("header", True).option("escape", '"').option("emptyValue", '""')
        writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def scan(
    df: DataFrame,
    columns: Sequence[str],
    equals: dict[str, object] | None = None,
    order_by: Sequence[Column] = (),
    limit: int | None = None,
) -> DataFrame:
    """Select list, equality filters, order and limit; pushed to Parquet or to a JDBC source."""
    for name, value in (equals or {}).items():
        df = df.where(F.col(name) == value)
    df = df.orderBy(*order_by) if order_by else df
    df = df.limit(limit) if limit is not None else df
    return df.select(*columns)


def lookup(profiles: DataFrame, keys: DataFrame, key: str = "user_id") -> DataFrame:
    """Rows of the wanted keys; Spark picks broadcast or shuffle from the size of the key table."""
    return profiles.join(keys.select(key).distinct(), key, "left_semi")


def lookup_one(profiles: DataFrame, value: object, key: str = "user_id") -> DataFrame:
    found = profiles.where(F.col(key) == value)
    if found.isEmpty():
        raise KeyError(f"{key} {value!r} not found")
    return found


def corpus(turns: DataFrame, min_answer: int = 30) -> DataFrame:
    """Question and answer both present, answer longer than ``min_answer`` characters."""
    return turns.dropna(subset=["input", "output"]).where(F.length("output") > min_answer)


def as_messages(turns: DataFrame, carry: Sequence[str], user_text: str = "input", reply: str = "output") -> DataFrame:
    """One answered turn becomes two stored messages, user first."""
    pair = F.array(
        F.struct(F.lit(0).alias("seq"), F.lit("user").alias("rol"), F.col(user_text).alias("contenido")),
        F.struct(F.lit(1).alias("seq"), F.lit("assistant").alias("rol"), F.col(reply).alias("contenido")),
    )
    return turns.select(*carry, F.explode(pair).alias("m")).select(
        *carry, "m.seq", "m.rol", F.lit("texto").alias("tipo"), "m.contenido"
    )


def append_messages(messages: DataFrame, path: str) -> None:
    messages.write.mode("append").parquet(path)


def open_sessions(sessions: DataFrame) -> DataFrame:
    """One open session per user, the one with the lowest id."""
    return pick_first(sessions.where("activa"), ["user_id"], [F.col("id").asc()])
