"""The wide one-row-per-user table and its numeric encoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fv
from ..session import materialize

MISSING_TEXT = "0"


def join_features(customers: DataFrame, *features: DataFrame) -> DataFrame:
    """Left joins on ``user_id``. All sides end up hashed on that one key, so each is shuffled once."""
    out = customers
    for f in features:
        out = out.join(f, "user_id", "left")
    return out


def fill_missing(df: DataFrame, keep: Sequence[str] = ("user_id",)) -> DataFrame:
    """Null becomes 0, False or the text sentinel ``'0'``, depending on the type."""
    filled = {}
    for field in df.schema:
        if field.name in keep:
            continue
        if isinstance(field.dataType, T.BooleanType):
            filled[field.name] = F.coalesce(F.col(field.name), F.lit(False))
        elif isinstance(field.dataType, T.NumericType):
            filled[field.name] = F.coalesce(F.col(field.name), F.lit(0).cast(field.dataType))
        elif isinstance(field.dataType, T.StringType):
            filled[field.name] = F.coalesce(F.col(field.name), F.lit(MISSING_TEXT))
    return df.withColumns(filled)


def master(customers: DataFrame, transactions: DataFrame, products: DataFrame, conversations: DataFrame) -> DataFrame:
    """Customers with their three feature families; categories stay readable, see ``CategoryEncoder``."""
    return fill_missing(join_features(customers, transactions, products, conversations))


def dense_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``c, label, code``: the distinct labels of each column (by its position) numbered from 0 in binary order.

    Labels are cut into ranges, numbered within each range and moved by the sizes of the ranges before; only a row per
    range is summed up in one place. Nulls have no code. The table is written.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(name).alias("label")) for i, name in enumerate(columns)]))
    labels = df.select(pairs.alias("_p")).select("_p.*").where("label is not null").distinct()
    ordered = labels.repartitionByRange("c", "label").sortWithinPartitions("c", "label")
    # the id holds the range and, in its lower 33 bits, the place within it
    placed = materialize(ordered.withColumn("_id", F.monotonically_increasing_id()), "labels", keep=True)
    placed = placed.select("c", "label", F.shiftright("_id", 33).alias("_range"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_i"))
    sizes = placed.groupBy("c", "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_least"))
    before = Window.partitionBy("c").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("c", "_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_least")).alias("_shift"))
    coded = placed.join(shift, ["c", "_range"]).select("c", "label", (F.col("_i") + F.col("_shift")).cast("int").alias("code"))
    return materialize(coded, "codes", keep=True)


class CategoryEncoder:
    """Text categories as integer codes in alphabetical (binary) order, fitted once and reused for scoring.

    The codes are a written table of which nothing but the number of labels per column reaches the driver.
    """

    def __init__(self, columns: Sequence[str] = tuple(fv.CATEGORICAL), suffix: str = "_code") -> None:
        self.columns, self.suffix = list(columns), suffix
        self.codes: DataFrame | None = None
        self.sizes: list[int] = []

    def fit(self, df: DataFrame) -> "CategoryEncoder":
        self.columns = [c for c in self.columns if c in df.columns]
        if self.columns:
            self._use(dense_codes(df, self.columns))
        return self

    def _use(self, codes: DataFrame) -> None:
        self.codes = codes
        found = {r.c: r.n for r in codes.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
        self.sizes = [found.get(i, 0) for i in range(len(self.columns))]

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``<column>_code``; categories unseen in the fit, and nulls, get the next free code."""
        out = df
        for i, c in enumerate(self.columns):
            own = self.codes.where(F.col("c") == i).select(F.col("label").alias("_label"), F.col("code").alias("_code"))
            found = out.join(own, F.col(c) == F.col("_label"), "left")
            out = found.withColumn(c + self.suffix, F.coalesce("_code", F.lit(self.sizes[i]))).drop("_label", "_code")
        return out

    def save(self, path: str) -> None:
        names = self.codes.sparkSession.createDataFrame([(i, c) for i, c in enumerate(self.columns)], "c int, columna string") if self.columns else None
        if names is not None:
            names.write.mode("overwrite").parquet(f"{path}/columns")
            self.codes.write.mode("overwrite").parquet(f"{path}/codes")

    @classmethod
    def load(cls, spark: SparkSession, path: str, columns: Sequence[str]) -> "CategoryEncoder":
        """``columns`` are those that were saved; without any there is nothing to read."""
        out = cls(columns)
        if columns:
            out.columns = [r.columna for r in spark.read.parquet(f"{path}/columns").orderBy("c").collect()]
            out._use(spark.read.parquet(f"{path}/codes"))
        return out


def encode_categories(df: DataFrame, columns: Sequence[str] = tuple(fv.CATEGORICAL)) -> DataFrame:
    return CategoryEncoder(columns).fit(df).transform(df)


def feature_matrix(df: DataFrame, columns: Sequence[str], encoder: CategoryEncoder | None = None) -> DataFrame:
    """The wanted columns that exist, once each, all as doubles. Text columns use the fitted codes;
    what cannot be a number is left out, what is missing counts as 0."""
    wanted = [c for c in dict.fromkeys(columns) if c in df.columns and c != "user_id"]
    text = [c for c in wanted if isinstance(df.schema[c].dataType, T.StringType)]
    encoder = encoder or CategoryEncoder(text).fit(df)
    coded = encoder.transform(df)
    out = []
    for c in wanted:
        kind = df.schema[c].dataType
        if c in text and c in encoder.columns:
            out.append(F.col(c + encoder.suffix).cast("double").alias(c))
        elif isinstance(kind, (T.NumericType, T.BooleanType)):
            number = F.col(c).cast("int") if isinstance(kind, T.BooleanType) else F.col(c)
            out.append(F.coalesce(F.nanvl(number.cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c))
    return coded.select("user_id", *out)
