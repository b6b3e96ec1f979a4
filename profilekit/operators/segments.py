"""Segmentation: standardised features, k-means with restarts, PCA, naming by centroid."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..session import materialize, temporary
from . import kmeans


@dataclass
class Standardizer:
    """Mean and population deviation per column; a constant column is only centred."""

    columns: list[str]
    means: list[float]
    stds: list[float]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str] = tuple(fv.CLUSTER_FEATURES)) -> "Standardizer":
        present = [c for c in columns if c in df.columns]
        row = df.agg(
            *[F.avg(c).alias(f"m{i}") for i, c in enumerate(present)],
            *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(present)],
        ).first()
        n = range(len(present))
        return cls(present, [float(row[f"m{i}"] or 0.0) for i in n], [float(row[f"s{i}"] or 0.0) or 1.0 for i in n])

    def z(self, column: str) -> Column:
        i = self.columns.index(column)
        return (F.coalesce(F.col(column).cast("double"), F.lit(0.0)) - self.means[i]) / self.stds[i]

    def transform(self, df: DataFrame, prefix: str = "z_") -> DataFrame:
        return df.withColumns({prefix + c: self.z(c) for c in self.columns})

    def vectors(self, df: DataFrame, keep: Sequence[str] = ("user_id",), out: str = "features") -> DataFrame:
        z = df.select(*keep, *[self.z(c).alias(f"_z{i}") for i, c in enumerate(self.columns)])
        names = [f"_z{i}" for i in range(len(self.columns))]
        return VectorAssembler(inputCols=names, outputCol=out).transform(z).drop(*names)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = list(zip(range(len(self.columns)), self.columns, self.means, self.stds))
        spark.createDataFrame(rows, "pos int, columna string, media double, desv double").write.mode(
            "overwrite"
        ).parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Standardizer":
        rows = spark.read.parquet(path).orderBy("pos").collect()
        return cls([r.columna for r in rows], [r.media for r in rows], [r.desv for r in rows])


def zscores(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ("user_id",)) -> DataFrame:
    scaler = Standardizer.fit(df, columns)
    return scaler.transform(df).select(*keep, *[f"z_{c}" for c in scaler.columns])


def kmeans_sweep(
    vectors: DataFrame, ks: Sequence[int] = tuple(range(2, 8)), restarts: int = 10, seed: int = 42,
    max_iter: int = 300, key: str = "user_id",
) -> DataFrame:
    """``k, cost, silhouette`` (squared Euclidean) per number of clusters; all fits share their scans."""
    spark = vectors.sparkSession
    with temporary(spark):
        plain = materialize(vectors.select(key, vector_to_array("features").alias("features")), "vectors")
        best = kmeans.fit_all(plain, [(k, restarts) for k in ks], seed, max_iter, key)
        evaluator = ClusteringEvaluator(featuresCol="v", predictionCol="cluster")
        rows = []
        for k, fit in best.items():
            coordinates = [F.get("features", F.lit(i)) for i in range(fit.centres.shape[1])]
            placed = plain.select(array_to_vector("features").alias("v"), kmeans.nearest(coordinates, fit.centres).cast("double").alias("cluster"))
            several = placed.select("cluster").distinct().count() > 1
            rows.append((k, fit.cost, float(evaluator.evaluate(placed)) if several else None))
    return spark.createDataFrame(rows, "k int, cost double, silhouette double")


@dataclass(frozen=True)
class NameRule:
    """The cluster that lies furthest along one standardised feature gets the name."""

    name: str
    feature: str
    direction: int = 1


def name_clusters(centres: dict[int, dict[str, float]], rules: Sequence[NameRule], other: str = "Segmento") -> dict[int, str]:
    """Rules in order, each names one cluster that has no name yet (ties: the lower id)."""
    names: dict[int, str] = {}
    for rule in rules:
        free = [c for c in sorted(centres) if c not in names]
        if free:
            names[max(free, key=lambda c: (rule.direction * centres[c].get(rule.feature, 0.0), -c))] = rule.name
    for c in sorted(centres):
        names.setdefault(c, f"{other} {c}")
    return names


def centres_of(df: DataFrame, cluster: str, columns: Sequence[str]) -> dict[int, dict[str, float]]:
    """Mean of each column per cluster: one row per cluster."""
    rows = df.groupBy(cluster).agg(*[F.avg(c).alias(c) for c in columns]).collect()
    return {r[cluster]: {c: float(r[c]) for c in columns} for r in rows}


def named(column: Column, names: dict[int, str]) -> Column:
    out = F.lit(None).cast("string")
    for c, name in names.items():
        out = F.when(column == c, name).otherwise(out)
    return out


@dataclass
class Segmentation:
    """Fitted scaler, centres in the order of their ids, names and the cost of the fit."""

    scaler: Standardizer
    centres: np.ndarray
    names: dict[int, str]
    cost: float

    @classmethod
    def fit(
        cls,
        master: DataFrame,
        rules: Sequence[NameRule],
        columns: Sequence[str] = tuple(fv.CLUSTER_FEATURES),
        k: int = 6,
        restarts: int = 15,
        seed: int = 42,
        max_iter: int = 300,
    ) -> "Segmentation":
        scaler = Standardizer.fit(master, columns)
        vectors = scaler.vectors(master).select("user_id", vector_to_array("features").alias("features"))
        best = kmeans.fit_all(vectors, [(k, restarts)], seed, max_iter)
        if not best:
            raise ValueError("there are no rows to segment")
        fitted = cls(scaler, best[k].centres, {}, best[k].cost)
        sizes = {r["segmento_id"]: r["count"] for r in fitted.transform(master).groupBy("segmento_id").count().collect()}
        # ids by falling size, ties by centroid, so that they do not depend on the seed
        order = sorted(range(k), key=lambda c: (-sizes.get(c, 0), tuple(np.round(fitted.centres[c], 9))))
        fitted.centres = fitted.centres[order]
        fitted.names = name_clusters({i: dict(zip(scaler.columns, map(float, c))) for i, c in enumerate(fitted.centres)}, rules)
        return fitted

    def transform(self, master: DataFrame) -> DataFrame:
        """Adds ``segmento_id`` and ``segmento_nombre``; narrow, the rows are not shuffled."""
        number = kmeans.nearest([self.scaler.z(c) for c in self.scaler.columns], self.centres)
        out = master.withColumn("segmento_id", number)
        return out.withColumn("segmento_nombre", named(F.col("segmento_id"), self.names))

    def save(self, spark: SparkSession, path: str) -> None:
        self.scaler.save(spark, f"{path}/scaler")
        rows = [(i, self.names[i], list(map(float, c)), self.cost) for i, c in enumerate(self.centres)]
        spark.createDataFrame(rows, "id int, nombre string, centro array<double>, costo double").write.mode("overwrite").parquet(f"{path}/centres")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Segmentation":
        rows = spark.read.parquet(f"{path}/centres").orderBy("id").collect()
        return cls(Standardizer.load(spark, f"{path}/scaler"), np.array([r.centro for r in rows]), {r.id: r.nombre for r in rows}, rows[0].costo)


def pca2(vectors: DataFrame, keep: Sequence[str] = ("user_id",)) -> DataFrame:
    """First two principal components of centred vectors; the largest loading of each is positive."""
    model = PCA(k=2, inputCol="features", outputCol="_p").fit(vectors)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[np.argmax(np.abs(loadings[:, j])), j] >= 0 else -1.0 for j in range(2)]
    parts = model.transform(vectors).withColumn("_p", vector_to_array("_p"))
    return parts.select(
        *keep, (F.get("_p", F.lit(0)) * signs[0]).alias("pca_x"), (F.get("_p", F.lit(1)) * signs[1]).alias("pca_y")
    )
