"""Builds the noise prototypes and the retrieval index from turns that carry an embedding column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import noise_label
from ..operators import measures, tfidf, vectors, views
from ..sources import tables


@dataclass
class RetrievalJob:
    spark: SparkSession
    out: str

    def _stage(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.out}/{name}"
        tables.write_table(df, path)
        return self.spark.read.schema(df.schema).parquet(path)

    def prototypes(self, turns: DataFrame, vec: str = "embedding") -> vectors.PrototypeModel:
        """Labels by rule, prototypes, calibrated threshold, label shares and the report; all saved."""
        labelled = self._stage(
            turns.dropna(subset=["input", vec]).withColumn("clase", noise_label(F.col("input"))), "turnos_clase"
        )
        tables.write_table(views.label_distribution(labelled, "clase"), f"{self.out}/distribucion")
        model = vectors.PrototypeModel.fit(labelled, vec)
        model.save(self.spark, f"{self.out}/prototipos")
        judged = model.classify(labelled, vec).select(
            (F.col("clase") == model.noise).cast("int").alias("real"),
            F.col("es_noise").cast("int").alias("previsto"),
        )
        tables.write_table(measures.classification_report(judged, "real", "previsto"), f"{self.out}/reporte")
        return model

    def dense(self, turns: DataFrame, vec: str = "embedding", tie: str = "turn") -> DataFrame:
        """Index entries with the vector of the first question of each conversation."""
        return self._stage(vectors.index_metadata(vectors.dense_index(turns, tie, ("user_id", vec))), "indice")

    def sparse(self, turns: DataFrame, tie: str = "turn") -> tuple[tfidf.TfidfModel, DataFrame, DataFrame]:
        """TF-IDF model (saved for later sessions), corpus and its written matrix rows."""
        corpus = self._stage(vectors.first_turns(tables.corpus(turns), ["input", "output"], tie), "corpus")
        model = tfidf.TfidfModel.fit(corpus, "conv_id", "input")
        model.save(f"{self.out}/tfidf")
        return model, corpus, self._stage(model.rows(corpus, "conv_id", "input"), "corpus_filas")
