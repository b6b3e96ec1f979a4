"""Prototype classifier and dense retrieval over an embedding column.

Vector arithmetic runs in Arrow batches inside the tasks: Spark's higher-order array functions are
interpreted per element, a matrix product is not.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text as tx
from .blocks import best_pairs, dense_rows
from .ranking import first_present, nulls_last, top_per_key

EPS = 1e-9
MAX_FIXED_VECTORS = 4096


def dot_with(vec: Column, fixed: np.ndarray) -> Column:
    """Dot products of each row's vector with a few fixed vectors, as ``array<double>``.

    ``fixed`` is a model (class prototypes, centroids), one row per class, and travels with the task.
    """
    if len(fixed) > MAX_FIXED_VECTORS:
        raise ValueError(f"{len(fixed)} vectors are no small model; use dense_topk")
    kernel = np.ascontiguousarray(np.asarray(fixed, dtype=np.float64).T)

    @F.arrow_udf("array<double>")
    def product(batch: pa.Array) -> pa.Array:
        valid = np.asarray(batch.is_valid())
        sims = dense_rows(batch.drop_null(), kernel.shape[0]) @ kernel
        offsets = np.r_[0, np.cumsum(valid * kernel.shape[1])].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(sims.ravel()), mask=pa.array(~valid))

    return product(vec)


def squared_norm(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x)


def l2_normalize(vec: Column) -> Column:
    norm = F.sqrt(squared_norm(vec)) + EPS
    return F.transform(vec, lambda x: x.cast("double") / norm)


def class_prototypes(df: DataFrame, vec: str = "embedding", label: str = "clase") -> DataFrame:
    """Normalised mean vector per class. The summarizer keeps one running vector per class and task."""
    means = (
        df.where(F.col(vec).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(label).alias("label"))
        .agg(Summarizer.mean(array_to_vector(F.col(vec))).alias("m"), F.count(F.lit(1)).alias("n"))
    )
    return means.select("label", l2_normalize(vector_to_array("m")).alias("proto"), "n")


@dataclass
class PrototypeModel:
    """Class prototypes and the calibrated threshold for the noise class."""

    vectors: dict[str, np.ndarray]
    counts: dict[str, int] = field(default_factory=dict)
    threshold: float = fv.DEFAULT_THRESHOLD
    noise: str = "noise"
    on_topic: str = "on_topic"

    @classmethod
    def fit(cls, df: DataFrame, vec: str = "embedding", label: str = "clase", calibrate: bool = True) -> "PrototypeModel":
        rows = class_prototypes(df, vec, label).collect()  # one row per class
        model = cls({r.label: np.array(r.proto) for r in rows}, {r.label: r.n for r in rows})
        if calibrate:
            scored = model.transform(df, vec).withColumn("_truth", (F.col(label) == model.noise).cast("int"))
            model.threshold = best_threshold(threshold_sweep(scored, "score", "_truth"))
        return model

    def sims(self, df: DataFrame, vec: str = "embedding") -> DataFrame:
        """Adds ``sim_<class>`` per class."""
        names = sorted(self.vectors)
        dots = dot_with(F.col(vec), np.array([self.vectors[n] for n in names]))
        out = df.withColumn("_dots", dots)
        return out.withColumns({f"sim_{n}": F.get("_dots", F.lit(i)) for i, n in enumerate(names)}).drop("_dots")

    def transform(self, df: DataFrame, vec: str = "embedding") -> DataFrame:
        """Adds the similarities and the relative score."""
        noise, topic = F.col(f"sim_{self.noise}"), F.col(f"sim_{self.on_topic}")
        return self.sims(df, vec).withColumn("score", relative_score(noise, topic))

    def classify(self, df: DataFrame, vec: str = "embedding") -> DataFrame:
        return self.transform(df, vec).withColumn("es_noise", F.col("score") >= F.lit(self.threshold))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(n, [float(x) for x in v], int(self.counts.get(n, 0))) for n, v in self.vectors.items()]
        spark.createDataFrame(rows, "label string, proto array<double>, n bigint").write.mode("overwrite").parquet(
            f"{path}/prototypes"
        )
        spark.createDataFrame(
            [(self.threshold, self.noise, self.on_topic)], "threshold double, noise string, on_topic string"
        ).write.mode("overwrite").parquet(f"{path}/params")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "PrototypeModel":
        rows = spark.read.parquet(f"{path}/prototypes").collect()
        p = spark.read.parquet(f"{path}/params").first()
        return cls(
            {r.label: np.array(r.proto) for r in rows}, {r.label: r.n for r in rows}, p.threshold, p.noise, p.on_topic
        )


def relative_score(noise: Column, on_topic: Column) -> Column:
    """Not clipped: a negative similarity can push it out of [0, 1]."""
    return F.try_divide(noise, noise + on_topic + F.lit(EPS))


def threshold_sweep(
    df: DataFrame, score: str, truth: str, grid: Sequence[float] = tuple(fv.THRESHOLD_GRID)
) -> DataFrame:
    """F1 for every threshold of the grid, from one pass over the rows.

    Rows are reduced to one count per grid interval first; every threshold then adds up intervals.
    """
    s = F.col(score)
    interval = sum(((s >= F.lit(t)).cast("int") for t in grid), F.lit(0))
    counts = (
        df.where(s.isNotNull() & F.col(truth).isNotNull())
        .select(interval.alias("i"), F.col(truth).cast("int").alias("t"))
        .groupBy("i")
        .agg(F.sum("t").alias("pos"), F.sum(1 - F.col("t")).alias("neg"))
    )
    # at most one entry per grid interval, so the list is bounded by the grid
    listed = counts.agg(F.collect_list(F.struct("i", "pos", "neg")).alias("c"))

    def added(above: Column | None, name: str) -> Column:
        rows = F.col("c") if above is None else F.filter("c", lambda x: x["i"] > above)
        return F.aggregate(rows, F.lit(0).cast("bigint"), lambda a, x: a + x[name])

    steps = F.posexplode(F.array(*[F.lit(float(t)) for t in grid])).alias("j", "umbral")
    tp, fp, p = added(F.col("j"), "pos"), added(F.col("j"), "neg"), added(None, "pos")
    rows = listed.select("c", steps).select("umbral", tp.alias("tp"), fp.alias("fp"), (p - tp).alias("fn"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return rows.withColumn("f1", f1)


def best_threshold(sweep: DataFrame, default: float = fv.DEFAULT_THRESHOLD) -> float:
    """Highest F1, the first threshold that reaches it; the default if none is above 0."""
    best = sweep.where("f1 > 0").orderBy(F.col("f1").desc(), "umbral").first()
    return float(best["umbral"]) if best else default


# --- retrieval index -------------------------------------------------------------------------------


def first_turns(turns: DataFrame, columns: Sequence[str], tie: str = "turn") -> DataFrame:
    """First value per conversation in time order, per column the first that is not null."""
    return first_present(turns, ["conv_id"], [*nulls_last(F.col("date")), F.col(tie)], columns)


def dense_index(turns: DataFrame, tie: str = "turn", extra: Sequence[str] = ("user_id",)) -> DataFrame:
    """Index entries: on-topic turns with a real question and answer, the first of each conversation."""
    good = turns.where(
        (tx.noise_label(F.col("input")) == "on_topic") & (F.length("output") > 30) & (F.length("input") > 5)
    )
    return first_turns(good, ["input", "output", *extra], tie)


def index_metadata(index: DataFrame) -> DataFrame:
    return index.withColumns({"input": F.substring("input", 1, 200), "output": F.substring("output", 1, 400)})


def dense_topk(
    queries: DataFrame,
    corpus: DataFrame,
    query_id: str,
    doc_id: str,
    vec: str = "embedding",
    answer: str = "output",
    k: int = fv.TOP_K,
    min_sim: float = fv.DENSE_MIN_SIM,
    factor: int = fv.CANDIDATE_FACTOR,
    prefix: int = fv.ANSWER_PREFIX,
    carry: Sequence[str] = (),
    broadcast_bytes: int | None = None,
) -> DataFrame:
    """Most similar entries per query: the best ``factor * k`` above ``min_sim``, then one per answer prefix."""
    pairs = best_pairs(
        queries.select(F.col(query_id).alias("q"), F.col(vec).alias("v")),
        corpus.select(F.col(doc_id).alias("d"), F.col(vec).alias("v")),
        min_sim, factor * k, **({"broadcast_bytes": broadcast_bytes} if broadcast_bytes is not None else {}),
    )
    return distinct_answers(pairs, corpus, query_id, doc_id, answer, k, prefix, carry)


def distinct_answers(
    pairs: DataFrame, corpus: DataFrame, query_id: str, doc_id: str, answer: str, k: int, prefix: int,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Adds the answers to candidate pairs, keeps the best per answer prefix and numbers the top ``k``."""
    texts = corpus.select(F.col(doc_id).alias("d"), F.col(answer), *carry)
    # candidates are few per query: Spark sees their size and decides how to join
    # one exchange by query serves both windows below
    full = pairs.join(texts, "d").repartition("q").withColumn("_prefix", F.substring(answer, 1, prefix))
    order = [F.col("sim").desc(), F.col("d").asc()]
    best = top_per_key(full, ["q", "_prefix"], order, 1)
    return top_per_key(best, ["q"], order, k, position="rn").select(
        F.col("q").alias(query_id), "rn", F.col("d").alias(doc_id), F.round("sim", 3).alias("similitud"), answer, *carry
    )


def retrieval_context(
    hits: DataFrame, query_id: str, question: str = "input", answer: str = "output", heading: str = "",
    with_similarity: bool = False,
) -> DataFrame:
    """One text block per query with the numbered examples; at most ``k`` short rows per query are gathered."""
    rows = F.array_sort(F.collect_list(F.struct("rn", question, answer, "similitud")))

    def example(r: Column) -> Column:
        label = F.concat(F.lit("Ejemplo "), r["rn"].cast("string"))
        if with_similarity:
            percent = F.round(r["similitud"] * 100).cast("int").cast("string")
            label = F.concat(label, F.lit(" ("), percent, F.lit("%)"))
        return F.concat(label, F.lit(":\nPregunta: "), r[question], F.lit("\nRespuesta: "), r[answer], F.lit("\n"))

    blocks = hits.groupBy(query_id).agg(rows.alias("_rows"))
    return blocks.select(
        query_id, F.concat(F.lit(heading), F.array_join(F.transform("_rows", example), "\n")).alias("contexto")
    )
