"""Summary tables and serving views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fv
from ..functions.text import dim_key
from ..functions.values import finite, safe_bool, safe_double, safe_int, share
from .ranking import pick_first, top_per_key

NO_SEGMENT = "Sin segmento"


def with_share(counts: DataFrame, n: str, out: str, digits: int | None = 3) -> DataFrame:
    """Share of the total; ``counts`` has one row per label, so the unpartitioned window stays small."""
    part = F.col(n) / F.sum(n).over(Window.partitionBy())
    return counts.withColumn(out, F.round(part, digits) if digits is not None else part)


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return with_share(df.groupBy(label).agg(F.count(F.lit(1)).alias("n")), "n", "share", None)


def segment_profile(df: DataFrame, columns: Sequence[str], segment: str = "segmento_nombre") -> DataFrame:
    return df.groupBy(segment).agg(*[F.round(F.avg(c), 2).alias(c) for c in columns])


def _first_by_id(column: str, order: str) -> Column:
    # the first row's value, null or not
    return F.min_by(F.struct(F.col(column)), order)[column]


def segment_summary(active: DataFrame, order: str = "id", dimensions: Sequence[str] = ("tono", "horario")) -> DataFrame:
    """Per segment: users, share, first row's dimensions, mean noise of those that have one.

    Rows without a segment form a group of their own; a table without the column is one unnamed segment.
    """
    present = [d for d in dimensions if d in active.columns]
    segment = F.col("segmento_nombre") if "segmento_nombre" in active.columns else F.lit(NO_SEGMENT)
    counts = (
        active.withColumn("segmento", segment)
        .groupBy("segmento")
        .agg(
            F.count(F.lit(1)).alias("n_usuarios"),
            *[_first_by_id(d, order).alias(d) for d in present],
            F.coalesce(F.round(F.avg("noise_score_usuario"), 3), F.lit(0.0)).alias("noise_pct_medio"),
        )
    )
    return with_share(counts, "n_usuarios", "pct").orderBy(F.col("n_usuarios").desc(), "segmento")


def segment_summary_b(profiles: DataFrame, order: str = "user_id") -> DataFrame:
    """The profile-table form: more dimensions and the churn share; a null segment is left out."""
    present = [d for d in ("tono", "longitud", "horario") if d in profiles.columns]
    counts = (
        profiles.groupBy(F.col("segmento_nombre").alias("segmento"))
        .agg(
            F.count(F.lit(1)).alias("n_usuarios"),
            *[_first_by_id(d, order).alias(d) for d in present],
            F.round(F.avg("noise_score_usuario"), 3).alias("noise_pct_medio"),
            F.round(F.avg("flag_riesgo_churn"), 3).alias("flag_churn_pct"),
        )
    )
    # the share is of all profiles, the unnamed ones included
    return (
        with_share(counts, "n_usuarios", "pct")
        .where(F.col("segmento").isNotNull())
        .orderBy(F.col("n_usuarios").desc(), "segmento")
    )


def propensity_by_segment(profiles: DataFrame, scores: Sequence[str], segment: str = "segmento_nombre") -> DataFrame:
    """Mean score per segment and product, long form: averages first, then a narrow unpivot."""
    wide = profiles.groupBy(segment).agg(*[F.avg(c).alias(c) for c in scores])
    return wide.unpivot([segment], list(scores), "producto", "score_medio")


def top_product_freq(profiles: DataFrame, column: str = "producto_top_1") -> DataFrame:
    named = profiles.where(F.col(column) != "")
    counts = named.groupBy(F.col(column).alias("producto")).agg(F.count(F.lit(1)).alias("n"))
    return with_share(counts, "n", "share", None).orderBy(F.col("n").desc(), "producto")


def profile_run_summary(profiles: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    checks = {
        "con_recomendacion": F.col("producto_top_1") != "",
        "churn": F.col("flag_riesgo_churn") == 1,
        "estresado": F.col("flag_credito_estresado") == 1,
        "ruido": F.col("noise_score_usuario") > fv.USER_GATE,
    }
    return profiles.agg(
        n.alias("n_total"),
        *[F.count_if(c).alias(f"n_{k}") for k, c in checks.items()],
        *[share(c).alias(f"pct_{k}") for k, c in checks.items()],
    )


def health_counts(users: DataFrame, classifications: DataFrame) -> DataFrame:
    """Users and distinct segments of the active classifications; a null segment counts as one."""
    segments = classifications.where("activo").select("segmento_nombre").distinct()
    rows = users.select(F.lit(1).alias("u"), F.lit(None).cast("string").alias("s")).unionAll(
        segments.select(F.lit(0), "segmento_nombre")
    )
    return rows.agg(
        F.count_if(F.col("u") == 1).alias("n_usuarios"),
        F.count_if(F.col("u") == 0).alias("n_segmentos"),
        F.count("s").alias("n_segmentos_con_nombre"),
    )


def index_stats(turns: DataFrame, index: DataFrame) -> DataFrame:
    """Corpus turns and conversations beside the index size and its mean text lengths."""
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("double")
    rows = convs.select(F.col("conv_id").isNotNull().cast("int").alias("c"), "n", none.alias("i"), none.alias("o"))
    docs = index.select(F.lit(None).cast("int"), F.lit(0), F.length("input"), F.length("output"))
    return rows.unionAll(docs).agg(
        F.sum("n").alias("n_turnos"),
        F.sum("c").alias("n_convs"),
        F.count_if(F.col("c").isNull()).alias("n_docs"),
        F.avg("i").alias("len_input"),
        F.avg("o").alias("len_output"),
    )


def session_summary(turn_log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per session, from the turn log (``noise_gate, noise_score, n_rag_docs, rag_sims``)."""
    sims = F.coalesce("rag_sims", F.array().cast("array<double>"))
    added = F.aggregate(sims, F.lit(0.0), lambda a, x: a + x)
    n = F.count(F.lit(1))
    return turn_log.groupBy(*keys).agg(
        n.alias("total_turnos"),
        F.count_if("noise_gate").alias("turnos_noise"),
        F.round(F.count_if("noise_gate") / n, 3).alias("pct_noise"),
        F.round(F.sum("noise_score") / n, 3).alias("noise_score_medio"),
        F.sum("n_rag_docs").alias("docs_rag_total"),
        F.round(F.sum(added) / F.greatest(F.sum(F.size(sims)), F.lit(1)), 3).alias("rag_sim_media"),
    )


# --- serving views -------------------------------------------------------------------------------


def users_per_segment(
    active: DataFrame, segment_order: Sequence[str], n: int = 2, segment: str = "segmento_nombre"
) -> DataFrame:
    """At most ``n`` users per segment, segments in the given order, unknown ones last."""
    rank = F.lit(99)
    for i, name in reversed(list(enumerate(segment_order))):
        rank = F.when(F.col(segment) == name, i).otherwise(rank)
    picked = top_per_key(active, [segment], [F.col("user_id").asc(), F.col("id").asc()], n)
    return picked.withColumn("orden", rank).orderBy("orden", "user_id", "id")


def latest_classification(classifications: DataFrame) -> DataFrame:
    return pick_first(
        classifications.where("activo"), ["user_id"], [F.col("created_at").desc_nulls_last(), F.col("id").desc()]
    )


def current_profile(
    users: DataFrame, classifications: DataFrame, json_schema: str | T.StructType, json_col: str = "datos_demograficos"
) -> DataFrame:
    """JSON attributes of the user overlaid by the latest active classification.

    Where a classification exists it wins for every shared column, null values included.
    """
    latest = latest_classification(classifications)
    own = users.withColumn("_json", F.from_json(json_col, json_schema)).select("user_id", "_json.*")
    shared = [c for c in latest.columns if c in own.columns and c != "user_id"]
    extra = [c for c in latest.columns if c not in own.columns]
    joined = own.alias("u").join(
        latest.withColumn("_has", F.lit(True)).alias("c"), F.col("u.user_id") == F.col("c.user_id"), "left"
    )
    overlay = [F.when(F.col("_has"), F.col(f"c.{c}")).otherwise(F.col(f"u.{c}")).alias(c) for c in shared]
    rest = [F.col(f"u.{c}") for c in own.columns if c not in shared and c != "user_id"]
    return joined.select(F.col("u.user_id"), *rest, *overlay, *[F.col(f"c.{c}") for c in extra])


def clean_nonfinite(df: DataFrame) -> DataFrame:
    doubles = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: finite(F.col(c)) for c in doubles}) if doubles else df


METRICS_JSON = "array<struct<producto:string,col_target:string,test_auc:double>>"


def metrics_of_runs(runs: DataFrame, schema: str = METRICS_JSON) -> DataFrame:
    """Metric rows of every run; a run that stored a single object counts as a list of one."""
    text = F.trim("metricas")
    listed = F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    return runs.withColumn("_m", F.from_json(listed, schema)).select(
        *[c for c in runs.columns if c != "metricas"], F.inline("_m")
    )


def latest_metrics(runs: DataFrame, schema: str = METRICS_JSON) -> DataFrame:
    """Rows of the latest run's metric list. The latest run is found with one combining aggregate."""
    newest = runs.agg(
        F.max_by(F.struct("run_id", "ejecutado_at", "metricas"), F.struct("ejecutado_at", "run_id")).alias("r")
    ).select("r.*")
    return metrics_of_runs(newest, schema)


def required(df: DataFrame, what: str) -> DataFrame:
    """The frame itself, or an error when it has no row."""
    if df.isEmpty():
        raise LookupError(f"no {what} available")
    return df


def users_filter(profiles: DataFrame, pattern: str, n: int, columns: Sequence[str]) -> DataFrame:
    present = [c for c in columns if c in profiles.columns]
    found = profiles.where(F.col("segmento_nombre").rlike(f"(?i){pattern}")) if pattern else profiles
    return found.orderBy("user_id").limit(n).select(*present)


def error_samples(df: DataFrame, truth: str, predicted: str, order: str, n: int = 5) -> DataFrame:
    """First ``n`` false positives and false negatives."""
    wrong = df.where(F.col(truth) != F.col(predicted)).withColumn(
        "error", F.when(F.col(predicted) == 1, "falso_positivo").otherwise("falso_negativo")
    )
    return top_per_key(wrong, ["error"], [F.col(order).asc()], n, position="pos")


# --- texts for the answering agent ---------------------------------------------------------------

ALERTS = ("noise", "estresado", "churn", "atipico", "frustracion")
ALL_CLEAR = "ok"


def active_alerts(noise: Column, stressed: Column, churn: Column, atypical: Column, frustration: Column) -> Column:
    """Codes of the alerts that hold, in fixed order; the all-clear code when none does."""
    holds = (
        safe_double(noise) >= fv.USER_GATE,
        safe_bool(stressed),
        safe_bool(churn),
        safe_bool(atypical),
        safe_int(frustration) >= fv.FRUSTRATION_ALERT,
    )
    found = F.array_compact(F.array(*[F.when(h, F.lit(code)) for code, h in zip(ALERTS, holds)]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(ALL_CLEAR)))


def instruction(column: Column, texts: dict[str, str], default: str, first_word: bool = True) -> Column:
    """Instruction text of a normalised dimension; null and unknown keys get the default key's text."""
    key = dim_key(column, first_word)
    out = F.when(key.isNull(), texts[default])
    for name, text in texts.items():
        out = out.when(key == name, text)
    return out.otherwise(texts[default])


def recommendation_text(products: Sequence[Column], empty: str = "  (sin recomendaciones activas)") -> Column:
    """``'  1. A\\n  2. B'`` from the product columns that hold a name."""
    named = F.filter(F.array(*products), lambda p: p.isNotNull() & ~p.isin("", "nan", "None"))
    lines = F.transform(named, lambda p, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), p))
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(empty)


def agent_context(df: DataFrame, template: str, out: str = "contexto") -> DataFrame:
    """Fills ``{column}`` places of a user's template; null values become empty text."""
    pieces, rest = [], template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        pieces += [F.lit(head), F.coalesce(F.col(name).cast("string"), F.lit(""))]
    return df.withColumn(out, F.concat(*pieces, F.lit(rest)))


def turn_contexts(
    turns: DataFrame, users: DataFrame, blocks: DataFrame, template: str, turn_id: str = "message_id",
    block: str = "contexto", out: str = "contexto",
) -> DataFrame:
    """One prompt-ready text per turn: ``users`` (one row per ``user_id``) and the examples retrieved for the turn fill the template.

    ``blocks`` has one row per turn with hits, as ``retrieval_context`` makes them; its text goes to the place ``{ejemplos}``.
    Turns without hits, without a user or of an unknown user stay, and their places become empty text. Texts are put in once, so braces
    in them are left alone.
    """
    found = blocks.select(turn_id, F.col(block).alias("ejemplos"))
    joined = turns.select(turn_id, "user_id").join(users, "user_id", "left").join(found, turn_id, "left")
    return agent_context(joined, template, out).select(turn_id, "user_id", out)


def tenure_years(days: Column) -> Column:
    return F.floor(safe_int(days) / 365)
