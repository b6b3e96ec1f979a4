"""Profile assembly: dimensions, masked scores, top products, flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv


def segment_dims(
    df: DataFrame,
    dims: DataFrame,
    columns: Sequence[str] = tuple(fv.SEGMENT_DIMENSIONS),
    segment: str = "segmento_nombre",
) -> DataFrame:
    """Communication dimensions per segment, ``''`` when unknown; the alert list joined as text.

    One row per segment in ``dims`` (``segmento_nombre``, the dimensions, ``alertas`` array). The join is
    unhinted, so the broadcast happens behind Spark's own size check.
    """
    side = dims.select(
        segment, *columns, F.array_join("alertas", " | ").alias("alertas_segmento")
    )
    joined = df.join(side, segment, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in [*columns, "alertas_segmento"]})


def channel_override(channel: Column, voice_share: Column) -> Column:
    return F.when(voice_share > fv.VOICE_SHARE, "voz").otherwise(channel)


def mask_owned(score: Column, owned: Column) -> Column:
    """Products a user already has are not recommended."""
    return F.when(owned.cast("int") == 1, 0.0).otherwise(score)


def top_products(scores: dict[str, Column], n: int = 3, above: float = fv.MIN_RECOMMENDED) -> Column:
    """Names by falling score, ties in the given order, only scores above the limit. Row-local."""
    entries = [
        F.struct((-F.coalesce(s, F.lit(0.0))).alias("neg"), F.lit(i).alias("ord"), F.lit(name).alias("name"))
        for i, (name, s) in enumerate(scores.items())
    ]
    best = F.slice(F.array_sort(F.array(*entries)), 1, n)
    return F.transform(F.filter(best, lambda e: -e["neg"] > above), lambda e: e["name"])


def with_top_products(df: DataFrame, scores: dict[str, str], n: int = 3) -> DataFrame:
    """Adds ``producto_top_1..n``, empty text where there is no such product."""
    names = top_products({name: F.col(c) for name, c in scores.items()}, n)
    with_list = df.withColumn("_top", names)
    return with_list.withColumns(
        {f"producto_top_{i + 1}": F.coalesce(F.get("_top", F.lit(i)), F.lit("")) for i in range(n)}
    ).drop("_top")


def risk_flags(df: DataFrame) -> DataFrame:
    """Churn, atypical use and stressed credit as 0/1; missing inputs count as no."""
    def flag(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False)).cast("int")

    atypical = F.col("patron_uso_atipico") if "patron_uso_atipico" in df.columns else F.lit(False)
    use = F.col("prod_util_max") if "prod_util_max" in df.columns else F.lit(0.0)
    churn = (F.col("dias_desde_ultimo_login") > fv.CHURN_LOGIN_DAYS) & (
        F.col("satisfaccion_1_10") < fv.CHURN_SATISFACTION
    )
    return df.withColumns(
        {
            "flag_riesgo_churn": flag(churn),
            "flag_uso_atipico": flag(atypical.cast("boolean")),
            "flag_credito_estresado": flag(use > fv.STRESSED_UTILISATION),
        }
    )


def with_user_noise(df: DataFrame) -> DataFrame:
    score = F.coalesce(F.round("conv_noise_pct", 4), F.lit(0.0)) if "conv_noise_pct" in df.columns else F.lit(0.0)
    return df.withColumn("noise_score_usuario", score)


def profile_columns(df: DataFrame, context: Sequence[str] = tuple(fv.PROFILE_CONTEXT)) -> DataFrame:
    """User noise score and the context columns that exist, plus the integer codes of categories."""
    out = with_user_noise(df)
    present = [c for c in context if c in df.columns]
    codes = [c + "_code" for c in present if c + "_code" in df.columns]
    return out.select("user_id", "noise_score_usuario", *present, *codes)


def profiles(master: DataFrame, dims: DataFrame, products: Sequence[str]) -> DataFrame:
    """Full profile from a master that carries ``segmento_id``, ``segmento_nombre`` and the raw ``prop_*`` scores.

    Only narrow steps and one join with the small dimension table.
    """
    masked = master.withColumns(
        {f"prop_{p}": mask_owned(F.col(f"prop_{p}"), F.col(f"tiene_{p}")) for p in products}
    )
    full = with_user_noise(risk_flags(segment_dims(masked, dims)))
    full = full.withColumn("canal", channel_override(F.col("canal"), F.col("conv_pct_voz")))
    full = with_top_products(full, {p: f"prop_{p}" for p in products})
    context = [c for c in fv.PROFILE_CONTEXT if c in master.columns]
    codes = [c + "_code" for c in context if c + "_code" in master.columns]
    return full.select(
        "user_id", "segmento_id", "segmento_nombre", *fv.SEGMENT_DIMENSIONS, "alertas_segmento",
        *[f"prop_{p}" for p in products],
        "producto_top_1", "producto_top_2", "producto_top_3",
        "flag_riesgo_churn", "flag_uso_atipico", "flag_credito_estresado", "noise_score_usuario",
        *context, *codes,
    )
