"""One-row-per-user features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text as tx
from ..functions.values import share, total
from .timeline import running


def _flag_mean(name: str):
    return F.avg(F.col(name).cast("int"))


def txn_features(df: DataFrame) -> DataFrame:
    """24 transaction features; one aggregation, combined before the shuffle."""
    hour, day = F.col("hora_del_dia"), F.col("dia_semana")
    agg = (
        df.where(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(
            F.count("transaccion_id").alias("txn_total"),
            F.avg("monto").alias("txn_monto_prom"),
            F.stddev_samp("monto").alias("txn_monto_std"),
            total(F.col("monto")).alias("txn_monto_total"),
            F.count_distinct("categoria_mcc").alias("txn_n_categorias"),
            F.count_distinct(F.to_date("fecha_hora")).alias("txn_n_dias_activo"),
            share(F.col("canal").isin(*fv.DIGITAL_CHANNELS)).alias("txn_pct_digital"),
            share(F.col("canal").isin(*fv.CASH_CHANNELS)).alias("txn_pct_efectivo"),
            _flag_mean("es_internacional").alias("txn_pct_inter"),
            F.count_if("es_internacional").alias("txn_n_inter"),
            _flag_mean("patron_uso_atipico").alias("txn_pct_atipico"),
            share(F.col("estatus") == "no_procesada").alias("txn_pct_fallida"),
            F.count_if(F.col("intento_numero") > 1).alias("txn_n_intentos_ext"),
            *[F.count_if(F.col("categoria_mcc") == c).alias(n) for n, c in fv.COUNTED_CATEGORIES.items()],
            F.count("meses_diferidos").alias("txn_n_msi"),
            total(F.col("cashback_generado")).alias("txn_cashback_total"),
            F.avg("hora_del_dia").alias("txn_hora_media"),
            share(day.isin(*fv.WEEKEND)).alias("txn_pct_finde"),
            share((hour >= 22) | (hour <= 5)).alias("txn_pct_nocturno"),
        )
    )
    return agg.withColumns(
        {
            "txn_volatilidad": F.try_divide(F.col("txn_monto_std"), F.col("txn_monto_prom") + 1),
            "txn_frec_por_dia": F.col("txn_total") / (F.col("txn_n_dias_activo") + 1),
        }
    )


def ownership_flags(df: DataFrame, product_types: Sequence[str] = tuple(fv.PRODUCT_TYPES)) -> DataFrame:
    """0/1 per product type: the user owns an active product of it. One pass for all types."""
    return df.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(*_ownership(product_types))


def _ownership(product_types: Sequence[str]):
    active = F.col("estatus") == "activo"
    return [
        F.max(F.when(active & (F.col("tipo_producto") == p), 1).otherwise(0)).alias(f"tiene_{p}")
        for p in product_types
    ]


def product_features(df: DataFrame, product_types: Sequence[str] = tuple(fv.PRODUCT_TYPES)) -> DataFrame:
    """9 portfolio features and one ownership flag per product type, in one aggregation."""
    status = F.col("estatus")
    agg = (
        df.where(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(
            F.count("producto_id").alias("prod_n_total"),
            F.count_if(status == "activo").alias("prod_n_activos"),
            F.count_if(status == "cancelado").alias("prod_n_cancelados"),
            F.count_if(status == "revision_de_pagos").alias("prod_n_revision"),
            F.coalesce(F.avg("utilizacion_pct"), F.lit(0.0)).alias("prod_util_media"),
            F.coalesce(F.max("utilizacion_pct"), F.lit(0.0)).alias("prod_util_max"),
            total(F.col("saldo_actual")).alias("prod_saldo_total"),
            total(F.col("limite_credito")).alias("prod_limite_total"),
            *_ownership(product_types),
        )
    )
    bad = F.col("prod_n_cancelados") + F.col("prod_n_revision")
    return agg.withColumn("prod_ratio_problematicos", bad / (F.col("prod_n_total") + 1))


def label_turns(df: DataFrame) -> DataFrame:
    """Narrow per-turn labels. The text is read once here; nothing later needs it.

    At scale write this frame out and build the conversation features from the written table.
    """
    text = F.col("input")
    return tx.with_turn_noise(df, "input").withColumns(
        {
            "intent": tx.intent(text),
            "urgente": tx.has_urgency(text),
            "frustrado": tx.has_frustration(text),
        }
    )


def turns_per_conv(df: DataFrame, conv: str = "conv_id", text: str = "input") -> DataFrame:
    """Attaches the number of turns of its conversation to each turn; null for a null conversation.

    Counted with a combining aggregate and joined back, so adaptive skew handling can split a long
    conversation (a window could not).
    """
    counts = df.where(F.col(conv).isNotNull()).groupBy(conv).agg(F.count(text).alias("turnos_conv"))
    return join_known(df, counts, conv, df.columns[0]).select(*df.columns, "turnos_conv")


NULL_SPREAD = 4096


def join_known(df: DataFrame, side: DataFrame, key: str, spread: str) -> DataFrame:
    """Left join on a key that may be null in many rows: those match nothing, so they are spread over tasks
    by another column instead of meeting in one."""
    salt = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(spread), F.lit(NULL_SPREAD))).otherwise(F.lit(0))
    salted = df.withColumn("_salt", salt)
    return salted.join(side.withColumn("_salt", F.lit(0).cast("bigint")), [key, "_salt"], "left").drop("_salt")


def timeline_features(turns: DataFrame, tie: str = "message_id") -> DataFrame:
    """Retries within 48 h of the user's previous turn and the noise trend over the two halves."""
    slim = turns.select("user_id", "date", tie, "noise_score")
    rows = running(
        slim, ["user_id"], "date", tie,
        sums={"_pos": F.lit(1)}, totals={"_n": F.lit(1)}, previous={"_prev": "date"},
    )
    late = F.col("_pos") > F.floor(F.col("_n") / 2)
    # missing scores do not occur: a turn without text scores 1.0
    agg = rows.groupBy("user_id").agg(
        F.max("_n").alias("_n"),
        F.count_if(gap_hours(F.col("_prev"), F.col("date")) < fv.RETRY_HOURS).alias("conv_reintentos_48h"),
        F.avg(F.when(late, F.col("noise_score"))).alias("_late"),
        F.avg(F.when(~late, F.col("noise_score"))).alias("_early"),
    )
    trend = F.when(F.col("_n") < fv.TREND_MIN_TURNS, 0.0).otherwise(F.round(F.col("_late") - F.col("_early"), 4))
    return agg.select("user_id", "conv_reintentos_48h", F.coalesce(trend, F.lit(0.0)).alias("conv_noise_trend"))


def gap_hours(earlier, later):
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 3.6e9


def with_gap_hours(turns: DataFrame, tie: str = "message_id") -> DataFrame:
    """Hours since the same user's previous turn; null for the first and for turns without a time."""
    rows = running(turns, ["user_id"], "date", tie, previous={"_prev": "date"})
    gap = F.when(F.col("date").isNotNull(), gap_hours(F.col("_prev"), F.col("date")))
    return rows.withColumn("hrs_gap", gap).drop("_prev")


def conv_features(labelled: DataFrame, tie: str = "message_id") -> DataFrame:
    """18 conversation features from labelled turns.

    Turns are first combined per (user, conversation); conversation sizes come from that smaller table,
    so no turn row travels with a conversation-wide window.
    """
    known = labelled.where(F.col("user_id").isNotNull())
    noisy = F.col("noise_score") > fv.NOISY_TURN
    counted = ("credito", "inversion", "tarjeta", "aclaracion", "seguridad", "negocio")
    pair = labelled.groupBy("user_id", "conv_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("input").alias("n_text"),
        F.sum("es_voz").alias("voz"),
        F.sum("input_len").alias("len"),
        F.count_if("urgente").alias("conv_urgencia"),
        F.count_if("frustrado").alias("conv_frustracion"),
        F.count_if(noisy).alias("noisy"),
        F.sum("noise_score").alias("score"),
        F.max("noise_score").alias("score_max"),
        *[F.count_if(F.col("intent") == i).alias(f"intent_{i}") for i in counted],
    )
    sizes = pair.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.sum("n_text").alias("turnos"))
    n = F.sum("n")
    sized = F.sum(F.when(F.col("turnos").isNotNull(), F.col("n")))
    base = (
        join_known(pair.where(F.col("user_id").isNotNull()), sizes, "conv_id", "user_id")
        .groupBy("user_id")
        .agg(
            F.count("conv_id").alias("conv_n_total"),
            (F.sum(F.col("turnos") * F.col("n")) / sized).alias("conv_turnos_prom"),
            F.max("turnos").alias("conv_turnos_max"),
            (F.sum("voz") / n).alias("conv_pct_voz"),
            (F.sum("len") / F.sum("n_text")).alias("conv_input_len_med"),
            F.sum("conv_urgencia").alias("conv_urgencia"),
            F.sum("conv_frustracion").alias("conv_frustracion"),
            (F.sum("noisy") / n).alias("conv_noise_pct"),
            (F.sum("score") / n).alias("conv_noise_score"),
            F.max("score_max").alias("conv_noise_max"),
            *[F.sum(f"intent_{i}").alias(f"intent_{i}") for i in counted],
        )
    )
    times = timeline_features(known, tie)
    return base.join(times, "user_id", "left").na.fill(0, ["conv_reintentos_48h", "conv_noise_trend"])
