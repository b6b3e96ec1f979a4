"""Per-user features and timelines against pandas, with hot users, missing times and null keys."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from profilekit.operators import features, sessions, timeline
from profilekit.operators.timeline import running

BASE = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def log():
    rng = np.random.default_rng(5)
    n = 1500
    user = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 40, n))
    date = [None if rng.random() < 0.15 else BASE + dt.timedelta(hours=int(h)) for h in rng.integers(0, 24 * 60, n)]
    pdf = pd.DataFrame({"message_id": rng.permutation(n) * 7000, "date": pd.to_datetime(pd.Series(date)), "score": rng.integers(0, 64, n) / 64})
    pdf["user_id"] = [None if rng.random() < 0.03 else f"u{u}" for u in user]
    pdf["reset"] = rng.random(n) < 0.05
    pdf["conv_id"] = [None if rng.random() < 0.1 else f"c{c}" for c in rng.integers(0, 200, n)]
    return pdf


@pytest.fixture(scope="module")
def frame(spark, log):
    rows = [
        (int(r.message_id), None if pd.isna(r.date) else r.date.to_pydatetime(), float(r.score), r.user_id, bool(r.reset), r.conv_id)
        for r in log.itertuples()
    ]
    return spark.createDataFrame(
        rows, "message_id bigint, date timestamp_ntz, noise_score double, user_id string, reset boolean, conv_id string"
    ).repartition(6)


def ordered(log):
    return log.dropna(subset=["user_id"]).sort_values(["user_id", "date", "message_id"], na_position="last")


def test_running_equals_pandas(frame, log):
    df = running(
        frame, ["user_id"], "date", "message_id",
        sums={"pos": F.lit(1), "resets": F.col("reset").cast("int")}, totals={"n": F.lit(1)}, previous={"prev": "date"},
    )
    got = {r.message_id: (r.pos, r.resets, r.n, r.prev) for r in df.collect()}
    want = ordered(log)
    g = want.groupby("user_id")
    pos, resets, n, prev = g.cumcount() + 1, g["reset"].cumsum(), g["reset"].transform("size"), g["date"].shift(1)
    assert len(got) == len(want)
    for i, m in zip(want.index, want["message_id"]):
        p, r, k, before = got[m]
        assert (p, r, k) == (pos[i], resets[i], n[i])
        if pd.notna(want.at[i, "date"]):
            assert before == (None if pd.isna(prev[i]) else prev[i].to_pydatetime())


def test_undated_rows_are_cut_too(spark):
    df = spark.range(300).select(F.lit("u").alias("user_id"), (F.col("id") * 90_000).alias("message_id"), F.lit(None).cast("timestamp_ntz").alias("date"))
    got = running(df, ["user_id"], "date", "message_id", sums={"pos": F.lit(1)}).orderBy("message_id")
    assert [r.pos for r in got.collect()] == list(range(1, 301))


def test_retries_and_trend_equal_pandas(frame, log):
    want = ordered(log)
    prev = want.groupby("user_id")["date"].shift(1)
    gap = (want["date"] - prev).dt.total_seconds() / 3600
    retries = want[gap < 48].groupby("user_id").size()

    def trend(g):
        if len(g) < 4:
            return 0.0
        mid = len(g) // 2
        return round(g["score"].iloc[mid:].mean() - g["score"].iloc[:mid].mean(), 4)

    trends = want.groupby("user_id")[["score"]].apply(trend)
    got = {r.user_id: r for r in features.timeline_features(frame).collect()}
    assert set(got) == set(trends.index)
    for u, t in trends.items():
        assert got[u].conv_reintentos_48h == retries.get(u, 0)
        assert abs(got[u].conv_noise_trend - t) <= 1.01e-4


@pytest.mark.parametrize("gaps,want", [([48.0], 0), ([47.999], 1), ([0.0], 1), ([1, 1, 49], 2)])
def test_retry_limit(spark, gaps, want):
    times = [BASE]
    for g in gaps:
        times.append(times[-1] + dt.timedelta(hours=g))
    df = spark.createDataFrame([("u", t, i, 0.0) for i, t in enumerate(times)], "user_id string, date timestamp_ntz, message_id bigint, noise_score double")
    assert features.timeline_features(df).first().conv_reintentos_48h == want


@pytest.mark.parametrize("scores,want", [([0.0, 0.0, 1.0], 0.0), ([0.0, 0.0, 1.0, 0.5], 0.75), ([0.0, 1.0, 1.0, 1.0, 1.0], 0.5)])
def test_trend_limit(spark, scores, want):
    df = spark.createDataFrame([("u", BASE + dt.timedelta(days=i), i, s) for i, s in enumerate(scores)], "user_id string, date timestamp_ntz, message_id bigint, noise_score double")
    assert features.timeline_features(df).first().conv_noise_trend == want


def test_conv_features_equal_pandas(spark):
    rows = [
        ("u1", "c1", 1, "hola", 2), ("u1", "c1", 2, "urge: mi crédito", 1), ("u2", "c1", 3, "ok", 1),
        ("u1", None, 4, "me sale error, no funciona", 1), ("u2", "c2", 5, "quiero ahorro", 2), (None, "c2", 6, "hola", 1),
        ("u3", None, 7, "pin", 1),
    ]
    df = spark.createDataFrame(
        [(*r, BASE + dt.timedelta(days=r[2])) for r in rows],
        "user_id string, conv_id string, message_id bigint, input string, channel_source int, date timestamp_ntz",
    )
    from profilekit.operators import clean

    got = {r.user_id: r for r in features.conv_features(features.label_turns(clean.clean_turns(df))).collect()}
    assert set(got) == {"u1", "u2", "u3"}
    u1, u2, u3 = got["u1"], got["u2"], got["u3"]
    assert (u1.conv_n_total, u1.conv_turnos_prom, u1.conv_turnos_max) == (1, 3.0, 3)
    assert (u2.conv_n_total, u2.conv_turnos_prom, u2.conv_turnos_max) == (2, 2.5, 3)
    assert (u3.conv_n_total, u3.conv_turnos_prom, u3.conv_turnos_max) == (0, None, None)
    assert (u1.conv_urgencia, u1.conv_frustracion, u1.intent_credito, u2.intent_inversion) == (1, 1, 1, 1)
    assert u1.conv_pct_voz == pytest.approx(1 / 3) and u2.conv_input_len_med == pytest.approx((2 + 13) / 2)


def test_txn_features_edge_rows(spark):
    schema = (
        "transaccion_id string, user_id string, fecha_hora timestamp_ntz, monto double, categoria_mcc string, canal string, "
        "es_internacional boolean, patron_uso_atipico boolean, estatus string, intento_numero int, meses_diferidos int, "
        "cashback_generado double, hora_del_dia int, dia_semana string"
    )
    empty = (None,) * 12
    df = spark.createDataFrame(
        [
            ("t1", "one", BASE, 5.0, "viajes", "codi", True, None, "ok", 2, 3, 1.0, 22, "Sunday"),
            (None, "nulls", *empty),
            ("t2", "minus", BASE, -2.0, "a", "oxxo", False, False, "no_procesada", 1, None, None, 5, "Monday"),
            ("t3", "minus", None, 0.0, "a", None, None, True, None, None, None, None, 6, None),
            ("t4", None, BASE, 1.0, "a", "b", True, True, "c", 1, 1, 1.0, 1, "d"),
        ],
        schema,
    )
    got = {r.user_id: r for r in features.txn_features(df).collect()}
    assert set(got) == {"one", "nulls", "minus"}
    one, nulls, minus = got["one"], got["nulls"], got["minus"]
    assert one.txn_monto_std is None and one.txn_pct_finde == 1.0 and one.txn_pct_nocturno == 1.0 and one.txn_n_msi == 1
    assert one.txn_frec_por_dia == 0.5 and one.txn_pct_atipico is None
    assert (nulls.txn_total, nulls.txn_monto_total, nulls.txn_cashback_total, nulls.txn_pct_digital) == (0, 0.0, 0.0, 0.0)
    assert nulls.txn_monto_prom is None
    assert minus.txn_volatilidad is None  # mean of -1 would divide by zero
    assert (minus.txn_pct_fallida, minus.txn_pct_efectivo, minus.txn_pct_inter, minus.txn_pct_nocturno) == (0.5, 0.5, 0.0, 0.5)


def test_product_features_own_only_active(spark):
    rows = [
        ("p1", "u", "seguro_vida", "activo", 0.5, 10.0, None), ("p2", "u", "credito_auto", "cancelado", None, 5.0, 7.0),
        (None, "u", "seguro_vida", "revision_de_pagos", 0.7, None, None), ("p3", "w", "credito_auto", None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "producto_id string, user_id string, tipo_producto string, estatus string, utilizacion_pct double, saldo_actual double, limite_credito double")
    got = {r.user_id: r for r in features.product_features(df).collect()}
    u, w = got["u"], got["w"]
    assert (u.prod_n_total, u.prod_n_activos, u.prod_n_cancelados, u.prod_n_revision) == (2, 1, 1, 1)
    assert u.prod_ratio_problematicos == pytest.approx(2 / 3) and u.prod_util_max == 0.7
    assert (u.tiene_seguro_vida, u.tiene_credito_auto) == (1, 0)
    assert (w.prod_util_media, w.prod_saldo_total, w.prod_limite_total, w.tiene_credito_auto) == (0.0, 0.0, 0.0, 0)
    assert len(df.columns) and len(features.product_features(df).columns) == 20


def test_feature_families_need_few_exchanges(spark, sf):
    from profilekit.plans import queries_users as qu

    txn = features.txn_features(spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("event_id").alias("transaccion_id"), "user_id", F.col("ts").alias("fecha_hora"), F.col("value").alias("monto"),
        F.col("event_type").alias("categoria_mcc"), F.lit("x").alias("canal"), F.lit(True).alias("es_internacional"),
        F.lit(True).alias("patron_uso_atipico"), F.lit("x").alias("estatus"), F.lit(1).alias("intento_numero"),
        F.lit(1).alias("meses_diferidos"), F.lit(1.0).alias("cashback_generado"), F.lit(1).alias("hora_del_dia"), F.lit("x").alias("dia_semana"),
    ))
    # the distinct counts are combined first, then per user
    assert txn._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2
    products = features.product_features(qu.products(spark, sf), qu.TYPES)
    assert products._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_session_lifecycle_with_two_resets(spark):
    rows = [
        ("u", 1, BASE, False), ("u", 2, BASE + dt.timedelta(hours=1), True), ("u", 3, BASE + dt.timedelta(hours=2), True),
        ("u", 4, BASE + dt.timedelta(days=3), False), ("w", 5, BASE, True),
    ]
    df = spark.createDataFrame(rows, "user_id string, message_id bigint, date timestamp_ntz, reset boolean")
    got = sorted(tuple(r) for r in sessions.session_lifecycle(df).collect())
    h = lambda n: BASE + dt.timedelta(hours=n)
    assert got == [
        ("u", 0, h(0), h(1), False, 1), ("u", 1, h(1), h(2), False, 1), ("u", 2, h(2), None, True, 2), ("w", 1, h(0), None, True, 1),
    ]


def test_history_pages_keep_every_message_in_order(spark):
    df = spark.range(25).select(
        F.lit("u").alias("user_id"), F.col("id").alias("message_id"), F.lit(BASE).cast("timestamp_ntz").alias("date"),
        F.lit(False).alias("reset"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("input"), F.lit("r").alias("output"),
    )
    pages = sorted(sessions.session_history(df, page=10).collect(), key=lambda r: r.pagina)
    assert [len(p.historial) for p in pages] == [20, 20, 10]
    asked = [m.content for p in pages for m in p.historial if m.role == "user"]
    assert asked == [f"m{i}" for i in range(25)]


@pytest.mark.parametrize("kind", ["one day", "one moment", "undated"])
def test_long_keys_are_cut_evenly(spark, kind):
    """A hundred thousand rows of one key: the ranges are even, and the values are those of a plain window."""
    n = 100_000
    moment = {"one day": "timestamp_ntz '2024-03-01' + make_dt_interval(0, 0, 0, id % 5000)", "one moment": "timestamp_ntz '2024-03-01'", "undated": "cast(null as timestamp_ntz)"}[kind]
    df = spark.range(n).selectExpr("if(id % 10 = 0, id % 7, 99) as user_id", f"{moment} as date", "id * 7919 % 100003 as message_id", "cast(id % 3 as int) as x")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in timeline.ranged(df, ["user_id"], "date", "message_id").groupBy("_part").count().collect()]
        got = timeline.running(df, ["user_id"], "date", "message_id", {"s": F.col("x")}, {"n": F.lit(1)}, {"before": "date"})
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) == 8 and max(sizes) < 2 * n / 8
    w = Window.partitionBy("user_id").orderBy(F.col("date").asc_nulls_last(), "message_id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.sum("x").over(upto).alias("s"), F.count("*").over(Window.partitionBy("user_id")).alias("n"), F.lag("date").over(w).alias("before"))
    assert got.count() == n and got.exceptAll(want.select(*got.columns)).count() == 0
