"""Serving views and profile assembly on literal rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from profilekit.operators import profiles, views

BASE = dt.datetime(2024, 1, 1)


def test_top_products_limits_and_ties(spark):
    df = spark.createDataFrame(
        [(1, 0.5, 0.5, 0.9, 0.2), (2, 0.10, 0.1001, 0.0, 0.0), (3, 0.0, 0.0, 0.0, 0.0), (4, None, 0.3, 0.3, 0.3)],
        "id int, a double, b double, c double, d double",
    )
    got = profiles.with_top_products(df, {"A": "a", "B": "b", "C": "c", "D": "d"})
    rows = {r.id: (r.producto_top_1, r.producto_top_2, r.producto_top_3) for r in got.collect()}
    assert rows == {1: ("C", "A", "B"), 2: ("B", "", ""), 3: ("", "", ""), 4: ("B", "C", "D")}


def test_top_products_need_no_shuffle(spark):
    df = spark.createDataFrame([(1, 0.5)], "id int, a double")
    plan = profiles.with_top_products(df, {"A": "a"})._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize(
    "login,satisfaction,use,odd,want",
    [(31, 5.9, 0.86, True, (1, 1, 1)), (30, 5.0, 0.85, False, (0, 0, 0)), (31, 6.0, None, None, (0, 0, 0))],
)
def test_risk_flag_limits(spark, login, satisfaction, use, odd, want):
    df = spark.createDataFrame(
        [(login, satisfaction, use, odd)],
        "dias_desde_ultimo_login int, satisfaccion_1_10 double, prod_util_max double, patron_uso_atipico boolean",
    )
    r = profiles.risk_flags(df).first()
    assert (r.flag_riesgo_churn, r.flag_uso_atipico, r.flag_credito_estresado) == want


def test_risk_flags_without_optional_columns(spark):
    df = spark.createDataFrame([(40, 1.0)], "dias_desde_ultimo_login int, satisfaccion_1_10 double")
    r = profiles.risk_flags(df).first()
    assert (r.flag_riesgo_churn, r.flag_uso_atipico, r.flag_credito_estresado) == (1, 0, 0)


def test_user_noise_is_not_strict_and_channel_is(spark):
    df = spark.createDataFrame([(0.40, 0.30), (0.39, 0.31), (None, None)], "n double, v double")
    zero = F.lit(0)
    got = [
        tuple(r)
        for r in df.select(
            views.active_alerts(F.col("n"), zero, zero, zero, zero).alias("a"),
            profiles.channel_override(F.lit("texto"), F.col("v")).alias("c"),
        ).collect()
    ]
    assert got == [(["noise"], "texto"), (["ok"], "voz"), (["ok"], "texto")]


def test_alert_order_and_text_values(spark):
    df = spark.createDataFrame([("0.9", "1.0", "1", "true", "2")], "a string, b string, c string, d string, e string")
    got = df.select(views.active_alerts(*[F.col(c) for c in "abcde"])).first()[0]
    assert got == ["noise", "estresado", "churn", "frustracion"]  # a text that is no number counts as 0


def test_recommendation_text(spark):
    df = spark.createDataFrame([("A", "nan", "B"), ("", None, "None")], "a string, b string, c string")
    got = [r[0] for r in df.select(views.recommendation_text([F.col(c) for c in "abc"])).collect()]
    assert got == ["  1. A\n  2. B", "  (sin recomendaciones activas)"]


def test_instruction_defaults(spark):
    df = spark.createDataFrame([("Corta (2)",), ("rara",), (None,)], "x string")
    got = [r[0] for r in df.select(views.instruction(F.col("x"), {"corta": "c", "media": "m"}, "media")).collect()]
    assert got == ["c", "m", "m"]


def test_agent_context_template(spark):
    df = spark.createDataFrame([(1, None, "x")], "a int, b string, c string")
    assert views.agent_context(df, "{a}-{b}-{c}!").first().contexto == "1--x!"


def test_turn_contexts(spark):
    """Turns without hits, without a user or of an unknown user stay; braces in texts are not places; extra columns of turns do no harm."""
    turns = spark.createDataFrame([(1, 7, "t"), (2, 7, "t"), (3, 8, "t"), (4, None, "t")], "message_id long, user_id long, nombre string")
    users = spark.createDataFrame([(7, "Ana {ejemplos}")], "user_id long, nombre string")
    blocks = spark.createDataFrame([(1, "E1 {nombre}"), (4, "E4")], "message_id long, contexto string")
    got = views.turn_contexts(turns, users, blocks, "{user_id}|{nombre}|{ejemplos}").collect()
    assert {r.message_id: r.contexto for r in got} == {1: "7|Ana {ejemplos}|E1 {nombre}", 2: "7|Ana {ejemplos}|", 3: "8||", 4: "||E4"}
    assert views.turn_contexts(turns.limit(0), users, blocks, "{nombre}").count() == 0


def test_segment_summary_order_and_missing_name(spark):
    df = spark.createDataFrame(
        [(3, "A", "t3", None), (1, "A", None, 0.5), (2, None, "t2", 0.25), (4, "B", "t4", None)],
        "id int, segmento_nombre string, tono string, noise_score_usuario double",
    )
    got = [tuple(r) for r in views.segment_summary(df).collect()]
    assert got == [("A", 2, None, 0.5, 0.5), (None, 1, "t2", 0.25, 0.25), ("B", 1, "t4", 0.0, 0.25)]
    assert views.segment_summary(df.where("id > 99")).count() == 0
    assert views.segment_summary(df.drop("segmento_nombre")).first().segmento == "Sin segmento"


def test_users_per_segment_order(spark):
    df = spark.createDataFrame(
        [(i, f"u{i}", s) for i, s in enumerate(["X", "B", "A", "B", "B", None, "A"])],
        "id int, user_id string, segmento_nombre string",
    )
    got = [(r.segmento_nombre, r.user_id) for r in views.users_per_segment(df, ["B", "A"]).collect()]
    assert got == [("B", "u1"), ("B", "u3"), ("A", "u2"), ("A", "u6"), ("X", "u0"), (None, "u5")]


def test_current_profile_null_of_the_table_wins(spark):
    users = spark.createDataFrame(
        [("u", '{"tono":"json","edad":5}'), ("w", '{"tono":"json"}'), ("x", None)], "user_id string, datos_demograficos string"
    )
    c = spark.createDataFrame(
        [(1, "u", True, BASE, None), (2, "u", False, BASE + dt.timedelta(days=9), "late"), (3, "u", True, BASE - dt.timedelta(days=1), "old")],
        "id int, user_id string, activo boolean, created_at timestamp_ntz, tono string",
    )
    got = {r.user_id: (r.edad, r.tono, r.id) for r in views.current_profile(users, c, "tono string, edad int").collect()}
    assert got == {"u": (5, None, 1), "w": (None, "json", None), "x": (None, None, None)}


def test_latest_metrics_object_and_list(spark):
    runs = spark.createDataFrame(
        [(1, BASE, '[{"producto":"a"},{"producto":"b"}]'), (2, BASE + dt.timedelta(days=1), '{"producto":"c","test_auc":0.5}')],
        "run_id int, ejecutado_at timestamp_ntz, metricas string",
    )
    assert [(r.producto, r.test_auc) for r in views.latest_metrics(runs).collect()] == [("c", 0.5)]
    assert views.metrics_of_runs(runs).count() == 3
    with pytest.raises(LookupError):
        views.required(views.latest_metrics(runs.limit(0)), "metrics")


def test_session_summary_without_documents(spark):
    log = spark.createDataFrame(
        [("s", True, 0.9, 0, []), ("s", False, 0.0, 2, [0.5, 0.7]), ("e", True, 0.65, 0, None)],
        "sesion string, noise_gate boolean, noise_score double, n_rag_docs int, rag_sims array<double>",
    )
    got = {r.sesion: tuple(r)[1:] for r in views.session_summary(log, ["sesion"]).collect()}
    assert got == {"s": (2, 1, 0.5, 0.45, 2, 0.6), "e": (1, 1, 1.0, 0.65, 0, 0.0)}


def test_health_counts_null_segment_counts_once(spark):
    users = spark.range(4)
    c = spark.createDataFrame([("a", True), (None, True), (None, True), ("b", False)], "segmento_nombre string, activo boolean")
    assert tuple(views.health_counts(users, c).first()) == (4, 2, 1)


def test_error_samples(spark):
    df = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(20)], "id int, t int, p int")
    got = views.error_samples(df, "t", "p", "id").orderBy("error", "pos").collect()
    assert [r.id for r in got] == [1, 3, 5, 7, 9, 0, 2, 4, 6, 8]


def test_unknown_segment_has_empty_dimensions(spark):
    dims = spark.createDataFrame([("A", "t", ["x", "y"])], "segmento_nombre string, tono string, alertas array<string>")
    df = spark.createDataFrame([(1, "A"), (2, "Z"), (3, None)], "id int, segmento_nombre string")
    got = {r.id: (r.tono, r.alertas_segmento) for r in profiles.segment_dims(df, dims, ["tono"]).collect()}
    assert got == {1: ("t", "x | y"), 2: ("", ""), 3: ("", "")}


def test_dimension_join_is_broadcast_by_size(spark, sf):
    from profilekit.plans.queries_users import role, segment_table

    base = role(spark, sf, "r_propensity").select("user_id", "segmento_nombre")
    joined = profiles.segment_dims(base, segment_table(spark, sf))
    joined.collect()
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
