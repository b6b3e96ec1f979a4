"""Streams equal their batch twins on split and repeated input; jobs run end to end."""

import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from profilekit.functions import text as tx
from profilekit.operators import clean, features, propensity, segments, sessions, tfidf, vectors
from profilekit.plans import queries_users as qu
from profilekit.plans.profile_job import ProfileJob
from profilekit.plans.queries_streams import logged_turns, turn_corpus
from profilekit.plans.retrieval_job import RetrievalJob
from profilekit.plans.role_views import role
from profilekit.session import scratch_path
from profilekit.sources import tables
from profilekit.streaming import messages as live


@pytest.fixture(scope="module")
def log(spark, sf):
    return role(spark, sf, "r_messages").cache()


@pytest.fixture(scope="module")
def folder(spark, log):
    """The log as files in time order, so that arrival follows time."""
    path = scratch_path(spark, "split")
    bounds = [0, 300, 301, 700, 10**9]
    for low, high in zip(bounds, bounds[1:]):
        log.where((F.col("message_id") >= low) & (F.col("message_id") < high)).coalesce(1).write.mode("append").parquet(path)
    return path


def finish(running):
    running.awaitTermination()
    assert running.exception() is None


def test_times_follow_ids(log):
    rows = log.select("message_id", "date").orderBy("message_id").collect()
    assert [r.date for r in rows] == sorted(r.date for r in rows)


@pytest.fixture(scope="module")
def newest_first(spark, log):
    """The log as four files, the newest delivered first, one of them twice."""
    path = scratch_path(spark, "late")
    for low, high in ((700, 10**9), (301, 700), (300, 301), (0, 300), (300, 500)):
        log.where((F.col("message_id") >= low) & (F.col("message_id") < high)).coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.mark.parametrize("files", [1, 2, 16])
def test_late_files_lose_no_gated_row(spark, log, newest_first, files):
    path, checkpoint = scratch_path(spark, "o"), scratch_path(spark, "c")
    finish(live.write_routed(live.read_files(spark, newest_first, log.schema, files_per_trigger=files), path, checkpoint))
    want = tx.with_route(tx.with_gate(log))
    got = live.read_routed(spark, path).select(*want.columns)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_messages_without_an_id_or_a_time_are_kept(spark):
    schema = "message_id bigint, date timestamp_ntz"
    rows = spark.createDataFrame([(None, None), (None, None), (1, None), (1, None), (2, None)], schema)
    seen = spark.createDataFrame([(2, None)], "message_id bigint, dia date")
    got = sorted((r.message_id or 0) for r in live.new_messages(rows, seen).collect())
    assert got == [0, 0, 1]


@pytest.mark.parametrize("files", [1, 2, 16])
@pytest.mark.parametrize("order", ["folder", "late"])
def test_session_numbers_whatever_the_arrival(spark, log, folder, files, order):
    source = folder
    if order == "late":
        source = scratch_path(spark, "late")
        for low, high in ((700, 10**9), (301, 700), (0, 301)):
            log.where((F.col("message_id") >= low) & (F.col("message_id") < high)).coalesce(1).write.mode("append").parquet(source)
    stream = live.read_files(spark, source, log.schema, files_per_trigger=files)
    path, checkpoint = scratch_path(spark, "o"), scratch_path(spark, "c")
    finish(live.write_table(live.session_turns(stream), path, checkpoint))
    written = spark.read.parquet(path)
    assert (written.where("tarde").count() > 0) == (order == "late" and files < 16)
    got = {r.message_id: (r.session_no, r.turno) for r in live.settled_turns(written).collect()}
    want = {r.message_id: (r.session_no, r.turno) for r in sessions.turn_number(log).collect()}
    assert got == want


@pytest.mark.parametrize("files", [1, 16])
def test_sessions_keep_null_and_large_ids(spark, log, files):
    """Ids beyond what doubles hold, and messages without an id, also as a user's latest one."""
    big = F.lit(1152921504606846977) + F.col("message_id")
    odd = log.withColumn("message_id", F.when(F.col("message_id") % 7 > 0, big))
    source, path, checkpoint = (scratch_path(spark, n) for n in "abc")
    # no two messages of one time and user without an id: their order would be open
    odd = odd.where("message_id is not null").unionByName(odd.where("message_id is null").dropDuplicates(["user_id", "date"]))
    for low, high in ((None, "2000-01-01"), ("1900-01-01", "2024-06-01"), ("2024-06-01", "2999-01-01")):
        part = odd.where(F.col("date").isNull()) if low is None else odd.where(F.col("date").between(F.lit(low).cast("timestamp_ntz"), F.lit(high).cast("timestamp_ntz")))
        part.coalesce(1).write.mode("append").parquet(source)
    kept = spark.read.schema(odd.schema).parquet(source)
    finish(live.write_table(live.session_turns(live.read_files(spark, source, odd.schema, files_per_trigger=files)), path, checkpoint))
    written = spark.read.parquet(path)
    assert written.count() == kept.count() and written.where("message_id is null").count() == kept.where("message_id is null and user_id is not null").count() > 0
    columns = ["message_id", "user_id", "session_no", "turno"]
    got = sorted(map(tuple, live.settled_turns(written).select(columns).collect()), key=str)
    assert got == sorted(map(tuple, sessions.turn_number(kept).select(columns).collect()), key=str)


def test_state_survives_a_restart(spark, log):
    source, path, checkpoint = (scratch_path(spark, n) for n in "abc")
    for low, high in ((0, 400), (400, 10**9)):
        part = log.where((F.col("message_id") >= low) & (F.col("message_id") < high))
        part.coalesce(1).write.mode("append").parquet(source)
        finish(live.write_table(live.session_turns(live.read_files(spark, source, log.schema)), path, checkpoint))
    got = {(r.message_id, r.session_no, r.turno) for r in spark.read.parquet(path).collect()}
    assert got == {(r.message_id, r.session_no, r.turno) for r in sessions.turn_number(log).collect()}


def test_gate_stream_drops_repeats(spark, log, folder):
    twice = scratch_path(spark, "twice")
    log.unionAll(log.where("message_id % 3 = 0")).write.parquet(twice)
    stream = live.read_files(spark, twice, log.schema)
    path, checkpoint = scratch_path(spark, "o"), scratch_path(spark, "c")
    finish(live.write_routed(stream, path, checkpoint))
    want = tx.with_route(tx.with_gate(log))
    got = live.read_routed(spark, path).select(*want.columns)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_messages_are_appended_from_a_stream(spark, log, folder):
    stream = live.read_files(spark, folder, log.schema, files_per_trigger=1)
    answered = stream.withColumn("output", F.concat(F.lit("r "), F.coalesce("input", F.lit(""))))
    path, checkpoint = scratch_path(spark, "o"), scratch_path(spark, "c")
    finish(live.write_table(tables.as_messages(answered, ["message_id"]), path, checkpoint))
    got = spark.read.parquet(path)
    assert got.count() == 2 * log.count() and got.select("message_id", "seq").distinct().count() == got.count()


def test_enriched_stream_equals_batch(spark, sf, log, folder):
    corpus = turn_corpus(spark, sf).cache()
    model = tfidf.TfidfModel.fit(corpus, "conv_id", "input")
    people = role(spark, sf, "r_propensity").select("user_id", "segmento_nombre")
    stream = live.read_files(spark, folder, log.schema, files_per_trigger=2)
    path, checkpoint = scratch_path(spark, "o"), scratch_path(spark, "c")
    finish(live.write_enriched(stream, people, model, corpus, path, checkpoint, "conv_id", min_sim=0.05))
    got = spark.read.parquet(path).drop("batch")
    routed = live.gate(log)
    asked = routed.where("not short_circuit and input is not null").select("message_id", F.col("input").alias("pregunta"))
    hits = tfidf.tfidf_topk(model, asked, corpus, "message_id", "pregunta", "conv_id", min_sim=0.05)
    want = sessions.turn_log(live.enrich(routed, people), hits, ["user_id", "segmento_nombre"])
    assert got.count() == log.count() and got.where("n_rag_docs > 0").count() > 0
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def test_a_user_advances_on_plain_arrays():
    """Rows in time order, those without a time last; the state holds the last dated message."""

    class State:
        exists, get = False, None

        def update(self, new):
            self.exists, self.get = True, new

    def rows(*of):
        ids, seconds, resets = zip(*of)
        return pd.DataFrame({"message_id": ids, "user_id": 3, "date": pd.to_datetime(pd.Series(seconds), unit="s"), "reset": pd.Series(resets, dtype=object), "sin_id": False})

    state = State()
    with warnings.catch_warnings():
        warnings.simplefilter("error")  # no data frame operation that guesses types
        (first,) = live._advance((3,), iter([rows((8, None, None), (5, 20, True)), rows((4, 20, None), (9, 10, False))]), state)
        (second,) = live._advance((3,), iter([rows((1, 15, None), (2, 30, True))]), state)
    columns = ["message_id", "session_no", "turno", "tarde", "reset"]
    assert first[columns].values.tolist() == [[9, 0, 1, False, False], [4, 0, 2, False, False], [5, 1, 1, False, True], [8, 1, 2, True, False]]
    assert second[columns].values.tolist() == [[1, 1, 3, True, False], [2, 2, 1, False, True]]
    assert state.get == (2, 1, 30_000_000, 2)


def test_short_circuited_turns_are_not_searched(spark, sf, monkeypatch):
    searched, real = [], vectors.dense_topk
    monkeypatch.setattr(vectors, "dense_topk", lambda asked, *rest, **named: searched.append(asked) or real(asked, *rest, **named))
    turns = logged_turns(spark, sf).select("message_id", "noise_gate", "n_rag_docs").collect()
    asked = {r.message_id for r in searched[0].select("message_id").collect()}
    assert asked == {r.message_id for r in turns if not r.noise_gate} and len(asked) < len(turns)
    assert all(r.n_rag_docs == 0 for r in turns if r.noise_gate) and any(r.n_rag_docs for r in turns)


RULES = [segments.NameRule("Activo", "txn_frec_por_dia"), segments.NameRule("Rico", "ingreso_mensual_mxn")]


def test_profile_job_from_csv(spark, sf):
    """Files in, profiles out; the stage tables and models are there afterwards."""
    paths = {}
    frames = {
        "r_customers": role(spark, sf, "r_customers"), "r_products": role(spark, sf, "r_products"),
        "r_transactions": role(spark, sf, "r_transactions"),
        "turns": role(spark, sf, "r_messages").select("conv_id", "user_id", "input", F.lit("x").alias("output"), "date", "channel_source"),
    }
    for name, df in frames.items():
        text = df.withColumns({c: F.col(c).cast("string") for c, t in df.dtypes if t == "timestamp_ntz"})
        paths[name] = scratch_path(spark, name)
        tables.write_table(text, paths[name], "csv")
    schema = {n: spark.read.option("header", True).csv(p).schema for n, p in paths.items()}

    def typed(name, doubles=(), ints=()):
        kinds = {**{c: "double" for c in doubles}, **{c: "int" for c in ints}}
        return ", ".join(f"{f.name} {kinds.get(f.name, 'string')}" for f in schema[name])

    out = scratch_path(spark, "job")
    job = ProfileJob(
        spark, out, RULES, qu.segment_table(spark, sf).withColumn("segmento_nombre", F.lit("Activo")).limit(1),
        product_types=qu.TYPES, targets={"tiene_tipo_1": "Tipo 1"}, params=propensity.TreeParams(rounds=3, folds=2),
        clusters=3, restarts=2, sweep=(2, 3), sweep_restarts=2,
    )
    result = job.run(
        tables.read_customers(spark, paths["r_customers"], typed("r_customers", ["satisfaccion_1_10", "ingreso_mensual_mxn"], ["edad", "score_buro", "antiguedad_dias", "dias_desde_ultimo_login"])),
        tables.read_products(spark, paths["r_products"], typed("r_products", ["utilizacion_pct", "saldo_actual", "limite_credito"])),
        tables.read_transactions(spark, paths["r_transactions"], typed("r_transactions", ["monto", "cashback_generado"], ["intento_numero", "meses_diferidos", "hora_del_dia"])),
        tables.with_turn_ids(tables.read_turns(spark, paths["turns"], typed("turns", ints=["channel_source"]))),
    )
    assert result.count() == frames["r_customers"].count()
    columns = set(result.columns)
    assert {"segmento_id", "prop_tipo_1", "producto_top_1", "flag_riesgo_churn", "noise_score_usuario"} <= columns
    assert result.where("prop_tipo_1 < 0 or prop_tipo_1 > 1").count() == 0
    summary = spark.read.parquet(f"{out}/resumen").first()
    assert summary.n_total == result.count()
    assert spark.read.parquet(f"{out}/metricas").count() == 1
    sweep = {r.k: r for r in spark.read.parquet(f"{out}/segmentos_barrido").collect()}
    assert sorted(sweep) == [2, 3] and sweep[3].cost <= sweep[2].cost
    fit = spark.read.parquet(f"{out}/segmentos_medidas").first()
    assert fit.k == 3 and -1 <= fit.silueta <= 1 and -1 <= fit.silueta_cuadrada <= 1 and fit.davies_bouldin > 0
    places = spark.read.parquet(f"{out}/segmentos_mapa")
    assert places.select("user_id").distinct().count() == result.count() and places.where("pca_x is null or pca_y is null").count() == 0
    means = spark.read.parquet(f"{out}/segmentos_perfil")
    direct = result.groupBy("segmento_nombre").count()
    assert means.join(direct, "segmento_nombre").count() == means.count() and {"ingreso_mensual_mxn", "score_buro", "conv_noise_pct"} <= set(means.columns)
    again = segments.Segmentation.load(spark, f"{out}/modelos/segmentos")
    assert again.transform(spark.read.parquet(f"{out}/master")).count() == result.count()
    # the written features equal those computed directly from the tables; empty texts are missing in files
    staged = spark.read.parquet(f"{out}/master").withColumn("user_id", F.col("user_id").cast("bigint"))
    direct = qu.master_table(spark, sf).select("user_id", "txn_total", "txn_n_dias_activo", "prod_n_total", "satisfaccion_1_10")
    assert direct.exceptAll(staged.select(*direct.columns)).count() == 0
    written = role(spark, sf, "r_messages").where("input <> ''")
    conv = features.conv_features(features.label_turns(clean.clean_turns(written)))
    conv = conv.select("user_id", "conv_n_total", "conv_noise_pct", "conv_reintentos_48h", "conv_turnos_max")
    assert conv.exceptAll(staged.select(*conv.columns)).count() == 0


def test_retrieval_job(spark, sf):
    rng = np.random.default_rng(0)
    turns = role(spark, sf, "r_turns")
    ids = [(r.conv_id, r.turn) for r in turns.select("conv_id", "turn").collect()]
    vec = [(c, t, [float(x) for x in rng.normal(size=4)]) for c, t in ids]
    given = turns.join(spark.createDataFrame(vec, "conv_id bigint, turn bigint, embedding array<float>"), ["conv_id", "turn"])
    # two short messages make the noise class
    given = given.withColumn("input", F.when(F.col("conv_id") % 5 == 0, F.lit("hola")).otherwise(F.col("input")))
    job = RetrievalJob(spark, scratch_path(spark, "retrieval"))
    model = job.prototypes(given)
    assert set(model.vectors) == {"noise", "on_topic"}
    assert vectors.PrototypeModel.load(spark, f"{job.out}/prototipos").threshold == model.threshold
    assert spark.read.parquet(f"{job.out}/reporte").count() == 5
    index = job.dense(given)
    assert index.where("length(input) > 200 or length(output) > 400").count() == 0
    assert index.where("embedding is null").count() == 0 and index.count() > 0
    _, corpus, rows = job.sparse(given)
    assert rows.count() <= corpus.count() and rows.where("size(t) <> size(w)").count() == 0
