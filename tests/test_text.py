"""Text rules on literal rows, column by column."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from profilekit.functions import fixed_values as fv
from profilekit.functions import sql as sql_functions
from profilekit.functions import text as tx
from profilekit.functions import values
from profilekit.plans.role_views import MESSAGES

EXTRA = [" hola mundo ", "aaa  bbb  ccc", "aa  bb  cc", "\tok\n", "CRÉDITO", "Ñ", "a", "9", "...", "jaja ok cuéntame un chiste"]
TEXTS = MESSAGES + EXTRA


@pytest.fixture(scope="module")
def messages(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, input string")


def by_id(df, *columns):
    return {r["id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_noise_type_and_score(messages):
    got = by_id(tx.with_turn_noise(messages), "noise_type", "noise_score")
    want = {
        0: ("exploracion_corta", 0.65), 1: ("on_topic", 0.0), 2: ("afirmacion_negacion", 0.4),
        3: ("menu_navegacion", 0.55), 4: ("solo_simbolos", 0.9), 5: ("broma_offtopic", 0.85),
        6: ("broma_offtopic", 0.3825), 8: ("artefacto_voz", 0.09), 13: ("exploracion_corta", 0.65),
        14: ("exploracion_corta", 0.65), 15: ("nulo", 1.0), 16: ("solo_simbolos", 0.9),
        18: ("afirmacion_negacion", 0.4), 19: ("on_topic", 0.0), 20: ("exploracion_corta", 0.65),
        21: ("on_topic", 0.0), 22: ("exploracion_corta", 0.65), 23: ("solo_simbolos", 0.9),
    }
    assert {i: got[i] for i in want} == want


def test_gate_truth_table(messages):
    got = by_id(tx.with_route(tx.with_gate(messages)), "gate", "noise_type", "noise_score", "response_code", "short_circuit")
    want = {
        2: (False, "afirm", 0.4, None, False),
        3: (True, "menu", 0.55, None, False),
        4: (True, "simbolos", 0.9, "simbolos", True),
        5: (True, "broma", 0.9, "broma", True),
        6: (False, "broma", 0.405, None, False),
        13: (True, "vacio", 1.0, "exploracion", True),
        14: (True, "vacio", 1.0, "exploracion", True),
        15: (True, "vacio", 1.0, "exploracion", True),
        0: (True, "exploracion", 0.65, "exploracion", True),
        19: (False, "on_topic", 0.0, None, False),
    }
    assert {i: got[i] for i in want} == want


def test_intent_is_first_rule_with_a_substring(messages):
    got = by_id(messages.select("id", tx.intent(F.col("input")).alias("x")), "x")
    want = {1: "tarjeta", 7: "inversion", 9: "tarjeta", 11: "seguridad", 12: "negocio", 15: "otro", 13: "otro", 19: "credito", 21: "transferencia", 22: "inversion"}
    assert {i: got[i][0] for i in want} == want


def test_label_puts_voice_first_and_null_is_noise(messages):
    got = by_id(messages.select("id", tx.noise_label(F.col("input")).alias("x")), "x")
    want = {0: "noise", 1: "on_topic", 8: "on_topic", 15: "noise", 13: "noise", 16: "noise", 19: "on_topic", 20: "noise"}
    assert {i: got[i][0] for i in want} == want


def test_words_finance_and_voice_on_literal_texts(spark):
    """Lower case and trimmed text, number of words, a finance word, a voice artefact."""
    want = {
        "Hola": ("hola", 1, False, False), " hola mundo ": ("hola mundo", 2, False, False), "aaa  bbb  ccc": ("aaa  bbb  ccc", 3, False, True),
        "aa  bb  cc": ("aa  bb  cc", 3, False, False), "aaa  bbb ccc": ("aaa  bbb ccc", 3, False, False), "\tok\n": ("ok", 1, False, False),
        "CRÉDITO": ("crédito", 1, True, False), "mi crédito, por favor": ("mi crédito, por favor", 4, True, False), "Ñandú 9": ("ñandú 9", 2, False, False),
        "...": ("...", 0, False, False), "": ("", 0, False, False), "año  que  viene": ("año  que  viene", 3, False, True), None: (None, None, None, None),
    }
    low = tx.normal(F.col("input"))
    df = spark.createDataFrame([(t,) for t in want], "input string")
    rows = df.select("input", low.alias("low"), tx.token_count(low).alias("n"), tx.has_word(low, fv.FINANCE).alias("fin"), tx.is_voice_artifact(F.col("input")).alias("voice")).collect()
    assert {r.input: tuple(r)[1:] for r in rows} == want


@pytest.mark.parametrize(
    "rules,expected",
    [
        (
            tx.AGENT_RULES,
            {4: ("alta", 0), 5: (False, "on_topic", 0.2, None), 23: (True, "simbolos", 0.95, "simbolos"),
             2: (False, "afirmacion", 0.4, None), 3: (False, "navegacion_menu", 0.4, None),
             13: (False, "on_topic", 0.2, None), 6: (True, "broma_detectada", 0.9, "broma_detectada")},
        ),
        (
            tx.SERVER_RULES,
            {4: (True, "solo_simbolos", 0.9, "solo_simbolos"), 5: (True, "broma_offtopic", 0.9, "broma_offtopic"),
             13: (True, "vacio", 1.0, "exploracion_corta"), 2: (False, "afirmacion_negacion", 0.4, None)},
        ),
    ],
)
def test_semantic_gate_low_score(messages, rules, expected):
    got = by_id(tx.with_semantic_gate(messages, F.lit(0.2), rules=rules), "gate", "noise_type", "noise_score", "response_code")
    for i, want in expected.items():
        if want[0] == "alta":  # symbols with an inner blank slip through the strict pattern
            assert got[i] == (False, "on_topic", 0.2, None)
        else:
            assert got[i] == want


def test_semantic_gate_high_score(messages):
    got = by_id(tx.with_semantic_gate(messages, F.lit(0.55)), "gate", "noise_type", "response_code")
    assert got[13] == (True, "exploracion", "exploracion")  # blank text goes to the score
    assert got[1] == (True, "alta_similitud_noise", "alta_similitud_noise")
    server = by_id(tx.with_semantic_gate(messages, F.lit(0.55), rules=tx.SERVER_RULES), "noise_type", "response_code")
    assert server[1] == ("alta_similitud_noise", "exploracion_corta")


def test_sql_functions_equal_columns(spark, messages):
    sql_functions.register(spark)
    sql = messages.selectExpr("id", "pk_intent(input) i", "pk_noise_label(input) l", "pk_token_count(input) n", "pk_normal(input) t")
    col = messages.select(
        "id", tx.intent(F.col("input")).alias("i"), tx.noise_label(F.col("input")).alias("l"),
        tx.token_count(tx.normal(F.col("input"))).alias("n"), tx.normal(F.col("input")).alias("t"),
    )
    assert by_id(sql, "i", "l", "n", "t") == by_id(col, "i", "l", "n", "t")


def test_sql_noise_gate_and_keys_equal_columns(spark, messages):
    sql_functions.register(spark)
    names = ["noise_type", "noise_score"]
    want = by_id(tx.with_turn_noise(messages), *names)
    assert by_id(messages.selectExpr("id", *[f"pk_{n}(input) as {n}" for n in names]), *names) == want
    gated = tx.with_route(tx.with_gate(messages))
    sql = messages.selectExpr("id", *[f"pk_{n}(input) as {n}" for n in ("gate", "gate_type", "gate_score", "response_code", "short_circuit")])
    assert by_id(sql, "gate", "gate_type", "gate_score", "response_code", "short_circuit") == by_id(gated, "gate", "noise_type", "noise_score", "response_code", "short_circuit")
    flags = messages.selectExpr("id", "pk_has_urgency(input) u", "pk_has_frustration(input) f")
    assert by_id(flags, "u", "f") == by_id(messages.select("id", tx.has_urgency(F.col("input")).alias("u"), tx.has_frustration(F.col("input")).alias("f")), "u", "f")
    keys = spark.createDataFrame([("  Corta (2 frases)",), ("Media larga (x)",), (None,)], "t string")
    assert [r[0] for r in keys.selectExpr("pk_dim_key(t)").collect()] == ["corta", "media", None]


def test_sql_casts_never_fail(spark):
    sql_functions.register(spark)
    texts = ["3", "2.9", "-2.9", " 7 ", "x", "", None, "NaN", "Infinity", "-Infinity", "1e30", "0", "0.4"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    columns = df.select(values.safe_double(F.col("t")), values.safe_int(F.col("t")), values.safe_bool(F.col("t"))).collect()
    got = df.selectExpr("pk_safe_double(t)", "pk_safe_int(t)", "pk_safe_bool(t)").collect()
    assert [str(tuple(r)) for r in got] == [str(tuple(r)) for r in columns]


def test_encoder_hook(messages):
    df = sql_functions.with_embedding(messages, lambda texts: [[float(len(t)), 1.0] for t in texts])
    got = by_id(df, "embedding")
    assert got[0][0] == [4.0, 1.0] and got[15][0] == [0.0, 1.0]


def test_no_python_in_text_plans(messages):
    plan = tx.with_route(tx.with_gate(tx.with_turn_noise(messages).drop("noise_type", "noise_score")))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "ArrowEval" not in text


def test_dim_key(spark):
    df = spark.createDataFrame([("  Corta (2 frases)",), ("Media larga (x)",), (None,)], "t string")
    got = [tuple(r) for r in df.select(tx.dim_key(F.col("t")), tx.dim_key(F.col("t"), first_word=False)).collect()]
    assert got == [("corta", "corta"), ("media", "media larga"), (None, None)]


def test_agrees_with_pandas_contains(messages):
    pdf = pd.DataFrame({"input": TEXTS})
    want = pdf["input"].str.lower().str.contains("|".join(fv.FRUSTRATION), na=False, regex=True).tolist()
    got = by_id(messages.select("id", F.coalesce(tx.has_frustration(F.col("input")), F.lit(False)).alias("x")), "x")
    assert [got[i][0] for i in range(len(TEXTS))] == want


def test_turn_labels_lower_a_text_once(spark):
    """Lower-casing is not repeated by test and branch; the finance words are looked for where a branch asks for them."""
    texts = spark.range(40).selectExpr("case when id % 3 = 0 then null else concat('Hola ', id, ' TARJETA x') end as input")
    labelled = tx.with_turn_labels(texts)
    plan = labelled._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 2 and "_finance" not in plan
    plain = tx.with_turn_noise(texts).withColumns({"intent": tx.intent(F.col("input")), "label": tx.noise_label(F.col("input"))})
    assert sorted(map(str, labelled.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
