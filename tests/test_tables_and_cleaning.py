"""Files, tolerant parsing and cleaning, with pandas as the specification where it is one."""

import datetime as dt
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from profilekit import schemas
from profilekit.functions import values as v
from profilekit.operators import clean, master, vectors
from profilekit.session import scratch_path, scratch_root
from profilekit.sources import tables

T = dt.datetime


def test_csv_round_trip_keeps_blanks_quotes_and_lines(spark):
    schema = "conv_id string, user_id string, input string, output string, date string, channel_source int"
    rows = [
        ("1", "u", 'dijo "hola"\ny, adios', "x", "2024-01-01 00:00:00", 2),
        ("2", "u", "x", "  con blancos  ", "malo", 1),
        ("2b", "u", "", "sin texto", "malo", 1),
        ("2c", "u", "None", "sin texto", "malo", 1),
        ("3", "u", None, "perdido", None, None),
        ("4", None, "ñandú, sí", None, "2024-01-02 03:04:05.678901", 1),
    ]
    path = scratch_path(spark, "csv")
    tables.write_table(spark.createDataFrame(rows, schema), path, "csv")
    got = sorted(map(tuple, tables.read_turns(spark, path).collect()), key=lambda r: r[0])
    assert got == [rows[0], rows[1], rows[5]]


def test_write_table_overwrites(spark):
    path = scratch_path(spark, "over")
    tables.write_table(spark.range(5), path)
    tables.write_table(spark.range(3), path)
    assert tables.read_table(spark, path).count() == 3


def test_lookup(spark):
    profiles = spark.createDataFrame([("a", 1), ("b", 2)], "user_id string, x int")
    assert [tuple(r) for r in tables.lookup_one(profiles, "b").collect()] == [("b", 2)]
    with pytest.raises(KeyError):
        tables.lookup_one(profiles, "z")
    keys = spark.createDataFrame([("a",), ("a",), ("q",)], "user_id string")
    assert [tuple(r) for r in tables.lookup(profiles, keys).collect()] == [("a", 1)]


def test_append_messages_adds_two_rows_per_turn(spark):
    path = scratch_path(spark, "msgs")
    turns = spark.createDataFrame([("s", 1, "q", "r"), ("s", 2, "q2", None)], "sesion_id string, n int, input string, output string")
    for _ in range(2):
        tables.append_messages(tables.as_messages(turns, ["sesion_id", "n"]), path)
    got = spark.read.parquet(path)
    assert got.count() == 8
    assert got.where("rol = 'assistant' and contenido is null").count() == 2


def test_corpus_needs_a_long_answer(spark):
    df = spark.createDataFrame([("a", "x" * 30), ("b", "x" * 31), (None, "x" * 40), ("c", None)], "input string, output string")
    assert [r.input for r in tables.corpus(df).collect()] == ["b"]


def test_open_sessions(spark):
    df = spark.createDataFrame([(1, "u", False), (3, "u", True), (2, "u", True), (4, "w", False)], "id int, user_id string, activa boolean")
    assert [(r.id, r.user_id) for r in tables.open_sessions(df).collect()] == [(2, "u")]


def test_missing_columns(spark):
    df = spark.createDataFrame([("u",)], "user_id string")
    with pytest.raises(ValueError, match="edad"):
        schemas.with_columns_of(df, "user_id string, edad int")
    out = schemas.with_columns_of(df, "user_id string, edad int", ("edad",))
    assert out.dtypes == [("user_id", "string"), ("edad", "int")]


def test_parse_timestamp_and_flags(spark):
    df = spark.createDataFrame([("2024-02-30",), ("2024-02-03",), ("x",), (None,)], "t string")
    got = [r[0] for r in df.select(v.parse_timestamp(F.col("t"))).collect()]
    assert got == [None, T(2024, 2, 3), None, None]
    flags = spark.createDataFrame([("True", True), ("False", False), ("true", None), (None, True)], "a string, b boolean")
    assert [tuple(r) for r in clean.parse_flags(flags, ["a", "b", "zz"]).collect()] == [
        (True, True), (False, False), (None, None), (None, True),
    ]


def test_safe_casts(spark):
    df = spark.createDataFrame([("1.9",), ("-1.9",), ("nan",), ("inf",), ("x",), (None,), ("0.4",)], "t string")
    got = [tuple(r) for r in df.select(v.safe_int(F.col("t")), v.safe_bool(F.col("t"))).collect()]
    assert got == [(1, True), (-1, True), (0, False), (0, False), (0, False), (0, False), (0, False)]


def test_finite_and_currency(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (1234.4,), (None,)], "x double")
    assert [r[0] for r in df.select(v.finite(F.col("x"))).collect()] == [None, None, None, 1234.4, None]
    assert df.where("x = 1234.4").select(v.currency(F.col("x"))).first()[0] == "$1,234"


def test_group_median_as_pandas(spark):
    pdf = pd.DataFrame(
        {
            "k": ["a", "a", "a", "a", "b", "b", None, None, "c"],
            "x": [1.0, 2.0, np.nan, 4.0, np.nan, np.nan, np.nan, 3.0, 5.0],
        }
    )
    pdf["i"] = range(len(pdf))
    want = pdf["x"].fillna(pdf.groupby("k")["x"].transform("median")).fillna(7.5)
    df = spark.createDataFrame([(r.i, r.k, None if np.isnan(r.x) else r.x) for r in pdf.itertuples()], "i int, k string, x double")
    got = {r.i: r.x for r in clean.impute_group_median(df, "x", "k", 7.5).collect()}
    assert [got[i] for i in range(len(pdf))] == want.tolist()


def test_dedup_as_pandas(spark):
    rows = [("a", 3, 1), ("a", 1, 2), ("b", None, 3), ("b", 5, 4), (None, 2, 5), (None, 1, 6), ("c", None, 7)]
    pdf = pd.DataFrame(rows, columns=["id", "t", "n"])
    want = set(pdf.sort_values("t").drop_duplicates("id", keep="first")["n"])
    df = spark.createDataFrame(rows, "id string, t int, n int")
    assert {r.n for r in clean.dedup_keep_first(df, "id", "t").collect()} == want
    assert tuple(clean.dedup_report(df, "id").first()) == (7, 4, 3)


def test_dedup_limits_a_hot_key_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") > 5).alias("id"), F.col("id").alias("t"))
    plan = clean.dedup_keep_first(df, "id", "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_first_present_as_pandas(spark):
    rows = [
        ("c1", T(2024, 1, 2), 1, None, "o1"), ("c1", T(2024, 1, 1), 2, None, None), ("c1", None, 3, "i3", "o3"),
        ("c2", None, 4, "x", None), (None, T(2024, 1, 1), 5, "y", "z"),
    ]
    pdf = pd.DataFrame(rows, columns=["conv_id", "date", "turn", "input", "output"])
    want = pdf.sort_values("date").groupby("conv_id")[["input", "output"]].first()
    df = spark.createDataFrame(rows, "conv_id string, date timestamp_ntz, turn int, input string, output string")
    got = {r.conv_id: (r.input, r.output) for r in vectors.first_turns(df, ["input", "output"]).collect()}
    assert got == {k: tuple(None if pd.isna(x) else x for x in w) for k, w in zip(want.index, want.values)}


def test_encoder_order_and_reuse(spark):
    df = spark.createDataFrame([("b",), ("Á",), ("a",), ("0",)], "c string")
    fitted = master.CategoryEncoder(["c", "absent"]).fit(df)
    assert {r.c: r.c_code for r in fitted.transform(df).collect()} == {"0": 0, "a": 1, "b": 2, "Á": 3}
    new = spark.createDataFrame([("zz",), ("b",)], "c string")
    assert {r.c: r.c_code for r in fitted.transform(new).collect()} == {"zz": 4, "b": 2}


def test_fill_missing_by_type(spark):
    df = spark.createDataFrame([("u", None, None, None, None)], "user_id string, a double, b boolean, c string, d bigint")
    assert tuple(master.fill_missing(df).first()) == ("u", 0.0, False, "0", 0)


def test_turn_ids_repeat(spark):
    df = spark.createDataFrame([("1", "a"), ("2", None)], "conv_id string, input string")
    first = sorted(r.message_id for r in tables.with_turn_ids(df).collect())
    assert first == sorted(r.message_id for r in tables.with_turn_ids(df.repartition(3)).collect())


def test_scratch_is_the_shared_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or scratch_root(spark) == named
    assert scratch_path(spark, "a") != scratch_path(spark, "a")
    assert uuid.UUID(scratch_path(spark, "a").rsplit("-", 1)[1])
