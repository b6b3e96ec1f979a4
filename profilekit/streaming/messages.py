"""The chat path as streams: gate and route, sessions with state, enrichment.

All text rules are the batch expressions. Sources should set a rate limit (``maxFilesPerTrigger`` or the
like): it bounds a micro-batch and with it the rows one user can have in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import with_gate, with_route
from ..operators.sessions import turn_log, turn_number
from ..operators.tfidf import TfidfModel, tfidf_topk


def read_files(spark: SparkSession, folder: str, schema, glob: str | None = None, files_per_trigger: int = 16) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(folder)


def new_messages(batch: DataFrame, earlier: DataFrame | None) -> DataFrame:
    """The messages of a micro-batch without those delivered before, in it or in ``earlier`` batches.

    A repeat has the same ``message_id`` and day. Messages without an id are never repeats. No message is too late.
    Of ``earlier`` (message_id, dia) only the days that the batch touches are read.
    """
    batch = batch.withColumn("dia", F.to_date("date"))
    named = batch.where(F.col("message_id").isNotNull()).dropDuplicates(["message_id", "dia"])
    if earlier is not None:
        low, high = batch.agg(F.min("dia"), F.max("dia")).first()
        earlier = earlier.where(F.col("dia").isNull() | F.col("dia").between(F.lit(low), F.lit(high)))
        same = (named["message_id"] == earlier["message_id"]) & named["dia"].eqNullSafe(earlier["dia"])
        named = named.join(earlier, same, "left_anti")
    return named.unionByName(batch.where(F.col("message_id").isNull()))


def gate(messages: DataFrame, text: str = "input") -> DataFrame:
    return with_route(with_gate(messages, text))


def _earlier(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """What batches before ``batch_id`` have routed, if any has written yet."""
    try:
        written = spark.read.schema("message_id bigint, batch bigint, dia date, short_circuit string").parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return written.where(F.col("batch") < batch_id).select("message_id", "dia")


def write_routed(messages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Gates messages and writes them once each, gated turns and those that go on to the answer path in two partitions.

    Each micro-batch overwrites its own folder, so a repeated batch does not double rows; inside, messages lie by day.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        fresh = gate(new_messages(batch, _earlier(batch.sparkSession, path, batch_id)))
        fresh.write.mode("overwrite").partitionBy("dia", "short_circuit").parquet(f"{path}/batch={batch_id}")
        batch.unpersist()

    return (
        messages.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_routed(spark: SparkSession, path: str) -> DataFrame:
    """The routed table; folder names are text, the flag is a boolean again."""
    routed = spark.read.parquet(path).drop("batch", "dia")
    return routed.withColumn("short_circuit", F.col("short_circuit").cast("boolean"))


# --- sessions with state -----------------------------------------------------------------------------

TURNS = "message_id bigint, user_id bigint, date timestamp_ntz, reset boolean, session_no bigint, turno bigint, tarde boolean, sin_id boolean"
#: Stands for a missing id inside the state and its batches: a null would turn the other ids into rounded doubles. It sorts first, as nulls do.
NO_ID = -(1 << 63)
#: A missing time as a number.
NO_TIME = -(1 << 63)
STATE = "session_no bigint, turno bigint, fecha bigint, mensaje bigint"


def _advance(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    session, turn, last, last_id = state.get if state.exists else (0, 0, None, None)
    rows = pd.concat(batches, ignore_index=True)
    # a call per user: plain arrays, as a few rows cost as much as thousands in data frames
    at, ids = rows["date"].astype("datetime64[us]").to_numpy().view("int64"), rows["message_id"].to_numpy()
    undated = at == NO_TIME
    order = np.lexsort((ids, at, undated))
    at, ids, undated = at[order], ids[order], undated[order]
    reset = np.asarray(rows["reset"].to_numpy()[order] == True, bool)  # noqa: E712
    number = session + reset.cumsum()
    starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
    turno = np.arange(1, len(number) + 1) - np.repeat(starts, np.diff(np.r_[starts, len(number)])) + turn * (number == session)
    late = undated
    if last is not None:
        late = undated | (at < last) | ((at == last) & (ids < last_id))
    dated = len(at) - int(undated.sum())  # they come first
    if dated and (last is None or (at[dated - 1], ids[dated - 1]) > (last, last_id)):
        last, last_id = int(at[dated - 1]), int(ids[dated - 1])
    state.update((int(number[-1]), int(turno[-1]), last, last_id))
    yield pd.DataFrame(
        {
            "message_id": ids, "user_id": key[0], "date": rows["date"].array.take(order), "reset": reset, "session_no": number,
            "turno": turno, "tarde": late, "sin_id": rows["sin_id"].to_numpy()[order],
        }
    )


def session_turns(messages: DataFrame) -> DataFrame:
    """Live session and turn numbers; the state of a user is two counters and the time and id of the last message.

    Micro-batches are numbered as they arrive, in time order inside one. A message that comes after a later one of
    its user, or without a time, is marked ``tarde``; ``settled_turns`` numbers the users who have such messages anew.
    Messages without an id are numbered as well, before others of the same time, and keep their null.
    """
    own = F.col("message_id").cast("bigint")
    numbered = (
        messages.select(F.coalesce(own, F.lit(NO_ID)).alias("message_id"), "user_id", "date", "reset", own.isNull().alias("sin_id"))
        .where(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .applyInPandasWithState(_advance, TURNS, STATE, "append", GroupStateTimeout.NoTimeout)
    )
    return numbered.withColumn("message_id", F.when(~F.col("sin_id"), F.col("message_id"))).drop("sin_id")


def settled_turns(written: DataFrame) -> DataFrame:
    """Session and turn numbers in time order, whatever the order of arrival: live numbers stay for users without late messages."""
    late = written.where("tarde").select("user_id").distinct()
    live = written.join(late, "user_id", "left_anti")
    again = turn_number(written.drop("session_no", "turno").join(late, "user_id", "left_semi"))
    columns = ["message_id", "user_id", "session_no", "turno"]
    return live.select(columns).unionByName(again.select(*[F.col(c).cast("bigint") for c in columns]))


def write_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


# --- enrichment --------------------------------------------------------------------------------------


def enrich(turns: DataFrame, profiles: DataFrame) -> DataFrame:
    """Stream-static left join with the profile table; Spark picks the join from the table's size."""
    return turns.join(profiles, "user_id", "left")


def write_enriched(
    messages: DataFrame,
    profiles: DataFrame,
    model: TfidfModel,
    corpus: DataFrame,
    path: str,
    checkpoint: str,
    doc_id: str = "doc_id",
    doc_text: str = "input",
    answer: str = "output",
    rows: DataFrame | None = None,
    min_sim: float | None = None,
) -> StreamingQuery:
    """Gates, adds the profile and looks up examples for the turns that need an answer, per micro-batch.

    Each micro-batch overwrites its own folder, so a repeated batch does not double rows.
    """
    keep = [c for c in ("user_id", *[c for c in profiles.columns if c != "user_id"])]
    limits = {} if min_sim is None else {"min_sim": min_sim}

    def handle(batch: DataFrame, batch_id: int) -> None:
        routed = gate(batch).persist()
        asked = routed.where(~F.col("short_circuit") & F.col("input").isNotNull())
        hits = tfidf_topk(
            model, asked.select("message_id", F.col("input").alias("_q")), corpus, "message_id", "_q", doc_id,
            doc_text, answer, rows=rows, **limits,
        )
        log = turn_log(enrich(routed, profiles), hits, keep)
        log.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        routed.unpersist()

    return (
        messages.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
