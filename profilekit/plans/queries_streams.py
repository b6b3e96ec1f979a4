"""Queries: the message log as a stream, and the turn log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text as tx
from ..operators import sessions, tfidf, vectors, views
from ..session import materialize, scratch_path
from ..sources import tables
from ..streaming import messages as live
from . import checks as q
from .queries_models import MIN_SIM
from .queries_tables import GATED
from .queries_users import SESSIONS
from .registry import query
from .role_views import duck, role, table


def message_stream(spark, sf) -> DataFrame:
    """The message role over a stream of several files of the events table, delivered over micro-batches."""
    events = table(spark, sf, "events")
    path = scratch_path(spark, "arriving")
    events.repartitionByRange(4, "ts").write.parquet(path)
    return role(spark, sf, "r_messages", events=live.read_files(spark, path, events.schema, files_per_trigger=2))


def _finished(running) -> None:
    running.awaitTermination()
    if running.exception():
        raise running.exception()


@query(
    "stream_gate",
    duck("r_messages") + f" select {GATED}, gate and response_code is not null as short_circuit from ({q.gate('r_messages')})",
    raw=True,
)
def stream_gate(spark, sf):
    path, checkpoint = scratch_path(spark, "routed"), scratch_path(spark, "routed-checkpoint")
    _finished(live.write_routed(message_stream(spark, sf), path, checkpoint))
    return live.read_routed(spark, path).select(*GATED.split(", "), "short_circuit")


@query(
    "stream_turns",
    q.with_(SESSIONS, roles=["r_messages"])
    + "select message_id, user_id, session_no::bigint as session_no, turno from trn",
)
def stream_turns(spark, sf):
    path, checkpoint = scratch_path(spark, "turns"), scratch_path(spark, "turns-checkpoint")
    _finished(live.write_table(live.session_turns(message_stream(spark, sf)), path, checkpoint))
    return live.settled_turns(spark.read.parquet(path))


def turn_corpus(spark, sf) -> DataFrame:
    """First real question and answer of each conversation."""
    return vectors.first_turns(tables.corpus(role(spark, sf, "r_turns")), ["input", "output"])


FIRST = "first({c} order by date nulls last, turn) filter (where {c} is not null) as {c}"
ENRICHED = f"""
 corpus as (select conv_id, {FIRST.format(c='input')}, {FIRST.format(c='output')} from r_turns where input is not null and output is not null and length(output) > 30 and conv_id is not null group by conv_id),
 gated as (select *, gate and response_code is not null as short_circuit from ({q.gate('r_messages')})),
 corpus_docs as (select conv_id as doc_id, input as text from corpus),
 query_docs as (select message_id as query_id, input as text from gated where not short_circuit and input is not null),
 {q.TFIDF},
 tp as (select query_id as q, doc_id as d, sum(qw.weight * postings.weight) as sim from qw join postings using (term) group by all),
 answers as (select conv_id as d, output from corpus),
 {q.topk('tp', fv.SPARSE_MIN_SIM)},
 docs as (select q as message_id, count(*) as n, string_agg(similitud::varchar, ' ' order by rn) as t from hits group by q)"""


@query(
    "stream_enrich",
    q.with_(ENRICHED, roles=["r_turns", "r_messages", "r_propensity"])
    + """select message_id, g.user_id, segmento_nombre, short_circuit as noise_gate, noise_type, noise_score,
 coalesce(n, 0) as n_rag_docs, coalesce(t, '') as rag_sims from gated g left join docs using (message_id) left join r_propensity p on p.user_id = g.user_id""",
    raw=True,
)
def stream_enrich(spark, sf):
    path, checkpoint = scratch_path(spark, "enriched"), scratch_path(spark, "enriched-checkpoint")
    corpus = materialize(turn_corpus(spark, sf), "corpus")
    model = tfidf.TfidfModel.fit(corpus, "conv_id", "input")
    rows = materialize(model.rows(corpus, "conv_id", "input"), "corpus-rows")
    profiles = role(spark, sf, "r_propensity").select("user_id", "segmento_nombre")
    _finished(
        live.write_enriched(
            message_stream(spark, sf), profiles, model, corpus, path, checkpoint, "conv_id", "input", "output", rows,
        )
    )
    return with_text_sims(spark.read.parquet(path).drop("batch"))


def with_text_sims(log: DataFrame) -> DataFrame:
    return log.withColumn("rag_sims", F.array_join(F.transform("rag_sims", lambda x: x.cast("string")), " "))


# --- turn log ----------------------------------------------------------------------------------------

LOG = f"""
 gated as ({q.gate('trn')}),
 vp as (select a.message_id as q, b.doc_id as d, list_inner_product(a.embedding::double[], b.embedding::double[]) as sim from r_message_vectors a cross join r_vectors b),
 answers as (select doc_id as d, output from r_vectors),
 {q.topk('vp', MIN_SIM)},
 docs as (select q as message_id, count(*) as n, sum(similitud) as s, string_agg(similitud::varchar, ' ' order by rn) as t from hits group by q),
 lg as (select message_id, user_id, session_no::bigint as session_no, turno, gate and response_code is not null as noise_gate, noise_type, noise_score,
  case when gate and response_code is not null then 0 else coalesce(n, 0) end as n_rag_docs, case when gate and response_code is not null then 0 else coalesce(s, 0) end as sims,
  case when gate and response_code is not null then '' else coalesce(t, '') end as rag_sims from gated left join docs using (message_id))"""
LOGGED = q.with_(SESSIONS, LOG, roles=["r_messages", "r_message_vectors", "r_vectors"])


def logged_turns(spark, sf) -> DataFrame:
    turns = sessions.turn_number(role(spark, sf, "r_messages"))
    routed = tx.with_route(tx.with_gate(turns))
    # short-circuited turns never reach retrieval
    asked = tx.with_route(tx.with_gate(role(spark, sf, "r_message_vectors"))).where(~F.col("short_circuit"))
    hits = vectors.dense_topk(asked, role(spark, sf, "r_vectors"), "message_id", "doc_id", min_sim=MIN_SIM)
    return sessions.turn_log(routed, hits, ["user_id", "session_no", "turno"])


@query(
    "turn_log",
    LOGGED + "select message_id, user_id, session_no, turno, noise_gate, noise_type, noise_score, n_rag_docs, rag_sims from lg",
    raw=True,
)
def turn_log(spark, sf):
    return with_text_sims(logged_turns(spark, sf))


@query(
    "session_summary",
    LOGGED
    + f"""select user_id, session_no, count(*) as total_turnos, count(*) filter (where noise_gate) as turnos_noise, {q.r('round(count(*) filter (where noise_gate) / count(*), 3)')} as pct_noise,
 {q.r('round(sum(noise_score) / count(*), 3)')} as noise_score_medio, sum(n_rag_docs)::bigint as docs_rag_total, {q.r('round(sum(sims) / greatest(sum(n_rag_docs), 1), 3)')} as rag_sim_media from lg group by all""",
)
def session_summary(spark, sf):
    return views.session_summary(logged_turns(spark, sf), ["user_id", "session_no"])
