"""Registered queries of the corpus operators, each over its whole table, and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_copies as copies
from . import cotraining, line_copies, mixing, near_copies, neighbours, online_packing, packed_ids, packing, passages, periodic_runs, personal_data, vector_codes
from .common import read
from .tokens import tokenizer_file

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def add(run):
        QUERIES[name] = run
        if check is not None:
            CHECKS[name] = check
        return run

    return add


@query("op1_best_fit_packing")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    packed = packing.pack_documents(read(spark, sf, "documents"), tokenizer_file())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")


@query(
    "op5_exact_copies",
    r"""
    with t as (select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[ \t\n\x0b\x0c\r]', '', 'g') as x from documents)
    select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by x) as group_size,
     row_number() over w = 1 as kept, sha256(x) as text_sha256
    from t window w as (partition by x order by n desc, doc_id)
    """,
)
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return copies.exact_copies(read(spark, sf, "documents"))


@query("op8_mix_sources")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(read(spark, sf, "documents"))


@query("op9_packed_ids")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return packed_ids.encode_and_read(read(spark, sf, "documents"), tokenizer_file()).drop("shard")


@query("op2_personal_data")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return personal_data.digest(personal_data.find(read(spark, sf, "documents")))


@query("op3_nearest_vectors")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.search(read(spark, sf, "embeddings"), "vec_id % 100 = 0")


@query("op6_cotraining_quality")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return cotraining.classify(read(spark, sf, "documents"), read(spark, sf, "labels"))


@query("op10_near_copies")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return near_copies.near_copies(read(spark, sf, "documents")).drop("row")


@query("op4_line_copies")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return line_copies.report(line_copies.line_matches(read(spark, sf, "documents")))


@query("op7_repeated_passages")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return passages.repeated_passages(read(spark, sf, "documents"))


@query("op13_online_packing")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return online_packing.digest(online_packing.pack_online(read(spark, sf, "documents"), tokenizer_file("word_bpe_49k.json")))


def _assigned(parts: str, books: str) -> str:
    """Every part's nearest entry by all distances (the lower index on ties) and its squared distance."""
    return f"""select vec_id, label, p, min(d) as d, arg_min(e, d * 64 + e) as e, any_value(x) as x from (
      select q.vec_id, q.label, q.p, q.x, b.e, list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(q.x, b.x)])::bigint as d
      from {parts} q join {books} b using (p)) group by vec_id, label, p"""


def _improved(assigned: str, books: str) -> str:
    return f"""select b.p, b.e, coalesce(m.x, b.x) as x from {books} b left join (
      select p, e, list(v order by i) as x from (
        select p, e, i, floor(sum(v)::double / count(*))::bigint as v from (select p, e, unnest(x) as v, generate_subscripts(x, 1) as i from {assigned}) group by p, e, i)
      group by p, e) m on m.p = b.p and m.e = b.e"""


@query(
    "op12_vector_codes",
    f"""
    with kept as materialized (select vec_id, label, [floor(256 * x::double)::bigint for x in embedding] as v, row_number() over (order by vec_id) - 1 as rn
      from embeddings where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
    parts as materialized (select vec_id, label, rn, p, list_slice(v, p * (len(v) // 16) + 1, (p + 1) * (len(v) // 16)) as x from kept, (select unnest(range(16)) as p)),
    b0 as materialized (select p, rn as e, x from parts where rn < 64),
    a0 as materialized ({_assigned('parts', 'b0')}),
    b1 as materialized ({_improved('a0', 'b0')}),
    a1 as materialized ({_assigned('parts', 'b1')}),
    b2 as materialized ({_improved('a1', 'b1')}),
    a2 as materialized ({_assigned('parts', 'b2')}),
    sha as (select sha256(string_agg(v::varchar, ',' order by p, e, i)) as s from (select p, e, unnest(x) as v, generate_subscripts(x, 1) as i from b2)),
    coded as (select vec_id, label, string_agg(printf('%02x', e::bigint), '' order by p) as code, sum(d)::bigint as error from a2 group by vec_id, label)
    select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, s as codebooks_sha256 from coded, sha
    """,
)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return vector_codes.report(read(spark, sf, "embeddings"))


@query(
    "op11_periodic_runs",
    r"""
    with recursive d as materialized (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
    c(r, s, k, x) as (
      select r, doc_id::varchar, 0::bigint, 4294967295::bigint from d
      union all
      select r, s, k + 1, xor((y // 2)::bigint, (case when y % 2 = 1 then 3988292384 else 0 end)::bigint)
      from (select r, s, k, case when k % 8 = 0 then xor(x, ascii(s[k // 8 + 1])::bigint) else x end as y from c where k < 8 * length(s))),
    h as materialized (select r, xor(x, 4294967295::bigint) as h from c where k = 8 * length(s)),
    w as materialized (select r, doc_id, [x for x in string_split_regex(text, '[ \t\n\x0b\x0c\r]+') if x <> ''] as w from d),
    v as materialized (select r, doc_id, w, len(w) as n, h % 10 = 0 and len(w) > 0 as planted, (h // 10) % greatest(len(w), 1) as a, h // 10 as g from w join h using (r)),
    p as materialized (select *, 1 + (n - a) // (3 + g % 8) as p from v),
    t as materialized (select r, n, unnest(range(n)) as i, unnest(w) as own, w, planted, a, p from p),
    t2 as materialized (select r, n, i, case when planted and i >= a then w[a + (i - a) % p + 1] else own end as x from t),
    e as materialized (select a.r, a.i, b.i - a.i as q from t2 a join t2 b on a.r = b.r and a.x = b.x and b.i > a.i and 4 * (b.i - a.i) <= a.n),
    g as (select r, q, min(i) as s, count(*) + q as l from (select *, i - row_number() over (partition by r, q order by i) as island from e) group by r, q, island),
    runs as materialized (select r, s, l, min(q) as q from g where l >= greatest(6, 4 * q) group by r, s, l),
    per as (select r, count(*) as n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' order by s, q) as lines,
      first(s order by l::double / q desc, s, q) as start, first(l order by l::double / q desc, s, q) as length, first(q order by l::double / q desc, s, q) as period from runs group by r),
    gone as (select distinct r, unnest(range(s + q, s + l)) as i from runs),
    kept as (select r, string_agg(x, ' ' order by i) as k from t2 anti join gone using (r, i) group by r)
    select doc_id, coalesce(n_runs, 0)::bigint as n_runs, start::bigint as start, length::bigint as length, period::bigint as period,
      (1000 * length // period)::bigint as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(k, '')) as collapsed_sha256
    from d left join per using (r) left join kept using (r)
    """,
)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.find(periodic_runs.with_planted(read(spark, sf, "documents"))))
