"""Queries: sources, cleaning, text rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fv
from ..functions import text as tx
from ..functions import values as v
from ..operators import clean, master, vectors, views
from ..session import scratch_path
from ..sources import tables
from . import checks as q
from .registry import query
from .role_views import duck, role

# --- A sources and sinks ---------------------------------------------------------------------------


def _as_csv(df: DataFrame, name: str) -> str:
    """Times as full text, so that the file keeps microseconds."""
    path = scratch_path(df.sparkSession, name)
    times = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)]
    tables.write_table(df.withColumns({c: F.col(c).cast("string") for c in times}) if times else df, path, "csv")
    return path


def _schema(df: DataFrame, text=("user_id",)) -> T.StructType:
    """The role's columns; ids and times as text, as in the files."""
    as_text = {f.name for f in df.schema if isinstance(f.dataType, T.TimestampNTZType) or f.name in text}
    return T.StructType([T.StructField(f.name, T.StringType() if f.name in as_text else f.dataType) for f in df.schema])


@query("scan_customers", duck("r_customers") + " select * replace (user_id::varchar as user_id) from r_customers", raw=True)
def scan_customers(spark: SparkSession, sf: str) -> DataFrame:
    df = role(spark, sf, "r_customers")
    return tables.read_customers(spark, _as_csv(df, "customers"), _schema(df))


@query("scan_products", duck("r_products") + " select * replace (producto_id::varchar as producto_id, user_id::varchar as user_id) from r_products", raw=True)
def scan_products(spark, sf):
    df = role(spark, sf, "r_products")
    return tables.read_products(spark, _as_csv(df, "products"), _schema(df, ("user_id", "producto_id")))


@query(
    "scan_transactions",
    duck("r_transactions")
    + " select * replace (transaccion_id::varchar as transaccion_id, user_id::varchar as user_id, epoch_us(fecha_hora) as fecha_hora) from r_transactions",
    raw=True,
)
def scan_transactions(spark, sf):
    df = role(spark, sf, "r_transactions")
    out = tables.read_transactions(spark, _as_csv(df, "transactions"), _schema(df, ("user_id", "transaccion_id")))
    return out.withColumn("fecha_hora", v.parse_timestamp(F.col("fecha_hora")))


@query(
    "scan_turns",
    duck("r_turns") + " select conv_id::varchar as conv_id, turn, user_id::varchar as user_id, epoch_us(date) as date, input, output from r_turns where input is not null",
    raw=True,
)
def scan_turns(spark, sf):
    df = role(spark, sf, "r_turns")
    out = tables.read_turns(spark, _as_csv(df, "turns"), _schema(df, ("user_id", "conv_id")))
    return out.withColumn("date", v.parse_timestamp(F.col("date")))


FIRST = "first({c} order by date nulls last, turn) filter (where {c} is not null) as {c}"


@query(
    "rag_corpus",
    duck("r_turns")
    + f" select conv_id, {FIRST.format(c='input')}, {FIRST.format(c='output')} from r_turns where input is not null and output is not null and length(output) > 30 and conv_id is not null group by conv_id",
)
def rag_corpus(spark, sf):
    return vectors.first_turns(tables.corpus(role(spark, sf, "r_turns")), ["input", "output"])


@query(
    "profile_lookup",
    duck("r_propensity", "r_messages")
    + " select user_id, segmento_nombre, prop_a, tiene_a from r_propensity where user_id in (select user_id from r_messages)",
    raw=True,
)
def profile_lookup(spark, sf):
    found = tables.lookup(role(spark, sf, "r_propensity"), role(spark, sf, "r_messages"))
    return found.select("user_id", "segmento_nombre", "prop_a", "tiene_a")


@query(
    "metrics_read",
    """select o_orderkey as run_id, epoch_us(o_orderdate) as ejecutado_at, o_orderpriority as producto, 'tiene_a' as col_target, (o_orderkey % 9 + 1) / 10 as test_auc from orders
 union all select o_orderkey, epoch_us(o_orderdate), o_orderstatus, 'tiene_b', 0.5 from orders""",
    raw=True,
)
def metrics_read(spark, sf):
    path = scratch_path(spark, "metrics")
    tables.write_table(views.metrics_of_runs(role(spark, sf, "r_runs")), path)
    return tables.read_table(spark, path)


@query(
    "table_scan",
    duck("r_classifications")
    + " select id, user_id, epoch_us(created_at) as created_at, segmento_nombre from r_classifications where activo order by created_at desc, id limit 50",
    raw=True,
)
def table_scan(spark, sf):
    return tables.scan(
        role(spark, sf, "r_classifications"), ["id", "user_id", "created_at", "segmento_nombre"], {"activo": True},
        [F.col("created_at").desc(), F.col("id")], 50,
    )


INDEX = f"""
 good as (select * from r_turns where {q.noise_label()} = 'on_topic' and length(output) > 30 and length(input) > 5 and conv_id is not null),
 idx as (select conv_id, {FIRST.format(c='input')}, {FIRST.format(c='output')}, {FIRST.format(c='user_id')} from good group by conv_id)"""


@query(
    "dense_index",
    q.with_(INDEX, roles=["r_turns"]) + "select conv_id, left(input, 200) as input, left(output, 400) as output, user_id from idx",
)
def dense_index(spark, sf):
    return vectors.index_metadata(vectors.dense_index(role(spark, sf, "r_turns")))


@query(
    "append_messages",
    duck("r_turns")
    + " select conv_id, turn, 0 as seq, 'user' as rol, 'texto' as tipo, input as contenido from r_turns union all select conv_id, turn, 1, 'assistant', 'texto', output from r_turns",
)
def append_messages(spark, sf):
    path = scratch_path(spark, "messages")
    tables.append_messages(tables.as_messages(role(spark, sf, "r_turns"), ["conv_id", "turn"]), path)
    return tables.read_table(spark, path)


NONFINITE = "select id, user_id, case when id % 7 = 0 then cast('NaN' as double) when id % 11 = 0 then cast('Infinity' as double) when id % 13 = 0 then cast('-Infinity' as double) else noise_score_usuario end as noise_score_usuario from r"


@query(
    "clean_nonfinite",
    duck("r_classifications")
    + f", r as (select * from r_classifications), d as ({NONFINITE}) select id, user_id, case when isfinite(noise_score_usuario) then noise_score_usuario end as noise_score_usuario from d",
    raw=True,
)
def clean_nonfinite(spark, sf):
    dirty = spark.sql(NONFINITE.replace("from r", "from {r}"), r=role(spark, sf, "r_classifications"))
    return views.clean_nonfinite(dirty)


# --- B cleaning --------------------------------------------------------------------------------------


@query(
    "clean_customers",
    q.with_(q.CUST, roles=["r_customers"])
    + "select * from cust",
    raw=True,
)
def clean_customers(spark, sf):
    return clean.clean_customers(role(spark, sf, "r_customers"))


@query(
    "fill_constants",
    duck("r_customers") + " select user_id, coalesce(estado, 'Desconocido') as estado, coalesce(ciudad, 'Desconocido') as ciudad from r_customers",
)
def fill_constants(spark, sf):
    df = role(spark, sf, "r_customers").select("user_id", "estado", "ciudad")
    return clean.fill_constants(df, {"estado": "Desconocido", "ciudad": "Desconocido"})


@query("impute_group_median", q.with_(q.CUST, roles=["r_customers"]) + "select user_id, ocupacion, satisfaccion_1_10 from cust", raw=True)
def impute_group_median(spark, sf):
    df = role(spark, sf, "r_customers").select("user_id", "ocupacion", "satisfaccion_1_10")
    return clean.impute_group_median(df, "satisfaccion_1_10", "ocupacion", fv.DEFAULT_SATISFACTION)


@query("parse_bool", q.with_(q.CUST, roles=["r_customers"]) + "select user_id, es_hey_pro, patron_uso_atipico from cust")
def parse_bool(spark, sf):
    df = role(spark, sf, "r_customers").select("user_id", "es_hey_pro", "patron_uso_atipico")
    return clean.parse_flags(df, fv.CUSTOMER_FLAGS)


@query(
    "parse_ts",
    duck("r_products") + " select producto_id, epoch_us(try_cast(fecha_apertura as timestamp)) as fecha_apertura from r_products",
)
def parse_ts(spark, sf):
    df = role(spark, sf, "r_products")
    return df.select("producto_id", v.parse_timestamp(F.col("fecha_apertura")).alias("fecha_apertura"))


@query(
    "null_out_of_range",
    duck("r_products") + " select producto_id, case when utilizacion_pct >= 0 and utilizacion_pct <= 1 then utilizacion_pct end as utilizacion_pct from r_products",
    raw=True,
)
def null_out_of_range(spark, sf):
    df = role(spark, sf, "r_products")
    return df.select("producto_id", v.null_outside(F.col("utilizacion_pct"), 0, 1).alias("utilizacion_pct"))


LINES = "select l_orderkey * 10 + l_linenumber as linea_id, l_shipdate as fecha_hora, l_partkey, l_suppkey, l_extendedprice from"


@query(
    "dedup_keep_first",
    f"""with x as ({LINES} lineitem) select linea_id, epoch_us(fecha_hora) as fecha_hora, l_partkey, l_suppkey, l_extendedprice
 from x qualify row_number() over (partition by linea_id order by fecha_hora nulls last, l_partkey nulls first, l_suppkey nulls first, l_extendedprice nulls first) = 1""",
    raw=True,
)
def dedup_keep_first(spark, sf):
    lines = spark.sql(LINES + " {t}", t=spark.read.parquet(f"{sf}/lineitem.parquet"))
    return clean.dedup_keep_first(lines, "linea_id", "fecha_hora", ["l_partkey", "l_suppkey", "l_extendedprice"])


@query(
    "dedup_report",
    f"""with x as ({LINES} lineitem), n as (select linea_id, count(*) as n from x group by linea_id)
 select sum(n)::bigint as n_rows, count(*) as n_kept, sum(n - 1)::bigint as n_removed from n""",
)
def dedup_report(spark, sf):
    lines = spark.sql(LINES + " {t}", t=spark.read.parquet(f"{sf}/lineitem.parquet"))
    return clean.dedup_report(lines, "linea_id")


@query(
    "clean_turns",
    duck("r_messages")
    + " select message_id, conv_id, user_id, epoch_us(date) as date, input, channel_source, reset, (coalesce(channel_source = 2, false))::int as es_voz, length(input) as input_len from r_messages where input is not null",
)
def clean_turns(spark, sf):
    return clean.clean_turns(role(spark, sf, "r_messages"))


@query(
    "encode_categories",
    q.with_(q.CUST, roles=["r_customers"])
    + "select user_id, "
    + ", ".join(
        f"coalesce({c}, '0') as {c}, (dense_rank() over (order by coalesce({c}, '0')) - 1)::int as {c}_code"
        for c in ("ocupacion", "genero", "estado", "ciudad")
    )
    + " from cust",
)
def encode_categories(spark, sf):
    df = master.fill_missing(clean.clean_customers(role(spark, sf, "r_customers")))
    return master.encode_categories(df.select("user_id", "ocupacion", "genero", "estado", "ciudad"))


MATRIX = ["edad", "ocupacion", "es_hey_pro", "score_buro", "edad", "nivel_educativo", "satisfaccion_1_10"]


@query(
    "feature_matrix",
    q.with_(q.CUST, roles=["r_customers"])
    + """select user_id, edad::double as edad, (dense_rank() over (order by coalesce(ocupacion, '0')) - 1)::double as ocupacion,
 coalesce(es_hey_pro, false)::int::double as es_hey_pro, score_buro::double as score_buro, satisfaccion_1_10 from cust""",
    raw=True,
)
def feature_matrix(spark, sf):
    df = master.fill_missing(clean.clean_customers(role(spark, sf, "r_customers")))
    return master.feature_matrix(df, MATRIX)


@query(
    "users_filter",
    duck("r_propensity")
    + " select user_id, segmento_nombre, prop_a from r_propensity where regexp_matches(segmento_nombre, '(?i)house') order by user_id limit 10",
    raw=True,
)
def users_filter(spark, sf):
    return views.users_filter(role(spark, sf, "r_propensity"), "house", 10, ["user_id", "segmento_nombre", "tono", "prop_a"])


@query(
    "safe_cast",
    duck("r_products")
    + """, x as (select producto_id, case when producto_id % 7 = 0 then fecha_apertura when producto_id % 5 = 0 then 'nan' else (producto_id % 4)::varchar || '.5' end as t from r_products),
 d as (select producto_id, coalesce(try_cast(t as double), 0) as n from x)
 select producto_id, case when isfinite(n) then n end as numero, (case when isfinite(n) then trunc(n) else 0 end)::bigint as entero, case when isfinite(n) then trunc(n) <> 0 else false end as logico from d""",
    raw=True,
)
def safe_cast(spark, sf):
    df = role(spark, sf, "r_products").select(
        "producto_id",
        F.when(F.col("producto_id") % 7 == 0, F.col("fecha_apertura"))
        .when(F.col("producto_id") % 5 == 0, "nan")
        .otherwise(F.concat((F.col("producto_id") % 4).cast("string"), F.lit(".5")))
        .alias("t"),
    )
    t = F.col("t")
    return df.select(
        "producto_id", v.finite(v.safe_double(t)).alias("numero"), v.safe_int(t).alias("entero"),
        v.safe_bool(t).alias("logico"),
    )


# --- C text rules ------------------------------------------------------------------------------------


def _messages(spark, sf) -> DataFrame:
    return role(spark, sf, "r_messages")


def _text_query(name: str, sql: str, column) -> None:
    @query(name, duck("r_messages") + f" select message_id, {sql} as valor from r_messages")
    def run(spark, sf):
        return _messages(spark, sf).select("message_id", column().alias("valor"))


_text_query("is_stt_artifact", q.voice(), lambda: tx.is_voice_artifact(F.col("input")))
_text_query("is_symbols", q.symbols(q.low()), lambda: tx.is_symbols(tx.normal(F.col("input"))))
_text_query("has_substring", q.sub(q.low(), tx.TURNS.jokes), lambda: tx.has_substring(tx.normal(F.col("input")), tx.TURNS.jokes))
_text_query("has_word", q.word(q.low(), tx.ONLINE.finance), lambda: tx.has_word(tx.normal(F.col("input")), tx.ONLINE.finance))
_text_query("token_count", f"{q.tokens(q.low())}::int", lambda: tx.token_count(tx.normal(F.col("input"))))


@query("intent_label", duck("r_messages") + f" select message_id, {q.intent()} as intent from r_messages")
def intent_label(spark, sf):
    return _messages(spark, sf).select("message_id", tx.intent(F.col("input")).alias("intent"))


@query("noise_score", duck("r_messages") + f" select message_id, noise_type, noise_score from ({q.turn_noise('r_messages')})", raw=True)
def noise_score(spark, sf):
    return tx.with_turn_noise(_messages(spark, sf)).select("message_id", "noise_type", "noise_score")


@query("noise_label", duck("r_messages") + f" select message_id, {q.noise_label()} as label from r_messages")
def noise_label(spark, sf):
    return _messages(spark, sf).select("message_id", tx.noise_label(F.col("input")).alias("label"))


GATED = "message_id, gate, noise_type, noise_score, response_code"


@query("gate_heuristic", duck("r_messages") + f" select {GATED} from ({q.gate('r_messages')})", raw=True)
def gate_heuristic(spark, sf):
    return tx.with_gate(_messages(spark, sf)).select(*GATED.split(", "))


@query(
    "gate_route",
    duck("r_messages") + f" select {GATED}, gate and response_code is not null as short_circuit from ({q.gate('r_messages')})",
    raw=True,
)
def gate_route(spark, sf):
    return tx.with_route(tx.with_gate(_messages(spark, sf))).select(*GATED.split(", "), "short_circuit")


def _on_real_texts(where: str, view: str) -> None:
    """All text rules over the whole texts of a table."""

    @query(
        f"text_flags_on_{where}",
        duck(view) + f""", l as (select *, {q.low()} as low_ from {view})
 select message_id, {q.voice()} as voz, {q.symbols('low_')} as simbolos, {q.sub('low_', tx.TURNS.jokes)} as broma, {q.word('low_', tx.ONLINE.finance)} as financiera,
  {q.tokens('low_')}::int as palabras, {q.among('low_', tx.TURNS.menu)} as menu, {q.among('low_', tx.TURNS.yes_no)} as si_no,
  {q.sub('lower(input)', fv.URGENCY)} as urgente, {q.sub('lower(input)', fv.FRUSTRATION)} as frustrado from l""",
    )
    def flags(spark, sf):
        text, low = F.col("input"), tx.normal(F.col("input"))
        return role(spark, sf, view).select(
            "message_id", tx.is_voice_artifact(text).alias("voz"), tx.is_symbols(low).alias("simbolos"),
            tx.has_substring(low, tx.TURNS.jokes).alias("broma"), tx.has_word(low, tx.ONLINE.finance).alias("financiera"),
            tx.token_count(low).alias("palabras"), low.isin(*tx.TURNS.menu).alias("menu"), low.isin(*tx.TURNS.yes_no).alias("si_no"),
            tx.has_urgency(text).alias("urgente"), tx.has_frustration(text).alias("frustrado"),
        )

    @query(
        f"turn_labels_on_{where}",
        duck(view) + f" select message_id, {q.intent()} as intent, {q.noise_label()} as label, noise_type, noise_score from ({q.turn_noise(view)})",
        raw=True,
    )
    def labels(spark, sf):
        return tx.with_turn_labels(role(spark, sf, view)).select("message_id", "intent", "label", "noise_type", "noise_score")

    @query(
        f"gate_route_on_{where}",
        duck(view) + f" select {GATED}, gate and response_code is not null as short_circuit from ({q.gate(view)})",
        raw=True,
    )
    def route(spark, sf):
        return tx.with_route(tx.with_gate(role(spark, sf, view))).select(*GATED.split(", "), "short_circuit")


_on_real_texts("conversations", "r_conversation_texts")
_on_real_texts("documents", "r_document_texts")


def _semantic(name: str, rules: tx.SemanticRules) -> None:
    scored = f" s as ({q.proto_scores('r_message_vectors', 'message_id, input')})"
    check = q.with_(q.PROTOS, scored, roles=["r_vectors", "r_message_vectors"])

    @query(name, check + q.semantic_gate(rules), raw=True)
    def run(spark, sf):
        model = vectors.PrototypeModel.fit(role(spark, sf, "r_vectors"), calibrate=False)
        scored = model.transform(role(spark, sf, "r_message_vectors"))
        return tx.with_semantic_gate(scored, F.col("score"), rules=rules).select(*GATED.split(", "))


_semantic("gate_semantic", tx.AGENT_RULES)
_semantic("gate_semantic_b", tx.SERVER_RULES)


@query(
    "dim_key",
    duck("r_propensity")
    + """, x as (select user_id, '  ' || segmento_nombre || ' larga (' || segmento_nombre || ') x' as t from r_propensity)
 select user_id, lower(split_part(trim(split_part(t, '(', 1)), ' ', 1)) as clave, lower(trim(split_part(t, '(', 1))) as clave_completa from x""",
)
def dim_key(spark, sf):
    s = F.col("segmento_nombre")
    t = F.concat(F.lit("  "), s, F.lit(" larga ("), s, F.lit(") x"))
    return role(spark, sf, "r_propensity").select(
        "user_id", tx.dim_key(t).alias("clave"), tx.dim_key(t, first_word=False).alias("clave_completa")
    )
