"""Queries: per-user features, summaries, serving views, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text as tx
from ..functions import values as v
from ..operators import clean, features, master, profiles, sessions, vectors, views
from . import checks as q
from .registry import query
from .role_views import duck, role

TYPES = tuple(q.TYPES)


def transactions(spark, sf) -> DataFrame:
    return clean.clean_transactions(role(spark, sf, "r_transactions"))


def products(spark, sf) -> DataFrame:
    return clean.clean_products(role(spark, sf, "r_products"))


def labelled(spark, sf) -> DataFrame:
    return features.label_turns(clean.clean_turns(role(spark, sf, "r_messages")))


def master_table(spark, sf) -> DataFrame:
    return master.master(
        clean.clean_customers(role(spark, sf, "r_customers")),
        features.txn_features(transactions(spark, sf)),
        features.product_features(products(spark, sf), TYPES),
        features.conv_features(labelled(spark, sf)),
    )


# --- D features --------------------------------------------------------------------------------------


@query("txn_features", q.with_(q.TXN, roles=["r_transactions"]) + f"select user_id, {q.shown(q.TXN_COLS)} from txn_f")
def txn_features(spark, sf):
    return features.txn_features(transactions(spark, sf))


@query("product_features", q.with_(q.PROD, roles=["r_products"]) + f"select user_id, {q.shown(q.PROD_COLS)} from prod_f")
def product_features(spark, sf):
    return features.product_features(products(spark, sf), TYPES)


@query(
    "ownership_flags",
    q.with_(q.PROD, roles=["r_products"]) + f"select user_id, {', '.join(f'tiene_{t}' for t in TYPES)} from prod_f",
)
def ownership_flags(spark, sf):
    return features.ownership_flags(products(spark, sf), TYPES)


CONV_SHOWN = q.shown(q.CONV_COLS)


@query("conv_features", q.with_(q.CONV, roles=["r_messages"]) + f"select user_id, {CONV_SHOWN} from conv_f")
def conv_features(spark, sf):
    return features.conv_features(labelled(spark, sf))


@query(
    "turns_per_conv",
    duck("r_messages")
    + " select message_id, conv_id, case when conv_id is not null then count(input) over (partition by conv_id) end as turnos_conv from r_messages",
)
def turns_per_conv(spark, sf):
    return features.turns_per_conv(role(spark, sf, "r_messages").select("message_id", "conv_id", "input")).drop("input")


@query("retries_48h", q.with_(q.CONV, roles=["r_messages"]) + "select user_id, conv_reintentos_48h from conv_f")
def retries_48h(spark, sf):
    return features.timeline_features(labelled(spark, sf)).select("user_id", "conv_reintentos_48h")


@query(
    "noise_trend",
    q.with_(q.CONV, roles=["r_messages"]) + f"select user_id, {q.r('conv_noise_trend')} as conv_noise_trend from conv_f",
)
def noise_trend(spark, sf):
    return features.timeline_features(labelled(spark, sf)).select("user_id", "conv_noise_trend")


@query(
    "gap_hours",
    duck("r_turns")
    + f""", m as (select *, conv_id * 1000 + turn as message_id from r_turns)
 select message_id, user_id, {q.r('(epoch_us(date) - epoch_us(lag(date) over (partition by user_id order by date nulls last, message_id))) / 3.6e9')} as hrs_gap from m where user_id is not null""",
)
def gap_hours(spark, sf):
    turns = role(spark, sf, "r_turns").withColumn("message_id", F.col("conv_id") * 1000 + F.col("turn"))
    return features.with_gap_hours(turns).select("message_id", "user_id", "hrs_gap")


MASTER_CTE = f"""
 mst as (select cust.* replace (coalesce(ocupacion, '0') as ocupacion, coalesce(es_hey_pro, false) as es_hey_pro,
   coalesce(patron_uso_atipico, false) as patron_uso_atipico),
   {', '.join(f'coalesce({c}, 0) as {c}' for c in [*q.TXN_COLS, *q.PROD_COLS, *q.CONV_COLS])}
  from cust left join txn_f using (user_id) left join prod_f using (user_id) left join conv_f using (user_id))"""
MASTER = q.with_(
    q.CUST, q.TXN, q.PROD, q.CONV, MASTER_CTE, roles=["r_customers", "r_transactions", "r_products", "r_messages"]
)
CUSTOMER_COLS = (
    "user_id, genero, estado, ciudad, ocupacion, satisfaccion_1_10, es_hey_pro, patron_uso_atipico, edad, "
    "score_buro, antiguedad_dias, dias_desde_ultimo_login"
)


@query(
    "master",
    MASTER
    + f"select {CUSTOMER_COLS}, {q.r('ingreso_mensual_mxn')} as ingreso_mensual_mxn, {q.shown(q.TXN_COLS)}, {q.shown(q.PROD_COLS)}, {CONV_SHOWN} from mst",
)
def master_query(spark, sf):
    return master_table(spark, sf)


@query(
    "label_distribution",
    duck("r_messages")
    + f", l as (select {q.noise_label()} as label from r_messages) select label, count(*) as n, {q.r('count(*) / sum(count(*)) over ()')} as share from l group by label",
)
def label_distribution(spark, sf):
    return views.label_distribution(role(spark, sf, "r_messages").select(tx.noise_label(F.col("input")).alias("label")))


PROFILED = ["ingreso_mensual_mxn", "score_buro", "edad"]


@query(
    "segment_profile",
    duck("r_customers")
    + " select ocupacion as segmento_nombre, "
    + ", ".join(q.r(f"round(avg({c}), 2)") + f" as {c}" for c in PROFILED)
    + " from r_customers group by ocupacion",
)
def segment_profile(spark, sf):
    df = role(spark, sf, "r_customers").withColumnRenamed("ocupacion", "segmento_nombre")
    return views.segment_profile(df, PROFILED)


TONES = "case when id % 3 = 0 then null else concat('tono ', cast(id % 3 as varchar(2))) end as tono, concat('hora ', cast(id % 5 as varchar(2))) as horario"


def classified(spark, sf) -> DataFrame:
    """Active classifications with two dimensions; one segment name is missing."""
    return spark.sql(
        f"select id, user_id, case when segmento_nombre = '3-MEDIUM' then null else segmento_nombre end as segmento_nombre, noise_score_usuario, {TONES} from {{c}} where activo",
        c=role(spark, sf, "r_classifications"),
    )


CLASSIFIED = duck("r_classifications") + (
    f", c as (select id, user_id, case when segmento_nombre = '3-MEDIUM' then null else segmento_nombre end as segmento_nombre, noise_score_usuario, {TONES} from r_classifications where activo)"
)


@query(
    "segment_summary",
    CLASSIFIED
    + f""" select segmento_nombre as segmento, count(*) as n_usuarios, {q.r('round(count(*) / sum(count(*)) over (), 3)')} as pct,
 first(tono order by id) as tono, first(horario order by id) as horario, {q.r('coalesce(round(avg(noise_score_usuario), 3), 0)')} as noise_pct_medio
 from c group by 1""",
)
def segment_summary(spark, sf):
    return views.segment_summary(classified(spark, sf))


@query(
    "segment_summary_b",
    CLASSIFIED
    + f""", p as (select *, tono || ' l' as longitud, (id % 4 = 0)::int as flag_riesgo_churn from c),
 g as (select segmento_nombre as segmento, count(*) as n_usuarios, {q.r('round(count(*) / sum(count(*)) over (), 3)')} as pct,
  first(tono order by id) as tono, first(longitud order by id) as longitud, first(horario order by id) as horario,
  {q.r('round(avg(noise_score_usuario), 3)')} as noise_pct_medio, {q.r('round(avg(flag_riesgo_churn), 3)')} as flag_churn_pct from p group by 1)
 select * from g where segmento is not null""",
)
def segment_summary_b(spark, sf):
    rows = classified(spark, sf).withColumns(
        {
            "longitud": F.concat("tono", F.lit(" l")),
            "flag_riesgo_churn": (F.col("id") % 4 == 0).cast("int"),
        }
    )
    return views.segment_summary_b(rows, order="id")


SCORES = ["prop_a", "prop_b", "prop_c", "prop_d"]


@query(
    "propensity_by_segment",
    duck("r_propensity")
    + " "
    + " union all ".join(
        f"select segmento_nombre, '{c}' as producto, {q.r(f'avg({c})')} as score_medio from r_propensity group by 1" for c in SCORES
    ),
)
def propensity_by_segment(spark, sf):
    return views.propensity_by_segment(role(spark, sf, "r_propensity"), SCORES)


def top_listed(spark, sf) -> DataFrame:
    df = role(spark, sf, "r_propensity")
    for p in "abcd":
        df = df.withColumn(f"prop_{p}", profiles.mask_owned(F.col(f"prop_{p}"), F.col(f"tiene_{p}")))
    return profiles.with_top_products(df, {f"Producto {p.upper()}": f"prop_{p}" for p in "abcd"})


MASKED = ", ".join(f"case when tiene_{p} = 1 then 0.0 else prop_{p} end as prop_{p}" for p in "abcd")
TOP = f"""
 msk as (select user_id, segmento_nombre, {MASKED}, tiene_a, tiene_b, tiene_c, tiene_d from r_propensity),
 lng as (select user_id, unnest(['Producto A', 'Producto B', 'Producto C', 'Producto D']) as producto, unnest([prop_a, prop_b, prop_c, prop_d]) as s, unnest([0, 1, 2, 3]) as ord from msk),
 rnk as (select *, row_number() over (partition by user_id order by s desc, ord) as rn from lng),
 top as (select user_id, {', '.join(f"coalesce(max(producto) filter (where rn = {i} and s > 0.10::double), '') as producto_top_{i}" for i in (1, 2, 3))} from rnk group by user_id)"""


@query("top3_products", q.with_(TOP, roles=["r_propensity"]) + "select * from top")
def top3_products(spark, sf):
    return top_listed(spark, sf).select("user_id", "producto_top_1", "producto_top_2", "producto_top_3")


@query("mask_owned", duck("r_propensity") + f" select user_id, {MASKED} from r_propensity", raw=True)
def mask_owned(spark, sf):
    return top_listed(spark, sf).select("user_id", *SCORES)


@query(
    "top_product_freq",
    q.with_(TOP, roles=["r_propensity"])
    + f"select producto_top_1 as producto, count(*) as n, {q.r('count(*) / sum(count(*)) over ()')} as share from top where producto_top_1 <> '' group by 1",
)
def top_product_freq(spark, sf):
    return views.top_product_freq(top_listed(spark, sf))


FLAGS = """coalesce(dias_desde_ultimo_login > 30 and satisfaccion_1_10 < 6, false)::int as flag_riesgo_churn,
 coalesce(patron_uso_atipico, false)::int as flag_uso_atipico, coalesce(prod_util_max > 0.85::double, false)::int as flag_credito_estresado"""


def with_portfolio(spark, sf) -> DataFrame:
    portfolio = features.product_features(products(spark, sf), TYPES).select("user_id", "prod_util_max")
    return clean.clean_customers(role(spark, sf, "r_customers")).join(portfolio, "user_id", "left")


@query(
    "risk_flags",
    q.with_(q.CUST, q.PROD, roles=["r_customers", "r_products"])
    + f"select user_id, {FLAGS} from cust left join prod_f using (user_id)",
)
def risk_flags(spark, sf):
    flagged = profiles.risk_flags(with_portfolio(spark, sf))
    return flagged.select("user_id", "flag_riesgo_churn", "flag_uso_atipico", "flag_credito_estresado")


CONV_KEY = "left join conv_f using (user_id)"
DIMS = "select c_mktsegment as segmento_nombre, concat('tono ', lower(c_mktsegment)) as tono, 'texto' as canal, concat('hora ', left(c_mktsegment, 1)) as horario, concat('estilo ', c_mktsegment) as estilo, 'media (4)' as longitud, 'nunca' as emojis, 'formal' as urgencia, concat(c_mktsegment, ' > 1') as alerta_1, concat(c_mktsegment, ' < 9') as alerta_2 from {customer} where c_mktsegment <> 'MACHINERY' group by c_mktsegment"


def segment_table(spark, sf) -> DataFrame:
    """One row per segment of the data; one segment has no entry."""
    dims = spark.sql(DIMS, customer=spark.read.parquet(f"{sf}/customer.parquet"))
    return dims.withColumn("alertas", F.array("alerta_1", "alerta_2")).drop("alerta_1", "alerta_2")


DIMS_CTE = f" dims as ({DIMS.replace('{customer}', 'customer')})"
DIM_COLS = ", ".join(f"coalesce({c}, '') as {c}" for c in fv.SEGMENT_DIMENSIONS)
ALERT_COL = "coalesce(alerta_1 || ' | ' || alerta_2, '') as alertas_segmento"


@query(
    "segment_dims",
    q.with_(DIMS_CTE, roles=["r_propensity"])
    + f"select user_id, segmento_nombre, {DIM_COLS}, {ALERT_COL} from r_propensity left join dims using (segmento_nombre)",
)
def segment_dims(spark, sf):
    base = role(spark, sf, "r_propensity").select("user_id", "segmento_nombre")
    return profiles.segment_dims(base, segment_table(spark, sf))


@query(
    "channel_override",
    q.with_(q.CONV, DIMS_CTE, roles=["r_messages", "r_propensity"])
    + f"select user_id, case when conv_pct_voz > 0.3::double then 'voz' else coalesce(canal, '') end as canal from r_propensity left join dims using (segmento_nombre) {CONV_KEY}",
)
def channel_override(spark, sf):
    base = role(spark, sf, "r_propensity").select("user_id", "segmento_nombre")
    voice = features.conv_features(labelled(spark, sf)).select("user_id", "conv_pct_voz")
    df = profiles.segment_dims(base, segment_table(spark, sf)).join(voice, "user_id", "left")
    return df.select("user_id", profiles.channel_override(F.col("canal"), F.col("conv_pct_voz")).alias("canal"))


CONTEXT = [
    "ingreso_mensual_mxn", "score_buro", "antiguedad_dias", "ocupacion", "satisfaccion_1_10",
    "dias_desde_ultimo_login", "es_hey_pro", "conv_n_total", "conv_frustracion", "conv_urgencia", "intent_credito",
    "intent_inversion",
]
CONTEXT_SQL = ", ".join(f"{q.r(c)} as {c}" if c == "ingreso_mensual_mxn" else c for c in CONTEXT)


@query(
    "profile_columns",
    MASTER
    + f"select user_id, {q.r('round(conv_noise_pct, 4)')} as noise_score_usuario, {CONTEXT_SQL}, (dense_rank() over (order by ocupacion) - 1)::int as ocupacion_code from mst",
)
def profile_columns(spark, sf):
    return profiles.profile_columns(master.encode_categories(master_table(spark, sf), ["ocupacion"]))


GIVEN = "abcd"


def full_profiles(spark, sf) -> DataFrame:
    """Profiles from the master table with given segments and scores."""
    given = role(spark, sf, "r_propensity")
    ids = F.when(F.col("segmento_nombre").isNotNull(), F.length("segmento_nombre")).alias("segmento_id")
    scored = master_table(spark, sf).join(given.select("*", ids), "user_id")
    return profiles.profiles(scored, segment_table(spark, sf), list(GIVEN))


TOP_NAMES = ", ".join(f"lower(right(producto_top_{i}, 1)) as producto_top_{i}" for i in (1, 2, 3))
PROFILES_CTE = f"""
 prf as (select user_id, length(segmento_nombre) as segmento_id, segmento_nombre, {DIM_COLS.replace("coalesce(canal, '') as canal", "case when conv_pct_voz > 0.3::double then 'voz' else coalesce(canal, '') end as canal")},
  {ALERT_COL}, {', '.join(f'{q.r(f"msk.{c}")} as {c}' for c in SCORES)}, {TOP_NAMES}, {FLAGS}, {q.r('round(conv_noise_pct, 4)')} as noise_score_usuario, {CONTEXT_SQL}
  from mst join msk using (user_id) join top using (user_id) left join dims using (segmento_nombre))"""
PROFILES = q.with_(
    q.CUST, q.TXN, q.PROD, q.CONV, MASTER_CTE, TOP, DIMS_CTE, PROFILES_CTE,
    roles=["r_customers", "r_transactions", "r_products", "r_messages", "r_propensity"],
)


@query("profiles", PROFILES + "select * from prf")
def profiles_query(spark, sf):
    return full_profiles(spark, sf)


@query(
    "profile_run_summary",
    PROFILES
    + "select count(*) as n_total, "
    + ", ".join(
        f"count(*) filter (where {c}) as n_{k}, {q.r(f'avg(case when {c} then 1.0 else 0.0 end)')} as pct_{k}"
        for k, c in {
            "con_recomendacion": "producto_top_1 <> ''",
            "churn": "flag_riesgo_churn = 1",
            "estresado": "flag_credito_estresado = 1",
            "ruido": "noise_score_usuario > 0.4::double",
        }.items()
    )
    + " from prf",
)
def profile_run_summary(spark, sf):
    return views.profile_run_summary(full_profiles(spark, sf))


@query(
    "health_counts",
    CLASSIFIED
    + ", u as (select count(*) as n from r_users) select (select n from u) as n_usuarios, count(distinct coalesce(segmento_nombre, '-')) as n_segmentos, count(distinct segmento_nombre) as n_segmentos_con_nombre from c".replace(
        "r_users", "customer where c_custkey % 31 <> 0"
    ),
)
def health_counts(spark, sf):
    return views.health_counts(role(spark, sf, "r_users"), classified(spark, sf).withColumn("activo", F.lit(True)))


INDEX_SQL = f"""
 good as (select * from r_turns where {q.noise_label()} = 'on_topic' and length(output) > 30 and length(input) > 5 and conv_id is not null),
 idx as (select conv_id, first(input order by date nulls last, turn) as input, first(output order by date nulls last, turn) as output from good group by conv_id)"""


@query(
    "index_stats",
    q.with_(INDEX_SQL, roles=["r_turns"])
    + f"""select (select count(*) from r_turns) as n_turnos, (select count(distinct conv_id) from r_turns) as n_convs, count(*) as n_docs,
 {q.r('avg(length(input))')} as len_input, {q.r('avg(length(output))')} as len_output from idx""",
)
def index_stats(spark, sf):
    turns = role(spark, sf, "r_turns")
    return views.index_stats(turns, vectors.dense_index(turns))


# --- E, F views ----------------------------------------------------------------------------------------

JSON = "ocupacion string, score_buro bigint"


@query(
    "current_profile",
    duck("r_users", "r_classifications")
    + f""", lst as (select * from r_classifications where activo qualify row_number() over (partition by user_id order by created_at desc, id desc) = 1)
 select u.user_id, u.datos_demograficos->>'ocupacion' as ocupacion, (u.datos_demograficos->>'score_buro')::bigint as score_buro,
  l.id, epoch_us(l.created_at) as created_at, l.activo, l.segmento_nombre, {q.r('l.noise_score_usuario')} as noise_score_usuario from r_users u left join lst l using (user_id)""",
)
def current_profile(spark, sf):
    return views.current_profile(role(spark, sf, "r_users"), role(spark, sf, "r_classifications"), JSON)


@query(
    "turns_with_profile",
    duck("r_turns", "r_propensity")
    + " select conv_id, turn, t.user_id, segmento_nombre, prop_a from r_turns t left join r_propensity p using (user_id)",
    raw=True,
)
def turns_with_profile(spark, sf):
    turns = role(spark, sf, "r_turns").select("conv_id", "turn", "user_id")
    return sessions.turns_with_profile(turns, role(spark, sf, "r_propensity").select("user_id", "segmento_nombre", "prop_a"))


@query("first_turn_per_conv", duck("r_turns") + " select conv_id, first(input order by date nulls last, turn) filter (where input is not null) as input, first(output order by date nulls last, turn) filter (where output is not null) as output, first(user_id order by date nulls last, turn) filter (where user_id is not null) as user_id from r_turns where conv_id is not null group by conv_id")
def first_turn_per_conv(spark, sf):
    return vectors.first_turns(role(spark, sf, "r_turns"), ["input", "output", "user_id"])


ORDER = ["1-URGENT", "2-HIGH", "4-NOT SPECIFIED"]


@query(
    "users_per_segment",
    CLASSIFIED
    + """ select id, user_id, segmento_nombre, tono, case segmento_nombre when '1-URGENT' then 0 when '2-HIGH' then 1 when '4-NOT SPECIFIED' then 2 else 99 end as orden
 from c qualify row_number() over (partition by segmento_nombre order by user_id, id) <= 2""",
)
def users_per_segment(spark, sf):
    picked = views.users_per_segment(classified(spark, sf), ORDER)
    return picked.select("id", "user_id", "segmento_nombre", "tono", "orden")


@query(
    "latest_classification",
    duck("r_classifications")
    + f" select * replace (epoch_us(created_at) as created_at, {q.r('noise_score_usuario')} as noise_score_usuario) from r_classifications where activo qualify row_number() over (partition by user_id order by created_at desc, id desc) = 1",
)
def latest_classification(spark, sf):
    return views.latest_classification(role(spark, sf, "r_classifications"))


@query(
    "latest_metrics",
    """with l as (select * from orders order by o_orderdate desc, o_orderkey desc limit 1)
 select o_orderkey as run_id, epoch_us(o_orderdate) as ejecutado_at, o_orderpriority as producto, 'tiene_a' as col_target, (o_orderkey % 9 + 1) / 10 as test_auc from l
 union all select o_orderkey, epoch_us(o_orderdate), o_orderstatus, 'tiene_b', 0.5 from l""",
)
def latest_metrics(spark, sf):
    return views.latest_metrics(role(spark, sf, "r_runs"))


@query(
    "error_samples",
    duck("r_scored")
    + """, p as (select doc_id, quality, (score >= 0.5)::int as pred from r_scored where quality <> (score >= 0.5)::int)
 select doc_id, quality, pred, case when pred = 1 then 'falso_positivo' else 'falso_negativo' end as error, row_number() over (partition by pred order by doc_id)::int as pos from p qualify pos <= 5""",
)
def error_samples(spark, sf):
    df = role(spark, sf, "r_scored").select("doc_id", "quality", (F.col("score") >= 0.5).cast("int").alias("pred"))
    return views.error_samples(df, "quality", "pred", "doc_id")


# --- J sessions --------------------------------------------------------------------------------------

SESSIONS = """
 ses as (select *, sum(reset::int) over (partition by user_id order by date nulls last, message_id) as session_no from r_messages where user_id is not null),
 trn as (select *, row_number() over (partition by user_id, session_no order by date nulls last, message_id) as turno from ses)"""


@query("turn_number", q.with_(SESSIONS, roles=["r_messages"]) + "select message_id, user_id, session_no::bigint as session_no, turno from trn")
def turn_number(spark, sf):
    return sessions.turn_number(role(spark, sf, "r_messages")).select("message_id", "user_id", "session_no", "turno")


@query(
    "session_lifecycle",
    q.with_(SESSIONS, roles=["r_messages"])
    + """, s as (select user_id, session_no::bigint as session_no, min(date) as a, count(*) as turnos from ses group by all)
 select user_id, session_no, epoch_us(a) as abierta_at, epoch_us(lead(a) over w) as cerrada_at, lead(a) over w is null as activa, turnos from s window w as (partition by user_id order by session_no)""",
)
def session_lifecycle(spark, sf):
    return sessions.session_lifecycle(role(spark, sf, "r_messages"))


def replied(spark, sf) -> DataFrame:
    return role(spark, sf, "r_messages").withColumn("output", F.concat(F.lit("eco "), F.coalesce("input", F.lit(""))))


@query(
    "session_history",
    q.with_(SESSIONS, roles=["r_messages"])
    + """select user_id, session_no::bigint as session_no, (turno - 1) // 200 as pagina, count(*) * 2 as n_mensajes,
 string_agg('user:' || coalesce(input, '-') || '|assistant:eco ' || coalesce(input, ''), '|' order by turno) as historial from trn group by all""",
)
def session_history(spark, sf):
    pages = sessions.session_history(replied(spark, sf))
    line = F.transform(
        "historial", lambda m: F.concat(m["role"], F.lit(":"), F.coalesce(m["content"], F.lit("-")))
    )
    return pages.select(
        "user_id", "session_no", "pagina", F.size("historial").cast("bigint").alias("n_mensajes"),
        F.array_join(line, "|").alias("historial"),
    )


# --- K texts -------------------------------------------------------------------------------------------

LENGTHS = {"corta": "dos frases", "media": "cuatro frases", "larga": "sin limite"}
EMOJIS = {"nunca": "sin emojis", "ocasional": "un emoji", "frecuente": "con emojis"}
URGENCY = {"inmediata": "resolver ya", "empática": "validar", "formal": "con datos"}


@query(
    "active_alerts",
    q.with_(q.CUST, q.PROD, q.CONV, roles=["r_customers", "r_products", "r_messages"])
    + f""", f as (select user_id, conv_noise_pct, conv_frustracion, {FLAGS} from cust left join prod_f using (user_id) left join conv_f using (user_id)),
 a as (select user_id, list_filter([case when coalesce(conv_noise_pct, 0) >= 0.4::double then 'noise' end, case when flag_credito_estresado = 1 then 'estresado' end,
  case when flag_riesgo_churn = 1 then 'churn' end, case when flag_uso_atipico = 1 then 'atipico' end, case when coalesce(conv_frustracion, 0) >= 2 then 'frustracion' end], lambda x: x is not null) as l from f)
 select user_id, case when len(l) = 0 then 'ok' else array_to_string(l, ',') end as alertas from a""",
)
def active_alerts(spark, sf):
    conv = features.conv_features(labelled(spark, sf)).select("user_id", "conv_noise_pct", "conv_frustracion")
    df = profiles.risk_flags(with_portfolio(spark, sf)).join(conv, "user_id", "left")
    codes = views.active_alerts(
        F.col("conv_noise_pct"), F.col("flag_credito_estresado"), F.col("flag_riesgo_churn"),
        F.col("flag_uso_atipico"), F.col("conv_frustracion"),
    )
    return df.select("user_id", F.array_join(codes, ",").alias("alertas"))


STYLE = "case c_custkey % 4 when 0 then 'Corta (2 frases)' when 1 then 'media' when 2 then ' LARGA y mas' else null end as longitud, case c_custkey % 5 when 0 then 'Nunca' when 1 then 'frecuente (2)' else 'otro' end as emojis, case c_custkey % 3 when 0 then 'Inmediata (1)' when 1 then 'formal seria' else 'Formal' end as urgencia"


INSTRUCTIONS = f"""select user_id, case lower(split_part(trim(split_part(longitud, '(', 1)), ' ', 1)) when 'corta' then 'dos frases' when 'larga' then 'sin limite' else 'cuatro frases' end as largo,
  case lower(split_part(trim(split_part(emojis, '(', 1)), ' ', 1)) when 'nunca' then 'sin emojis' when 'frecuente' then 'con emojis' else 'un emoji' end as emoji,
  case lower(trim(split_part(urgencia, '(', 1))) when 'inmediata' then 'resolver ya' when 'formal' then 'con datos' else 'validar' end as urgente from sty"""
STYLES = f"sty as (select c_custkey as user_id, {STYLE} from customer)"


@query("instruction_lookup", f"with {STYLES} {INSTRUCTIONS}")
def instruction_lookup(spark, sf):
    return instructions(spark, sf)


def instructions(spark, sf) -> DataFrame:
    df = spark.sql(f"select c_custkey as user_id, {STYLE} from {{c}}", c=spark.read.parquet(f"{sf}/customer.parquet"))
    return df.select(
        "user_id",
        views.instruction(F.col("longitud"), LENGTHS, "media").alias("largo"),
        views.instruction(F.col("emojis"), EMOJIS, "ocasional").alias("emoji"),
        views.instruction(F.col("urgencia"), URGENCY, "empática", first_word=False).alias("urgente"),
    )


RECOMMENDED = """case when len(l) = 0 then '  (sin recomendaciones activas)' else array_to_string([('  ' || i || '. ' || x) for x, i in l], chr(10)) end"""


@query(
    "recommendation_text",
    q.with_(TOP, roles=["r_propensity"])
    + f", r as (select user_id, list_filter([producto_top_1, producto_top_2, producto_top_3], lambda x: x <> '') as l from top) select user_id, {RECOMMENDED} as recomendados from r",
)
def recommendation_text(spark, sf):
    tops = [F.col(f"producto_top_{i}") for i in (1, 2, 3)]
    return top_listed(spark, sf).select("user_id", views.recommendation_text(tops).alias("recomendados"))


TEMPLATE = "Cliente {user_id} ({segmento_nombre}), ingreso {ingreso}, {anios} anios, tono {tono}\nAlertas: {alertas}\nProductos:\n{recomendados}"


@query(
    "agent_context",
    PROFILES
    + f""", x as (select *, list_filter([case when noise_score_usuario >= 0.4::double then 'noise' end, case when flag_credito_estresado = 1 then 'estresado' end,
  case when flag_riesgo_churn = 1 then 'churn' end, case when flag_uso_atipico = 1 then 'atipico' end, case when conv_frustracion >= 2 then 'frustracion' end], lambda x: x is not null) as al,
  list_filter([producto_top_1, producto_top_2, producto_top_3], lambda x: x <> '') as l from prf)
 select user_id, 'Cliente ' || user_id || ' (' || segmento_nombre || '), ingreso $' || format('{{:,}}', round(ingreso_mensual_mxn)::bigint) || ', ' || (antiguedad_dias // 365) || ' anios, tono ' || tono
  || chr(10) || 'Alertas: ' || case when len(al) = 0 then 'ok' else array_to_string(al, ',') end || chr(10) || 'Productos:' || chr(10) || {RECOMMENDED} as contexto from x""",
)
def agent_context(spark, sf):
    return views.agent_context(agent_users(spark, sf), TEMPLATE).select("user_id", "contexto")


def agent_users(spark, sf) -> DataFrame:
    """The profiles with the columns that the template names."""
    df = full_profiles(spark, sf)
    codes = views.active_alerts(
        F.col("noise_score_usuario"), F.col("flag_credito_estresado"), F.col("flag_riesgo_churn"),
        F.col("flag_uso_atipico"), F.col("conv_frustracion"),
    )
    tops = [F.col(f"producto_top_{i}") for i in (1, 2, 3)]
    return df.withColumns(
        {
            "ingreso": v.currency(F.col("ingreso_mensual_mxn")),
            "anios": views.tenure_years(F.col("antiguedad_dias")),
            "alertas": F.array_join(codes, ","),
            "recomendados": views.recommendation_text(tops),
        }
    )
