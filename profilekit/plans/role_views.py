"""Test bindings: each input role expressed over the given tables.

One SQL text per role, equal in Spark and DuckDB but for the day name. In Spark the views read DataFrames
(no names are registered); the SQL checks use the same texts as common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

MESSAGES = [
    "hola",
    "¿Cuánto debo de mi tarjeta?",
    "ok",
    "B",
    "!!! ???",
    "dime un chiste",
    "hey, te amo",
    "quiero invertir mi ahorro a plazo",
    "necesito  saber  saldo actual",
    "urge: bloquear mi tarjeta por robo",
    "me sale error, no funciona el token",
    "mi opinión del servicio",
    "es posible pagar mañana",
    "",
    "   ",
    None,
    "ü",
    "ñandú azul",
    "  sí  ",
    "crédito",
    "precrédito no",
    "spei.",
    "gat_1",
    "😄😄",
]


def _values(rows) -> str:
    return ", ".join(f"({i}, {'null' if m is None else chr(39) + m + chr(39)})" for i, m in enumerate(rows))


VIEWS = {
    "r_customers": """
select c.c_custkey as user_id, case when c.c_custkey % 2 = 0 then 'F' else 'M' end as sexo,
 case when c.c_custkey % 11 = 0 then null else n.n_name end as estado,
 case when c.c_custkey % 13 = 0 then null else r.r_name end as ciudad,
 case when c.c_custkey % 17 = 0 then null else c.c_mktsegment end as ocupacion,
 case when c.c_custkey % 7 = 0 then null else cast(c.c_custkey % 10 + 1 as double) end as satisfaccion_1_10,
 case when c.c_custkey % 19 = 0 then 'x' when c.c_custkey % 3 = 0 then 'True' else 'False' end as es_hey_pro,
 case when c.c_custkey % 23 = 0 then 'True' else 'False' end as patron_uso_atipico,
 18 + c.c_custkey % 60 as edad, (c.c_acctbal + 1000) * 8 as ingreso_mensual_mxn,
 300 + (c.c_custkey * 37) % 551 as score_buro, (c.c_custkey * 53) % 3650 as antiguedad_dias,
 (c.c_custkey * 13) % 60 as dias_desde_ultimo_login
from {customer} c join {nation} n on c.c_nationkey = n.n_nationkey join {region} r on n.n_regionkey = r.r_regionkey
""",
    "r_products": """
select o_orderkey as producto_id, o_custkey as user_id, concat('tipo_', cast(o_orderkey % 10 as varchar(2))) as tipo_producto,
 case o_orderstatus when 'F' then 'activo' when 'O' then 'cancelado' else 'revision_de_pagos' end as estatus,
 case when o_orderkey % 5 = 0 then null else o_totalprice / 400000 end as utilizacion_pct,
 o_totalprice as saldo_actual, case when o_orderkey % 3 = 0 then null else o_totalprice * 2 end as limite_credito,
 case when o_orderkey % 29 = 0 then 'bad' else cast(cast(o_orderdate as date) as varchar(10)) end as fecha_apertura
from {orders}
""",
    "r_transactions": """
select event_id - case when event_id % 50 = 1 then 1 else 0 end as transaccion_id, ts as fecha_hora, user_id, value as monto,
 case event_type when 'click' then 'viajes' when 'error' then 'servicios_digitales' when 'purchase' then 'supermercado'
   when 'signup' then 'restaurante' else 'otro' end as categoria_mcc,
 case k % 6 when 0 then 'app_ios' when 1 then 'app_android' when 2 then 'oxxo' when 3 then 'cajero_externo' when 4 then 'web' else null end as canal,
 k < 10 as es_internacional, k >= 95 as patron_uso_atipico,
 case when event_type = 'error' then 'no_procesada' else 'procesada' end as estatus,
 k % 4 as intento_numero, case when k % 5 = 0 then k else null end as meses_diferidos,
 value / 128 as cashback_generado, cast(hour(ts) as int) as hora_del_dia, DAYNAME as dia_semana
from (select *, cast(regexp_extract(props, '[0-9]+', 0) as int) as k from {events}) e
""",
    "r_messages": f"""
select e.event_id as message_id, e.user_id * 40 + k % 5 as conv_id, e.user_id, e.ts as date, m.msg as input,
 case when k % 9 = 0 then 2 else 1 end as channel_source, k = 0 as reset
from (select *, cast(regexp_extract(props, '[0-9]+', 0) as int) as k from {{events}}) e
join (select * from (values {_values(MESSAGES)}) as v(i, msg)) m on e.event_id % {len(MESSAGES)} = m.i
""",
    "r_conversation_texts": """
select conv_id * 100000 + turn as message_id, text as input from {conversations}
""",
    "r_document_texts": """
select doc_id as message_id, text as input from {documents}
""",
    "r_turns": """
select conv_id, turn, conv_id % 30 as user_id, e.ts as date, input, output from (
 select conv_id, turn, role, text as input, lead(text) over w as output
 from {conversations} window w as (partition by conv_id order by turn)) t
left join {events} e on e.event_id = t.conv_id * 8 + t.turn where role = 'user'
""",
    "r_vectors": """
select vec_id as doc_id, embedding, label, case when label < 5 then 'noise' else 'on_topic' end as clase,
 concat('answer ', cast(vec_id % 40 as varchar(3))) as output from {embeddings}
""",
    "r_message_vectors": f"""
select e.event_id as message_id, m.msg as input, v.embedding
from (select event_id, event_id % (select count(*) from {{embeddings}}) as vector_of from {{events}}) e
join (select * from (values {_values(MESSAGES)}) as t(i, msg)) m on e.event_id % {len(MESSAGES)} = m.i
join {{embeddings}} v on e.vector_of = v.vec_id
""",
    "r_classifications": """
select o_orderkey as id, o_custkey as user_id, o_orderdate as created_at, o_orderstatus <> 'O' as activo,
 o_orderpriority as segmento_nombre, o_totalprice / 524288 as noise_score_usuario from {orders}
""",
    "r_users": """
select c_custkey as user_id, concat('{"ocupacion":"', c_mktsegment, '","score_buro":', cast(300 + (c_custkey * 37) % 551 as varchar(4)), '}') as datos_demograficos
from {customer} where c_custkey % 31 <> 0
""",
    "r_propensity": """
select c_custkey as user_id, c_mktsegment as segmento_nombre,
 cast((c_custkey * 7) % 64 as double) / 64 as prop_a, cast((c_custkey * 11) % 64 as double) / 64 as prop_b,
 cast((c_custkey * 7) % 32 as double) / 32 as prop_c, cast(c_custkey % 8 as double) / 64 as prop_d,
 cast(c_custkey % 3 = 0 as int) as tiene_a, cast(c_custkey % 4 = 0 as int) as tiene_b,
 cast(c_custkey % 5 = 0 as int) as tiene_c, cast(c_custkey % 2 = 0 as int) as tiene_d
from {customer}
""",
    "r_scored": """
select l.doc_id, l.quality, l.toxic, d.n_chars, cast(d.n_chars % 1000 as double) / 1000 as score
from {labels} l join {documents} d on l.doc_id = d.doc_id
""",
    "r_runs": """
select o_orderkey as run_id, o_orderdate as ejecutado_at,
 concat('[{"producto":"', o_orderpriority, '","col_target":"tiene_a","test_auc":0.', cast(o_orderkey % 9 + 1 as varchar(1)),
  '},{"producto":"', o_orderstatus, '","col_target":"tiene_b","test_auc":0.5}]') as metricas
from {orders}
""",
}

SPARK_DAY = "date_format(ts, 'EEEE')"
DUCK_DAY = "dayname(ts)"
_TABLE_NAME = re.compile(r"\{(" + "|".join(TABLES) + r")\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def role(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    """The role view as a DataFrame; ``given`` replaces tables (a stream, for instance)."""
    text = VIEWS[name].replace("DAYNAME", SPARK_DAY)
    used = sorted(set(_TABLE_NAME.findall(text)))
    frames = {t: given.get(t) if t in given else table(spark, sf_dir, t) for t in used}
    # literal braces of JSON texts must survive the formatter
    text = _TABLE_NAME.sub(r"<<\1>>", text).replace("{", "{{").replace("}", "}}")
    text = re.sub(r"<<(\w+)>>", r"{\1}", text)
    return spark.sql(text, **frames)


def duck(*names: str) -> str:
    """``with`` clause that defines the role views for DuckDB."""
    parts = []
    for name in names:
        text = _TABLE_NAME.sub(r"\1", VIEWS[name].replace("DAYNAME", DUCK_DAY))
        parts.append(f"{name} as ({text.strip()})")
    return "with " + ",\n".join(parts)
