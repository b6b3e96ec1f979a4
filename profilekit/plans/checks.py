"""SQL fragments shared by the checks; written for DuckDB."""

from __future__ import annotations

from ..functions import fixed_values as fv
from ..functions import text as tx
from .registry import DIGITS, NUDGE
from .role_views import duck


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def r(x: str) -> str:
    return f"round(({x})::double + {NUDGE}, {DIGITS})"


def low(col: str = "input") -> str:
    return f"regexp_replace(lower({col}), {lit(f'^{tx.SPACE}+|{tx.SPACE}+$')}, '', 'g')"


def sub(col: str, words) -> str:
    return "(" + " or ".join(f"contains({col}, {lit(w)})" for w in words) + ")"


def word(col: str, words) -> str:
    return f"regexp_matches({col}, {lit(tx.whole_word_pattern(words))})"


def symbols(col: str) -> str:
    return f"(length({col}) > 0 and not regexp_matches({col}, {lit(tx.READABLE)}))"


def voice(col: str = "input") -> str:
    runs = f"{tx.SPACE}{{2,}}".join([tx.WORD + "{3,}"] * 3)
    return f"regexp_matches({col}, {lit(runs)})"


def tokens(col: str) -> str:
    return f"len(regexp_extract_all({col}, {lit(tx.WORD + '+')}))"


def among(col: str, words) -> str:
    return f"{col} in ({', '.join(lit(w) for w in words)})"


def intent(col: str = "input") -> str:
    whens = " ".join(f"when {sub(f'lower({col})', ws)} then {lit(n)}" for n, ws in fv.INTENTS.items())
    return f"case when {col} is null then 'otro' {whens} else 'otro' end"


def noise_label(col: str = "input") -> str:
    l, x = low(col), tx.LABELS
    dull = f"({among(l, x.menu)} or {among(l, x.yes_no)} or {tokens(l)} <= 2)"
    return (
        f"case when {col} is null then 'noise' when {voice(col)} then 'on_topic' when {symbols(l)} then 'noise' "
        f"when {sub(l, x.jokes)} then 'noise' when {dull} and not {word(l, x.finance)} then 'noise' else 'on_topic' end"
    )


def turn_noise(source: str, col: str = "input") -> str:
    """``source`` rows with noise_type and noise_score."""
    x = tx.TURNS
    weights = " ".join(f"when {lit(n)} then {w}::double" for n, w in fv.TURN_WEIGHTS.items())
    return f"""
select * exclude (l_, fin_, w_), case when noise_type = 'nulo' then 1.0::double when fin_ and w_ > 0 then round(w_ * 0.45::double, 4) else w_ end as noise_score
from (select *, case noise_type {weights} else 1.0::double end as w_ from (
 select *, case when {col} is null then 'nulo' when {symbols('l_')} then 'solo_simbolos' when {sub('l_', x.jokes)} then 'broma_offtopic'
  when {voice(col)} then 'artefacto_voz' when {among('l_', x.menu)} then 'menu_navegacion'
  when {among('l_', x.yes_no)} then 'afirmacion_negacion' when {tokens('l_')} <= 2 and not fin_ then 'exploracion_corta' else 'on_topic' end as noise_type
 from (select *, {word('l_', x.finance)} as fin_ from (select *, {low(col)} as l_ from {source}))))"""


def gate(source: str, col: str = "input") -> str:
    """``source`` rows with gate, noise_type, noise_score, response_code."""
    x = tx.ONLINE
    weights = " ".join(f"when {lit(n)} then {w}::double" for n, w in fv.GATE_WEIGHTS.items())
    return f"""
select *, case when gate then case noise_type when 'vacio' then 'exploracion' when 'broma' then 'broma'
  when 'simbolos' then 'simbolos' when 'exploracion' then 'exploracion' end end as response_code
from (select *, noise_score >= 0.55 as gate from (
select * exclude (l_, fin_, w_), case when noise_type = 'vacio' then 1.0::double when fin_ and w_ > 0 then round(w_ * 0.45::double, 4) else w_ end as noise_score
from (select *, case noise_type {weights} else 1.0::double end as w_ from (
 select *, case when l_ = '' then 'vacio' when {symbols('l_')} then 'simbolos' when {sub('l_', x.jokes)} then 'broma'
  when {among('l_', x.menu)} then 'menu' when {among('l_', x.yes_no)} then 'afirm'
  when {tokens('l_')} <= 2 and not fin_ then 'exploracion' else 'on_topic' end as noise_type
 from (select *, {word('l_', x.finance)} as fin_ from (select *, {low(f"coalesce({col}, '')")} as l_ from {source}))))))"""


PROTOS = """
 parts as (select clase as label, i, avg(x::double) as m, count(*) as n
  from (select clase, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from r_vectors) group by all),
 norms as (select label, sqrt(sum(m * m)) + 1e-9 as nn from parts group by label),
 protos as (select label, list(m / nn order by i) as proto, max(n) as n from parts join norms using (label) group by label)"""


def proto_scores(vectors: str, carry: str) -> str:
    return f"""
 select {carry}, sn as sim_noise, so as sim_on_topic, sn / (sn + so + 1e-9) as score from (
  select v.*, list_inner_product(embedding::double[], (select proto from protos where label = 'noise')) as sn,
   list_inner_product(embedding::double[], (select proto from protos where label = 'on_topic')) as so from {vectors} v)"""


def semantic_gate(rules: tx.SemanticRules) -> str:
    """Rows of ``s`` (message_id, input, score) through the gate."""
    x = rules.lexicon
    sym = symbols("l_") if rules.symbols_allow_blank else f"regexp_matches(l_, {lit(tx.SYMBOLS_NO_BLANK)})"
    blank = f"when l_ = '' then {lit(rules.blank)}" if rules.blank else ""
    blank_score = f"when fixed_ = {lit(rules.blank)} then {rules.blank_score}" if rules.blank else ""
    reply = "noise_type"
    if rules.single_reply:
        reply = (
            f"case when fixed_ in ({lit(rules.symbols)}, {lit(rules.joke)}) then fixed_ else {lit(rules.single_reply)} end"
        )
    return f"""
select message_id, gate, noise_type, noise_score, case when gate then {reply} end as response_code from (
 select *, case when fixed_ is null then coalesce(score >= 0.55, false) else fixed_ not in ({lit(rules.yes_no)}, {lit(rules.menu)}) end as gate,
  coalesce(fixed_, case when not coalesce(score >= 0.55, false) then 'on_topic' when {tokens('l_')} <= 3 then {lit(rules.short)} else {lit(rules.similar)} end) as noise_type,
  case when fixed_ is null then round(score, 4) {blank_score} when fixed_ = {lit(rules.symbols)} then {rules.symbols_score} when fixed_ = {lit(rules.joke)} then {rules.joke_score} else {rules.pass_score} end::double as noise_score
 from (select *, case {blank} when {sym} then {lit(rules.symbols)} when {sub('l_', x.jokes)} then {lit(rules.joke)}
   when {among('l_', x.yes_no)} then {lit(rules.yes_no)} when {among('l_', x.menu)} then {lit(rules.menu)} end as fixed_
  from (select *, {low("coalesce(input, '')")} as l_ from s)))"""


TXN = f"""
 tx as (select * exclude rn from (select *, row_number() over (partition by transaccion_id order by fecha_hora nulls last, user_id, monto) as rn from r_transactions) where rn = 1),
 txn as (select user_id, count(transaccion_id) as txn_total, avg(monto) as txn_monto_prom, stddev_samp(monto) as txn_monto_std,
  coalesce(sum(monto), 0) as txn_monto_total, count(distinct categoria_mcc) as txn_n_categorias,
  count(distinct fecha_hora::date) as txn_n_dias_activo,
  avg(case when {among('canal', fv.DIGITAL_CHANNELS)} then 1.0 else 0.0 end) as txn_pct_digital,
  avg(case when {among('canal', fv.CASH_CHANNELS)} then 1.0 else 0.0 end) as txn_pct_efectivo,
  avg(es_internacional::int) as txn_pct_inter, count(*) filter (where es_internacional) as txn_n_inter,
  avg(patron_uso_atipico::int) as txn_pct_atipico, avg(case when estatus = 'no_procesada' then 1.0 else 0.0 end) as txn_pct_fallida,
  count(*) filter (where intento_numero > 1) as txn_n_intentos_ext,
  count(*) filter (where categoria_mcc = 'viajes') as txn_n_viajes,
  count(*) filter (where categoria_mcc = 'servicios_digitales') as txn_n_servicios_dig,
  count(*) filter (where categoria_mcc = 'supermercado') as txn_n_supermercado,
  count(*) filter (where categoria_mcc = 'restaurante') as txn_n_restaurante,
  count(meses_diferidos) as txn_n_msi, coalesce(sum(cashback_generado), 0) as txn_cashback_total,
  avg(hora_del_dia) as txn_hora_media,
  avg(case when dia_semana in ('Saturday', 'Sunday') then 1.0 else 0.0 end) as txn_pct_finde,
  avg(case when hora_del_dia >= 22 or hora_del_dia <= 5 then 1.0 else 0.0 end) as txn_pct_nocturno
  from tx where user_id is not null group by user_id),
 txn_f as (select *, txn_monto_std / nullif(txn_monto_prom + 1, 0) as txn_volatilidad, txn_total / (txn_n_dias_activo + 1) as txn_frec_por_dia from txn)"""

TYPES = [f"tipo_{i}" for i in range(10)]
OWNED = ", ".join(
    f"max(case when estatus = 'activo' and tipo_producto = '{t}' then 1 else 0 end) as tiene_{t}" for t in TYPES
)
PROD = f"""
 pr as (select * replace (case when utilizacion_pct between 0 and 1 then utilizacion_pct end as utilizacion_pct) from r_products),
 prod as (select user_id, count(producto_id) as prod_n_total, count(*) filter (where estatus = 'activo') as prod_n_activos,
  count(*) filter (where estatus = 'cancelado') as prod_n_cancelados, count(*) filter (where estatus = 'revision_de_pagos') as prod_n_revision,
  coalesce(avg(utilizacion_pct), 0) as prod_util_media, coalesce(max(utilizacion_pct), 0) as prod_util_max,
  coalesce(sum(saldo_actual), 0) as prod_saldo_total, coalesce(sum(limite_credito), 0) as prod_limite_total, {OWNED}
  from pr where user_id is not null group by user_id),
 prod_f as (select *, (prod_n_cancelados + prod_n_revision) / (prod_n_total + 1) as prod_ratio_problematicos from prod)"""

COUNTED = ("credito", "inversion", "tarjeta", "aclaracion", "seguridad", "negocio")
CONV = f"""
 cv0 as (select *, (coalesce(channel_source = 2, false))::int as es_voz, length(input) as input_len, {intent()} as intent,
   {sub('lower(input)', fv.URGENCY)} as urgente, {sub('lower(input)', fv.FRUSTRATION)} as frustrado
  from r_messages where input is not null),
 cv as ({turn_noise('cv0')}),
 cvt as (select *, case when conv_id is not null then count(input) over (partition by conv_id) end as turnos_conv,
   row_number() over w as rn, count(*) over (partition by user_id) as n,
   (epoch_us(date) - epoch_us(lag(date) over w)) / 3.6e9 as gap
  from cv window w as (partition by user_id order by date nulls last, message_id)),
 conv_f as (select user_id, count(distinct conv_id) as conv_n_total, avg(turnos_conv) as conv_turnos_prom, max(turnos_conv) as conv_turnos_max,
  avg(es_voz) as conv_pct_voz, avg(input_len) as conv_input_len_med, count(*) filter (where urgente) as conv_urgencia,
  count(*) filter (where frustrado) as conv_frustracion, avg(case when noise_score > 0.35 then 1.0 else 0.0 end) as conv_noise_pct,
  avg(noise_score) as conv_noise_score, max(noise_score) as conv_noise_max,
  {', '.join(f"count(*) filter (where intent = '{i}') as intent_{i}" for i in COUNTED)},
  count(*) filter (where gap < 48) as conv_reintentos_48h,
  case when max(n) < 4 then 0.0 else round(avg(noise_score) filter (where rn > n // 2) - avg(noise_score) filter (where rn <= n // 2), 4) end as conv_noise_trend
  from cvt where user_id is not null group by user_id)"""

CUST = """
 med as (select ocupacion, median(satisfaccion_1_10) as m from r_customers where ocupacion is not null group by ocupacion),
 cust as (select user_id, sexo as genero, coalesce(estado, 'Desconocido') as estado, coalesce(ciudad, 'Desconocido') as ciudad, ocupacion,
   coalesce(satisfaccion_1_10, m, 7.5) as satisfaccion_1_10,
   case es_hey_pro when 'True' then true when 'False' then false end as es_hey_pro,
   case patron_uso_atipico when 'True' then true when 'False' then false end as patron_uso_atipico,
   edad, ingreso_mensual_mxn, score_buro, antiguedad_dias, dias_desde_ultimo_login
  from r_customers left join med using (ocupacion))"""

TXN_COLS = [
    "txn_total", "txn_monto_prom", "txn_monto_std", "txn_monto_total", "txn_n_categorias", "txn_n_dias_activo",
    "txn_pct_digital", "txn_pct_efectivo", "txn_pct_inter", "txn_n_inter", "txn_pct_atipico", "txn_pct_fallida",
    "txn_n_intentos_ext", "txn_n_viajes", "txn_n_servicios_dig", "txn_n_supermercado", "txn_n_restaurante",
    "txn_n_msi", "txn_cashback_total", "txn_hora_media", "txn_pct_finde", "txn_pct_nocturno", "txn_volatilidad",
    "txn_frec_por_dia",
]
PROD_COLS = [
    "prod_n_total", "prod_n_activos", "prod_n_cancelados", "prod_n_revision", "prod_util_media", "prod_util_max",
    "prod_saldo_total", "prod_limite_total", *[f"tiene_{t}" for t in TYPES], "prod_ratio_problematicos",
]
CONV_COLS = [
    "conv_n_total", "conv_turnos_prom", "conv_turnos_max", "conv_pct_voz", "conv_input_len_med", "conv_urgencia",
    "conv_frustracion", "conv_noise_pct", "conv_noise_score", "conv_noise_max", *[f"intent_{i}" for i in COUNTED],
    "conv_reintentos_48h", "conv_noise_trend",
]
FRACTIONS = {
    "txn_monto_prom", "txn_monto_std", "txn_monto_total", "txn_pct_digital", "txn_pct_efectivo", "txn_pct_inter",
    "txn_pct_atipico", "txn_pct_fallida", "txn_cashback_total", "txn_hora_media", "txn_pct_finde", "txn_pct_nocturno",
    "txn_volatilidad", "txn_frec_por_dia", "prod_util_media", "prod_util_max", "prod_saldo_total",
    "prod_limite_total", "prod_ratio_problematicos", "conv_turnos_prom", "conv_pct_voz", "conv_input_len_med",
    "conv_noise_pct", "conv_noise_score", "conv_noise_max", "conv_noise_trend",
}


def shown(columns, fill: bool = False) -> str:
    out = []
    for c in columns:
        x = f"coalesce({c}, 0)" if fill else c
        out.append(f"{r(x)} as {c}" if c in FRACTIONS else f"{x} as {c}")
    return ", ".join(out)


def with_(*parts: str, roles=()) -> str:
    """``with`` clause of role views followed by further common table expressions."""
    head = duck(*roles)
    return head + "".join(",\n" + p.strip() for p in parts) + "\n"


TFIDF = f"""
 toks as (select doc_id, regexp_extract_all(lower(text), {lit('[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]{2,}')}) as t from corpus_docs),
 occ as (select doc_id, unnest(t || [x || ' ' || t[i + 1] for x, i in t[:-2]]) as term from toks),
 tf as (select doc_id, term, count(*) as tf from occ group by all),
 totals as (select term, sum(tf) as total, count(*) as df from tf group by term),
 vocab as (select term, ln((1 + (select count(*) from corpus_docs)) / (1 + df)) + 1 as idf from totals order by total desc, term limit {fv.VOCABULARY_SIZE}),
 wraw as (select doc_id, term, (1 + ln(tf)) * idf as w from tf join vocab using (term)),
 postings as (select doc_id, term, w / sqrt(sum(w * w) over (partition by doc_id)) as weight from wraw),
 qtoks as (select query_id, regexp_extract_all(lower(text), {lit('[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]{2,}')}) as t from query_docs),
 qocc as (select query_id, unnest(t || [x || ' ' || t[i + 1] for x, i in t[:-2]]) as term from qtoks),
 qtf as (select query_id, term, count(*) as tf from qocc group by all),
 qraw as (select query_id, term, (1 + ln(tf)) * idf as w from qtf join vocab using (term)),
 qw as (select query_id, term, w / sqrt(sum(w * w) over (partition by query_id)) as weight from qraw)"""


def topk(pairs: str, min_sim: float, k: int = 3, factor: int = 3, prefix: int = 60) -> str:
    """CTEs from ``pairs`` (q, d, sim) and ``answers`` (d, output) to ``hits`` (q, rn, d, similitud, output)."""
    return f"""
 cand as (select q, d, round(sim, 9) as sim from {pairs} qualify row_number() over (partition by q order by round(sim, 9) desc, d) <= {k * factor}),
 kept as (select c.*, a.output from cand c join answers a using (d) where sim >= {min_sim}
  qualify row_number() over (partition by q, left(output, {prefix}) order by sim desc, d) = 1),
 hits as (select q, row_number() over (partition by q order by sim desc, d) as rn, d, round(sim, 3) as similitud, output from kept
  qualify rn <= {k})"""


