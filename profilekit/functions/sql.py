"""The text rules as SQL functions, and the hook for a user's encoder."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixed_values as fv
from . import text as tx


def _quote(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _any_substring(low: str, words) -> str:
    return "(" + " or ".join(f"contains({low}, {_quote(w)})" for w in words) + ")"


def _among(low: str, words) -> str:
    return f"{low} in ({', '.join(_quote(w) for w in words)})"


def _weighed(kind: str, weights: dict[str, float], finance: str) -> str:
    """The class's weight, damped where a finance word stands; null for other classes."""
    cases = []
    for name, weight in weights.items():
        full = f"{round(min(1.0, weight), 4)}D"
        less = f"{round(min(1.0, weight * fv.FINANCE_DAMPING), 4)}D"
        cases.append(f"when {_quote(name)} then " + (f"if({finance}, {less}, {full})" if weight > 0 else full))
    return f"case {kind} {' '.join(cases)} end"


def register(spark: SparkSession, prefix: str = "pk_") -> list[str]:
    """Temporary SQL functions over one text argument; Spark inlines their bodies into the plan.

    Texts: normal, token_count, is_voice_artifact, is_symbols, has_finance_word, has_urgency, has_frustration, intent, noise_label,
    noise_type and noise_score of a turn, gate_type, gate_score, gate, response_code and short_circuit of a message, dim_key.
    Casts: safe_double, safe_int and safe_bool of a text, which never fail.
    """

    def low_of(text: str) -> str:
        return f"trim(both {_quote(tx.BLANKS)} from lower({text}))"

    def finance_in(low: str, lex: tx.Lexicon) -> str:
        return f"{low} rlike {_quote(tx.whole_word_pattern(lex.finance))}"

    def words_in(low: str) -> str:
        return f"regexp_count({low}, {_quote(tx.WORD + '+')})"

    def symbols_in(low: str) -> str:
        return f"(length({low}) > 0 and not {low} rlike {_quote(tx.READABLE)})"

    low, voice, lex, turns, online = low_of("t"), f"t rlike {_quote(tx.VOICE)}", tx.LABELS, tx.TURNS, tx.ONLINE
    rules = " ".join(f"when {_any_substring('lower(t)', words)} then {_quote(n)}" for n, words in fv.INTENTS.items())
    finance, count, symbols = finance_in(low, lex), words_in(low), symbols_in(low)
    said = low_of("coalesce(t, '')")
    call = lambda name: f"{prefix}{name}(t)"
    bodies = {
        "normal": ("string", low),
        "token_count": ("int", count),
        "is_voice_artifact": ("boolean", voice),
        "is_symbols": ("boolean", symbols),
        "has_finance_word": ("boolean", finance),
        "has_urgency": ("boolean", _any_substring("lower(t)", fv.URGENCY)),
        "has_frustration": ("boolean", _any_substring("lower(t)", fv.FRUSTRATION)),
        "intent": ("string", f"case when t is null then {_quote(fv.INTENT_OTHER)} {rules} else {_quote(fv.INTENT_OTHER)} end"),
        "noise_label": (
            "string",
            f"case when t is null then 'noise' when {voice} then 'on_topic' "
            f"when {symbols} or {_any_substring(low, lex.jokes)} then 'noise' "
            f"when ({_among(low, (*lex.menu, *lex.yes_no))} or {count} <= 2) and not {finance} then 'noise' else 'on_topic' end",
        ),
        "noise_type": (
            "string",
            f"case when t is null then 'nulo' when {symbols} then 'solo_simbolos' when {_any_substring(low, turns.jokes)} then 'broma_offtopic' "
            f"when {voice} then 'artefacto_voz' when {_among(low, turns.menu)} then 'menu_navegacion' when {_among(low, turns.yes_no)} then 'afirmacion_negacion' "
            f"when {count} <= 2 and not {finance_in(low, turns)} then 'exploracion_corta' else 'on_topic' end",
        ),
        "noise_score": ("double", f"coalesce({_weighed(call('noise_type'), fv.TURN_WEIGHTS, finance_in(low, turns))}, 1.0D)"),
        "gate_type": (
            "string",
            f"case when {said} = '' then 'vacio' when {symbols_in(said)} then 'simbolos' when {_any_substring(said, online.jokes)} then 'broma' "
            f"when {_among(said, online.menu)} then 'menu' when {_among(said, online.yes_no)} then 'afirm' "
            f"when {words_in(said)} <= 2 and not {finance_in(said, online)} then 'exploracion' else 'on_topic' end",
        ),
        "gate_score": ("double", f"coalesce({_weighed(call('gate_type'), fv.GATE_WEIGHTS, finance_in(said, online))}, 1.0D)"),
        "gate": ("boolean", f"{call('gate_score')} >= {fv.MESSAGE_GATE}D"),
        "response_code": (
            "string",
            f"case when not {call('gate')} then null when {call('gate_type')} = 'vacio' then 'exploracion' "
            f"when {_among(call('gate_type'), tx.GATE_REPLIES)} then {call('gate_type')} end",
        ),
        "short_circuit": ("boolean", f"{call('gate')} and {call('response_code')} is not null"),
        "dim_key": ("string", f"lower(substring_index(trim(both {_quote(tx.BLANKS)} from substring_index(t, '(', 1)), ' ', 1))"),
        "safe_double": ("double", "coalesce(try_cast(t as double), 0.0D)"),
        "safe_int": ("bigint", "coalesce(try_cast(nullif(nullif(nanvl(try_cast(t as double), null), double('inf')), double('-inf')) as bigint), 0L)"),
        "safe_bool": ("boolean", f"{prefix}safe_int(t) != 0"),
    }
    for name, (kind, body) in bodies.items():
        spark.sql(f"create or replace temporary function {prefix}{name}(t string) returns {kind} return {body}")
    return [prefix + n for n in bodies]


def with_embedding(
    df: DataFrame, encode: Callable[[list[str]], list[list[float]]], text: str = "input", out: str = "embedding"
) -> DataFrame:
    """Adds vectors from a user's encoder, called once per Arrow batch. Filter rows before, not after."""

    @F.pandas_udf("array<float>")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series(list(encode(batch.fillna("").tolist())))

    return df.withColumn(out, run(F.col(text)))
