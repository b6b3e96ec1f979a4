"""Text classifiers as column expressions: no Python runs per row, batch and stream use the same code.

Word characters and white space are spelled as Unicode classes because ``\\w``, ``\\b`` and ``\\s`` differ
between engines and JDK versions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed_values as fv

WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
SPACE = r"[\s\x0b\x1c-\x1f\x{0085}\p{Z}]"
READABLE = "[a-záéíóúñ0-9ıſ]"
# three runs of three or more word characters; the outer runs need only their nearest three, which keeps the
# search linear in long words
VOICE = f"{WORD}{{3}}{SPACE}{{2,}}{WORD}{{3,}}{SPACE}{{2,}}{WORD}{{3}}"
# every character that counts as white space
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# the agent's symbol test allows no inner white space
SYMBOLS_NO_BLANK = r"^[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x{0085}\p{Z}]+$"


@dataclass(frozen=True)
class Lexicon:
    """Vocabulary of one rule variant."""

    yes_no: tuple[str, ...]
    jokes: tuple[str, ...]
    finance: tuple[str, ...]
    menu: tuple[str, ...] = tuple(fv.MENU)


TURNS = Lexicon(tuple(fv.YES_NO), tuple(fv.JOKES), tuple(fv.FINANCE))
LABELS = Lexicon(tuple(fv.YES_NO_LABELS), tuple(fv.JOKES_LABELS), tuple(fv.FINANCE_LABELS))
ONLINE = Lexicon(tuple(fv.YES_NO_API), tuple(fv.JOKES_API), tuple(fv.FINANCE_API))
AGENT = Lexicon(tuple(fv.YES_NO_SHORT), tuple(fv.JOKES_AGENT), tuple(fv.FINANCE))
SERVER = Lexicon(tuple(fv.YES_NO), tuple(fv.JOKES_API), tuple(fv.FINANCE_SERVER))


def _quoted(words) -> str:
    return "|".join(re.sub(r"([.^$*+?()\[\]{}|\\])", r"\\\1", w) for w in words)


def whole_word_pattern(words) -> str:
    return f"(^|{NOT_WORD})({_quoted(words)})($|{NOT_WORD})"


# --- predicates (null text gives null; callers decide what null means) --------------------------


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def normal(text: Column) -> Column:
    return strip(F.lower(text))


def is_voice_artifact(text: Column) -> Column:
    return text.rlike(VOICE)


def is_symbols(low: Column) -> Column:
    return (F.length(low) > 0) & ~low.rlike(READABLE)


def is_symbols_no_blank(low: Column) -> Column:
    return low.rlike(SYMBOLS_NO_BLANK)


def has_substring(low: Column, words) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | low.contains(word)
    return hit


def has_word(low: Column, words) -> Column:
    return low.rlike(whole_word_pattern(words))


def token_count(low: Column) -> Column:
    return F.regexp_count(low, F.lit(f"{WORD}+"))


def is_short_exploration(low: Column, lex: Lexicon, finance: Column) -> Column:
    return (token_count(low) <= 2) & ~finance & ~low.isin(*lex.yes_no) & ~low.isin(*lex.menu)


# --- classifiers ---------------------------------------------------------------------------------


def intent(text: Column, rules: dict[str, list[str]] | None = None, low: Column | None = None) -> Column:
    """First rule in order with a substring hit; blank or null text is the catch-all class. ``low``: the lower-cased text, if a column holds it."""
    low = F.lower(text) if low is None else low
    label = F.when(text.isNull(), fv.INTENT_OTHER)
    for name, words in (rules or fv.INTENTS).items():
        label = label.when(has_substring(low, words), name)
    return label.otherwise(fv.INTENT_OTHER)


def _damped(weight: float, finance: Column) -> Column:
    full = round(min(1.0, weight), 4)
    if weight <= 0:
        return F.lit(full)
    return F.when(finance, F.lit(round(min(1.0, weight * fv.FINANCE_DAMPING), 4))).otherwise(F.lit(full))


def _scored(kind: Column, weights: dict[str, float], finance: Column) -> Column:
    score = None
    for name, weight in weights.items():
        value = _damped(weight, finance)
        score = F.when(kind == name, value) if score is None else score.when(kind == name, value)
    return score


def turn_noise_type(text: Column, low: Column, finance: Column, lex: Lexicon = TURNS) -> Column:
    return (
        F.when(text.isNull(), "nulo")
        .when(is_symbols(low), "solo_simbolos")
        .when(has_substring(low, lex.jokes), "broma_offtopic")
        .when(is_voice_artifact(text), "artefacto_voz")
        .when(low.isin(*lex.menu), "menu_navegacion")
        .when(low.isin(*lex.yes_no), "afirmacion_negacion")
        .when((token_count(low) <= 2) & ~finance, "exploracion_corta")
        .otherwise("on_topic")
    )


def with_turn_noise(
    df: DataFrame,
    text: str = "input",
    lex: Lexicon = TURNS,
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """Adds ``noise_type`` and ``noise_score``.

    Done in steps so that lower-casing and the class are computed once per row; the finance test runs where a branch asks for it.
    """
    raw, low = F.col(text), F.col("_low")
    finance = has_word(low, lex.finance)
    return (
        df.withColumn("_low", normal(raw))
        .withColumn("noise_type", turn_noise_type(raw, low, finance, lex))
        .withColumn(
            "noise_score",
            F.coalesce(_scored(F.col("noise_type"), weights or fv.TURN_WEIGHTS, finance), F.lit(1.0)),
        )
        .drop("_low")
    )


def noise_label(text: Column, lex: Lexicon = LABELS, low: Column | None = None) -> Column:
    """Training label ``noise`` / ``on_topic``: voice artefacts are on topic before anything else. ``low``: the normal text, if a column holds it."""
    low = normal(text) if low is None else low
    finance = has_word(low, lex.finance)
    dull = low.isin(*lex.menu) | low.isin(*lex.yes_no) | (token_count(low) <= 2)
    return (
        F.when(text.isNull(), "noise")
        .when(is_voice_artifact(text), "on_topic")
        .when(is_symbols(low) | has_substring(low, lex.jokes), "noise")
        .when(dull & ~finance, "noise")
        .otherwise("on_topic")
    )


def with_turn_labels(df: DataFrame, text: str = "input") -> DataFrame:
    """Adds ``intent``, ``label``, ``noise_type`` and ``noise_score``; a text is lower-cased once for all substring tests."""
    raw = F.col(text)
    lowered = df.withColumn("_lower", F.lower(raw)).withColumn("_normal", strip(F.col("_lower")))
    labelled = lowered.withColumns({"intent": intent(raw, low=F.col("_lower")), "label": noise_label(raw, low=F.col("_normal"))})
    return with_turn_noise(labelled.drop("_lower", "_normal"), text)


# canned replies exist for these classes only; a gated class without one still goes to the answer path
GATE_REPLIES = ("broma", "simbolos", "exploracion")


def with_gate(
    df: DataFrame,
    text: str = "input",
    lex: Lexicon = ONLINE,
    weights: dict[str, float] | None = None,
    threshold: float = fv.MESSAGE_GATE,
) -> DataFrame:
    """Rule gate for incoming messages: ``gate, noise_type, noise_score, response_code``."""
    raw = F.coalesce(F.col(text), F.lit(""))
    low, finance, kind = F.col("_low"), F.col("_finance"), F.col("noise_type")
    reply = F.when(kind == "vacio", "exploracion").when(kind.isin(*GATE_REPLIES), kind)
    return (
        df.withColumn("_low", normal(raw))
        .withColumn("_finance", has_word(low, lex.finance))
        .withColumn(
            "noise_type",
            F.when(low == "", "vacio")
            .when(is_symbols(low), "simbolos")
            .when(has_substring(low, lex.jokes), "broma")
            .when(low.isin(*lex.menu), "menu")
            .when(low.isin(*lex.yes_no), "afirm")
            .when((token_count(low) <= 2) & ~finance, "exploracion")
            .otherwise("on_topic"),
        )
        .withColumn("noise_score", F.coalesce(_scored(kind, weights or fv.GATE_WEIGHTS, finance), F.lit(1.0)))
        .withColumn("gate", F.col("noise_score") >= threshold)
        .withColumn("response_code", F.when(F.col("gate"), reply))
        .drop("_low", "_finance")
    )


@dataclass(frozen=True)
class SemanticRules:
    """Names, scores and order of one variant of the embedding-backed gate."""

    lexicon: Lexicon
    symbols: str
    symbols_score: float
    symbols_allow_blank: bool
    joke: str
    joke_score: float
    yes_no: str
    menu: str
    pass_score: float
    short: str
    similar: str
    blank: str | None = None
    blank_score: float = 1.0
    single_reply: str | None = None
    short_tokens: int = 3
    threshold: float = fv.MESSAGE_GATE


AGENT_RULES = SemanticRules(
    lexicon=AGENT, symbols="simbolos", symbols_score=0.95, symbols_allow_blank=False, joke="broma_detectada",
    joke_score=0.90, yes_no="afirmacion", menu="navegacion_menu", pass_score=0.40, short="exploracion",
    similar="alta_similitud_noise",
)
SERVER_RULES = SemanticRules(
    lexicon=SERVER, symbols="solo_simbolos", symbols_score=0.90, symbols_allow_blank=True, joke="broma_offtopic",
    joke_score=0.90, yes_no="afirmacion_negacion", menu="menu_navegacion", pass_score=0.40, short="exploracion_corta",
    similar="alta_similitud_noise", blank="vacio", single_reply="exploracion_corta",
)


def with_semantic_gate(
    df: DataFrame, prototype_score: Column, text: str = "input", rules: SemanticRules = AGENT_RULES
) -> DataFrame:
    """Cheap rules first, then the prototype score: ``gate, noise_type, noise_score, response_code``."""
    raw = F.coalesce(F.col(text), F.lit(""))
    low, proto, fixed = F.col("_low"), F.col("_proto"), F.col("_fixed")
    symbols = is_symbols(low) if rules.symbols_allow_blank else is_symbols_no_blank(low)
    quick = F.when(symbols, rules.symbols).when(has_substring(low, rules.lexicon.jokes), rules.joke)
    if rules.blank:
        quick = F.when(low == "", rules.blank).when(symbols, rules.symbols).when(
            has_substring(low, rules.lexicon.jokes), rules.joke
        )
    quick = quick.when(low.isin(*rules.lexicon.yes_no), rules.yes_no).when(low.isin(*rules.lexicon.menu), rules.menu)
    passing = fixed.isin(rules.yes_no, rules.menu)
    by_score = F.coalesce(proto >= rules.threshold, F.lit(False))
    semantic = F.when(~by_score, "on_topic").when(token_count(low) <= rules.short_tokens, rules.short).otherwise(
        rules.similar
    )
    fixed_score = (
        F.when(passing, rules.pass_score)
        .when(fixed == rules.symbols, rules.symbols_score)
        .when(fixed == rules.joke, rules.joke_score)
    )
    if rules.blank:
        fixed_score = fixed_score.when(fixed == rules.blank, rules.blank_score)
    kind = F.col("noise_type")
    reply = kind
    if rules.single_reply:
        reply = F.when(fixed.isin(rules.symbols, rules.joke), fixed).otherwise(rules.single_reply)
    return (
        df.withColumn("_low", normal(raw))
        .withColumn("_proto", prototype_score)
        .withColumn("_fixed", quick)
        .withColumn("noise_type", F.coalesce(fixed, semantic))
        .withColumn("noise_score", F.when(fixed.isNotNull(), fixed_score).otherwise(F.round(proto, 4)))
        .withColumn("gate", F.when(fixed.isNotNull(), ~passing).otherwise(by_score))
        .withColumn("response_code", F.when(F.col("gate"), reply))
        .drop("_low", "_proto", "_fixed")
    )


def with_route(df: DataFrame) -> DataFrame:
    """Only a gated message that has a canned reply leaves the answer path."""
    return df.withColumn("short_circuit", F.col("gate") & F.col("response_code").isNotNull())


def has_urgency(text: Column) -> Column:
    return has_substring(F.lower(text), fv.URGENCY)


def has_frustration(text: Column) -> Column:
    return has_substring(F.lower(text), fv.FRUSTRATION)


def dim_key(text: Column, first_word: bool = True) -> Column:
    """``'Corta (2 frases)'`` becomes ``'corta'``."""
    key = strip(F.substring_index(text, "(", 1))
    return F.lower(F.substring_index(key, " ", 1) if first_word else key)
