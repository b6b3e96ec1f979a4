"""Personal data by weak supervision. DataFrame functions only; the driver fits on counts of bounded number.

Base patterns give spans that always stay. Wider patterns propose more; labelers (shape, checksum,
gazetteer, context, neighbours, length) vote on every proposal, expectation-maximisation estimates how far
each labeler can be trusted, and a naive Bayes classifier over the spans' own features, trained on
the estimated labels, decides which proposals become spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


KINDS = ("email", "ip", "card", "phone")

# A match can only begin where a run begins or the last match ended, and runs are never given back:
# same matches as the plain patterns, in time linear in the text.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Proposals: digits in groups, and addresses with their signs spelt out.
NUMBER = r"(?<![0-9A-Za-z.,_+-])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,18}(?![0-9A-Za-z])"
SPELT = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}\x20?(?:\[dot\]|\(dot\)|\x20dot\x20)\x20?[A-Za-z]{2,24}(?![A-Za-z0-9])"
#: (pattern, what a text must hold for it to be tried)
BASE = {"email": (EMAIL, "@"), "ip": (IP, r"[0-9]\.[0-9]"), "card": (CARD, r"(?:[0-9][\x20-]?){13}"), "phone": (PHONE, r"\+[0-9]")}
WIDE = {"number": (NUMBER, r"(?:[0-9][\x20().-]{0,2}){7}"), "spelt": (SPELT, r"dot(?:\]|\)|\x20)")}
CONTEXT_CHARS = 32
#: A match has two characters or more, so this many before one hold its context.
CONTEXT_MATCHES = CONTEXT_CHARS // 2

#: Gazetteers: words that go with personal numbers, words that go with others, starts of card numbers, endings of hosts.
PERSONAL_WORDS = ("tel", "phone", "call", "mobile", "fax", "card", "visa", "credit", "contact", "mail", "whatsapp", "telefon", "handy", "karte", "appel", "carte", "telefono", "tarjeta", "llame", "correo")
OTHER_WORDS = ("order", "invoice", "version", "isbn", "serial", "page", "total", "item", "code", "ref", "key", "hash", "bestell", "rechnung", "commande", "facture", "pedido", "factura")
CARD_STARTS = ("34", "36", "37", "4", "51", "52", "53", "54", "55", "6011", "65")
ENDINGS = ("com", "org", "net", "edu", "info", "io", "de", "fr", "es", "uk", "eu")

LABELERS = ("shape", "checksum", "gazetteer", "context", "neighbours", "length")
BUCKETS = 512
ROUNDS = 50
#: Probability from which a proposal becomes a span.
ACCEPT = 0.9


def tried(text: Column, needs: str) -> Column:
    return F.when(text.contains(needs) if needs == "@" else text.rlike(needs), text).otherwise(F.lit(""))


def found(kind: str, matches: Column, between: Column) -> Column:
    """array of a pattern's matches in order, with the length and the last characters of the text since the last match, and the next character."""
    n = F.size(matches)
    pairs = F.arrays_zip(F.slice(between, 1, n).alias("g"), matches.alias("m"), F.slice(between, 2, n).alias("h"), F.slice(matches, 2, n).alias("n"))
    near = lambda x: F.right(x, F.lit(CONTEXT_CHARS))
    return F.transform(pairs, lambda p, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("pos"), F.length(p["g"]).alias("gap"), p["m"].alias("match"), near(p["g"]).alias("tail"), near(F.concat(near(p["g"]), near(p["m"]))).alias("behind"),
        F.coalesce(F.left(F.when(p["h"] != "", p["h"]).otherwise(p["n"]), F.lit(1)), F.lit("")).alias("after"),
    ))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Of a string of digits."""
    back = F.reverse(x)

    def step(s: Column, i: Column) -> Column:
        d = back.substr(i, F.lit(1)).cast("int")
        twice = d * 2
        return s + F.when(i % 2 == 0, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(back), F.lit(1))), F.lit(0), step) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    n = F.length(digits(match))
    if kind == "ip":
        return match.rlike(r"^(0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(\.|$)){4}$")
    if kind == "card":
        return n.between(13, 19) & luhn(digits(match))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def candidates(docs: DataFrame) -> DataFrame:
    """row, doc_id, and ``found``: the raw matches of all patterns."""
    table = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    patterns = {**BASE, **WIDE}
    table = table.withColumns({f"_t_{k}": tried(F.col("text"), needs) for k, (_, needs) in patterns.items()})
    table = table.withColumns({f"_m_{k}": F.regexp_extract_all(f"_t_{k}", F.lit(p), 0) for k, (p, _) in patterns.items()} | {f"_b_{k}": F.split(f"_t_{k}", p, -1) for k, (p, _) in patterns.items()})
    return table.select("row", "doc_id", F.concat(*[found(k, F.col(f"_m_{k}"), F.col(f"_b_{k}")) for k in patterns]).alias("found"))


def spans_of(held: DataFrame) -> DataFrame:
    """row, proposed, kind, start, end, match, before, after: base spans, and proposals that overlap none of their row.

    Positions are running sums over a row's matches, and two passes over its spans by start, one each way, tell which overlap: a text costs
    as much as sorting its matches, and only matches with their surroundings are shuffled.
    """
    raw = held.select("row", F.explode("found").alias("x")).select("row", "x.*").repartition("row")
    order = Window.partitionBy("row", "kind").orderBy("pos")
    end = F.sum(F.col("gap") + F.length("match")).over(order)
    before = F.concat_ws("", F.collect_list("behind").over(order.rowsBetween(-CONTEXT_MATCHES, -1)), F.col("tail"))
    placed = raw.select(
        "row", F.col("kind").isin(*WIDE).alias("proposed"), "kind", (end - F.length("match")).cast("int").alias("start"), end.cast("int").alias("end"), "match",
        F.lower(F.right(before, F.lit(CONTEXT_CHARS))).alias("before"), "after",
    )
    good = F.lit(False)
    for kind in BASE:
        good = F.when(F.col("kind") == kind, valid(kind, F.col("match"))).otherwise(good)
    kept = placed.where(F.col("proposed") | good)
    forth = Window.partitionBy("row").orderBy("start", "proposed").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("proposed")).rowsBetween(Window.unboundedPreceding, 0)
    reach, limit = F.max(F.when(~F.col("proposed"), F.col("end"))).over(forth), F.min(F.when(~F.col("proposed"), F.col("start"))).over(back)
    free = F.coalesce(F.col("reach") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("end") <= F.col("limit"), F.lit(True))
    named = F.when(F.col("kind") == "spelt", "email").when(F.length(digits(F.col("match"))) >= 13, "card").otherwise("phone")
    return (
        kept.withColumns({"reach": reach, "limit": limit}).where(~F.col("proposed") | free).drop("reach", "limit")
        .withColumn("kind", F.when(F.col("proposed"), named).otherwise(F.col("kind")))
    )


def votes(spans: DataFrame) -> DataFrame:
    """Adds the labelers' votes: 1 personal, -1 not, 0 no opinion. A span's labelers see only its text and surroundings."""
    match, n = F.col("match"), F.length(digits(F.col("match")))
    words = lambda w: F.col("before").rlike(r"\b(" + "|".join(w) + r")")
    number = F.col("kind") != "email"
    shape = F.when(match.rlike(r"^(\+[0-9]{1,3} ?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$") | match.rlike(r"^[0-9]{4}([ -]?[0-9]{4}){3}$") | match.rlike(r"@|[\[(]at[\])]"), 1).when(match.rlike(r"^[0-9]+$") & (n < 13), -1)
    checksum = F.when(number & n.between(13, 19), F.when(luhn(digits(match)), 1).otherwise(-1))
    starts = digits(match).rlike("^(" + "|".join(CARD_STARTS) + ")")
    gazetteer = F.when(F.col("kind") == "card", F.when(starts, 1).otherwise(-1)).when(~number, F.when(F.lower(match).rlike(r"[^a-z](" + "|".join(ENDINGS) + ")$"), 1).otherwise(-1))
    context = F.when(words(PERSONAL_WORDS), 1).when(words(OTHER_WORDS), -1)
    neighbours = F.when(F.col("before").rlike(r"[=#$€/_%*]\s?$") | F.col("after").rlike(r"[=#$€/_%*]"), -1)
    length = F.when(number, F.when(n.between(9, 16), 1).when(~n.between(7, 19), -1))
    made = dict(zip(LABELERS, (shape, checksum, gazetteer, context, neighbours, length)))
    return spans.withColumns({f"v_{k}": F.coalesce(v.cast("int"), F.lit(0)) for k, v in made.items()})


def estimate(patterns: list[tuple[tuple[int, ...], float]], rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Expectation-maximisation over patterns of votes and their counts: the probability that a pattern is personal.

    Labelers are independent given the label; each has its own chance of every vote under either label. The
    start is the share of personal votes; every chance has a pseudo-count, so that a
    labeler that never speaks, or always says the same, tells nothing.
    """
    chance = {p: min(0.95, max(0.05, 0.5 + 0.25 * sum(p))) for p, _ in patterns}
    for _ in range(rounds):
        total = [sum(n * (1 - chance[p]) for p, n in patterns), sum(n * chance[p] for p, n in patterns)]
        said = [[{v: 1.0 for v in (-1, 0, 1)} for _ in LABELERS] for _ in range(2)]
        for p, n in patterns:
            for j, v in enumerate(p):
                said[1][j][v] += n * chance[p]
                said[0][j][v] += n * (1 - chance[p])
        for p, _ in patterns:
            odds = math.log((total[1] + 1) / (total[0] + 1))
            for j, v in enumerate(p):
                odds += math.log(said[1][j][v] / (total[1] + 3)) - math.log(said[0][j][v] / (total[0] + 3))
            chance[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return chance


def features(spans: DataFrame) -> Column:
    """array of (name, bucket): what the final classifier sees of a span."""
    shape = F.regexp_replace(F.regexp_replace("match", "[0-9]", "0"), "[A-Za-z]+", "a")
    seen = {
        "kind": F.col("kind"), "shape": shape, "digits": F.length(digits(F.col("match"))).cast("string"), "start": digits(F.col("match")).substr(1, 2),
        "word": F.regexp_extract("before", r"(\w+)\W*$", 1), "left": F.substring("before", -1, 1), "right": F.col("after"),
    }
    return F.array(*[F.struct(F.lit(k).alias("name"), F.pmod(F.xxhash64(F.lit(k), v), F.lit(BUCKETS)).alias("bucket")) for k, v in seen.items()])


def classify(spans: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """Of the spans with ``proposed``, those that the trained classifier accepts.

    At most 3 to the number of labelers patterns of votes and 7 * BUCKETS feature counts reach the driver or are broadcast, whatever
    the input's size.
    """
    spark = spans.sparkSession
    columns = [f"v_{k}" for k in LABELERS]
    voted = materialize(votes(spans), "votes")
    counts = [(tuple(r[c] for c in columns), float(r["count"])) for r in voted.groupBy(*columns).count().collect()]
    chances = estimate(counts)
    if not chances:
        return voted.select("row", "kind", "start", "end").where(F.lit(False))
    table = spark.createDataFrame([(*p, c) for p, c in chances.items()], ", ".join(f"{c} int" for c in columns) + ", chance double")
    seen = voted.join(F.broadcast(table), columns).withColumn("f", features(voted)).withColumn("votes", sum((F.col(c) for c in columns), F.lit(0)))
    total = sum(n for _, n in counts)
    yes = sum(n * chances[p] for p, n in counts)
    learned = (
        seen.select("chance", F.explode("f").alias("f")).groupBy("f.name", "f.bucket").agg(F.sum("chance").alias("yes"), F.count("*").alias("n"))
        .select("name", "bucket", (F.log((F.col("yes") + 0.5) / (yes + 1)) - F.log((F.col("n") - F.col("yes") + 0.5) / (total - yes + 1))).alias("weight"))
    )
    prior = math.log((yes + 1) / (total - yes + 1))
    scored = (
        seen.where("proposed and votes > 0 and chance >= 0.5").select("row", "kind", "start", "end", F.explode("f").alias("f"))
        .select("row", "kind", "start", "end", "f.name", "f.bucket").join(F.broadcast(learned), ["name", "bucket"])
        .groupBy("row", "kind", "start", "end").agg((F.sum("weight") + prior).alias("odds"))
    )
    return scored.where(F.col("odds") >= math.log(accept / (1 - accept))).select("row", "kind", "start", "end")


def find(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """One row per document: doc_id, base and added spans as arrays of (kind number, start, end), sorted.

    Starts and ends count code points, ends exclusive. Null texts count as empty and have no spans; repeated rows are
    handled each; other columns are ignored. An empty table gives an empty one.
    """
    held = materialize(candidates(docs), "candidates")
    spans = materialize(spans_of(held), "spans")
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    both = spans.where(~F.col("proposed")).select("row", "proposed", "kind", "start", "end").unionByName(classify(spans, accept).withColumn("proposed", F.lit(True)))
    span = F.struct(number.alias("kind"), "start", "end")
    listed = both.groupBy("row").agg(*[F.sort_array(F.collect_list(F.when(F.col("proposed") == flag, span))).alias(name) for name, flag in (("base", False), ("added", True))])
    none = F.array().cast("array<struct<kind:bigint,start:int,end:int>>")
    return held.select("row", "doc_id").join(listed, "row", "left").select("doc_id", *[F.coalesce(c, none).alias(c) for c in ("base", "added")])


def digest(spans: DataFrame) -> DataFrame:
    """doc_id, counts by kind, hash of the base spans, all spans as text."""
    kinds = F.array(*map(F.lit, KINDS))
    text = lambda a: F.concat_ws(",", F.transform(a, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"].cast("int")), x["start"], x["end"])))

    def count(number: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == number)).cast("long")

    counts = [count(k + 1).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    every = F.array_sort(F.concat("base", "added"))
    return spans.select("doc_id", *counts, F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(every).alias("spans"))
