"""Mixing sources to target weights by Sainte-Laguë quotas of equal blocks. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.timeline import running
from .common import in_struct, materialize, with_text

#: Words in a block; the unit of the quotas.
BLOCK_WORDS = 64
#: Blocks in a shard of a source, about; it is what one window task ranks.
SHARD_BLOCKS = 100_000
#: Divisors that one pass tries.
DIVISORS = 32
SHARE, MOST, SEED = 1.5, 2, "mix-1"
WEIGHTS = (3, 1, 2)
WORD = r"[^\x20\x09-\x0D]+"


def _place(*parts: Column | str) -> Column:
    """A seeded place in line: 32 hex digits."""
    return F.md5(F.concat_ws("-", F.lit(SEED), *parts))


def targets(sizes: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target, turn: ``share`` of all sizes by weight, at most ``most`` times a source's own size.

    Sources by code point, null last, weigh ``weights`` in turn. What a full source cannot take goes to
    the others by weight: sources fill in the order of limit / weight, and the level at which the
    first one is not filled holds for all that remain. Both orders are summed up in ranges, so sources may be many.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_all", F.lit(0))
    turned = running(by_source, ["_all"], "source", "source_size", sums={"turn": F.lit(1)})
    listed = turned.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("turn") - 1, F.lit(len(weights))).cast("int") + 1))
    listed = listed.withColumn("limit", F.col("source_size") * most).withColumn("reach", F.col("limit") / F.col("weight"))
    line = materialize(running(
        listed, ["_all"], "reach", "turn",
        sums={"_limits": F.col("limit"), "_weights": F.col("weight")}, totals={"_size": F.col("source_size"), "_weight": F.col("weight")},
    ), "levels")
    level = (F.col("_size") * F.lit(share) - (F.col("_limits") - F.col("limit"))) / (F.col("_weight") - (F.col("_weights") - F.col("weight")))
    found = line.select(F.max(F.when(level <= F.col("reach"), level))).first()[0]
    level = F.lit(found).cast("double")
    filled = F.when(level.isNull() | (F.col("reach") <= level), F.col("limit").cast("double"))
    return line.select("source", "source_size", F.coalesce(filled, F.col("weight") * level).alias("target"), "turn")


def quotas(votes: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``votes`` with ``quota``: blocks by Sainte-Laguë, the seats go to the highest of votes / (2 k + 1).

    ``votes`` is a written table with votes (words wanted) and turn (a whole number, the order of equal quotients). There are as many seats as
    the votes fill blocks, rounded. With a divisor d, votes / d rounded are the seats of quotients above d / 2; a
    divisor is searched that gives all seats, many being tried in one pass. Quotients that are equal, or too near for
    that, are put in order, and as many as are still missing get a seat.
    """
    v = F.col("votes")

    def seats(divisor: float) -> Column:
        return F.floor(v / F.lit(divisor) + 0.5)

    whole = votes.agg(F.sum("votes").alias("v"), F.count_if(v > 0).alias("n"), F.max("votes").alias("most")).first()
    wanted = int((whole.v or 0.0) / block_words + 0.5)
    if not wanted:
        return votes.withColumn("quota", F.lit(0).cast("long"))
    # rounding changes the seats by at most one half for each source
    low, high = whole.v / (wanted + whole.n + 1), whole.v / (wanted - whole.n - 1) if wanted > whole.n + 1 else 4 * whole.most
    while high / low - 1 > 1e-12:
        tried = [low * (high / low) ** (i / (DIVISORS + 1)) for i in range(1, DIVISORS + 1)]
        sums = votes.agg(*[F.sum(seats(d)).alias(f"d{i}") for i, d in enumerate(tried)]).first()
        exact = [d for d, n in zip(tried, sums) if n == wanted]
        if exact:
            return votes.withColumn("quota", seats(exact[0]))
        low, high = max([low, *(d for d, n in zip(tried, sums) if n > wanted)]), min([high, *(d for d, n in zip(tried, sums) if n < wanted)])
    given = votes.withColumn("quota", seats(high))
    missing = wanted - given.agg(F.sum("quota")).first()[0]
    after = given.withColumns({"_next": -v / (2 * F.col("quota") + 1), "_all": F.lit(0)})
    placed = running(after, ["_all"], "_next", "turn", sums={"_place": F.lit(1)})
    return placed.withColumn("quota", F.col("quota") + (F.col("_place") <= missing).cast("long")).select(*votes.columns, "quota")


def select(docs: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS,
           block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, number: str | None = None) -> DataFrame:
    """One row per document: row, doc_id, size, source_size, target, passes (times it is taken whole), blocks
    (further blocks taken of it), extra (their words).

    Null texts have no words, and documents without words are never taken; a null source is a source
    of its own. Repeated rows count each; other columns are ignored. A source's documents are dealt into shards of about
    ``shard_blocks`` blocks by a seeded hash of doc_id and size; a smaller source is one shard. The quota of a source,
    given among all sources, is dealt to its shards by rounding what it would be up to each of them. In a shard it is met by whole
    passes over its documents and, for the rest, by blocks in a seeded order, each taken once at most, so no
    document gives more than ``most`` times its words. ``row`` is the column ``number``, or counts the rows. An empty table gives an empty one.
    """
    counted = docs.select(
        (F.col(number) if number else F.monotonically_increasing_id()).alias("row"), F.col("doc_id").cast("long"), F.col("source").cast("string"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"),
    )
    sizes = materialize(counted, "sizes")
    wanted = materialize(targets(sizes, share, most, weights), "targets")
    given = materialize(quotas(wanted.withColumn("votes", F.col("target")), block_words), "quotas")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    hashed = F.conv(F.substring(_place(name, "size"), 1, 8), 16, 10).cast("long")
    # one exact key for a source, so that null ones meet as well
    key = F.concat(F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.lit("+")), F.coalesce("source", F.lit("")))
    per_source = given.withColumn("key", key).select(
        "key", "source_size", "target", "quota", F.floor(F.try_divide("target", "source_size")).alias("passes"),
        (F.floor(F.col("source_size") / (block_words * shard_blocks)) + 1).alias("shards"),
    )
    placed = sizes.withColumn("key", key).join(per_source.select("key", "source_size", "target", "shards"), "key")
    placed = placed.withColumn("shard", F.pmod(hashed, F.col("shards"))).drop("shards")
    parts = placed.where("size > 0").groupBy("key", "shard").agg(F.sum("size").alias("here"))
    upto = running(parts, ["key"], "shard", "here", sums={"_upto": F.col("here")}).join(per_source.drop("shards"), "key")

    def dealt(words: Column) -> Column:
        return F.floor(F.col("quota") * words / F.col("source_size") + 0.5)

    quota = dealt(F.col("_upto")) - dealt(F.col("_upto") - F.col("here"))
    need = quota * block_words - F.col("passes") * F.col("here")
    needs = materialize(upto.select("shard", "key", F.when(F.col("passes") >= most, 0).otherwise(F.least(F.greatest(need, F.lit(0)), F.col("here"))).alias("need")), "needs")
    blocks = placed.where("size > 0").select(
        "row", "doc_id", "size", "shard", "key", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / block_words).cast("int"))).alias("block")
    ).withColumn("words", F.least(F.lit(block_words), F.col("size") - F.col("block") * block_words))
    line = W.partitionBy("shard", "key").orderBy(_place(name, "size", "block"), "doc_id", "size", "block", "row")
    before = F.coalesce(F.sum("words").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    chosen = blocks.withColumn("before", before).join(needs, ["shard", "key"]).where(F.col("before") + F.col("words") / 2 <= F.col("need"))
    extra = chosen.groupBy("row").agg(F.sum("words").alias("extra"), F.sort_array(F.collect_list("block")).alias("blocks"))
    whole = placed.join(per_source.select("key", F.coalesce("passes", F.lit(0)).alias("passes")), "key")
    return whole.join(extra, "row", "left").select(
        "row", "doc_id", "size", "source_size", "target", F.col("passes").cast("int").alias("passes"), "blocks", F.coalesce("extra", F.lit(0)).alias("extra")
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words the mix takes, repeats counted). See ``select``."""
    return select(docs, **options).select("doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("extra")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, **options) -> DataFrame:
    """What the mix takes, with all columns of ``docs``: a row for each whole pass over a document, and one with the
    text of its further blocks. ``n_chars``, where the table has it, follows the text."""
    own = in_struct(docs)
    chosen = select(own.select("row", "own.doc_id", "own.source", "own.text"), number="row", block_words=block_words, **options).where("size > 0").select("row", "passes", "blocks")
    copies = F.sequence(F.when(F.col("blocks").isNull(), 1).otherwise(0), F.col("passes"))
    taken = own.join(chosen, "row").where("passes > 0 or blocks is not null").withColumn("copy", F.explode(copies))
    words = F.regexp_extract_all("own.text", F.lit(WORD + r"[\x20\x09-\x0D]*"), 0)
    parts = F.transform("blocks", lambda b: F.array_join(F.slice(words, b * block_words + 1, block_words), ""))
    text = F.when(F.col("copy") == 0, F.array_join(parts, "")).otherwise(F.col("own.text"))
    return with_text(taken, text, docs)
