"""Line deduplication by an exact set-similarity join.

A line is the set of its words, ordered by rarity in the corpus. Two lines whose sets agree to 0.8 have two
words next to each other in both orders, among the first few of both: lines that share such a pair are compared with the first of
them, and those it does not connect with each other, where lengths and parity bit sets (an upper bound) allow a match.
What passes is verified. All links lie within what is connected so, and are counted there block by block. A line goes
if an earlier line matches it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import discard
from .common import chunks, in_struct, lower_joined, materialize, mix, numbered, utf8, with_text, word_hashes
from .graph import components
from .near_copies import BITS, parity_bits, verify


@dataclass(frozen=True)
class Plan:
    """``rarity_bits``: rarity is counted in 2 ** rarity_bits buckets of words, one byte each on every executor, whatever the corpus.
    Buckets only order words; results are exact for any number. Connected lines are compared in blocks of about ``block``, so
    that a task holds two of them at most. ``similarity`` is 0.75 or more: below, few words might have no pair in common.
    Words whose bucket holds ``rare`` at most are keys one by one, others in pairs; keys are grouped, and texts looked up, in ``slices`` turns, so
    that only a part of them is on disk twice."""

    similarity: float = 0.8
    rarity_bits: int = 24
    rare: int = 64
    slices: int = 3
    block: int = 2048

    def __post_init__(self) -> None:
        if self.similarity < 0.75:
            raise ValueError("similarity below 0.75")


#: Words whose buckets are counted before they are handed on.
COUNTED = 1 << 21
#: Words of two blocks that are counted at once.
COLUMNS = 4096
#: Entries of keys that a task looks at together, and sets of one key whose bits are compared by pairs there.
ENTRIES, GROUP = 1 << 16, 128


def _lines(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word of all texts: hash, number of its line over all texts; for each text: its first line's number; for each line: its text's number."""
    data, begins = lower_joined(texts)
    starts, hashes = word_hashes(data)
    breaks = np.flatnonzero(data == 10)
    first = np.searchsorted(breaks, begins)
    return hashes, np.searchsorted(breaks, starts), first, np.repeat(np.arange(len(texts)), np.diff([*first, len(breaks) + 1]))


def rarity(docs: DataFrame, bits: int) -> np.ndarray:
    """One byte per bucket of words: 0 where the corpus holds one word at most, else the logarithm of how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def counts() -> pa.RecordBatch:
            bucket, count = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(count.astype(np.int64))], names=["bucket", "n"])

        for part in chunks(batches):
            _, hashes = word_hashes(lower_joined(part.column("text").to_pylist())[0])
            held.append((hashes >> np.uint64(64 - bits)).astype(np.int32))
            n += len(hashes)
            if n >= COUNTED:
                yield counts()
                held, n = [], 0
        if held:
            yield counts()

    found = docs.select(utf8().alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where("n > 1")
    got = found.select("bucket", F.least(F.lit(255), F.ceil(8 * F.log2("n"))).cast("short").alias("level")).toArrow()
    out = np.zeros(1 << bits, np.uint8)
    out[got.column("bucket").to_numpy()] = got.column("level").to_numpy()
    return out


def signed_lines(docs: DataFrame, plan: Plan) -> DataFrame:
    """d, r, l (a line's id), n words, parity bits, digest of the set (x1, x2), keys: rare words, and pairs of words next to each other.

    Words that occur nowhere else come first and count as lost. Rare ones are keys of their own, one more than can be lost at most; if
    they are not as many, all of them may be lost, and pairs of neighbours among the others are keys as well. There each lost word breaks two
    pairs, and each word the other line has besides breaks one: with one pair more than that, counted from the rarest, two lines that match
    have one in common. Both lines' first words are all words up to some place in one order, so what the line that ends first has in
    common with the other is among the other's. Of equal lines of one batch only the first has keys.
    """
    levels = docs.sparkSession.sparkContext.broadcast(rarity(docs, plan.rarity_bits))
    shift = np.uint64(64 - plan.rarity_bits)
    rare = np.floor(8 * np.log2(plan.rare))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            hashes, line, first, text_of = _lines(part.column("text").to_pylist())
            if not len(hashes):
                continue
            level = levels.value[(hashes >> shift).astype(np.int64)]
            order = np.lexsort((hashes, level, line))
            hashes, line, level = hashes[order], line[order], level[order]
            new = np.ones(len(line), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (line[1:] != line[:-1])
            hashes, line, level = hashes[new], line[new], level[new]
            begins = np.flatnonzero(np.diff(line, prepend=-1))
            n = np.diff([*begins, len(line)])
            with np.errstate(over="ignore"):
                bits = np.bitwise_xor.reduceat(np.uint64(1) << (mix(hashes) >> np.uint64(58)), begins)
                x1, x2 = [np.add.reduceat(mix(hashes ^ np.uint64(c)), begins).view(np.int64) for c in (0x51ED270B, 0x3C6EF372FE94F82B)]
            alone, few = (np.add.reduceat(x.astype(np.int64), begins) for x in (level == 0, (level > 0) & (level <= rare)))
            lost = n - alone - np.ceil(plan.similarity * n - 1e-9).astype(np.int64)
            one = np.clip(lost + 1, 0, few)
            left = n - alone - few
            two = np.where(few <= lost, np.clip(broken(n, left, plan.similarity) + 1, 0, np.maximum(left - 1, 0)), 0)
            by_digest = np.lexsort((x2, x1))
            again = np.zeros(len(n), bool)
            again[1:] = (x1[by_digest[1:]] == x1[by_digest[:-1]]) & (x2[by_digest[1:]] == x2[by_digest[:-1]])
            one[by_digest[again]] = two[by_digest[again]] = 0
            place = np.arange(len(line)) - np.repeat(begins + alone, n)
            pair = np.repeat(two, n) > place - np.repeat(few, n)
            pair &= place >= np.repeat(few, n)
            use = np.flatnonzero(pair | ((place >= 0) & (place < np.repeat(one, n))))
            offsets = np.concatenate([[0], np.cumsum(one + two)]).astype(np.int32)
            # a pair's second word is in the same line
            keys = mix(hashes[use] ^ np.where(pair[use], mix(np.append(hashes, hashes[:1])[use + 1]), np.uint64(0)))
            own = line[begins]
            text = text_of[own]
            yield pa.RecordBatch.from_arrays([
                part.column("d").take(pa.array(text)), part.column("row").take(pa.array(text)), pa.array((own - first[text]).astype(np.int32)),
                pa.array(n.astype(np.int32)), pa.array(bits.view(np.int64)), pa.array(x1), pa.array(x2), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64))),
            ], names=["d", "r", "l", "n", "bits", "x1", "x2", "keys"])

    return docs.select("d", "row", utf8().alias("text")).mapInArrow(run, "d long, r long, l int, n int, bits long, x1 long, x2 long, keys array<long>")


def broken(n: np.ndarray, left: np.ndarray, similarity: float) -> np.ndarray:
    """How many pairs of neighbours among the ``left`` words of a line that has ``n`` may be missing in a line that matches it.

    With m words there and o shared, 2 (left - o) + (m - o) at most; o is the least that a match needs, and the
    sum is linear in m, so one of the least and the largest m gives the most.
    """
    share = 3 * similarity / (1 + similarity)
    most = [2 * left + m - share * (n + m) for m in (np.ceil(similarity * n - 1e-9), np.floor(n / similarity + 1e-9))]
    return np.floor(np.maximum(*most) + 1e-9).astype(np.int64)


def shared_keys(lines: DataFrame, plan: Plan) -> DataFrame:
    """key, h, f: the keys that two different sets or more have, with these (by x1) and the first of them.

    Where ``GROUP`` sets at most share a key, those that none of the others may match are left out. A task streams over its keys in order.
    """

    def alike(n: np.ndarray, m: np.ndarray, differ: np.ndarray) -> np.ndarray:
        least = np.ceil((n + m) * (plan.similarity / (1 + plan.similarity)) - 1e-9)
        return (np.minimum(n, m) >= np.maximum(n, m) * plan.similarity - 1e-9) & (np.bitwise_count(differ.view(np.uint64)) <= n + m - 2 * least)

    def told(key: np.ndarray, h: np.ndarray, starts: np.ndarray, keep: np.ndarray) -> pa.RecordBatch:
        """The kept rows; f is the first of them in their group."""
        at = np.where(keep, np.arange(len(key)), len(key))
        f = np.minimum.reduceat(at, starts) if len(starts) else at
        f = np.repeat(f, np.diff([*starts, len(key)]))[keep]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (key[keep], h[keep], h[f])], names=["key", "h", "f"])

    def whole(key: np.ndarray, h: np.ndarray, n: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
        """Groups that are complete."""
        starts = np.flatnonzero(np.diff(key, prepend=key[:1] + 1))
        sizes = np.diff([*starts, len(key)])
        keep = np.repeat(sizes > GROUP, sizes)
        rank = np.where(keep, 0, np.arange(len(key)) - np.repeat(starts, sizes))
        at, k = np.flatnonzero(rank), 1
        while len(at):
            met = alike(n[at], n[at - k], bits[at] ^ bits[at - k])
            keep[at[met]] = keep[at[met] - k] = True
            k += 1
            at = at[rank[at] >= k]
        return told(key, h, starts, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "h", "n", "bits")
        held, large, waiting, rows = None, None, [], 0  # the last key's rows, or its key, first and latest set if they were handed on
        for batch in _then_none(batches):
            if batch is not None:
                waiting.append([batch.column(c).to_numpy() for c in names])
                rows += batch.num_rows
                if rows < ENTRIES:
                    continue
            cols = [np.concatenate(c) for c in zip(*([held] if held else []), *waiting)]
            held, waiting, rows = None, [], 0
            if not cols or not len(cols[0]):
                continue
            new = np.ones(len(cols[0]), bool)
            new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
            if large is not None:
                new[0] = (cols[0][0], cols[1][0]) != (large[0], large[2])
            cols = [c[new] for c in cols]
            if large is not None:
                more = int(np.searchsorted(cols[0] != large[0], True))
                if more:
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0][:more]), pa.array(cols[1][:more]), pa.array(np.full(more, large[1]))], names=["key", "h", "f"])
                    large = (large[0], large[1], cols[1][more - 1])
                    cols = [c[more:] for c in cols]
                if not len(cols[0]):
                    continue
                large = None
            last = len(cols[0]) if batch is None else int(np.flatnonzero(np.diff(cols[0], prepend=cols[0][:1] + 1))[-1])
            if last:
                yield whole(*(c[:last] for c in cols))
            rest = [c[last:] for c in cols]
            if len(rest[0]) > GROUP:
                yield told(rest[0], rest[1], np.array([0]), np.ones(len(rest[0]), bool))
                large = (rest[0][0], rest[1][0], rest[1][-1])
            elif len(rest[0]):
                held = rest

    entries = lines.select(F.explode("keys").alias("key"), F.col("x1").alias("h"), "n", "bits")
    turns = [entries.where(F.pmod("key", F.lit(plan.slices)) == k).repartition("key").sortWithinPartitions("key", "h") for k in range(plan.slices)]
    return reduce(DataFrame.unionByName, [materialize(x.mapInArrow(run, "key long, h long, f long"), "shared") for x in turns])


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def word_sets(docs: DataFrame, wanted: DataFrame, plan: Plan) -> DataFrame:
    """row (a node), set: sorted word hashes, wide: parity bits of the wanted lines (node, id). A part of the texts is shuffled at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            nodes, texts = [], []
            for text, asked in zip(part.column("text").to_pylist(), part.column("lines").to_pylist()):
                own = text.split(b"\n")
                nodes += [s["node"] for s in asked]
                texts += [own[s["l"]] for s in asked]
            hashes, line, *_ = _lines(texts)
            cut = np.searchsorted(line, np.arange(len(texts) + 1))
            sets = [np.unique(hashes[a:b]) for a, b in zip(cut, cut[1:])]
            bits = parity_bits(np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate([hashes[:0], *sets]), len(sets))
            wide = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BITS, pa.int32()), pa.array(bits))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary()), wide], names=["row", "set", "wide"])

    # as a table its size is known, so a small one is broadcast and no text is shuffled
    lines = materialize(wanted.groupBy(F.col("id.r").alias("row")).agg(F.collect_list(F.struct("id.l", "node")).alias("lines")), "wanted")
    turns = [docs.where(F.pmod("row", F.lit(plan.slices)) == k).join(lines, "row").select("lines", utf8().alias("text")) for k in range(plan.slices)]
    return reduce(DataFrame.unionByName, [materialize(x.mapInArrow(run, "row long, set binary, wide array<long>"), "sets") for x in turns])


def _may_match(similarity: float, n: Column, bits: list[Column], m: Column, other_bits: list[Column]) -> Column:
    shared = F.ceil((n + m) * (similarity / (1 + similarity)) - 1e-9)
    lengths = F.least(n, m) >= F.greatest(n, m) * similarity - 1e-9
    return lengths & (reduce(add, [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(bits, other_bits)]) <= n + m - 2 * shared)


def ordered(docs: DataFrame) -> DataFrame:
    """``row``, ``d`` (doc_id, the largest number for null) and text."""
    return docs.select("row", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("d"), "text")


def line_matches(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """One row per line with words: id (doc number, row, line from 0), match (the id of an earlier line, or null), similarity,
    class (the first line of all that are connected), links (how many other lines match it, earlier or later).

    Lines are what ``\\n`` parts; words are lower-cased runs without ``[\\x20\\x09-\\x0D]``. Lines come in the order of doc_id (null
    last), rows that repeat a doc_id in the order of the table, then of lines. A line has a match exactly if some earlier
    line's set of words has a Jaccard similarity of 0.8 or more with its own, and is then given the earliest of them; equal
    sets match the first of them. Blank lines, and null or empty texts, have no rows. ``docs`` (doc_id, text; other columns are
    ignored) may be empty, which gives an empty table.

    Equal sets are one representative, compared once; every pair of representatives that match is counted.
    """
    own = numbered(docs.select("doc_id", "text"))
    return _matches(ordered(own), plan, spent=own)


def _linked(docs: DataFrame, lines: DataFrame, plan: Plan, spent: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes (node, h, x2, id, size, n, bits: the first of all lines with an equal set, where another line may match),
    sets (row, set) of them, links (a, b, similarity): verified ones, enough to connect all nodes that are linked.

    Every node is compared with the first of each of its keys, so that a group of near copies takes about as many
    comparisons as it has members. Nodes of one key that are not connected after that are all compared with each other, but for pairs whose
    lengths or parity bits show that they differ too much: these bound the similarity from above, so no link is lost.
    ``spent``, the table below ``docs``, is deleted once the sets are written.
    """
    shared = shared_keys(lines, plan)
    # as a table its size is known, so a small one is broadcast
    wanted = materialize(shared.select(F.col("h").alias("x1")).distinct(), "wanted")
    first = lines.join(wanted, "x1").groupBy("x1", "x2").agg(F.min(F.struct("d", "r", "l")).alias("id"), F.count("*").alias("size"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    nodes = materialize(first.select(F.monotonically_increasing_id().alias("node"), F.col("x1").alias("h"), "x2", "id", "size", "n", "bits"), "nodes")
    sets = word_sets(docs, nodes.select("node", "id"), plan)
    if spent is not None:
        discard(spent)
    wide = materialize(nodes.select("node", "h", "n").join(sets.select(F.col("row").alias("node"), "wide"), "node"), "wide")
    other = wide.select(F.col("node").alias("b"), F.col("h").alias("f"), F.col("n").alias("m"), F.col("wide").alias("c"))
    alike = _may_match(plan.similarity, F.col("n"), [F.col("wide")[k] for k in range(BITS)], F.col("m"), [F.col("c")[k] for k in range(BITS)])
    stars = shared.where("h != f").select("h", "f").distinct()
    pairs = materialize(stars.join(wide, "h").join(other, "f").where(alike).select(F.col("node").alias("a"), "b"), "pairs")
    sure = materialize(verify(pairs, sets, plan.similarity), "links")
    placed = shared.select("key", "h").join(nodes.select("node", "h", "n", "bits"), "h").join(components(sure), "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = materialize(placed.select("key", "node", "n", "bits", "root"), "placed")
    # each node outside its key's largest part meets all others there: no pair lies within one part
    part = placed.groupBy("key", "root").agg(F.count("*").alias("size"))
    largest = part.groupBy("key").agg(F.max(F.struct("size", "root")).alias("top"), F.count("*").alias("parts")).where("parts > 1").select("key", F.col("top.root").alias("top"))
    apart = materialize(placed.join(largest, "key"), "open")
    discard(placed)
    x = apart.where("root != top").select("key", F.col("node").alias("a"), "n", F.col("root").alias("ra"), "bits")
    y = apart.select("key", F.col("node").alias("b"), F.col("n").alias("m"), F.col("root").alias("rb"), "top", F.col("bits").alias("c"))
    # of two nodes outside the largest part, the smaller asks
    near = _may_match(plan.similarity, F.col("n"), [F.col("bits")], F.col("m"), [F.col("c")])
    rest = x.join(y, "key").where("ra != rb and (rb = top or a < b)").where(near).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    tried = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    rest = rest.join(tried, ["a", "b"], "left_anti").join(wide.select(F.col("node").alias("a"), "n", "wide"), "a").join(other.drop("f"), "b")
    rest = materialize(rest.where(alike).select("a", "b"), "pairs")
    rest = materialize(verify(rest, sets, plan.similarity), "links")
    discard(apart)
    return nodes, sets, sure.unionByName(rest)


def _overlaps(x: np.ndarray, x_of: np.ndarray, y: np.ndarray, y_of: np.ndarray) -> np.ndarray:
    """How many words every set of x shares with every set of y; ``of`` numbers the sets."""
    common = np.intersect1d(x, y)
    out = np.zeros((x_of[-1] + 1, y_of[-1] + 1), np.float32)
    for low in range(0, len(common), COLUMNS):
        words = common[low : low + COLUMNS]
        both = []
        for values, of, n in ((x, x_of, len(out)), (y, y_of, out.shape[1])):
            at = np.searchsorted(words, values).clip(max=len(words) - 1)
            hit = words[at] == values
            both.append(np.zeros((n, len(words)), np.float32))
            both[-1][of[hit], at[hit]] = 1
        out += both[0] @ both[1].T
    return out


def counted(placed: DataFrame, plan: Plan) -> DataFrame:
    """node, others (how many lines of other sets match), m (earliest of them that comes before: its id and the similarity, or null).

    ``placed``: root, node, id, size, set. What is connected is cut into blocks; a task holds two of them at a time.
    """
    names = ("root", "low", "high")
    blocks = placed.groupBy("root").agg(F.ceil(F.count("*") / plan.block).alias("blocks")).where("blocks > 1")
    own = placed.join(materialize(blocks, "blocks"), "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long"))).withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "id.*", "size", "set")

    def compared(group: dict[str, np.ndarray], words: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((group["l"], group["r"], group["d"]))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        of = np.repeat(np.arange(len(n)), n)
        lower = group["own"] == group["low"]
        x, y = np.flatnonzero(lower), np.flatnonzero(lower if group["low"][0] == group["high"][0] else ~lower)
        others, match, got = np.zeros(len(n), np.int64), np.full(len(n), len(n)), np.zeros(len(n))
        if len(x) and len(y):
            sides = []
            for side in (x, y):
                place = np.full(len(n), -1)
                place[side] = np.arange(len(side))
                use = place[of] >= 0
                sides += [words[use], place[of[use]]]
            shared = _overlaps(*sides).astype(np.float64)
            similar = shared / (n[x][:, None] + n[y][None, :] - shared)
            near = (similar >= plan.similarity - 1e-12) & (rank[x][:, None] != rank[y][None, :])
            for a, b, hit, how in ((x, y, near, similar), (y, x, near.T, similar.T))[: 1 if x[0] == y[0] else 2]:
                others[a] = hit @ group["size"][b]
                before = np.where(hit & (rank[b][None, :] < rank[a][:, None]), rank[b][None, :], len(n))
                best = before.argmin(axis=1)
                match[a], got[a] = before[np.arange(len(a)), best], how[np.arange(len(a)), best]
        none = match == len(n)
        at = order[np.where(none, 0, match)]
        return pa.RecordBatch.from_arrays(
            [pa.array(group["node"]), pa.array(others), *(pa.array(group[k][at], mask=none) for k in ("d", "r", "l")), pa.array(got, mask=none)], names=["node", "others", "d", "r", "l", "similarity"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            held = yield from parts(table, last=False)
        if held is not None:
            yield from parts(held, last=True)

    def parts(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        """Compares the whole groups of a table, and returns the rows of the last one, which may go on."""
        if not table.num_rows:
            return None
        cols = {c: table.column(c).to_numpy() for c in table.schema.names if c != "set"}
        new = np.zeros(table.num_rows, bool)
        for c in names:
            new[1:] |= cols[c][1:] != cols[c][:-1]
        cuts = [0, *np.flatnonzero(new), *([table.num_rows] if last else [])]
        sets = table.column("set").slice(0, cuts[-1]).to_pylist()
        n = np.array([len(s) // 8 for s in sets], np.int64)
        words, ends = np.frombuffer(b"".join(sets), np.uint64), np.concatenate([[0], np.cumsum(n)])
        for a, b in zip(cuts, cuts[1:]):
            yield compared({c: v[a:b] for c, v in cols.items()}, words[ends[a] : ends[b]], n[a:b])
        return None if last else table.slice(cuts[-1])

    found = met.repartition(*names).sortWithinPartitions(*names).mapInArrow(run, "node long, others long, d long, r long, l int, similarity double")
    match = F.when(F.col("d").isNotNull(), F.struct(F.struct("d", "r", "l").alias("id"), "similarity"))
    return found.groupBy("node").agg(F.sum("others").alias("others"), F.min(match).alias("m"))


def _matches(docs: DataFrame, plan: Plan, spent: DataFrame | None = None) -> DataFrame:
    """``line_matches`` of a written table (row, d, text). Tables are deleted as soon as nothing reads them, ``spent``, the table below ``docs``, as well."""
    lines = materialize(signed_lines(docs, plan), "lines")
    nodes, sets, links = _linked(docs, lines, plan, spent)
    root = materialize(components(links).join(nodes, "node").select("root", "node", "id", "size", "h", "x2"), "connected")
    placed = root.join(sets.withColumnRenamed("row", "node"), "node").select("root", "node", "id", "size", "set")
    found = materialize(counted(placed, plan), "counted")
    least = root.groupBy("root").agg(F.min("id").alias("class"))
    found = root.join(least, "root").join(found, "node").select(F.col("h").alias("x1"), "x2", "class", "others", "m")
    equal = W.partitionBy("x1", "x2")
    own = lines.select(F.struct("d", "r", "l").alias("id"), "x1", "x2").withColumns({"first": F.min("id").over(equal), "size": F.count("*").over(equal)}).join(found, ["x1", "x2"], "left")
    same = F.col("id") != F.col("first")
    return own.select(
        "id", F.when(same, F.col("first")).otherwise(F.col("m.id")).alias("match"), F.when(same, F.lit(1.0)).otherwise(F.col("m.similarity")).alias("similarity"),
        F.coalesce("class", "first").alias("class"), (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("links"),
    )


def report(matches: DataFrame) -> DataFrame:
    """doc_id, line, kept, match_doc_id, match_line, similarity, class_doc_id, class_line, links."""
    number = lambda c: F.when(F.col(f"{c}.d") < (1 << 63) - 1, F.col(f"{c}.d"))
    return matches.select(
        number("id").alias("doc_id"), F.col("id.l").alias("line"), F.col("match").isNull().alias("kept"),
        number("match").alias("match_doc_id"), F.col("match.l").alias("match_line"), "similarity",
        number("class").alias("class_doc_id"), F.col("class.l").alias("class_line"), "links",
    )


def drop_matches(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """The documents, with all their columns, without the lines that have an earlier match.

    ``n_chars``, where the table has it, follows the new text. A document that loses all its lines with words goes;
    documents that had none stay as they are.
    """
    own = in_struct(docs)
    matches = _matches(ordered(own.select("row", "own.doc_id", "own.text")), plan)
    by_row = matches.groupBy(F.col("id.r").alias("row")).agg(F.collect_list(F.when(F.col("match").isNotNull(), F.col("id.l"))).alias("gone"), F.count("*").alias("lines"))
    lost = by_row.where(F.size("gone") > 0)
    joined = own.join(lost, "row", "left").where("gone is null or size(gone) < lines")
    numbers = F.transform(F.split("own.text", "\n"), lambda x, k: F.struct(x.alias("x"), k.alias("k")))
    left = F.transform(F.filter(numbers, lambda s: ~F.array_contains(F.col("gone"), s["k"])), lambda s: s["x"])
    return with_text(joined, F.concat_ws("\n", left), docs, F.col("gone").isNotNull())
