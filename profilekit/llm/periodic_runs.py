"""Runs of repeated words, found on a grammar of the text.

The words of a chunk of documents are replaced by Re-Pair: pairs that occur often become symbols, round by round, and
the few symbols left of each document are joined pairwise until it is one symbol. So every document is a binary tree,
and equal stretches share subtrees. A run lies wholly below one lowest node and crosses the boundary between its two
parts; these crossing runs are computed once for each distinct symbol, moved to all places where the symbol is derived,
and put together where they overlap.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, mix, utf8, word_hashes

#: A run is at least so long, and at least so many periods.
SHORTEST, POWER = 6, 4
#: Pairs of a boundary and a period that are tried at once.
TRIED = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
FOUND = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"


class Grammar:
    """A binary grammar of several rows of symbols, and every place where one of its pairs is derived.

    ``left``, ``size`` and ``place`` hold for each pair symbol the words of its left part, its words, and the first
    place in the text where it stands; ``symbols`` and ``places`` list all derivations.
    """

    def __init__(self, ids: np.ndarray, row: np.ndarray):
        n_ids = int(ids.max()) + 1 if len(ids) else 0
        self.base = n_ids
        self.known = np.zeros(0, np.int64)  # pairs in order, and their symbols
        self.named = np.zeros(0, np.int64)
        self.left, self.size, self.place = [], [], []
        self.symbols: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.count = n_ids
        seq, at, width = ids.astype(np.int64), np.arange(len(ids)), np.ones(len(ids), np.int64)
        frequent = True
        while len(seq) > 1:
            same = row[at[1:]] == row[at[:-1]]
            if not same.any():
                break
            pair = np.where(same, seq[:-1] << 32 | seq[1:], -1)
            chosen = self._frequent(pair) if frequent else None
            if chosen is None or len(chosen) * 32 < len(seq):
                # pairs that are left occur hardly twice: the rest is joined two by two
                frequent = False
                first = np.concatenate([[True], ~same])
                number = np.arange(len(seq)) - np.maximum.accumulate(np.where(first, np.arange(len(seq)), 0))
                chosen = np.flatnonzero(same & (number[:-1] % 2 == 0))
            symbols = self._symbols(pair[chosen], at[chosen], width[chosen], width[chosen + 1])
            self.symbols.append(symbols)
            self.places.append(at[chosen])
            seq[chosen] = symbols
            width[chosen] += width[chosen + 1]
            keep = np.ones(len(seq), bool)
            keep[chosen + 1] = False
            seq, at, width = seq[keep], at[keep], width[keep]
        joined = (lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64))
        self.left, self.size, self.place = joined(self.left), joined(self.size), joined(self.place)
        self.symbols, self.places = joined(self.symbols) - self.base, joined(self.places)

    @staticmethod
    def _frequent(pair: np.ndarray) -> np.ndarray:
        """Places of pairs that occur twice and more often than the pairs they overlap; of equal ones every second."""
        names, inverse, n = np.unique(pair, return_inverse=True, return_counts=True)
        rank = np.empty(len(names), np.int64)
        rank[np.lexsort((names, n))] = np.arange(1, len(names) + 1)
        rank[(n < 2) | (names < 0)] = 0
        rank = rank[inverse]
        edges = np.flatnonzero(np.diff(rank, prepend=-1))
        number = np.arange(len(rank)) - np.repeat(edges, np.diff(edges, append=len(rank)))
        before, after = np.concatenate([[0], rank[:-1]]), np.concatenate([rank[1:], [0]])
        return np.flatnonzero((rank > 0) & (number % 2 == 0) & (before <= rank) & (after <= rank))

    def _symbols(self, pair: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        names, example, inverse = np.unique(pair, return_index=True, return_inverse=True)
        slot = np.searchsorted(self.known, names)
        new = np.ones(len(names), bool)
        if len(self.known):
            new = self.known[np.minimum(slot, len(self.known) - 1)] != names
        fresh = self.count + np.arange(int(new.sum()))
        self.count += len(fresh)
        e = example[new]
        self.left.append(left[e])
        self.size.append(left[e] + right[e])
        self.place.append(at[e])
        self.known, self.named = np.insert(self.known, slot[new], names[new]), np.insert(self.named, slot[new], fresh)
        return self.named[np.searchsorted(self.known, names)][inverse]


class Equal:
    """How far two places of a text agree, forwards and backwards, by sums of powers over its words."""

    def __init__(self, hashes: np.ndarray):
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(hashes), _BASE)]))
            self.sums = np.zeros(len(hashes) + 1, np.uint64)
            np.cumsum(mix(hashes) * self.power[:-1], out=self.sums[1:])

    def __call__(self, a: np.ndarray, lag: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the ``n`` words from ``a`` are those from ``a + lag``."""
        with np.errstate(over="ignore"):
            return (self.sums[a + n] - self.sums[a]) * self.power[lag] == self.sums[a + lag + n] - self.sums[a + lag]

    def reach(self, a: np.ndarray, lag: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words from ``a`` on (before ``a``, if ``back``) equal those ``lag`` further, ``most`` at most."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        # steps double first, as most reaches are short
        step, open_ = 1, np.arange(len(a))
        while len(open_):
            n = np.minimum(step, high[open_])
            fits = self(a[open_] - n if back else a[open_], lag[open_], n)
            low[open_[fits]] = n[fits]
            high[open_[~fits]] = n[~fits] - 1
            open_ = open_[fits & (n < high[open_])]
            step *= 2
        while len(open_ := np.flatnonzero(low < high)):
            n = (low[open_] + high[open_] + 1) // 2
            fits = self(a[open_] - n if back else a[open_], lag[open_], n)
            low[open_[fits]] = n[fits]
            high[open_[~fits]] = n[~fits] - 1
        return low


def crossing(grammar: Grammar, equal: Equal) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """symbol, start and end within it, and least period of all runs that cross a symbol's boundary.

    A run of four periods has two of them on one side of the boundary. So a period is tried if the words beside the
    boundary return after it, and then extended to both sides as far as the symbol goes.
    """
    found: list[tuple[np.ndarray, ...]] = []
    long_ = np.flatnonzero(grammar.size >= SHORTEST)
    most = grammar.size[long_] // POWER
    ends = np.cumsum(most)
    done = 0
    while done < len(long_):
        to = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + TRIED, side="right")))
        part, n = long_[done:to], most[done:to]
        done = to
        symbol = np.repeat(part, n)
        lag = np.arange(len(symbol)) - np.repeat(np.cumsum(n) - n, n) + 1
        begin = grammar.place[symbol]
        cut, end = begin + grammar.left[symbol], begin + grammar.size[symbol]
        word = np.minimum(lag, 16)
        for back in (False, True):
            # two periods right of the boundary, or two left of it
            a = cut - 2 * lag if back else cut
            inside = (a >= begin) if back else (cut + 2 * lag <= end)
            k = np.flatnonzero(inside)
            k = k[equal(a[k], lag[k], word[k])]
            k = k[equal(a[k], lag[k], lag[k])]
            start = a[k] - equal.reach(a[k], lag[k], a[k] - begin[k], back=True)
            stop = a[k] + 2 * lag[k] + equal.reach(a[k] + lag[k], lag[k], end[k] - a[k] - 2 * lag[k])
            good = (stop - start >= np.maximum(SHORTEST, POWER * lag[k])) & (start < cut[k]) & (stop > cut[k])
            k = k[good]
            found.append((symbol[k], start[good] - begin[k], stop[good] - begin[k], lag[k]))
    symbol, start, stop, lag = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
    # a multiple of the least period reaches equally far
    order = np.lexsort((lag, stop, start, symbol))
    symbol, start, stop, lag = symbol[order], start[order], stop[order], lag[order]
    first = np.ones(len(symbol), bool)
    first[1:] = (np.diff(symbol) != 0) | (np.diff(start) != 0) | (np.diff(stop) != 0)
    return symbol[first], start[first], stop[first], lag[first]


def plain_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs of one text by comparing it with itself at every distance; in the order of start and period."""
    least: dict[tuple[int, int], int] = {}
    for lag in range(1, len(words) // POWER + 1):
        same = np.concatenate([[False], words[:-lag] == words[lag:], [False]])
        edges = np.flatnonzero(np.diff(same))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a + lag >= max(SHORTEST, POWER * lag):
                least.setdefault((a, b - a + lag), lag)
    return sorted((a, n, lag) for (a, n), lag in least.items())


def text_runs(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length and period of all runs in several texts; ``row`` says for each word which text it is of.

    Starts count over all words. The result is in the order of start and period.
    """
    none = (np.zeros(0, np.int64),) * 3
    if len(hashes) < SHORTEST:
        return none
    grammar = Grammar(np.unique(hashes, return_inverse=True)[1], row)
    symbol, start, stop, lag = crossing(grammar, Equal(hashes))
    if not len(symbol):
        return none
    # to all places where the symbols are derived
    wanted = np.zeros(len(grammar.size), bool)
    wanted[symbol] = True
    use = wanted[grammar.symbols]
    symbols, places = grammar.symbols[use], grammar.places[use]
    low, high = np.searchsorted(symbol, symbols), np.searchsorted(symbol, symbols, side="right")
    n = high - low
    run = np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    place = np.repeat(places, n)
    start, stop, lag = place + start[run], place + stop[run], lag[run]
    # parts of one run have its period and overlap by that much at least
    order = np.lexsort((stop, start, lag))
    start, stop, lag = start[order], stop[order], lag[order]
    fresh = np.ones(len(start), bool)
    group = np.cumsum(np.diff(lag, prepend=0) != 0) * (2 * len(hashes))
    reach = np.maximum.accumulate(stop + group) - group
    fresh[1:] = (np.diff(lag) != 0) | (start[1:] > reach[:-1] - lag[1:])
    head = np.flatnonzero(fresh)
    start, stop, lag = start[head], np.maximum.reduceat(stop, head), lag[head]
    order = np.lexsort((lag, start))
    start, stop, lag = start[order], stop[order], lag[order]
    wrong = _wrong(hashes, row, start, stop, lag)
    if len(wrong):  # two different stretches had one hash: their texts are compared word by word
        bad = np.unique(row[start[wrong]])
        good = ~np.isin(row[start], bad)
        parts = [np.stack([start[good], stop[good] - start[good], lag[good]])]
        for r in bad.tolist():
            at = int(np.searchsorted(row, r))
            parts.append(np.array([(s + at, n, p) for s, n, p in plain_runs(hashes[row == r])], np.int64).reshape(-1, 3).T)
        start, length, lag = np.concatenate(parts, axis=1)
        order = np.lexsort((lag, start))
        return start[order], length[order], lag[order]
    return start, stop - start, lag


def _wrong(hashes: np.ndarray, row: np.ndarray, start: np.ndarray, stop: np.ndarray, lag: np.ndarray) -> np.ndarray:
    """Those runs that do not repeat word by word, or could go on."""
    n = stop - start - lag
    first = np.cumsum(n) - n
    out = np.zeros(len(start), bool)
    for at in range(0, len(start), 1 << 14):
        k = slice(at, at + (1 << 14))
        i = np.repeat(start[k] - (first[k] - first[k][0]), n[k]) + np.arange(int(n[k].sum()))
        same = hashes[i] == hashes[i + np.repeat(lag[k], n[k])]
        out[k] = ~np.logical_and.reduceat(same, first[k] - first[k][0])
    before, last = np.maximum(start - 1, 0), len(hashes) - 1
    out |= (start > 0) & (row[before] == row[start]) & (hashes[before] == hashes[before + lag])
    after = np.minimum(stop, last)
    out |= (stop <= last) & (row[after] == row[start]) & (hashes[after] == hashes[after - lag])
    return np.flatnonzero(out)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (struct of start, length, period; by start, then period) and the collapsed text's bytes.

    A run is a longest stretch of words that repeats with its least period, at least four times and over six words.
    The collapsed text holds the words that no run contains after its first period, joined by one space. Words are
    what lies between space, tab and the line breaks \\x0A to \\x0D. Documents are worked on whole, in chunks of about
    1 MB or one longer document; nothing is shuffled. Null and empty texts have no words, no runs and an empty collapsed
    text; repeated rows are each a row of the result; an empty table gives an empty one; columns but doc_id and text
    are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            texts = part.column("text").to_pylist()
            whole = b"\n".join(texts)
            starts, hashes = word_hashes(np.frombuffer(whole, np.uint8))
            begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
            row = np.searchsorted(begins, starts, side="right") - 1
            n_words = np.bincount(row, minlength=len(texts))
            first = np.cumsum(n_words) - n_words
            start, length, period = text_runs(hashes, row)
            dropped = np.zeros(len(hashes) + 1, np.int64)
            np.add.at(dropped, start + period, 1)
            np.add.at(dropped, start + length, -1)
            kept = np.cumsum(dropped[:-1]) == 0
            of = row[start]
            edges = np.searchsorted(of, np.arange(len(texts) + 1))
            own = start - first[of]
            collapsed = []
            for k, text in enumerate(texts):
                words = text.split()
                if edges[k] < edges[k + 1]:
                    words = compress(words, kept[first[k] : first[k] + n_words[k]])
                collapsed.append(b" ".join(words))
            entries = pa.StructArray.from_arrays([pa.array(own), pa.array(length), pa.array(period)], ["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), entries)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words), runs, pa.array(collapsed, pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), utf8().alias("text")).mapInArrow(run, FOUND)


def greatest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; ties: the least start, then period. Null if there is none."""

    def better(best: Column, run: Column) -> Column:
        a, b = run["length"] * best["period"], best["length"] * run["period"]
        return F.when(best.isNull() | (a > b), run).otherwise(best)

    # runs come by start and period, so the first of equals is the one wanted
    return F.aggregate(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"), better)


def digest(found: DataFrame) -> DataFrame:
    """The greatest run of each document, and checksums of all its runs and of its collapsed text."""
    best = found.withColumn("_best", greatest(F.col("runs")))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"), F.col("_best.length").alias("length"),
        F.col("_best.period").alias("period"), F.expr("_best.length * 1000 div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the documents (by a checksum of their ids) end in a repeated stretch.

    With h = crc32(doc_id), g = h / 10 rounded down and n words: if 10 divides h and n > 0, word i >= a becomes word
    a + (i - a) % p, for a = g % n and p = 1 + (n - a) / (3 + g % 8) rounded down.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    hit = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), h.alias("_h")).withColumn("_g", F.expr("_h div 10"))
    words = hit.withColumn("_w", F.when(F.col("_h") % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")))
    placed = words.withColumn("_n", F.size("_w")).withColumn("_a", F.expr("if(_n > 0, _g % _n, 0)"))
    placed = placed.withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    repeated = F.expr("array_join(transform(_w, (w, i) -> if(i < _a, w, get(_w, cast(_a + (i - _a) % _p as int)))), ' ')")
    return placed.select("doc_id", F.when(F.col("_n") > 0, repeated).otherwise(F.col("text")).alias("text"))
