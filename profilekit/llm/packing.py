"""Best-fit packing with certified bin counts.

Pieces are dealt at random into groups; each group is packed by best-fit decreasing, and a
dual-feasible-function bound says how many sequences it needs at least. In groups that use more
than their bound, sequences with room are opened, their pieces are pooled with those of another
such group, and best-fit decreasing runs again; the new packing stays if it needs fewer sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from . import tokens
from .common import materialize, utf8

CAPACITY = 2048
#: Pieces in a group, about; a group is one task's work.
GROUP_PIECES = 60_000
ROUNDS = 4


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: the best of two families of dual-feasible functions.

    f_t counts lengths above capacity - t as a whole sequence and drops those below t; u_k rounds
    multiples of capacity / (k + 1) down to k-ths. The sum of a dual-feasible function over the
    lengths, in units of the capacity, is a bound.
    """
    if not len(lengths):
        return 0
    n = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1]
    size = np.arange(capacity + 1)
    best = -(-int(n @ size) // capacity)
    weight = np.cumsum(n * size)
    count = np.cumsum(n)
    for t in range(1, capacity // 2 + 1):
        large = int(count[-1] - count[capacity - t])
        middle = int(weight[capacity - t] - weight[t - 1])
        best = max(best, large + -(-middle // capacity))
    for k in range(1, 21):
        scaled = (k + 1) * size
        exact = scaled % capacity == 0
        value = np.where(exact, size * k, scaled // capacity * capacity)  # in units of k * capacity
        best = max(best, -(-int(n @ value) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of every piece, and the number of sequences.

    Sequences wait in lists by their room; a bit set over rooms finds the least that suffices.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, n = 0, 0
    for i, length in zip(order.tolist(), lengths[order].tolist()):
        fit = rooms >> length
        if length and fit:
            room = length + ((fit & -fit).bit_length() - 1)
            b = waiting[room].pop()
            if not waiting[room]:
                rooms &= ~(1 << room)
        else:
            b, room, n = n, capacity, n + 1
        bins[i], offsets[i] = b, capacity - room
        left = room - length
        if left:
            waiting[left].append(b)
            rooms |= 1 << left
    return bins, offsets, n


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's pieces.

    A document longer than ``capacity`` is cut into pieces of that length, the first one shorter if
    it does not divide. Null text counts as empty: such a document is the end id alone.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer, end_id).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, counts = encode(part.column("text").to_pylist())
                n = -(-counts // capacity)
                of = np.repeat(np.arange(len(counts)), n)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                first = counts - (n - 1) * capacity
                length = np.where(piece == 0, first[of], capacity)
                start = np.where(piece == 0, 0, first[of] + (piece - 1) * capacity)
                begin = (np.cumsum(counts) - counts)[of] + start
                data = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist())]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id").take(pa.array(of)), "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64()),
                })

    return docs.select(F.col("doc_id").cast("long"), utf8().alias("text")).mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def pack(cut: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """Adds sequence_id, offset, and of the piece's last group: bins, bound, and ``certified`` (they are equal).

    ``cut`` has a long column ``length`` between 1 and ``capacity``; other columns are kept. Equal rows are packed each on its
    own. An empty table gives an empty one. Groups hold about ``group_pieces`` rows, dealt by a hash
    of the row, so no document, source or length is gathered in one group. Sequence ids are
    round, group and bin in one number; a piece of full length is a sequence of its own with a negative id.
    """
    own = cut.columns
    full = cut.where(F.col("length") >= capacity).withColumns({
        "sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"),
        "bins": F.lit(1).cast("long"), "bound": F.lit(1).cast("long"), "certified": F.lit(True),
    })
    n = cut.where(F.col("length") < capacity).count()
    groups = max(1, -(-n // group_pieces))
    dealt = cut.where(F.col("length") < capacity).withColumn("_group", F.pmod(F.xxhash64(*own, F.monotonically_increasing_id()), F.lit(groups)))
    schema = StructType([*dealt.schema.fields]).add("sequence_id", "long").add("offset", "long").add("bins", "long").add("bound", "long").add("certified", "boolean").add("_open", "boolean")
    arrow = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema])

    def run(number: int):
        def fit(group: pa.Table) -> pa.Table:
            lengths = group.column("length").to_numpy()
            bins, offsets, n_bins = best_fit_decreasing(lengths, capacity)
            bound = lower_bound(lengths, capacity)
            base = (number * (1 << 30) + int(group.column("_group")[0].as_py())) << 24
            ids = bins + base
            if "sequence_id" in group.column_names:  # repacked: the old packing stays unless this one is shorter
                was = group.column("sequence_id").to_numpy()
                before = len(np.unique(was))
                if before <= n_bins:
                    ids, offsets, n_bins = was, group.column("offset").to_numpy(), before
                    _, bins = np.unique(was, return_inverse=True)
            fill = np.bincount(bins, weights=lengths, minlength=1)
            more = {
                "sequence_id": ids, "offset": offsets, "bins": np.full(len(ids), n_bins), "bound": np.full(len(ids), bound),
                "certified": np.full(len(ids), n_bins == bound), "_open": (n_bins > bound) & (fill[bins] < capacity),
            }
            return pa.table([group.column(f.name) if f.name not in more else pa.array(more[f.name], f.type) for f in arrow], schema=arrow)

        return fit

    packed = materialize(dealt.groupBy("_group").applyInArrow(run(0), schema), "packed")
    done = [packed.where("not _open")]
    for k in range(1, rounds + 1):
        groups = -(-groups // 2)
        rest = packed.where("_open").withColumn("_group", F.pmod(F.xxhash64("_group", F.lit(k)), F.lit(groups)))
        packed = materialize(rest.groupBy("_group").applyInArrow(run(k), schema), "packed")
        done.append(packed.where("not _open"))
        if groups == 1:
            break
    done.append(packed.where("_open"))
    columns = [*own, "sequence_id", "offset", "bins", "bound", "certified"]
    return reduce(DataFrame.unionByName, [full.select(columns), *(d.select(columns) for d in done)])


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenizes, cuts and packs all documents."""
    return pack(materialize(pieces(docs, tokenizer, capacity), "pieces"), capacity)
