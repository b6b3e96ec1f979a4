"""Approximate nearest neighbours by multi-probe p-stable hashing.

A table cuts space by ``functions`` random directions into steps of one width; a vector lies in the
bucket of its steps. A query visits its own bucket and those beside it, in the order of how likely they
hold a near vector (the squared distances to the steps' borders, summed), and what the tables' buckets hold is ranked
by exact distance.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, mix


@dataclass(frozen=True)
class Plan:
    """``width`` is in units of the vectors' root mean square distance from their mean, measured on at most
    ``sample_rows`` vectors; all else covers every row."""

    tables: int = 10
    functions: int = 6
    probes: int = 60
    width: float = 1.5
    sample_rows: int = 2000
    group_rows: int = 20_000
    seed: int = 7


def _directions(plan: Plan, dim: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([plan.seed, dim])
    return rng.normal(size=(dim, plan.tables * plan.functions)), rng.uniform(0, width, plan.tables * plan.functions)


def _bucket(steps: np.ndarray, table: np.ndarray | int) -> np.ndarray:
    """One number for the steps along the last axis."""
    h = np.zeros(steps.shape[:-1], np.uint64) + np.asarray(table, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(steps.shape[-1]):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + steps[..., k].astype(np.int64).astype(np.uint64))
    return h.astype(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def clean(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles), dim. Vectors that are null, zero, empty or hold null or non-finite
    numbers take no part, nor do rows without vec_id; of rows that repeat a vec_id the least vector counts."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    ok = F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("e", lambda v: v != 0)
    table = vectors.select(F.col("vec_id").cast("long"), x.alias("e")).where("vec_id is not null and e is not null").where(ok)
    return table.groupBy("vec_id").agg(F.min("e").alias("embedding")).withColumn("dim", F.size("embedding"))


def _nearest(queries: np.ndarray, q_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, best: dict[int, list]) -> None:
    """Puts the k nearest of ``rows`` for each query into ``best``, in double precision."""
    step = max(1, (1 << 20) // max(1, rows.size))
    for a in range(0, len(queries), step):
        d = np.sqrt(((queries[a : a + step, None, :] - rows[None, :, :]) ** 2).sum(axis=2))
        for i, row in enumerate(d):
            own = int(q_ids[a + i])
            keep = np.flatnonzero(ids != own)
            if len(keep) > k:
                limit = np.partition(row[keep], k - 1)[k - 1]
                keep = keep[row[keep] <= limit]
            have = best.setdefault(own, [])
            have += zip(row[keep].tolist(), ids[keep].tolist())
            if len(have) > 8 * k:
                best[own] = sorted(set(have))[:k]


def _answers(k: int):
    """For co-groups of rows and queries that share buckets."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        best: dict[int, list] = {}
        if rows.num_rows and queries.num_rows:
            bucket = rows.column("bucket").to_numpy()
            order = np.argsort(bucket, kind="stable")
            bucket, ids, x = bucket[order], rows.column("vec_id").to_numpy()[order], _matrix(rows.column("embedding"))[order]
            wanted = queries.column("bucket").to_numpy()
            by = np.argsort(wanted, kind="stable")
            wanted, q_ids, q = wanted[by], queries.column("query_id").to_numpy()[by], _matrix(queries.column("embedding"))[by]
            starts = np.flatnonzero(np.diff(wanted, prepend=wanted[0] - 1))
            for a, b in zip(starts, [*starts[1:], len(wanted)]):
                low, high = np.searchsorted(bucket, wanted[a], "left"), np.searchsorted(bucket, wanted[a], "right")
                if high > low:
                    _nearest(q[a:b], q_ids[a:b], x[low:high], ids[low:high], k, best)
        out = [(q, v, d) for q, have in best.items() for d, v in sorted(set(have))[:k]]
        return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate((("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())))})

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, is_query: str, k: int = 10, plan: Plan = Plan()) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found by Euclidean distance, ties to the smaller vec_id.

    ``is_query`` is an SQL condition on vec_id; every row but the query's own is a candidate. Of equal vectors the k + 1 with the
    smallest ids are looked at, which is all that can be among the k. Vectors of different length
    are never compared. Buckets with more than ``plan.group_rows`` vectors are split, and their
    queries sent to each part. A query that finds fewer than k is compared with all rows, in blocks. An empty table gives
    an empty one; other columns are ignored.
    """
    own = materialize(clean(vectors), "vectors")
    queries = own.where(is_query).select(F.col("vec_id").alias("query_id"), "embedding", "dim")
    copy = F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))
    rows = materialize(own.withColumn("copy", copy).where(F.col("copy") <= k + 1).drop("copy"), "index-rows")
    n = rows.count()
    if not n:
        return own.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    parts = -(-n // plan.group_rows)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("embedding", "dim").limit(plan.sample_rows).collect()
    widths = {}
    for d in {r.dim for r in sample}:
        x = np.array([r.embedding for r in sample if r.dim == d])
        spread = float(np.sqrt(((x - x.mean(axis=0)) ** 2).sum(axis=1).mean()))
        widths[d] = plan.width * (spread or float(np.abs(x).max()))
    usual = widths[max(widths, key=lambda d: sum(r.dim == d for r in sample))]

    def hashed(probes: int):
        ways = np.array(sorted(itertools.product((-1, 0, 1), repeat=plan.functions), key=lambda w: sum(map(abs, w))))

        def run(batches):
            for batch in batches:
                dims = batch.column("dim").to_numpy()
                for d in np.unique(dims):
                    part = batch.filter(pa.array(dims == d))
                    width = widths.get(int(d), usual)
                    a, b = _directions(plan, int(d), width)
                    for at in range(0, part.num_rows, 512):
                        piece = part.slice(at, 512)
                        f = ((_matrix(piece.column("embedding")) @ a + b) / width).reshape(-1, plan.tables, plan.functions)
                        steps = np.floor(f)
                        tables = np.arange(plan.tables)[None, :] + int(d) * 1000
                        if probes == 1:
                            buckets = _bucket(steps, tables)[:, :, None]
                        else:
                            low = f - steps
                            cost = np.einsum("ntk,wk->ntw", low**2, (ways == -1).astype(float)) + np.einsum("ntk,wk->ntw", (1 - low) ** 2, (ways == 1).astype(float))
                            chosen = ways[np.argsort(cost, axis=2, kind="stable")[:, :, :probes]]
                            buckets = _bucket(steps[:, :, None, :] + chosen, tables[:, :, None])
                        m = buckets.shape[1] * buckets.shape[2]
                        yield pa.RecordBatch.from_arrays([
                            piece.column(0).take(pa.array(np.repeat(np.arange(piece.num_rows), m))),
                            pa.array(buckets.reshape(-1)),
                        ], names=[piece.schema.names[0], "bucket"])

        return run

    at = materialize(rows.select("vec_id", "embedding", "dim").mapInArrow(hashed(1), "vec_id long, bucket long"), "buckets")
    asked = queries.mapInArrow(hashed(plan.probes), "query_id long, bucket long")
    heavy = at.groupBy("bucket").count().where(F.col("count") > plan.group_rows).select("bucket", F.ceil(F.col("count") / plan.group_rows).cast("int").alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    part = F.pmod(F.xxhash64("bucket", "salt"), F.lit(parts * plan.tables)).alias("part")
    left = at.join(heavy, "bucket", "left").withColumn("salt", F.pmod(F.xxhash64("vec_id"), salts).cast("int")).join(rows, "vec_id").select(part, "dim", "bucket", "vec_id", "embedding")
    right = asked.join(at.select("bucket").distinct(), "bucket", "left_semi").join(heavy, "bucket", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    right = right.join(queries, "query_id").select(part, "dim", "bucket", "query_id", "embedding")
    schema = "query_id long, vec_id long, score double"
    found = materialize(_top(left.groupBy("part", "dim").cogroup(right.groupBy("part", "dim")).applyInArrow(_answers(k), schema), k), "neighbours")
    # the exact way for queries that found too few
    enough = found.groupBy("query_id").count().where(F.col("count") >= k)
    few = materialize(queries.join(enough, "query_id", "left_anti"), "few")
    if not few.count():
        return found
    block = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).alias("part")
    left = rows.select(block, "dim", F.lit(0).cast("long").alias("bucket"), "vec_id", "embedding")
    right = few.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), "dim", F.lit(0).cast("long").alias("bucket"), "query_id", "embedding")
    exact = _top(left.groupBy("part", "dim").cogroup(right.groupBy("part", "dim")).applyInArrow(_answers(k), schema), k)
    return found.join(few, "query_id", "left_anti").unionByName(exact)
