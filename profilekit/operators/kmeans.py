"""k-means with all numbers of clusters and all restarts in one scan per iteration.

Tasks add up counts, sums and costs per fit and cluster, executors sum them where the tasks are many. Coordinates are
rounded to multiples of 2^-20, so the sums are exact and the centres do not depend on how the rows are partitioned.
Fits that have come to rest drop out of the later scans.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, temporary
from .boosting import BLOBS, matrix, parts_of, total

UNIT = float(1 << 20)
#: The rows of least hash from which the first centres are drawn.
SEED_ROWS = 1 << 14
#: Rows that a task compares with a fit's centres at once.
PASS_ROWS = 4096
#: A fit rests when its centres together moved by less (squared).
REST = 1e-4


@dataclass
class Fit:
    """Centres of one restart, and the sum of all rows' squared distances from the nearest of them."""

    restart: int
    centres: np.ndarray
    cost: float = np.inf
    resting: bool = False


def first_centres(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++: each further centre is drawn with a chance that grows with the squared distance from those before."""
    chosen = [points[rng.integers(len(points))]]
    least = np.full(len(points), np.inf)
    while len(chosen) < k:
        least = np.minimum(least, ((points - chosen[-1]) ** 2).sum(axis=1))
        total = least.sum()
        pick = rng.choice(len(points), p=least / total) if total > 0 else rng.integers(len(points))
        chosen.append(points[pick])
    return np.array(chosen)


def squared_distances(columns: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Centres x points of coordinates x points. Added up one coordinate after the other, so that a point's result does not depend on its batch."""
    out = np.zeros((len(centres), columns.shape[1]))
    apart = np.empty_like(out)
    for f, column in enumerate(columns):
        np.subtract(column, centres[:, f, None], out=apart)
        apart *= apart
        out += apart
    return out


def nearest_of(far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per point its nearest centre and how far that is; ties: the first."""
    own, least = np.zeros(far.shape[1], np.int64), far[0]
    for c in range(1, len(far)):
        np.putmask(own, far[c] < least, c)
        least = np.minimum(least, far[c])
    return own, least


def _pass(rows: DataFrame, fits: Sequence[Fit], width: int) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """Per fit: counts, sums and cost with its present centres."""
    centres = [f.centres for f in fits]
    edges = np.cumsum([0, *(len(c) for c in centres)])
    stacked = np.concatenate(centres)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cost = np.zeros(len(stacked)), np.zeros((len(stacked), width)), np.zeros(len(stacked))
        for batch in batches:
            for at in range(0, batch.num_rows, PASS_ROWS):
                points = matrix(batch.column(0).slice(at, PASS_ROWS), width)
                columns, member = np.ascontiguousarray(points.T), np.zeros((len(stacked), len(points)))
                for a, b in zip(edges[:-1], edges[1:]):
                    own, least = nearest_of(squared_distances(columns, stacked[a:b]))
                    n[a:b] += np.bincount(own, minlength=b - a)
                    cost[a:b] += np.bincount(own, np.rint(least * UNIT), b - a)
                    member[a + own, np.arange(len(own))] = 1
                sums += member @ (points * UNIT)  # of whole numbers, so exact in any order
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([np.concatenate([n, cost, sums.ravel()]).tobytes()], pa.binary())], ["m", "sums"])

    size = 8 * len(stacked) * (width + 2)
    whole = total(rows.mapInArrow(add_up, BLOBS), rows.rdd.getNumPartitions(), size)[0]
    n, cost, sums = whole[: len(stacked)], whole[len(stacked) : 2 * len(stacked)] / UNIT, whole[2 * len(stacked) :].reshape(-1, width) / UNIT
    return {i: (n[a:b], sums[a:b], float(cost[a:b].sum())) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:]))}


def fit_all(vectors: DataFrame, wanted: Sequence[tuple[int, int]], seed: int = 42, max_iter: int = 300, key: str = "user_id", vector: str = "features") -> dict[int, Fit]:
    """The fit of least cost for every k; ``wanted`` lists (k, restarts). Ties: the earlier restart.

    ``vectors`` holds arrays of equal length. A cluster that loses all rows keeps its centre. An empty table gives no fit.
    """
    with temporary(vectors.sparkSession):
        rounded = F.transform(vector, lambda x: F.rint(x * UNIT) / UNIT)
        n = vectors.count()
        rows = materialize(vectors.select(key, rounded.alias("x")).repartition(parts_of(n), key), "points")
        sample = rows.orderBy(F.xxhash64(key, F.lit(seed)), key, "x").limit(SEED_ROWS).select("x").toArrow().column(0).combine_chunks()
        if not n:
            return {}
        width = len(sample[0])
        points, rows = matrix(sample, width), rows.select("x").persist(StorageLevel.MEMORY_AND_DISK)
        fits = [(k, Fit(i, first_centres(points, k, np.random.default_rng([seed, k, i])))) for k, restarts in wanted for i in range(restarts)]
        for _ in range(max_iter):
            moving = [f for _, f in fits if not f.resting]
            if not moving:
                break
            for i, (count, sums, _) in _pass(rows, moving, width).items():
                fit = moving[i]
                after = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], fit.centres)
                fit.resting = ((after - fit.centres) ** 2).sum() < REST
                fit.centres = after
        for i, (_, _, cost) in _pass(rows, [f for _, f in fits], width).items():
            fits[i][1].cost = cost
        rows.unpersist()
    best: dict[int, Fit] = {}
    for k, fit in fits:
        if k not in best or fit.cost < best[k].cost:
            best[k] = fit
    return best


def nearest(coordinates: Sequence[Column], centres: np.ndarray) -> Column:
    """Index of the nearest centre as a plain expression; ties: the first."""
    far = F.array(*[sum((c - float(x)) * (c - float(x)) for c, x in zip(coordinates, centre)) for centre in centres])
    return (F.array_position(far, F.array_min(far)) - 1).cast("int")
