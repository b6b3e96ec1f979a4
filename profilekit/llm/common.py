"""Helpers of the corpus operators: words and shingles as 64-bit numbers, chunked batches, shared tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session

#: Texts are worked on in pieces of about so many bytes, so that memory in a task does not follow the batch.
CHUNK_BYTES = 1 << 20
#: Words are runs of other characters than these.
SPACES = b" \t\n\x0b\x0c\r"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
with np.errstate(over="ignore"):
    _BYTE = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(0xA5A3564E27F3C1B7)
    _BYTE ^= _BYTE >> np.uint64(29)
    _BYTE *= np.uint64(0xBF58476D1CE4E5B9)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back; what its stages shuffled is deleted as soon as it is written."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return session.materialize(df, name, keep)
    finally:
        conf.set(key, before)


def numbered(docs: DataFrame, name: str = "row") -> DataFrame:
    """``docs`` with a number for each row, written once: ids by partition change when a later scan splits the files in another way."""
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")


def in_struct(docs: DataFrame) -> DataFrame:
    """``row`` and ``own``, all columns of ``docs`` in one struct, so that no working column meets one of theirs; written once."""
    return materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")), "numbered")


def with_text(rows: DataFrame, text: Column, docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """The columns of ``docs`` from ``own``, with another text where it ``changed``; ``n_chars``, where the table has it, follows the text."""
    new = {"text": text.cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    if changed is not None:
        new = {c: F.when(changed, x).otherwise(F.col("own")[c]) for c, x in new.items()}
    return rows.select(*[new.get(c, F.col("own")[c]).alias(c) for c in docs.columns])


def utf8(column: str = "text") -> Column:
    """The text's bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers (the splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches, each with about CHUNK_BYTES in the binary or string ``column`` (one row at least)."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + CHUNK_BYTES, side="right")))
            yield batch.slice(at, to - at)
            at = to


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes: differences of a running polynomial sum, moved to the same power."""
    if len(_POWERS[0]) < len(data) + 1:
        n = 1 << max(20, len(data).bit_length())
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64)))):
                _POWERS[k] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base)]))
    up, down = _POWERS
    with np.errstate(over="ignore"):
        running = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=running[1:])
        return mix((running[ends] - running[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offset and hash of every word in an array of bytes."""
    inside = ~_IS_SPACE[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    return edges[::2], spans(data, edges[::2], edges[1::2])


def lower_joined(texts: list[bytes], sep: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """All texts in lower case in one array of bytes, ``sep`` between them; and where each begins."""
    lowered = [t.decode("utf-8", "replace").lower().encode() for t in texts]
    lengths = np.array([len(t) + len(sep) for t in lowered], np.int64)
    return np.frombuffer(sep.join(lowered), np.uint8), np.cumsum(lengths) - lengths


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; of all words, if there are fewer."""
    if len(words) == 0:
        return words
    n = max(1, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(size, len(words))):
            out = (out + words[k : k + n]) * _BASE
    return mix(out)
