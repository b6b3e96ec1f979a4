"""Token ids in files of fixed-width bit fields, with block offsets for random access.

A file holds the ids of whole documents in order: a magic word, blocks of BLOCK_IDS ids with
``width`` bits each (least significant bit first; a block begins on a byte), then a footer with the
documents' ids and token counts and the offset of every block, and last the footer's length. The
width is the least that holds every id of the vocabulary.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import scratch_path
from . import tokens
from .common import materialize, utf8

MAGIC = b"bits0001"
BLOCK_IDS = 1 << 14
NO_ID = -(1 << 63)


def width_for(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Bit fields of ``width`` bits, least significant bit first."""
    bits = (ids[:, None] >> np.arange(width, dtype=np.uint32)).astype(np.uint8) & 1
    return np.packbits(bits.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    """The first ``n`` ids of a packed block."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", count=n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return bits.astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))


class Writer:
    """Appends documents to one file; holds one unfilled block and the footer's numbers."""

    def __init__(self, sink, width: int):
        self.sink, self.width = sink, width
        self.open, self.n_open = [], 0
        self.docs: list[int] = []
        self.counts: list[int] = []
        self.offsets: list[int] = []
        self.at = len(MAGIC)
        sink.write(MAGIC)

    def _block(self, ids: np.ndarray) -> None:
        data = ids.astype(f"<u{self.width // 8}").tobytes() if self.width in (8, 16, 32) else pack(ids, self.width)
        self.offsets.append(self.at)
        self.sink.write(data)
        self.at += len(data)

    def add(self, doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> None:
        self.docs += [NO_ID if d is None else d for d in doc_ids]
        self.counts += counts.tolist()
        self.open.append(ids)
        self.n_open += len(ids)
        if self.n_open >= BLOCK_IDS:
            held = np.concatenate(self.open)
            full = len(held) // BLOCK_IDS * BLOCK_IDS
            for k in range(0, full, BLOCK_IDS):
                self._block(held[k : k + BLOCK_IDS])
            self.open, self.n_open = [held[full:]], len(held) - full

    def close(self) -> None:
        if self.n_open:
            self._block(np.concatenate(self.open))
        head = json.dumps({"width": self.width, "block": BLOCK_IDS, "docs": len(self.docs), "blocks": len(self.offsets), "ids": sum(self.counts)}).encode()
        footer = b"".join([struct.pack("<I", len(head)), head, np.array(self.docs, "<i8").tobytes(), np.array(self.counts, "<i8").tobytes(), np.array(self.offsets, "<i8").tobytes()])
        self.sink.write(footer + struct.pack("<Q", len(footer)))


class Reader:
    """Random access to one file: ``ids(start, stop)`` reads only the blocks that hold them."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 8)
        (n,) = struct.unpack("<Q", source.read(8))
        source.seek(size - 8 - n)
        footer = source.read(n)
        self.data_end = size - 8 - n
        (h,) = struct.unpack_from("<I", footer)
        head = json.loads(footer[4 : 4 + h])
        self.width, self.block, self.n_ids = head["width"], head["block"], head["ids"]
        at, d = 4 + h, head["docs"]
        self.docs = np.frombuffer(footer, "<i8", d, at)
        self.counts = np.frombuffer(footer, "<i8", d, at + 8 * d)
        self.offsets = np.frombuffer(footer, "<i8", head["blocks"], at + 16 * d)

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        begin = int(self.offsets[first])
        end = int(self.offsets[last + 1]) if last + 1 < len(self.offsets) else self.data_end
        self.source.seek(begin)
        data = self.source.read(end - begin)
        out = []
        for k in range(first, last + 1):
            n = min(self.block, self.n_ids - k * self.block)
            a = int(self.offsets[k]) - begin
            out.append(unpack(data[a : a + (n * self.width + 7) // 8], self.width, n))
        return np.concatenate(out)[start - first * self.block : stop - first * self.block]


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Writes the ids of ``docs`` (doc_id, text) into files below ``folder``, and returns the list of files.

    The files' order (``shard``), and the order in each, is by doc_id: null ids first, equal ids by
    the hash of their text. Null texts count as empty; every document gets ``end_id`` at its end. Other columns
    are ignored. A task writes under a name of its own and the list, itself a written table, holds
    the files of the tasks that ended well; what a lost task left is never read. An empty table
    gives no file.
    """
    from tokenizers import Tokenizer

    width = width_for(Tokenizer.from_file(tokenizer).get_vocab_size())
    text = F.coalesce("text", F.lit(""))
    ordered = (
        docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("_tie"), utf8().alias("text"))
        .repartitionByRange("doc_id", "_tie")
        .sortWithinPartitions("doc_id", "_tie")
    )

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer, sink = tokens.encoder(tokenizer, end_id).encode, None, None
        number = TaskContext.get().partitionId()
        path = f"{folder.rstrip('/')}/ids-{number:06d}-{uuid.uuid4().hex}.bits"
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, counts = encode(part.column("text").to_pylist())
                if writer is None:
                    fs, inner = pafs.FileSystem.from_uri(path)
                    fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                    sink = fs.open_output_stream(inner)
                    writer = Writer(sink, width)
                writer.add(part.column("doc_id").to_pylist(), counts, ids)
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([number], pa.int64()), "path": [path], "n_docs": pa.array([len(writer.docs)], pa.int64()), "n_ids": pa.array([sum(writer.counts)], pa.int64())})

    return materialize(ordered.mapInArrow(shard, "shard long, path string, n_docs long, n_ids long"), "ids-list")


def read_back(files: DataFrame) -> DataFrame:
    """One row per document out of the files: doc_id, start (ids before it), n_tokens, ids_crc32, shard."""
    starts = files.withColumn("start", F.coalesce(F.sum("n_ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    n = max(1, files.count())

    def docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, inner = pafs.FileSystem.from_uri(row["path"])
                with fs.open_input_file(inner) as source:
                    reader = Reader(source)
                    ends = np.cumsum(reader.counts)
                    at = 0
                    while at < len(ends):  # a few blocks' worth of documents at a time
                        base = int(ends[at - 1]) if at else 0
                        to = max(at + 1, int(np.searchsorted(ends, base + 16 * BLOCK_IDS, side="right")))
                        data = memoryview(reader.ids(base, int(ends[to - 1])).astype("<u4").tobytes())
                        cut = np.concatenate([[0], ends[at:to] - base]) * 4
                        crc = [zlib.crc32(data[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
                        ids = reader.docs[at:to]
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array(ids, mask=ids == NO_ID), "start": pa.array(row["start"] + base + cut[:-1] // 4),
                            "n_tokens": pa.array(reader.counts[at:to]), "ids_crc32": pa.array(crc, pa.int64()),
                            "shard": pa.array(np.full(to - at, row["shard"])),
                        })
                        at = to

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, shard long"
    return starts.repartitionByRange(n, "shard").mapInArrow(docs, schema)


def encode_and_read(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Writes the files below the shared scratch folder and reads the documents back."""
    return read_back(write(docs, scratch_path(docs.sparkSession, "ids"), tokenizer, end_id))
