"""Sum-of-squares online packing: every task packs its documents as they come, and nothing is shuffled.

A level array counts the open windows by their fill. A document goes to the fill level for which the sum of the
squared counts becomes least, a new window being one of the choices; so no level collects many windows, and most
windows are filled to the last id by whole documents. What is still open at the end of a task is topped up by
cutting the emptiest windows' documents, and the very last ids become sequences whose lengths are powers of two.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, chunks, spans, utf8, word_hashes

CAPACITY = 4096
END_ID = 2
#: Ids that a task holds in open windows at most; beyond that all of them are settled and the levels start anew.
HELD_IDS = 1 << 22
#: Distinct words remembered in a worker at most; the memory is emptied beyond that.
MEMORY_WORDS = 1 << 21

#: A piece: document, its place among the document's ids, the ids, and how many the document has.
Piece = tuple[object, int, np.ndarray, int]

#: Bytes by kind: 0 white space, 1 ASCII letters, 2 other ASCII, 3 the rest.
_KIND = np.full(256, 3, np.uint8)
_KIND[:128] = [0 if b in SPACES else 1 if chr(b).isalpha() else 2 for b in range(128)]

PACKED = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class WordEncoder:
    """Ids of whole texts, equal to the library's own, for tokenizers that drop white space and never join across it.

    Each distinct word is encoded once by the library; words are told apart by a 64-bit hash. A word is a run without
    ASCII white space, cut once more between an ASCII letter and another ASCII character after it, where such
    tokenizers cut as well. An added token lies in one run without white space, which is then left whole. ``end_id`` follows every text, an empty
    one too.
    """

    def __init__(self, path: str, end_id: int = END_ID, memory: int = MEMORY_WORDS):
        from tokenizers import Tokenizer

        self.library, self.end_id, self.memory = Tokenizer.from_file(path), end_id, memory
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        # the last token of a unit ends with the suffix of the vocabulary
        suffix = self.library.model.end_of_word_suffix
        self.closing = np.zeros(self.library.get_vocab_size() + 1, bool)
        self.closing[[i for token, i in self.library.get_vocab().items() if suffix and token.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _unknown(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.arange(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.flatnonzero(self.keys[at] != keys)

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        """Encodes the words: those of letters alone are one unit each, so they go in rows that are cut at the ends of units."""
        found: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(words)
        texts = [w.decode() for w in words]
        alone = [i for i, t in enumerate(texts) if not t.isalpha()]
        plain = [i for i, t in enumerate(texts) if t.isalpha()]
        rows = [plain[k : k + 500] for k in range(0, len(plain), 500)]
        for row, x in zip(rows, self._library_ids([" ".join(texts[i] for i in row) for row in rows])):
            ends = np.flatnonzero(self.closing[x]) + 1
            if len(ends) == len(row):
                for i, part in zip(row, np.split(x, ends[:-1])):
                    found[i] = part
            else:  # a letter whose lower case is no letter alone
                alone += row
        for i, x in zip(alone, self._library_ids([texts[i] for i in alone])):
            found[i] = x
        at = np.searchsorted(self.keys, keys)
        self.slots = np.insert(self.slots, at, len(self.ends) - 1 + np.arange(len(keys)))
        self.keys = np.insert(self.keys, at, keys)
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(x) for x in found])])
        self.ids = np.concatenate([self.ids, *found])

    def _library_ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, the end id after each, and how many belong to each text."""
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        whole = b"\n".join([*texts, b""])
        data = np.frombuffer(whole, np.uint8)
        kind = _KIND[data]
        inside = kind > 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | ((kind[:-1] == 1) & (kind[1:] == 2))
        closes = inside.copy()  # every text ends in a line break, so the last byte is none of a word
        closes[:-1] &= ~inside[1:] | begins[1:]
        starts, stops = np.flatnonzero(begins), np.flatnonzero(closes) + 1
        hashes = spans(data, starts, stops)
        if any(a in whole for a in self.added):
            starts, stops, hashes = self._with_added(whole, starts, stops, hashes)
        of = np.searchsorted(np.cumsum(lengths), starts, side="right")
        keys, example, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        new = self._unknown(keys)
        if len(new) and len(self.keys) > self.memory:
            self._forget()
            new = np.arange(len(keys))
        if len(new):
            e = example[new]
            self._learn(keys[new], [whole[a:b] for a, b in zip(starts[e].tolist(), stops[e].tolist())])
        slots = self.slots[np.searchsorted(self.keys, keys)][inverse]
        begin, n = self.ends[slots], self.ends[slots + 1] - self.ends[slots]
        # every word's ids, and after the words of a text its end id
        counts = np.bincount(of, weights=n, minlength=len(texts)).astype(np.int64) + 1
        out = np.full(int(counts.sum()), self.end_id, np.uint32)
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        within = np.arange(total)
        out[within + np.repeat(of, n)] = self.ids[np.repeat(begin - (ends - n), n) + within]
        return out, counts

    def _with_added(self, whole: bytes, starts: np.ndarray, stops: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words cut at white space only, where one of them holds an added token."""
        words, word_hash = word_hashes(np.frombuffer(whole, np.uint8))
        ends = np.append(words[1:], len(whole))
        kept = np.zeros(len(words), bool)
        for a in self.added:
            at = whole.find(a)
            while at >= 0:
                kept[np.searchsorted(words, at, side="right") - 1] = True
                at = whole.find(a, at + 1)
        outside = ~kept[np.searchsorted(words, starts, side="right") - 1]
        long_ = [len(whole[a:b].split(None, 1)[0]) for a, b in zip(words[kept].tolist(), ends[kept].tolist())]
        order = np.argsort(np.concatenate([starts[outside], words[kept]]), kind="stable")
        return (
            np.concatenate([starts[outside], words[kept]])[order],
            np.concatenate([stops[outside], words[kept] + np.array(long_, np.int64)])[order],
            np.concatenate([hashes[outside], word_hash[kept]])[order],
        )


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int = END_ID) -> WordEncoder:
    """One encoder for each worker process."""
    return WordEncoder(path, end_id)


class Levels:
    """Open windows by fill; ``place`` returns a window once it is full."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.clear()

    def clear(self) -> None:
        # moving a window from fill h to h + s changes the sum of squares by 2 (count[h + s] - count[h] + 1); the
        # constants at both ends make the same difference right for a new window and for one that becomes full
        self.count = np.zeros(self.capacity + 1)
        self.count[0], self.count[-1] = 0.5, -0.5
        self.start = np.full(self.capacity + 1, -np.inf)  # count where a window can be taken from
        self.start[0] = 0.5
        self.windows: list[list[list[Piece]]] = [[] for _ in range(self.capacity)]
        self.held = 0

    def place(self, piece: Piece) -> list[Piece] | None:
        """Puts a piece of less than the capacity where the sum of squares becomes least; ties: the fullest."""
        size = len(piece[2])
        change = self.count[size:] - self.start[: self.capacity + 1 - size]
        level = len(change) - 1 - int(np.argmin(change[::-1]))
        window = self.windows[level].pop() if level else []
        window.append(piece)
        if level:
            self._set(level)
        if level + size == self.capacity:
            self.held -= level
            return window
        self.windows[level + size].append(window)
        self._set(level + size)
        self.held += size
        return None

    def _set(self, level: int) -> None:
        n = len(self.windows[level])
        self.count[level] = n
        self.start[level] = n or -np.inf

    def settle(self) -> list[list[Piece]]:
        """Closes all open windows: the emptiest ones' pieces are cut to fill the fullest ones, and what is left at
        last is cut into sequences whose lengths are powers of two."""
        order = [w for level in range(self.capacity - 1, 0, -1) for w in self.windows[level]]
        room = [self.capacity - sum(len(p[2]) for p in w) for w in order]
        self.clear()
        low, high = 0, len(order) - 1
        while low < high:
            while room[low] and low < high:
                doc, start, ids, total = order[high].pop()
                cut = min(room[low], len(ids))
                order[low].append((doc, start, ids[:cut], total))
                room[low] -= cut
                if cut < len(ids):
                    order[high].append((doc, start + cut, ids[cut:], total))
                room[high] += cut
                if not order[high]:
                    high -= 1
            if not room[low]:
                low += 1
        done = order[:low]
        if low <= high and order[low]:
            left, rest = order[low], self.capacity - room[low]
            for bit in reversed(range(rest.bit_length())):
                if rest >> bit & 1:
                    part, left = _split(left, 1 << bit)
                    done.append(part)
        return done


def _split(pieces: list[Piece], size: int) -> tuple[list[Piece], list[Piece]]:
    """The first ``size`` ids of a row of pieces, and the others."""
    head: list[Piece] = []
    for i, (doc, start, ids, total) in enumerate(pieces):
        if len(ids) > size:
            if size:
                head.append((doc, start, ids[:size], total))
            return head, [(doc, start + size, ids[size:], total), *pieces[i + 1 :]]
        head.append((doc, start, ids, total))
        size -= len(ids)
    return head, []


def pack_online(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, held_ids: int = HELD_IDS
) -> DataFrame:
    """The pieces of all documents with their ids (little-endian unsigned 32-bit), sequence and offset.

    A document of ``capacity`` ids or more is cut into whole sequences and a rest; the rest, like every shorter
    document, is placed by sum of squares. Every sequence is full or as long as a power of two, so none is padded.
    A task holds ``held_ids`` ids in open windows at most; beyond that it settles them all and goes on, so its memory
    follows neither the table nor a length at which windows cannot be filled. Sequence ids hold the task's partition.

    Null and empty texts are the end id alone; equal rows are packed each on its own; a null doc_id is kept; an empty
    table gives an empty one. Columns but doc_id and text are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        levels, rows, size = Levels(capacity), [], 0

        def close(window: list[Piece]) -> None:
            nonlocal number, size
            offset = 0
            for doc, start, ids, total in window:
                rows.append((doc, start, len(ids), ids.tobytes(), total, number, offset))
                offset += len(ids)
            number, size = number + 1, size + offset

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for part in chunks(batches):
            ids, counts = encoder(tokenizer, end_id).encode(part.column("text").to_pylist())
            ends = np.cumsum(counts)
            for doc, at, n in zip(part.column("doc_id").to_pylist(), (ends - counts).tolist(), counts.tolist()):
                own = ids[at : at + n].astype("<u4")  # a copy, so that an open window does not hold its whole chunk
                for start in range(0, n - capacity + 1, capacity):
                    close([(doc, start, own[start : start + capacity], n)])
                rest = n - n % capacity
                if rest < n:
                    full = levels.place((doc, rest, own[rest:] if not rest else own[rest:].copy(), n))
                    if full:
                        close(full)
                    if levels.held > held_ids:
                        for window in levels.settle():
                            close(window)
                if size > 1 << 18:
                    yield batch()
                    size = 0
        for window in levels.settle():
            close(window)
        yield batch()

    return docs.select(F.col("doc_id").cast("long"), utf8().alias("text")).mapInArrow(run, PACKED)


def digest(packed: DataFrame) -> DataFrame:
    """The pieces with the checksum of their ids in place of the ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
