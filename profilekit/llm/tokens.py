"""Token ids of texts by a public tokenizer file."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

from .common import mix, spans

#: The pieces remembered in a worker at most (about 50 bytes each); the memory is emptied beyond that.
MEMORY_PIECES = 1 << 21
#: Bytes of text that are worked on at once.
BLOCK_BYTES = 1 << 20

_UNEVEN = re.compile(r"^\s|\s\s|\s$")
_SEP = 0xFF  # occurs in no UTF-8 text
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, _SEP]] = True
_CUT = np.zeros(256, bool)
_CUT[[10, 32, _SEP]] = True


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Encoder:
    """Ids of whole texts, equal to the library's own for byte-level BPE files.

    Such tokenizers cut a text before every space that stands between two other characters, and no
    merge crosses a cut; likewise around a single line break. A text is therefore cut there, each distinct piece is encoded once by the
    library, and the ids of all texts are gathered from their pieces; pieces are told apart by a
    64-bit hash. A text in which white space is doubled, begins or ends is encoded whole by the
    library, and so is one that holds an added token, which no cut may part. The ids of an empty text are none. ``end_id`` is appended to each text.
    """

    def __init__(self, path: str, end_id: int | None = 0, memory: int = MEMORY_PIECES):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        # byte-level vocabularies write one letter for each byte
        self.bytes_of = np.zeros(self.library.get_vocab_size() + 1, np.int64)
        for token, i in self.library.get_vocab().items():
            self.bytes_of[i] = len(token)
        self.tail = np.array([] if end_id is None else [end_id], np.uint32)
        self.memory = memory
        self._forget()

    def _forget(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.starts = [np.zeros(0, np.uint32)], np.zeros(1, np.int64)

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        """Encodes the pieces in a row, and cuts the ids where the bytes of a piece end."""
        rows = [b"".join(pieces[k : k + 1000]).decode() for k in range(0, len(pieces), 1000)]
        ids = np.concatenate([np.array(x.ids, np.uint32) for x in self.library.encode_batch_fast(rows, add_special_tokens=False)])
        piece_ends = np.cumsum([len(p) for p in pieces])
        ends = np.cumsum(self.bytes_of[ids])
        cut = np.searchsorted(ends, piece_ends)
        if not np.array_equal(ends[cut], piece_ends):
            raise ValueError("the tokenizer's pieces are not independent")
        at = np.searchsorted(self.keys, keys)
        self.slots = np.insert(self.slots, at, len(self.starts) - 1 + np.arange(len(keys)))
        self.keys = np.insert(self.keys, at, keys)
        self.starts = np.concatenate([self.starts, self.starts[-1] + cut + 1])
        self.ids.append(ids)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts as 32-bit unsigned integers, and how many belong to each text."""
        flat, counts, at = [], [], 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= BLOCK_BYTES):
                size += len(texts[to])
                to += 1
            block, n = self._block(texts[at:to])
            flat.append(block)
            counts.append(n)
            at = to
        return (np.concatenate(flat), np.concatenate(counts)) if flat else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _uneven(self, data: np.ndarray, begins: np.ndarray, texts: list[bytes]) -> np.ndarray:
        white = _WHITE[data]
        bad = np.flatnonzero(white[:-1] & white[1:])
        a, b = data[:-1], data[1:]
        odd = np.flatnonzero(((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A)) | ((a == 0xE2) & (b <= 0x81)) | ((a == 0xE3) & (b == 0x80)))
        out = np.zeros(len(texts), bool)
        out[np.searchsorted(begins, bad + 1, side="right") - 1] = True
        out[np.searchsorted(begins, bad, side="right") - 1] |= ~out[np.searchsorted(begins, bad, side="right") - 1] & (data[bad] != _SEP)
        for k in np.unique(np.searchsorted(begins, odd, side="right") - 1):
            out[k] = out[k] or bool(_UNEVEN.search(texts[k].decode()))
        return out

    def _block(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sep = bytes([_SEP])
        whole = sep.join([b"", *texts, b""])
        data = np.frombuffer(whole, np.uint8)
        lengths = np.array([len(t) for t in texts], np.int64)
        begins = 1 + np.cumsum(lengths + 1) - (lengths + 1)
        uneven = self._uneven(data, begins, texts) | (lengths == 0)
        if any(a in whole for a in self.added):
            uneven |= np.array([any(a in t for a in self.added) for t in texts])
        # pieces lie between spaces, line breaks or separators; a piece's hash covers what stands before it
        cuts = np.flatnonzero(_CUT[data])
        first = data[cuts[:-1]]
        sizes = np.diff(cuts) - 1
        full = sizes > 0
        starts, sizes, first = cuts[:-1][full] + 1, sizes[full], first[full]
        of = np.searchsorted(begins, starts, side="right") - 1
        use = ~uneven[of]
        starts, sizes, first, of = starts[use], sizes[use], first[use], of[use]
        counts = np.zeros(len(texts), np.int64)
        parts: dict[int, np.ndarray] = {}
        for k in np.flatnonzero(uneven):
            parts[k] = np.array(self.library.encode(texts[k].decode(), add_special_tokens=False).ids if texts[k] else [], np.uint32)
            counts[k] = len(parts[k])
        flat = np.zeros(0, np.uint32)
        if len(starts):
            with np.errstate(over="ignore"):
                hashes = mix(spans(data, starts, starts + sizes) + first.astype(np.uint64))
            keys, example, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            for again in (False, True):
                at = np.searchsorted(self.keys, keys)
                new = np.flatnonzero((at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != keys)) if len(self.keys) else np.arange(len(keys))
                if not len(new):
                    break
                e = example[new]
                pieces = [b"\n" + whole[s:t] if f == _SEP else whole[s - 1 : t] for s, t, f in zip(starts[e].tolist(), (starts[e] + sizes[e]).tolist(), first[e].tolist())]
                if len(self.keys) > self.memory:
                    self._forget()
                    continue
                self._learn(keys[new], pieces)
            at = np.searchsorted(self.keys, keys)
            if len(new) and not np.array_equal(self.keys[np.minimum(at, len(self.keys) - 1)], keys):
                raise RuntimeError("pieces are missing")
            if len(self.ids) > 1:
                self.ids = [np.concatenate(self.ids)]
            slots = self.slots[at][inverse]
            begin, end = self.starts[slots] + (first == _SEP), self.starts[slots + 1]  # without the line break
            n = end - begin
            ends = np.cumsum(n)
            flat = self.ids[0][np.repeat(begin - (ends - n), n) + np.arange(int(ends[-1]))]
            counts += np.bincount(of, weights=n, minlength=len(texts)).astype(np.int64)
        if not parts and not len(self.tail):
            return flat, counts
        # the tail after each text, and the texts that were encoded whole, in their places
        total = counts + len(self.tail)
        ends = np.cumsum(total)
        out = np.empty(int(ends[-1]), np.uint32)
        out_begin = ends - total
        even = np.where(uneven, 0, counts)
        within = np.arange(int(even.sum())) - np.repeat(np.cumsum(even) - even, even)
        out[np.repeat(out_begin, even) + within] = flat
        for k, ids in parts.items():
            out[out_begin[k] : out_begin[k] + len(ids)] = ids
        for j, x in enumerate(self.tail):
            out[out_begin + counts + j] = x
        return out, total


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int | None = 0) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path, end_id)
