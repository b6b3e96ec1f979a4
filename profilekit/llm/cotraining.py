"""Quality classifier by co-training two views of a document.

The text view sees what the characters and words are like; the page view sees source, language, length and
layout of lines. Each is a logistic regression, fitted on a bounded sample of labelled rows. Over a few
rounds each view scores every document and hands the ones it is surest of, with its own
answer as label, to the other. Held-out labelled rows calibrate both views and their combination,
which then scores all documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, materialize, utf8


@dataclass(frozen=True)
class Plan:
    """``label_rows`` bounds the labelled sample (drawn by hash of doc_id), of which ``held_share`` calibrates;
    ``pseudo_rows`` bounds what one view hands to the other in a round. Rounds look at all documents."""

    label_rows: int = 20_000
    held_share: float = 0.3
    rounds: int = 3
    pseudo_rows: int = 2_000
    sure: float = 0.95
    penalty: float = 1.0
    keep_from: float = 0.5


CLASSES = 12
_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate((bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b" ", b"\n\r\t\x0b\x0c", b".,", b"'\"()[]{}", b"|", bytes(range(194, 245)), bytes(range(128, 192)))):
    _CLASS[list(_chars)] = _k + 1
_CLASS[[c for c in range(33, 127) if not _CLASS[c]]] = CLASSES - 1
TEXT_FEATURES = CLASSES * CLASSES + 5
PAGE_BUCKETS = 32
PAGE_FEATURES = 6 + 2 * PAGE_BUCKETS


def text_view(text: bytes) -> np.ndarray:
    """Roots of the shares of pairs of character classes, and how varied the words are."""
    out = np.zeros(TEXT_FEATURES, np.float32)
    kinds = _CLASS[np.frombuffer(text, np.uint8)]
    if len(kinds) > 1:
        pairs = np.bincount(kinds[:-1] * CLASSES + kinds[1:], minlength=CLASSES * CLASSES)
        out[: CLASSES * CLASSES] = np.sqrt(pairs / (len(kinds) - 1))
    words = text.split()
    n = len(words)
    if n:
        same = sum(a == b for a, b in zip(words, words[1:]))
        distinct = len(set(words))
        out[-5:] = (distinct / n, same / n, np.log1p(n) / 10, np.log1p(len(text) / n), np.log(distinct) / np.log(n) if n > 1 else 1)
    return out


def page_view(text: bytes, source: str | None, lang: str | None) -> np.ndarray:
    """Length, layout of lines, and hashed source and language."""
    out = np.zeros(PAGE_FEATURES, np.float32)
    lines = [x for x in text.split(b"\n") if x.strip()]
    n = len(lines)
    if n:
        ends = sum(x.rstrip()[-1:] in (b".", b"!", b"?", b":", b'"') for x in lines)
        out[:6] = (np.log1p(len(text)) / 10, np.log1p(n) / 5, np.log1p(len(text) / n) / 5, len(set(lines)) / n, ends / n, max(map(len, lines)) / len(text))
    for k, name in enumerate((source, lang)):
        out[6 + k * PAGE_BUCKETS + (zlib.crc32(name.encode()) % PAGE_BUCKETS if name is not None else 0)] = 1
    return out


def views(docs: DataFrame) -> DataFrame:
    """row, doc_id, and both views of every document as bytes of 32-bit floats; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            texts, sources, langs = (part.column(c).to_pylist() for c in ("text", "source", "lang"))
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column("doc_id"), pa.array([text_view(t).tobytes() for t in texts], pa.binary()), pa.array([page_view(*x).tobytes() for x in zip(texts, sources, langs)], pa.binary())],
                names=["row", "doc_id", "text_view", "page_view"],
            )

    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), utf8().alias("text"), F.col("source").cast("string"), F.col("lang").cast("string"))
    return own.mapInArrow(run, "row long, doc_id long, text_view binary, page_view binary")


def _floats(column: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(-1, width).astype(np.float64)


@dataclass
class Logistic:
    """Logistic regression on standardised columns, by Newton steps."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, penalty: float) -> Logistic:
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale[scale < 1e-6] = np.inf
        z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
        w = np.zeros(z.shape[1])
        ridge = np.full(z.shape[1], penalty)
        ridge[0] = 1e-6
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(ridge)
            step = np.linalg.solve(h, z.T @ (y - p) - ridge * w)
            w += step * min(1.0, 5 / (np.abs(step).max() + 1e-9))
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, w)

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weights[1:] + self.weights[0], -30, 30)


def _chance(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-odds))


@dataclass
class Model:
    """Both views' classifiers and their calibration on held-out rows. Without labels of both kinds all
    documents get the score ``usual``."""

    text: Logistic | None
    page: Logistic | None
    calibrate_text: Logistic | None
    calibrate_page: Logistic | None
    combine: Logistic | None
    usual: float
    keep_from: float

    def scores(self, text: list[bytes], page: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chances of good quality: by the text view, by the page view, combined."""
        if self.combine is None or not text:
            same = np.full(len(text), self.usual)
            return same, same, same
        a = self.calibrate_text.odds(self.text.odds(_floats(text, TEXT_FEATURES))[:, None])
        b = self.calibrate_page.odds(self.page.odds(_floats(page, PAGE_FEATURES))[:, None])
        return _chance(a), _chance(b), _chance(self.combine.odds(np.column_stack([a, b])))


def fit(seen: DataFrame, labels: DataFrame, plan: Plan = Plan()) -> Model:
    """``seen``: a written table of views(); ``labels``: doc_id, quality (0 or 1; nulls are left out, of
    several labels the mean counts)."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    order = F.xxhash64("doc_id", F.lit("sample"))
    chosen = seen.join(known.orderBy(order, "doc_id").limit(plan.label_rows), "doc_id").orderBy(order, "doc_id", "row").limit(plan.label_rows)
    rows = chosen.select("doc_id", "quality", "text_view", "page_view").toArrow().to_pydict()
    y = np.array(rows["quality"], np.float64)
    usual = float(y.mean()) if len(y) else 1.0
    kinds = ((TEXT_FEATURES, rows["text_view"]), (PAGE_FEATURES, rows["page_view"]))
    x = [_floats(data, width) for width, data in kinds]
    # copies of one text share their place, so that none is learnt from and held out at once
    held = np.array([zlib.crc32(t) % 1000 < 1000 * plan.held_share for t in rows["text_view"]], bool)
    if any(len(np.unique(y[part])) < 2 for part in (held, ~held)):
        return Model(None, None, None, None, None, usual if len(np.unique(y)) == 2 else 1.0, plan.keep_from)
    train = [(v[~held], y[~held]) for v in x]
    rest = seen.join(known.select("doc_id"), "doc_id", "left_anti")
    for k in range(plan.rounds + 1):
        learners = [Logistic.fit(v, t, plan.penalty) for v, t in train]
        if k == plan.rounds:
            break
        pool = materialize(_sure(rest, *learners), "sure")
        for giver, taker, odds in ((0, 1, "text_odds"), (1, 0, "page_odds")):
            for label, share in ((1, usual), (0, 1 - usual)):
                n = max(1, round(plan.pseudo_rows * share))
                sure = pool.where(F.col(odds) * (1 if label else -1) >= float(np.log(plan.sure / (1 - plan.sure))))
                # rows with the same views count once
                once = sure.groupBy("key").agg(F.min("row").alias("row"), F.first(odds).alias("odds"))
                top = once.orderBy((F.abs("odds")).desc(), F.xxhash64("key", F.lit(k)), "row").limit(n)
                got = seen.join(top.select("row"), "row").select("row", "text_view", "page_view").toArrow().sort_by("row").to_pydict()
                width, name = ((TEXT_FEATURES, "text_view"), (PAGE_FEATURES, "page_view"))[taker]
                if got["row"]:
                    v, t = train[taker]
                    train[taker] = (np.concatenate([v, _floats(got[name], width)]), np.concatenate([t, np.full(len(got["row"]), float(label))]))
    raw = [m.odds(v[held])[:, None] for m, v in zip(learners, x)]
    sides = [Logistic.fit(r, y[held], 0.01) for r in raw]
    both = np.column_stack([s.odds(r) for s, r in zip(sides, raw)])
    return Model(*learners, *sides, Logistic.fit(both, y[held], 0.01), usual, plan.keep_from)


def _sure(rest: DataFrame, text: Logistic, page: Logistic) -> DataFrame:
    """row, a key of the views, and both views' log odds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = text.odds(_floats(batch.column("text_view").to_pylist(), TEXT_FEATURES)), page.odds(_floats(batch.column("page_view").to_pylist(), PAGE_FEATURES))
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("key"), pa.array(a), pa.array(b)], names=["row", "key", "text_odds", "page_odds"])

    return rest.select("row", F.xxhash64("text_view", "page_view").alias("key"), "text_view", "page_view").mapInArrow(run, "row long, key long, text_odds double, page_odds double")


def score(seen: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, text_score, page_score, score, kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, c = model.scores(batch.column("text_view").to_pylist(), batch.column("page_view").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(a), pa.array(b), pa.array(c), pa.array(c >= model.keep_from)], names=["doc_id", "text_score", "page_score", "score", "kept"])

    return seen.select("doc_id", "text_view", "page_view").mapInArrow(run, "doc_id long, text_score double, page_score double, score double, kept boolean")


def classify(docs: DataFrame, labels: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """Scores all documents: doc_id, text_score, page_score, score (chance of good quality), kept.

    ``docs`` has doc_id, text, source and lang, each of which may be null (null text counts as empty); other
    columns are ignored. Repeated rows are scored each and alike. Without labels of both kinds every document is kept;
    an empty table gives an empty one.
    """
    seen = materialize(views(docs), "views")
    return score(seen, fit(seen, labels, plan))


def keep_good(docs: DataFrame, labels: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """The documents, with all their columns, that the classifier fitted on them does not reject."""
    model = fit(materialize(views(docs), "views"), labels, plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            texts, sources, langs = (part.column(c).to_pylist() for c in ("text", "source", "lang"))
            texts = [(t or "").encode() for t in texts]
            _, _, c = model.scores([text_view(t).tobytes() for t in texts], [page_view(*x).tobytes() for x in zip(texts, sources, langs)])
            yield part.filter(pa.array(c >= model.keep_from, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
