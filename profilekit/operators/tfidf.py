"""TF-IDF over one- and two-word terms, as tables.

A document's terms are counted where its row is read, in Arrow slices of bounded size: neither texts nor term
occurrences are shuffled. Only the corpus-wide term totals are, after a slice has added up its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import WORD
from ..session import materialize
from .blocks import best_pairs
from .vectors import distinct_answers

TOKEN = f"{WORD}{{2,}}"
#: Words that a task counts at once, about.
SLICE_TOKENS = 1 << 18


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def counted(tokens_col: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct terms (words and neighbouring pairs) of several lists of words, and row, term's number and count of what each list holds."""
    offsets = tokens_col.offsets.to_numpy()
    words = tokens_col.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    row = np.repeat(np.arange(len(tokens_col)), np.diff(offsets))
    code = words.indices.to_numpy().astype(np.int64)
    n_words = len(words.dictionary)
    follows = row[1:] == row[:-1]
    pairs, pair_code = np.unique((code[:-1] * n_words + code[1:])[follows], return_inverse=True)
    both = pc.binary_join_element_wise(words.dictionary.take(pa.array(pairs // max(n_words, 1))), words.dictionary.take(pa.array(pairs % max(n_words, 1))), " ")
    names = pa.concat_arrays([words.dictionary, both])
    at = np.concatenate([row, row[:-1][follows]]) * len(names) + np.concatenate([code, n_words + pair_code])
    at, n = np.unique(at, return_counts=True)
    return names, at // max(len(names), 1), at % max(len(names), 1), n


def in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``SLICE_TOKENS`` words in the last column, one row at least; a null list is empty."""
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.columns[-1]), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_TOKENS, side="right")))
            yield batch.slice(at, to - at)
            at = to


def _words(batch: pa.RecordBatch) -> pa.Array:
    """The last column as plain lists; null ones hold nothing."""
    lists = batch.columns[-1]
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int32), lists.flatten())


def term_totals(docs: DataFrame, text: str) -> DataFrame:
    """``term, total, df``. Tasks add up terms over their slices, so a slice sends each of its terms once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_slices(batches):
            names, _, term, n = counted(_words(part))
            total, df = np.bincount(term, n, len(names)).astype(np.int64), np.bincount(term, minlength=len(names))
            yield pa.RecordBatch.from_arrays([names, pa.array(total), pa.array(df)], ["term", "total", "df"])

    sent = docs.select(tokens(F.col(text)).alias("toks")).mapInArrow(run, "term string, total long, df long")
    return sent.groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))


@dataclass
class TfidfModel:
    """Vocabulary of at most ``max_terms`` rows: ``term, term_id, idf``."""

    vocabulary: DataFrame
    n_docs: int
    max_terms: int = fv.VOCABULARY_SIZE

    @classmethod
    def fit(cls, docs: DataFrame, doc_id: str, text: str, max_terms: int = fv.VOCABULARY_SIZE) -> "TfidfModel":
        n_docs = docs.count()
        # ties at the cut go by term, so the choice does not depend on partitions
        kept = term_totals(docs, text).orderBy(F.col("total").desc(), F.col("term").asc()).limit(max_terms)
        number = F.row_number().over(Window.orderBy("term")) - 1  # bounded by max_terms rows
        idf = F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1
        vocabulary = kept.select("term", number.alias("term_id"), idf.alias("idf"), "total", "df")
        return cls(materialize(vocabulary, "vocabulary", keep=True), n_docs, max_terms)

    def save(self, path: str) -> None:
        """Vocabulary and number of documents, for use in another session."""
        self.vocabulary.withColumns({"n_docs": F.lit(self.n_docs), "max_terms": F.lit(self.max_terms)}).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "TfidfModel":
        """A saved model; one of no terms has no documents either."""
        table = spark.read.parquet(path)
        row = table.select("n_docs", "max_terms").first()
        return cls(table.drop("n_docs", "max_terms"), row.n_docs if row else 0, row.max_terms if row else fv.VOCABULARY_SIZE)

    def rows(self, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
        """Sparse matrix rows ``d, t, w``: term ids and 1 + ln(tf) times idf, of unit length; a row is as long as its document
        has terms of the vocabulary, and left out without any.

        A document is a row and counts its terms where it is read: nothing is shuffled. The vocabulary, at most
        ``max_terms`` rows, goes to the tasks.
        """
        listed = self.vocabulary.select("term", "term_id", "idf").toArrow().combine_chunks()
        known, ids, idf = pa.array(listed.column("term").to_pylist(), pa.string()), listed.column("term_id").to_numpy(), listed.column("idf").to_numpy()
        source = docs.select(F.col(doc_id).alias("d"), tokens(F.col(text)).alias("toks"))
        schema = source.select("d", F.lit(None).cast("array<int>").alias("t"), F.lit(None).cast("array<double>").alias("w")).schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in in_slices(batches):
                names, row, term, n = counted(_words(part))
                place = pc.fill_null(pc.index_in(names, value_set=known), -1).to_numpy(zero_copy_only=False)[term] if len(names) else term
                use = place >= 0
                row, place = row[use], place[use]
                weight = (1 + np.log(n[use])) * idf[place]
                length = np.sqrt(np.bincount(row, weight * weight, part.num_rows))
                order = np.lexsort((ids[place], row))
                row, place, weight = row[order], place[order], (weight / length[row])[order]
                some, starts = np.unique(row, return_index=True)
                edges = pa.array(np.append(starts, len(row)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(some)), pa.ListArray.from_arrays(edges, pa.array(ids[place].astype(np.int32))), pa.ListArray.from_arrays(edges, pa.array(weight))], ["d", "t", "w"]
                )

        return source.mapInArrow(run, schema)

    def postings(self, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
        """``d, term, term_id, weight``: the rows, an entry each."""
        entries = self.rows(docs, doc_id, text).select("d", F.explode(F.arrays_zip("t", "w")).alias("e")).select("d", F.col("e.t").alias("term_id"), F.col("e.w").alias("weight"))
        return entries.join(self.vocabulary.select("term", "term_id"), "term_id").select("d", "term", "term_id", "weight")


def tfidf_topk(
    model: TfidfModel,
    queries: DataFrame,
    corpus: DataFrame,
    query_id: str,
    query_text: str,
    doc_id: str,
    doc_text: str = "input",
    answer: str = "output",
    k: int = fv.TOP_K,
    min_sim: float = fv.SPARSE_MIN_SIM,
    factor: int = fv.CANDIDATE_FACTOR,
    prefix: int = fv.ANSWER_PREFIX,
    carry: Sequence[str] = (),
    rows: DataFrame | None = None,
) -> DataFrame:
    """Most similar entries per query; a query without a known term gets none.

    ``rows`` may pass the written ``model.rows(corpus)`` so that the corpus is not read again.
    """
    wanted = model.rows(queries, query_id, query_text).withColumnRenamed("d", "q")
    known = rows if rows is not None else model.rows(corpus, doc_id, doc_text)
    pairs = best_pairs(wanted, known, min_sim, factor * k)
    return distinct_answers(pairs, corpus, query_id, doc_id, answer, k, prefix, carry)
