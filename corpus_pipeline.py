"""From raw documents to packed training sequences: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from profilekit.llm import cotraining, line_copies, mixing, near_copies, packing
from profilekit.llm.common import materialize, read
from profilekit.llm.tokens import tokenizer_file
from profilekit.session import discard, temporary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the co-trained classifier rejects; it is fitted on ``labels``."""
    return cotraining.keep_good(docs, read(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that match an earlier line, and documents that thereby lose all their lines."""
    with temporary(spark):
        return materialize(line_copies.drop_matches(docs), "lines_left", keep=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    with temporary(spark):
        return materialize(near_copies.keep_one(docs), "one_of_each", keep=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's target of words: whole documents, once or twice, and blocks of others."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenizes what is left and packs it into sequences."""
    return packing.pack_documents(docs, tokenizer_file())


#: In this order. Every stage takes all its predecessor kept; all but the last return the columns of documents. The two
#: stages that write large working tables return a table of its own and delete the others.
STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's tables are deleted once its result is written."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with temporary(spark):
            result = stage(spark, docs, sf_dir)
            docs = materialize(result, name, keep=True)
        if name in ("lines", "near_duplicates"):
            discard(result)
    return STAGES[-1][1](spark, docs, sf_dir)


#: A fitted classifier, signatures and token ids are beyond SQL; tests/llm checks every stage by brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
CHECKS: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
