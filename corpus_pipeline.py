"""A corpus pipeline: quality, near-duplicates, benchmark passages, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import decontaminate, packing, pii, quality, queries, simhash
from gleaner.llm.common import forget, read, settled, small_batches


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, all columns as they are; rejected ones go.

    Null and empty texts are judged as texts whose statistics are all zero, texts of any length whole, and rows with a null or
    a repeated doc_id each by its own text. A score of exactly 0.5 is accepted. Without any label all rows stay; an empty table gives none.
    """
    small_batches(spark)
    return quality.accepted(docs, read(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id, all columns as they are.

    Texts without words (null, empty, white space) are copies of each other. Rows that repeat a doc_id and its words are one
    document; with other words they are others. Rows with a null doc_id are in no group and stay. An empty table gives none.
    """
    small_batches(spark)
    return simhash.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage, all columns as they are.

    Null and empty texts and items match nothing and stay; texts of any length are read whole; rows with a null or a repeated
    doc_id are judged each. A similarity of exactly 0.8 is a match. An empty benchmark removes nothing; an empty table gives none.
    """
    small_batches(spark)
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by pseudonyms in their texts; other columns as they are.

    The key is the session's (``pii.SETTING``). Null texts stay null, empty ones empty; repeated rows and null ids stay.
    Equal values have equal pseudonyms in all rows. An empty table gives none.
    """
    small_batches(spark)
    return pii.pseudonymise(docs, pii.session_key(spark, queries.DEMONSTRATION), keep=True)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens: the rows of ``packing.pack``.

    Null and empty texts are one token; long texts span as many sequences as they need; repeated rows and null ids are packed
    each. An empty table gives none.
    """
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: SQL has no random features, fingerprints, permutations or tokenizer: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over all documents, each one's result written and read again; what led to it is deleted.

    Where the session names no size of Arrow batches, the stages set it to 4 MB, and it stays so: the last stage's rows are made
    when the caller reads them. Without a key of the session's own (``pii.SETTING``) pseudonyms are made with a known one, and a warning says so.
    """
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        following = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name.replace(" ", "-"))
        forget(docs)  # a table of the stage before; the given one is left alone
        docs = following
    return STAGES[-1][1](spark, docs, sf_dir)
