"""The corpus pipeline: documents go through toxicity, line dedup, near-dedup, decontamination and packing.

Each stage is a function of (spark, docs, sf_dir). Run one after another, a stage's result is written as Parquet and
read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, line_chunks, near_copies, simhash, toxicity
from millrace.llm._common import materialize, release, table
from millrace.llm.queries import pack


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents below the toxicity threshold of their language.

    Null, empty and blank texts are scored as having no words, texts of any length whole; repeated rows go or stay
    together; without labels nothing goes.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat earlier ones (by doc_id, then place); n_chars follows the text.

    A text may become empty; a null text stays null, with a null n_chars; rows equal in doc_id and text are treated alike.
    """
    kept = line_chunks.dedup_lines(docs).select("row.*")
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*[f"`{c}`" for c in docs.columns]) if "n_chars" in docs.columns else kept


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id.

    Texts without words are one group; ties and repeated rows are resolved by hashes of text and row (see the operator).
    """
    return simhash.drop_near_duplicates(docs, jaccard=near_copies.JACCARD)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark window; null and empty texts hold none. Each row is judged by itself."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences; a null or empty text is one end id, repeated rows are packed each."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", remove_contaminated),
    ("packing", pack_sequences),
]
#: Chunking, fingerprints, the classifier and the tokenizer can't be said in SQL; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
