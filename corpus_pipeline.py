"""From raw documents to training pieces: each stage applies one operator to all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aligngrid.llm import common, minhash, mixing, pieces, pii, repetition

#: The columns of `documents`; all stages but the last return them.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the rules on words and repeated passages reject."""
    return repetition.repetition_rules(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of each class of near-duplicates."""
    return minhash.keep_one(docs.select(*COLUMNS))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind; n_chars is that of the new text."""
    return pii.redacted(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents, so that the sources have the shares of words that their weights ask for."""
    return mixing.take(docs.select(*COLUMNS), mixing.n_words())


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids of the pieces and their number, a row for each row of the mixture."""
    out = pieces.encode_texts(docs, keep=["doc_id", "lang", "source"])
    return out.select("doc_id", "lang", "source", F.size("ids").alias("n_pieces"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_dedup),
    ("personal data", redaction),
    ("mixing sources", mixture),
    ("encoding", encoding),
]

#: SQL can't express the longest repeats, the signatures, the fitted trees or the pieces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each result is written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.store(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
