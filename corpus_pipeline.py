"""A corpus pipeline of five stages over the documents table.

Each stage takes all rows that the one before it kept and returns the columns of documents; the last one
returns packed pieces. Stages that change a text set n_chars (where the table has it) to the new length.

Defined results: a null or empty text fails the quality rules and goes; a null doc_id is passed on like any other;
repeated rows are judged alike by the rules, lose their later lines as one document, and all but one of them go at the
near-copy stage; ties go to the smallest doc_id; columns of the table may have any names, also those that a stage uses
for itself, and come out unchanged; an empty table goes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellcnv.llm import nearcopies, packing, pii, rules, templates
from cellcnv.llm.common import stored, table

#: An isolation forest isn't expressible in SQL; tests hold each stage's operator against brute force.
ORACLE_SQL = None


def _measured(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return rules.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go, but for the first of each template; a leaf has several templates, and lines without enough words are judged as they stand from 20 characters on."""
    return _measured(templates.without_recurring_lines(docs, several=True, min_chars=20))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles with a Jaccard index of at least 0.8.

    SimHash fingerprints in vantage-point trees link the close ones; an exact set join finds the pairs that no fingerprint can promise.
    """
    return nearcopies.one_of_near_copies(docs)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in angle brackets."""
    return _measured(pii.redact(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("simhash_near_dedup", simhash_near_dedup), ("pii", mask_pii), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
