"""Corpus pipeline: quality, near duplicates, decontamination, secrets, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and
read again as the next stage's documents. Filtering stages return the columns of
the documents unchanged; the secret stage returns every document with its secrets
replaced; the last stage returns the encoded documents.

In every stage: a null text counts as empty; rows with a null id or nulls in other
columns are kept like others; an empty table gives an empty one; whole texts are read,
however long; further columns may have any name and stay as they are. What is special
to a stage is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxmill.llm import decontam, ngram_join, quality_classifier, secret_scan, sentence_pieces
from voxmill.llm.common import Scratch, crc_mod, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the rule ensemble scores below 0.3; one id in five gives no label.

    A score of exactly 0.3 stays. Repeated rows are scored each. Labels with a null id
    or value don't count; without usable labels the score is 0.5, and all stay.
    """
    labels = read(spark, sf_dir, "labels")
    model = quality_classifier.train(docs, labels.where(crc_mod(F.col("doc_id"), 5) != 0))
    return quality_classifier.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates.

    Similarity is 0.8 or more on sets of five words. An id's other texts are judged by
    themselves; of rows with the same id and text one stays. Rows without an id and
    texts without a word belong to no group and stay.
    """
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which one word in twenty or more lies in a benchmark window.

    Texts without a word stay, and so does everything where the benchmark has no
    words. Items without an id count. Repeated rows are judged each.
    """
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark; overlapping ones by one mark. No row goes, null texts stay null, and n_chars is brought up to date."""
    return secret_scan.redact(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece ids and their number, and whether decoding gives the text back. A null text has null ids. Rows are encoded each, and none goes."""
    return sentence_pieces.encode(docs)


STAGES = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scan", secrets),
    ("sentence_pieces", pieces),
]

# Not expressible in SQL: the first stage is a fitted model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs, before = Scratch(spark), read(spark, sf_dir, "documents"), ()
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        scratch.drop(*before)
        before = (name,)
    return STAGES[-1][1](spark, docs, sf_dir)
