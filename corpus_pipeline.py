"""A corpus pipeline of five stages; each gets the documents that the one before it kept.

All stages: null and empty texts are documents without words; long texts are read whole; identifiers may be null or
repeated; extra columns, whatever their names, are passed on by all but the last; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadrille.llm import exact_dedup, mixing, ngram_join, sentencepiece_lattice, toxicity
from quadrille.llm.common import stored, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal regression rejects go; it is fitted on a bounded sample of labelled ones.

    Texts without words stay. Rows that repeat stay or go together.
    """
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest identifier stays; of rows that repeat identifier and text, one.

    Null and empty texts are equal to each other, so one of them stays.
    """
    return exact_dedup.exact_dedup(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more over five-word shingles the one with the smallest identifier stays.

    A null identifier is the largest. Texts without words link with nothing and stay.
    """
    return ngram_join.near_dedup(docs, ngram_join.Spec(n=5, percent=80))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh 1, 2, 3 in turn; a document appears as often as the mix takes it, at most three times.

    A null source is one of its own. Rows that repeat are taken alike.
    """
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece numbers of every document's text; doc_id, ids and what tells that they are right. Repeated rows are encoded each."""
    return sentencepiece_lattice.report(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]
#: SQL has no form of the first, third, fourth and fifth stage; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
