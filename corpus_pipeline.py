"""A training corpus from raw documents, in five stages."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from offerlode.llm import bpe, line_dedup, mixing, simhash, toxicity  # noqa: E402
from offerlode.llm.common import durable, table  # noqa: E402


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on their labels, doesn't reject.

    Null and empty texts score as clean; each row is judged by itself, so repeated rows fare
    alike. Without labels nothing is rejected. All columns are kept.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, docs.columns, only_clean=True)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share; n_chars is counted anew.

    A null text stays null and n_chars of an unchanged one stays as it is. No row goes, not even
    one whose lines all go; repeated rows count as documents of their own. All columns are kept.
    """
    made = line_dedup.drop_shared_lines(docs)
    lost = F.col(made.columns[len(docs.columns) + 1]) > 0
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.when(lost, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return made.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by the fingerprints and bits of op1.

    Null, empty and blank texts are one group. Of a group the smallest doc_id stays, null last;
    of equal rows one. An empty table stays empty; all columns are kept.
    """
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it.

    Null sources are a source. Null and empty texts have no words, so they are taken as often as
    target / size of their source, rounded down; repeated rows share one decision. All columns
    are kept.
    """
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left, repeats included.

    A null text counts as empty: no tokens and the digests of nothing.
    """
    return bpe.token_digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Models, fingerprints and draws by hash are no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
