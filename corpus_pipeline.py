"""A corpus pipeline of five stages over ``documents``; each stage's rows feed the next.

Every stage takes ``(spark, docs, sf_dir)`` and returns the columns of ``documents`` (and any
further ones), but for the last, which returns a row of token counts and digests for each
document of the mix.

Null texts are empty texts throughout.  Rows without an id can't be told apart, so the two
dedup stages keep them; rows that repeat an id stay or go together.  An empty table passes
through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from panelcast.llm import mixing as mixing_rates
from panelcast.llm.exact_dedup import exact_dedup
from panelcast.llm.pieces import encode_decode
from panelcast.llm.shared import cut, table
from panelcast.llm.simhash import simhash_groups
from panelcast.llm.toxicity import fit, reject_toxic


TARGETS = {d: w for d, w in mixing_rates.TARGETS.items() if d != "toxic"}  # of the domains that are left once toxic documents are gone


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is in ``kept``, and those without an id."""
    return docs.join(kept.select("doc_id").distinct(), "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    return reject_toxic(docs, fit(docs, table(spark, sf_dir, "labels")))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return _only(docs, exact_dedup(docs).where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the smallest id."""
    return _only(docs, simhash_groups(docs).where("doc_id = component_id"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, more often where its domains need tokens to reach their shares of the mix."""
    return mixing_rates.mixed_documents(docs, table(spark, sf_dir, "labels"), TARGETS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=False)


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_duplicates),
    ("simhash near-dedup", near_duplicates),
    ("mixing to target weights", mixing),
    ("sentencepiece", sentencepiece),
]

ORACLE_SQL = None  # hashing, trained models and a fitted mix; tests hold it against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
