"""A training corpus from ``documents``: stages of the operators in ``carecycle.llm``.

Each stage takes (spark, docs, sf_dir) and its result is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of
``documents``. SQL can't express a trained network or a packing, so there is no
SQL; the tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carecycle.llm import language, packing, simhash, suffixes
from carecycle.llm.storage import written

LEAST_SCORE = 0.35  # mean probability below which the network counts as undecided
PASSAGE_WORDS = 51  # a repeated passage of so many words goes


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, with that language where theirs is missing.

    Null texts, texts without a letter and texts on which the network is
    undecided go.
    """
    found = language.label(docs, language.fit(docs))
    kept = found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    lang = F.coalesce("row.lang", "lang_pred").alias("lang")
    return kept.select(*[lang if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, the one with the smallest id.

    Groups are those of op10: 3-word shingles, at most 2 differing bits. Rows
    are told apart by id and text, so of two texts under one id only a copy
    goes; of equal rows one stays. Rows without an id form no group and stay.
    """
    keys = [F.xxhash64("text").alias("k1"), F.xxhash64("text", F.lit(0)).alias("k2")]
    found = simhash.near_duplicates(docs.select("doc_id", "text", *keys), carry=("k1", "k2"))
    one = found.filter("doc_id = component_id").groupBy("component").agg(F.min(F.struct("doc_id", "k1", "k2")).alias("row"))
    same = ["doc_id", "k1", "k2"]
    kept = docs.select(*docs.columns, *keys).join(written(one.select("row.*"), "kept"), same, "left_semi")
    return kept.dropDuplicates(same).select(docs.columns).union(docs.filter("doc_id IS NULL"))


def suffix_dedup(
    spark: SparkSession, docs: DataFrame, sf_dir: str, words: int | None = None
) -> DataFrame:
    """Texts without the bytes of strings that occur more than once; all documents stay."""
    found = suffixes.remove_repeats(docs, as_text=True, words=words)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return found.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``suffix_dedup`` that takes passages of PASSAGE_WORDS words as well, however short their words."""
    return suffix_dedup(spark, docs, sf_dir, PASSAGE_WORDS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of at most 4096."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("suffix_dedup", passage_dedup),
    ("pack", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
