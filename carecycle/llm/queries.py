"""The named queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carecycle.llm import (
    bpe, chat, embeddings, language, minhash, negatives, packing, pages, pii, rans, simhash, suffixes,
    variants,
)
from carecycle.llm.storage import folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents")))
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "row.doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.extract(_table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(_table(spark, sf_dir, "conversations"))


def op7_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "token-files")
    rans.write(_table(spark, sf_dir, "documents"), path)
    docs = rans.read(spark, path).select(
        "part", "seq", "piece", "at", "doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )
    return rans.with_starts(docs, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.fingerprints(_table(spark, sf_dir, "documents"))
    found = found.withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
    return minhash.with_likeness(found).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).drop("component")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = variants.count_words(_table(spark, sf_dir, "documents"), drop_one_in=variants.DROP_ONE_IN)
    return variants.group_variants(words)


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def n(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", n("email"), n("ip"), n("card"), n("phone"), F.sha2(pii.listed(base), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
    )


QUERIES = {
    "op1_multi_index": op1_multi_index,
    "op2_packing": op2_packing,
    "op3_bpe": op3_bpe,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_html": op5_html,
    "op6_chat": op6_chat,
    "op7_rans": op7_rans,
    "op8_minhash": op8_minhash,
    "op9_language": op9_language,
    "op10_simhash": op10_simhash,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_pii": op13_pii,
}
ORACLE: dict[str, str] = {"op6_chat": chat.SQL, "op11_hard_negatives": negatives.SQL, "op13_pii": pii.SQL}
