"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compression, divergence, lm, merkle, oracles, quality, toxicity
from .chat import format_conversations, masked_text, read_turns
from .decontaminate import scan
from .fingerprint import fingerprints
from .jaccard import near_duplicates
from .mixing import mix
from .sharding import shard
from .shared import stash
from .warc import through_archives


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats every conversation, and one that says control strings; what is returned is read from the output."""
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    out = format_conversations(turns)
    read = out.withColumn("read", read_turns(F.col("formatted"))).withColumn("masked", masked_text(F.col("formatted"), F.col("loss_spans")))
    said_turns = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(said_turns, 256).alias("turns_sha256"),
        F.char_length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "n_blocks",
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document by a model of those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = lm.train(docs.where(~lm.held_out(F.col("doc_id"))))
    return lm.score(docs, model).withColumn("held_out", lm.held_out(F.col("doc_id")))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def remainder(of: str, n: int):
    return F.crc32(F.col(of).cast("string").cast("binary")) % n


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of remainder 2 teach nothing: they are the held-out quarter."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    uri = toxicity.train(docs, labels, learn=remainder("doc_id", 4) != 2)
    out = toxicity.flagged(toxicity.score(docs, uri), uri)
    return out.select(
        "doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "flagged"
    )


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through_archives(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "complete")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), 40).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs.select("doc_id", "text"), quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "quality_score.expected_grade", "quality_score.tail_probability", (F.col("quality_score.tail_probability") >= 0.5).alias("keep"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = compression.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *compression.COUNTS, "base_failed", "kept", "verdict", *compression.SIZES)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proof of every row; rows whose id's CRC-32 is a multiple of 7 are tampered with, and fold to another root."""
    fields = {c: F.col(c) for c in merkle.FIELDS}
    tampered = fields | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        "lang",
        merkle.leaf(*fields.values()).alias("leaf"),
        F.when((remainder("doc_id", 7) == 0) & F.col("n_chars").isNotNull(), merkle.leaf(*tampered.values())).alias("tampered"),
    )
    found = merkle.manifest(stash(rows, "leaves"))
    found = found.withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_formatting": op1_chat_formatting,
        "op2_lm_scoring": op2_lm_scoring,
        "op3_fingerprints": op3_fingerprints,
        "op4_toxicity": op4_toxicity,
        "op5_jaccard_join": op5_jaccard_join,
        "op6_mixing": op6_mixing,
        "op7_decontamination": op7_decontamination,
        "op8_warc": op8_warc,
        "op9_sharding": op9_sharding,
        "op10_quality": op10_quality,
        "op11_source_divergence": op11_source_divergence,
        "op12_quality_rules": op12_quality_rules,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_formatting": oracles.CHAT,
        "op5_jaccard_join": oracles.JACCARD,
        "op7_decontamination": oracles.DECONTAMINATION,
        "op8_warc": oracles.WARC,
        "op9_sharding": oracles.SHARDING,
        "op11_source_divergence": oracles.DIVERGENCE,
        "op13_merkle_manifest": oracles.MERKLE,
    }
