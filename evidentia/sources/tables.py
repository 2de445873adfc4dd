"""The engine's inputs as derived from the driver's star schema (one rule a table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns with ids, clocks, scope, client and a revision."""
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(conv_id as int), 0, cast(turn as int), 0)")
    return read(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.col("conv_id"), F.col("turn")).alias("turn_id"),
        F.concat(F.lit("c"), F.col("conv_id") % 3).alias("client"),
        F.col("conv_id").cast("string").alias("session_id"),
        F.concat(F.lit("p"), F.col("conv_id") % 4).alias("scope"),
        at.alias("happened_at"),
        at.alias("known_at"),
        "role",
        F.col("text").alias("content"),
        F.sha2("text", 256).alias("raw_sha256"),
        F.concat(F.lit("conv-"), F.col("conv_id")).alias("source_path"),
        F.col("turn").alias("source_ordinal"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("revision"),
    )


def document_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(
        F.concat(F.lit("document-"), F.col("doc_id")).alias("turn_id"), F.col("source").alias("session_id"), F.col("lang").alias("scope"), F.lit("document").alias("role"), F.col("text").alias("content"), F.col("doc_id").alias("revision")
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id and text: each benchmark item, whole."""
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as curated memories: two clocks, keyed facts, and every third superseding the customer's previous one."""
    prev = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    known = F.expr("o_orderdate + make_dt_interval(cast(o_orderkey % 5 as int), 0, 0, 0)")
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("memory_id"),
        F.col("o_orderpriority").alias("scope"),
        F.col("o_orderdate").alias("effective_at"),
        known.alias("known_at"),
        F.col("o_orderstatus").alias("title"),
        F.col("o_totalprice").cast("string").alias("content"),
        F.col("o_totalprice").alias("amount"),
        F.concat_ws("|", F.col("o_custkey"), F.lower("o_orderstatus")).alias("fact"),
        F.when(F.col("o_orderkey") % 3 == 0, prev).alias("supersedes"),
    )


def entity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """memory_id, entity: the brands of an order's parts."""
    lines, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    return lines.join(part, lines["l_partkey"] == part["p_partkey"]).select(F.col("l_orderkey").alias("memory_id"), F.col("p_brand").alias("entity")).distinct()


def engrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lower(F.concat_ws(" ", "p_name", "p_type"))
    terms = F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit("[a-z0-9]+"), 0), lambda w: F.length(w) >= 2))
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(p_partkey as int), 0)")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("engram_id"), F.col("p_brand").alias("scope"), at.alias("happened_at"), terms.alias("terms"), (F.col("p_size") / 100.0).alias("strength"), F.col("p_partkey").alias("revision"))


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = read(spark, sf_dir, "part")
    row = lambda size: part.select(F.concat(F.lit("src/"), F.col("p_partkey"), F.lit(".py")).alias("path"), F.col("p_partkey").alias("key"), F.sha2(F.concat_ws("|", "p_name", size), 256).alias("sha256"))
    before = row(F.col("p_size")).filter("key % 10 <> 0")
    after = row((F.col("p_size") + (F.col("p_partkey") % 4 == 0).cast("int"))).filter("key % 10 <> 1")
    return before, after


def typed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("evidence_id"), F.col("user_id").alias("entity_id"), F.col("event_type").alias("relation"), F.col("value").alias("numeric_value"), F.get_json_object("props", "$.k").cast("long").alias("object_id"), F.col("ts").alias("observed_at"), F.expr("ts + interval '1' hour").alias("recorded_at")
    )
