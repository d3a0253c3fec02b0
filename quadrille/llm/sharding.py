"""Sharding: rendezvous hashing of record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import documents, table

SHARDS = 24
#: Rows of a shard are numbered in so many independent blocks.
BLOCKS = 4096


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard that wins the key: each draws a uniform u from (key, shard), and the largest
    -weight / ln(u) wins. A further shard only adds a draw, so rows move into it and nowhere else; a
    larger weight only draws rows in. Equal draws go to the smaller shard; a null key is one key."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")

    def draw(s: int) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(s)), 11)
        return F.lit(-float(weights[s])) / F.log((bits + F.lit(0.5)) / F.lit(2.0**53))

    return F.array_max(F.array(*[F.struct(draw(s).alias("x"), F.lit(-s).alias("s")) for s in range(len(weights))]))["s"] * F.lit(-1)


def assign_shards(df: DataFrame, key: str = "doc_id", shards: int = SHARDS, weights: Sequence[float] | None = None) -> DataFrame:
    """df with an int column shard in front; a column of that name in df is replaced. No shuffle."""
    return df.withColumn("shard", rendezvous(F.col(key), weights or [1.0] * shards).cast("int"))


def number_slots(rows: DataFrame, spread: Column, order: Sequence[str]) -> DataFrame:
    """rows with a long slot, 0 to n-1 within each shard.

    A shard is cut into blocks by the hash spread. Counts by (shard, block) give each block its first
    slot; rows are numbered within their block. So no task sorts a shard, and a shard that holds most
    rows is numbered by as many tasks as it has blocks.
    """
    rows = rows.withColumn("_block", F.pmod(spread, F.lit(BLOCKS)).cast("int"))
    counts = rows.groupBy("shard", "_block").count()
    first = counts.select("shard", "_block", (F.sum("count").over(W.partitionBy("shard").orderBy("_block")) - F.col("count")).alias("_first"))
    within = F.row_number().over(W.partitionBy("shard", "_block").orderBy(*order))
    return rows.withColumn("_row", within).join(first, ["shard", "_block"]).withColumn("slot", F.col("_first") + F.col("_row") - 1).drop("_block", "_first", "_row")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs (doc_id, text).

    The law is `key`: doc_id and the number of shards decide, equal texts under other ids may part.
    size is the text's UTF-8 bytes plus 8; a null text counts as empty. Rows of one doc_id share a
    shard, and are spread over blocks by their text; rows that agree in everything are numbered in any
    order, which no reader can tell apart. An empty table gives an empty table; other columns are left out.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    rows = assign_shards(rows, "doc_id", shards).withColumn("grown_shard", rendezvous(F.col("doc_id"), [1.0] * (shards + 1)).cast("int"))
    rows = table(rows, "shards")
    rows = number_slots(rows, F.xxhash64("doc_id", "text_crc32"), ["doc_id", "text_crc32", "size"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir, "doc_id", "text"))
