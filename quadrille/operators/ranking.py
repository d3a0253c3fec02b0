"""Ranking by distance to an anchor, and how well it keeps the anchor's label in front."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.vectors import rounded
from ..storage import rank_rows
from .comparisons import PROFILES


def shuffled(pos: Column, seed: int) -> Column:
    """What puts places in a seeded order, the same on every engine: a digest of seed and place, so that two seeds give
    orders that have nothing to do with each other."""
    return F.md5(F.concat(F.lit(f"{seed}:"), pos.cast("string")))


def sample(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """The first n rows in a seeded order, numbered p from 1. n is a parameter, not a share of the table."""
    first = rows.withColumn("_k", shuffled(F.col("pos"), seed)).orderBy("_k", "id").limit(n)
    return first.withColumn("p", F.row_number().over(W.orderBy("_k", "id"))).drop("_k")


def rank_by_anchor(rows: DataFrame, anchor_id: str, profile: str = "f64", digits: int | None = None) -> DataFrame:
    """rows but the anchor with d and rank: nearest first, ties by id. The anchor's row is broadcast. digits: d is rounded
    to so many before rows are ranked."""
    anchor = rows.where(F.col("id") == anchor_id).select(F.col("embedding").alias("_anchor"), F.col("label_name").alias("anchor_label")).limit(1)
    near = rows.where(F.col("id") != anchor_id).crossJoin(F.broadcast(anchor)).withColumn("d", PROFILES[profile](F.col("_anchor"), F.col("embedding"))).drop("_anchor", "embedding")
    return rank_rows(near if digits is None else near.withColumn("d", rounded(F.col("d"), digits)), "d", "id")


def inversions(ranked: DataFrame) -> DataFrame:
    """One row of metrics of ranked rows (rank, relevant 0 or 1): how many irrelevant rows stand before
    relevant ones. A relevant row at rank r, the j-th of its kind, has r - j of them before it, so sums suffice.
    No pairs: rate 0, auc 1. Other values of relevant are errors."""
    valid = F.col("relevant").isin(0, 1)
    checked = F.when(valid, F.col("relevant")).otherwise(F.raise_error(F.lit("relevance is neither 0 nor 1")).cast("int"))
    sums = ranked.select(F.col("rank"), checked.alias("y")).agg(F.count("*").alias("n_items"), F.coalesce(F.sum("y"), F.lit(0)).alias("n_in"), F.coalesce(F.sum(F.col("rank") * F.col("y")), F.lit(0)).alias("places"))
    p, n = F.col("n_in"), F.col("n_items") - F.col("n_in")
    out = sums.select("n_items", p.alias("n_in"), n.alias("n_out"), (F.col("places") - F.expr("n_in * (n_in + 1) div 2")).alias("inversions"), (p * n).alias("max_inversions"))
    rate = F.when(F.col("max_inversions") > 0, F.col("inversions") / F.col("max_inversions")).otherwise(0.0)
    return out.withColumn("inversion_rate", rate).withColumn("auc", F.lit(1.0) - F.col("inversion_rate"))


def rank_metrics(rows: DataFrame, anchor_id: str, profile: str = "f64") -> DataFrame:
    ranked = rank_by_anchor(rows, anchor_id, profile)
    return inversions(ranked.withColumn("relevant", (F.col("label_name") == F.col("anchor_label")).cast("int")))
