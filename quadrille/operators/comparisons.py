"""The comparison oracle: is d(a, b) < d(c, d)? Ties answer no."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import six_digits
from ..functions.vectors import half_distance, squared_distance

Distance = Callable[[Column, Column], Column]
#: Numeric profiles.
PROFILES: dict[str, Distance] = {"f64": squared_distance, "f16": half_distance}


class Comparator(Protocol):
    """Anything that adds a boolean column `answer` to rows with text or id columns a, b, c, d."""

    def compare(self, quads: DataFrame) -> DataFrame: ...


def pair_distances(pairs: DataFrame, items: DataFrame, profile: str = "f64") -> DataFrame:
    """pairs (left_id, right_id) with their distance d; an id without vector is an error."""
    distance = PROFILES[profile]
    left = items.select(F.col("id").alias("left_id"), F.col("embedding").alias("_a"))
    right = items.select(F.col("id").alias("right_id"), F.col("embedding").alias("_b"))
    return pairs.join(left, "left_id", "left").join(right, "right_id", "left").withColumn("d", distance(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def distance_matrix(left: DataFrame, right: DataFrame, profile: str = "f64") -> DataFrame:
    """left_id, right_id, d for every pair of two sets of rows, which is what this operator is for; one side is
    meant to be small (anchors, centers, samples), and Spark broadcasts it if it is."""
    a = left.select(F.col("id").alias("left_id"), F.col("embedding").alias("_a"))
    b = right.select(F.col("id").alias("right_id"), F.col("embedding").alias("_b"))
    return a.crossJoin(b).select("left_id", "right_id", PROFILES[profile](F.col("_a"), F.col("_b")).alias("d"))


class VectorComparator:
    """Answers from vectors of a table (id, embedding). An id without vector is an error. The distances are kept, and reasoning
    says them."""

    def __init__(self, items: DataFrame, profile: str = "f64") -> None:
        self.items, self.distance = items.select("id", "embedding"), PROFILES[profile]

    def compare(self, quads: DataFrame) -> DataFrame:
        """quads with d_ab, d_cd, answer and reasoning. Vectors of one pair at a time take part: those of a and b are gone before c and d are joined."""
        out = quads
        for x, y in ("ab", "cd"):
            for c in (x, y):
                out = out.join(self.items.select(F.col("id").alias(c), F.col("embedding").alias(f"_{c}")), c, "left")
            out = out.withColumn(f"d_{x}{y}", self.distance(F.col(f"_{x}"), F.col(f"_{y}"))).drop(f"_{x}", f"_{y}")
        said = F.concat(F.lit("embedding_sq_l2_ab="), six_digits(F.col("d_ab")), F.lit("; embedding_sq_l2_cd="), six_digits(F.col("d_cd")))
        return out.withColumn("answer", F.col("d_ab") < F.col("d_cd")).withColumn("reasoning", said)


def closer(comparator: Comparator, spark: SparkSession, a: str, b: str, c: str, d: str) -> bool:
    """One question, one answer: whether a and b are closer than c and d."""
    return comparator.compare(spark.createDataFrame([(a, b, c, d)], "a string, b string, c string, d string")).select("answer").first()[0]


def grouped_majority(answers: DataFrame, invert: str | None = None, groups: DataFrame | None = None) -> DataFrame:
    """grp, n, no, majority of answers (grp, answer): whether more than half, rounded down, say no. An
    inverted group turns the verdict. A tie is no majority. groups (grp, and the column that inverts) says which groups there are: one without answers has no
    majority either; without it, groups are those that have answers."""
    found = answers.groupBy("grp").agg(F.count("*").alias("n"), F.count_if(~F.col("answer")).alias("no"), *([F.first(invert).alias("_invert")] if invert and groups is None else []))
    if groups is not None:
        every = groups.select("grp", *([F.col(invert).alias("_invert")] if invert else []))
        found = every.join(found, "grp", "left").fillna(0, ["n", "no"])
    verdict = F.col("no") > F.floor(F.col("n") / 2)
    return found.withColumn("majority", F.when(F.col("_invert"), ~verdict).otherwise(verdict) if invert else verdict).select("grp", "n", "no", "majority")


def edges(left: DataFrame, right: DataFrame, profile: str = "f64") -> DataFrame:
    """left_id, right_id, d, left_p, right_p of all pairs of different ids of two samples (id, p, embedding)."""
    a = left.select(F.col("id").alias("left_id"), F.col("p").alias("left_p"), F.col("embedding").alias("_a"))
    b = right.select(F.col("id").alias("right_id"), F.col("p").alias("right_p"), F.col("embedding").alias("_b"))
    return a.crossJoin(b).where("left_id <> right_id").select("left_id", "right_id", "left_p", "right_p", PROFILES[profile](F.col("_a"), F.col("_b")).alias("d"))
