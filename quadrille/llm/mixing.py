"""Mixing sources to target weights: entropy balancing by distributed Newton steps on the dual.

Documents of one source and one size share a rate, so everything between the first count of words
and the last join runs on cells (source, size, number of documents). Only DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..storage import rank_rows
from .common import WORD, documents, one_of_equal, release, row_keys, table, whole_rows

#: Weights of the sources in code-point order, repeating; share of all words; most copies of a document.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Newton steps and settling rounds at most; both stop as soon as they have converged.
STEPS, ROUNDS = 60, 12
#: Documents of a cell are ranked within so many hash buckets, so that no cell meets in one task.
BUCKETS = 1024


def source_targets(sizes: DataFrame) -> DataFrame:
    """skey, source_size, target of each source: weights share SHARE of all words, no target stands
    above MOST times its source's size, and what is cut off is shared again by weight.

    Sharing the excess until none is above ends at one level t with target = min(cap, weight * t). Each round takes
    the sources at their cap out and shares the rest anew; t only rises, so it ends after at most as many rounds as there are
    ratios of cap and weight, in practice a few. A round is two sums over the sources.
    """
    named = rank_rows(sizes, "none", "source", name="place")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("place") - 1) % len(WEIGHTS) + 1).cast("int")).cast("double")
    rows = table(named.select("skey", "source_size", weight.alias("weight"), (F.col("source_size") * MOST).alias("cap")), "weights")
    total = rows.agg(F.sum("source_size")).first()[0] or 0.0
    level, at_cap = 0.0, -1
    while True:
        full = F.col("cap") < F.col("weight") * F.lit(level)
        r = rows.agg(F.count(F.when(full, 1)), F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(~full, F.col("weight")))).first()
        if r[0] == at_cap or not r[2]:
            break
        at_cap, level = r[0], (SHARE * total - r[1]) / r[2]
    return rows.select("skey", "source_size", F.least("cap", F.col("weight") * F.lit(level)).alias("target"))


def _rate(dual: Column, size: Column) -> Column:
    """exp(dual * size), at most MOST: of all rates with the source's words on target, those of least
    relative entropy to one copy each."""
    return F.least(F.lit(float(MOST)), F.exp(F.least(dual * size, F.lit(1.0))))


def solve_dual(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """skey, source_size, target, dual: the multiplier at which the rates meet each source's target.

    Newton steps on the concave dual, one aggregate over the cells each; a bracket that every step
    narrows takes over where a step would leave it. ln(target / words) and ln(MOST) bound the root,
    as every document that counts has a word at least.
    """
    from math import log

    ratio = F.col("target") / F.col("source_size")
    state = targets.where("source_size > 0").select("skey", "source_size", "target", F.lit(0.0).alias("dual"), F.least(F.lit(0.0), F.log(ratio)).alias("lo"), F.lit(log(MOST)).alias("hi"))
    # At a target of MOST times the words every rate is MOST, which the bracket's end gives.
    state = table(state.withColumn("dual", F.when(F.col("target") >= F.col("source_size") * MOST * (1 - 1e-12), F.col("hi")).otherwise(0.0)), "dual")
    words = F.col("n") * F.col("size")
    rate = F.exp(F.least(F.col("dual") * F.col("size"), F.lit(1.0)))
    for _ in range(STEPS):
        at = cells.where("size > 0").join(state, "skey").groupBy("skey").agg(F.sum(words * _rate(F.col("dual"), F.col("size"))).alias("got"), F.sum(F.when(rate < MOST, words * F.col("size") * rate).otherwise(0.0)).alias("slope"))
        now = state.join(at, "skey").withColumn("off", F.col("got") - F.col("target"))
        now = now.withColumn("lo", F.when(F.col("off") < 0, F.col("dual")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("off") > 0, F.col("dual")).otherwise(F.col("hi")))
        step = F.col("dual") - F.try_divide("off", "slope")
        done = F.abs("off") <= F.greatest(F.lit(0.25), F.col("target") * 1e-9)
        now = now.withColumn("dual", F.when(done, F.col("dual")).when((step > F.col("lo")) & (step < F.col("hi")), step).otherwise((F.col("lo") + F.col("hi")) / 2))
        then = table(now.select(*state.columns, done.alias("done")), "dual")
        left = then.where("not done").limit(1).count()
        release(state)
        state = then.drop("done")
        state._table_path = then._table_path
        if not left:
            break
    return state


def round_copies(cells: DataFrame, duals: DataFrame) -> DataFrame:
    """The cells with whole numbers of copies, 0 to MOST times their documents.

    Systematic rounding from the largest size down keeps each source within one document of its
    target. Then every round flips, for each source, the copies of one size that bring it nearest.
    """
    down = W.partitionBy("skey").orderBy(F.desc("size"))
    rated = cells.join(duals, "skey", "left").withColumn("mass", F.col("n") * F.coalesce(_rate(F.col("dual"), F.col("size")), F.lit(1.0)))
    run = F.sum("mass").over(down)
    rated = rated.withColumn("copies", (F.floor(run + 0.5) - F.floor(run - F.col("mass") + 0.5)).cast("long"))
    now = table(rated.select("skey", "size", "n", "target", F.greatest(F.lit(0).cast("long"), F.least("copies", F.col("n") * MOST)).alias("copies")), "cells")
    for _ in range(ROUNDS):
        off = now.groupBy("skey").agg((F.first("target", True) - F.sum(F.col("copies") * F.col("size"))).alias("off"))
        room = F.when(F.col("off") > 0, F.col("n") * MOST - F.col("copies")).otherwise(F.col("copies"))
        flips = F.least(room, F.greatest(F.lit(1).cast("long"), F.floor(F.abs("off") / F.col("size"))))
        left = F.abs(F.abs("off") - flips * F.col("size"))
        best = now.where("size > 0").join(off, "skey").where((room > 0) & (left < F.abs("off") - 1e-6)).groupBy("skey").agg(F.min(F.struct(left.alias("left"), "size", (flips * F.signum("off").cast("long")).alias("flips"))).alias("best"))
        best = table(best.select("skey", "best.size", "best.flips"), "flips")
        any_left = best.limit(1).count()
        if any_left:
            then = table(now.join(best, ["skey", "size"], "left").select("skey", "size", "n", "target", (F.col("copies") + F.coalesce("flips", F.lit(0))).alias("copies")), "cells")
            release(now)
            now = then
        release(best)
        if not any_left:
            break
    return now


def _mixed(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2, size, source_size, target, copies of every row of docs (doc_id, source, text, k1, k2)."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = table(docs.select("doc_id", "k1", "k2", "source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("skey"), size.alias("size"), F.xxhash64("doc_id", "k1").alias("h")), "sizes")
    cells = table(rows.groupBy("skey", "size").agg(F.count("*").alias("n"), F.first("source").alias("source")), "cells")
    sizes = cells.groupBy("skey").agg(F.first("source").alias("source"), F.sum(F.col("n") * F.col("size")).cast("double").alias("source_size")).withColumn("none", F.col("source").isNull())
    targets = table(source_targets(sizes), "targets")
    copies = round_copies(cells, solve_dual(cells, targets))
    # Of n documents of a cell, copies % n get one more than the others: those of the lowest hashes.
    cell = ["skey", "size"]
    rows = rows.withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int"))
    buckets = rows.groupBy(*cell, "bucket").count()
    buckets = buckets.withColumn("before", F.sum("count").over(W.partitionBy(*cell).orderBy("bucket")) - F.col("count"))
    buckets = buckets.join(copies.select(*cell, F.floor(F.col("copies") / F.col("n")).alias("each"), (F.col("copies") % F.col("n")).alias("extra")), cell).join(targets, "skey").drop("count")
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy(*cell, "bucket").orderBy("h", "doc_id", "k1"))).join(buckets.hint("merge"), [*cell, "bucket"])
    many = F.col("each") + (F.col("before") + F.col("rank") <= F.col("extra")).cast("long")
    return ranked.select("doc_id", "k1", "k2", "size", F.col("source_size").cast("long").alias("source_size"), "target", many.alias("copies"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken of every row of docs (doc_id, source, text).

    size counts words (null: 0). A null source is a source of its own, the last. Documents without a
    word have no say and keep one copy or two, of no words. Documents of one source and size that get
    unequal copies are told apart by a hash of doc_id, so reruns agree however the rows are dealt out; equal
    rows are alike. An empty table gives an empty table.
    """
    return _mixed(docs.select("doc_id", "source", "text", *row_keys("doc_id", "text"))).select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; all columns stay. Rows that agree in everything are told apart
    by nothing: together they return as often as they are taken together."""
    whole = whole_rows(docs)
    mixed = _mixed(whole.select("row.doc_id", "row.source", "row.text", "k1", "k2"))
    many = mixed.groupBy("k1", "k2").agg(F.sum("copies").cast("int").alias("copies")).where("copies > 0")
    return one_of_equal(whole.join(many, ["k1", "k2"])).select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op8_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(documents(spark, sf_dir, "doc_id", "source", "text"))
