"""Tables in the folder that driver and executors share, and ranks over whole tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset on one machine a temporary folder is set; on a cluster
    that is an error, since executors would each write to their own disk."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="quadrille-"))
    return sc.getCheckpointDir()


def table(df: DataFrame, label: str = "table") -> DataFrame:
    """df written once and read back: cuts the lineage, and a lost executor costs no recomputation. The
    files go when the application ends, or with release()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, place = _files(spark, path)
    files.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a table() whose rows no later plan reads."""
    files, place = _files(df.sparkSession, df._table_path)
    files.delete(place, True)


def _files(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def running_total(df: DataFrame, value: str, *order: Column | str, name: str = "before") -> DataFrame:
    """df with the sum of `value` over the rows before each in a total order, without any task that sees all rows: rows are dealt out by
    ranges of the order and summed within their partition; sums of the partitions before give the rest."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("at"))
    dealt = table(dealt.withColumn("part", F.shiftright("at", 33)), "ranges")
    own = dealt.groupBy("part").agg(F.sum(f"row.{value}").alias("whole"))
    earlier = own.select("part", (F.sum("whole").over(W.orderBy("part")) - F.col("whole")).alias("earlier"))
    within = F.sum(f"row.{value}").over(W.partitionBy("part").orderBy("at")) - F.col(f"row.{value}")
    return dealt.withColumn("within", within).join(earlier, "part").select("row.*", (F.col("earlier") + F.col("within")).alias(name))


def rank_rows(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """df with its 1-based place in a total order, without any task that sees all rows.

    Rows are dealt out by ranges of the order and numbered within their partition; sizes of the
    partitions before give the rest. The order must be total, or the places of tied rows are undefined.
    """
    dealt = table(df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("at")), "ranks")
    part = F.shiftright("at", 33)
    before = dealt.groupBy(part.alias("part")).count().withColumn("before", F.sum("count").over(W.orderBy("part")) - F.col("count")).drop("count")
    return dealt.withColumn("part", part).join(before, "part").select("row.*", (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(name))


#: Bins of a histogram of keys; rows of its border that are put in order.
BINS, BORDER = 1024, 100_000


def nth_row(df: DataFrame, n: int, key: str, tie: str, border: int = BORDER) -> tuple | None:
    """(key, tie) of the n-th row, counted from 1, in the order of key (finite numbers) and tie; None if there are fewer. Rows up to it are those with
    a less key, or an equal one and no greater tie.

    A histogram of the keys tells in which bin the row is; that bin is divided until it holds `border` rows at most, and these
    alone are put in order. Each turn is one aggregate over df, which should be a table; nothing is shuffled but counts. A key that more than
    `border` rows share is decided by ranking their ties in a distributed way."""
    if n < 1:
        return None
    held = df.select(F.col(key).cast("double").alias("key"), F.col(tie).alias("tie"))
    low, high, size = held.agg(F.min("key"), F.max("key"), F.count("*")).first()
    before = 0
    if size < n:
        return None
    while size > border and low < high:
        width = (high - low) / BINS
        if not low + width > low:
            break
        at = F.least(F.floor((F.col("key") - F.lit(low)) / F.lit(width)), F.lit(BINS - 1))
        bins = held.where(F.col("key").between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy("bin").collect()
        for b in bins:
            if before + b.n >= n:
                low, high, size = b.low, b.high, b.n
                break
            before += b.n
    inside = held.where(F.col("key").between(low, high))
    if size <= border:
        found = inside.orderBy("key", "tie").limit(n - before).orderBy(F.desc("key"), F.desc("tie")).first()
    else:
        found = rank_rows(inside, "key", "tie").where(F.col("rank") == n - before).first()
    return found["key"], found["tie"]


def up_to(cut: tuple | None, key: str, tie: str) -> Column:
    """Whether a row comes no later than nth_row() in the order; without one, no row does."""
    if cut is None:
        return F.lit(False)
    k = F.col(key).cast("double")
    return (k < F.lit(cut[0])) | ((k == F.lit(cut[0])) & (F.col(tie) <= F.lit(cut[1])))


def number_rows(df: DataFrame, name: str = "pos") -> DataFrame:
    """df with its place from 0 on, without gaps, in the order of its source; a column of that name is replaced.

    Rows of files go by the files' paths, then by their places in the file, whatever splits Spark makes: rows are counted by split, and
    the splits before give each its first place. Nothing is sorted and no row is shuffled by its place. Where df doesn't
    come from files, its partitions give the order."""
    try:
        source = df.metadataColumn("_metadata")
        keyed = df.select("*", source["file_path"].alias("_file"), source["file_block_start"].alias("_block"), F.monotonically_increasing_id().alias("_at"))
    except AnalysisException:
        at = F.monotonically_increasing_id()
        keyed = df.select("*", F.lit("").alias("_file"), F.shiftright(at, 33).alias("_block"), at.alias("_at"))
    splits = table(keyed.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows")), "splits")
    before = running_total(splits, "_rows", "_file", "_block", name="_before").drop("_rows")
    return keyed.join(before, ["_file", "_block"]).withColumn(name, F.col("_before") + F.col("_at") - F.col("_first")).drop("_file", "_block", "_at", "_first", "_before")
