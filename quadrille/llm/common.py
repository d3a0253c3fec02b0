"""What the operators share: inputs, tables in the shared folder, star-contracted components."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..storage import shared_dir

#: Words are maximal runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a text that are cut into words at once.
PART = 1 << 20


def text_parts(text: bytes) -> Iterator[bytes]:
    """A UTF-8 text in parts that end at white space, of PART bytes and the rest of a word."""
    start = 0
    while start < len(text):
        end = start + PART
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        yield text[start:end]
        start = end


def word_parts(text: bytes) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text, in lists whose size doesn't grow with the text."""
    return (part.split() for part in text_parts(text))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The rows in small batches: what Python makes of a batch is many times as large as the batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def row_keys(*columns: Column | str) -> list[Column]:
    """k1, k2: 128 bits that tell rows apart by these columns; equal rows have equal keys."""
    return [F.xxhash64(*columns).alias("k1"), F.xxhash64(F.lit("row"), *reversed(columns)).alias("k2")]


def whole_rows(df: DataFrame) -> DataFrame:
    """row (all columns of df) and k1, k2: 128 bits that tell rows apart by all their columns, nulls included."""
    own = [F.col(f"`{c}`") for c in df.columns]
    return df.select(F.struct(*own).alias("row"), *row_keys(*[x for c in own for x in (F.isnull(c), c)]))


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def table(df: DataFrame, label: str) -> DataFrame:
    """df written once to the shared folder and read back: later plans start from these files, so a
    lost executor costs no recomputation, and nothing upstream runs twice. The files go when the
    application ends, or with release()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    fs, place = _fs(spark, path)
    fs.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a table() whose rows no later plan reads."""
    fs, place = _fs(df.sparkSession, df._table_path)
    fs.delete(place, True)


def reclaim(spark: SparkSession) -> None:
    """Let Spark drop shuffle files that nothing refers to any more. It does so when the driver collects its
    garbage, which with much shuffled and little held may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def one_of_equal(rows: DataFrame) -> DataFrame:
    """One of the rows (row, k1, k2, ...) with equal keys."""
    return rows.withColumn("nth", F.row_number().over(W.partitionBy("k1", "k2").orderBy("k1"))).where("nth = 1")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the (u, v) edges can reach.

    Alternates large-star and small-star contraction, which takes a number of rounds logarithmic in
    the longest chain. Every round is two aggregates and a join over edges; no neighbour list is
    ever gathered. Nodes without edges don't appear.
    """
    flat = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = table(flat, "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        then = table(small, "edges")
        release(now)
        now, before, mark = then, mark, _mark(then)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Count and an order-free digest of the edges."""
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.expr("xxhash64(v, u) % 1000003"))).first())
