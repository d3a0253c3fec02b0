"""The tables that queries run on, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.text_rows import vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Parameters of all queries: clusters, the anchor, where seeds start.
K, ANCHOR, SEED = 10, "0", 0


def query(sql: str | None = None):
    """Register a function under its name, with SQL that gives the same rows."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = "WITH RECURSIVE " + sql.strip() if sql.lstrip().startswith("v AS") else sql
        return f

    return put


def V(spark: SparkSession, d: str) -> DataFrame:  # noqa: N802
    return vectors(spark, f"{d}/embeddings.parquet")


def T(spark: SparkSession, d: str) -> DataFrame:  # noqa: N802
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    return docs.join(labels, "doc_id", "left").select("doc_id", "text", "lang", "source", "quality")


def centers(rows: DataFrame, n: int = K) -> DataFrame:
    """Fixed centers: the first n places."""
    return rows.where(F.col("pos") < n).select("id", (F.col("pos") + 1).alias("p"), "embedding")


#: The vectors, as SQL sees them.
VIEW = "v AS (SELECT vec_id::VARCHAR AS id, vec_id AS pos, label, 'class_' || label AS label_name, embedding AS e FROM embeddings)"


def dist(a: str, b: str) -> str:
    return f"list_reduce(list_transform(list_zip({a}, {b}), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)), lambda x, y: x + y)"


def norm2(a: str) -> str:
    return f"list_reduce(list_transform({a}, lambda x: x::DOUBLE * x::DOUBLE), lambda x, y: x + y)"


def half_sql(x: str) -> str:
    big = "4398046511105::DOUBLE"
    return f"(CASE WHEN abs({x}) >= 0.00006103515625 THEN {x} * {big} - ({x} * {big} - {x}) ELSE round_even({x} * 16777216, 0) / 16777216 END)"


def key_sql(pos: str, seed: int) -> str:
    return f"md5('{seed}:' || {pos})"


def sample_sql(name: str, source: str, n: str, seed: int) -> str:
    return f"{name} AS (SELECT *, row_number() OVER (ORDER BY {key_sql('pos', seed)}, id) AS p FROM {source} QUALIFY p <= {n})"


#: Rows assigned to the nearest of K fixed centers.
ASSIGNED = f"""c AS (SELECT id AS center_id, pos + 1 AS p, e AS ce FROM v WHERE pos < {K}),
n AS (SELECT v.id, v.pos, v.label_name, c.center_id, {dist('v.e', 'c.ce')} AS d, v.id = c.center_id AS is_self,
  row_number() OVER (PARTITION BY v.id ORDER BY (v.id <> c.center_id), {dist('v.e', 'c.ce')}, c.p) AS r FROM v, c),
a AS (SELECT id, pos, label_name, center_id, d, is_self FROM n WHERE r = 1)"""
