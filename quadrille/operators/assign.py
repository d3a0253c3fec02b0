"""Nearest centers, clusters and their compression."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from ..storage import rank_rows, release, table
from .comparisons import PROFILES
from .edge_sort import distances, matrix

#: Numbers (centers times dimensions) that travel at once.
ONE_ROW = 4_000_000


def nearest_center(rows: DataFrame, centers: DataFrame, profile: str = "f64", keep: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """id, center_id, d, is_self, label_name, and the columns to keep, of every row of rows (id, embedding, label_name); centers (id, p, embedding).

    A center stays with itself, others go to the nearest center, on a tie to the earliest; rows that repeat each return. Nothing is
    shuffled: up to `limit` numbers (ONE_ROW) of centers travel as one broadcast row; more of them travel in blocks of that size, each of which lowers
    the least distance that a row has so far. No centers: no rows."""
    limit, distance = ONE_ROW if limit is None else limit, PROFILES[profile]
    size, widest, count = centers.agg(F.coalesce(F.sum(F.size("embedding")), F.lit(0)), F.max(F.size("embedding")), F.count("*")).first()
    columns = ["id", "label_name", "embedding", *[c for c in keep if c != "embedding"]]
    kind = centers.schema["id"].dataType
    best = T.StructType([T.StructField("other", T.BooleanType()), T.StructField("d", T.DoubleType()), T.StructField("p", centers.schema["p"].dataType), T.StructField("center_id", kind)])
    near = rows.select(*columns)
    if size <= limit or profile != "f64":
        near = near.withColumn("best", F.lit(None).cast(best))
        for part in _parts(centers, 1 if size <= limit else -(-size // limit), count):
            packed = part.agg(F.collect_list(F.struct("p", F.col("id").alias("center_id"), F.col("embedding").alias("v"))).alias("centers"))
            least = F.array_min(F.transform("centers", lambda c: F.struct((c["center_id"] != F.col("id")).alias("other"), distance(F.col("embedding"), c["v"]).alias("d"), c["p"].alias("p"), c["center_id"].alias("center_id"))))
            near = near.crossJoin(F.broadcast(packed)).withColumn("best", F.least("best", least.cast(best))).drop("centers")
        near = near.where("best IS NOT NULL")
    else:
        near = _by_blocks(near, centers, best, max(1, limit // widest))
    shown = [F.col(c) for c in keep]
    return near.select("id", F.col("best.center_id").alias("center_id"), F.col("best.d").alias("d"), (~F.col("best.other")).alias("is_self"), "label_name", *shown)


def _parts(centers: DataFrame, n: int, count: int) -> list[DataFrame]:
    """The centers in n parts of about equal size, by a hash of their ids."""
    return [centers] if n == 1 else [centers.where(F.pmod(F.xxhash64("id"), F.lit(n)) == i) for i in range(n)]


class Near:
    """A block of centers in groups around some of them: a group is looked at only for rows that may have a nearer center in it."""

    def __init__(self, found: pa.Table) -> None:
        self.ids, self.p, self.x = found.column("id").combine_chunks(), found.column("p").combine_chunks(), matrix(found.column("embedding").combine_chunks())
        self.heads = self.x[:: max(1, int(len(self.x) ** 0.5))]
        home = _roughly(self.x, self.heads).argmin(axis=1)
        self.groups = [np.flatnonzero(home == g) for g in range(len(self.heads))]
        away = np.sqrt(((self.x - self.heads[home]) ** 2).sum(axis=1))
        self.radius = np.array([away[g].max(initial=0.0) for g in self.groups])
        self.order = self.p.to_numpy().astype(np.int64)

    def nearest(self, x: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distance, center) of the nearest center of each row that is nearer than `least`, or as near; center -1 where none is."""
        d, at = least.copy(), np.full(len(x), -1)
        scale = np.sqrt(max((x * x).sum(axis=1).max(initial=0), (self.x * self.x).sum(axis=1).max(initial=0)))
        reach = np.maximum(np.sqrt(_roughly(x, self.heads)) - self.radius - 1e-6 * (1 + scale), 0) ** 2
        for g in np.argsort(reach.min(axis=0), kind="stable"):
            rows = np.flatnonzero(reach[:, g] <= d)
            own = self.groups[g]
            if not len(rows) or not len(own):
                continue
            found = distances(x[rows], self.x[own])
            low = found.min(axis=1)
            first = np.where(found == low[:, None], self.order[own], np.iinfo(np.int64).max).argmin(axis=1)
            center = own[first]
            held = at[rows]
            better = (low < d[rows]) | ((low == d[rows]) & ((held < 0) | (self.order[center] < self.order[held])))
            d[rows[better]], at[rows[better]] = low[better], center[better]
        return d, at


def _roughly(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T), 0)


def _by_blocks(near: DataFrame, centers: DataFrame, best: T.StructType, step: int) -> DataFrame:
    """near with best, from blocks of `step` centers: each block is a broadcast and one pass through Python, one after the other in the same
    tasks. Distances are those of the column expression; matrix products and the triangle inequality only say which are needed."""
    numbered = table(rank_rows(centers.select("id", "p", "embedding"), "p", "id", name="_n"), "centers")
    arrow = to_arrow_type(best)
    out = near.withColumn("best", F.lit(None).cast(best))
    for low in range(0, numbered.count(), step):
        shared = near.sparkSession.sparkContext.broadcast(Near(numbered.where(F.col("_n").between(low + 1, low + step)).orderBy("_n").toArrow()))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block: Near = shared.value
            mine: dict = {}
            for i, name in enumerate(block.ids.to_pylist()):
                mine.setdefault(name, []).append(i)
            for b in batches:
                if not b.num_rows:
                    continue
                x, held = matrix(b.column("embedding")), b.column("best").to_pylist()
                least = np.array([h["d"] if h and h["other"] else np.inf for h in held])
                d, at = block.nearest(x, least)
                for i, (h, a) in enumerate(zip(held, at.tolist())):
                    if a >= 0:
                        one = (True, float(d[i]), block.p[a].as_py(), block.ids[a].as_py())
                        if h is None or one < (h["other"], h["d"], h["p"], h["center_id"]):
                            held[i] = dict(zip(("other", "d", "p", "center_id"), one))
                for i, name in enumerate(b.column("id").to_pylist()):
                    for a in mine.get(name, ()):
                        one = (False, float(distances(x[i : i + 1], block.x[a : a + 1])[0, 0]), block.p[a].as_py(), name)
                        h = held[i]
                        if h["other"] or one < (h["other"], h["d"], h["p"], h["center_id"]):
                            held[i] = dict(zip(("other", "d", "p", "center_id"), one))
                columns = [pa.array(held, arrow) if c == "best" else b.column(c) for c in b.schema.names]
                yield pa.RecordBatch.from_arrays(columns, b.schema.names)

        out = out.mapInArrow(run, out.schema)
    release(numbered)
    return out


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    """center_id, size, place: largest clusters first, ties by id."""
    sizes = assigned.groupBy("center_id").agg(F.count("*").alias("size"))
    return rank_rows(sizes, F.desc("size"), "center_id", name="place")


def nested_clusters(assigned: DataFrame, page: int = 1000, fields: Sequence[str] = ()) -> DataFrame:
    """center_id, size, page, members: ids in input order (pos), or structs of id and fields, in pages of bounded length,
    so that no task gathers a whole cluster."""
    ranked = rank_rows(assigned.select("center_id", "pos", "id", *fields), "center_id", "pos", "id")
    first = ranked.groupBy("center_id").agg(F.min("rank").alias("first"), F.count("*").alias("size"))
    paged = ranked.join(first, "center_id").withColumn("page", F.floor((F.col("rank") - F.col("first")) / page))
    members = F.array_sort(F.collect_list(F.struct("rank", F.struct("id", *fields).alias("row"))))
    return paged.groupBy("center_id", "size", "page").agg(F.transform(members, lambda m: m["row"] if fields else m["row"]["id"]).alias("members"))


def largest_clusters(assigned: DataFrame, k: int) -> DataFrame:
    """center_id, size of the k largest clusters, ties by id."""
    return assigned.groupBy("center_id").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "center_id").limit(k)


def compression_centers(assigned: DataFrame, k: int) -> DataFrame:
    """id, p of k centers: cluster centers by size, then rows of clusters in that order by id, then any row by
    id. assigned (id, center_id) covers all rows; more centers than rows is an error."""
    if k > (n := assigned.count()):
        raise ValueError(f"{k} centers of {n} rows")
    sizes = assigned.groupBy("center_id").agg(F.count("*").alias("size"))
    heads = sizes.select(F.col("center_id").alias("id"), F.lit(0).alias("turn"), (-F.col("size")).alias("order"), "center_id")
    rest = assigned.join(sizes, "center_id").select("id", F.lit(1).alias("turn"), (-F.col("size")).alias("order"), "center_id")
    first = heads.unionByName(rest).groupBy("id").agg(F.min(F.struct("turn", "order", "center_id")).alias("o"))
    picked = first.orderBy("o.turn", "o.order", "o.center_id", "id").limit(k)
    return picked.select("id", F.row_number().over(W.orderBy("o.turn", "o.order", "o.center_id", "id")).alias("p"))
