"""Exact top-k search: branch and bound over dimension blocks in vertical layout."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import table

SCALE, K, EVERY = 256, 5, 50
#: Dimensions that are accumulated between two compactions.
STRIDE = 8
#: Vectors of a block of candidates, and of a block of queries; candidates that give queries their floors.
CANDIDATES, QUERIES, SEED = 16384, 8192, 4096
#: Bytes of values of a block, and of the candidates that give floors, whatever the number of dimensions.
BYTES, SEED_BYTES = 1 << 23, 1 << 21
#: Queries that are searched together, and the part of their pairs with candidates that is followed pair by pair.
TOGETHER, SPARSE = 32, 1 / 8
#: Bytes of all queries up to which they are broadcast.
BROADCAST = 64 << 20
#: Columns of a block.
BLOCK = ["ids", "dims", "vals", "masses"]
#: Doubles hold all whole numbers up to here.
EXACT = 2.0**53


def quantize(df: DataFrame, every: int = 1) -> DataFrame:
    """vec_id and ints: floor(SCALE * x) of each component. Rows whose vec_id is null, whose vector is
    null, empty, or holds a null or non-finite component take no part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    rows = rows.where(F.col("vec_id") % every == 0) if every > 1 else rows
    return rows.select("vec_id", F.transform(x, lambda v: F.floor(v * SCALE)).alias("ints"))


def in_order(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """keys and values (a row for each dimension) by falling norm, and the norms of what is left of each vector before the
    first and after each STRIDE dimensions, a little above their true values against rounding."""
    squares = np.add.reduceat(values.astype(np.float64) ** 2, range(0, len(values), STRIDE), axis=0)
    left = np.zeros((len(squares) + 1, len(keys)))
    left[:-1] = np.sqrt(squares[::-1].cumsum(axis=0)[::-1]) * (1 + 1e-9)
    order = np.lexsort((keys, -left[0]))
    return keys[order], np.ascontiguousarray(values[:, order]), np.ascontiguousarray(left[:, order])


def vertical_blocks(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of up to size vectors and BYTES of values (or one vector) of a partition, by falling norm: ids, one run of values for each dimension, and
    what in_order() says is left. Shorter vectors are filled up with zeros, which add nothing to an inner product."""

    def block(ids: list, vectors: list) -> pa.RecordBatch:
        wide = max(map(len, vectors))
        values = np.zeros((wide, len(vectors)), dtype=np.int64)
        for i, v in enumerate(vectors):
            values[: len(v), i] = v
        keys, values, left = in_order(np.array(ids, dtype=np.int64), values)
        return pa.RecordBatch.from_arrays([pa.array([keys.tobytes()]), pa.array([wide], pa.int32()), pa.array([values.tobytes()]), pa.array([left.tobytes()])], BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        vectors: list = []
        wide = 0
        for batch in batches:
            flat = batch.column(1)
            starts = flat.offsets.to_numpy()
            values = flat.values.to_numpy(zero_copy_only=False)
            for i, key in enumerate(batch.column(0).to_numpy(zero_copy_only=False)):
                vector = values[starts[i] : starts[i + 1]]
                wide = max(wide, len(vector))
                if ids and (len(ids) == size or 8 * wide * (len(ids) + 1) > BYTES):
                    yield block(ids, vectors)
                    ids, vectors, wide = [], [], len(vector)
                ids.append(key)
                vectors.append(vector)
        if ids:
            yield block(ids, vectors)

    return rows.mapInArrow(run, "ids binary, dims int, vals binary, masses binary")


def _open(wide: int, ids: bytes, dims: int, values: bytes, masses: bytes | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's keys, values and norms, filled up to `wide` dimensions; one without masses is put in order."""
    keys = np.frombuffer(ids, dtype=np.int64)
    own = np.frombuffer(values, dtype=np.int64).reshape(dims, len(keys))
    if masses is None:
        keys, own, left = in_order(keys, own)
    else:
        left = np.frombuffer(masses).reshape(-1, len(keys))
    whole, mass = np.zeros((wide, len(keys)), dtype=np.int64), np.zeros((-(-wide // STRIDE) + 1, len(keys)))
    whole[:dims], mass[: len(left)] = own, left
    return keys, whole, mass


def _kind(q: np.ndarray, c: np.ndarray) -> type:
    """Doubles where a score, and each partial sum, which are at most dims * |q| * |c|, are exact; whole numbers of any size
    elsewhere."""
    top = [int(np.abs(x).max(initial=0)) for x in (q, c)]
    return np.float64 if len(q) * top[0] * top[1] < EXACT else object


def head(block: tuple, n: int) -> tuple:
    """The first n vectors of a block."""
    keys, values, left = _open(block[1], *block)
    return keys[:n].tobytes(), block[1], values[:, :n].tobytes(), left[:, :n].tobytes()


def seed_block(blocks: DataFrame) -> tuple | None:
    """SEED vectors, of SEED_BYTES at most, of one block, cut where the block lies; None without blocks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x = [c[row].as_py() for c in batch.columns]
                first = head(tuple(x), min(SEED, max(1, SEED_BYTES // (8 * x[1]))))
                yield pa.RecordBatch.from_arrays([pa.array([v], c.type) for v, c in zip(first, batch.columns)], batch.schema.names)

    one = blocks.limit(1).mapInArrow(cut, blocks.schema).first()
    return one and tuple(one)


def floors(queries: tuple, candidates: tuple, k: int) -> np.ndarray:
    """For each query of a block its k-th highest score among a block of candidates, which no result of it falls below; minus
    infinity where that isn't known."""
    wide = max(queries[1], candidates[1])
    ids, q, _ = _open(wide, *queries)
    keys, c, _ = _open(wide, *candidates)
    if len(keys) <= k or _kind(q, c) is object:
        return np.full(len(ids), -np.inf)
    scores = q.T.astype(np.float64) @ c.astype(np.float64)
    scores[ids[:, None] == keys] = -np.inf
    return np.partition(scores, len(keys) - k, axis=1)[:, len(keys) - k]


def search_block(queries: tuple, candidates: tuple, k: int, floor: np.ndarray | None = None) -> Iterator[tuple[int, int, int]]:
    """(query_id, vec_id, score) of each query's k best in one block of candidates, ties to smaller ids; what is below the
    query's floor is left out.

    Candidates lie by falling norm. The first ones are scored whole for a threshold of each query, unless its floor is higher. TOGETHER
    queries then gain STRIDE dimensions at a time, and what can't reach a threshold any more goes: what is missing
    from a score is at most the product of the norms of both vectors' remaining dimensions. Candidates are compacted where half of
    them are of no use to any of the queries, and pairs are where SPARSE of them stay.
    """
    wide = max(queries[1], candidates[1])
    ids, q, left_q = _open(wide, *queries)
    keys, c, left_c = _open(wide, *candidates)
    kind = _kind(q, c)
    q, c = q.astype(kind), c.astype(kind)
    least = np.full(len(ids), -np.inf, dtype=kind) if floor is None else floor.astype(kind)
    if len(keys) > k:
        scores = q.T @ c[:, : 8 * k]
        scores[ids[:, None] == keys[: 8 * k]] = -np.inf
        least = np.maximum(least, np.sort(scores, axis=1)[:, -k]) if scores.shape[1] >= k else least
    bound = least.astype(np.float64)
    bound -= np.where(np.isinf(bound), 0, np.abs(bound)) * 1e-9
    # The norm that a candidate needs; those of smaller norm are at the end.
    need = np.where(bound > 0, bound / np.maximum(left_q[0], np.finfo(float).tiny), -np.inf)
    open_ = np.flatnonzero(need <= left_c[0].max(initial=0))
    for at in range(0, len(open_), TOGETHER):
        own = open_[at : at + TOGETHER]
        alive = np.arange(np.searchsorted(-left_c[0], -need[own].min(), side="right"))
        part, cc = np.zeros((len(own), len(alive)), dtype=kind), c[:, : len(alive)]
        pairs = None
        for n, d in enumerate(range(0, wide, STRIDE)):
            if pairs is None:
                part = part + q[d : d + STRIDE, own].T @ cc[d : d + STRIDE]
                stay = part.astype(np.float64) + left_q[n + 1, own][:, None] * left_c[n + 1, alive] >= bound[own][:, None]
                if np.count_nonzero(stay) <= SPARSE * stay.size:
                    i, j = np.nonzero(stay)
                    part, pairs = part[i, j], (own[i], alive[j])
                elif np.count_nonzero(use := stay.any(axis=0)) <= len(use) / 2:
                    part, cc, alive = part[:, use], cc[:, use], alive[use]
            else:
                i, j = pairs
                part = part + (q[d : d + STRIDE, i] * c[d : d + STRIDE, j]).sum(axis=0)
                stay = part.astype(np.float64) + left_q[n + 1, i] * left_c[n + 1, j] >= bound[i]
                part, pairs = part[stay], (i[stay], j[stay])
        i, j = pairs or (np.repeat(own, len(alive)), np.tile(alive, len(own)))
        part = part.ravel()
        good = np.flatnonzero((part >= least[i]) & (ids[i] != keys[j]))
        i, low, part = i[good], keys[j[good]], part[good]
        order = np.lexsort((low, -part, i)) if kind is np.float64 else np.array(sorted(range(len(i)), key=lambda x: (i[x], -part[x], low[x])), dtype=np.int64)
        i, low, part = i[order], low[order], part[order]
        best = np.arange(len(i)) - np.searchsorted(i, i) < k
        yield from zip(ids[i[best]].tolist(), low[best].tolist(), map(int, part[best]))


def _meet(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """Each block of candidates with each block of queries. The queries are broadcast only if their measured bytes are at most
    BROADCAST; beyond it the partitions of both sides meet pairwise."""
    size = queries.agg(F.coalesce(F.sum(F.octet_length("q_vals") + F.octet_length("q_masses")), F.lit(0)).alias("n")).first().n
    return candidates.crossJoin(F.broadcast(queries) if size <= BROADCAST else queries.hint("shuffle_replicate_nl"))


def top_k(df: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of df (vec_id, embedding) whose vec_id is divisible by
    `every`, the k rows of highest inner product of quantized vectors, ties to smaller ids.

    Rows that share the query's vec_id are its own and no candidates; another id twice in the table is two
    candidates. Both sides are cut into blocks of bounded size, which are put in order and measured once. SEED vectors of one block give
    each query a floor before any search, so a block whose norms can't reach it is left at once. Then every block of queries meets every
    block of candidates, and each meeting returns at most k rows a query, of which most are below the floor and stay away.
    """
    candidates = table(vertical_blocks(quantize(df), CANDIDATES), "candidates")
    queries = vertical_blocks(quantize(df, every), QUERIES)
    queries = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns])
    seed, n = seed_block(candidates), len(BLOCK)

    def floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x = [c[row].as_py() for c in batch.columns]
                floor = floors(tuple(x), seed, k)
                yield pa.RecordBatch.from_arrays([*batch.slice(row, 1).columns, pa.array([floor.tobytes()])], [*batch.schema.names, "q_floor"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x = [c[row].as_py() for c in batch.columns]
                found = [*search_block(tuple(x[n:-1]), tuple(x[:n]), k, np.frombuffer(x[-1]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)] if found else [pa.array([], pa.int64())] * 3, ["query_id", "vec_id", "score"])

    queries = table(queries.mapInArrow(floored, "q_ids binary, q_dims int, q_vals binary, q_masses binary, q_floor binary"), "queries")
    best = _meet(candidates, queries).mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_branch_and_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


TOP_K_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
