"""K-means over vectors: all starts are seeded and moved together, one scan of the rows a step.

Seeding draws rows with the squared distance to the nearest chosen center as weight. A pass draws for each start several rows at once, by the
distances before it; the driver takes them in turn with the probability that the distance is still that large, which is the
same as one draw at a time. What a pass gives the driver has the size of the centers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import as_double, squared_distance
from ..storage import table
from .assign import nearest_center
from .edge_sort import matrix
from .successive import Clustering

#: Rows of a batch that meet all centers at once; rows drawn in a pass for each start, at most; tasks that sum partial results.
ROWS, DRAWS, SUMS = 2048, 64, 32


def centroids(assigned: DataFrame, rows: DataFrame) -> DataFrame:
    """center_id, dim, mean of the members of each cluster, in long form: whole vectors are summed before the shuffle, and only the
    means are spread out."""
    members = assigned.select("id", "center_id").join(rows.select("id", array_to_vector(as_double(F.col("embedding"))).alias("x")), "id")
    return members.groupBy("center_id").agg(Summarizer.mean(F.col("x")).alias("m")).select("center_id", F.posexplode(vector_to_array("m")).alias("dim", "mean"))


def lloyd_step(rows: DataFrame, centers: DataFrame) -> DataFrame:
    return centroids(nearest_center(rows, centers), rows)


def inertia(assigned: DataFrame) -> DataFrame:
    """One row: summed squared distance d of rows to their centers."""
    return assigned.agg(F.sum("d").alias("inertia"), F.count("*").alias("n"))


def center_rows(assigned: DataFrame, rows: DataFrame) -> DataFrame:
    """center_id, row_id: the member nearest to its cluster's centroid, ties to the earliest."""
    whole = centroids(assigned, rows).groupBy("center_id").agg(F.array_sort(F.collect_list(F.struct("dim", "mean"))).alias("c")).select("center_id", F.transform("c", lambda c: c["mean"]).alias("centroid"))
    members = assigned.select("id", "center_id").join(rows.select("id", "pos", "embedding"), "id").join(whole, "center_id")
    d = F.round(squared_distance(F.col("embedding"), F.col("centroid")), 9)
    return members.groupBy("center_id").agg(F.min(F.struct(d.alias("d"), "pos", "id")).alias("m")).select("center_id", F.col("m.id").alias("row_id"))


# --- Fitting ---------------------------------------------------------------------------------------------


def uniform(pos: np.ndarray, *salts: int) -> np.ndarray:
    """A number in (0, 1) for each place, made from the place and the salts alone."""
    x = pos.astype(np.uint64)
    for salt in (*salts, 0):
        x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def squared(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs by a matrix product; rounding never makes them negative."""
    return np.maximum((x * x).sum(axis=1)[:, None] + (centers * centers).sum(axis=1) - 2 * (x @ centers.T), 0)


def draws(pos: np.ndarray, x: np.ndarray, centers: np.ndarray, n: int, seed: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, rows) of starts by draws: of each draw the row of least key, which is a row with the squared distance to the start's centers
    (starts, centers, dimensions) as weight. Infinite keys: no row is away from the centers."""
    starts, have = centers.shape[:2]
    keys, best = np.empty((starts, n)), np.empty((starts, n), dtype=np.int64)
    for r in range(starts):
        away = squared(x, centers[r]).min(axis=1) if have else np.ones(len(x))
        with np.errstate(divide="ignore"):
            for t in range(n):
                key = -np.log(uniform(pos, seed, r, turn, t)) / away
                keys[r, t] = key.min()
                least = np.flatnonzero(key == keys[r, t])
                best[r, t] = least[pos[least].argmin()]
    return keys, best


def accepted(seed: int, start: int, turn: int, draw: int, now: float, then: float) -> bool:
    """Whether a row drawn when its distance was `then` is taken when it is `now`."""
    return uniform(np.array([draw]), seed, start, turn, 1 << 20)[0] * then < now


@dataclass
class Step:
    """Sums of a pass over the rows: by start and center the members' number and sum, by start the cost."""

    count: np.ndarray
    total: np.ndarray
    cost: np.ndarray


def partial(x: np.ndarray, centers: np.ndarray) -> Step:
    """The step of some rows: each goes to the nearest center of each start, the first of equals."""
    starts, k, width = centers.shape
    out = Step(np.zeros((starts, k)), np.zeros((starts, k, width)), np.zeros(starts))
    for low in range(0, len(x), ROWS):
        part = x[low : low + ROWS]
        label = squared(part, centers.reshape(-1, width)).reshape(len(part), starts, k).argmin(axis=2)
        for r in range(starts):
            one = np.zeros((len(part), k))
            one[np.arange(len(part)), label[:, r]] = 1
            out.count[r] += one.sum(axis=0)
            out.total[r] += one.T @ part
            out.cost[r] += ((part - centers[r][label[:, r]]) ** 2).sum()
    return out


def moved(step: Step, centers: np.ndarray) -> np.ndarray:
    """The means of the members; a center without members stays."""
    return np.where(step.count[..., None] > 0, step.total / np.maximum(step.count, 1)[..., None], centers)


def fit(draw: Callable[[np.ndarray, int, int], list], step: Callable[[np.ndarray], Step], spread: float, k: int, *, seed: int, n_init: int, max_iter: int, init: str, tol: float) -> tuple[np.ndarray, float, int]:
    """(centers, cost, steps) of the best start. draw(centers, n, turn) gives by start and draw a row's vector or None, step(centers) the sums; spread is
    the mean variance of a dimension. A start ends when its centers move by at most tol * spread in all, or after max_iter steps."""
    chosen: list[list[np.ndarray]] = [[] for _ in range(n_init)]
    turn = 0
    while any(len(c) < k for c in chosen):
        have = min(map(len, chosen))
        n = 1 if not have else k if init == "random" else min(DRAWS, max(4, have))
        # Starts that are ahead wait; centers that all have are what the draws go by.
        base = np.stack([np.stack(c[:have]) for c in chosen]) if have and init != "random" else np.zeros((n_init, 0, 0))
        found = draw(base, n if init != "random" else k, turn)
        for r, own in enumerate(found):
            if init == "random":
                chosen[r] = [x for x in own]
                continue
            if have:
                chosen[r] = chosen[r][:have]
            for t, x in enumerate(own):
                if len(chosen[r]) == k:
                    break
                if x is None:
                    chosen[r] += [chosen[r][0]] * (k - len(chosen[r]))
                    break
                then = squared(x[None], np.stack(chosen[r][:have])).min() if have else 1.0
                now = squared(x[None], np.stack(chosen[r])).min() if have else 1.0
                if accepted(seed, r, turn, t, now, then):
                    chosen[r].append(x)
        turn += 1
    centers = np.stack([np.stack(c) for c in chosen])
    live, steps = list(range(n_init)), 0
    while live and steps < max_iter:
        new = moved(step(centers[live]), centers[live])
        shift = ((new - centers[live]) ** 2).sum(axis=(1, 2))
        centers[live] = new
        live = [r for r, s in zip(live, shift) if s > tol * spread]
        steps += 1
    cost = step(centers).cost
    best = int(cost.argmin())
    return centers[best], float(cost[best]), steps


def _numbers(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())


def _draw(rows: DataFrame, seed: int) -> Callable[[np.ndarray, int, int], list]:
    """draws() over rows (pos, embedding): the least of each task, then of all."""

    def run(centers: np.ndarray, n: int, turn: int) -> list:
        shared = rows.sparkSession.sparkContext.broadcast(centers)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                pos, x = b.column(0).to_numpy(), matrix(b.column(1))
                keys, best = draws(pos, x, shared.value, n, seed, turn)
                slot, at = np.arange(keys.size, dtype=np.int64), best.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(keys.ravel()), pa.array(pos[at]), _numbers(x[at])], ["slot", "key", "pos", "x"])

        least = rows.select("pos", "embedding").mapInArrow(work, "slot long, key double, pos long, x array<double>").groupBy("slot").agg(F.min(F.struct("key", "pos", "x")).alias("m"))
        found = {r.slot: r.m for r in least.collect()}
        return [[np.array(found[r * n + t].x) if found[r * n + t].key < float("inf") else None for t in range(n)] for r in range(len(centers))]

    return run


def _step(rows: DataFrame) -> Callable[[np.ndarray], Step]:
    """partial() over rows (embedding): tasks sum what they see, SUMS tasks sum these by start and center, in a fixed order."""

    def run(centers: np.ndarray) -> Step:
        starts, k, width = centers.shape
        shared = rows.sparkSession.sparkContext.broadcast(centers)

        def flat(s: Step, part: int) -> pa.RecordBatch:
            cost = np.zeros((starts, k))
            cost[:, 0] = s.cost
            values = np.concatenate([s.count[..., None], cost[..., None], s.total], axis=2).reshape(starts * k, -1)
            return pa.RecordBatch.from_arrays([pa.array(np.arange(starts * k)), pa.array([part] * (starts * k), pa.int64()), _numbers(values)], ["slot", "part", "x"])

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Step(np.zeros((starts, k)), np.zeros((starts, k, width)), np.zeros(starts))
            for b in batches:
                if b.num_rows:
                    more = partial(matrix(b.column(0)), shared.value)
                    own = Step(own.count + more.count, own.total + more.total, own.cost + more.cost)
            yield flat(own, TaskContext.get().partitionId())

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for b in batches:
                for slot, x in zip(b.column(0).to_pylist(), matrix(b.column(2)) if b.num_rows else ()):
                    held[slot] = held.get(slot, 0) + x
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([*held], pa.int64()), pa.array([0] * len(held), pa.int64()), _numbers(np.stack([*held.values()]))], ["slot", "part", "x"])

        shape = "slot long, part long, x array<double>"
        # So many tasks as the partial results are worth, by the size of the centers: most passes are short.
        sums = min(SUMS, 1 + starts * k * width // 50_000)
        summed = rows.select("embedding").mapInArrow(work, shape).repartition(sums, "slot").sortWithinPartitions("slot", "part").mapInArrow(add, shape)
        values = np.zeros((starts * k, width + 2))
        for r in summed.collect():
            values[r.slot] = r.x
        values = values.reshape(starts, k, -1)
        return Step(values[..., 0], values[..., 2:], values[..., 1].sum(axis=1))

    return run


def _spread(rows: DataFrame) -> float:
    found = rows.agg(Summarizer.variance(array_to_vector(as_double(F.col("embedding")))).alias("v"), F.count("*").alias("n")).first()
    return float(np.mean(found.v.toArray()) * (found.n - 1) / max(1, found.n))


def kmeans_cluster(rows: DataFrame, k: int, *, seed: int = 0, n_init: int = 10, max_iter: int = 300, init: str = "k-means++", tol: float = 1e-4, on_step: Callable[[dict], None] | None = None) -> Clustering:
    """The best of n_init starts by cost, the first of equals; centers are the members nearest to the centroids. A cluster that ends
    without members isn't there. init: "k-means++", or "random" for k different rows. on_step is told of every pass over the rows. The driver and
    each task hold the centers of all starts: n_init * k vectors."""
    # Every pass takes its tasks from this table: the files that rows come from may be one.
    rows = table(rows.select("id", "pos", "label_name", "embedding").repartition("id"), "rows")
    n = rows.count()
    if not 1 <= k <= n or n_init < 1 or max_iter < 1 or tol < 0 or init not in ("k-means++", "random"):
        raise ValueError("k lies between 1 and the number of rows, n_init and max_iter are at least 1, tol isn't negative, init is k-means++ or random")
    log: list[dict] = []

    def told(name: str, f: Callable) -> Callable:
        def run(centers: np.ndarray, *more):
            log.append({"pass": name, "starts": len(centers), "rows": n})
            if on_step:
                on_step(log[-1])
            return f(centers, *more)

        return run

    best, cost, steps = fit(told("seed", _draw(rows, seed)), told("move", _step(rows)), _spread(rows), k, seed=seed, n_init=n_init, max_iter=max_iter, init=init, tol=tol)
    shared = rows.sparkSession.sparkContext.broadcast(best)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label = squared(matrix(b.column(1)), shared.value).argmin(axis=1) if b.num_rows else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(label.astype(str).tolist(), pa.string())], ["id", "center_id"])

    named = table(rows.select("id", "embedding").mapInArrow(place, f"id {dict(rows.dtypes)['id']}, center_id string"), "placed")
    heads = center_rows(named, rows)
    out = table(named.join(heads, "center_id").select("id", F.col("row_id").alias("center_id")).join(rows.select("id", "pos", "label_name"), "id"), "assigned")
    return Clustering(out, out, log, {"target_clusters": k, "seed": seed, "kmeans_init": init, "kmeans_n_init": n_init, "kmeans_max_iter": max_iter, "tol": tol, "steps": steps, "embedding_shape": [n, len(best[0])], "inertia": cost})
