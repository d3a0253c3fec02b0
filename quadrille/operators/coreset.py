"""A coreset from weak comparisons: rounds that sample, order edges by a noisy-proof test, and peel off the safe half.

Samples, their edges, kernels and cores are tables, as candidates and their edges are. Only vectors of samples travel to tasks, in
blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..storage import nth_row, rank_rows, release, table, up_to
from .assign import compression_centers, nearest_center
from .comparisons import edges
from .edge_sort import BLOCK, DELTA, blocks, distances, edge_table, matrix, sort_edges
from .ranking import sample
from .successive import Clustering, unique_ids

#: Rows below which no round starts.
TERMINAL = 100


@dataclass(frozen=True)
class Sizes:
    """Sizes of a round over n rows. The numbers in round_sizes() are fixed values of the algorithm."""

    first: int
    second: int
    kernel: int
    guards: int


def round_sizes(n: int, k: int, first: float = 1.0, second: float = 1.0) -> Sizes:
    ell = max(1, max(n, 2).bit_length() - 1)
    kernel = max(12, int(1.2 * ell))
    return Sizes(min(n, ceil(first * max(6, 3 * k))), min(n, ceil(second * max(24, 8 * k, 80))), kernel, max(1, kernel // 3))


def samples(active: DataFrame, sizes: Sizes, seed: int) -> tuple[DataFrame, DataFrame]:
    """Two samples by two seeds, numbered p; they may overlap."""
    return sample(active, sizes.first, 2 * seed + 1), sample(active, sizes.second, 2 * seed + 2)


def non_sample(active: DataFrame, one: DataFrame, two: DataFrame) -> DataFrame:
    return active.join(one.select("id").union(two.select("id")).distinct(), "id", "left_anti")


def edge_order(one: DataFrame, two: DataFrame) -> DataFrame:
    """s, v, d, xr: edges between the samples, nearest first, ties in the order of the samples. Their number
    depends on k only, but on its square; so they are ranked by ranges."""
    return rank_rows(edges(one, two), "d", "left_p", "right_p", name="xr").select(F.col("left_id").alias("s"), F.col("right_id").alias("v"), "d", "xr")


def _ranked(ordered: DataFrame) -> DataFrame:
    return ordered.withColumn("r", F.row_number().over(W.partitionBy("s").orderBy("xr")))


def kernels(ordered: DataFrame, sizes: Sizes) -> DataFrame:
    """The nearest edges of each s."""
    return _ranked(ordered).where(F.col("r") <= sizes.kernel).select("s", "v", "d", "xr")


def guards(ordered: DataFrame, sizes: Sizes) -> DataFrame:
    """A few edges of each s, DELTA behind its kernel; none where it has too few edges."""
    low = sizes.kernel + DELTA
    return _ranked(ordered).where(F.col("r").between(low + 1, low + sizes.guards)).select("s", "v", "d")


def core_prime(one: DataFrame, kernel: DataFrame, sizes: Sizes) -> DataFrame:
    """s, t, v: for each pair of samples both kernels are merged by edge rank. The sample whose edge comes last is s;
    its core against t is t's kernel without the merged ranks from 2 * kernel - DELTA to 2 * kernel."""
    a = one.select(F.col("id").alias("a"), F.col("p").alias("pa"))
    b = one.select(F.col("id").alias("b"), F.col("p").alias("pb"))
    pairs = a.crossJoin(b).where("pa < pb").select("a", "b")
    k = kernel.select("s", "v", "xr")
    both = pairs.join(k, F.col("a") == k.s).select("a", "b", F.lit(0).alias("side"), "v", "xr").unionByName(pairs.join(k, F.col("b") == k.s).select("a", "b", F.lit(1).alias("side"), "v", "xr"))
    pair = W.partitionBy("a", "b")
    ranked = both.withColumn("zr", F.row_number().over(pair.orderBy("xr"))).withColumn("last", F.max(F.struct("xr", "side")).over(pair)["side"])
    kept = ranked.where((F.col("side") != F.col("last")) & ~F.col("zr").between(2 * sizes.kernel - DELTA, 2 * sizes.kernel))
    first = F.col("last") == 0
    return kept.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("s"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("t"), "v")


def proximity(rest: DataFrame, one: DataFrame, guard: DataFrame, limit: int = BLOCK) -> DataFrame:
    """rest with prox: the most guards of any one sample that lie farther from it than the row does; 0 without guards. Samples
    with guards travel in blocks of `limit` bytes of vectors, so rows aren't shuffled and what travels doesn't grow with k."""
    held = table(guard.groupBy("s").agg(F.sort_array(F.collect_list("d")).alias("g")).join(one.select(F.col("id").alias("s"), "p", "embedding"), "s").select("p", "embedding", "g"), "guards")
    size = held.agg(F.max(F.size("embedding")), F.max("p"), F.max(F.size("g"))).first()
    out = rest.withColumn("prox", F.lit(0))
    step = max(1, limit // (8 * max(1, (size[0] or 0) + (size[2] or 0))))
    for low in range(0, size[1] or 0, step):
        found = held.where(F.col("p").between(low + 1, low + step)).orderBy("p").toArrow()
        if len(found):
            lists = found.column("g").combine_chunks()
            g = np.full((len(found), size[2]), -np.inf)
            for i, own in enumerate(lists.to_pylist()):
                g[i, : len(own)] = own
            out = out.mapInArrow(_nearer(rest.sparkSession.sparkContext.broadcast((matrix(found.column("embedding").combine_chunks()), g))), out.schema)
    release(held)
    return out


def _nearer(shared):
    """Raise prox of rows (embedding, prox) by a block of samples (vectors, distances of guards)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, g = shared.value
        step = max(1, (1 << 20) // max(1, g.size))
        for b in batches:
            x, prox = matrix(b.column("embedding")), b.column("prox").to_numpy()
            for low in range(0, len(x), step):
                d = distances(x[low : low + step], vectors)
                most = (d[:, :, None] < g).sum(axis=2).max(axis=1)
                prox = np.concatenate([prox[:low], np.maximum(prox[low : low + step], most), prox[low + step :]])
            columns = [pa.array(prox.astype(np.int32)) if c == "prox" else b.column(c) for c in b.schema.names]
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return run


def guard_filter(rest: DataFrame, one: DataFrame, guard: DataFrame) -> DataFrame:
    """The three quarters of the rows, rounded down, of least proximity, ties by place (places don't repeat)."""
    found = table(proximity(rest, one, guard), "proximity")
    return found.where(up_to(nth_row(found, 3 * found.count() // 4, "prox", "pos"), "prox", "pos"))


def nearest_edges(ordered: DataFrame) -> DataFrame:
    """s, v, ord: of each v the edge that comes first."""
    return ordered.groupBy("v").agg(F.min(F.struct("ord", "s")).alias("e")).select("e.s", "v", "e.ord")


def safe_prefix(nearest: DataFrame, n_active: int) -> DataFrame:
    """The first half, of the number of active rows, of the nearest edges: at least one of them, all if fewer."""
    found = table(nearest, "nearest")
    cut = nth_row(found, max(1, n_active // 2), "ord", "v")
    return found if cut is None else found.where(up_to(cut, "ord", "v"))


def one_round(active: DataFrame, n: int, k: int, seed: int, first: float = 1.0, second: float = 1.0) -> tuple[DataFrame, dict]:
    """(assigned (id, center_id) of the rows that leave, the round's log)."""
    sizes = round_sizes(n, k, first, second)
    one, two = (table(x, "sample") for x in samples(active, sizes, seed))
    rest = non_sample(active, one, two).repartition("id")
    ordered = table(edge_order(one, two), "edges")
    kernel = kernels(ordered, sizes)
    chosen = table(guard_filter(rest, one, guards(ordered, sizes)).select("id", "pos", "embedding"), "candidates")
    near, safe = None, 0
    filtered = chosen.count()
    if filtered:
        near = nearest_edges(sort_edges(edge_table(chosen, blocks(one, kernel, active, sizes.kernel), seed), sizes.kernel))
    out = one.select("id", F.col("id").alias("center_id"))
    if near is not None:
        out = out.unionByName(safe_prefix(near, n).select(F.col("v").alias("id"), F.col("s").alias("center_id")))
    out = table(out, "round")
    left = out.count()
    names = [[r.id for r in x.orderBy("p").select("id").collect()] for x in (one, two)]
    safe = left - len(names[0])
    log = {"n_active_before": n, "sample1_size": len(names[0]), "sample2_size": len(names[1]), "edge_sample_count": ordered.count(), "window_size": sizes.kernel, "dislocation_bound": DELTA}
    log |= {"filtered_count": filtered, "safe_count": safe, "removed_count": left, "n_active_after": n - left, "sample1_center_ids": names[0], "sample2_center_ids": names[1]}
    for x in (one, two, ordered, chosen):
        release(x)
    return out, log


def coreset_cluster(rows: DataFrame, k: int, *, correctness: float = 0.85, first: float = 1.0, second: float = 1.0, window_multiplier: float = 2.0, terminal_multiplier: float = 0.01, sample_fraction_cap: float | None = None, window_size: int | None = None, max_rounds: int | None = None, seed: int = 0, final: int | None = None, on_round: Callable[[dict], None] | None = None) -> Clustering:
    """Rounds until TERMINAL rows are left or the rounds are used up; what is left are centers of their own. final:
    exactly so many centers, padded from the largest clusters, and all rows assigned anew. correctness and the window and
    terminal multipliers are recorded and change nothing; the cap and the window size can't be set. on_round is told of each round."""
    if sample_fraction_cap is not None or window_size is not None:
        raise ValueError("sample_fraction_cap and window_size can't be set")
    if k < 1 or not 0 <= correctness <= 1 or min(first, second, window_multiplier, terminal_multiplier) <= 0 or (max_rounds is not None and max_rounds < 1) or (final is not None and final < 1):
        raise ValueError("a parameter is out of range")
    rows = table(rows.select("id", "pos", "label_name", "embedding").repartition("id"), "rows")
    n = unique_ids(rows)
    limit = max_rounds or max(n, 2).bit_length()
    active, left, parts, rounds = rows, n, [], []
    while left > TERMINAL and len(rounds) < limit:
        out, log = one_round(active, left, k, seed + len(rounds), first, second)
        parts.append(out)
        rounds.append({"index": len(rounds) + 1, **log})
        if on_round:
            on_round(rounds[-1])
        active = table(active.join(out.select("id"), "id", "left_anti"), "active")
        left -= log["removed_count"]
    placed = active.select("id", F.col("id").alias("center_id"))
    for p in parts:
        placed = placed.unionByName(p)
    candidates = table(placed.join(rows.select("id", "pos", "label_name"), "id"), "candidates")
    assigned = candidates
    if final is not None:
        centers = compression_centers(candidates, final).join(rows.select("id", "embedding"), "id")
        assigned = table(nearest_center(rows, centers).select("id", "center_id").join(rows.select("id", "pos", "label_name"), "id"), "assigned")
    return Clustering(assigned, candidates, rounds, {"target_clusters": k, "oracle_correctness_probability": correctness, "sample1_multiplier": first, "sample2_multiplier": second, "window_multiplier": window_multiplier, "terminal_multiplier": terminal_multiplier, "sample_fraction_cap": None, "nearest_edge_strategy": "adversarial_sort", "seed": seed, "final_center_count": final})
