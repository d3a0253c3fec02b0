"""Successive sampling: sample centers, let the nearest part of the rows leave with them, and repeat."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import nth_row, rank_rows, release, table, up_to
from .assign import largest_clusters, nearest_center
from .ranking import sample


@dataclass
class Clustering:
    """assigned (id, center_id) is final; candidates are the clusters before compression to exactly k."""

    assigned: DataFrame
    candidates: DataFrame
    rounds: list[dict] = field(default_factory=list)
    parameters: dict = field(default_factory=dict)

    @property
    def compressed(self) -> bool:
        return self.assigned is not self.candidates


def sample_size(n: int, k: int, multiplier: float) -> int:
    return min(n, max(1, ceil(k * multiplier)))


def sorted_round(remaining: DataFrame, centers: DataFrame, profile: str = "f64") -> DataFrame:
    """id, center_id, d, is_self, label_name, rank of the remaining rows: centers first, then by distance, ties by id."""
    return rank_rows(nearest_center(remaining, centers, profile), F.desc("is_self"), "d", "id")


def unique_ids(rows: DataFrame) -> int:
    """The number of rows; ids that repeat are an error, as assignments go by id."""
    n, ids = rows.agg(F.count("*"), F.count_distinct("id")).first()
    if ids != n:
        raise ValueError("ids repeat or are null")
    return n


def successive_sampling(rows: DataFrame, k: int, *, multiplier: float = 1.0, cover: float = 0.5, seed: int = 0, final: int | None = None, profile: str = "f64", on_round: Callable[[dict], None] | None = None) -> Clustering:
    """Each round samples k * multiplier centers, and the nearest `cover` of the remaining rows join them. Rows that are
    left when no more than a sample remains become their own centers. final: keep so many of the largest clusters
    (fewer if there are fewer) and assign all rows to their centers anew. Logarithmically many rounds, each of which writes the remaining rows
    once, with their nearest centers; the border of what joins is found from histograms of the distances. on_round is told of each."""
    if k < 1 or multiplier <= 0 or not 0 < cover < 1 or (final is not None and final < 1):
        raise ValueError("k and final are at least 1, the multiplier positive, cover between 0 and 1")
    rows = table(rows.select("id", "pos", "label_name", "embedding"), "rows")
    n = unique_ids(rows)
    m, remaining, left = sample_size(n, k, multiplier), rows, n
    rounds, parts, held = [], [], []
    while left > m:
        centers = table(sample(remaining, m, seed + len(rounds)), "centers")
        covered = min(left, max(1, ceil(cover * left)))
        ids = [r.id for r in centers.orderBy("p").select("id").collect()]
        near = nearest_center(remaining, centers, profile, keep=("pos", "embedding"))
        near = table(near.withColumn("key", F.when(F.col("is_self"), -1.0).otherwise(F.col("d"))), "near")
        release(centers)
        held.append(near)
        inside = up_to(nth_row(near, covered, "key", "id"), "key", "id")
        parts.append(near.where(inside).select("id", "center_id"))
        rounds.append({"index": len(rounds) + 1, "n_remaining_before": left, "sample_size": m, "sample_center_ids": ids, "covered_count": covered, "n_remaining_after": left - covered})
        if on_round:
            on_round(rounds[-1])
        remaining = near.where(~inside).select("id", "pos", "label_name", "embedding")
        left -= covered
    parts.append(remaining.select("id", F.col("id").alias("center_id")))
    candidates = parts[0]
    for p in parts[1:]:
        candidates = candidates.unionByName(p)
    candidates = table(candidates.join(rows.select("id", "pos", "label_name"), "id"), "candidates")
    for x in held:
        release(x)
    assigned = candidates
    if final is not None:
        kept = largest_clusters(candidates, final)
        ordered = rank_rows(kept, F.desc("size"), "center_id", name="p").select(F.col("center_id").alias("id"), "p")
        centers = table(ordered.join(rows.select("id", "embedding"), "id"), "centers")
        assigned = table(nearest_center(rows, centers, profile, keep=("pos",)).select("id", "center_id", "pos", "label_name"), "assigned")
        release(centers)
    release(rows)
    return Clustering(assigned, candidates, rounds, {"target_clusters": k, "sample_size": m, "sample_multiplier": multiplier, "cover_fraction": cover, "seed": seed, "final_center_count": final})
