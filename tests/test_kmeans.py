"""K-means against the same draws and steps over one matrix."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.operators import kmeans
from quadrille.plans import catalog
from quadrille.plans.fixtures import K, SEED, V
from tests.conftest import SF


def plain(pos, x, k, **options):
    def draw(centers, n, turn):
        keys, best = kmeans.draws(pos, x, centers, n, options["seed"], turn)
        return [[x[best[r, t]] if np.isfinite(keys[r, t]) else None for t in range(n)] for r in range(len(centers))]

    return kmeans.fit(draw, lambda c: kmeans.partial(x, c), x.var(axis=0).mean(), k, **options)


def _rows(spark, x, parts=5):
    return spark.createDataFrame([(str(i), i, f"l{i % 3}", [float(y) for y in v]) for i, v in enumerate(x)], "id string, pos long, label_name string, embedding array<double>").repartition(parts)


@pytest.mark.parametrize("init", ["k-means++", "random"])
def test_equal_to_one_process(spark, init):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(40, 3)) + c for c in rng.normal(size=(6, 3)) * 4])
    options = {"seed": 3, "n_init": 4, "max_iter": 50, "init": init, "tol": 1e-4}
    told = []
    out = kmeans.kmeans_cluster(_rows(spark, x), 6, on_step=told.append, **options)
    centers, cost, steps = plain(np.arange(len(x)), x, 6, **options)
    assert out.parameters["inertia"] == pytest.approx(cost, rel=1e-12) and out.parameters["steps"] == steps
    label = kmeans.squared(x, centers).argmin(axis=1)
    groups = {}
    for r in out.assigned.collect():
        groups.setdefault(r.center_id, set()).add(int(r.id))
    assert sorted(map(sorted, groups.values())) == sorted([*np.flatnonzero(label == c)] for c in set(label))
    for c, own in groups.items():
        mean = x[sorted(own)].mean(axis=0)
        assert int(c) == min(own, key=lambda i: (round(((x[i] - mean) ** 2).sum(), 9), i))
    assert told == out.rounds and sum(t["pass"] == "move" for t in told) == steps + 1 and told[-1]["starts"] == 4


def test_the_query(spark):
    rows = V(spark, SF).orderBy("pos").collect()
    x = np.array([r.embedding for r in rows], dtype=float)
    centers, _, _ = plain(np.array([r.pos for r in rows]), x, K, seed=SEED, n_init=10, max_iter=300, init="k-means++", tol=1e-4)
    label = kmeans.squared(x, centers).argmin(axis=1)
    groups = {}
    for r in catalog.QUERIES["kmeans_cluster"](spark, SF).collect():
        groups.setdefault(r.center_id, []).append(int(r.id))
    assert sorted(map(sorted, groups.values())) == sorted([rows[i].pos for i in np.flatnonzero(label == c)] for c in set(label))


def test_draws_have_the_distance_as_weight():
    """Centers by batches of draws are as often what they are by one draw at a time."""
    x = np.array([[0.0], [1.0], [3.0], [3.5]])
    first, second = np.zeros(4), np.zeros((4, 4))
    for seed in range(4000):
        seen = []

        def draw(centers, n, turn, seed=seed):
            keys, best = kmeans.draws(np.arange(4), x, centers, n, seed, turn)
            return [[x[best[0, t]] if np.isfinite(keys[0, t]) else None for t in range(n)]]

        def step(centers, seen=seen):
            seen.append(centers.copy())
            return kmeans.partial(x, centers)

        kmeans.fit(draw, step, 1.0, 3, seed=seed, n_init=1, max_iter=1, init="k-means++", tol=0)
        a, b, _ = (int(np.flatnonzero(x[:, 0] == c)[0]) for c in seen[0][0, :, 0])
        first[a] += 1
        second[a, b] += 1
    assert np.abs(first / 4000 - 0.25).max() < 0.03
    away = (x - x.T) ** 2
    assert np.abs(second / second.sum(axis=1, keepdims=True) - away / away.sum(axis=1, keepdims=True)).max() < 0.06


def test_few_different_rows(spark):
    out = kmeans.kmeans_cluster(_rows(spark, np.array([[1.0, 2.0]] * 6 + [[5.0, 5.0]])), 4, n_init=2)
    assert out.assigned.select("center_id").distinct().count() == 2 and out.parameters["inertia"] == 0
    one = kmeans.kmeans_cluster(_rows(spark, np.array([[0.0], [2.0], [10.0]])), 1, n_init=2)
    assert one.parameters["inertia"] == pytest.approx(56) and {r.center_id for r in one.assigned.collect()} == {"1"}
    for bad in ({"k": 0}, {"k": 4}, {"k": 1, "tol": -1}, {"k": 1, "init": "other"}):
        with pytest.raises(ValueError):
            kmeans.kmeans_cluster(_rows(spark, np.array([[0.0], [2.0], [10.0]])), **bad)


def test_rows_of_one_file_are_dealt_out(spark, monkeypatch):
    seen = []
    plain_step = kmeans._step
    monkeypatch.setattr(kmeans, "_step", lambda rows: seen.append(rows.select(F.spark_partition_id().alias("p")).distinct().count()) or plain_step(rows))
    kmeans.kmeans_cluster(_rows(spark, np.random.default_rng(1).normal(size=(9000, 64)), 1), 3, n_init=1, max_iter=2)
    assert seen[0] > 1


def test_the_least_key_of_equals_is_the_earliest_place():
    x = np.array([[1.0], [1.0], [1.0]])
    keys, best = kmeans.draws(np.array([5, 3, 9]), x, np.array([[[1.0]]]), 2, 0, 0)
    assert np.isinf(keys).all() and (best == 1).all()
