"""Nearest centers by blocks, selection by histograms, and what comparisons say."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille import storage
from quadrille.functions.text import six_digits
from quadrille.operators import assign, comparisons, coreset, successive


def _rows(spark, x, first=0):
    return spark.createDataFrame([(str(first + i), first + i, f"l{i % 3}", [float(y) for y in v]) for i, v in enumerate(x)], "id string, pos long, label_name string, embedding array<double>")


@pytest.mark.parametrize("profile, limit", [("f64", 40), ("f64", 7), ("f64", 4000), ("f16", 40)])
def test_blocks_give_what_one_row_gives(spark, profile, limit):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(150, 3)), rng.integers(0, 2, (80, 3)), rng.normal(size=(20, 3)) + 50])
    rows = _rows(spark, x)
    rows = rows.unionByName(rows.where("pos % 9 = 0")).unionByName(rows.where("pos = 4").withColumn("embedding", F.array(*map(F.lit, [9.0, 9.0, 9.0])))).repartition(4)
    centers = rows.dropDuplicates(["id"]).where("pos % 4 = 1").select("id", (F.col("pos") * 7 % 251).cast("int").alias("p"), "embedding")
    columns = ("id", "center_id", "d", "is_self", "label_name", "pos")
    want = sorted(tuple(r[c] for c in columns) for r in assign.nearest_center(rows, centers, profile, keep=("pos",)).collect())
    found = assign.nearest_center(rows, centers, profile, keep=("pos",), limit=limit)
    assert sorted(tuple(r[c] for c in columns) for r in found.collect()) == want and len(want) == rows.count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and ("BroadcastNestedLoopJoin" not in plan or profile == "f16" or limit == 4000)
    assert assign.nearest_center(rows, centers.limit(0), profile).count() == 0 and assign.nearest_center(rows.limit(0), centers, profile, limit=limit).count() == 0


@pytest.mark.parametrize("border", [1, 7, 1000])
def test_the_nth_row(spark, border):
    rng = random.Random(border)
    keys = [rng.choice([0.0, 1e-9, 1.0, rng.random(), -rng.random(), 1e6]) for _ in range(300)]
    rows = storage.table(spark.createDataFrame([(k, f"{i:03}") for i, k in enumerate(keys)], "key double, id string").repartition(5))
    order = sorted((k, f"{i:03}") for i, k in enumerate(keys))
    for n in (1, 2, 60, 150, 299, 300):
        cut = storage.nth_row(rows, n, "key", "id", border)
        assert cut == order[n - 1]
        assert rows.where(storage.up_to(cut, "key", "id")).count() == n
    assert storage.nth_row(rows, 301, "key", "id") is None and storage.nth_row(rows, 0, "key", "id") is None
    assert rows.where(storage.up_to(None, "key", "id")).count() == 0


def test_six_digits(spark):
    rng = random.Random(2)
    values = [0.0, 1.0, -1.0, 0.5, 123456.0, 1234567.0, 0.0001, 0.00001, 1e-300, 1e300, 999999.5, 9.999999, float("inf"), float("-inf"), float("nan")]
    values += [rng.uniform(-1, 1) * 10.0 ** rng.randint(-12, 12) for _ in range(500)]
    got = [r.t for r in spark.createDataFrame([(v,) for v in values], "v double").select(six_digits(F.col("v")).alias("t")).collect()]
    assert got == [f"{v:.6g}" for v in values]


def test_reasoning_says_the_distances(spark):
    rows = _rows(spark, [[0, 0], [3, 0], [0, 0.001]])
    quads = spark.createDataFrame([("0", "1", "0", "2")], "a string, b string, c string, d string")
    one = comparisons.VectorComparator(rows).compare(quads).first()
    assert one.reasoning == "embedding_sq_l2_ab=9; embedding_sq_l2_cd=1e-06" and one.answer is False


def test_groups_without_answers(spark):
    answers = spark.createDataFrame([(1, True), (1, False), (2, False)], "grp int, answer boolean")
    groups = spark.createDataFrame([(1, False), (2, False), (3, False), (4, True)], "grp int, turned boolean")
    got = {r.grp: (r.n, r.no, r.majority) for r in comparisons.grouped_majority(answers, "turned", groups).collect()}
    assert got == {1: (2, 1, False), 2: (1, 1, True), 3: (0, 0, False), 4: (0, 0, True)}


def test_repeated_ids_are_refused(spark):
    rows = _rows(spark, np.arange(6)[:, None])
    for bad in (rows.unionByName(rows.limit(1)), rows.withColumn("id", F.when(F.col("pos") > 0, F.col("id")))):
        for f in (successive.successive_sampling, coreset.coreset_cluster):
            with pytest.raises(ValueError, match="ids repeat"):
                f(bad, 2)


def test_rounds_are_told(spark):
    rng = np.random.default_rng(5)
    rows = _rows(spark, rng.normal(size=(150, 2)))
    for f in (successive.successive_sampling, coreset.coreset_cluster):
        told = []
        out = f(rows, 3, on_round=told.append)
        assert told == out.rounds and told
        counted = "covered_count" if f is successive.successive_sampling else "removed_count"
        own = out.assigned.count()
        before, after = ("n_remaining_before", "n_remaining_after") if f is successive.successive_sampling else ("n_active_before", "n_active_after")
        assert own == 150 and [t["index"] for t in told] == list(range(1, len(told) + 1))
        assert told[0][before] == 150 and all(t[before] - t[counted] == t[after] for t in told) and all(a[after] == b[before] for a, b in zip(told, told[1:]))
