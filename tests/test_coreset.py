"""A round of the coreset against a version in one process that asks every member of every core."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadrille.operators import coreset, edge_sort
from quadrille.plans import catalog
from quadrille.plans.fixtures import K, SEED, V
from tests.conftest import SF


class Plain:
    """Rows (id, pos, vector) and their distances."""

    def __init__(self, spark, rows):
        self.spark, self.rows = spark, {i: (pos, np.asarray(v, dtype=float)) for i, pos, v in rows}
        self.at = {i: k for k, i in enumerate(self.rows)}
        x = np.stack([v for _, v in self.rows.values()])
        self.d = edge_sort.distances(x, x)

    def dist(self, a, b):
        return self.d[self.at[a], self.at[b]]

    def sample(self, active, n, seed):
        return sorted(active, key=lambda i: (hashlib.md5(f"{seed}:{self.rows[i][0]}".encode()).hexdigest(), i))[:n]

    def setup(self, active, sizes, seed):
        self.one, two = self.sample(active, sizes.first, 2 * seed + 1), self.sample(active, sizes.second, 2 * seed + 2)
        edges = sorted((self.dist(s, v), p, q, s, v) for p, s in enumerate(self.one) for q, v in enumerate(two) if s != v)
        own = defaultdict(list)
        for xr, (d, _, _, s, v) in enumerate(edges):
            own[s].append((xr, v, d))
        low = sizes.kernel + 5
        self.kernel = {s: e[: sizes.kernel] for s, e in own.items()}
        guards = {s: e[low : low + sizes.guards] for s, e in own.items()}
        rest = [i for i in active if i not in {*self.one, *two}]
        prox = {r: max([sum(self.dist(s, r) < d for _, _, d in g) for s, g in guards.items()], default=0) for r in rest}
        self.candidates = sorted(rest, key=lambda r: (prox[r], self.rows[r][0]))[: 3 * len(rest) // 4]
        self.core = {}
        for p, a in enumerate(self.one):
            for b in self.one[p + 1 :]:
                both = sorted((xr, side, v) for side, x in enumerate((a, b)) for xr, v, _ in self.kernel.get(x, []))
                if both:
                    last = both[-1][1]
                    s, t = (a, b) if last == 0 else (b, a)
                    self.core[s, t] = [v for z, (_, side, v) in enumerate(both, 1) if side != last and not 2 * sizes.kernel - 5 <= z <= 2 * sizes.kernel]

    def less(self, e, f):
        (s1, v1), (s2, v2) = e, f
        if not self.kernel.get(s1) or not self.kernel.get(s2):
            return True
        core = [v for _, v, _ in self.kernel[s2]] if s1 == s2 else self.core.get((s1, s2))
        if core:
            return not sum(not self.dist(s1, v1) < self.dist(c, v2) for c in core) > len(core) // 2
        core = self.core.get((s2, s1))
        return sum(not self.dist(s2, v2) < self.dist(c, v1) for c in core) > len(core) // 2 if core else True

    def sort(self, edges):
        if len(edges) < 2:
            return edges
        less = [self.less(e, edges[0]) for e in edges[1:]]
        return [*self.sort([e for e, x in zip(edges[1:], less) if x]), edges[0], *self.sort([e for e, x in zip(edges[1:], less) if not x])]

    def hashed(self, seed):
        pairs = self.spark.createDataFrame([(s, v) for s in self.one for v in self.candidates], "s string, v string")
        found = pairs.select("s", "v", F.xxhash64(F.lit(seed), "s", "v").alias("h")).collect()
        return [(r.s, r.v) for r in sorted(found, key=lambda r: (r.h, r.s, r.v))]

    def round(self, active, k, seed):
        n = len(active)
        self.setup(active, coreset.round_sizes(n, k), seed)
        out, seen = {s: s for s in self.one}, []
        for s, v in self.sort(self.hashed(seed)) if self.candidates else ():
            if v not in seen:
                seen.append(v)
                if len(seen) <= max(1, n // 2):
                    out[v] = s
        return out

    def cluster(self, k, seed):
        active, out, turn = list(self.rows), {}, 0
        while len(active) > 100:
            found = self.round(active, k, seed + turn)
            out |= found
            active = [i for i in active if i not in found]
            turn += 1
        return out | {i: i for i in active}

    def compress(self, placed, k):
        size = defaultdict(int)
        for c in placed.values():
            size[c] += 1
        centers = sorted(size, key=lambda c: (-size[c], c))[:k]
        return {i: min(centers, key=lambda c: (c != i, self.dist(i, c), centers.index(c))) for i in self.rows}


@pytest.fixture(scope="module")
def plain(spark):
    return Plain(spark, [(r.id, r.pos, r.embedding) for r in V(spark, SF).collect()])


def test_round(spark, plain):
    got = {r.id: r.center_id for r in catalog.QUERIES["algg_round"](spark, SF).collect()}
    assert got == plain.round(list(plain.rows), K, SEED)


def test_cluster_and_exact_k(spark, plain):
    want = plain.cluster(K, SEED)
    assert {r.id: r.center_id for r in catalog.QUERIES["algg_cluster"](spark, SF).collect()} == want
    assert {r.id: r.center_id for r in catalog.QUERIES["algg_cluster_exact_k"](spark, SF).collect()} == plain.compress(want, K)


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(str(i), i, f"l{i % 3}", rng.normal(size=4).tolist()) for i in range(160)], "id string, pos long, label_name string, embedding array<double>")
    sizes = coreset.round_sizes(160, 2)
    one, two = (coreset.table(x, "sample") for x in coreset.samples(rows, sizes, 0))
    kernel = coreset.table(coreset.kernels(coreset.edge_order(one, two), sizes), "kernels")
    return rows, sizes, one, kernel, coreset.non_sample(rows, one, two).select("id", "pos", "embedding")


@pytest.mark.parametrize("node, pivots, limit", [(10_000, 16, 1 << 26), (60, 1, 1 << 26), (20, 7, 100), (1, 1000, 1 << 26), (100, 40, 1 << 11)])
def test_order_is_the_same_at_any_size(spark, small, node, pivots, limit):
    rows, sizes, one, kernel, rest = small
    edges = edge_sort.edge_table(rest, edge_sort.blocks(one, kernel, rows, sizes.kernel, limit), 1)
    got = [(r.s, r.v) for r in sorted(edge_sort.sort_edges(edges, sizes.kernel, node, pivots).collect(), key=lambda r: r.ord)]
    plain = Plain(spark, [(r.id, r.pos, r.embedding) for r in rows.collect()])
    plain.setup(list(plain.rows), sizes, 0)
    plain.candidates = [r.id for r in rest.collect()]
    assert got == plain.sort(plain.hashed(1))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_the_test_is_the_literal_vote(seed):
    """One order statistic against asking every member of the core, with ties and kernels that aren't full."""
    rng = np.random.default_rng(seed)
    width = int(rng.integers(3, 8))
    held = rng.integers(0, width + 1, 2)
    ranks = np.full((2, width), edge_sort.NONE)
    order = rng.permutation(2 * width)
    for i, n in enumerate(held):
        ranks[i, :n] = np.sort(order[i * width : i * width + n])
    near = np.where(ranks != edge_sort.NONE, rng.integers(0, 4, (2, width)), np.inf)
    d, p = rng.integers(0, 4, 2).astype(float), np.array([0, int(rng.integers(0, 2))])
    if p[0] == p[1]:
        ranks[1], held = ranks[0], held[[0, 0]]
        near[1] = np.where(ranks[1] != edge_sort.NONE, rng.integers(0, 4, width), np.inf)
    both = edge_sort.Edges(p, d, ranks, edge_sort.middles(near))
    got = edge_sort.before(both.take(np.array([0])), both.take(np.array([1])), width)[0]
    merged = sorted((r, i, j) for i in (0, 1) for j, r in enumerate(ranks[i, : held[i]]))
    if not held.all():
        want = True
    elif p[0] == p[1]:
        want = not sum(not d[0] < x for x in near[1, : held[1]]) > held[1] // 2
    else:
        last = merged[-1][1]
        core = [near[1 - last, j] for z, (_, i, j) in enumerate(merged, 1) if i != last and not 2 * width - 5 <= z <= 2 * width]
        no = sum(not d[last] < x for x in core)
        want = (not no > len(core) // 2 if last == 0 else no > len(core) // 2) if core else True
    assert got == want


def test_vectors_that_cannot_be_compared_are_errors(spark, small):
    rows, sizes, one, kernel, rest = small
    bad = rest.limit(3).unionByName(spark.createDataFrame([("x", 1000, [1.0, None, 2.0, 3.0])], rest.schema))
    with pytest.raises(Exception, match="hold nulls"):
        edge_sort.edge_table(bad, edge_sort.blocks(one, kernel, rows, sizes.kernel), 1).collect()


def _random_edges(n, samples, width, seed, spread):
    rng = np.random.default_rng(seed)
    ranks = np.stack([np.sort(rng.choice(3 * samples * width, width, replace=False)) for _ in range(samples)])
    if seed % 2:
        ranks[0, width // 2 :] = edge_sort.NONE
    p = rng.integers(0, samples, n)
    near = np.where(ranks[p] != edge_sort.NONE, rng.normal(1.2, spread, (n, width)), np.inf)
    return edge_sort.Edges(p + 1, rng.normal(1, spread, n), ranks[p], edge_sort.middles(near))


@pytest.mark.parametrize("spread", [0.01, 0.1, 0.5])
def test_pivots_that_split_nothing_change_no_place(monkeypatch, spread):
    monkeypatch.setattr(edge_sort, "LARGE", 8)
    low = np.where(np.arange(300) % 3 == 0, 0, 100)
    for seed in range(10):
        edges = _random_edges(300, 5, 7, seed, spread)
        monkeypatch.setattr(edge_sort, "TURNS", 4)
        place, child = edge_sort.quicksort(low, edges, 7)
        monkeypatch.setattr(edge_sort, "TURNS", 1 << 40)
        want, pivots = edge_sort.quicksort(low, edges, 7)
        assert place.tolist() == want.tolist() and child.tolist() == pivots.tolist()
        i, j = np.random.default_rng(seed).integers(0, 300, (2, 500))
        cores = edge_sort.Cores(edges, edges, 7)
        assert all((a == b).all() for a, b in zip(cores.of(edges, i, edges, j), cores._of(edges, i, edges, j)))


def test_edges_that_answer_alike_take_few_levels(monkeypatch):
    """No pivot splits them: one level for each would make as many tests as pairs."""
    tests, plain = [], edge_sort.before_at
    monkeypatch.setattr(edge_sort, "before_at", lambda a, i, *more: tests.append(len(i)) or plain(a, i, *more))
    place, _ = edge_sort.quicksort(np.zeros(20_000, dtype=np.int64), _random_edges(20_000, 30, 19, 2, 0.01), 19)
    assert sorted(place) == [*range(20_000)] and sum(tests) < 100 * 20_000
