"""The quality classifier against direct normal equations and the definition of isotonic regression."""

import math
import random

import numpy as np
import pytest

from quadrille.llm import quality


def _level(y, w):
    """The nondecreasing fit of least squares: the greatest least mean over all intervals around a place."""
    n = len(y)
    mean = lambda a, b: sum(y[a : b + 1] * w[a : b + 1]) / sum(w[a : b + 1])
    return [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]


@pytest.mark.parametrize("seed", range(20))
def test_isotonic(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 15))
    at, y, w = np.sort(rng.normal(size=n)), rng.integers(0, 4, n).astype(float), rng.integers(1, 5, n).astype(float)
    knots, values = quality.isotonic(at, y, w)
    want = _level(y, w)
    groups: dict = {}
    for x, level, weight in zip(at, want, w):
        groups.setdefault(round(level, 9), []).append((x, weight))
    assert values == pytest.approx(sorted(groups)) and knots == pytest.approx([sum(x * v for x, v in groups[k]) / sum(v for _, v in groups[k]) for k in sorted(groups)])


def test_fit_is_the_direct_solution(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, len(quality.NAMES))).astype(np.float32)
    y, part = (x[:, 0] + x[:, 1] ** 2 + rng.normal(size=400) > 0.5).astype(float), rng.integers(0, 4, 400)
    rows = spark.createDataFrame([(v.tolist(), float(t), int(p)) for v, t, p in zip(x, y, part)], "x array<float>, y double, part int").repartition(3)
    model = quality.fit(rows)
    wide = x.astype(np.float64)
    assert model.mean == pytest.approx(wide.mean(axis=0), abs=1e-8) and model.scale == pytest.approx(wide.std(axis=0), abs=1e-8)
    z = model.features(wide)
    own = part > 0
    direct = np.linalg.solve(z[own].T @ z[own] + quality.RIDGE * own.sum() / quality.FEATURES * np.eye(z.shape[1]), z[own].T @ y[own])
    assert model.beta == pytest.approx(direct, abs=1e-6)
    raw = np.floor(np.clip(z[~own] @ model.beta, -1, 2) * quality.BINS / 3)
    bins = sorted(set(raw))
    level = _level(np.array([y[~own][raw == b].mean() for b in bins]), np.array([(raw == b).sum() for b in bins]))
    assert sorted(set(np.round(level, 9))) == pytest.approx(sorted(set(np.round(model.values, 9))))
    # The features approximate a Gaussian kernel.
    a, b = (wide[:40] - model.mean) / model.scale, np.clip((wide[:40] - model.mean) / model.scale, -8, 8)
    kernel = np.exp(-((b[:, None] - b[None]) ** 2).sum(axis=2) / 2 / quality.WIDTH**2)
    assert a.shape == b.shape and np.abs(z[:40, :-1] @ z[:40, :-1].T - kernel).mean() < 0.06


def test_statistics_of_awkward_texts():
    """Null and empty texts, and a very long one, by their definition."""
    assert not quality.statistics(b"").any()
    rng = random.Random(1)
    for text in (b"one", b"One TWO\nthree, 4", b" \n\t", b"w" * 3_000_000, " ".join(rng.choice(["aé", "Bb", "7,", "long" * 9]) for _ in range(400_000)).encode()):
        got, words, lines, n = quality.statistics(text), text.split(), text.split(b"\n"), len(text)
        assert got[0] == pytest.approx(math.log1p(n)) and got[1] == pytest.approx(math.log1p(len(words)))
        share = [text.count(bytes([b])) / n for b in set(text[:100_000])] if n < 100_000 else None
        assert share is None or got[16] == pytest.approx(-sum(p * math.log(p) for p in share))
        if words:
            sizes = np.array([len(w) for w in words], dtype=float)
            assert got[17:20] == pytest.approx([sizes.mean(), sizes.std(), math.log1p(sizes.max())])
            assert got[20:23] == pytest.approx([len(set(words)) / len(words), sum(not w.isalnum() for w in words) / len(words), sum(w.isupper() for w in words) / len(words)])
        assert got[23:27] == pytest.approx([math.log1p(len(lines)), math.log1p(n / len(lines)), len(set(lines)) / len(lines), sum(not x[:1].isalpha() for x in lines) / len(lines)])
