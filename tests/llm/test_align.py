"""Alignment of two tokenizers against whole encodings and a comparison of all byte ranges."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from quadrille.llm import align

A, B = public_tokenizers.path(align.BYTE_BPE), public_tokenizers.path(align.PIECE_BPE)


@pytest.fixture(scope="module")
def known():
    return align.Tokenizers(A, B)


def _texts():
    rng = random.Random(5)
    parts = ["a", "b", "é", " ", "  ", "\n", "\t", "1", "2", "'s", "'re", "\x00", "中", "🙂", "　", "\x1c", "-", "<|endoftext|>", "<s>", "the", "ing", "\r", "́", "<0x41>", "ﬁ", "’", "The quick brown fox"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(150)]
    texts += [None, "", " ", "  ", "\n", "x ", " x", "foo\n  bar", "literal ▁ mark", "▁", "plain words again and again", "plain words again and again"]
    return [*texts, " ".join(f"word{i % 700}" for i in range(60_000)), "unbroken" * 40_000, "é" * 3000]


def _tokens(known, text):
    """Ids and byte ranges of whole encodings, or none."""
    if not text:
        return None
    whole, out = (" " + text).encode(), []
    for ids, names in ((known.a.encode(" " + text, add_special_tokens=False).ids, known.a_bytes), (known.b.encode(text), known.b_bytes)):
        at, spans = 0, []
        for i in ids:
            spans.append((i, at, at + len(names[i])))
            at = spans[-1][2]
        if b"".join(names[i] for i in ids) != whole:
            return None
        out.append(spans)
    return out


def _links(a, b):
    """All pairs of tokens whose ranges share bytes."""
    out, k = [], 0
    for i, lo, hi in a:
        while b[k][2] <= lo:
            k += 1
        m = k
        while m < len(b) and b[m][1] < hi:
            out.append((i, b[m][0]))
            m += 1
    return out


def expected(known, texts):
    found = [_tokens(known, t) for t in texts]
    links = [_links(*f) if f else [] for f in found]
    count = Counter(x for own in links for x in own)
    top = defaultdict(int)
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    rows = []
    for f, own in zip(found, links):
        if not f:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        ends = sorted({x[2] for x in f[0]} & {x[2] for x in f[1]})
        groups, at = [], [0, 0]
        for e in ends:
            said = []
            for side in (0, 1):
                own_ids = []
                while at[side] < len(f[side]) and f[side][at[side]][2] <= e:
                    own_ids.append(str(f[side][at[side]][0]))
                    at[side] += 1
                said.append(",".join(own_ids))
            groups.append("|".join(said))
        rows.append((len(f[0]), len(f[1]), len(ends), len(own), sum(count[x] == top[x[1]] for x in own), sum(count[x] for x in own), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return rows


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("broadcast", [align.BROADCAST, 150])
def test_brute_force(spark, known, broadcast):
    texts = _texts()
    rows = [(i if i % 11 else None, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(3).selectExpr("*", "7 AS n_a", "8 AS pairs", "9 AS best")
    got = align.align_documents(df, A, B, broadcast)
    assert got.columns == ["doc_id", *NAMES]
    want = expected(known, [t for _, t, _ in rows])
    assert sorted((str(r.doc_id), *(r[c] for c in NAMES)) for r in got.collect()) == sorted((str(i), *w) for (i, _, _), w in zip(rows, want))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert align.align_documents(df, A, B).count() == 0


def test_long_texts_go_in_parts(known):
    units = [u for part, _ in align.parts("some words " * 300_000) for u in part]
    assert "".join(units) == " " + "some words " * 300_000
    assert max(n for _, n in align.parts("some words " * 300_000)) < align.BATCH + 100


def test_links_of_a_batch():
    import numpy as np

    # " abc" + " de": A cuts 2|4 and 7, B cuts 3|4 and 6|7.
    totals, a_group, b_group, la, lb = align.align(np.array([2, 4, 7]), np.array([3, 4, 6, 7]), np.array([4, 7]))
    assert totals.T.tolist() == [[2, 2, 1, 3], [1, 2, 1, 2]]
    assert (a_group.tolist(), b_group.tolist()) == ([0, 0, 1], [0, 0, 1, 1])
    assert list(zip(la.tolist(), lb.tolist())) == [(0, 0), (1, 0), (1, 1), (2, 2), (2, 3)]


@pytest.mark.parametrize("kept", [2, 400])
def test_units_are_forgotten(monkeypatch, kept):
    """Units met again stay, others and too many go; what is encoded anew is the same."""
    monkeypatch.setattr(align, "KEPT", kept)
    t, fresh = align.Tokenizers(A, B), align.Tokenizers(A, B)
    rng, sizes = random.Random(3), []
    for _ in range(60):
        units = [f" common{rng.randint(0, 3)}" for _ in range(5)] + [f" rare{rng.randint(0, 10**6)}" for _ in range(10)]
        t.forget()
        sizes.append(len(t.at))
        fresh.clear()
        for x, y in zip(t.tokens(t.places(units)), fresh.tokens(fresh.places(units))):
            assert x.tolist() == y.tolist()
        assert len(t.at) == len(t.good) == len(t.used) == len(t.a_from) - 1 == len(t.b_from) - 1
    assert max(sizes) < 120
    assert (kept == 400) == (min(sizes[30:]) > 0)
