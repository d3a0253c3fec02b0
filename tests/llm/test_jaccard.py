"""Near copies by Jaccard similarity against brute force over all pairs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quadrille.llm import jaccard, simhash


def _set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _kept(rows):
    """Ids that are the smallest of their group."""
    sets, low = [_set(t) for _, t in rows], list(range(len(rows)))
    alike = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) >= 0.8]
    for _ in rows:
        for i, j in alike:
            low[i] = low[j] = min(low[i], low[j])
    return Counter(rows[i][0] for i in set(low))


def _texts():
    """Copies with words changed, from hardly to half of them, chains of changes, short and empty texts."""
    rng = random.Random(5)
    out = [None, "", " \n", "one two", "One  two", "one two three four five", "one two three four six"]
    for _ in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([12, 60, 300]))]
        out.append(" ".join(base))
        for share in (0.005, 0.01, 0.02, 0.04, 0.1, 0.5):
            out.append(" ".join(f"x{rng.randrange(3000)}" if rng.random() < share else w for w in base))
    chain = [f"c{i}" for i in range(80)]
    for i in range(40):
        chain[i * 2] = f"d{i}"
        out.append(" ".join(chain))
    return list(enumerate(out))


@pytest.mark.parametrize("crowd", [1, 3, 16])
def test_near_copies_by_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    monkeypatch.setattr(jaccard, "SIDE", 5 if crowd == 1 else 512)
    rows = _texts()
    docs = spark.createDataFrame([*rows, rows[9], (None, rows[9][1])], "doc_id long, text string")
    assert Counter(r.doc_id for r in jaccard.keep_one(docs).collect()) == _kept(rows)
    assert jaccard.keep_one(docs.where("false")).count() == 0


def test_the_stage_drops_near_copies_beyond_two_bits(spark):
    base = [f"w{i * 7919 % 1000}" for i in range(200)]
    near = [*base[:50], "new", *base[51:150], "newer", *base[151:]]
    rows = [(1, " ".join(base), "s"), (2, " ".join(near), "s"), (3, " ".join(base[:120]), "s")]
    assert (simhash.fingerprint(rows[0][1].encode()) ^ simhash.fingerprint(rows[1][1].encode())).bit_count() > 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == {1, 3}


def test_fingerprints_propose_pairs_that_share_no_band(spark):
    """Near copies within two bits are linked without any band, and only if their sets are similar."""
    base = [f"w{i * 7919 % 1000}" for i in range(400)]
    texts = [" ".join(base), " ".join([*base[:-1], "new"]), " ".join(f"v{i}" for i in range(400))]
    rows = jaccard.sketches(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"))
    rows = rows.withColumn("bands", F.array().cast("array<long>"))
    fps = {r.doc_id: r.fp for r in rows.collect()}
    assert ((fps[0] ^ fps[1]) & (2**64 - 1)).bit_count() <= 2
    keys = {r.doc_id: bytes(r.key) for r in rows.collect()}

    def sets(wanted):
        whole = jaccard.whole_sets(spark.createDataFrame([(keys[i], t) for i, t in enumerate(texts)], "key binary, text string"))
        return whole.join(wanted, "key", "left_semi")

    found = {bytes(r.node): bytes(r.root) for r in jaccard.links(rows.select("key", "n", "fp", "bands"), sets).collect()}
    assert found.keys() == {keys[0], keys[1]} and len(set(found.values())) == 1
    assert jaccard.links(rows.select("key", "n", "fp", "bands"), sets, 1.0).count() == 0
