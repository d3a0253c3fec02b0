"""The pipeline's stages against brute force, on the smallest tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quadrille.llm import pii
from quadrille.llm.common import table
from tests.llm.test_jaccard import _kept
from tests.llm.test_llm_operators import _targets, _words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(table(stage(spark, out[-1], SF), name))
    return out


def test_columns(stages):
    assert all(x.columns == stages[0].columns for x in stages[:-1])


def test_toxic_documents_go(spark, stages):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[1].collect()}
    clean = [d for d, t in labels.items() if not t]
    assert sum(d in kept for d in clean) / len(clean) > 0.97


def test_labelled_toxic_documents_go(spark):
    """On a table with enough of them to learn from."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.reject_toxic(spark, docs, sf).select("doc_id").collect()}
    toxic = [r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").join(docs, "doc_id", "left_semi").collect()]
    assert toxic and sum(d not in kept for d in toxic) / len(toxic) > 0.9


def test_one_of_each_group_stays(stages):
    """By brute force: five-word shingles, Jaccard similarity of 0.8 or more, over chains."""
    rows = sorted((r.doc_id, r.text) for r in stages[1].collect())
    assert Counter(r.doc_id for r in stages[2].collect()) == _kept(rows)


def test_personal_data_are_masked(stages):
    before = {r.doc_id: r.text for r in stages[2].collect()}
    after = {r.doc_id: r for r in stages[3].collect()}
    assert before.keys() == after.keys()
    assert all(r.text == pii.redact(before[d], pii.find_spans(before[d])) and r.n_chars == len(r.text) for d, r in after.items())


def test_mix(stages):
    sizes, took = Counter(), Counter()
    one = {}
    for r in stages[3].collect():
        sizes[r.source] += len(_words(r.text))
        one[r.doc_id] = r
    for r in stages[4].collect():
        assert r == one[r.doc_id]
        took[r.source] += len(_words(r.text))
    assert max(Counter(r.doc_id for r in stages[4].collect()).values()) <= 2
    for s, t in _targets(sizes).items():
        assert abs(took[s] - t) <= max(30, 0.02 * t)


def test_packed(stages):
    assert stages[5].agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048
    pieces = stages[5].groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).collect()
    copies = Counter(r.doc_id for r in stages[4].collect())
    assert all(r.n == r.doc_tokens * copies[r.doc_id] for r in pieces) and len(pieces) == len(copies)


def test_run_gives_the_stages_rows(spark, stages):
    """Copies of one document may lie in other sequences from run to run, its pieces' bytes don't change."""
    columns = ["doc_id", "doc_tokens"]
    total = lambda df: Counter({tuple(r[c] for c in columns): r.n for r in df.groupBy(*columns).agg(F.sum("length").alias("n")).collect()})
    found = corpus_pipeline.run(spark, SF)
    assert found.columns == stages[5].columns and total(found) == total(stages[5])


WIDE = "doc_id long, text string, lang string, source string, n_chars long, k1 long, k2 string, row int, _k1 int, rank int, copies int, spans string, nth int, root string, spans_ int"


def _awkward():
    """Nulls in each column, no words, repeated rows, rows that differ in one column only, one text under two ids."""
    base = " ".join(f"word{i}" for i in range(30))
    extra = (1, "x", 2, 3, 4, 5, "y", 6, "z", 7)
    rows = [(1, base, "en", "s1", 5), (1, base, "de", "s1", 5), (1, base, None, "s1", 5), (1, base, "s1", None, 5), (1, base, "en", "s1", 5), (2, base, "en", "s2", 5)]
    rows += [(None, None, None, None, None), (3, "", "en", "s1", 0), (4, None, "en", None, None), (None, "call +49 30 1234567", "en", "s2", 1), (5, "mail a@b.de " * 3, "en", "s2", 1), (6, "x " * 5000, "en", "s3", 1)]
    return [(*r, *extra) for r in rows]


def test_stages_on_awkward_rows(spark):
    docs = spark.createDataFrame(_awkward(), WIDE).repartition(3)
    kept = corpus_pipeline.reject_toxic(spark, docs, SF)
    assert kept.columns == docs.columns and Counter(map(tuple, kept.collect())) == Counter(_awkward())
    one = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    rows = [tuple(r) for r in one.collect()]
    assert one.columns == docs.columns and set(rows) <= set(_awkward())
    assert Counter(r[0] for r in rows) == Counter([1, 3, None, 5, 6]) and sorted(map(str, rows)) == sorted(str(tuple(r)) for r in corpus_pipeline.drop_near_duplicates(spark, docs.repartition(5), SF).collect())
    masked = corpus_pipeline.mask_personal_data(spark, docs, SF)
    texts = Counter(r.text for r in masked.collect())
    assert masked.columns == docs.columns and texts["call [PHONE]"] == 1 and texts["mail [EMAIL] " * 3] == 1 and texts[None] == 2
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    took = Counter(map(tuple, mixed.collect()))
    have = Counter(_awkward())
    assert mixed.columns == docs.columns and set(took) <= set(have) and all(n <= 2 * have[r] for r, n in took.items())
    packed = corpus_pipeline.pack_sequences(spark, docs, SF)
    assert packed.agg(F.sum("length")).first()[0] >= docs.count()


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], WIDE)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
