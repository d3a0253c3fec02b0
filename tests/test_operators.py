"""Edge rules of the operators, by hand and by chance."""

import json
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from py4j.protocol import Py4JJavaError

from pyspark.errors import PySparkException as _PySparkException
from pyspark.sql import functions as F

from quadrille import cli
from quadrille.functions import text as X
from quadrille.functions import vectors as E
from quadrille.operators import assign, comparisons, coreset, judge, kmeans, metrics, ranking, report, successive
from quadrille.plans import catalog
from quadrille.sources import keys, text_rows
from quadrille.storage import rank_rows
from quadrille.streaming.assign_stream import assign_stream
from tests.conftest import SF

#: What an action raises when a task does.
FAILS = (_PySparkException, Py4JJavaError)


def _items(spark, vectors, labels=None):
    rows = [(str(i), i, labels[i] if labels else "a", [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "id string, pos long, label_name string, embedding array<float>")


def _assigned(spark, pairs):
    return spark.createDataFrame([(str(i), c, name) for i, (c, name) in enumerate(pairs)], "id string, center_id string, label_name string")


def test_rank_rows_is_a_permutation(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 7)
    got = rank_rows(df, F.desc("k"), "id").collect()
    want = sorted(range(1000), key=lambda i: (-(i % 7), i))
    assert {r.id: r["rank"] for r in got} == {x: n + 1 for n, x in enumerate(want)}
    assert rank_rows(df.where("false"), "id").count() == 0


def test_normalized_ranking_ties_at_nine_digits(spark, tmp_path):
    """Multiples of one vector have unit vectors that differ in the last bits only: they rank by id."""
    rows = [(0, [1.0, 0.0, 0.0, 0.0], 0)] + [(i, [x * i for x in (3.0, 5.0, 7.0, 11.0)], 0) for i in range(1, 200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.QUERIES["rank_normalized"](spark, str(tmp_path)).orderBy("rank").collect()
    assert [r.id for r in got] == sorted(str(i) for i in range(1, 200))


def test_rounding_goes_by_the_scaled_double(spark):
    x = [0.0, 0.1234565, 1.0000005, 2.5e-9, 0.49999999999999994, 1.9999999995]
    df = spark.createDataFrame([(y,) for y in x], "x double")
    for digits in (6, 9):
        scale = 10.0**digits
        assert [r.y for r in df.select(E.rounded(F.col("x"), digits).alias("y")).collect()] == [np.floor(y * scale + 0.5) / scale for y in x]


def test_ranking_without_pairs(spark):
    for relevant in ([1, 1], [0, 0], []):
        rows = spark.createDataFrame([(i + 1, y) for i, y in enumerate(relevant)], "rank long, relevant int")
        m = ranking.inversions(rows).first()
        assert (m.inversions, m.inversion_rate, m.auc, m.n_items) == (0, 0.0, 1.0, len(relevant))


def test_ranking_counts_inversions(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 60).tolist()
    m = ranking.inversions(spark.createDataFrame([(i + 1, v) for i, v in enumerate(y)], "rank long, relevant int")).first()
    assert m.inversions == sum(y[j] == 0 for i in range(60) if y[i] for j in range(i)) and m.max_inversions == sum(y) * (60 - sum(y))


def test_relevance_is_binary(spark):
    with pytest.raises(FAILS):
        ranking.inversions(spark.createDataFrame([(1, 2)], "rank long, relevant int")).collect()


def test_metrics_by_hand(spark):
    one = metrics.evaluate(_assigned(spark, [("c", "x")] * 4)).first()
    assert (one.purity, one.adjusted_rand_index, one.normalized_mutual_information, one.rand_index) == (1, 1, 1, 1)
    single = metrics.evaluate(_assigned(spark, [(str(i), "x" if i < 2 else "y") for i in range(4)])).first()
    assert (single.pairwise_precision, single.purity, single.pairwise_recall) == (1, 1, 0)
    mixed = metrics.evaluate(_assigned(spark, [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")])).first()
    assert mixed.adjusted_rand_index == pytest.approx(-0.5) and mixed.mutual_information == pytest.approx(0)


def test_metrics_refuse(spark):
    twice = spark.createDataFrame([("1", "a", "x"), ("1", "b", "x")], "id string, center_id string, label_name string")
    for rows in (twice, twice.where("false")):
        with pytest.raises(FAILS):
            metrics.evaluate(rows).collect()


def test_metrics_do_not_see_names(spark):
    rng = np.random.default_rng(2)
    pairs = [(str(a), str(b)) for a, b in rng.integers(0, 4, (50, 2))]
    first, second = (metrics.evaluate(_assigned(spark, p)).first().asDict() for p in (pairs, [("z" + c, "w" + n) for c, n in pairs]))
    assert first == pytest.approx(second)


def test_ties_answer_no(spark):
    items = _items(spark, [[0], [1], [2], [3]])
    quads = spark.createDataFrame([("0", "1", "2", "3"), ("0", "1", "0", "2"), ("0", "2", "0", "1")], "a string, b string, c string, d string")
    got = {(r.a, r.b, r.c, r.d): r.answer for r in comparisons.VectorComparator(items).compare(quads).collect()}
    assert got == {("0", "1", "2", "3"): False, ("0", "1", "0", "2"): True, ("0", "2", "0", "1"): False}


def test_majority_needs_more_than_half(spark):
    rows = [(0, i < 6) for i in range(12)] + [(1, i < 5) for i in range(12)]
    got = {r.grp: r.majority for r in comparisons.grouped_majority(spark.createDataFrame(rows, "grp int, answer boolean")).collect()}
    assert got == {0: False, 1: True}


@pytest.mark.parametrize("one_row", [0, assign.ONE_ROW])
def test_nearest_center_rules(spark, monkeypatch, one_row):
    """Ties go to the earlier center, a center stays with itself even beside an equal vector."""
    monkeypatch.setattr(assign, "ONE_ROW", one_row)
    items = _items(spark, [[0], [2], [1], [0], [2]])
    centers = items.where("id in ('0', '1', '3')").withColumn("p", F.when(F.col("id") == "1", 1).when(F.col("id") == "0", 2).otherwise(3))
    got = {r.id: r.center_id for r in assign.nearest_center(items, centers).collect()}
    assert got == {"0": "0", "1": "1", "2": "1", "3": "3", "4": "1"}


def test_compression_pads(spark):
    rows = spark.createDataFrame([("1", "1"), ("10", "1"), ("2", "1"), ("3", "3"), ("4", "3")], "id string, center_id string")
    assert [r.id for r in assign.compression_centers(rows, 4).orderBy("p").collect()] == ["1", "3", "10", "2"]
    with pytest.raises(ValueError):
        assign.compression_centers(rows, 6)


def test_successive_sampling_covers_all(spark):
    rng = np.random.default_rng(4)
    items = _items(spark, rng.normal(size=(90, 3)))
    one = successive.successive_sampling(items, 5, seed=3, final=5)
    assert one.compressed and one.assigned.count() == one.candidates.count() == 90
    assert one.assigned.select("center_id").distinct().count() == 5
    again = successive.successive_sampling(items.repartition(5), 5, seed=3, final=5)
    assert {tuple(r) for r in again.assigned.collect()} == {tuple(r) for r in one.assigned.collect()}
    for bad in ({"cover": 1.0}, {"multiplier": 0}, {"final": 0}):
        with pytest.raises(ValueError):
            successive.successive_sampling(items, 5, **bad)


def test_coreset_leaves_small_tables_alone(spark):
    items = _items(spark, np.arange(40)[:, None])
    out = coreset.coreset_cluster(items, 3)
    assert not out.rounds and not out.compressed and out.assigned.where("id = center_id").count() == 40
    for bad in ({"sample_fraction_cap": 0.5}, {"window_size": 3}, {"max_rounds": 0}, {"correctness": 1.1}):
        with pytest.raises(ValueError):
            coreset.coreset_cluster(items, 3, **bad)


def test_kmeans(spark):
    rng = np.random.default_rng(8)
    items = _items(spark, np.concatenate([rng.normal(size=(30, 2)) * 0.1 + c for c in ([0, 0], [5, 5], [0, 9])]), ["abc"[i // 30] for i in range(90)])
    out = kmeans.kmeans_cluster(items, 3, n_init=3, max_iter=20)
    assert metrics.evaluate(out.assigned).first().adjusted_rand_index == 1
    assert kmeans.kmeans_cluster(items, 1).assigned.select("center_id").distinct().count() == 1
    with pytest.raises(ValueError):
        kmeans.kmeans_cluster(items, 91)


def test_half_precision(spark):
    x = np.concatenate([np.random.default_rng(9).normal(size=2000) * 10.0 ** np.random.default_rng(1).integers(-8, 4, 2000), [0, 2**-24, 2**-25, 1 + 2**-11, 65504]])
    got = [r.h for r in spark.createDataFrame([(float(v),) for v in x], "v double").select(E.half(F.col("v")).alias("h")).collect()]
    assert got == x.astype(np.float16).astype(float).tolist()


def test_text_fields(spark):
    df = spark.createDataFrame([(" a ", None, " b\n"), (None, " ", None)], "x string, y string, z string")
    assert [r.t for r in df.select(X.join_fields(F.col("x"), F.col("y"), F.col("z")).alias("t")).collect()] == ["a\n\nb", ""]


def test_text_rows(spark, tmp_path):
    raw = spark.createDataFrame([("hi", "Out-Of-Scope ", 1), ("yo", "greet", 2), ("bye", None, 3)], "query string, intent string, other int")
    raw.coalesce(1).write.json(str(tmp_path / "rows.json"))
    rows = text_rows.load_dataset(spark, "CLINC-150", [str(tmp_path / "none.parquet"), str(tmp_path / "rows.json")]).orderBy("pos").collect()
    assert [(r.text, r.label_name, r.metadata) for r in rows] == [("yo", "greet", {"other": "2"}), ("bye", None, {"other": "3"})]
    assert rows[0].id == str(rows[0].pos) != "0"
    with pytest.raises(ValueError):
        text_rows.load_dataset(spark, "other", [])
    with pytest.raises(ValueError):
        text_rows.text_rows(raw, text_fields=("gone",))
    with pytest.raises(RuntimeError):
        text_rows.read_first(spark, [str(tmp_path / "nothing")])


def test_missing_vector_is_an_error(spark):
    items = _items(spark, [[0], [1]])
    with pytest.raises(FAILS, match="no vector for: 9"):
        text_rows.with_vectors(spark.createDataFrame([("9",)], "id string"), items, "id").collect()


def test_vectors_that_cannot_be_compared_are_left_out(spark, tmp_path):
    rows = [(0, [1.0, 2.0], 1), (1, None, 1), (2, [float("nan"), 0.0], 1), (3, [None, 0.0], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "v"))
    assert [r.id for r in text_rows.vectors(spark, str(tmp_path / "v")).collect()] == ["0"]


def test_responses(spark):
    said = ['text {"reasoning":"x","is_ab_less_than_cd":true} tail', '{"reasoning":"x","is_ab_less_than_cd":"true"}', '{"reasoning":1,"is_ab_less_than_cd":true}', "no", None, "[1]"]
    got = spark.createDataFrame([(s,) for s in said], "s string").select(X.parse_response(F.col("s")).alias("p")).collect()
    assert [(r.p.ok, r.p.answer) for r in got] == [(True, True)] + [(False, None)] * 5


def test_cache_key_is_json(spark):
    row = ('q"\\', "é\n/", "b", "a")
    got = spark.createDataFrame([row], "a string, b string, c string, d string").select(X.cache_key(*map(F.col, "abcd")).alias("k")).first().k
    assert got == json.dumps({"a": min(row[:2]), "b": max(row[:2]), "c": "a", "d": "b", "version": 1}, ensure_ascii=False)


def test_kmeans_query_uses_the_operators_defaults(spark, monkeypatch):
    fit, said = kmeans.kmeans_cluster, {}
    monkeypatch.setattr(kmeans, "kmeans_cluster", lambda rows, k, **more: said.update(more) or fit(rows, k, n_init=1, max_iter=1))
    catalog.QUERIES["kmeans_cluster"](spark, SF)
    assert said.keys() == {"seed"}


def test_judge_and_cache(spark, tmp_path):
    quads = spark.createDataFrame([("a", "bb", "c", "ddd"), ("bb", "a", "ddd", "c"), ("aaaa", "b", "c", "d")], "a string, b string, c string, d string")
    found, new = judge.cached_compare(quads, judge.OfflineModel)
    assert new.count() == 2 and sorted(r.answer for r in found.collect()) == [False, True, True]
    path = str(tmp_path / "cache")
    judge.append_to_cache(path, new)
    judge.append_to_cache(path, new.withColumn("reasoning", F.lit("later")))
    cache = spark.read.parquet(path)
    assert cache.count() == 2 and cache.where("reasoning = 'later'").count() == 0
    assert judge.pending(judge.with_key(quads), cache).count() == 0


def test_judge_reads_whole_texts(spark):
    """Every document as it is, against three others by place: long texts, line breaks and one beginning for many."""
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    texts += ["one beginning of many\n" + x for x in ("", "\n", "two\r\nlines", "Text: x\n\nIs the distance")]
    n = len(texts)
    asked = [(texts[i], texts[(i + 1) % n], texts[(i + 7) % n], texts[(i + 31) % n]) for i in range(n)]
    found, _ = judge.cached_compare(spark.createDataFrame([*asked, *asked[:9]], "a string, b string, c string, d string"), judge.OfflineModel)
    got = [(r.a, r.b, r.c, r.d, r.answer) for r in found.collect()]
    assert any("\n" in x for x in texts[:-4]) and len(got) == n + 9
    assert all(answer == (abs(len(a) - len(b)) < abs(len(c) - len(d))) for a, b, c, d, answer in got)


class Broken:
    def generate(self, messages):
        return ["{}"] * (len(messages) + 1)


def test_judge_gives_up(spark):
    quads = spark.createDataFrame([("a", "b", "c", "d")], "a string, b string, c string, d string")
    with pytest.raises(FAILS, match="no usable answers"):
        judge.cached_compare(quads, Broken)[0].collect()


def test_keys(tmp_path, monkeypatch):
    monkeypatch.setenv("API_KEYS_FILE", str(tmp_path / "k.json"))
    assert keys.load_keys() == {}
    (tmp_path / "k.json").write_text('{"one": "1"}')
    assert keys.get_key("one") == "1" and keys.get_key("two") is None
    for bad in ("{", "[1]"):
        (tmp_path / "k.json").write_text(bad)
        with pytest.raises(ValueError):
            keys.load_keys()


def test_stream_assigns_new_rows(spark, tmp_path):
    items = _items(spark, [[0], [10], [1], [9]])
    items.write.parquet(str(tmp_path / "in"))
    centers = items.where("pos < 2").withColumn("p", F.col("pos"))
    stream = spark.readStream.schema(items.schema).parquet(str(tmp_path / "in"))
    assign_stream(stream, centers, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {(r.id, r.center_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("0", "0"), ("1", "1"), ("2", "0"), ("3", "1")}


def test_documents(spark, capsys):
    path = f"{SF}/embeddings.parquet"
    assert cli.main(["--task", "rank", path]) == 0
    said = json.loads(capsys.readouterr().out)
    assert said["metrics"]["n_items"] == 20 and [r["rank"] for r in said["ranked_rows"]] == list(range(1, 21))
    assert cli.main(["--task", "cluster", "--cluster-count", "4", "--candidate-limit", "60", path]) == 0
    said = json.loads(capsys.readouterr().out)
    assert said["metrics"]["n_clusters"] == 4 and said["clustering"]["algorithm"] == report.ALGORITHMS["cluster"] and "candidate_metrics" in said
    with pytest.raises(SystemExit):
        cli.main(["--task", "cluster", path])


def test_documents_are_whole(spark, capsys, tmp_path):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    large = str(tmp_path / "large")
    vectors.unionByName(vectors.withColumn("vec_id", F.col("vec_id") + 10_000)).unionByName(vectors.withColumn("vec_id", F.col("vec_id") + 20_000)).write.parquet(large)
    rank = ["--task", "rank", "--candidate-limit", "0"]
    with pytest.raises(SystemExit):
        cli.main([*rank, large])
    assert cli.main([*rank, "--output", str(tmp_path / "rank"), large]) == 0
    rows = spark.read.json(json.loads(capsys.readouterr().out)["ranked_rows"]).collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, 3 * vectors.count()))
    for task, other in (("cluster", "candidate_clusters"), ("embedding-cluster", None)):
        args = ["--task", task, "--cluster-count", "4", "--candidate-limit", "60", "--embedding-kmeans-n-init", "1"]
        assert cli.main([*args, large]) == 0
        said = json.loads(capsys.readouterr().out)
        assert cli.main([*args, "--output", str(tmp_path / task), large]) == 0
        named = json.loads(capsys.readouterr().out)
        for name in filter(None, ("clusters", other)):
            lines = [json.loads(r.value) for r in spark.read.text(named[name]).collect()]
            assert len({x for c in said[name] for x in c["rows"]}) == sum(c["size"] for c in said[name]) == 60
            assert {(c["center"], *c["rows"]) for c in lines} == {(c["center"], *c["rows"]) for c in said[name]}
        assert len(said["clusters"]) == 4 and (other or "candidate_clusters" not in said)


def test_documents_of_texts(spark, capsys, tmp_path):
    words = ["oos" if i == 7 else f"intent_{i % 3}" for i in range(12)]
    (tmp_path / "test.jsonl").write_text("".join(json.dumps({"key": 100 + i, "text": f"text {i}", "intent": w}) + "\n" for i, w in enumerate(words)))
    spark.createDataFrame([(100 + i, [float(i % 3), float(i)], 0) for i in range(12)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "v"))
    args = ["--dataset", "clinc", "--dataset-id", str(tmp_path / "{split}.jsonl"), "--id-field", "key", "--candidate-limit", "0", str(tmp_path / "v")]
    for more, n in (([], 10), (["--include-oos"], 11)):
        assert cli.main([*args, *more]) == 0
        said = json.loads(capsys.readouterr().out)
        ranked = said["ranked_rows"]
        assert said["dataset"]["split"] == "test" and len(ranked) == n
        assert {(r["id"], r["text"], r["label"], r["label_name"]) for r in ranked} == {(str(100 + i), f"text {i}", w, w) for i, w in enumerate(words) if i and (more or w != "oos")}
        assert [r["d"] for r in ranked] == sorted(r["d"] for r in ranked)
    assert cli.main(["--task", "embedding-cluster", "--cluster-count", "3", "--embedding-kmeans-n-init", "1", *args]) == 0
    said = json.loads(capsys.readouterr().out)
    assert {(r["id"], r["text"], r["label"]) for c in said["clusters"] for r in c["rows"]} == {(str(100 + i), f"text {i}", w) for i, w in enumerate(words) if w != "oos"}
    assert cli.main(["--task", "cluster", "--cluster-count", "3", "--output", str(tmp_path / "out"), *args]) == 0
    named = json.loads(capsys.readouterr().out)
    for name in ("clusters", "candidate_clusters"):
        assert sorted(x["text"] for r in spark.read.text(named[name]).collect() for x in json.loads(r.value)["rows"]) == sorted(f"text {i}" for i in range(12) if i != 7)
    with pytest.raises(SystemExit):
        cli.main(["--dataset", "clinc", str(tmp_path / "v")])
    spark.createDataFrame([(100, [0.0, 0.0], 0)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "few"))
    with pytest.raises(FAILS, match="no vector for"):
        cli.main([*args[:-1], str(tmp_path / "few")])


def test_the_library_stands_without_the_llm_folders():
    import subprocess
    import sys

    code = "import sys; sys.modules['quadrille.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.queries() and not [q for q in e.queries() if q.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], check=True)


# --- Sampling, vectors that can't be compared, judgements ------------------------------------------------------


def test_seeds_give_unrelated_samples(spark):
    rows = spark.range(2000).select(F.col("id").cast("string").alias("id"), F.col("id").alias("pos"))
    drawn = [{r.id for r in ranking.sample(rows, 200, s).collect()} for s in (0, 1, 2, 5, 50)]
    shared = [len(a & b) for i, a in enumerate(drawn) for b in drawn[:i]]
    assert all(len(x) == 200 for x in drawn) and max(shared) < 45 and 12 < sum(shared) / len(shared) < 28
    assert drawn[0] == {r.id for r in ranking.sample(rows.repartition(7), 200, 0).collect()}


@pytest.mark.parametrize("other", [None, [1.0, 2.0], [1.0, None, 3.0]])
def test_vectors_that_cannot_be_compared_are_errors(spark, other):
    rows = spark.createDataFrame([("0", 0, "x", [1.0, 2.0, 3.0]), ("1", 1, "y", other)], "id string, pos long, label_name string, embedding array<float>")
    for profile in ("f64", "f16"):
        with pytest.raises(Exception, match="unequal in length"):
            ranking.rank_by_anchor(rows, "0", profile).collect()


def test_unknown_ids_are_errors(spark):
    items = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "id string, embedding array<float>")
    comparator = comparisons.VectorComparator(items)
    assert comparisons.closer(comparator, spark, "a", "a", "a", "b") and not comparisons.closer(comparator, spark, "a", "b", "a", "b")
    with pytest.raises(Exception, match="missing"):
        comparisons.closer(comparator, spark, "a", "b", "a", "z")
    with pytest.raises(Exception, match="missing"):
        comparisons.pair_distances(spark.createDataFrame([("a", "z")], "left_id string, right_id string"), items).collect()
    said = comparator.compare(spark.createDataFrame([("a", "b", "a", "a")], "a string, b string, c string, d string")).first()
    assert said.reasoning == "embedding_sq_l2_ab=1; embedding_sq_l2_cd=0"


def test_half_precision_overflows(spark):
    got = [r[0] for r in spark.createDataFrame([(65504.0,), (65519.0,), (65520.0,), (-1e9,)], "x double").select(E.half(F.col("x"))).collect()]
    assert got == [65504.0, 65504.0, float("inf"), float("-inf")]


def test_labels_lose_white_space_of_all_kinds(spark):
    assert spark.createDataFrame([("\tOut-Of Scope\n",)], "x string").select(X.normalize_label(F.col("x"))).first()[0] == "out_of_scope"


def test_judgements_have_their_own_types(spark):
    """Nested objects and text behind the object don't lend their types."""
    cases = {
        'x {"reasoning": "a", "is_ab_less_than_cd": true} tail': True,
        '{"o": {"is_ab_less_than_cd": true}, "reasoning": "r", "is_ab_less_than_cd": "true"}': False,
        '{"reasoning": "r", "is_ab_less_than_cd": "true"} "is_ab_less_than_cd": true}': False,
        '{"reasoning": 5, "is_ab_less_than_cd": false}': False,
        '{"reasoning": "a", "is_ab_less_than_cd": true': False,
        "none": False,
    }
    rows = spark.createDataFrame([(c,) for c in cases], "s string").select("s", X.parse_response(F.col("s")).alias("p")).collect()
    assert {r.s: r.p.ok for r in rows} == cases and all((judge.judgement(c) is not None) == ok for c, ok in cases.items())


def test_malformed_judgements_are_asked_again(spark, tmp_path):
    class Flaky:
        def __init__(self):
            self.turn = 0

        def generate(self, messages):
            self.turn += 1
            return ['{"reasoning": "r", "is_ab_less_than_cd": "tr' if self.turn == 1 else '{"reasoning": "r", "is_ab_less_than_cd": true}'] * len(messages)

    quads = spark.createDataFrame([("a", "b", "c", "d")] * 3, "a string, b string, c string, d string")
    found, new = judge.cached_compare(quads, Flaky)
    assert [r.answer for r in found.collect()] == [True] * 3 and new.count() == 1
    counts = judge.cache_counts(judge.with_key(quads.unionByName(quads.withColumn("a", F.lit("z")))), new).first()
    assert (counts.hits, counts.misses, counts.asked) == (3, 3, 1)


def test_names_are_found_at_the_package():
    import quadrille

    assert all(callable(getattr(quadrille, n)) or n.isupper() for n in quadrille.__all__) and "rank_by_anchor" in dir(quadrille)
