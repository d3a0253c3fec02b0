"""Each key of the tasks' documents, and options that change which rows take part."""

import json

import numpy as np
import pytest

from quadrille import cli
from quadrille.operators import report, successive

ROUND = {"index", "n_remaining_before", "sample_size", "sample_center_ids", "covered_count", "n_remaining_after"}
CORESET_ROUND = {"index", "n_active_before", "sample1_size", "sample2_size", "edge_sample_count", "window_size", "dislocation_bound", "filtered_count", "safe_count", "removed_count", "n_active_after", "sample1_center_ids", "sample2_center_ids"}
DATASET = {"name", "dataset_id", "split", "config", "n_loaded_rows", "candidate_seed"}
MODEL = {"provider", "model_name", "prompt"}
COMPARISON = {"backend", "distance", "normalize_embeddings", "embedding_shape"}


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """130 rows in three files, of four numbered labels, the last of which is out of scope; one text is there twice."""
    folder = tmp_path_factory.mktemp("cli")
    rng = np.random.default_rng(2)
    (folder / "test.json").mkdir()
    for part, (a, b) in enumerate(((0, 50), (50, 60), (60, 130))):
        lines = [json.dumps({"text": f"text {i if i != 9 else 5}", "intent": i % 4}) for i in range(a, b)]
        (folder / "test.json" / f"{part}.json").write_text("\n".join(lines))
    vectors = [(i, (rng.normal(size=3) * (1 + i)).tolist(), 0) for i in range(130)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").write.parquet(str(folder / "v"))
    args = ["--dataset", "clinc", "--dataset-id", str(folder / "{split}.json"), "--label-names", "a,b,c,oos", "--embedding-model-name", "m", str(folder / "v")]
    return args, np.array([v for _, v, _ in vectors])


def _said(capsys, args):
    assert cli.main(args) == 0
    return json.loads(capsys.readouterr().out)


def test_rank(files, capsys):
    args, x = files
    said = _said(capsys, ["--candidate-limit", "0", "--anchor-index", "3", *args])
    assert said.keys() == {"dataset", "model", "comparison", "anchor", "metrics", "ranked_rows"}
    assert DATASET | {"n_ranked_candidates", "sort_seed", "n_embedding_source_rows", "n_unique_embedding_texts"} <= said["dataset"].keys()
    assert said["model"].keys() == MODEL and COMPARISON <= said["comparison"].keys()
    # Rows 3, 7, ... are out of scope, so the fourth row that is left is row 4.
    assert said["anchor"] == {"id": "4", "text": "text 4", "label": "0", "label_name": "a"}
    kept = [i for i in range(130) if i % 4 != 3]
    assert said["dataset"]["n_loaded_rows"] == len(kept) and said["dataset"]["n_ranked_candidates"] == len(kept) - 1
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    unit[9] = unit[5]
    order = sorted((i for i in kept if i != 4), key=lambda i: (((unit[i] - unit[4]) ** 2).sum(), str(i)))
    assert [r["id"] for r in said["ranked_rows"]] == [str(i) for i in order]
    raw = _said(capsys, ["--candidate-limit", "0", "--anchor-index", "3", "--no-embedding-normalize", *args])
    assert [r["id"] for r in raw["ranked_rows"]] != [r["id"] for r in said["ranked_rows"]] and raw["comparison"]["normalize_embeddings"] is False
    whole = _said(capsys, ["--candidate-limit", "0", "--anchor-index", "3", "--include-oos", *args])
    assert whole["anchor"]["id"] == "3" and whole["anchor"]["label_name"] == "oos"
    for bad in ("-1", str(len(kept))):
        with pytest.raises(IndexError):
            cli.main(["--anchor-index", bad, *args])


def test_cluster(files, capsys):
    said = _said(capsys, ["--task", "cluster", "--cluster-count", "4", "--candidate-limit", "0", "--progress", *files[0]])
    assert said.keys() == {"dataset", "model", "comparison", "clustering", "metrics", "candidate_metrics", "candidate_clusters", "clusters"}
    own = said["clustering"]
    assert {"algorithm", "target_clusters", "sample_size", "sample_multiplier", "cover_fraction", "seed", "exact_k_compression", "final_center_count", "n_candidate_centers", "n_final_centers", "rounds"} <= own.keys()
    assert own["rounds"] and all(r.keys() == ROUND for r in own["rounds"]) and own["n_final_centers"] == 4 == len(said["clusters"])
    assert own["n_candidate_centers"] == len(said["candidate_clusters"])


def test_coreset(files, capsys):
    said = _said(capsys, ["--task", "weak-comparison-cluster", "--cluster-count", "3", "--candidate-limit", "0", "--include-oos", *files[0]])
    assert said.keys() == {"dataset", "model", "comparison", "clustering", "metrics", "coreset_metrics", "coreset_clusters", "clusters"}
    own = said["clustering"]
    assert {"algorithm", "target_clusters", "oracle_correctness_probability", "sample1_multiplier", "sample2_multiplier", "window_multiplier", "terminal_multiplier", "sample_fraction_cap", "nearest_edge_strategy", "seed", "exact_k_compression", "final_center_count", "n_coreset_centers", "n_final_centers", "rounds"} <= own.keys()
    assert own["rounds"] and all(r.keys() == CORESET_ROUND for r in own["rounds"])
    for r in own["rounds"]:
        assert r["n_active_before"] - r["removed_count"] == r["n_active_after"] and r["removed_count"] == r["safe_count"] + r["sample1_size"] == r["safe_count"] + len(r["sample1_center_ids"])


def test_kmeans(files, capsys):
    said = _said(capsys, ["--task", "embedding-cluster", "--cluster-count", "1", "--candidate-limit", "0", "--embedding-kmeans-n-init", "2", *files[0]])
    assert said.keys() == {"dataset", "model", "clustering", "metrics", "clusters"}
    own = said["clustering"]
    assert {"algorithm", "target_clusters", "seed", "normalize_embeddings", "kmeans_init", "kmeans_n_init", "kmeans_max_iter", "embedding_shape", "inertia", "n_final_centers"} <= own.keys()
    assert own["inertia"] > 0 and own["n_final_centers"] == 1 and own["embedding_shape"] == [98, 3]


def test_ontology_has_no_out_of_scope(files):
    with pytest.raises(ValueError, match="intents only"):
        cli.main(["--include-oos", "--dataset", "dbpedia", *files[0][2:]])


def test_nothing_is_cut_in_silence(spark):
    rows = spark.range(report.INLINE + 1).selectExpr("cast(id AS string) AS id", "id AS pos", "'x' AS label_name", "'0' AS center_id", "id + 1 AS rank", "0.0 AS d")
    with pytest.raises(ValueError, match="output folder"):
        report.listed_clusters(rows)
    with pytest.raises(ValueError, match="output folder"):
        report.rank_document(rows, rows.limit(1), "0", {})
    result = successive.Clustering(rows.limit(3), rows.limit(3))
    assert report.clustering_document("cluster", result, {})["clustering"]["n_candidate_centers"] == 1
