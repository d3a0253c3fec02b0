"""python -m quadrille.cli --task TASK PATH: one task over a table of vectors, or over a dataset of texts and the vectors of its
rows; its document on stdout."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.vectors import normalize
from .operators.coreset import coreset_cluster
from .operators.kmeans import kmeans_cluster
from .operators.ranking import rank_by_anchor, rank_metrics, sample
from .operators.report import INLINE, clustering_document, dumps, rank_document, with_clusters
from .operators.successive import successive_sampling
from .sources.text_rows import at_index, is_ontology, load_dataset, shared_vectors, vectors, with_vectors

#: Names of tasks, and below names, defaults and choices of options.
TASKS = ("rank", "cluster", "weak-comparison-cluster", "embedding-cluster")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--task", choices=TASKS, default="rank")
    p.add_argument("path", help="Parquet with vec_id, embedding, label; with a dataset vec_id is the id of a text row")
    p.add_argument("--dataset", help="name of the dataset that --dataset-id holds")
    p.add_argument("--dataset-id", action="append", help="file of text rows, {split} and {config} in it stand for the split and the configuration; if repeated, the first that can be read")
    p.add_argument("--config", help="configuration of the dataset")
    p.add_argument("--split", help="test for intents and train for the ontology if unset")
    p.add_argument("--include-oos", action="store_true", help="keep out-of-scope intents; an error for other datasets")
    p.add_argument("--label-names", help="names of numbered labels from 0 on, comma-separated, or @ and a file with one name a line")
    p.add_argument("--id-field", help="column of the text rows that holds their ids; if unset the column id, or their places")
    p.add_argument("--output", help=f"new folder for all ranked rows or clusters, as JSON lines; needed beyond {INLINE} rows")
    p.add_argument("--anchor-index", type=int, default=0, help="place of the anchor among the rows that are loaded")
    p.add_argument("--candidate-limit", type=int, default=20, help="0: all")
    p.add_argument("--candidate-seed", type=int, default=0)
    p.add_argument("--sort-seed", type=int, help="recorded only: the order of a ranking doesn't depend on it")
    p.add_argument("--cluster-count", type=int)
    p.add_argument("--cluster-sample-multiplier", type=float, default=1.0)
    p.add_argument("--cluster-cover-fraction", type=float, default=0.5)
    p.add_argument("--cluster-seed", type=int, default=0)
    p.add_argument("--weak-comparison-correctness-probability", type=float, default=0.85)
    p.add_argument("--weak-comparison-sample1-multiplier", type=float, default=1.0)
    p.add_argument("--weak-comparison-sample2-multiplier", type=float, default=1.0)
    p.add_argument("--weak-comparison-max-rounds", type=int)
    p.add_argument("--no-cluster-exact-k", action="store_true")
    p.add_argument("--embedding-model-name", help="what made the vectors, for the document")
    p.add_argument("--embedding-prompt", help="the instruction that they were made with, for the document")
    p.add_argument("--no-embedding-normalize", action="store_true", help="take vectors as they are; else they get unit length")
    p.add_argument("--embedding-kmeans-n-init", type=int, default=10)
    p.add_argument("--embedding-kmeans-max-iter", type=int, default=300)
    p.add_argument("--progress", action="store_true", help="a line on stderr for each round or step")
    p.add_argument("--profile", choices=("f64", "f16"), default="f64")
    return p


def split_of(a: argparse.Namespace) -> str:
    return a.split or ("train" if is_ontology(a.dataset) else "test")


def names_of(a: argparse.Namespace, spark: SparkSession) -> list[str]:
    """Names of numbered labels; a file is read as Spark reads text, in the order of its lines."""
    if not a.label_names:
        return []
    if a.label_names.startswith("@"):
        return [r.value for r in spark.read.text(a.label_names[1:]).collect()]
    return a.label_names.split(",")


def text_rows_of(spark: SparkSession, a: argparse.Namespace) -> DataFrame | None:
    """The dataset that the options name."""
    if a.dataset is None:
        return None
    if is_ontology(a.dataset) and a.include_oos:
        raise ValueError("--include-oos is for intents only")
    said = {"dataset_id": a.dataset_id[0], "split": split_of(a), "config": a.config}
    options = {"id_field": a.id_field, "label_names": names_of(a, spark), "provenance": said} | ({} if is_ontology(a.dataset) else {"remove_oos": not a.include_oos})
    return load_dataset(spark, a.dataset, [x.replace("{split}", split_of(a)).replace("{config}", a.config or "") for x in a.dataset_id], **options)


def progress_of(a: argparse.Namespace):
    """What rounds are told to: one line each, of their numbers."""
    if not a.progress:
        return None
    return lambda log: print(f"{a.task}: " + " ".join(f"{k}={v}" for k, v in log.items() if not isinstance(v, list)), file=sys.stderr, flush=True)


def main(argv: list[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    if (a.dataset is None) != (a.dataset_id is None):
        p.error("--dataset and --dataset-id go together")
    if a.task != "rank" and (a.cluster_count is None or a.cluster_count < 1):
        p.error("--cluster-count is required and at least 1")
    spark = SparkSession.builder.getOrCreate()
    rows, texts = vectors(spark, a.path), text_rows_of(spark, a)
    source: dict = {"path": a.path}
    if texts is not None:
        rows, source = with_vectors(texts, rows, "id"), {"path": a.path, "name": a.dataset, "dataset_id": a.dataset_id[0], "split": split_of(a), "config": a.config, "include_oos": a.include_oos}
        if a.task != "embedding-cluster":
            rows = shared_vectors(rows)
    if not a.no_embedding_normalize:
        rows = rows.withColumn("embedding", normalize(F.col("embedding")))
    n_loaded, width = rows.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not n_loaded:
        raise RuntimeError("no rows are loaded")
    source |= {"n_loaded_rows": n_loaded, "candidate_seed": a.candidate_seed}
    parts = {"model": {"provider": "table", "model_name": a.embedding_model_name, "prompt": a.embedding_prompt}}
    compared = {"backend": "vectors", "distance": "squared_l2", "profile": a.profile, "normalize_embeddings": not a.no_embedding_normalize}
    unique = F.count_distinct("text") if "text" in rows.columns else F.count_distinct("id")
    if a.task == "rank":
        found = at_index(rows, a.anchor_index).first() if 0 <= a.anchor_index < n_loaded else None
        if found is None:
            raise IndexError(f"the anchor's index lies between 0 and {n_loaded - 1}")
        rest = rows.where(F.col("id") != found.id)
        chosen = sample(rest, a.candidate_limit, a.candidate_seed).drop("p") if a.candidate_limit > 0 else rest
        n = chosen.count()
        if not a.output and n > INLINE:
            p.error(f"--output is needed for more than {INLINE} rows")
        both = chosen.unionByName(rows.where((F.col("id") == found.id) & (F.col("pos") == found.pos)))
        source |= {"n_ranked_candidates": n, "sort_seed": a.sort_seed, "n_embedding_source_rows": n + 1, "n_unique_embedding_texts": both.agg(unique).first()[0]}
        parts["comparison"] = compared | {"embedding_shape": [source["n_unique_embedding_texts"], width]}
        print(dumps(rank_document(rank_by_anchor(both, found.id, a.profile), rank_metrics(both, found.id, a.profile), found, source, output=a.output, **parts)))
        return 0
    if a.candidate_limit > 0:
        rows = sample(rows, a.candidate_limit, a.candidate_seed).drop("p")
    k, final = a.cluster_count, None if a.no_cluster_exact_k else a.cluster_count
    n = rows.count()
    if n < k:
        raise ValueError("there are fewer rows than clusters")
    if not a.output and n > INLINE:
        p.error(f"--output is needed for more than {INLINE} rows")
    source["n_clustered_rows"] = n
    told = progress_of(a)
    if a.task != "embedding-cluster":
        source |= {"n_embedding_source_rows": n, "n_unique_embedding_texts": rows.agg(unique).first()[0]}
        parts["comparison"] = compared | {"embedding_shape": [source["n_unique_embedding_texts"], width]}
    if a.task == "cluster":
        result = successive_sampling(rows, k, multiplier=a.cluster_sample_multiplier, cover=a.cluster_cover_fraction, seed=a.cluster_seed, final=final, profile=a.profile, on_round=told)
    elif a.task == "weak-comparison-cluster":
        result = coreset_cluster(rows, k, correctness=a.weak_comparison_correctness_probability, first=a.weak_comparison_sample1_multiplier, second=a.weak_comparison_sample2_multiplier, max_rounds=a.weak_comparison_max_rounds, seed=a.cluster_seed, final=final, on_round=told)
    else:
        result = kmeans_cluster(rows, k, seed=a.cluster_seed, n_init=a.embedding_kmeans_n_init, max_iter=a.embedding_kmeans_max_iter, on_step=told)
        result.parameters["normalize_embeddings"] = not a.no_embedding_normalize
    print(dumps(with_clusters(a.task, clustering_document(a.task, result, source, **parts), result, a.output, texts)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
