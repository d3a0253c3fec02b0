"""Result documents of the four tasks, as DataFrames of one JSON text or of JSON lines."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .assign import nested_clusters
from .metrics import evaluate
from .successive import Clustering

#: The algorithms' names in documents.
ALGORITHMS = {"cluster": "mettu_plaxton_successive_sampling", "weak-comparison-cluster": "weak_comparison_alg_g_coreset_plus", "embedding-cluster": "instructor_kmeans"}


#: Rows up to which a document holds rankings and clusters itself; beyond it they are written to a folder.
INLINE = 1000


#: What a document says of a row beside its id and the name of its label.
FIELDS = ("text", "label")


def fields_of(rows: DataFrame) -> list[str]:
    return [c for c in FIELDS if c in rows.columns]


def clusters_json(assigned: DataFrame) -> DataFrame:
    """One JSON line per page of a cluster: center, size, page, rows (ids, or objects where there are texts)."""
    return nested_clusters(assigned, fields=_shown(assigned)).select(F.to_json(F.struct(F.col("center_id").alias("center"), "size", "page", F.col("members").alias("rows"))).alias("json"))


def _shown(assigned: DataFrame) -> list[str]:
    return [*fields_of(assigned), "label_name"] if "text" in assigned.columns else []


def listed_clusters(assigned: DataFrame) -> list[dict]:
    """All clusters of a table of up to INLINE rows, the largest first; more rows are an error."""
    if assigned.limit(INLINE + 1).count() > INLINE:
        raise ValueError(f"clusters of more than {INLINE} rows need an output folder")
    pages: dict = {}
    for r in sorted(nested_clusters(assigned, fields=_shown(assigned)).collect(), key=lambda r: r.page):
        pages.setdefault((-r["size"], r.center_id), []).extend(m.asDict() if isinstance(m, Row) else m for m in r.members)
    return [{"center": c, "size": -n, "rows": rows} for (n, c), rows in sorted(pages.items())]


def with_clusters(task: str, body: dict, result: Clustering, output: str | None, texts: DataFrame | None = None) -> dict:
    """The document with all final and candidate clusters, or with the names of the folders that they are written to. texts
    (id, text, label) are said of the rows."""
    parts = {"clusters": result.assigned}
    if task != "embedding-cluster":
        parts["candidate_clusters" if task == "cluster" else "coreset_clusters"] = result.candidates
    for name, assigned in parts.items():
        assigned = assigned if texts is None else assigned.join(texts.select("id", *fields_of(texts)), "id")
        if output:
            body[name] = f"{output}/{name}"
            clusters_json(assigned).write.text(body[name])
        else:
            body[name] = listed_clusters(assigned)
    return body


def metrics_of(assigned: DataFrame) -> dict:
    return evaluate(assigned).first().asDict()


def clustering_document(task: str, result: Clustering, dataset: dict, **parts: dict) -> dict:
    """What a run says of itself, with parts (model, comparison) as given; with_clusters() adds the clusters themselves."""
    centers = lambda x: x.select("center_id").distinct().count()
    said = {"algorithm": ALGORITHMS[task], **result.parameters, "rounds": result.rounds}
    said["n_final_centers"] = centers(result.assigned)
    if task != "embedding-cluster":
        said["exact_k_compression"] = result.compressed
        said["n_candidate_centers" if task == "cluster" else "n_coreset_centers"] = centers(result.candidates)
    body = {"dataset": dataset, **parts, "clustering": said, "metrics": metrics_of(result.assigned)}
    if task != "embedding-cluster":
        body["candidate_metrics" if task == "cluster" else "coreset_metrics"] = metrics_of(result.candidates)
    return body


def row_of(row: Row) -> dict:
    """What a document says of one row."""
    return {c: row[c] for c in ("id", *FIELDS, "label_name") if c in row}


def rank_document(ranked: DataFrame, metrics: DataFrame, anchor: str | Row, dataset: dict, rows: int = INLINE, output: str | None = None, **parts: dict) -> dict:
    """A ranking with its metrics, all its rows in the document or, as JSON lines, in a folder in output. More than `rows` rows without
    output are an error. anchor: an id, or the row itself; parts (model, comparison) as given."""
    shown = ["id", *fields_of(ranked), "label_name", "rank", "d"] if "text" in ranked.columns else ["id", "label_name", "rank", "d"]
    body = {"dataset": dataset, **parts, "anchor": anchor if isinstance(anchor, str) else row_of(anchor), "metrics": metrics.first().asDict()}
    if output:
        path = f"{output}/ranked_rows"
        ranked.select(*shown).write.json(path)
        return {**body, "ranked_rows": path}
    first = ranked.orderBy("rank").limit(rows + 1).select(*shown).collect()
    if len(first) > rows:
        raise ValueError(f"a ranking of more than {rows} rows needs an output folder")
    return {**body, "ranked_rows": [r.asDict() for r in first]}


def dumps(document: dict) -> str:
    return json.dumps(document, indent=2, ensure_ascii=False)
