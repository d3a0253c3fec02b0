"""Comparison-based ranking, clustering and evaluation of labelled items on Spark."""

from .functions.text import cache_key, join_fields, label_name, normalize_label, parse_response, prompt
from .functions.vectors import normalize, squared_distance, squared_norm
from .operators.assign import nearest_center
from .operators.comparisons import Comparator, VectorComparator, closer, distance_matrix, grouped_majority, pair_distances
from .operators.coreset import coreset_cluster
from .operators.judge import ChatModel, append_to_cache, ask, cache_counts, cached_compare, upsert
from .operators.kmeans import kmeans_cluster
from .operators.metrics import contingency, evaluate
from .operators.ranking import inversions, rank_by_anchor, rank_metrics, sample
from .operators.successive import Clustering, successive_sampling
from .sources.text_rows import load_dataset, load_intents, load_ontology, text_rows, vectors, with_vectors

__all__ = [
    "ChatModel", "Clustering", "Comparator", "VectorComparator", "append_to_cache", "ask", "cache_counts", "cache_key", "cached_compare", "closer",
    "contingency", "coreset_cluster", "distance_matrix", "evaluate", "grouped_majority", "inversions", "join_fields", "kmeans_cluster", "label_name",
    "load_dataset", "load_intents", "load_ontology", "nearest_center", "normalize", "normalize_label", "pair_distances", "parse_response", "prompt",
    "rank_by_anchor", "rank_metrics", "sample", "squared_distance", "squared_norm", "successive_sampling", "text_rows", "upsert", "vectors", "with_vectors",
]
