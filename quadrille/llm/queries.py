"""The queries of the subpackage, one per operator, and SQL for those that it can express."""

from __future__ import annotations

from .align import op13_cross_tokenizer
from .langid import op11_kneser_ney_language
from .media import op4_media_columns
from .merkle import MERKLE_SQL, op12_merkle_manifest
from .mixing import op8_entropy_mixing
from .packing import op1_packing
from .pii import op6_pii_spans
from .quality import op3_quality_classifier
from .rindex import op10_run_length_index
from .sharding import op9_rendezvous_sharding
from .simhash import op5_simhash_dedup
from .topk import TOP_K_SQL, op2_branch_and_bound
from .toxicity import op7_toxicity_chain

QUERIES = {
    f.__name__: f
    for f in (
        op1_packing,
        op2_branch_and_bound,
        op3_quality_classifier,
        op4_media_columns,
        op5_simhash_dedup,
        op6_pii_spans,
        op7_toxicity_chain,
        op8_entropy_mixing,
        op9_rendezvous_sharding,
        op10_run_length_index,
        op11_kneser_ney_language,
        op12_merkle_manifest,
        op13_cross_tokenizer,
    )
}

SQL: dict[str, str] = {"op2_branch_and_bound": TOP_K_SQL, "op12_merkle_manifest": MERKLE_SQL}
