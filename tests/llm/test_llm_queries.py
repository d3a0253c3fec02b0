"""The final columns of the registered queries, on the smallest tables."""

import hashlib
import zlib

import pytest

from quadrille.llm import queries

SF = "/root/testdata/sf0.001"
#: Columns that the contracts name, with their types.
COLUMNS = {
    "op1_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op2_branch_and_bound": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op3_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4_media_columns": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op5_simhash_dedup": "doc_id bigint, fingerprint string, component_id bigint",
    "op6_pii_spans": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op8_entropy_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op9_rendezvous_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op10_run_length_index": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op11_kneser_ney_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op12_merkle_manifest": "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
    "op13_cross_tokenizer": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, name):
    found = queries.QUERIES[name](spark, SF)
    have = dict(found.dtypes)
    assert {c: have.get(c) for c in (x.split()[0] for x in COLUMNS[name].split(", "))} == dict(x.split() for x in COLUMNS[name].split(", "))
    rows = found.collect()
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    if name != "op2_branch_and_bound":
        assert {r.doc_id for r in rows} == set(texts) and (name == "op1_packing" or len(rows) == len(texts))
    for r in rows:
        if name == "op4_media_columns":
            own = texts[r.doc_id]
            payload = own + bytes(-len(own) % 64 if own else 64)
            assert (r.n_bytes, r.payload_bytes) == (len(own), len(payload)) and r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        if name == "op9_rendezvous_sharding":
            own = texts[r.doc_id]
            assert (r.size, r.text_crc32, r.law) == (len(own) + 8, zlib.crc32(own), "key") and 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
        if name == "op10_run_length_index" and not r.n_removed:
            assert r.kept_sha256 == hashlib.sha256(texts[r.doc_id]).hexdigest() and r.n_spans == 0
