"""A corpus pipeline: documents in, packed training sequences out. Each stage calls one operator.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before has kept; what it returns
is written as Parquet and read again. All but the last return the columns of documents, and further columns, whatever their names, pass through them. An
empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import table
from quadrille.llm.jaccard import keep_one
from quadrille.llm.mixing import take_copies
from quadrille.llm.packing import TOKENIZER, pack_documents
from quadrille.llm.pii import redact_documents
from quadrille.llm.toxicity import fit_toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain takes for toxic go. A null or empty text has no words, so that the model without words decides; rows that agree share a verdict."""
    return fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).reject(docs, "toxic")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, Jaccard similarity of 0.8 or more. Of rows that agree in
    everything one stays; texts under five words are one shingle, and texts without words are copies of each other."""
    return keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become the names of their kinds; n_chars follows the text. A null text stays null, with its n_chars."""
    return redact_documents(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stays as often as the mix takes it: not at all, once, twice. Documents without words have no size and stay
    as the mix rounds them; a null source is one source."""
    return take_copies(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids and their places in windows of 2048. A null or empty text is one id. Rows of one doc_id
    are packed each."""
    found = pack_documents(docs.select("doc_id", "text"), public_tokenizers.path(TOKENIZER))
    return found.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learnt classifiers, token ids and checksums have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
