"""SimHash near-dedup: pigeonhole blocks, joined, then verified by Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, documents, one_of_equal, slices, table, whole_rows, word_parts

SHINGLE, SEED, DISTANCE = 3, 42, 2
#: Four blocks of 16 bits: fingerprints within two bits agree on two blocks at least.
BLOCKS, WIDTH = 4, 16
#: A pair of blocks shared by more fingerprints than this goes by their neighbours instead of by pairs.
CROWD = 16


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of a text, in parts, so that memory doesn't grow with the text."""
    digest, join = xxhash.xxh64_intdigest, b" ".join
    kept: list[bytes] = []
    any_yet = False
    for words in word_parts(text.lower()):
        words = kept + words
        if len(words) >= shingle:
            any_yet = True
            own = [digest(s, SEED) for s in map(join, zip(*[words[i:] for i in range(shingle)]))]
            yield np.array(own, dtype=np.uint64)
        kept = words[-(shingle - 1) :]
    if kept and not any_yet:
        yield np.array([digest(join(kept), SEED)], dtype=np.uint64)


def fingerprint(text: bytes | None) -> int:
    """The 64-bit fingerprint as a signed long: a bit is set if it is in over half the hashes."""
    counts, n = np.zeros(64, dtype=np.int64), 0
    for hashes in shingle_hashes(text or b""):
        n += len(hashes)
        for at in range(0, len(hashes), 1 << 15):
            part = hashes[at : at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > n).view(">u8")[0].astype(np.int64)) if n else 0


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        kept = {n: batch.column(n) for n in batch.schema.names if n != "text"}
        texts = batch.column("text").cast(pa.binary())
        yield pa.RecordBatch.from_pydict(kept | {"fp": pa.array([fingerprint(x.as_py()) for x in texts], pa.int64())})


def fingerprints(docs: DataFrame) -> DataFrame:
    """Every row of docs with fp in place of text; a null text counts as empty: fp 0."""
    kept = [f for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType([*kept, T.StructField("fp", T.LongType())])
    return docs.select(*[f.name for f in kept], "text").mapInArrow(_fingerprints, schema)


def links(marks: DataFrame) -> DataFrame:
    """Edges (u, v) that connect the distinct fingerprints fp exactly as all pairs within DISTANCE do.

    Every fingerprint is filed under the six pairs of its four blocks. Within two bits, two blocks at
    least are untouched, so close fingerprints meet in a file; members of a file are joined and verified.
    A crowded file would make a square of pairs. Its members are listed instead under themselves and
    their 64 neighbours at one bit: two of them are within two bits exactly if they share a list, so an
    edge from each to the smallest of every list connects the same fingerprints. A list has 65 members at most.
    """
    def file(i: int, j: int):
        mask = (0xFFFF << (WIDTH * i)) | (0xFFFF << (WIDTH * j))
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        return F.struct(F.lit(4 * i + j).alias("c"), F.col("fp").bitwiseAND(F.lit(mask)).alias("k"))

    filed = marks.select("fp", F.explode(F.array(*[file(i, j) for i, j in combinations(range(BLOCKS), 2)])).alias("f")).select("fp", "f.c", "f.k")
    sizes = table(filed.groupBy("c", "k").count().where("count > 1"), "files")
    few = filed.join(sizes.where(F.col("count") <= CROWD), ["c", "k"]).select("c", "k", "fp")
    pairs = few.select("c", "k", F.col("fp").alias("u")).join(few.select("c", "k", F.col("fp").alias("v")), ["c", "k"]).where("u > v")
    pairs = pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= DISTANCE).select("u", "v")
    many = filed.join(sizes.where(F.col("count") > CROWD), ["c", "k"], "left_semi").select("fp").distinct()
    bits = F.array(F.lit(0).cast("long"), *[F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b).cast("long") for b in range(64)])
    lists = many.select("fp", F.explode(F.transform(bits, lambda b: F.col("fp").bitwiseXOR(b))).alias("k"))
    low = lists.groupBy("k").agg(F.min("fp").alias("m"), F.count("*").alias("n")).where("n > 1")
    stars = lists.join(low, "k").where("fp <> m").select(F.col("fp").alias("u"), F.col("m").alias("v"))
    return pairs.unionByName(stars)


def _groups(rows: DataFrame, least) -> DataFrame:
    """fp, root, least: the group of each fingerprint in rows, and the least of its own rows."""
    marks = table(rows.groupBy("fp").agg(F.min(least).alias("least")), "marks")
    roots = table(components(links(marks.select("fp"))), "roots")
    return marks.join(roots, marks.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of every row of docs (doc_id, text).

    component_id is the smallest doc_id that the row reaches over fingerprints at DISTANCE or fewer
    bits, itself included; null ids are passed over, and a component of null ids only has none. Rows
    without a word have fingerprint zero and are linked like others. Repeated rows each return.
    """
    rows = table(fingerprints(docs.select("doc_id", "text")), "fingerprints")
    own = _groups(rows, "doc_id")
    ids = own.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(own.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near_duplicates: that of the smallest doc_id, null ids last. Rows that agree in
    everything are one; of rows with one id, hashes of all columns choose. All columns stay."""
    whole = whole_rows(docs)
    rows = table(fingerprints(whole.select("row.doc_id", "k1", "k2", "row.text")), "fingerprints")
    return keep_least(whole, _groups(rows, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")))


def keep_least(whole: DataFrame, own: DataFrame) -> DataFrame:
    """The row of whole (whole_rows) that is the least of each root in own (root, least: a struct that ends in its keys)."""
    first = own.groupBy("root").agg(F.min("least").alias("one")).select("one.k1", "one.k2")
    return one_of_equal(whole.join(first, ["k1", "k2"], "left_semi")).select("row.*")


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
