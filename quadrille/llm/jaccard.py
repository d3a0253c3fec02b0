"""Near copies by Jaccard similarity of word shingles: SimHash fingerprints and MinHash bands propose pairs, whole sets decide.

Fingerprints of the shingles, linked as simhash.py links them, come first: two bits or fewer. Similar sets differ in more bits than blocks of
fingerprints can be joined on, so bands propose what these leave apart. Bands are joined and verified from the cheapest comparisons on: a set with the least set of its bands, then with the least set
of each, then, of what that leaves apart, every pair that shares a band. Where a band is crowded, these last are
compared in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, reclaim, slices, table, whole_rows
from . import simhash
from .simhash import keep_least, shingle_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: A pair at similarity 0.8 shares no band with a probability of (1 - 0.8 ** 8) ** 40, about 6 in 10,000; at 0.85, 3 in a million.
BANDS, ROWS = 40, 8
#: Sets that share a band and are compared pair by pair; beyond, in blocks of SIDE. Partners of one set in one group of rows.
CROWD, SIDE, FAN = 16, 512, 1000
_FACTORS = np.random.default_rng(42).integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the shingles of a text, sorted; a shorter text is one shingle, one without words none."""
    parts = [np.unique(x) for x in shingle_hashes(text or b"", shingle)]
    if len(parts) == 1:
        return parts[0]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of a set as a signed long: a bit is set if it is in over half the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(hashes)).view(">u8")[0].astype(np.int64))


def bands(hashes: np.ndarray) -> list[int]:
    """A number for each band of least permuted hashes; no hashes, no bands."""
    if not len(hashes):
        return []
    folded = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(folded), 256):
        np.minimum(low, (folded[at : at + 256, None] * _FACTORS).min(axis=0), out=low)
    rows = low.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(r.tobytes(), b) - (1 << 63) for b, r in enumerate(rows)]


def _with_sets(docs: DataFrame, shingle: int, schema: str, columns) -> DataFrame:
    """docs (..., text) with what columns() makes of the shingle sets in place of text."""
    kept = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            sets = [shingle_set(x.as_py(), shingle) for x in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_pydict({f.name: batch.column(f.name) for f in kept} | columns(sets))

    return docs.select(*[f.name for f in kept], "text").mapInArrow(run, T.StructType([*kept, *T._parse_datatype_string(schema).fields]))


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Every row of docs with key (128 bits that equal sets share), n (size of the set), fp (its fingerprint) and bands in place of text."""
    return _with_sets(docs, shingle, "key binary, n int, fp long, bands array<bigint>", lambda sets: {
        "key": pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
        "n": pa.array([len(s) for s in sets], pa.int32()),
        "fp": pa.array([fingerprint(s) for s in sets], pa.int64()),
        "bands": pa.array([bands(s) for s in sets], pa.list_(pa.int64())),
    })


def whole_sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Every row of docs with its set in place of text."""
    return _with_sets(docs, shingle, "hashes array<bigint>", lambda sets: {"hashes": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))})


def _compare(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Similar pairs of rows (v, part, u, hashes) in the order of (v, part, u): the row without u is v itself."""
    own, it = np.zeros(0, dtype=np.int64), None
    for batch in batches:
        us, vs = [], []
        for v, u, hashes in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
            x = hashes.values.to_numpy()
            if u is None:
                own, it = x, v
                continue
            both = len(np.intersect1d(own, x, assume_unique=True)) if v == it else 0
            if both >= similarity * (len(own) + len(x) - both):
                us.append(u)
                vs.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], ["u", "v"])


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose whole sets are as similar. One set is moved for each pair; partners of one v beyond
    FAN are dealt to several groups of rows."""
    many = pairs.groupBy("v").agg(F.ceil(F.count("*") / FAN).alias("parts"))
    v = many.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).join(sets.withColumnRenamed("key", "v"), "v")
    u = pairs.join(many, "v").select("v", F.pmod(F.xxhash64("u"), F.col("parts")).alias("part"), F.col("u").alias("key")).join(sets, "key")
    rows = v.select("v", "part", F.lit(None).cast("binary").alias("u"), "hashes").unionByName(u.select("v", "part", F.col("key").alias("u"), "hashes"))
    return rows.repartition("v", "part").sortWithinPartitions("v", "part", "u").mapInArrow(lambda batches: _compare(batches, similarity), "u binary, v binary")


def similar(a: list[np.ndarray], b: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of similar sets. Hashes that many sets hold are counted by matrix products, rare ones one by one."""
    sizes = [np.array([len(s) for s in x]) for x in (a, b)]
    flat = [np.concatenate(x) for x in (a, b)]
    shared = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    rows, columns, counts = [], [], []
    for x, n in zip(flat, sizes):
        at = np.minimum(np.searchsorted(shared, x), max(0, len(shared) - 1))
        hit = np.flatnonzero(shared[at] == x) if len(shared) else np.zeros(0, dtype=np.int64)
        order = hit[np.argsort(at[hit], kind="stable")]
        rows.append(np.repeat(np.arange(len(n)), n)[order])
        columns.append(at[order])
        counts.append(np.bincount(at[order], minlength=len(shared)))
    common = np.zeros((len(a), len(b)), dtype=np.float32)
    often = counts[0] * counts[1] > len(a) * len(b) // 64
    dense = np.flatnonzero(often)
    for k in range(0, len(dense), 1024):
        part = dense[k : k + 1024]
        sides = []
        for r, c, n in zip(rows, columns, (len(a), len(b))):
            own = np.flatnonzero(np.isin(c, part))
            m = np.zeros((n, len(part)), dtype=np.float32)
            m[r[own], np.searchsorted(part, c[own])] = 1
            sides.append(m)
        common += sides[0] @ sides[1].T
    first = [np.cumsum(c) - c for c in counts]
    rare = np.flatnonzero(~often)
    for k in range(0, len(rare), 4096):
        part = rare[k : k + 4096]
        n = counts[0][part] * counts[1][part]
        of = np.repeat(part, n)
        at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        i = rows[0][first[0][of] + at // counts[1][of]]
        j = rows[1][first[1][of] + at % counts[1][of]]
        common += np.bincount(i * len(b) + j, minlength=len(a) * len(b)).reshape(common.shape)
    return np.nonzero(common >= similarity * (sizes[0][:, None] + sizes[1][None, :] - common))


def _across(groups: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Edges that connect groups (g, key, root) as all similar pairs with one g and two roots do. The largest root of a g
    isn't compared with itself. Sets are dealt into blocks, so that no task sees a whole g."""
    sizes = groups.groupBy("g", "root").count()
    main = sizes.groupBy("g").agg(F.max(F.struct("count", "root")).alias("m"), F.sum("count").alias("all")).select("g", F.col("m.root").alias("main"), F.ceil(F.col("all") / SIDE).alias("x"), F.ceil((F.col("all") - F.col("m.count")) / SIDE).alias("y"))
    rows = groups.join(main.where("y > 0"), "g").join(sets, "key")
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    block = lambda n: F.pmod(F.xxhash64("key"), F.col(n))
    every = rows.withColumn("bx", block("x")).withColumn("by", span("y")).withColumn("side", F.lit(0))
    apart = rows.where("root <> main").withColumn("by", block("y")).withColumn("bx", span("x")).withColumn("side", F.lit(1))

    def run(both: pd.DataFrame) -> pd.DataFrame:
        a, b = (both[both.side == s].sort_values("key") for s in (0, 1))
        if not len(a) or not len(b):
            return pd.DataFrame({"u": [], "v": []})
        i, j = similar([np.asarray(x) for x in a.hashes], [np.asarray(x) for x in b.hashes], similarity)
        found = pd.DataFrame({"u": a.key.to_numpy()[i], "v": b.key.to_numpy()[j], "p": a.root.to_numpy()[i], "q": b.root.to_numpy()[j]})
        return found[found.p != found.q].drop_duplicates(["p", "v"])[["u", "v"]]

    columns = ["g", "bx", "by", "side", "key", "root", "hashes"]
    return every.select(columns).unionByName(apart.select(columns)).groupBy("g", "bx", "by").applyInPandas(run, "u binary, v binary")


def _rooted(rows: DataFrame, roots: DataFrame, key: str = "key", name: str = "root") -> DataFrame:
    return rows.join(roots.select(F.col("node").alias(key), F.col("root").alias(name)), key, "left").withColumn(name, F.coalesce(name, key))


def by_fingerprint(marks: DataFrame) -> DataFrame:
    """Pairs (u, v) of the sets in marks (key, n, fp) whose fingerprints are equal or linked: each set with the least one of its own fingerprint, and
    the least ones of linked fingerprints with each other."""
    rows = marks.where("n > 0").select("key", "fp")
    heads = table(rows.groupBy("fp").agg(F.min("key").alias("head")), "heads")
    own = rows.join(heads, "fp").where("key <> head").select(F.col("key").alias("u"), F.col("head").alias("v"))
    head = lambda c: heads.select(F.col("fp").alias(c), F.col("head").alias(f"h_{c}"))
    linked = simhash.links(heads.select("fp")).distinct().join(head("u"), "u").join(head("v"), "v")
    return own.unionByName(linked.select(F.greatest("h_u", "h_v").alias("u"), F.least("h_u", "h_v").alias("v")))


def links(marks: DataFrame, sets, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root) of the components of the distinct sets in marks (key, n, fp, bands), over pairs that by_fingerprint() gives and all that share a
    band, if they have the similarity. sets: from keys (key) to their sets (key, hashes). Sets without a partner don't appear."""
    spark = marks.sparkSession
    close = table(by_fingerprint(marks), "close")
    filed = table(marks.select("key", "n", F.explode("bands").alias("k")), "filed")
    files = table(filed.groupBy("k").agg(F.count("*").alias("members"), F.min(F.struct("key", "n")).alias("least")).where("members > 1"), "files")
    shared = table(filed.join(files, "k").select("k", "key", "n", "members", F.col("least.key").alias("least"), F.col("least.n").alias("least_n")), "shared")
    reclaim(spark)
    wanted = shared.select("key").unionByName(close.select(F.col("u").alias("key"))).unionByName(close.select(F.col("v").alias("key")))
    whole = table(sets(wanted.distinct()), "whole")
    reclaim(spark)
    fit = lambda p, q: F.least(p, q) >= F.lit(similarity) * F.greatest(p, q)
    stars = table(shared.where((F.col("key") != F.col("least")) & fit("n", "least_n")).select(F.col("key").alias("u"), F.col("least").alias("v")).distinct(), "stars")
    first = stars.groupBy("u").agg(F.min("v").alias("v"))
    edges = table(_verified(close.unionByName(first).distinct(), whole, similarity), "edges")
    roots = table(components(edges), "roots")
    open_ = _rooted(_rooted(stars, roots, "u", "p"), roots, "v", "q").where("p <> q").select("u", "v").join(first, ["u", "v"], "left_anti")
    edges = table(edges.unionByName(_verified(table(open_, "open"), whole, similarity)), "edges")
    roots = table(components(edges), "roots")
    reclaim(spark)
    own = table(_rooted(shared, roots), "rooted")
    apart = own.groupBy("k").agg(F.min("root").alias("a"), F.max("root").alias("z")).where("a <> z").select("k")
    own = table(own.join(apart, "k", "left_semi"), "apart")
    few = own.where(F.col("members") <= CROWD).select("k", "key", "n", "root", "least")
    u = few.select("k", *[F.col(c).alias(f"u_{c}") for c in ("key", "n", "root")])
    pairs = few.join(u, "k").where("key < u_key AND root <> u_root AND key <> least").where(fit("n", "u_n")).select(F.col("u_key").alias("u"), F.col("key").alias("v")).distinct()
    pairs = pairs.join(stars, ["u", "v"], "left_anti")
    edges = edges.unionByName(_verified(table(pairs, "pairs"), whole, similarity))
    # Crowded files that have sets in common are one group, in which each pair is compared once.
    many = own.where(F.col("members") > CROWD)
    if many.limit(1).count():
        crowds = table(components(many.select(F.col("key").alias("u"), F.col("least").alias("v"))), "crowds")
        groups = table(_rooted(many.select("key", "root").distinct(), crowds, "key", "g"), "groups")
        edges = edges.unionByName(_across(groups, whole, similarity))
    return table(components(table(edges, "edges")), "roots")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group that chains of similar texts connect: that of the smallest doc_id, null ids last.
    Equal sets are similar, none among them, so all texts without a word are one group. Rows that agree in everything are one; of
    rows with one id, hashes of all columns choose. All columns stay."""
    whole = whole_rows(docs)
    rows = table(sketches(whole.select("row.doc_id", "k1", "k2", "row.text"), shingle), "sketches")
    least = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    marks = table(rows.groupBy("key").agg(F.min(least).alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "marks")

    def sets(keys: DataFrame) -> DataFrame:
        one = marks.join(keys, "key", "left_semi").select("key", "least.k1", "least.k2")
        own = whole.select("row.text", "k1", "k2").join(one, ["k1", "k2"]).select("key", "text")
        return whole_sets(own, shingle).dropDuplicates(["key"])

    roots = links(marks.select("key", "n", "fp", "bands"), sets, similarity)
    return keep_least(whole, _rooted(marks, roots).select("least", "root"))
