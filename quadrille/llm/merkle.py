"""Merkle manifest: one root over a dataset, and for each row the proof that it belongs to it.

Rows become leaves, 16 neighbours become their hash, level by level: first within each source, then over the sources' roots.
Executors climb LEVELS levels at a time in aligned buckets of 16 ** LEVELS nodes: a bucket is one row of arrays, and DuckDB runs its
levels as ordered string_agg and sha256 over Arrow tables of a few buckets. Spark numbers the nodes, climbs again over the buckets' roots
until each source has one, and joins the outer part of the proofs to the buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import documents, table

#: Children of a node; levels of a bucket; rows that one DuckDB query takes at least, in whole buckets.
FAN, LEVELS, ROWS = 16, 3, 1 << 15
BUCKET = FAN**LEVELS
#: What is hashed of a row.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_hash(*values: Column) -> Column:
    """Lowercase hex sha256 of the values, each as its UTF-8 byte count, a colon and itself, or `-` if null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def tampered_text(doc_id: Column, text: Column, every: int = 5) -> Column:
    """The text with A-Z lower-cased where `every` divides crc32 of the id in decimals; else, and without id, the text."""
    return F.when(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % every == 0, F.translate(text, UPPER, LOWER)).otherwise(text)


def number_nodes(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """rows with i, their place from 0 within their tree, and n, the tree's size. Rows are dealt by ranges and numbered within
    partitions; what partitions before hold of a tree gives the rest, so a tree may span any number of tasks. Rows that agree
    in all of `order` are told apart by where they are read."""
    by = [F.asc_nulls_first(tree), *[F.asc_nulls_first(c) for c in order], F.asc("_at")]
    dealt = rows.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    dealt = table(dealt.withColumn("_part", F.shiftright("_at", 33)), "numbered")
    held = dealt.groupBy("_part", tree).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    own = W.partitionBy(tree)
    before = held.select(F.col("_part").alias("_p"), F.col(tree).alias("_t"), "_first", (F.sum("_n").over(own.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(own).alias("n"))
    joined = dealt.join(before, (F.col("_part") == F.col("_p")) & F.col(tree).eqNullSafe(F.col("_t")))
    return joined.withColumn("i", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_p", "_t", "_first", "_before")


def buckets(nodes: DataFrame, *payload: str) -> DataFrame:
    """tree, bucket, n, nodes: aligned runs of BUCKET nodes (tree, i, n, payload), each in order in one row."""
    listed = F.array_sort(F.collect_list(F.struct((F.col("i") % BUCKET).cast("int").alias("i"), *payload)))
    return nodes.groupBy("tree", F.floor(F.col("i") / BUCKET).alias("bucket")).agg(F.max("n").alias("n"), listed.alias("nodes"))


def depth(n: Column) -> Column:
    """Levels that a bucket of a tree of n nodes climbs: LEVELS where there is more than one bucket."""
    return sum(((n > FAN**k).cast("int") for k in range(LEVELS)), F.lit(0))


# --- DuckDB over a few buckets ---------------------------------------------------------------------------


def _levels() -> str:
    """n0 .. nL: nodes (b, i, h) of each level. s0 ..: the hashes of a run of FAN nodes, laid end to end. Input: x (b, i, h), d (b, depth)."""
    parts = ["n0 AS (SELECT b, i, h FROM x)"]
    for k in range(LEVELS):
        parts.append(f"s{k} AS (SELECT b, i // {FAN} AS i, string_agg(h, '' ORDER BY i) AS s FROM n{k} JOIN d USING (b) WHERE depth > {k} GROUP BY ALL)")
        parts.append(f"n{k + 1} AS (SELECT b, i, sha256(s) AS h FROM s{k} UNION ALL SELECT b, i, h FROM n{k} JOIN d USING (b) WHERE depth <= {k})")
    return ", ".join(parts)


def _proofs() -> str:
    """p: of each row of x what stands left (l0 ..) and right (r0 ..) of its node in the run, level by level; empty above its depth."""
    columns = [f"coalesce(s{k}.s[1 : 64 * (x.i // {FAN**k} % {FAN})], '') AS l{k}, coalesce(s{k}.s[64 * (x.i // {FAN**k} % {FAN}) + 65 :], '') AS r{k}" for k in range(LEVELS)]
    joins = " ".join(f"LEFT JOIN s{k} ON s{k}.b = x.b AND s{k}.i = x.i // {FAN ** (k + 1)}" for k in range(LEVELS))
    return f"p AS (SELECT x.*, d.depth, {', '.join(columns)} FROM x JOIN d USING (b) {joins})"


_STEPS = ", ".join(f"[l{k}, r{k}]" for k in range(LEVELS))
TOPS = f"WITH {_levels()} SELECT b, h FROM n{LEVELS} ORDER BY b"
SIBLINGS = f"WITH {_levels()}, {_proofs()} SELECT b, i, [{_STEPS}][1:depth] AS sides FROM p ORDER BY b, i"
#: The fold starts with [leaf, '']; a level's sides [left, right] take it to [hash, ''].
VERDICTS = f"""WITH {_levels()}, {_proofs()},
w AS (SELECT p.*, list_concat([{_STEPS}][1:depth], o.sides) AS sides FROM p JOIN o USING (b))
SELECT b, i, sha256(array_to_string(flatten(sides), '')) AS proof, list_reduce(list_concat([[t, '']], sides), lambda a, x: [sha256(x[1] || a[1] || x[2]), ''])[1] AS folded FROM w ORDER BY b, i"""


def _engine():
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads = 1; SET memory_limit = '400MB'; SET temp_directory = ''")
    return con


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole buckets, until they hold ROWS nodes."""
    for batch in batches:
        start, held = 0, 0
        sizes = batch.column(batch.schema.get_field_index("nodes")).value_lengths().to_pylist()
        for at, size in enumerate(sizes):
            held += size
            if held >= ROWS or at == len(sizes) - 1:
                yield pa.Table.from_batches([batch.slice(start, at + 1 - start)])
                start, held = at + 1, 0


def _flat(chunk: pa.Table) -> tuple[pa.Table, pa.Table]:
    """(x, d): the nodes of a chunk's buckets, and the buckets' depths; b is a bucket's place in the chunk."""
    nodes = chunk.column("nodes").combine_chunks()
    inner = nodes.flatten()
    x = pa.table({"b": nodes.value_parent_indices(), **{f.name: inner.field(k) for k, f in enumerate(inner.type)}})
    return x, pa.table({"b": pa.array(range(chunk.num_rows), pa.int64()), "depth": chunk.column("depth")})


def _climb(sql: str, keys: list[str], per_node: bool):
    """Buckets (keys, n, nodes, depth) to keys and what sql gives: a row per bucket, or per node with its place i."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _engine()
        for chunk in _chunks(batches):
            x, d = _flat(chunk)
            con.register("x", x)
            con.register("d", d)
            if "sides" in chunk.column_names:
                con.register("o", pa.table({"b": d.column("b"), "sides": chunk.column("sides")}))
            found = con.sql(sql).to_arrow_table()
            b = found.column("b").combine_chunks()
            out = {k: chunk.column(k).combine_chunks().take(b) for k in keys}
            if per_node:
                out |= {c: x.column(c).combine_chunks() for c in x.column_names if c not in ("b", "t", *(["h"] if "proof" not in found.column_names else []))}
            out |= {c: found.column(c).combine_chunks() for c in found.column_names if c not in ("b", "i")}
            yield from pa.table(out).to_batches()

    return run


# --- Trees -----------------------------------------------------------------------------------------------

_SIDES = T.ArrayType(T.ArrayType(T.StringType()))


def climb(nodes: DataFrame) -> DataFrame:
    """tree, i, root, sides of nodes (tree, i, n, h): the root of the node's tree, and level by level what stands left and right
    of the node. Every turn leaves one node of BUCKET; the turns are as many as the largest tree needs."""
    tree = nodes.schema["tree"]
    if (nodes.agg(F.max("n")).first()[0] or 0) <= 1:
        return nodes.select("tree", "i", F.col("h").alias("root"), F.array().cast(_SIDES).alias("sides"))
    packed = table(buckets(nodes, "h").withColumn("depth", depth(F.col("n"))), "buckets")
    up = climb(table(tops(packed, tree), "tops")).select(F.col("tree").alias("_t"), F.col("i").alias("_b"), "root", F.col("sides").alias("outer"))
    schema = T.StructType([tree, T.StructField("bucket", T.LongType()), T.StructField("i", T.IntegerType()), T.StructField("sides", _SIDES)])
    own = packed.mapInArrow(_climb(SIBLINGS, ["tree", "bucket"], True), schema)
    joined = own.join(up, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("bucket") == F.col("_b")))
    return table(joined.select("tree", (F.col("bucket") * BUCKET + F.col("i")).alias("i"), "root", F.concat("sides", "outer").alias("sides")), "sides")


def tops(packed: DataFrame, tree: T.StructField) -> DataFrame:
    """The buckets' roots as nodes (tree, i, n, h) of the next turn."""
    schema = T.StructType([tree, *T._parse_datatype_string("bucket long, n long, h string").fields])
    found = packed.mapInArrow(_climb(TOPS, ["tree", "bucket", "n"], False), schema)
    return found.select("tree", F.col("bucket").alias("i"), F.ceil(F.col("n") / BUCKET).alias("n"), "h")


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified of every row of docs (FIELDS).

    Within a source leaves ascend by doc_id, a null id first, equal ids by leaf; rows that agree in everything have equal leaves and
    places next to each other, in any order. A null source is a tree like any other and the first. A source of one row is its own
    subroot, a dataset of one source has its subroot as root, and a node without siblings adds nothing to a proof. Null values are
    hashed as `-`, which no other value is. An empty table gives an empty manifest; other columns are left out. Texts are hashed where
    they are read and don't move; what is shuffled has some 100 bytes a row. Memory: one bucket, or ROWS nodes, a task.
    """
    text = tampered_text(F.col("doc_id"), F.col("text"))
    hashes = docs.select("doc_id", F.col("source").alias("tree"), leaf_hash(*map(F.col, FIELDS)).alias("h"), leaf_hash(*map(F.col, FIELDS[:-1]), text).alias("t"))
    leaves = table(hashes, "leaves")
    packed = table(buckets(number_nodes(leaves, "tree", "doc_id", "h"), "doc_id", "h", "t").withColumn("depth", depth(F.col("n"))), "buckets")
    tree = docs.schema["source"]
    tree = T.StructField("tree", tree.dataType)
    inner = table(climb(table(tops(packed, tree), "tops")), "inner")
    roots = inner.where("i = 0").select(F.lit(0).alias("all"), F.col("tree").alias("source"), F.col("root").alias("h"))
    sources = table(number_nodes(roots, "all", "source"), "sources")
    over = climb(sources.select(F.col("all").alias("tree"), "i", "n", "h")).select("i", F.col("root").alias("whole"), F.col("sides").alias("outer"))
    over = sources.select(F.col("source").alias("_s"), F.col("h").alias("subroot"), "i").join(over, "i").drop("i")
    outer = inner.join(over, F.col("tree").eqNullSafe(F.col("_s"))).select(F.col("tree").alias("_t"), F.col("i").alias("_b"), "subroot", F.col("whole").alias("root"), F.concat("sides", "outer").alias("sides"))
    ready = packed.join(outer, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("bucket") == F.col("_b"))).select("tree", "subroot", "root", "sides", "depth", "nodes")
    schema = T.StructType([tree, *T._parse_datatype_string("subroot string, root string, i int").fields, docs.schema["doc_id"], *T._parse_datatype_string("h string, proof string, folded string").fields])
    found = ready.mapInArrow(_climb(VERDICTS, ["tree", "subroot", "root"], True), schema)
    return found.select("doc_id", F.col("tree").alias("source"), F.col("h").alias("leaf"), "subroot", "root", F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = manifest(documents(spark, sf_dir, *FIELDS))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


# --- SQL -------------------------------------------------------------------------------------------------

_CRC = "xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295)"
#: Levels of a tree in SQL: enough for 16 ** 8 rows of a source and as many sources.
_TALL = 8


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in (*FIELDS[:-1], text)) + ")"


def _tree_sql(name: str) -> str:
    """{name}0 (tree, i, h, n) to {name}{_TALL}, runs {name}s0 ..: as in _levels(), until one node is left."""
    parts = []
    for k in range(_TALL):
        parts.append(f"{name}s{k} AS (SELECT tree, i // 16 AS i, string_agg(h, '' ORDER BY i) AS s, any_value(n) AS n FROM {name}{k} WHERE n > 1 GROUP BY 1, 2)")
        parts.append(f"{name}{k + 1} AS (SELECT tree, i, sha256(s) AS h, (n + 15) // 16 AS n FROM {name}s{k} UNION ALL SELECT tree, i, h, n FROM {name}{k} WHERE n = 1)")
    return ", ".join(parts)


def _walk_sql(name: str, source: str, tree: str) -> str:
    """{name}w0 .. from {name}w0 (i, f, proof, ...): each row's fold f and proof after each level."""
    parts = []
    for k in range(_TALL):
        left, right = "coalesce(s.s[1 : 64 * (w.i % 16)], '')", "coalesce(s.s[64 * (w.i % 16) + 65 :], '')"
        parts.append(f"{name}w{k + 1} AS (SELECT w.* REPLACE (w.i // 16 AS i, CASE WHEN s.s IS NULL THEN w.f ELSE sha256({left} || w.f || {right}) END AS f, w.proof || {left} || {right} AS proof) FROM {name}w{k} w LEFT JOIN {source}s{k} s ON s.tree IS NOT DISTINCT FROM w.{tree} AND s.i = w.i // 16)")
    return ", ".join(parts)


MERKLE_SQL = f"""WITH e AS (SELECT *, CASE WHEN {_CRC} % 5 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS other FROM documents),
r AS (SELECT doc_id, source, {_leaf_sql('text')} AS leaf, {_leaf_sql('other')} AS t FROM e),
q AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM r),
a0 AS (SELECT source AS tree, i, leaf AS h, n FROM q), {_tree_sql('a')},
b0 AS (SELECT 0 AS tree, row_number() OVER (ORDER BY encode(tree) NULLS FIRST) - 1 AS i, h, count(*) OVER () AS n FROM a{_TALL}), {_tree_sql('b')},
o AS (SELECT tree AS source, row_number() OVER (ORDER BY encode(tree) NULLS FIRST) - 1 AS at, h AS subroot, 0 AS one FROM a{_TALL}),
xw0 AS (SELECT q.doc_id, q.source, q.leaf, q.i, q.t AS f, '' AS proof FROM q), {_walk_sql('x', 'a', 'source')},
yw0 AS (SELECT x.doc_id, x.leaf, o.subroot, o.one, o.at AS i, x.f, x.proof FROM xw{_TALL} x JOIN o ON o.source IS NOT DISTINCT FROM x.source), {_walk_sql('y', 'b', 'one')}
SELECT y.doc_id, y.leaf, y.subroot, b.h AS root, sha256(y.proof) AS proof_sha256, y.f AS folded_root, y.f = b.h AS verified FROM yw{_TALL} y, b{_TALL} b"""
