"""Edges from samples to candidates, the test of two edges by a core's vote, and their order by a quicksort with that test.

The core of a sample s against a sample t is a prefix of t's kernel in the order of edges, for whatever t: merging two kernels leaves both in
their order, and the merged ranks that are taken out are the last ones. So a vote needs of a candidate v only the middles of its distances to the
first m vertices of the kernel of t. An edge (t, v) carries these as an array: that is the table M(s, t, v) of middle distances, with m for s.
Once the edges are made no vector moves, whatever its width; a level of the sort shuffles nothing but counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..storage import release, table

#: The gap behind a kernel; edges of a node that one task sorts; pivots of a pass; bytes of samples' vectors that travel at once.
DELTA, NODE, PIVOTS, BLOCK = 5, 200_000, 1 << 14, 1 << 26
#: Kernels that are merged at once, pairs of samples whose cores are held, and what stands for a rank that isn't there.
AT_ONCE, PAIRS, NONE = 1 << 13, 1 << 16, np.iinfo(np.int64).max
#: Edges that a task makes; edges that are sorted together; edges of a node, and levels, from which it is worth while to look for pivots that split nothing.
MADE, TOGETHER, LARGE, TURNS = 200_000, 20_000, 256, 4


# --- Vectors ---------------------------------------------------------------------------------------------


def matrix(column: pa.Array) -> np.ndarray:
    """A column of vectors as doubles. Vectors that are missing, unequal in length or hold nulls are errors."""
    flat = column.flatten()
    width = len(flat) // max(1, len(column))
    if column.null_count or flat.null_count or not (column.value_lengths().to_numpy() == width).all():
        raise ValueError("vectors are missing, unequal in length or hold nulls")
    return flat.to_numpy().astype(np.float64).reshape(len(column), width)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs, summed dimension by dimension as the column expression does."""
    out = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        out += (x[:, j : j + 1] - y[:, j]) ** 2
    return out


# --- Samples with their kernels --------------------------------------------------------------------------


@dataclass
class Block:
    """Samples in the order of p, their vectors, and their kernels: ranks of edges, and places among the vertices (-1: none)."""

    ids: pa.Array
    p: np.ndarray
    vectors: np.ndarray
    ranks: np.ndarray
    at: np.ndarray
    vertices: np.ndarray


def blocks(one: DataFrame, kernel: DataFrame, active: DataFrame, width: int, limit: int = BLOCK) -> Iterator[Block]:
    """The samples `one` (id, p, embedding), each with its kernel (s, v, xr) of at most `width` vertices, which are rows of active, in
    blocks of `limit` bytes of vectors: what the driver and a task hold doesn't grow with the number of samples."""
    ends = kernel.join(active.select(F.col("id").alias("v"), F.col("embedding").alias("vector")), "v")
    listed = ends.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("xr", "v", "vector"))).alias("kernel")).withColumnRenamed("s", "id")
    held = table(one.select("id", "p", "embedding").join(listed, "id", "left").withColumn("kernel", F.coalesce("kernel", F.array())), "samples")
    size = held.agg(F.max(F.size("embedding")), F.max("p")).first()
    step = max(1, limit // (8 * (width + 1) * max(1, size[0] or 0)))
    for low in range(0, size[1] or 0, step):
        yield _block(held.where(F.col("p").between(low + 1, low + step)).orderBy("p").toArrow(), width)
    release(held)


def _block(found: pa.Table, width: int) -> Block:
    lists = found.column("kernel").combine_chunks()
    inner = lists.flatten()
    row, place = lists.value_parent_indices().to_numpy(), np.zeros(len(inner), dtype=np.int64)
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, dtype=np.int64)
    place = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))
    ranks, at = np.full((len(found), width), NONE), np.full((len(found), width), -1)
    vectors = matrix(found.column("embedding").combine_chunks())
    vertices = np.zeros((0, vectors.shape[1]))
    if len(row):
        names = inner.field("v").dictionary_encode()
        _, first = np.unique(names.indices.to_numpy(), return_index=True)
        ranks[row, place], at[row, place] = inner.field("xr").to_numpy(), names.indices.to_numpy()
        vertices = matrix(inner.field("vector").take(pa.array(first)))
    return Block(found.column("id").combine_chunks(), found.column("p").to_numpy().astype(np.int64), vectors, ranks, at, vertices)


def middles(d: np.ndarray) -> np.ndarray:
    """Of distances to a kernel in the order of its edges (last axis): for m = 1, 2, ... the (m // 2 + 1)-th least of the first m."""
    out = np.empty_like(d)
    for m in range(1, d.shape[-1] + 1):
        out[..., m - 1] = np.partition(d[..., :m], m // 2, axis=-1)[..., m // 2]
    return out


def edge_table(candidates: DataFrame, parts: Iterator[Block], seed: int) -> DataFrame:
    """s, v, p, d, ranks, middles, h: all edges of the samples of the blocks to candidates (id, embedding). Ranks are those of the edges of s's kernel,
    middles say how far its vertices are from v; h is the hash that chooses pivots. Each block is one pass over the candidates, which are dealt
    out by the number of edges, whatever files they come from."""
    kind = candidates.schema["id"].dataType
    schema = T.StructType([T.StructField("s", kind), T.StructField("v", kind), *T._parse_datatype_string("p long, d double, ranks array<long>, middles array<double>").fields])
    spark, out = candidates.sparkSession, None
    n, rows = candidates.count(), candidates.select("id", "embedding")
    for part in parts:
        dealt = rows.repartition(max(spark.sparkContext.defaultParallelism, -(-n * len(part.p) // MADE)), "id")
        shared = spark.sparkContext.broadcast(part)
        found = dealt.mapInArrow(_edges(shared, to_arrow_type(kind)), schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.withColumn("h", F.xxhash64(F.lit(seed), "s", "v"))


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())


def _edges(shared, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Block = shared.value
        n, width = b.at.shape
        step = max(1, (1 << 20) // (n * (width + 1) + len(b.vertices)))
        for batch in batches:
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                x = matrix(part.column(1))
                d = distances(x, b.vectors)
                if len(b.vertices):
                    near = np.where(b.at >= 0, distances(x, b.vertices)[:, b.at], np.inf)
                else:
                    near = np.full((len(x), n, width), np.inf)
                v, s = np.repeat(np.arange(len(x)), n), np.tile(np.arange(n), len(x))
                yield pa.RecordBatch.from_arrays(
                    [b.ids.cast(kind).take(pa.array(s)), part.column(0).take(pa.array(v)), pa.array(b.p[s]), pa.array(d.ravel()), _lists(b.ranks[s]), _lists(middles(near).reshape(-1, width))],
                    ["s", "v", "p", "d", "ranks", "middles"],
                )

    return run


# --- The test --------------------------------------------------------------------------------------------


@dataclass
class Edges:
    """Edges as arrays: number of the sample, distance, ranks of its kernel, middles of the other end's distances to it."""

    p: np.ndarray
    d: np.ndarray
    ranks: np.ndarray
    middles: np.ndarray

    @classmethod
    def of(cls, batch, prefix: str = "") -> Edges:
        p, d, ranks, mid = (_whole(batch.column(f"{prefix}{c}")) for c in ("p", "d", "ranks", "middles"))
        return cls(p.to_numpy(), d.to_numpy(), *(x.flatten().to_numpy().reshape(len(p), -1) for x in (ranks, mid)))

    def take(self, at: np.ndarray) -> Edges:
        return Edges(self.p[at], self.d[at], self.ranks[at], self.middles[at])


def _whole(column):
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


class Cores:
    """What the test of two edges needs of their samples alone: how much of a kernel the core is (0: it is empty, or a kernel is), and whether the
    core lies at the second edge's end. Made once for all pairs of the samples of two lots of edges where these are few for the number of edges,
    else for each pair of edges.

    The core belongs to the sample whose kernel has the last edge, and is the other kernel's prefix of merged ranks below
    2 * kernel - DELTA; between edges of one sample it is the kernel."""

    def __init__(self, a: Edges, b: Edges, kernel: int) -> None:
        self.kernel = kernel
        (self.left, one), (self.right, two) = map(self._samples, (a, b))
        self.size = None
        if len(one) * len(two) <= max(PAIRS, len(a.p)):
            size, second = self._of(a, np.repeat(one, len(two)), b, np.tile(two, len(one)))
            self.size, self.second = size.reshape(len(one), -1), second.reshape(len(one), -1)

    @staticmethod
    def _samples(edges: Edges) -> tuple[np.ndarray, np.ndarray]:
        """(a number from 0 on by p, an edge of each number's sample)."""
        at = np.full(edges.p.max(initial=-1) + 1, -1)
        at[edges.p] = np.arange(len(edges.p))
        there = at >= 0
        return np.cumsum(there) - 1, at[there]

    def of(self, a: Edges, i: np.ndarray, b: Edges, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(size, second) of the edges i of a and j of b."""
        if self.size is None:
            return self._of(a, i, b, j)
        one, two = self.left[a.p[i]], self.right[b.p[j]]
        return self.size[one, two], self.second[one, two]

    def _of(self, a: Edges, i: np.ndarray, b: Edges, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size, second = np.empty(len(i), dtype=np.int64), np.empty(len(i), dtype=bool)
        for low in range(0, len(i), AT_ONCE):
            part = slice(low, low + AT_ONCE)
            size[part], second[part] = self._merged(a.ranks[i[part]], b.ranks[j[part]], a.p[i[part]] == b.p[j[part]])
        return size, second

    def _merged(self, a: np.ndarray, b: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        last = (np.where(a == NONE, -1, a).max(axis=1) > np.where(b == NONE, -1, b).max(axis=1))[:, None]
        owner, other = np.where(last, a, b), np.where(last, b, a)
        merged = np.arange(1, other.shape[1] + 1) + (owner[:, None, :] < other[:, :, None]).sum(axis=2)
        m = ((other != NONE) & (merged < 2 * self.kernel - DELTA)).sum(axis=1)
        held = [(x != NONE).sum(axis=1) for x in (a, b)]
        m = np.where(same, held[1], m)
        return np.where((held[0] == 0) | (held[1] == 0), 0, m), last[:, 0] | same


def before(a: Edges, b: Edges, kernel: int) -> np.ndarray:
    """Whether each edge of a comes before that of b: most of a core agrees. A count of "not nearer" answers above half of L is a comparison
    with the (L // 2 + 1)-th least distance to the core, so no answer is asked one by one. An empty core says yes."""
    rows = np.arange(len(a.p))
    return before_at(a, rows, b, rows, Cores(a, b, kernel))


def before_at(a: Edges, i: np.ndarray, b: Edges, j: np.ndarray, cores: Cores) -> np.ndarray:
    """before() of the edges i of a and j of b, of which only the distances that decide are read."""
    m, second = cores.of(a, i, b, j)
    at = np.maximum(m - 1, 0)
    return np.where(m == 0, True, np.where(second, a.d[i] < b.middles[j, at], a.middles[i, at] <= b.d[j]))


def test_edges(found: DataFrame, kernel: int) -> DataFrame:
    """found (columns of an edge_table(), and those of the edge to compare with under pivot_*) with less."""
    kept = [c for c in found.columns if c.removeprefix("pivot_") not in ("p", "d", "ranks", "middles")]
    schema = T.StructType([*[found.schema[c] for c in kept], T.StructField("less", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                less = before(Edges.of(b), Edges.of(b, "pivot_"), kernel)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(less)], [*kept, "less"])

    return found.mapInArrow(run, schema)


# --- The sort --------------------------------------------------------------------------------------------


def splitless(edges: Edges, rows: np.ndarray, cores: Cores) -> np.ndarray:
    """Of the first edges of a node in the order of their hashes those that don't split it, as pivots one after the other: whether all that is left
    of the node comes before each. Least and greatest distances by sample tell, without a test of each edge by each pivot."""
    number = cores.left[edges.p[rows]]
    order = np.argsort(number, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], number[order[1:]] != number[order[:-1]]]))
    there = number[order[starts]]
    d, mid = edges.d[rows[order]], edges.middles[rows[order]]
    low, high = (f.reduceat(d, starts)[:, None] for f in (np.minimum, np.maximum))
    lows, highs = (f.reduceat(mid, starts, axis=0) for f in (np.minimum, np.maximum))
    pivots = rows[: min(len(rows) - 1, max(LARGE, len(rows) // 2), (1 << 22) // len(there))]
    q = cores.right[edges.p[pivots]]
    m, second = cores.size[there[:, None], q], cores.second[there[:, None], q]
    at, own = np.maximum(m - 1, 0), np.arange(len(there))[:, None]
    its, pivot_d = edges.middles[pivots, at], edges.d[pivots]
    all_less = ((m == 0) | np.where(second, high < its, highs[own, at] <= pivot_d)).all(axis=0)
    none_less = ((m != 0) & np.where(second, low >= its, lows[own, at] > pivot_d)).all(axis=0)
    known = all_less | none_less
    return all_less[: len(known) if known.all() else known.argmin()]


def quicksort(low: np.ndarray, edges: Edges, kernel: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, children) of edges in the order of their hashes. low: the first place of each one's node. The pivot of a node is its
    first edge; all nodes of a level are split at once. children[0] and [1]: the pivots of what is less and of what isn't, -1 if nothing is.

    Where samples' edges answer alike, a pivot splits nothing, and as many levels as edges would follow: pivots like that are found many at once."""
    place, child, slot = np.empty(len(low), dtype=np.int64), np.full((2, len(low)), -1), np.full(len(low), -1)
    low, rows, cores, level = low.copy(), np.arange(len(low)), Cores(edges, edges, kernel), 0
    uneven = np.zeros(len(low), dtype=bool)

    def link(pivots: np.ndarray) -> None:
        known = pivots[slot[pivots] >= 0]
        child[slot[known] % 2, slot[known] // 2] = known

    while len(rows):
        rows, level = rows[np.argsort(low[rows], kind="stable")], level + 1
        head = np.concatenate([[True], low[rows[1:]] != low[rows[:-1]]])
        if level % TURNS == 0 and cores.size is not None:
            left = np.ones(len(rows), dtype=bool)
            first = np.flatnonzero(head)
            size = np.diff(np.append(first, len(rows)))
            for at, n in zip(first.tolist(), size.tolist()):
                if n < LARGE or not uneven[rows[at]]:
                    continue
                node = rows[at : at + n]
                less = splitless(edges, node, cores)
                if t := len(less):
                    gone, rest = node[:t], node[t:]
                    place[gone] = np.where(less, low[gone] + n - np.cumsum(less), low[gone] + np.cumsum(~less) - 1)
                    slot[node[1 : t + 1]] = 2 * gone + ~less
                    slot[rest] = 2 * gone[-1] + ~less[-1]
                    link(gone)
                    low[rest] += (~less).sum()
                    left[at : at + t] = False
            rows = rows[left]
            head = np.concatenate([[True], low[rows[1:]] != low[rows[:-1]]])
        pivots, group = rows[head], np.cumsum(head) - 1
        link(pivots)
        rest, own = rows[~head], group[~head]
        pivot = pivots[own]
        less = before_at(edges, rest, edges, pivot, cores)
        size, fewer = np.bincount(own, minlength=len(pivots)), np.bincount(own[less], minlength=len(pivots))
        place[pivots] = low[pivots] + fewer
        slot[rest] = 2 * pivot + ~less
        low[rest] = np.where(less, low[rest], place[pivot] + 1)
        uneven[rest] = (16 * np.minimum(fewer, size - fewer) < size)[own]
        rows = rest
    return place, child


@dataclass
class Trees:
    """Search trees of the pivots of some nodes: low of each node, its first pivot (-1: none), and for pivots, place among those of all nodes."""

    low: np.ndarray
    root: np.ndarray
    first: np.ndarray
    edges: Edges
    place: np.ndarray
    child: np.ndarray

    def gaps(self, low: np.ndarray, edges: Edges, kernel: int) -> np.ndarray:
        """How many pivots of its node come before each edge."""
        node = np.searchsorted(self.low, low)
        at, gap = self.root[node], np.zeros(len(low), dtype=np.int64)
        cores = Cores(edges, self.edges, kernel) if (at >= 0).any() else None
        while len(open_ := np.flatnonzero(at >= 0)):
            now = at[open_]
            side = (~before_at(edges, open_, self.edges, now, cores)).astype(np.int64)
            gap[open_] = self.place[now] - self.first[node[open_]] + side
            at[open_] = self.child[side, now]
        return gap


def _pass(live: DataFrame, nodes: list[tuple[int, int, int]], kernel: int, pivots: int) -> tuple[DataFrame, list[tuple], list[tuple]]:
    """One pass over the edges of nodes (low, high, least hash): (edges with their new low; new nodes; (s, v, place) of the pivots).

    The pivots are the edges of least hash, `pivots` of all nodes as one expects of hashes. Inserted in the order of hashes they are the
    top of the tree that splitting by one pivot at a time would give."""
    spark = live.sparkSession
    share = max(1, pivots // len(nodes))
    bounds = [(lo, hi, least + ((1 << 63) - least) * share // max(share, hi - lo) - (hi - lo <= share)) for lo, hi, least in nodes]
    kept = spark.createDataFrame([(lo, t) for lo, _, t in bounds], "low long, bound long")
    live = live.join(F.broadcast(kept), "low")
    chosen = live.where(F.col("h") <= F.col("bound")).orderBy("low", "h", "s", "v").toArrow()
    low = chosen.column("low").to_numpy()
    lows = np.array([lo for lo, _, _ in bounds])
    order = np.argsort(lows)
    first, sizes = np.searchsorted(low, lows[order]), np.searchsorted(low, lows[order], side="right") - np.searchsorted(low, lows[order])
    edges = Edges.of(chosen) if len(low) else None
    place, child = quicksort(np.repeat(first, sizes), edges, kernel) if edges else (np.zeros(0, dtype=np.int64), np.zeros((2, 0), dtype=np.int64))
    trees = spark.sparkContext.broadcast(Trees(lows[order], np.where(sizes > 0, first, -1), first, edges, place, child))
    schema = T.StructType([*[f for f in live.schema if f.name != "bound"], T.StructField("gap", T.LongType())])
    names = schema.names[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                gap = trees.value.gaps(b.column("low").to_numpy(), Edges.of(b), kernel)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(gap)], [*names, "gap"])

    parted = table(live.where(F.col("h") > F.col("bound")).mapInArrow(run, schema), "level")
    counted = parted.groupBy("low", "gap").count().toArrow()
    count = {(lo, g): n for lo, g, n in zip(*(counted.column(c).to_pylist() for c in ("low", "gap", "count")))}
    moved, new, done = [], [], []
    names_of = list(zip(chosen.column("s").to_pylist(), chosen.column("v").to_pylist()))
    for (lo, _, bound), f, size in zip([bounds[i] for i in order], first.tolist(), sizes.tolist()):
        at = lo
        inside = {int(place[i]) - f: names_of[i] for i in range(f, f + size)}
        for g in range(size + 1):
            if n := count.get((lo, g), 0):
                moved.append((lo, g, at))
                new.append((at, at + n, bound))
                at += n
            if g < size:
                done.append((*inside[g], at))
                at += 1
    to = spark.createDataFrame(moved, "low long, gap long, to long")
    return parted.join(F.broadcast(to), ["low", "gap"]).drop("gap", "low").withColumnRenamed("to", "low"), new, done


def sort_edges(edges: DataFrame, kernel: int, node: int = NODE, pivots: int = PIVOTS) -> DataFrame:
    """s, v, ord: the edges of an edge_table(), numbered from 0 in the order of a quicksort by the test, which isn't transitive, so the order depends
    on pivots: of a node's edges the one with the least hash. Nodes of more than `node` edges are split by up to `pivots` pivots
    a pass, in one pass over the edges; smaller ones are finished within tasks. The order is the same at any `node` and `pivots`. The driver holds
    the pivots of a pass and counts between them, never what grows with the edges."""
    kind = dict(edges.dtypes)
    edges = table(edges.withColumn("low", F.lit(0).cast("long")), "edges")
    n = edges.count()
    large = [(0, n, -(1 << 63))] if n > node else []
    small, live = ([], edges) if large else ([edges], None)
    out: list[DataFrame] = []
    while large:
        now, later = large[:pivots], large[pivots:]
        lows = edges.sparkSession.createDataFrame([(x[0],) for x in later], "low long") if later else None
        wait = live.join(F.broadcast(lows), "low", "left_semi") if later else None
        split, new, done = _pass(live.join(F.broadcast(lows), "low", "left_anti") if later else live, now, kernel, pivots)
        if done:
            out.append(edges.sparkSession.createDataFrame(done, f"s {kind['s']}, v {kind['v']}, ord long"))
        grown = [x for x in new if x[1] - x[0] > node]
        if grown:
            still = edges.sparkSession.createDataFrame([(x[0],) for x in grown], "low long")
            small.append(split.join(F.broadcast(still), "low", "left_anti"))
            live = split.join(F.broadcast(still), "low", "left_semi")
            live = live if wait is None else live.unionByName(wait)
        else:
            small.append(split)
            live = wait
        large = later + grown

    schema = T.StructType([edges.schema["s"], edges.schema["v"], T.StructField("ord", T.LongType())])

    def placed(found: pa.Table) -> Iterator[pa.RecordBatch]:
        place, _ = quicksort(found.column("low").to_numpy(), Edges.of(found), kernel)
        yield from pa.table({"s": found.column("s"), "v": found.column("v"), "ord": pa.array(place)}).to_batches()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Whole nodes are sorted together: most are far smaller than a batch.
        held: list[pa.RecordBatch] = []
        for b in batches:
            held += [b] if b.num_rows else []
            if sum(x.num_rows for x in held) < TOGETHER:
                continue
            found = pa.Table.from_batches(held)
            low = found.column("low").to_numpy()
            cut = int(np.searchsorted(low, low[-1]))
            if cut:
                yield from placed(found.slice(0, cut))
                held = found.slice(cut).to_batches()
        if held:
            yield from placed(pa.Table.from_batches(held))

    rest = small[0]
    for x in small[1:]:
        rest = rest.unionByName(x)
    found = rest.repartition("low").sortWithinPartitions("low", "h", "s", "v").mapInArrow(finish, schema)
    for x in out:
        found = found.unionByName(x)
    return found
