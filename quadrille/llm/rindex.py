"""Suffix-array dedup: a run-length index finds long matches in repetitive text.

Every string of MATCH bytes has an anchor, a gram that its own bytes select, so equal strings have equal grams at the
same offset. What a text repeats within itself is settled where the text is read. Of the rest, the stretch of strings around each
anchor is hashed; stretches that agree are settled by their hash, and stretches of one gram that differ are brought together in
batches and indexed. Of a batch the suffix order is sorted whole, so memory follows the bytes of a batch (BATCH, and at most
CROWD stretches more); matches are measured only at the ends of the runs of its Burrows-Wheeler transform, and matching
statistics are streamed from these samples. A corpus has no single index, which would be one task.

Two different stretches of one gram would be taken for equal if their 64-bit hashes agreed, which for a gram with n stretches has
a probability of n * n / 2 ** 65; two grams that agree by chance cost time only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, reclaim, release, row_keys, slices, table

#: Bytes of a match, and of an anchor's gram.
MATCH, GRAM = 400, 32
#: A passage: bytes of strings that are looked for in other texts, and words that a run of them has at least.
PASSAGE, WORDS = 256, 51
#: Stretches that one gram may bring into a batch; bytes of a batch; bytes that are hashed at once.
CROWD, BATCH, CHUNK = 4096, 1 << 17, 1 << 18
#: Pairs of suffixes that are compared at once.
PAIRS = 1 << 15
#: Bytes whose hashes, with what they are made from, stay in a processor's cache.
CACHED = 1 << 14

_RANDOM = np.random.default_rng(20).integers(0, 1 << 63, size=270, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE, _ODD = _RANDOM[:256], _RANDOM[256:]
_LOW = np.uint64(0xFFFFFFFF)


# --- Anchors ---------------------------------------------------------------------------------------------


def gram_hashes(data: np.ndarray, n: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the n bytes from each place on."""
    out = np.empty(len(data) - n + 1, dtype=np.uint64)
    for at in range(0, len(out), CACHED):
        out[at : at + CACHED] = _joined_hashes(data[at : at + CACHED + n - 1], n)
    return out


def _joined_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """gram_hashes() of few bytes: hashes of powers of two are joined."""
    x, size, parts = _BYTE[data], 1, {}
    while 2 * size <= n:
        if n & size:
            parts[size] = x
        y = x[:-size] * _ODD[size.bit_length()]
        y += x[size:]
        x, size = y, 2 * size
    done = size
    for part in sorted(parts, reverse=True):
        left = len(data) - done - part + 1
        y = x[:left] * _ODD[9]
        y += parts[part][done : done + left]
        x, done = y, done + part
    x ^= x >> np.uint64(29)
    x *= _ODD[10]
    x ^= x >> np.uint64(32)
    return x


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of every n neighbours: from the ends and the starts of blocks of n."""
    padded = np.full(-(-len(x) // n) * n, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, n)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = len(x) - n + 1
    return np.minimum(back[:m], ahead[n - 1 : n - 1 + m])


def _select(data: np.ndarray, ends: np.ndarray, match: int) -> list[np.ndarray]:
    """Anchors of texts laid end to end: places, hashes, and the starts of the first and the last string of `match` bytes that
    each is the anchor of. The anchor of a string is its first gram of least hash. No string reaches across an end."""
    if len(data) < match:
        return [np.zeros(0, dtype=t) for t in (np.int64, np.uint64, np.int64, np.int64)]
    grams = gram_hashes(data)
    at = (_sliding_min((grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64), match - GRAM + 1) & _LOW).astype(np.int64)
    for e in ends[:-1]:
        at[max(0, e - match + 1) : e] = -1
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    place = at[first]
    own = place >= 0
    return [x[own] for x in (place, grams[place], first, last)]


def _settle(data: bytes, found: list[np.ndarray], match: int) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
    """What a text repeats within itself: the anchors with the strings that hadn't been there before, and the runs of bytes
    of strings that are there again. Hashes propose, bytes decide."""
    place, grams, first, last = found
    if len(set(grams.tolist())) == len(grams):
        return found, []
    _, group, count = np.unique(grams, return_inverse=True, return_counts=True)
    again = np.flatnonzero(count[group] > 1)
    sizes = (last - first + 1)[again]
    owner = np.repeat(again, sizes)
    start = np.arange(int(sizes.sum())) + np.repeat(first[again] - (np.cumsum(sizes) - sizes), sizes)
    hashes = gram_hashes(np.frombuffer(data, dtype=np.uint8), match)[start]
    order = np.argsort(hashes, kind="stable")
    same = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
    before = np.full(len(start), -1, dtype=np.int64)
    before[order[same + 1]] = start[order[same]]
    later = np.flatnonzero(before >= 0)
    s, f = start[later], before[later]
    cuts = np.flatnonzero(np.concatenate([[True], (np.diff(s) != 1) | (np.diff(f) != 1)])) if len(s) else np.zeros(0, dtype=np.int64)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(s)]):
        n = b - a - 1 + match
        if data[s[a] : s[a] + n] != data[f[a] : f[a] + n]:
            before[later[a:b]] = -1
    later = before >= 0
    found_at = np.zeros(len(data) + 2, dtype=bool)
    found_at[start[later] + 1] = found_at[before[later] + 1] = True
    edges = np.flatnonzero(found_at[1:] != found_at[:-1])
    runs = [(lo, hi - 1 + match) for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist())]
    new = np.flatnonzero(~later)
    kept, at = np.unique(owner[new], return_index=True)
    first, last = first.copy(), last.copy()
    first[kept], last[kept] = start[new[at]], start[new[np.concatenate([at[1:], [len(new)]]) - 1]]
    stay = np.ones(len(place), dtype=bool)
    stay[again] = False
    stay[kept] = True
    return [x[stay] for x in (place, grams, first, last)], runs


def anchors(texts: list[bytes], match: int = MATCH) -> Iterator[tuple[int, list[np.ndarray], list[tuple[int, int]]]]:
    """(index, anchors, repeated runs) for texts of `match` bytes or more. Short ones are hashed together. A long one is cut into
    pieces of CHUNK strings, so that memory follows CHUNK; a string is in one piece only."""
    group: list[int] = []
    size = 0

    def flush() -> Iterator[tuple[int, list[np.ndarray], list[tuple[int, int]]]]:
        ends = np.cumsum([len(texts[i]) for i in group])
        found = _select(np.frombuffer(b"".join([texts[i] for i in group]), dtype=np.uint8), ends, match)
        cuts = [0, *np.searchsorted(found[0], ends).tolist()]
        for k, i in enumerate(group):
            begin = ends[k] - len(texts[i])
            own = [x[cuts[k] : cuts[k + 1]] for x in found]
            yield i, *_settle(texts[i], [own[0] - begin, own[1], own[2] - begin, own[3] - begin], match)

    for i, text in enumerate(texts):
        if len(text) < match:
            continue
        if len(text) > CHUNK:
            for start in range(0, len(text) - match + 1, CHUNK):
                piece = text[start : start + CHUNK + match - 1]
                (place, grams, first, last), runs = _settle(piece, _select(np.frombuffer(piece, dtype=np.uint8), np.array([len(piece)]), match), match)
                yield i, [place + start, grams, first + start, last + start], [(lo + start, hi + start) for lo, hi in runs]
            continue
        group.append(i)
        size += len(text)
        if size >= CACHED:
            yield from flush()
            group, size = [], 0
    if group:
        yield from flush()


MARK, PIECE = "k1 long, k2 long, lo int, hi int", "file long, k1 long, k2 long, lo int, at int, data binary, m long"
OCCURRENCE = "k1 long, k2 long, gram long, around long, place int, lo int, hi int"


def _occurrences(batches: Iterator[pa.RecordBatch], match: int) -> Iterator[pa.RecordBatch]:
    """For each anchor: its text's key, its gram, where the stretch of its strings is, and a hash of that. Rows without
    a gram are runs that a text repeats within itself."""
    names = [c.split()[0] for c in OCCURRENCE.split(", ")]
    digest = xxhash.xxh3_64_intdigest

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*rows)]
        none = columns[4] < 0
        return pa.RecordBatch.from_arrays([pa.array(c, mask=none if n == "gram" else None) for n, c in zip(names, columns)], names)

    for batch in slices(batches):
        texts = [t.as_py() or b"" for t in batch.column(2).cast(pa.binary())]
        k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
        rows, held = [], 0
        for i, (place, grams, first, last), runs in anchors(texts, match):
            text, hi = texts[i], last + match
            around = [digest(text[a:b], p - a) for a, b, p in zip(first.tolist(), hi.tolist(), place.tolist())]
            lo, end = np.array(runs, dtype=np.int64).reshape(-1, 2).T
            n, zero = len(place) + len(runs), np.zeros(len(runs), dtype=np.int64)
            rows.append((
                np.full(n, k1[i]), np.full(n, k2[i]), np.concatenate([grams.view(np.int64), zero]), np.concatenate([np.array(around, dtype=np.uint64).view(np.int64), zero]),
                np.concatenate([place, zero - 1]).astype(np.int32), np.concatenate([first, lo]).astype(np.int32), np.concatenate([hi, end]).astype(np.int32),
            ))
            held += n
            if held > 1 << 16:
                yield flush(rows)
                rows, held = [], 0
        if rows:
            yield flush(rows)


# --- The index of a batch --------------------------------------------------------------------------------


def suffix_order(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Places of text in the order of their suffixes. Symbol 0 ends a segment; no two ends are alike, the earlier
    is less. left: symbols up to the segment's end. Prefix doubling from 7 symbols; only open groups are sorted again."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, dtype=text.dtype)])
    key = np.zeros(n, dtype=np.int64)
    for j in range(7):
        key <<= 9
        key |= np.where(left >= j, padded[j : n + j], 0)
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    del key
    rank = np.empty(n, dtype=np.int32)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n, dtype=np.int32), 0))
    depth, longest = 7, int(left.max(initial=0))
    while depth <= longest:
        shared = np.concatenate([first[1:], [True]])
        slots = np.flatnonzero(~(first & shared))
        slots = slots[left[order[slots]] >= depth]
        if not len(slots):
            break
        at = order[slots]
        pair = (rank[at].astype(np.int64) << 32) | rank[np.minimum(at + depth, n - 1)]
        again = np.argsort(pair, kind="stable")
        at, pair = at[again], pair[again]
        order[slots] = at
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        first[slots] = new
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0)).astype(np.int32)
        depth *= 2
    return order


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, within their segments; PAIRS of them are compared at once."""
    out, step, last = np.zeros(len(a), dtype=np.int64), np.arange(32), len(text)
    padded = np.concatenate([text, np.zeros(64, dtype=text.dtype)])
    for low in range(0, len(a), PAIRS):
        alive = np.arange(low, min(low + PAIRS, len(a)))
        while len(alive):
            x = padded[np.minimum(a[alive] + out[alive], last)[:, None] + step]
            y = padded[np.minimum(b[alive] + out[alive], last)[:, None] + step]
            same = (x == y) & (x != 0)
            whole = same.all(axis=1)
            out[alive] += np.where(whole, 32, same.argmin(axis=1))
            alive = alive[whole]
    return out


def matching_statistics(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """For each place, the longest string from there that also starts at another place of the text.

    Neighbours in suffix order hold it. Where the transform has the same symbol as before, a place's match with its
    neighbour is its predecessor's less one; so it is measured at the starts of runs (for the neighbour before) and at
    their ends (for the neighbour after), and streamed along the text from there. Ends of segments are runs of one.
    """
    order = suffix_order(text, left)
    n = len(text)
    before = text[order - 1]
    starts = np.concatenate([[True], (before[1:] != before[:-1]) | (before[1:] == 0)])
    ends = np.concatenate([starts[1:], [True]])
    out = np.zeros(n, dtype=np.int32)
    for sampled, to in ((np.flatnonzero(starts), -1), (np.flatnonzero(ends), 1)):
        inside = (sampled + to >= 0) & (sampled + to < n)
        at = order[sampled]
        value = np.zeros(len(at), dtype=np.int64)
        value[inside] = _common(text, at[inside], order[sampled[inside] + to])
        reach = np.zeros(n, dtype=np.int32)
        reach[at] = value + at
        out = np.maximum(out, np.maximum.accumulate(reach) - np.arange(n, dtype=np.int32))
    return out


def repeats(pieces: list[tuple[object, int, bytes]], match: int | None = None) -> list[tuple[object, int, int]]:
    """(key, start, end) of runs of bytes covered by strings of `match` bytes (MATCH) that start at two places of the pieces
    (key of a text, place in it, bytes). Pieces of one text that overlap are one segment: a place is there once."""
    match = match or MATCH
    segments: list[list] = []
    for key, lo, data in sorted(pieces, key=lambda p: (p[0], p[1], -len(p[2]))):
        if segments and segments[-1][0] == key and lo <= segments[-1][1] + len(segments[-1][2]):
            have = segments[-1][1] + len(segments[-1][2]) - lo
            segments[-1][2] += data[max(0, have) :] if have < len(data) else b""
        else:
            segments.append([key, lo, bytearray(data)])
    sizes = np.array([len(s[2]) for s in segments], dtype=np.int64)
    text = np.zeros(int(sizes.sum()) + len(segments), dtype=np.uint16)
    left = np.empty(len(text), dtype=np.int32)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    for (_, _, data), at in zip(segments, begin):
        text[at : at + len(data)] = np.frombuffer(bytes(data), dtype=np.uint8)
        text[at : at + len(data)] += 1
        left[at : at + len(data) + 1] = np.arange(len(data), -1, -1)
    found = np.concatenate([[False], matching_statistics(text, left) >= match, [False]])
    edges = np.flatnonzero(found[1:] != found[:-1])
    out = []
    for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
        k = int(np.searchsorted(begin, s, side="right")) - 1
        key, lo, _ = segments[k]
        out.append((key, lo + s - int(begin[k]), lo + e - 1 + match - int(begin[k])))
    return out


def _index(batches: Iterator[pa.RecordBatch], match: int) -> Iterator[pa.RecordBatch]:
    """Marks from rows (file, k1, k2, lo, data) in the order of file; a batch holds whole files."""
    held: list[tuple] = []
    size, last = 0, None

    def marks() -> pa.RecordBatch:
        found = repeats(held, match)
        columns = [[k[0] for k, _, _ in found], [k[1] for k, _, _ in found], [s for _, s, _ in found], [e for _, _, e in found]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["k1", "k2", "lo", "hi"])

    for batch in batches:
        for file, k1, k2, lo, data in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if file != last and size >= BATCH:
                yield marks()
                held, size = [], 0
            held.append(((k1, k2), lo, data))
            size, last = size + len(data), file
    if held:
        yield marks()


# --- The distributed part --------------------------------------------------------------------------------


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, k1, k2, lo, at, data, m) for the wanted stretches of each text."""
    for batch in slices(batches, 100):
        rows: list[tuple] = []
        size = 0
        texts = batch.column(2).cast(pa.binary())
        for i, wanted in enumerate(batch.column(3).to_pylist()):
            text, k1, k2 = texts[i].as_py(), batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            for w in wanted:
                rows.append((w["gram"], k1, k2, w["lo"], w["place"] - w["lo"], text[w["lo"] : w["hi"]], w["m"]))
                size += w["hi"] - w["lo"]
            if size > 1 << 22:
                yield _cut_batch(rows)
                rows, size = [], 0
        if rows:
            yield _cut_batch(rows)


def _cut_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["file", "k1", "k2", "lo", "at", "data", "m"])


def _split(pieces: DataFrame, match: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(pieces by file, with no crowded file; marks found on the way) of the pieces of crowded files.

    A crowded file is split by what stands next to the gram. Two pieces that match with the gram at one place of `match`
    bytes share, of the bytes still open, at least half on its left or half on its right. So each piece goes to the file of
    its left half and to that of its right half. What is shared on one side bounds how far a match reaches on the other,
    so pieces get shorter; those that are now equal are settled, one of them stays for the others. At `match` bytes all pieces of a
    file are equal. No match is lost, and pieces that share a gram by chance part at once.
    """
    around = match - GRAM
    whole: list[DataFrame] = []
    marks: list[DataFrame] = []
    level = pieces.withColumn("l", F.lit(0)).withColumn("r", F.lit(0))
    while level.limit(1).count():
        half = F.ceil((F.lit(around) - F.col("l") - F.col("r")) / 2).cast("int")
        sides = F.array(F.struct((F.col("l") + F.col("half")).alias("l"), F.col("r").alias("r")), F.struct(F.col("l").alias("l"), (F.col("r") + F.col("half")).alias("r")))
        after = F.octet_length("data") - F.col("at") - GRAM
        both = level.withColumn("half", half).select("file", "k1", "k2", "lo", "at", "data", F.explode(sides).alias("side")).where((F.col("at") >= F.col("side.l")) & (after >= F.col("side.r")))
        both = both.withColumn("left", F.least(F.col("at"), F.lit(around) - F.col("side.r"))).withColumn("right", F.least(after, F.lit(around) - F.col("side.l"))).where(F.col("left") + F.col("right") >= around)
        shared = F.substring("data", F.col("at") - F.col("side.l") + 1, F.col("side.l") + F.col("side.r") + GRAM)
        data = F.substring("data", F.col("at") - F.col("left") + 1, F.col("left") + F.col("right") + GRAM)
        hot = both.select(F.xxhash64("file", "side.l", "side.r", shared).alias("file"), "k1", "k2", (F.col("lo") + F.col("at") - F.col("left")).alias("lo"), F.col("left").alias("at"), data.alias("data"), F.col("side.l").alias("l"), F.col("side.r").alias("r"))
        hot = table(hot.withColumn("around", F.xxhash64("data", "at")).withColumn("hi", F.col("lo") + F.octet_length("data")), "split")
        classes = table(hot.groupBy("file", "around").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "lo")).alias("one")).select("file", "around", "n", "one.*"), "classes")
        marks.append(hot.join(classes.where("n > 1").select("file", "around"), ["file", "around"], "left_semi").select("k1", "k2", "lo", "hi"))
        still = table(classes.groupBy("file").agg(F.count("*").alias("m"), F.min("n").alias("n")).where("m > 1 AND n = 1").select("file", "m"), "open")
        # The one join that moves bytes: of each class that is still open one piece.
        one = table(hot.join(classes.drop("n").join(still, "file"), ["file", "around", "k1", "k2", "lo"]).select(*pieces.columns, "l", "r", "m"), "level")
        whole.append(one.where(F.col("m") <= CROWD).select(*pieces.columns))
        level = one.where(F.col("m") > CROWD).drop("m")
    return whole, marks


def find_repeats(docs: DataFrame, match: int = MATCH) -> DataFrame:
    """Marks (k1, k2, lo, hi, own) of the texts in docs (k1, k2, text): together they cover exactly the bytes
    of strings of `match` bytes that start at two places; own: of what is there again in the text itself
    (in the same CHUNK of it). Marks overlap."""
    found = table(docs.mapInArrow(lambda batches: _occurrences(batches, match), OCCURRENCE), "anchors")
    every = found.where("gram IS NOT NULL")
    # Stretches that agree are a class. In a class of two or more all strings repeat.
    classes = table(every.groupBy("gram", "around").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "place", "lo", "hi")).alias("one")), "classes")
    reclaim(docs.sparkSession)
    sure = every.join(classes.where("n > 1").select("gram", "around"), ["gram", "around"], "left_semi").select("k1", "k2", "lo", "hi")
    sure = sure.withColumn("own", F.lit(False)).unionByName(found.where("gram IS NULL").select("k1", "k2", "lo", "hi", F.lit(True).alias("own")))
    sure = table(sure, "sure")
    release(found)
    # Of grams with a class of one and another class, one member of each class goes to the index.
    # They are a table, so that the join below reads two plain shuffles and Spark can split the classes of a hot gram.
    still = table(classes.groupBy("gram").agg(F.count("*").alias("m"), F.min("n").alias("n")).where("m > 1 AND n = 1").select("gram", "m"), "still")
    wanted = table(classes.join(still, "gram").select("one.*", "gram", "m"), "wanted")
    release(classes)
    reclaim(docs.sparkSession)
    # Of rows that agree in everything, which share a key, each brings its pieces; they become one segment.
    wanted = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("gram", "place", "lo", "hi", "m")).alias("wanted"))
    pieces = table(docs.join(wanted, ["k1", "k2"]).select("k1", "k2", "text", "wanted").mapInArrow(_cut, PIECE), "pieces")
    reclaim(docs.sparkSession)
    parts, marks = [pieces.where(F.col("m") <= CROWD).drop("m")], []
    crowded = pieces.where(F.col("m") > CROWD).drop("m")
    if crowded.limit(1).count():
        more, marks = _split(crowded, match)
        parts += more
    found = [p.select("file", "k1", "k2", "lo", "data").repartition("file").sortWithinPartitions("file").mapInArrow(lambda batches: _index(batches, match), MARK) for p in parts]
    out = sure
    for x in [*found, *marks]:
        out = out.unionByName(x.withColumn("own", F.lit(False)))
    return out


def _runs(marks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the runs that marks (lists of lo, hi) make where they touch or overlap, in order."""
    inner = marks.flatten()
    base = marks.value_parent_indices().to_numpy().astype(np.int64) << 32
    lo, hi = (base + inner.field(c).to_numpy() for c in ("lo", "hi"))
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    first = np.ones(len(lo), dtype=bool)
    first[1:] = lo[1:] > hi[:-1]
    last = np.append(first[1:], True) if len(lo) else first
    return lo[first] >> 32, lo[first] & 0xFFFFFFFF, hi[last] & 0xFFFFFFFF


def _whole_words(text: bytes, lo: int, hi: int) -> int:
    """Words of text[lo:hi], without those that go on beyond its ends."""
    run = text[lo:hi]
    cut = sum(0 < at < len(text) and len(b" ".join(text[at - 1 : at + 1].split())) == 2 for at in (lo, hi))
    return len(run.split()) - cut


def _spans(rows: int, row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """Lists of (lo, hi) by row."""
    entry = pa.StructArray.from_arrays([pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["lo", "hi"])
    return pa.ListArray.from_arrays(np.append(0, np.cumsum(np.bincount(row, minlength=rows))).astype(np.int32), entry)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = [t.as_py() or b"" for t in batch.column(1).cast(pa.binary())]
        n = len(texts)
        spans, shared = _runs(batch.column(2)), _runs(batch.column(3))
        long = np.array([_whole_words(texts[i], lo, hi) >= WORDS for i, lo, hi in zip(*(x.tolist() for x in shared))], dtype=bool)
        cuts = np.searchsorted(spans[0], np.arange(n + 1)).tolist()
        kept = []
        for i, data in enumerate(texts):
            own = slice(cuts[i], cuts[i + 1])
            starts, ends = [0, *spans[2][own].tolist()], [*spans[1][own].tolist(), len(data)]
            kept.append(b"".join(data[a:b] for a, b in zip(starts, ends)))
        passages = _spans(n, *(x[long] for x in shared))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(kept, pa.binary()), _spans(n, *spans), passages], ["doc_id", "n_bytes", "kept", "spans", "passages"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k1, k2, text, marks) to (k1, k2, at, text): the runs of marks that hold MATCH bytes or more, and where they start."""
    for batch in slices(batches, 100):
        row, lo, hi = _runs(batch.column(3))
        own = hi - lo >= MATCH
        if own.any():
            row, lo, hi = row[own], lo[own], hi[own]
            text = [batch.column(2)[i].as_buffer()[a:b].to_pybytes() for i, a, b in zip(row.tolist(), lo.tolist(), hi.tolist())]
            keys = [batch.column(k).take(pa.array(row)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(lo, pa.int32()), pa.array(text, pa.binary())], ["k1", "k2", "at", "text"])


def find_in_runs(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """find_repeats() for MATCH bytes, where runs (k1, k2, lo, hi) mark what shorter strings repeat: a longer string that repeats lies in one
    run, so only runs of MATCH bytes or more are read, each as a text of its own."""
    marks = runs.groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("marks"))
    cut = docs.join(marks, ["k1", "k2"]).select("k1", "k2", F.encode("text", "UTF-8").alias("text"), "marks")
    cut = cut.mapInArrow(_segments, "k1 long, k2 long, at int, text binary")
    segments = table(cut.select("*", *[k.alias(f"s{n}") for n, k in enumerate(row_keys("k1", "k2", "at"), 1)]), "segments")
    reclaim(docs.sparkSession)
    found = find_repeats(segments.select(F.col("s1").alias("k1"), F.col("s2").alias("k2"), "text"))
    whose = segments.select("k1", "k2", "at", "s1", "s2").distinct()
    found = found.select(F.col("k1").alias("s1"), F.col("k2").alias("s2"), "lo", "hi").join(whose, ["s1", "s2"])
    return found.select("k1", "k2", (F.col("lo") + F.col("at")).alias("lo"), (F.col("hi") + F.col("at")).alias("hi"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, kept (the remaining bytes), spans (removed runs), passages of every row of docs (doc_id, text).

    A null text counts as empty. Texts under MATCH bytes lose nothing. Rows that agree in everything repeat
    each other, so each of them loses all its strings of MATCH bytes. A removed run may end within a
    character, which is why kept is binary. passages are runs of WORDS whole words or more, of strings of
    PASSAGE bytes that other texts have too; they stay where no string of MATCH bytes takes them. Rows are told apart by two 64-bit
    hashes of id and text.
    """
    rows = docs.select("doc_id", "text", *row_keys("doc_id", "text"))
    keyed = rows.select("k1", "k2", "text")
    short = table(find_repeats(keyed, PASSAGE), "marks")
    reclaim(docs.sparkSession)
    marks = table(find_in_runs(keyed, short.drop("own")), "marks").withColumn("removed", F.lit(True))
    marks = marks.unionByName(short.where("NOT own").drop("own").withColumn("removed", F.lit(False)))
    reclaim(docs.sparkSession)
    place = F.struct("lo", "hi")
    marks = marks.groupBy("k1", "k2").agg(F.collect_set(F.when(F.col("removed"), place)).alias("marks"), F.collect_set(F.when(~F.col("removed"), place)).alias("shared"))
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("n_bytes long, kept binary, spans array<struct<lo:int,hi:int>>, passages array<struct<lo:int,hi:int>>").fields])
    return rows.join(marks, ["k1", "k2"], "left").select("doc_id", "text", "marks", "shared").mapInArrow(_remove, schema)


def op10_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.size("passages").cast("long").alias("n_passages"))
