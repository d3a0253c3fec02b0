"""Cross-tokenizer alignment: where two tokenizers cut the same bytes alike, and which of their ids go together.

Tokens of a whole batch of texts are laid end to end with the byte offsets of the texts. The ends of A's and of B's tokens are
counted at their offsets once; a cut is where both occur, a link (two tokens that share bytes) ends where either occurs, and prefix
sums over the batch, taken at the texts' ends, give what each text has.

Texts are encoded by units: neither tokenizer joins a character that isn't white space with a space behind it, so a text is cut there,
each different unit is encoded once and kept, and long texts go through in parts.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, slices, table

#: Files of the two tokenizers.
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of texts that are aligned at once; tokens that a worker keeps; pairs of ids that are summed in a worker.
BATCH, KEPT, SUMMED = 1 << 20, 1 << 21, 1 << 19
#: Pairs of ids whose counts travel to tasks at once, at 17 bytes each.
BROADCAST = 1 << 22
#: A unit: spaces, then everything up to a space that follows something else than white space.
UNIT = re.compile(r" +(?:[^ ]*+(?<=[^\S ]) +)*[^ ]*")


def byte_alphabet() -> dict[str, int]:
    """What a byte-level tokenizer writes for each byte: visible Latin-1 characters for themselves, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokenizers:
    """A and B, and what they made of the units seen so far."""

    def __init__(self, a: str, b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        words = {i: w for w, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [bytes(alphabet[c] for c in words.get(i, "") if c in alphabet) for i in range(max(words) + 1)]
        pieces = map(self.b.id_to_piece, range(self.b.get_piece_size()))
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.space = self.b.piece_to_id("▁")
        self.a_size, self.b_size = (np.array([len(x) for x in y], dtype=np.int32) for y in (self.a_bytes, self.b_bytes))
        #: An id in decimals with what may follow it: A's in rows , and |, B's in rows , and ;
        marks = [f"{i}{c}".encode() for n, cs in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for c in cs for i in range(n)]
        self.marks = np.array([*marks, None], dtype=object)[:-1]
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.good, self.used = np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int64)
        self.a_ids, self.b_ids = (np.zeros(0, dtype=np.int32) for _ in "ab")
        self.a_from, self.b_from = (np.zeros(1, dtype=np.int64) for _ in "ab")

    def forget(self) -> None:
        """Where more than KEPT tokens are kept: drop the units that were met once since the last time, and all if the rest still holds more
        than half of KEPT."""
        if len(self.a_ids) + len(self.b_ids) <= KEPT:
            return
        units, again = list(self.at), np.flatnonzero(self.used > 1)
        n = [np.diff(start)[again] for start in (self.a_from, self.b_from)]
        if n[0].sum() + n[1].sum() > KEPT // 2:
            self.clear()
            return
        self.a_ids, self.b_ids = _spread(self.a_ids, self.a_from, again), _spread(self.b_ids, self.b_from, again)
        self.a_from, self.b_from = (np.append(0, np.cumsum(x)) for x in n)
        self.good, self.used = self.good[again], np.zeros(len(again), dtype=np.int64)
        self.at = {units[x]: place for place, x in enumerate(again.tolist())}

    def learn(self, units: list[str]) -> None:
        """Encode units that are new."""
        ours = [x.ids for x in self.a.encode_batch_fast(units, add_special_tokens=False)]
        theirs = [x if u != " " else [self.space] for u, x in zip(units, self.b.encode([u[1:] for u in units], num_threads=1))]
        whole = [u.encode() for u in units]
        good = np.ones(len(units), dtype=bool)
        found = []
        for ids, names, sizes in ((ours, self.a_bytes, self.a_size), (theirs, self.b_bytes, self.b_size)):
            counts = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            ends = np.cumsum(counts)
            found.append((np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(counts.sum())), ends))
            good &= self._given_back(*found[-1], names, sizes, whole)
        (a, a_ends), (b, b_ends) = found
        self.a_from, self.b_from = np.append(self.a_from, a_ends + self.a_from[-1]), np.append(self.b_from, b_ends + self.b_from[-1])
        self.a_ids, self.b_ids = np.append(self.a_ids, a), np.append(self.b_ids, b)
        self.at.update(zip(units, range(len(self.good), len(self.good) + len(units))))
        self.good, self.used = np.append(self.good, good), np.append(self.used, np.zeros(len(units), dtype=np.int64))

    @staticmethod
    def _given_back(ids: np.ndarray, ends: np.ndarray, names: list[bytes], sizes: np.ndarray, whole: list[bytes]) -> np.ndarray:
        """Whether the bytes of each unit's tokens are those of the unit: all of them at once, or one by one where they differ somewhere."""
        bytes_of = [names[i] for i in ids.tolist()]
        total = np.append(0, np.cumsum(sizes[ids], dtype=np.int64))[np.append(0, ends)]
        if (np.diff(total) == np.fromiter(map(len, whole), dtype=np.int64, count=len(whole))).all() and b"".join(bytes_of) == b"".join(whole):
            return np.ones(len(whole), dtype=bool)
        at = [0, *ends.tolist()]
        return np.array([b"".join(bytes_of[x:y]) == w for x, y, w in zip(at, at[1:], whole)], dtype=bool)

    def places(self, units: list[str]) -> np.ndarray:
        """The units' numbers; new ones are encoded first."""
        if new := [u for u in dict.fromkeys(units) if u not in self.at]:
            self.learn(new)
        at = np.fromiter(map(self.at.__getitem__, units), dtype=np.int64, count=len(units))
        self.used += np.bincount(at, minlength=len(self.used))
        return at

    def tokens(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A's ids and B's ids of units by their numbers."""
        return _spread(self.a_ids, self.a_from, places), _spread(self.b_ids, self.b_from, places)


@lru_cache(1)
def loaded(a: str, b: str) -> Tokenizers:
    """The tokenizers of two files, with what they have encoded, for all tasks of a worker."""
    return Tokenizers(a, b)


def _spread(flat: np.ndarray, start: np.ndarray, at: np.ndarray) -> np.ndarray:
    """flat[start[x] : start[x + 1]] for all x of at, end to end."""
    n = start[at + 1] - start[at]
    return flat[np.repeat(start[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def align(a_ends: np.ndarray, b_ends: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts whose ends and whose tokens' ends are byte offsets in one batch: (n_a, n_b, n_groups, n_links of each text as rows; group of
    each A token; group of each B token; A token and B token of each link). The last token of both ends a text."""
    n = int(ends[-1]) if len(ends) else 0
    found = np.bincount(np.concatenate([a_ends - 1, b_ends - 1 + n]), minlength=2 * n).astype(bool)
    a, b = found[:n], found[n:]
    cut, link = a & b, a | b
    before = [np.cumsum(x, dtype=np.int32) for x in (a, b, cut, link)]
    totals = np.diff(np.stack([x[ends - 1] for x in before]), axis=1, prepend=0)
    a_group, b_group = (before[2][x - 1] - cut[x - 1] for x in (a_ends, b_ends))
    at = np.flatnonzero(link)
    return totals, a_group, b_group, before[0][at] - a[at], before[1][at] - b[at]


def written(t: Tokenizers, a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The ids of all groups in order, with what follows each, and the group of each."""
    groups = np.concatenate([2 * a_group, 2 * b_group + 1])
    order = np.argsort(groups, kind="stable")
    groups = groups[order]
    last = np.append(groups[1:] != groups[:-1], True)
    base = np.concatenate([a, b + np.int32(2 * len(t.a_bytes))])[order]
    step = np.where(groups % 2 == 0, len(t.a_bytes), len(t.b_bytes))
    return t.marks[base + last * step].tolist(), groups // 2


class Text:
    """What is known of a text so far."""

    __slots__ = ("key", "totals", "digest", "pairs", "times", "good", "open")

    def __init__(self, key: object) -> None:
        self.key, self.totals, self.digest, self.pairs, self.times, self.good, self.open = key, np.zeros(4, dtype=np.int64), None, [], [], True, True

    def add(self, totals: np.ndarray, marks: list[bytes], pairs: np.ndarray, times: np.ndarray) -> None:
        self.totals += totals
        if self.digest is None:
            self.digest = hashlib.sha256()
        else:
            self.digest.update(b";")
        self.digest.update(b"".join(marks)[:-1])
        self.pairs.append(pairs)
        self.times.append(times)

    def row(self) -> tuple:
        if not self.good or self.digest is None:
            none = np.zeros(0, dtype=np.int64)
            return self.key, 0, 0, 0, 0, "", none, none
        return self.key, *self.totals.tolist(), self.digest.hexdigest(), *merged(self.pairs, self.times)


def merged(pairs: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs in order, and how often each is there."""
    if len(pairs) == 1:
        return pairs[0], times[0]
    key, at = np.unique(np.concatenate(pairs), return_inverse=True)
    return key, np.bincount(at, weights=np.concatenate(times), minlength=len(key)).astype(np.int64)


def parts(text: str) -> Iterator[tuple[list[str], int]]:
    """The units of a space and the text, in lists of about BATCH bytes or of one longer unit, with their bytes."""
    if len(text) < BATCH // 4:
        yield UNIT.findall(" " + text), len(text.encode()) + 1
        return
    units, size = [], 0
    for m in UNIT.finditer(" " + text):
        units.append(m.group())
        size += len(units[-1]) if units[-1].isascii() else len(units[-1].encode())
        if size >= BATCH:
            yield units, size
            units, size = [], 0
    if units:
        yield units, size


def align_parts(t: Tokenizers, held: list[tuple[Text, list[str], int]]) -> None:
    """Align parts of texts as one batch, and add what is found to their texts."""
    t.forget()
    places = t.places([u for _, units, _ in held for u in units])
    edges = np.cumsum([0, *[len(units) for _, units, _ in held]])
    good = np.add.reduceat(~t.good[places], edges[:-1]) == 0
    for ok, (text, _, _) in zip(good, held):
        text.good &= bool(ok)
    own = [k for k, ok in enumerate(good) if ok]
    if not own:
        return
    a, b = t.tokens(np.concatenate([places[edges[k] : edges[k + 1]] for k in own]))
    ends = np.cumsum([held[k][2] for k in own])
    totals, a_group, b_group, la, lb = align(np.cumsum(t.a_size[a], dtype=np.int64), np.cumsum(t.b_size[b], dtype=np.int64), ends)
    marks, group = written(t, a, b, a_group, b_group)
    mark_ends = np.searchsorted(group, np.cumsum(totals[2])).tolist()
    links = np.repeat(np.arange(len(own), dtype=np.int64), totals[3])
    space = len(t.a_bytes) * len(t.b_bytes)
    keys, times = np.unique(links * space + a[la].astype(np.int64) * len(t.b_bytes) + b[lb], return_counts=True)
    key_ends = np.searchsorted(keys, np.arange(1, len(own) + 1, dtype=np.int64) * space).tolist()
    for n, k in enumerate(own):
        m, p = (slice(x[n - 1] if n else 0, x[n]) for x in (mark_ends, key_ends))
        held[k][0].add(totals[:, n], marks[m], keys[p] - n * space, times[p])


ROW = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def _encode(a: str, b: str, kind: pa.DataType):
    """Rows of (doc_id, text) to rows of ROW, and rows without n_a that hold sums of pairs over texts."""

    def lists(values: list[np.ndarray]) -> pa.Array:
        return pa.ListArray.from_arrays(np.cumsum([0, *map(len, values)]).astype(np.int32), np.concatenate(values))

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        columns = [*zip(*rows)]
        arrays = [pa.array(columns[0], kind), *[pa.array(c, pa.int64()) for c in columns[1:5]], pa.array(columns[5], pa.string()), lists(columns[6]), lists(columns[7])]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", *[c.split()[0] for c in ROW.split(", ")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = loaded(a, b)
        held, open_texts, size = [], [], 0
        pairs: list[np.ndarray] = []
        times: list[np.ndarray] = []

        def sums(limit: int) -> Iterator[pa.RecordBatch]:
            """The pairs of finished texts, summed when there are many; given out beyond `limit`."""
            nonlocal pairs, times
            if sum(map(len, pairs)) < limit:
                return
            key, n = merged(pairs, times)
            if len(key) < limit // 2:
                pairs, times = [key], [n]
                return
            for at in range(0, len(key), 1 << 16):
                yield flush([(None, None, None, None, None, None, key[at : at + (1 << 16)], n[at : at + (1 << 16)])])
            pairs, times = [], []

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal held, open_texts, size
            if held:
                align_parts(t, held)
            held, size = [], 0
            rows = [x.row() for x in open_texts if not x.open]
            open_texts = [x for x in open_texts if x.open]
            if rows:
                pairs.extend(r[6] for r in rows if len(r[6]))
                times.extend(r[7] for r in rows if len(r[6]))
                yield flush(rows)
                yield from sums(2 * SUMMED)

        for batch in slices(batches):
            for key, value in zip(batch.column(0), batch.column(1)):
                text = Text(key.as_py())
                open_texts.append(text)
                raw = value.as_py()
                for units, n in parts(raw) if raw else ():
                    held.append((text, units, n))
                    size += n
                    if size >= BATCH:
                        yield from done()
                text.open = False
            if len(open_texts) > 2000:
                yield from done()
        yield from done()
        if pairs:
            yield from sums(0)

    return run


def pair_counts(encoded: DataFrame) -> DataFrame:
    """pair, n: how many links hold each pair of ids."""
    both = encoded.where("n_a IS NULL").select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
    return both.groupBy("pair").agg(F.sum("n").alias("n"))


def with_counts(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """rows (with pairs, times) with n_best and count_sum raised by what counts (pair, n, best), which travel to the tasks, say of their pairs."""
    spark = rows.sparkSession
    found = counts.orderBy("pair").toArrow()
    known = spark.sparkContext.broadcast(tuple(found.column(c).to_numpy() for c in ("pair", "n", "best")))
    place = {c: i for i, c in enumerate(rows.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded.cache_clear()
        pair, n, best = known.value
        for b in batches:
            key, times = (b.column(place[c]).flatten().to_numpy() for c in ("pairs", "times"))
            ends = np.cumsum(b.column(place["pairs"]).value_lengths().to_numpy())
            at = np.searchsorted(pair, key)
            hit = np.flatnonzero(pair[np.minimum(at, len(pair) - 1)] == key) if len(pair) else np.zeros(0, dtype=np.int64)
            columns = list(b.columns)
            for name, value in (("n_best", best), ("count_sum", n)):
                more = np.zeros(len(key), dtype=np.int64)
                more[hit] = times[hit] * value[at[hit]]
                total = np.append(0, np.cumsum(more))[np.append(0, ends)]
                columns[place[name]] = pa.array(b.column(place[name]).to_numpy() + np.diff(total))
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return rows.mapInArrow(run, rows.schema)


def align_documents(docs: DataFrame, a: str, b: str, broadcast: int = BROADCAST) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs (doc_id, text), with A a byte-level BPE
    (file a) and B a piece BPE with byte fallback (file b).

    A text that is null, empty, or not given back by the tokens' bytes has no tokens: zeros and an empty digest, and no part in the
    counts. Each row counts, rows of one doc_id or text as often as they are there. Ties for a B id's highest count are all best. An empty table gives
    an empty result; other columns are left out. Texts are read once and not shuffled: of each row its different pairs are kept. Counts of up to
    `broadcast` pairs travel to the tasks; more come in blocks of a hash of the pair, one pass over the rows each. Memory: BATCH bytes, KEPT
    tokens, and one unit a task; a unit is as long as a text goes on without spaces.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"]
    schema = T.StructType([T.StructField("doc_id", kind.dataType), *T._parse_datatype_string(ROW).fields])
    encoded = table(docs.select("doc_id", "text").mapInArrow(_encode(a, b, to_arrow_type(kind.dataType)), schema), "encoded")
    counts = pair_counts(encoded)
    size = _pieces(b)
    top = counts.groupBy((F.col("pair") % size).alias("b")).agg(F.max("n").alias("top"))
    counts = counts.join(top, F.col("pair") % size == F.col("b")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    counts = table(counts, "pairs")
    blocks = max(1, -(-counts.count() // broadcast))
    rows = encoded.where("n_a IS NOT NULL").withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    for k in range(blocks):
        rows = with_counts(rows if k == 0 else table(rows, "counted"), counts.where(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == k))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _pieces(b: str) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=b).get_piece_size()


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_documents(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE))
