"""Packing: token ids into fixed windows by bounded-space best fit."""

from __future__ import annotations

import json
import os
import struct
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, slices, table, text_parts

WINDOW, END_ID, TOKENIZER = 2048, 1, "word_bpe_49k.json"
#: Open windows of a partition; partitions whose leftovers are merged together.
OPEN, MERGED = 64, 64
#: A leftover window with at most this many free places stays as it is.
SLACK = 32
#: Bounds of a worker's memory: words whose ids are kept in each of two generations, the longest of them, units encoded at once, bytes of ids
#: to a batch.
KEPT, LONGEST, UNITS, BATCH = 1 << 18, 48, 4096, 1 << 22


class WordIds:
    """Token ids of a text from those of its white-space separated words, which are kept by word.

    The tokenizer folds white space and never lets a token cross it, so a text's ids are its words' ids in turn, and a stop or
    comma after a letter may as well stand alone. Words repeat, so most are looked up. New words of Latin letters, digits and
    signs are cut by the tokenizer's own pattern into units, which its model encodes together, separated by spaces: the last id of
    each unit, and no other, is that of a word's end. Any other word is encoded whole. Once KEPT words are kept, those of the generation before go
    that weren't met since.
    """

    def __init__(self, file: str) -> None:
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.kept: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.tokenizer, self.units = Tokenizer.from_file(file), Tokenizer.from_file(file)
        self.units.normalizer, self.units.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        # New units are each met once, so the model's own cache would only cost time, as would threads for one text.
        model = self.units.model
        model._resize_cache(0)
        self.units.model = model
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(file) as f:
            made = json.load(f)
        end, vocab = made["model"]["end_of_word_suffix"], self.units.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocab.items() if token.endswith(end)]] = True
        self.cut = regex.compile(made["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        #: Printable characters below U+0250: lower case and composition don't depend on what is near them.
        self.plain = regex.compile(r"[\x21-\x7E\u00A1-\u024F]+").fullmatch
        #: A stop or comma at a word's end that isn't after a letter from A to y with diaeresis, or a digit.
        self.odd = regex.compile(rb"(?<![A-Za-z0-9])(?<!\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])[.,][ \n]").search

    def _learn(self, words: set[bytes]) -> list[bytes]:
        """Keeps the ids of words that aren't kept, and of their units. Returns those that are too long to stay."""
        kept, before = self.kept, self.before
        simple: list[bytes] = []
        parts: list[tuple[bytes, list[bytes]]] = []
        for word in words:
            if (ids := before.get(word)) is not None:
                kept[word] = ids
            elif word.isalpha() and word.islower():
                simple.append(word)
            else:
                text = word.decode()
                if (text.isascii() and text.isprintable() or self.plain(text)) and "<|" not in text:
                    text = text.lower()
                    parts.append((word, [u.encode() for u in ([text] if text.isalpha() else self.cut(text))]))
                else:
                    kept[word] = pack_ids(self.tokenizer.encode(text, add_special_tokens=False).ids)
        self._encode(simple)
        units = {u for _, some in parts for u in some}.difference(kept)
        kept.update((u, before[u]) for u in units if u in before)
        self._encode([u for u in units if u not in kept])
        for word, some in parts:
            kept[word] = kept[some[0]] if len(some) == 1 else b"".join(map(kept.__getitem__, some))
        return [w for w in words | units if len(w) > LONGEST]

    def _encode(self, units: list[bytes]) -> None:
        for at in range(0, len(units), UNITS):
            some = units[at : at + UNITS]
            text = b" ".join(some)
            text = text.decode() if text.isascii() else text.decode("latin-1").translate(_BYTES)
            ids = np.array(self.units.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            raw = ids.tobytes()
            self.kept.update(zip(some, [raw[a:b] for a, b in zip(cuts, cuts[1:])], strict=True))

    def ids(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids, END_ID last."""
        out = []
        for part in text_parts(text):
            if not self.odd(part):
                for sign in (b".", b","):
                    part = part.replace(sign + b" ", b" " + sign + b" ").replace(sign + b"\n", b" " + sign + b"\n")
            # A-Z may go where no character is from U+0280 on, as all are that combine, and no special token begins.
            if b"<|" not in part and (part.isascii() or len(part.translate(None, _BEYOND)) == len(part)):
                part = part.lower()
            if len(self.kept) >= KEPT:
                self.before, self.kept = self.kept, {}
            words = part.split()
            found = [*map(self.kept.get, words)]
            if None in found:
                long = self._learn({w for w, ids in zip(words, found) if ids is None})
                kept = self.kept
                found = [kept[w] if ids is None else ids for w, ids in zip(words, found)]
                for word in long:
                    del kept[word]
            out += found
        out.append(pack_ids([END_ID]))
        return b"".join(out)


#: What characters from U+0280 on begin with in UTF-8.
_BEYOND = bytes(range(0xCA, 0xF5))


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as its Latin-1 character if that is visible, the others as the characters
    from U+0100 on. Spaces stay."""
    hidden = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD)]
    return {b: chr(256 + i) for i, b in enumerate(hidden) if b != 0x20}


_BYTES = _byte_letters()


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(1)
def _word_ids(file: str) -> WordIds:
    return WordIds(file)


class Windows:
    """OPEN windows of one partition. A piece goes into the fullest window that has room; if none has,
    the fullest window is emitted and the piece opens another."""

    def __init__(self, first_id: int) -> None:
        self.next_id, self.open, self.pieces = first_id, [], {}

    def place(self, piece: tuple, size: int) -> list[tuple]:
        """Rows (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of the window that this emits."""
        done: list[tuple] = []
        at = bisect_right(self.open, (WINDOW - size, 1 << 63)) - 1
        if at >= 0:
            fill, seq = self.open.pop(at)
        else:
            if len(self.open) >= OPEN:
                done = self.pieces.pop(self.open.pop()[1])
            fill, seq = 0, self.next_id
            self.next_id += 1
            self.pieces[seq] = []
        self.pieces[seq].append((*piece, seq, fill))
        if fill + size == WINDOW:
            done = done + self.pieces.pop(seq)
        else:
            insort(self.open, (fill + size, seq))
        return done


PIECE = ("start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, whole boolean, part int")


def _pack(file: str, kind: pa.DataType):
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "whole", "part"]
    types = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32()]

    def batch(rows: list[tuple], whole: bool, part: int) -> pa.RecordBatch:
        columns = [*zip(*rows)]
        n = len(rows)
        return pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(columns, types)], pa.array([whole] * n, pa.bool_()), pa.array([part] * n, pa.int32())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = _word_ids(file), TaskContext.get().partitionId()
        windows = Windows(part << 32)
        rows: list[tuple] = []
        held = 0
        for b in slices(batches):
            for doc, text in zip(b.column(0), b.column(1).cast(pa.binary())):
                ids = words.ids(text.as_py() or b"")
                n = len(ids) // 4
                for start in range(0, n, WINDOW):
                    size = min(WINDOW, n - start)
                    new = windows.place((doc.as_py(), start, size, ids[4 * start : 4 * (start + size)], n), size)
                    rows += new
                    held += sum(4 * r[2] for r in new)
                if held >= BATCH:
                    yield batch(rows, True, part)
                    rows, held = [], 0
        if rows:
            yield batch(rows, True, part)
        for _, seq in windows.open:
            yield batch(windows.pieces[seq], False, part)

    return run


def _merge(group):
    """Leftover windows, end to end, cut where a window is full; the fullest stay as they are."""
    import pandas as pd

    group = group.sort_values(["sequence_id", "offset"], kind="stable")
    fill = group.groupby("sequence_id")["length"].sum()
    full = set(fill.index[fill >= WINDOW - SLACK])
    out, free, at, seq = [], [s for s in fill.index if s not in full], WINDOW, -1
    for row in group.itertuples(index=False):
        if row.sequence_id in full:
            out.append((row.doc_id, row.start, row.length, row.ids, row.doc_tokens, row.sequence_id, row.offset))
            continue
        done = 0
        while done < row.length:
            if at == WINDOW:
                seq, at = free.pop(0), 0
            size = min(WINDOW - at, row.length - done)
            out.append((row.doc_id, row.start + done, size, row.ids[4 * done : 4 * (done + size)], row.doc_tokens, seq, at))
            done, at = done + size, at + size
    frame = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
    return frame.astype({"doc_id": group["doc_id"].dtype})


def pack_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Pieces of docs (doc_id, text): doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    A text's ids, closed by END_ID, are cut into pieces of WINDOW ids and a rest. Each partition packs
    its pieces while it tokenizes; windows that are still open at its end go, with those of MERGED - 1 further
    partitions, to one task that lays them end to end. So the padding is that of one window per MERGED partitions,
    and what the best fit leaves free. ids are little-endian unsigned 32-bit integers. A null or empty text is END_ID
    alone. Rows of one doc_id are separate documents. Memory: OPEN windows and one text a task.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *T._parse_datatype_string(PIECE).fields])
    pieces = table(docs.select("doc_id", "text").mapInArrow(_pack(tokenizer, to_arrow_type(kind)), schema), "pieces")
    columns = schema.names[:7]
    rest = pieces.where("not whole").withColumn("g", F.floor(F.col("part") / MERGED)).groupBy("g").applyInPandas(lambda g: _merge(g), T.StructType(schema.fields[:7]))
    return pieces.where("whole").select(*columns).unionByName(rest)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = pack_documents(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path(TOKENIZER))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
