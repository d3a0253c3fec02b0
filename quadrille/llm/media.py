"""Media columns: signature sniffing with Aho-Corasick, confirmed by format validators."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, slices

ALIGN, RATE, DECLARED = 64, 8000, "application/octet-stream"


class Media(NamedTuple):
    kind: str
    offset: int
    length: int


def _wave(data: memoryview, at: int) -> int:
    """Length of the RIFF file at this place, or 0: its chunks must fill it exactly."""
    end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    if end > len(data) or bytes(data[at + 8 : at + 12]) not in (b"WAVE", b"WEBP"):
        return 0
    place = at + 12
    while place + 8 <= end:
        size = int.from_bytes(data[place + 4 : place + 8], "little")
        place += 8 + size + size % 2
    return end - at if place == end else 0


def _png(data: memoryview, at: int) -> int:
    """Chunks with right checksums, IHDR first, up to IEND."""
    place, first = at + 8, True
    while place + 12 <= len(data):
        size = int.from_bytes(data[place : place + 4], "big")
        kind = bytes(data[place + 4 : place + 8])
        end = place + 12 + size
        if end > len(data) or first != (kind == b"IHDR") or first and size != 13 or zlib.crc32(data[place + 4 : end - 4]) != int.from_bytes(data[end - 4 : end], "big"):
            return 0
        if kind == b"IEND":
            return end - at
        place, first = end, False
    return 0


@lru_cache(maxsize=1)
def _last(data: bytes, mark: bytes) -> int:
    """The last place of a mark, looked for once however many headers ask."""
    return data.rfind(mark)


def _jpeg(data: memoryview, at: int) -> int:
    """Marker segments up to the scan, then entropy-coded bytes up to the end marker."""
    place = at + 2
    while place + 4 <= len(data) and data[place] == 0xFF:
        marker, size = data[place + 1], int.from_bytes(data[place + 2 : place + 4], "big")
        if size < 2 or marker in (0x00, 0xFF, 0xD8, 0xD9):
            return 0
        place += 2 + size
        if marker == 0xDA:
            break
    else:
        return 0
    if place > _last(data.obj, b"\xff\xd9"):
        return 0
    return data.obj.find(b"\xff\xd9", place) + 2 - at


def _gif(data: memoryview, at: int) -> int:
    """Blocks and their sub-blocks up to the trailer."""

    def blocks(place: int) -> int:
        while place < len(data) and data[place]:
            place += 1 + data[place]
        return place + 1

    def colours(flags: int) -> int:
        return 3 << (flags % 8 + 1) if flags & 0x80 else 0

    if at + 13 > len(data):
        return 0
    place = at + 13 + colours(data[at + 10])
    while place + 1 < len(data) or place < len(data) and data[place] == 0x3B:
        if data[place] == 0x3B:
            return place + 1 - at
        if data[place] == 0x21:
            place = blocks(place + 2)
        elif data[place] == 0x2C and place + 10 < len(data):
            place = blocks(place + 11 + colours(data[place + 9]))
        else:
            return 0
    return 0


def _bmp(data: memoryview, at: int) -> int:
    if at + 30 > len(data):
        return 0
    size, zero, start, header = struct.unpack("<IIII", data[at + 2 : at + 18])
    width, height, planes, bits = struct.unpack("<iiHH", data[at + 18 : at + 30])
    rows = (abs(width) * bits + 31) // 32 * 4 * abs(height)
    right = zero == 0 and header in (40, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and start >= 14 + header
    return size if right and start + rows <= size <= len(data) - at else 0


def _gzip(data: memoryview, at: int) -> int:
    """One member that inflates to its own length and checksum; inflated in steps of bounded size."""
    work, place = zlib.decompressobj(31), at
    try:
        while not work.eof and place < len(data):
            step = data[place : place + 65536]
            work.decompress(step, 1 << 20)
            while work.unconsumed_tail:
                work.decompress(work.unconsumed_tail, 1 << 20)
            place += len(step)
    except zlib.error:
        return 0
    return place - len(work.unused_data) - at if work.eof else 0


def _pdf(data: memoryview, at: int) -> int:
    """From the header to the first end mark after a cross-reference."""
    table = data.obj.find(b"startxref", at)
    end = data.obj.find(b"%%EOF", table) if table >= 0 else -1
    return end + 5 - at if end >= 0 else 0


#: Magic bytes (fixed by the formats) and who confirms them.
SIGNATURES: dict[bytes, tuple[str, Callable[[memoryview, int], int]]] = {
    b"RIFF": ("audio/wav", _wave),
    b"\x89PNG\r\n\x1a\n": ("image/png", _png),
    b"\xff\xd8\xff": ("image/jpeg", _jpeg),
    b"GIF87a": ("image/gif", _gif),
    b"GIF89a": ("image/gif", _gif),
    b"BM": ("image/bmp", _bmp),
    b"\x1f\x8b\x08": ("application/gzip", _gzip),
    b"%PDF-": ("application/pdf", _pdf),
}


@lru_cache(1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic in SIGNATURES:
        found.add_word(magic.decode("latin-1"), magic)
    found.make_automaton()
    return found


def sniff(data: bytes | None) -> list[Media]:
    """Confirmed media in data by offset: one pass locates all magic bytes, and what a validator refuses
    is text that looks like them. Null or empty data holds none. A RIFF form WEBP is an image."""
    view, out = memoryview(data or b""), []
    documents_to = 0  # a document's header within a document, or after one that never ends, is no other
    for last, magic in _automaton().iter((data or b"").decode("latin-1")):
        at = last + 1 - len(magic)
        kind, valid = SIGNATURES[magic]
        if valid is _pdf and at < documents_to:
            continue
        size = valid(view, at)
        if valid is _pdf:
            documents_to = at + size if size else len(view)
        if size:
            out.append(Media("image/webp" if magic == b"RIFF" and bytes(view[at + 8 : at + 12]) == b"WEBP" else kind, at, size))
    return sorted(out, key=lambda m: (m.offset, -m.length))


def detect(data: bytes | None, declared: str | None) -> tuple[str | None, list[Media]]:
    """The type of data, and media embedded in it. A confirmed file at offset 0 corrects the declared
    type; without one the declared type stands."""
    found = sniff(data)
    outer = found[0] if found and found[0].offset == 0 else None
    return (outer.kind if outer else declared), [m for m in found if m is not outer]


def carve(data: bytes, media: list[Media]) -> list[bytes]:
    return [data[m.offset : m.offset + m.length] for m in media]


def store(payload: bytes) -> bytes:
    """The payload as a WAVE file of 8-bit mono samples."""
    odd = len(payload) % 2
    form = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(payload))
    return b"RIFF" + struct.pack("<I", len(form) + len(payload) + odd) + form + payload + bytes(odd)


def samples(stored: bytes) -> bytes:
    """The samples of a WAVE file that sniff() has confirmed at offset 0."""
    view, place = memoryview(stored), 12
    while bytes(view[place : place + 4]) != b"data":
        size = int.from_bytes(view[place + 4 : place + 8], "little")
        place += 8 + size + size % 2
    return stored[place + 8 : place + 8 + int.from_bytes(view[place + 4 : place + 8], "little")]


def features(data: bytes) -> str:
    """Sum, number of distinct values, greatest count and rises of the samples, all of them whole numbers."""
    x = np.frombuffer(data, dtype=np.uint8)
    counts = np.bincount(x, minlength=256)
    rises = int(np.count_nonzero(x[1:] > x[:-1]))
    return f"sum={int((counts * np.arange(256)).sum())};values={int((counts > 0).sum())};mode={int(counts.argmax())};most={int(counts.max())};rises={rises}"


MEDIA = "n_bytes long, media binary, declared string"
FOUND = "n_bytes long, payload binary, media_bytes long, media_sha256 string, kind string, corrected boolean, embedded array<struct<kind:string,offset:long,length:long>>, feature string"


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media, declared: each whole text as UTF-8, zeros up to a positive multiple of
    ALIGN, stored as a WAVE file under a type that says nothing. A null text counts as empty. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [x.as_py() or b"" for x in batch.column(1).cast(pa.binary())]
            media = [store(x + bytes((-len(x)) % ALIGN if x else ALIGN)) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary()), pa.array([DECLARED] * len(texts))], ["doc_id", "n_bytes", "media", "declared"])

    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(MEDIA).fields])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def read_media(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload, media_bytes, media_sha256, kind, corrected, embedded, feature of media
    (doc_id, n_bytes, media, declared).

    The type comes from the bytes; embedded media are listed by place and can be carved. payload holds the
    samples of audio, and is null where the bytes are no WAVE file; feature then covers the bytes themselves.
    Null media count as empty. Repeated rows each return. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry = pa.struct([("kind", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
        for batch in slices(batches):
            rows = []
            for x, said in zip(batch.column(2), batch.column(3)):
                data = x.as_py() or b""
                kind, inner = detect(data, said.as_py())
                payload = samples(data) if kind == "audio/wav" and data[:4] == b"RIFF" else None
                held = ",".join(f"{m.kind}@{m.offset}+{m.length}" for m in inner)
                feature = f"{kind};{features(data if payload is None else payload)};embedded={held}"
                rows.append((payload, len(data), hashlib.sha256(data).hexdigest(), kind, kind != said.as_py(), [m._asdict() for m in inner], feature))
            types = [pa.binary(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.list_(entry), pa.string()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "n_bytes", "payload", "media_bytes", "media_sha256", "kind", "corrected", "embedded", "feature"])

    schema = T.StructType([media.schema["doc_id"], *T._parse_datatype_string(FOUND).fields])
    return media.select("doc_id", "n_bytes", "media", "declared").mapInArrow(run, schema)


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_media(store_texts(documents(spark, sf_dir, "doc_id", "text")))
    return found.select("doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", F.octet_length("payload") - 63, F.lit(64))).alias("tail_crc32"), "media_bytes", "media_sha256", "feature")
