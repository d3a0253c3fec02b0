"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, slices, table, word_parts

FOLDS, THRESHOLD = 5, 0.3
#: Labelled rows that the model is fitted on, about, and the partitions that sum them.
TRAIN, SUMMED = 100_000, 32
#: Random features, the kernel's width in standard deviations, ridge penalty per row, calibration rows.
FEATURES, WIDTH, RIDGE, BINS = 256, 4.0, 1e-3, 2000

_KIND = np.zeros(256, dtype=np.int64)  # 0: other
for _n, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\v\f", b".", b",", b"!?", b"#$%&*", b"|<>{}[]=_~^\\/", b"'\"-;:()@+`", bytes(range(128, 256))), 1):
    _KIND[list(_bytes)] = _n
NAMES = ("log_bytes", "log_words", *[f"share_{i}" for i in range(14)], "entropy", "mean_word", "sd_word", "longest_word", "distinct_words", "marked_words", "capital_words", "log_lines", "mean_line", "distinct_lines", "rare_start")


def statistics(text: bytes) -> np.ndarray:
    """NAMES of a whole UTF-8 text; an empty text has zeros. The share of a word or line is among all of them."""
    out = np.zeros(len(NAMES), dtype=np.float64)
    if not text:
        return out
    n = len(text)
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    share = counts[counts > 0] / n
    out[0] = np.log1p(n)
    out[2:16] = np.bincount(_KIND, weights=counts, minlength=14) / n
    out[16] = -(share * np.log(share)).sum()
    words = total = squares = longest = marked = capital = 0
    seen: set[bytes] = set()
    for part in word_parts(text):
        lengths = np.fromiter(map(len, part), dtype=np.int64, count=len(part))
        words += len(part)
        total += int(lengths.sum())
        squares += int((lengths * lengths).sum())
        longest = max(longest, int(lengths.max(initial=0)))
        marked += sum(not w.isalnum() for w in part)
        capital += sum(w.isupper() for w in part)
        seen.update(part)
    lines = text.split(b"\n")
    out[1] = np.log1p(words)
    if words:
        mean = total / words
        out[17:20] = mean, max(0.0, squares / words - mean * mean) ** 0.5, np.log1p(longest)
        out[20:23] = len(seen) / words, marked / words, capital / words
    out[23:26] = np.log1p(len(lines)), np.log1p(n / len(lines)), len(set(lines)) / len(lines)
    out[26] = sum(not x[:1].isalpha() for x in lines) / len(lines)
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of every row of docs (doc_id, text); a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [statistics(t.as_py() or b"") for t in batch.column(1).cast(pa.binary())]
            flat = pa.array(np.concatenate(rows).astype(np.float32) if rows else np.zeros(0, np.float32))
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "x"])

    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("x array<float>").fields])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def training_rows(labels: DataFrame, column: str, most: int) -> DataFrame:
    """doc_id and y of labels that may be learnt from: a label of 0 or 1, an id, not held out; of more
    than `most` such rows a share chosen by hash, `most` in expectation. Of an id labelled twice the mean counts."""
    rows = labels.select("doc_id", F.col(column).cast("double").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0.0, 1.0) & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.avg("y").alias("y"))
    n = rows.count()
    return rows if n <= most else rows.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < int(most / n * (1 << 20)))


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.cos(z @ self.omega + self.phase) * (2 / self.omega.shape[1]) ** 0.5, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.values)


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, len(NAMES))


def isotonic(at: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: places and levels of the nondecreasing fit, places ascending."""
    blocks: list[list[float]] = []
    for x, y, w in zip(at, mean, weight):
        blocks.append([x * w, y * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(rows: DataFrame, seed: int = 1) -> Model:
    """The model of rows (x, y, part): normal equations over part > 0, calibration over part 0.

    Partitions sum their own equations, SUMMED matrices of FEATURES squared in all; bins of the raw score
    are counted likewise. Without both labels the score is the mean label, or a half if there is none.
    """
    rng = np.random.default_rng(seed)
    width = len(NAMES)
    at = [F.avg(F.col("x")[i].cast("double")).alias(f"m{i}") for i in range(width)] + [F.stddev_pop(F.col("x")[i].cast("double")).alias(f"s{i}") for i in range(width)]
    seen = rows.agg(F.count("*").alias("n"), F.avg("y").alias("y"), *at).first()
    omega, phase = rng.normal(size=(width, FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES)
    if not seen.n or seen.y in (0.0, 1.0):
        flat = np.array([0.5 if seen.y is None else seen.y])
        return Model(np.zeros(width), np.ones(width), omega, phase, np.zeros(FEATURES + 1), np.zeros(1), flat)
    scale = np.array([seen[f"s{i}"] or 0.0 for i in range(width)]).round(9)
    model = Model(np.array([seen[f"m{i}"] for i in range(width)]).round(9), np.where(scale > 1e-9, scale, 1.0), omega, phase, np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((FEATURES + 2, FEATURES + 2))
        for b in batches:
            z = np.hstack([model.features(_matrix(b.column(0))), b.column(1).to_numpy()[:, None]])
            gram += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()])], ["g"])

    parts = rows.where("part > 0").select("x", "y").mapInArrow(sums, "g binary").collect()
    gram = sum(np.frombuffer(r.g).reshape(FEATURES + 2, -1) for r in parts)
    n = max(1.0, gram[FEATURES, FEATURES])
    beta = np.linalg.solve(gram[:-1, :-1] + RIDGE * n / FEATURES * np.eye(FEATURES + 1), gram[:-1, -1])
    model = model._replace(beta=beta)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = np.floor(np.clip(model.raw(_matrix(b.column(0))), -1, 2) * BINS / 3)
            yield pa.RecordBatch.from_arrays([pa.array(raw.astype(np.int64)), b.column(1)], ["bin", "y"])

    counts = rows.where("part = 0").select("x", "y").mapInArrow(bins, "bin long, y double").groupBy("bin").agg(F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    if not counts:
        return model._replace(knots=np.array([0.0, 1.0]), values=np.array([0.0, 1.0]))
    knots, values = isotonic(*(np.array(c, dtype=np.float64) for c in zip(*[((r.bin + 0.5) * 3 / BINS, r.y, r.n) for r in counts])))
    return model._replace(knots=knots, values=values)


def score_documents(docs: DataFrame, labels: DataFrame, column: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text), learnt from labels (doc_id, column).

    Statistics are taken once per row and kept; about TRAIN labelled rows fit the model. Rows whose
    crc32(doc_id) is divisible by FOLDS are never learnt from, nor are rows without id, and come back as held out.
    Repeated rows each return.
    """
    stats = table(document_statistics(docs), "statistics")
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(4))
    rows = stats.join(training_rows(labels, column, TRAIN), "doc_id").select("doc_id", "x", "y", part.alias("part"))
    # Sums of doubles depend on their order, so that is the same each time.
    rows = table(rows.repartition(SUMMED, "doc_id").sortWithinPartitions("doc_id"), "training")
    model = fit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = np.clip(model.score(_matrix(b.column(1))), 0, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], ["doc_id", "score"])

    scored = stats.mapInArrow(run, T.StructType([stats.schema["doc_id"], T.StructField("score", T.DoubleType())]))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
