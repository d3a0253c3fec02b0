"""Toxicity: a classifier chain whose later links see out-of-fold probabilities of earlier ones."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import or_
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, slices, table
from .quality import held_out

#: Categories in the order of the chain: a column of the labels, and the value that means yes.
CHAIN = (("quality", 0), ("toxic", 1))
#: Labelled rows that the chain is fitted on, about; units that it looks at for each category, the least number
#: of those rows that hold one, and its least chi-square.
TRAIN, UNITS, SUPPORT, SURE = 10_000, 128, 5, 16.0
#: Folds; ridge penalty; probability from which a document is toxic.
FOLDS, RIDGE, THRESHOLD = 5, 0.3, 0.4

_WORD = re.compile(r"[^\W\d_]+")
#: Code points of a text that are cut into words at once.
PART = 1 << 20


def words_of(text: str | None) -> Iterator[list[str]]:
    """Lower-case runs of letters, in lists whose size doesn't grow with the text; parts end at white space."""
    text, start = text or "", 0
    while start < len(text):
        end = start + PART
        while end < len(text) and not text[end].isspace():
            end += 1
        yield _WORD.findall(text[start:end].lower())
        start = end


def units_of(word: str) -> tuple[str, ...]:
    """What a word tells: itself, and how it begins, for languages that inflect and compound."""
    return (word, word[:5] + "-", word[:4] + "-") if len(word) > 5 else (word, word[:4] + "-") if len(word) > 4 else (word,)


def count_units(text: str | None, among: dict[str, int] | None = None) -> tuple[Counter, int]:
    """Occurrences of each unit in a text, of these only if given, and its number of words."""
    words: Counter = Counter()
    for part in words_of(text):
        words.update(part)
    units: Counter = Counter()
    for w, n in words.items():
        for u in units_of(w):
            if among is None or u in among:
                units[u] += n
    return units, words.total()


class Vocabulary(NamedTuple):
    index: dict[str, int]

    def features(self, text: str | None) -> np.ndarray:
        """n / (n + 1) for a unit that occurs n times, then the log of the number of words."""
        units, n = count_units(text, self.index)
        out = np.zeros(len(self.index) + 1)
        for u, times in units.items():
            out[self.index[u]] = times / (times + 1)
        out[-1] = np.log1p(n) / 10
        return out


def _texts(batch: pa.RecordBatch) -> list:
    return batch.column(batch.schema.get_field_index("text")).to_pylist()


def choose_units(rows: DataFrame, categories: Sequence[str]) -> tuple[Vocabulary, list[list[str]]]:
    """For each category the UNITS units whose presence in a document tells most about it, by chi-square over
    rows where it isn't null; units in fewer than SUPPORT of them, or below SURE, are chance. Also the units that
    the same rule chooses without each fold."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [[*count_units(t)[0]] for t in _texts(b)]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in (*categories, "fold")], pa.array(found, pa.list_(pa.string()))], [*categories, "fold", "units"])

    held = rows.select("text", *categories, "fold").mapInArrow(distinct, ", ".join([*[f"{c} double" for c in categories], "fold int", "units array<string>"]))
    parts = [F.lit(True), *[F.col("fold") != f for f in range(FOLDS)]]
    sums = [x for k, part in enumerate(parts) for c in categories for x in (F.count(F.when(part, F.col(c))).alias(f"n_{c}_{k}"), F.sum(F.when(part, F.col(c))).alias(f"{c}_{k}"))]
    total = rows.agg(*sums).first()
    by_unit = table(held.select(F.explode("units").alias("unit"), *categories, "fold").groupBy("unit").agg(*sums).where(reduce(or_, [F.col(f"n_{c}_0") >= SUPPORT for c in categories])), "units")
    chosen: list[dict[str, int]] = []
    for k in range(len(parts)):
        units: dict[str, int] = {}
        for c in categories:
            yes, among, n = float(total[f"{c}_{k}"] or 0), total[f"n_{c}_{k}"], F.col(f"n_{c}_{k}")
            if not 0 < yes < among:
                continue
            chi = (F.col(f"{c}_{k}") * among - n * yes) ** 2 / (n * (among - n + 1.0)) * (among / (yes * (among - yes)))
            for r in by_unit.where(n >= SUPPORT).where(chi >= SURE).orderBy(F.desc(chi), "unit").limit(UNITS).select("unit").collect():
                units.setdefault(r.unit, len(units))
        chosen.append(units)
    return Vocabulary(chosen[0]), [[*units] for units in chosen[1:]]


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps, intercept last and unpenalized."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], RIDGE)
    penalty[-1] = 1e-6
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def probability(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def fit_chain(x: np.ndarray, ys: np.ndarray, fold: np.ndarray, seen: Sequence[np.ndarray] | None = None) -> list[np.ndarray]:
    """A model per column of ys, fitted on the rows where it isn't NaN; without any its probability is 0. Each but the
    first sees, beside x, what earlier models say of a row when fitted without its fold, so that it learns from
    guesses as good as those it will get. seen: the columns of x that the models see, then those that were chosen without each
    fold, which the guesses for that fold see."""
    seen = seen or [np.arange(x.shape[1])] * (FOLDS + 1)
    models, guesses = [], np.zeros((len(x), 0))
    for k in range(ys.shape[1]):
        y, known = ys[:, k], ~np.isnan(ys[:, k])
        own = np.hstack([x[:, seen[0]], guesses])
        models.append(logistic(own[known], y[known]) if known.any() else np.append(np.zeros(own.shape[1]), -np.inf))
        guess = np.full(len(y), y[known].mean() if known.any() else 0.0)
        for f in range(FOLDS):
            others = known & (fold != f)
            if (fold == f).any() and others.any():
                part = np.hstack([x[:, seen[f + 1]], guesses])
                guess[fold == f] = probability(logistic(part[others], y[others]), part[fold == f])
        guesses = np.hstack([guesses, guess[:, None]])
    return models


def run_chain(models: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    for w in models:
        x = np.hstack([x, probability(w, x)[:, None]])
    return x[:, -len(models) :]


class Chain(NamedTuple):
    """A fitted chain: its categories in order, the units it looks at, and a model for each category."""

    categories: tuple[str, ...]
    vocabulary: Vocabulary
    models: list[np.ndarray]

    def probabilities(self, texts: Sequence[str | None]) -> np.ndarray:
        x = np.array([self.vocabulary.features(t) for t in texts]).reshape(-1, len(self.vocabulary.index) + 1)
        return run_chain(self.models, x)

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id and p_ of each category for every row of docs (doc_id, text): one pass over whole texts
        without a shuffle. Null texts count as empty; repeated rows each return."""
        names = [f"p_{c}" for c in self.categories]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                p = self.probabilities(_texts(b))
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(p[:, k]) for k in range(len(names))]], ["doc_id", *names])

        return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], *[T.StructField(c, T.DoubleType()) for c in names]]))

    def reject(self, docs: DataFrame, category: str) -> DataFrame:
        """The rows of docs whose probability of the category is below THRESHOLD; all columns stay."""
        k = self.categories.index(category)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                yield b.filter(pa.array(self.probabilities(_texts(b))[:, k] < THRESHOLD))

        return docs.mapInArrow(run, docs.schema)


def fit_toxicity(docs: DataFrame, labels: DataFrame, chain: Sequence[tuple[str, int]] = CHAIN) -> Chain:
    """The chain, each link fitted on about TRAIN rows of docs that have its label, chosen by hash of those that
    aren't held out; so the driver sees TRAIN rows a link of 2 * UNITS numbers whatever the tables' sizes. A label
    that is null doesn't count, others of its row do. Without labelled rows every probability is below 1e-12."""
    categories = [c for c, _ in chain]
    known = labels.select("doc_id", *[(F.col(c) == yes).cast("double").alias(c) for c, yes in chain]).where(~held_out(F.col("doc_id"))).dropna("all", subset=categories).groupBy("doc_id").agg(*[F.max(c).alias(c) for c in categories])
    n = known.agg(*[F.count(c).alias(c) for c in categories]).first()
    if max(n) > TRAIN:
        place = F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1 << 20))
        known = known.where(reduce(or_, [F.col(c).isNotNull() & (place < int(min(1, TRAIN / max(n[c], 1)) * (1 << 20))) for c in categories]))
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold")
    # About TRAIN rows a link, whatever the tables' sizes.
    rows = table(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", *categories, fold), "training")
    vocabulary, without = choose_units(rows, categories)
    every = Vocabulary({u: k for k, u in enumerate(dict.fromkeys([*vocabulary.index, *[u for units in without for u in units]]))})

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = pa.array([every.features(t).astype(np.float32).tobytes() for t in _texts(b)], pa.binary())
            yield pa.RecordBatch.from_arrays([x, *[b.column(b.schema.get_field_index(c)) for c in (*categories, "fold")]], ["x", *categories, "fold"])

    seen = rows.mapInArrow(examples, ", ".join(["x binary", *[f"{c} double" for c in categories], "fold int"])).toPandas()
    if len(seen):
        x = np.stack([np.frombuffer(v, dtype=np.float32) for v in seen.x]).astype(np.float64)
        columns = [np.array([*[every.index[u] for u in units], len(every.index)]) for units in (vocabulary.index, *without)]
        models = fit_chain(x, seen[categories].to_numpy(), seen.fold.to_numpy(), columns)
    else:
        models = [np.append(np.zeros(len(vocabulary.index) + 1 + k), -np.inf) for k in range(len(categories))]
    return Chain(tuple(categories), vocabulary, models)


def op7_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    found = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).score(docs)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("p_quality").alias("low_quality"), F.col("p_toxic").alias("score"), (F.col("p_toxic") >= THRESHOLD).cast("int").alias("predicted"))
