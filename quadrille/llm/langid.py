"""Language identification by interpolated Kneser-Ney character models.

Runs of ORDER characters are counted per language over all rows that may be learned from. Spark derives from them, order by order, the
numbers of different characters in front (which lower orders count instead), discounts and probabilities; each language's
probabilities and back-off weights become sorted arrays of hashes. Where these would be too large for a task, the most frequent runs travel
with their log probabilities in all languages, and those of all other runs that texts have are joined to them. A text goes to the language of
least cross-entropy per character. Rows kept apart from the counts say how often that is right at a given lead, and from which surprise on it is rejected.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import documents, release, slices, table
from .quality import isotonic

#: Characters of a run; characters of a text, and of a batch, that are hashed at once; runs and weights of a model that travels, at most.
ORDER, PART, BATCH, KEPT = 5, 1 << 19, 1 << 20, 1 << 20
#: Held-out remainder and its divisor; one in so many texts to learn from serves calibration; share of them to reject.
HELD_OUT, FOLDS, CALIBRATION, REJECT = 2, 4, 8, 0.001
#: What stands before a text's beginning, and between words.
PAD, SPACE = 2, 32
#: Bins of a lead and of a surprise.
BINS, WIDTH = 200, 0.25
#: Joined log probabilities are summed as multiples of its inverse, so that sums don't depend on their order.
UNIT = 1 << 26
UNKNOWN = "und"

_ODD = np.random.default_rng(11).integers(0, 1 << 63, size=ORDER, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@cache
def _kinds() -> np.ndarray:
    """Of each code point: 2 for letters, 1 for marks, which stay with their letters, 0 for others."""
    kinds = [unicodedata.category(chr(i))[0] for i in range(0x110000)]
    return np.array([{"L": 2, "M": 1}.get(k, 0) for k in kinds], dtype=np.uint8)


def characters(text: str) -> Iterator[np.ndarray]:
    """Code points of the lower-cased text in parts of bounded length; whatever is neither letter nor mark is one space between words."""
    after = SPACE
    for at in range(0, len(text), PART):
        code = np.frombuffer(text[at : at + PART].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        word = _kinds()[code] > 0
        code = np.where(word, code, np.uint32(SPACE))
        keep = word.copy()
        keep[1:] |= word[:-1]
        keep[0] |= after != SPACE
        code = code[keep]
        if len(code):
            after = int(code[-1])
            yield code


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def padded(text: str) -> Iterator[np.ndarray]:
    """The parts of characters(), each behind the ORDER - 1 before it."""
    before = np.full(ORDER - 1, PAD, dtype=np.uint32)
    for code in characters(text):
        whole = np.concatenate([before, code])
        yield whole
        before = whole[1 - ORDER :]


def run_hashes(code: np.ndarray) -> list[np.ndarray]:
    """For k = 1 to ORDER the hash of the k characters that end at each place from ORDER - 1 on; and, as item 0, a constant."""
    n = max(0, len(code) - ORDER + 1)
    wide = code.astype(np.uint64)
    out = [np.zeros(n, dtype=np.uint64)]
    for k in range(ORDER):
        out.append(out[-1] + (wide[ORDER - 1 - k : ORDER - 1 - k + n] + np.uint64(1)) * _ODD[k])
    return out


# --- Counting --------------------------------------------------------------------------------------------


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) to (lang, run, n): runs of ORDER characters, counted in batches."""
    held: dict[str, list[np.ndarray]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, codes in held.items():
            code = np.concatenate(codes)
            hashes = run_hashes(code)[ORDER]
            # A run that reaches from one part into the next belongs to neither.
            ends = np.cumsum([len(c) for c in codes])
            inside = np.ones(len(hashes), dtype=bool)
            for e in ends[:-1]:
                inside[e - ORDER + 1 : e] = False
            at = np.flatnonzero(inside)
            _, first, n = np.unique(hashes[at], return_index=True, return_counts=True)
            runs = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(code, ORDER)[at[first]]).view(f"<U{ORDER}").ravel()
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(runs.tolist(), pa.string()), pa.array(n, pa.int64())], ["lang", "run", "n"])
        held.clear()

    for batch in slices(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for code in padded(text.as_py() or ""):
                held.setdefault(lang, []).append(code)
                size += len(code)
                if size >= 4 * BATCH:
                    yield from flush()
                    size = 0
    yield from flush()


def run_counts(rows: DataFrame) -> DataFrame:
    """lang, run, n over all rows (lang, text)."""
    return rows.select("lang", "text").mapInArrow(_count, "lang string, run string, n long").groupBy("lang", "run").agg(F.sum("n").alias("n"))


def probabilities(counts: DataFrame, order: int = ORDER) -> list[DataFrame]:
    """For k = 1 to order: lang, run, n, p, back of the runs of k characters. p is the interpolated Kneser-Ney probability of the last character
    after the others, back the weight that the characters before it give to the next lower order.

    counts are those of the longest runs; shorter runs count the different characters that stand before them. The discount is
    n1 / (n1 + 2 n2) for n1 runs that are there once and n2 that are there twice, or a half where that says nothing. Order 0 is
    uniform over the characters of all languages and one unknown."""
    levels = [table(counts, "runs")]
    for k in range(order - 1, 0, -1):
        levels.insert(0, table(levels[0].groupBy("lang", F.substring("run", 2, k).alias("run")).agg(F.count("*").alias("n")), "runs"))
    size = levels[0].select("run").distinct().count() + 1
    out: list[DataFrame] = []
    for k, level in enumerate(levels, 1):
        ones = level.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"))
        share = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        discount = ones.select("lang", F.when((F.col("n1") > 0) & (F.col("n2") > 0), share).otherwise(0.5).alias("d"))
        after = W.partitionBy("lang", "before")
        level = level.withColumn("before", F.substring("run", 1, k - 1)).withColumn("total", F.sum("n").over(after)).withColumn("kinds", F.count("*").over(after))
        level = level.join(F.broadcast(discount), "lang").withColumn("back", F.col("d") * F.col("kinds") / F.col("total"))
        if k == 1:
            lower = level.withColumn("lower", F.lit(1.0 / size))
        else:
            lower = level.withColumn("shorter", F.substring("run", 2, k - 1)).join(out[-1].select("lang", F.col("run").alias("shorter"), F.col("p").alias("lower")), ["lang", "shorter"])
        out.append(table(lower.select("lang", "run", "n", ((F.col("n") - F.col("d")) / F.col("total") + F.col("back") * F.col("lower")).alias("p"), "back"), "levels"))
    return out


# --- The model -------------------------------------------------------------------------------------------


class Model:
    """Per language: for each order a sorted array of hashes of runs with their log probabilities, and one of the characters before with
    their log back-off weights. size: characters of all languages and one.

    A model that isn't whole has neither, but `frequent`: sorted hashes of runs of ORDER characters, and the log probabilities of each in every
    language. It says nothing about other runs."""

    def __init__(self, langs: list[str], size: int) -> None:
        self.langs, self.floor = langs, -np.log(size)
        self.runs: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self.backs: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self.frequent: tuple[np.ndarray, np.ndarray] | None = None

    def log_probabilities(self, lang: int, hashes: list[np.ndarray], before: list[np.ndarray]) -> np.ndarray:
        """Of the last character of each run. hashes, before: of the last k characters, and of the k characters before the last."""
        n = len(hashes[0])
        out, left = np.zeros(n), np.arange(n)
        for k in range(ORDER, 0, -1):
            value, known = _find(self.runs[lang, k], hashes[k][left])
            out[left[known]] += value[known]
            left = left[~known]
            value, known = _find(self.backs[lang, k], before[k - 1][left])
            out[left[known]] += value[known]
        out[left] += self.floor
        return out


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, k, run, p, back) with hashes of the run and of what stands before its last character in place of the run."""
    for b in batches:
        k, runs = b.column(1).to_numpy(), b.column(2).to_pylist()
        own, prior = np.zeros(len(k), dtype=np.uint64), np.zeros(len(k), dtype=np.uint64)
        for order in np.unique(k):
            at = np.flatnonzero(k == order)
            code = np.array([runs[i] for i in at], dtype=f"<U{order}").view(np.uint32).reshape(len(at), order).astype(np.uint64) + np.uint64(1)
            for j in range(order):
                own[at] += code[:, order - 1 - j] * _ODD[j]
                if j:
                    prior[at] += code[:, order - 1 - j] * _ODD[j - 1]
        hashes = [pa.array(x.view(np.int64)) for x in (own, prior)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *hashes, b.column(3), b.column(4)], ["lang", "k", "run", "before", "p", "back"])


def _sorted(hashes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes, first = np.unique(hashes, return_index=True)
    return hashes, values[first]


def _find(entry: tuple[np.ndarray, np.ndarray], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, whether they are there)."""
    hashes, values = entry
    if not len(hashes):
        return np.zeros((len(wanted), *values.shape[1:])), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
    return values[at], hashes[at] == wanted


def fit_languages(rows: DataFrame, kept: int = KEPT) -> Model:
    """The model of all rows (lang, text), whole if it has at most `kept` runs."""
    return model_of(probabilities(run_counts(rows)), kept)


def model_of(levels: list[DataFrame], kept: int = KEPT) -> Model:
    """The model of these probabilities. It is whole if there are at most `kept` runs, and otherwise has the most frequent ones in the same memory
    (32 bytes a run), which is what the driver and each task hold."""
    every = levels[0].withColumn("k", F.lit(1))
    for k, level in enumerate(levels[1:], 2):
        every = every.unionByName(level.withColumn("k", F.lit(k)))
    langs = sorted(r.lang for r in levels[0].select("lang").distinct().collect())
    model = Model(langs, levels[0].select("run").distinct().count() + 1)
    if every.count() > kept:
        model.frequent = _frequent(levels, model, 4 * kept // (len(langs) + 1))
        return model
    found = every.select("lang", "k", "run", "p", "back").mapInArrow(_hashed, "lang string, k int, run long, before long, p double, back double").toArrow()
    lang = found.column("lang").to_numpy()
    k, run, prior, p, back = (found.column(c).to_numpy() for c in ("k", "run", "before", "p", "back"))
    for i, name in enumerate(langs):
        for order in range(1, ORDER + 1):
            own = np.flatnonzero((k == order) & (lang == name))
            model.runs[i, order] = _sorted(run[own].view(np.uint64), np.log(p[own]))
            model.backs[i, order] = _sorted(prior[own].view(np.uint64), np.log(back[own]))
    return model


def _frequent(levels: list[DataFrame], model: Model, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, log probabilities by run and language) of the most frequent runs, `most` at most."""
    runs = levels[-1].groupBy("run").agg(F.sum("n").alias("n"))
    total, least = 0, 1 << 62
    for r in sorted(runs.groupBy(F.least("n", F.lit(1 << 12)).alias("n")).count().collect(), key=lambda r: -r.n):
        total += r["count"]
        if total > most:
            break
        least = r.n
    found = log_probabilities(runs.where(F.col("n") >= least).select("run"), levels, model).mapInArrow(_hashed_runs, "run long, logs array<long>").toArrow()
    hashes = found.column("run").to_numpy().view(np.uint64)
    logs = found.column("logs").combine_chunks().flatten().to_numpy().reshape(len(hashes), len(model.langs)) / UNIT
    order = np.argsort(hashes)
    return hashes[order], logs[order]


def _hashed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (run, logs) with hashes of the runs of ORDER characters."""
    for b in batches:
        code = np.array(b.column(0).to_pylist(), dtype=f"<U{ORDER}").view(np.uint32).reshape(b.num_rows, ORDER).astype(np.uint64) + np.uint64(1)
        own = (code * _ODD[::-1]).sum(axis=1, dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), b.column(1)], ["run", "logs"])


def log_probabilities(runs: DataFrame, levels: list[DataFrame], model: Model) -> DataFrame:
    """run, logs of the different runs (run) of ORDER characters: the log probability of the last character in each language of the model, in UNITs.
    Order by order, what a language doesn't have gets the weight of the characters before and the value of the shorter run."""
    spark = runs.sparkSession
    langs = F.broadcast(spark.createDataFrame([(x,) for x in model.langs], "lang string"))
    lower = None
    for k, level in enumerate(levels, 1):
        own = runs.select(F.substring("run", ORDER + 1 - k, k).alias("run")).distinct().crossJoin(langs).withColumn("before", F.substring("run", 1, k - 1))
        backs = level.groupBy("lang", F.substring("run", 1, k - 1).alias("before")).agg(F.first(F.log("back")).alias("weight"))
        found = own.join(level.select("lang", "run", F.log("p").alias("log")), ["lang", "run"], "left").join(backs, ["lang", "before"], "left")
        if lower is None:
            found = found.withColumn("shorter", F.lit(float(model.floor)))
        else:
            found = found.withColumn("rest", F.substring("run", 2, k - 1)).join(lower.select("lang", F.col("run").alias("rest"), F.col("log").alias("shorter")), ["lang", "rest"])
        lower = table(found.select("lang", "run", F.coalesce("log", F.coalesce("weight", F.lit(0.0)) + F.col("shorter")).alias("log")), "logs")
    both = F.array_sort(F.collect_list(F.struct("lang", F.round(F.col("log") * UNIT).cast("long").alias("log"))))
    return lower.groupBy("run").agg(both.getField("log").alias("logs"))


# --- Scoring ---------------------------------------------------------------------------------------------


def entropies(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(summed negative log probabilities by text and language, characters of each text). The model must know all runs."""
    total, chars = np.zeros((len(texts), len(model.langs))), np.zeros(len(texts), dtype=np.int64)
    for _ in measure(model, texts, total, chars):
        raise ValueError("the model isn't whole")
    return total, chars


def measure(model: Model, texts: list[str | None], total: np.ndarray, chars: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Adds to total and chars what entropies() returns, without the runs that a model which isn't whole doesn't know; these are yielded, batch
    by batch: numbers of texts, runs, how often."""
    held: list[tuple[int, np.ndarray]] = []

    def flush() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        code = np.concatenate([c for _, c in held])
        ends = np.cumsum([len(c) for _, c in held])
        starts = ends - [len(c) for _, c in held]
        hashes = run_hashes(code)
        # Places of hashes are those of runs' first characters; runs that reach from one part into the next are left out.
        at = np.concatenate([np.arange(s, e - ORDER + 1) for s, e in zip(starts, ends)])
        _, first, inverse = np.unique(hashes[ORDER][at], return_index=True, return_inverse=True)
        one = at[first]
        size = ends - starts - ORDER + 1
        cuts = np.cumsum(size) - size
        if model.frequent is None:
            own = [h[one] for h in hashes]
            prior = [_before(code, one, k) for k in range(ORDER)]
            values = (model.log_probabilities(lang, own, prior) for lang in range(len(model.langs)))
        else:
            logs, known = _find(model.frequent, hashes[ORDER][one])
            values = np.where(known[:, None], logs, 0.0).T
        for lang, value in enumerate(values):
            sums = np.add.reduceat(value[inverse], cuts)
            for (i, _), s in zip(held, sums):
                total[i, lang] -= s
        for (i, _), n in zip(held, size):
            chars[i] += n
        if model.frequent is not None and not known.all():
            left = np.flatnonzero(~known[inverse])
            owner = np.repeat([i for i, _ in held], size)[left]
            pairs, n = np.unique(owner * len(one) + inverse[left], return_counts=True)
            place = one[pairs % len(one)]
            runs = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(code, ORDER)[place]).view(f"<U{ORDER}").ravel()
            yield pairs // len(one), runs, n
        held.clear()

    waiting = 0
    for i, text in enumerate(texts):
        for code in padded(text or ""):
            held.append((i, code))
            waiting += len(code)
            if waiting >= BATCH:
                yield from flush()
                waiting = 0
    if held:
        yield from flush()


def _before(code: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k characters before the last one of the runs that start at these places."""
    out = np.zeros(len(at), dtype=np.uint64)
    for j in range(k):
        out += (code[at + ORDER - 2 - j].astype(np.uint64) + np.uint64(1)) * _ODD[j]
    return out


def _decide(langs: list[str], letters: list[bool], total: np.ndarray, chars: np.ndarray) -> list[pa.Array]:
    """best, entropy (of the best language, per character), lead (over the next best), chars; best is null without letters or languages."""
    each = total / np.maximum(chars, 1)[:, None]
    best, entropy, lead = [], np.zeros(len(letters)), np.zeros(len(letters))
    for i, known in enumerate(letters):
        if not langs or not known:
            best.append(None)
            continue
        order = np.argsort(each[i], kind="stable")
        best.append(langs[order[0]])
        entropy[i] = each[i, order[0]]
        lead[i] = each[i, order[1]] - entropy[i] if len(order) > 1 else 0.0
    return [pa.array(best, pa.string()), pa.array(entropy), pa.array(lead), pa.array(chars)]


DECIDED = "best string, entropy double, lead double, chars long"


def _score(model: Model):
    """Rows (text, other columns) to the other columns and those of _decide(), by a whole model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(0).to_pylist()
            more = _decide(model.langs, [bool(t) and has_letter(t) for t in texts], *entropies(model, texts))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *more], [*b.schema.names[1:], "best", "entropy", "lead", "chars"])

    return run


PARTS = "row long, letters boolean, chars long, total array<double>, run string, n long"


def _part(model: Model):
    """Rows (text, other columns) to the other columns and PARTS: a number of the row, whether it has letters, characters and sums by language as far as
    the model goes, without run. Further rows have a row's number and one of its other runs, how often, and nothing else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        names = ["row", "letters", "chars", "total", "run", "n"]
        for b in slices(batches):
            texts = b.column(0).to_pylist()
            total, chars = np.zeros((len(texts), len(model.langs))), np.zeros(len(texts), dtype=np.int64)
            for at, runs, n in measure(model, texts, total, chars):
                own = [pa.nulls(len(at), c.type) for c in b.columns[1:]]
                more = [pa.array(row + at), pa.nulls(len(at), pa.bool_()), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.list_(pa.float64())), pa.array(runs.tolist(), pa.string()), pa.array(n)]
                yield pa.RecordBatch.from_arrays([*own, *more], [*b.schema.names[1:], *names])
            letters = pa.array([bool(t) and has_letter(t) for t in texts], pa.bool_())
            more = [pa.array(row + np.arange(len(texts))), letters, pa.array(chars), pa.array(total.tolist(), pa.list_(pa.float64())), pa.nulls(len(texts), pa.string()), pa.nulls(len(texts), pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *more], [*b.schema.names[1:], *names])
            row += len(texts)

    return run


def _decided(langs: list[str]):
    """Rows (letters, chars, total, other columns) to the other columns and those of _decide()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = np.array(b.column(2).to_pylist(), dtype=np.float64).reshape(b.num_rows, len(langs))
            more = _decide(langs, b.column(0).to_pylist(), total, b.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[3:], *more], [*b.schema.names[3:], "best", "entropy", "lead", "chars"])

    return run


def score_rows(rows: DataFrame, levels: list[DataFrame], kept: int = KEPT) -> DataFrame:
    """The columns of rows (text, others) but the text, with those of _decide(). Where the model isn't whole, the runs of texts that aren't among the
    frequent ones go to the levels: each different one gets its log probabilities once, by joins, and they are summed by row."""
    spark = rows.sparkSession
    model = model_of(levels, kept)
    shared = spark.sparkContext.broadcast(model)
    own, decided = rows.schema.fields[1:], T._parse_datatype_string(DECIDED).fields
    if model.frequent is None:
        return table(rows.mapInArrow(lambda batches: _score(shared.value)(batches), T.StructType([*own, *decided])), "entropies")
    nullable = [T.StructField(f.name, f.dataType) for f in own]
    parts = table(rows.mapInArrow(lambda batches: _part(shared.value)(batches), T.StructType([*nullable, *T._parse_datatype_string(PARTS).fields])), "parts")
    rest = parts.where("run IS NOT NULL").select("row", "run", "n")
    logs = table(log_probabilities(rest.select("run").distinct(), levels, model), "logs")
    sums = rest.join(logs, "run").groupBy("row").agg(F.array(*[F.sum(F.col("n") * F.col("logs")[i]) for i in range(len(model.langs))]).alias("more"))
    every = parts.where("run IS NULL").join(sums, "row", "left")
    total = F.when(F.col("more").isNull(), F.col("total")).otherwise(F.zip_with("total", "more", lambda x, y: x - y / UNIT))
    langs = model.langs
    out = table(every.select("letters", "chars", total.alias("total"), *[f.name for f in own]).mapInArrow(lambda batches: _decided(langs)(batches), T.StructType([*nullable, *decided])), "entropies")
    release(parts)
    return out


def weight(lead: Column, chars: Column) -> Column:
    """A lead in entropy in bins: what speaks for the best language grows with the square root of the length."""
    return F.least(F.floor(lead * F.sqrt(chars) / WIDTH), F.lit(BINS - 1)).cast("int")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves HELD_OUT; not so without id."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS == HELD_OUT, F.lit(False))


def identify(docs: DataFrame, kept: int = KEPT) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected, entropy of every row of docs (doc_id, text, lang).

    Learned from are rows with text and lang that aren't held out; a row without id may be. lang_pred is UNKNOWN, with score 0 and
    rejected, where the text is null or empty or has no letter, or where there is nothing to learn from. Equal entropies go to the language that
    sorts first. score is the calibrated probability that lang_pred is right; rejected marks texts more surprising to their best language than all
    but REJECT of the texts that calibrate. Equal texts are in one part, counts or calibration. Repeated rows all count and
    all return. An empty table gives an empty result; other columns are left out. Memory: the model that travels (`kept` runs; the result doesn't depend on
    it) and BATCH characters a task.
    """
    mine = ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    apart = F.pmod(F.xxhash64("text"), F.lit(CALIBRATION)) == 0
    levels = probabilities(run_counts(docs.where(mine & ~apart).select("lang", "text")))
    rows = docs.select("text", "doc_id", F.when(mine & apart, F.col("lang")).alias("known"))
    scored = score_rows(rows, levels, kept)
    surprise = F.col("entropy") - F.col("mean")
    tested = scored.where("known IS NOT NULL AND best IS NOT NULL")
    means = tested.where("known = best").groupBy(F.col("best").alias("_l")).agg(F.avg("entropy").alias("mean"))
    far = F.floor(surprise * F.sqrt("chars") / WIDTH).cast("int")
    found = tested.select(weight(F.col("lead"), F.col("chars")).alias("bin"), (F.col("known") == F.col("best")).cast("double").alias("right")).groupBy("bin").agg(F.avg("right").alias("right"), F.count("*").alias("n")).orderBy("bin").collect()
    tail = tested.where("known = best").join(F.broadcast(means), F.col("best") == F.col("_l")).groupBy(far.alias("far")).count().collect()
    curve = _curve(found)
    limit = _limit(tail)
    sure = F.element_at(F.array(*map(F.lit, curve)), weight(F.col("lead"), F.col("chars")) + 1)
    known = F.col("best").isNotNull()
    out = scored.join(F.broadcast(means), F.col("best") == F.col("_l"), "left")
    rejected = F.coalesce(far > limit, F.lit(False)) if limit is not None else F.lit(False)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce("best", F.lit(UNKNOWN)).alias("lang_pred"), F.when(known, sure).otherwise(0.0).alias("score"), (~known | rejected).alias("rejected"), F.when(known, F.col("entropy")).alias("entropy"))


def _curve(found: list) -> list[float]:
    """For each bin of the lead, how often the best language is right: nondecreasing, and a half where nothing was seen."""
    if not found:
        return [0.5] * BINS
    at, level = isotonic(*(np.array(c, dtype=np.float64) for c in zip(*[(r.bin, (r.right * r.n + 1) / (r.n + 2), r.n) for r in found])))
    return np.clip(np.interp(np.arange(BINS), at, level), 0, 1).tolist()


def _limit(tail: list) -> int | None:
    """The least bin of surprise that at most REJECT of the rows lie beyond."""
    left = REJECT * sum(r["count"] for r in tail)
    for r in sorted(tail, key=lambda r: -r.far):
        left -= r["count"]
        if left < 0:
            return r.far
    return None


def op11_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir, "doc_id", "text", "lang"))
