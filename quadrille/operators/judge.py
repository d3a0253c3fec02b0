"""A language model as the comparison oracle: deduplicated, asked once, with answers that are kept as they come.

A cache is a folder of Parquet commits (key, reasoning, answer, commit). Tasks write to it themselves, so that a lost executor costs no answer
that has been written; the folder must be one that Python on every machine reaches (a shared path, or a URI that pyarrow knows).
"""

from __future__ import annotations

import asyncio
import json
import re
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice
from typing import Protocol

import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..functions.text import cache_key, prompt
from ..storage import table

#: The object that a judge must answer with.
RESPONSE_SCHEMA = "reasoning string, is_ab_less_than_cd boolean"


class ChatModel(Protocol):
    """Answers lists of messages (role, content), one text each."""

    def generate(self, messages: list[list[dict]]) -> list[str]: ...


#: The four texts of a prompt, of any number of lines; one that itself holds the next heading ends there.
QUESTION = re.compile(r"Text A: (.*?)\nText B: (.*?)\nText C: (.*?)\nText D: (.*)\nIs the distance between A and B", re.DOTALL)


class OfflineModel:
    """A stand-in without a network: compares lengths of texts, deterministically."""

    def generate(self, messages: list[list[dict]]) -> list[str]:
        out = []
        for m in messages:
            a, b, c, d = map(len, QUESTION.match(m[-1]["content"]).groups())
            out.append(f'Sure: {{"reasoning": "by length", "is_ab_less_than_cd": {"true" if abs(a - b) < abs(c - d) else "false"}}} done')
        return out


def judgement(response: str | None) -> tuple[str, bool] | None:
    """(reasoning, answer) of a reply that parse_response() takes: the object from the first brace on, with a text and a truth value under the
    two names."""
    try:
        found, _ = json.JSONDecoder().raw_decode(response[response.index("{") :])
        said = found["reasoning"], found["is_ab_less_than_cd"]
    except (ValueError, AttributeError, TypeError, KeyError):
        return None
    return said if isinstance(said[0], str) and isinstance(said[1], bool) else None


def with_key(quads: DataFrame) -> DataFrame:
    return quads.withColumn("key", cache_key(F.col("a"), F.col("b"), F.col("c"), F.col("d")))


def pending(quads: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """One row per key of quads (a, b, c, d, key) that the cache doesn't know."""
    once = quads.groupBy("key").agg(F.min(F.struct(*"abcd")).alias("one")).select("key", "one.*")
    return once if cache is None else once.join(cache.select("key"), "key", "left_anti")


ANSWER = "key string, reasoning string, answer boolean"
#: Errors of a client that are worth another try after a while.
PASSING = (ConnectionError, TimeoutError)


class Counters:
    """What a run of questions has cost: calls of the model, questions in them, calls that were repeated, answers. Accumulators of the session;
    calls of attempts that failed count too, as they have been made."""

    NAMES = ("calls", "questions", "repeated", "answers")

    def __init__(self, spark: SparkSession) -> None:
        self.of = {n: spark.sparkContext.accumulator(0) for n in self.NAMES}

    def add(self, name: str, n: int = 1) -> None:
        self.of[name].add(n)

    def as_dict(self) -> dict[str, int]:
        return {n: a.value for n, a in self.of.items()}


class Pool:
    """A client in a task: at most `concurrency` calls are open at once, each with up to `batch` questions. A call that fails in passing or whose
    answers don't parse is made again, after a wait that doubles. A client with a coroutine `agenerate` is awaited, others run in
    threads."""

    def __init__(self, client, *, batch: int, concurrency: int, retries: int, wait: float, counters: Counters | None) -> None:
        self.client, self.batch, self.concurrency, self.retries, self.wait, self.counters = client, batch, concurrency, retries, wait, counters

    def _count(self, name: str, n: int = 1) -> None:
        if self.counters:
            self.counters.add(name, n)

    async def _answers(self, open_calls: asyncio.Semaphore, messages: list[list[dict]]) -> list[tuple[str, bool]]:
        async with open_calls:
            for turn in range(self.retries + 1):
                self._count("calls")
                self._count("questions", len(messages))
                try:
                    if hasattr(self.client, "agenerate"):
                        said = await self.client.agenerate(messages)
                    else:
                        said = await asyncio.to_thread(self.client.generate, messages)
                    found = [*map(judgement, said)]
                    if len(found) == len(messages) and all(x is not None for x in found):
                        return found
                except PASSING:
                    if turn == self.retries:
                        raise
                if turn < self.retries:
                    self._count("repeated")
                    await asyncio.sleep(self.wait * 2**turn)
        raise RuntimeError("the model gave no usable answers")

    def run(self, questions: Iterator[tuple[str, list[dict]]]) -> Iterator[list[tuple[str, str, bool]]]:
        """(key, reasoning, answer) of (key, messages), a call's worth at a time, as calls end. What has been answered when a call fails is
        given out before the error is raised."""
        loop = asyncio.new_event_loop()
        loop.set_default_executor(ThreadPoolExecutor(self.concurrency))
        open_calls, keys, failed = asyncio.Semaphore(self.concurrency), {}, None
        try:
            while not failed:
                part = [*islice(questions, self.batch)]
                if part:
                    task = loop.create_task(self._answers(open_calls, [m for _, m in part]))
                    keys[task] = [k for k, _ in part]
                if not keys:
                    break
                if part and len(keys) < self.concurrency:
                    continue
                done, _ = loop.run_until_complete(asyncio.wait(keys, return_when=asyncio.FIRST_COMPLETED if part else asyncio.ALL_COMPLETED))
                for task in done:
                    own = keys.pop(task)
                    if task.exception():
                        failed = task.exception()
                        continue
                    self._count("answers", len(own))
                    yield [(k, *x) for k, x in zip(own, task.result())]
            if failed:
                for task, own in [*keys.items()]:
                    loop.run_until_complete(asyncio.wait([task]))
                    if not task.exception():
                        self._count("answers", len(own))
                        yield [(k, *x) for k, x in zip(own, task.result())]
                raise failed
        finally:
            loop.run_until_complete(loop.shutdown_default_executor())
            loop.close()


class Log:
    """The answers of one partition of a run, in Parquet files of the cache: a file after `flush` answers, or after `interval` seconds
    with some. What an earlier attempt of the partition has written isn't asked again."""

    def __init__(self, path: str, run: str, flush: int, interval: float) -> None:
        from pyspark import TaskContext

        self.files, root = reach(path)
        self.folder, self.part = f"{root}/run={run}", f"part-{TaskContext.get().partitionId():05}-"
        self.flush_at, self.interval, self.held, self.since = flush, interval, [], time.monotonic()
        self.files.create_dir(self.folder, recursive=True)

    def earlier(self) -> list[tuple[str, str, bool]]:
        found = [f.path for f in self.files.get_file_info(pa.fs.FileSelector(self.folder)) if f.base_name.startswith(self.part)]
        return [(r["key"], r["reasoning"], r["answer"]) for path in found for r in pq.read_table(path, filesystem=self.files, partitioning=None).to_pylist()]

    def add(self, answers: list[tuple[str, str, bool]]) -> None:
        self.held += answers
        if len(self.held) >= self.flush_at or time.monotonic() - self.since >= self.interval:
            self.flush()

    def flush(self) -> None:
        """A file appears as a whole or not at all; readers leave out names that start with a dot."""
        self.since = time.monotonic()
        if not self.held:
            return
        name, commit = f"{self.part}{uuid.uuid4().hex}.parquet", commit_name()
        rows = pa.table({**{c: pa.array(v) for c, v in zip(("key", "reasoning", "answer"), zip(*self.held))}, "commit": [commit] * len(self.held)})
        pq.write_table(rows, f"{self.folder}/.{name}", filesystem=self.files)
        self.files.move(f"{self.folder}/.{name}", f"{self.folder}/{name}")
        self.held = []


def commit_name() -> str:
    return f"{time.time_ns():020}-{uuid.uuid4().hex}"


def reach(path: str):
    """(file system, path in it) by which Python reaches a folder; an error where it can't."""
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


def ask(questions: DataFrame, model: Callable[[], ChatModel], *, batch: int = 16, concurrency: int = 4, tasks: int | None = 1, retries: int = 2, wait: float = 0.5, counters: Counters | None = None, log: str | None = None, run: str = "", flush: int = 1000, interval: float = 5.0) -> DataFrame:
    """key, reasoning, answer of questions (key, a, b, c, d): in `tasks` partitions, each with `concurrency` calls of up to `batch` questions
    open at once; tasks=None lets Spark deal them out by their size, for models that bear any number of calls. With a log, answers are written there by flush and interval, under the name of the run, and an attempt that starts anew goes on from them.
    Every evaluation of the result asks: cached_compare() evaluates it once."""
    dealt = questions.repartition("key") if tasks is None else questions.repartition(tasks, "key")
    asked = dealt.select("key", prompt(*map(F.col, "abcd")).alias("messages"))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        written = Log(log, run, flush, interval) if log else None
        known = {k: (r, x) for k, r, x in written.earlier()} if written else {}
        frame = lambda rows: pd.DataFrame(rows, columns=["key", "reasoning", "answer"])
        if known:
            yield frame([(k, *x) for k, x in known.items()])
        pool = Pool(model(), batch=batch, concurrency=concurrency, retries=retries, wait=wait, counters=counters)
        open_questions = ((k, [{"role": m["role"], "content": m["content"]} for m in x]) for f in frames for k, x in zip(f["key"], f["messages"]) if k not in known)
        try:
            for answers in pool.run(open_questions):
                if written:
                    written.add(answers)
                yield frame(answers)
        finally:
            if written:
                written.flush()

    return asked.mapInPandas(work, ANSWER)


def cached_compare(quads: DataFrame, model: Callable[[], ChatModel], cache: DataFrame | str | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(quads with reasoning and answer, what was newly asked). Equal questions are asked once and answered everywhere.

    The model is asked in one job, whose answers are a table before anything reads them. cache: known answers, or the folder of a
    cache, to which answers go while they come; a job that fails, or a task that starts anew, asks nothing again that has been
    written there. Where several writers answer a question, each returns the first
    commit that is there when it reads, and from then on all do."""
    keyed = with_key(quads)
    if not isinstance(cache, str):
        new = table(ask(pending(keyed, cache), model, **options), "answers")
        known = new if cache is None else cache.select("key", "reasoning", "answer").unionByName(new)
        return keyed.join(known, "key"), new
    new = table(ask(pending(keyed, read_cache(quads.sparkSession, cache)), model, log=cache, run=uuid.uuid4().hex, **options), "answers")
    return keyed.join(table(read_cache(quads.sparkSession, cache), "known"), "key"), new


def cache_counts(keyed: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """One row: of quads with key, how many the cache answers (hits), how many it doesn't (misses), and how many different
    questions these are (asked)."""
    known = F.lit(False) if cache is None else F.col("known").isNotNull()
    rows = keyed.select("key") if cache is None else keyed.select("key").join(cache.select("key", F.lit(1).alias("known")), "key", "left")
    return rows.agg(F.count_if(known).alias("hits"), F.count_if(~known).alias("misses"), F.count_distinct(F.when(~known, F.col("key"))).alias("asked"))


def upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with what it didn't know; the first answer of a key stays."""
    return cache.unionByName(new.join(cache.select("key"), "key", "left_anti"))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """key, reasoning, answer of a cache folder; none if it isn't there. Of several commits of a key the first counts."""
    try:
        found = spark.read.option("mergeSchema", True).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], ANSWER)
    commit = F.coalesce("commit", F.lit("")) if "commit" in found.columns else F.lit("")
    first = found.groupBy("key").agg(F.min(F.struct(commit.alias("commit"), "reasoning", "answer")).alias("one"))
    return first.select("key", "one.reasoning", "one.answer")


def append_to_cache(path: str, new: DataFrame) -> None:
    """Commit answers whose keys the cache at path doesn't hold; a missing cache is made. Of two writers that commit a key at
    once, both commits stay and readers take the first."""
    new = new.join(read_cache(new.sparkSession, path).select("key"), "key", "left_anti").dropDuplicates(["key"])
    new.select("key", "reasoning", "answer", F.lit(commit_name()).alias("commit")).write.parquet(f"{path}/run={uuid.uuid4().hex}")


def compact_cache(spark: SparkSession, path: str) -> None:
    """One commit in place of all: of each key the first, under its own commit. Commits made meanwhile stay. Not while others read."""
    files, place = storage._files(spark, path)
    old = [f.getPath() for f in files.listStatus(place)]
    found = spark.read.option("mergeSchema", True).parquet(*[p.toString() for p in old]) if old else None
    if found is None:
        return
    commit = F.coalesce("commit", F.lit("")) if "commit" in found.columns else F.lit("")
    first = found.groupBy("key").agg(F.min(F.struct(commit.alias("commit"), "reasoning", "answer")).alias("one"))
    first.select("key", "one.reasoning", "one.answer", "one.commit").write.parquet(f"{path}/run={uuid.uuid4().hex}")
    for p in old:
        files.delete(p, True)
