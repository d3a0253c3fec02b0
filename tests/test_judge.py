"""Questions are asked once: calls are counted, tasks die, writers meet, and clients see no more open calls than they may."""

import asyncio
import os
import threading
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quadrille.operators import judge
from quadrille.plans import catalog
from tests.conftest import SF

COLUMNS = "a string, b string, c string, d string"
YES = '{"reasoning": "r", "is_ab_less_than_cd": true}'


class Counting:
    """Answers yes and writes down every question."""

    def __init__(self, path, answer=True, die_at=None, fail_at=None):
        self.path, self.answer, self.die_at, self.fail_at = str(path), answer, die_at, fail_at

    def __call__(self):
        return self

    def generate(self, messages):
        seen = len(asked(self.path))
        if self.die_at is not None and seen >= self.die_at:
            os._exit(1)
        if self.fail_at is not None and seen >= self.fail_at:
            raise ValueError("broken")
        with open(self.path, "a") as f:
            f.write("".join(str(hash(m[-1]["content"])) + "\n" for m in messages))
        return [f'{{"reasoning": "{self.answer}", "is_ab_less_than_cd": {str(self.answer).lower()}}}'] * len(messages)


def asked(path):
    return open(path).read().split() if os.path.exists(path) else []


def _quads(spark, n=12):
    return spark.createDataFrame([(f"a{i % n}", "b", "c", "d") for i in range(3 * n)], COLUMNS)


def test_one_call_a_question_however_often_results_are_read(spark, tmp_path):
    quads = _quads(spark)
    found, new = judge.cached_compare(quads, Counting(tmp_path / "calls"), batch=1)
    assert found.count() == 36 and found.where("answer").count() == 36 and new.count() == 12
    judge.append_to_cache(str(tmp_path / "cache"), new)
    assert len(asked(tmp_path / "calls")) == 12
    again, none = judge.cached_compare(quads, Counting(tmp_path / "calls"), judge.read_cache(spark, str(tmp_path / "cache")))
    assert again.count() == 36 and none.count() == 0 and len(asked(tmp_path / "calls")) == 12


@pytest.mark.parametrize("how", ["die_at", "fail_at"])
def test_what_was_answered_before_a_task_died_is_not_asked_again(spark, tmp_path, how):
    quads, calls, cache = _quads(spark), tmp_path / "calls", str(tmp_path / "cache")
    with pytest.raises(Exception):
        judge.cached_compare(quads, Counting(calls, **{how: 7}), cache, batch=1, concurrency=1, flush=1)
    assert len(asked(calls)) == 7 and judge.read_cache(spark, cache).count() == 7
    found, new = judge.cached_compare(quads, Counting(calls), cache, batch=1, concurrency=1)
    assert found.count() == 36 and new.count() == 5 and Counter(asked(calls)).most_common(1)[0][1] == 1 and len(asked(calls)) == 12


def test_an_attempt_that_starts_anew_goes_on(spark, tmp_path):
    questions, calls = judge.pending(judge.with_key(_quads(spark))), tmp_path / "calls"
    options = {"log": str(tmp_path / "cache"), "run": "one", "tasks": 3, "batch": 2}
    for _ in range(2):
        assert judge.ask(questions, Counting(calls), **options).count() == 12
    assert len(asked(calls)) == 12


def test_two_writers(spark, tmp_path):
    quads, cache, results = _quads(spark), str(tmp_path / "cache"), {}

    def write(answer):
        results[answer] = judge.cached_compare(quads, Counting(tmp_path / f"calls{answer}", answer), cache, batch=3, tasks=2, flush=2)[0].collect()

    threads = [threading.Thread(target=write, args=(x,)) for x in (True, False)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert {len(r) for r in results.values()} == {36}
    whole = {r.key: (r.reasoning, r.answer) for r in judge.read_cache(spark, cache).collect()}
    assert len(whole) == 12
    judge.compact_cache(spark, cache)
    assert {r.key: (r.reasoning, r.answer) for r in judge.read_cache(spark, cache).collect()} == whole
    assert spark.read.parquet(cache).count() == 12
    found, new = judge.cached_compare(quads, Counting(tmp_path / "more", die_at=0), cache)
    assert new.count() == 0 and all((r.reasoning, r.answer) == whole[r.key] for r in found.collect())


class Open:
    """Counts the calls that are open at once."""

    def __init__(self, coroutine):
        self.now = self.most = 0
        self.lock = threading.Lock()
        if coroutine:
            self.agenerate = self._agenerate

    def _enter(self, n):
        with self.lock:
            self.now += n
            self.most = max(self.most, self.now)

    def generate(self, messages):
        self._enter(1)
        time.sleep(0.05)
        self._enter(-1)
        return [YES] * len(messages)

    async def _agenerate(self, messages):
        self._enter(1)
        await asyncio.sleep(0.05)
        self._enter(-1)
        return [YES] * len(messages)


@pytest.mark.parametrize("coroutine", [True, False])
def test_calls_that_are_open_at_once(coroutine):
    client = Open(coroutine)
    pool = judge.Pool(client, batch=2, concurrency=3, retries=0, wait=0, counters=None)
    answers = [x for part in pool.run((str(i), []) for i in range(41)) for x in part]
    assert sorted(a[0] for a in answers) == sorted(map(str, range(41))) and client.most == 3


def test_passing_errors_wait_and_others_do_not():
    class Busy:
        times = []

        def generate(self, messages):
            self.times.append(time.monotonic())
            if len(self.times) < 4:
                raise ConnectionError("busy")
            return [YES] * len(messages)

    pool = judge.Pool(Busy(), batch=4, concurrency=2, retries=3, wait=0.05, counters=None)
    assert len([x for part in pool.run(iter([("k", [])])) for x in part]) == 1
    gaps = [b - a for a, b in zip(Busy.times, Busy.times[1:])]
    assert gaps[0] >= 0.05 and gaps[1] >= 0.1 and gaps[2] >= 0.2
    Busy.times = []
    with pytest.raises(ConnectionError):
        list(judge.Pool(Busy(), batch=4, concurrency=2, retries=1, wait=0, counters=None).run(iter([("k", [])])))
    assert list(judge.Pool(Busy(), batch=4, concurrency=2, retries=1, wait=0, counters=None).run(iter([]))) == []


def test_counters_are_those_of_the_log(spark, tmp_path):
    counters, calls = judge.Counters(spark), tmp_path / "calls"
    judge.cached_compare(_quads(spark), Counting(calls), str(tmp_path / "cache"), batch=5, counters=counters)
    got = counters.as_dict()
    assert got["answers"] == got["questions"] == len(asked(calls)) == judge.read_cache(spark, str(tmp_path / "cache")).count() == 12
    assert got["calls"] == 3 and got["repeated"] == 0


def test_no_questions(spark, tmp_path):
    quads = spark.createDataFrame([], COLUMNS)
    found, new = judge.cached_compare(quads, Counting(tmp_path / "calls", die_at=0), str(tmp_path / "cache"))
    assert found.count() == new.count() == 0 and judge.read_cache(spark, str(tmp_path / "cache")).count() == 0
    judge.append_to_cache(str(tmp_path / "other"), new.withColumn("more", F.lit(1)))
    assert judge.read_cache(spark, str(tmp_path / "other")).count() == 0


def test_the_query_asks_in_as_many_tasks_as_its_questions_need(spark, monkeypatch):
    seen, plain = [], judge.ask
    monkeypatch.setattr(judge, "ask", lambda *a, **options: seen.append(options) or plain(*a, **options))
    catalog.QUERIES["oracle_cached_compare"](spark, SF)
    assert seen[0]["tasks"] is None
    monkeypatch.undo()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        questions = judge.pending(judge.with_key(_quads(spark, 100)))
        assert judge.ask(questions, judge.OfflineModel, tasks=None).select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
