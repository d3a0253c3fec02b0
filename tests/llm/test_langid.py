"""Character models against sums over dictionaries, and languages against what they are."""

import math
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quadrille.llm import langid
from tests.conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
N = langid.ORDER


def _clean(text):
    out = []
    for c in text.lower():
        word = unicodedata.category(c)[0] in "LM"
        if word or (out and out[-1] != " "):
            out.append(c if word else " ")
    return "".join(out)


class Plain:
    """Interpolated Kneser-Ney by its formula."""

    def __init__(self, texts):
        self.counts = [Counter() for _ in range(N + 1)]
        for t in texts:
            code = chr(langid.PAD) * (N - 1) + _clean(t)
            self.counts[N].update(code[i : i + N] for i in range(len(code) - N + 1))
        for k in range(N - 1, 0, -1):
            self.counts[k].update(g[1:] for g in self.counts[k + 1])
        self.d = [None]
        for c in self.counts[1:]:
            one, two = (sum(n == x for n in c.values()) for x in (1, 2))
            self.d.append(one / (one + 2 * two) if one and two else 0.5)
        self.total, self.kinds = ([defaultdict(int) for _ in range(N + 1)] for _ in range(2))
        for k in range(1, N + 1):
            for g, n in self.counts[k].items():
                self.total[k][g[:-1]] += n
                self.kinds[k][g[:-1]] += 1

    def p(self, run, size):
        if not run:
            return 1 / size
        k, lower = len(run), self.p(run[1:], size)
        if not (total := self.total[k].get(run[:-1])):
            return lower
        back = self.d[k] * self.kinds[k][run[:-1]] / total
        return max(self.counts[k][run] - self.d[k], 0) / total + back * lower


def _training():
    rng = random.Random(2)
    words = {"aa": ["the", "and", "water", "wind", "éa"], "bb": ["der", "und", "wasser", "wind", "ß"], "cc": ["el", "agua", "viento", "ñu", "中文"]}
    return [(lang, " ".join(rng.choice(w) for _ in range(rng.randint(1, 30)))) for lang, w in words.items() for _ in range(30)] + [("aa", ""), ("aa", "12"), ("bb", "Wind, WIND!! " * 400)]


def test_entropies(spark):
    rows = _training()
    model = langid.fit_languages(spark.createDataFrame(rows, "lang string, text string").repartition(4))
    plain = {lang: Plain([t for x, t in rows if x == lang]) for lang in model.langs}
    size = len({c for p in plain.values() for c in p.counts[1]}) + 1
    texts = ["the wasser", "", None, "viento del agua", "q", "中", "42", "Wind" * 50, "ñu und  the\n\nwater é"]
    total, chars = langid.entropies(model, texts)
    for i, t in enumerate(texts):
        clean = _clean(t or "")
        assert chars[i] == len(clean)
        code = chr(langid.PAD) * (N - 1) + clean
        for j, lang in enumerate(model.langs):
            want = -sum(math.log(plain[lang].p(code[k : k + N], size)) for k in range(len(clean)))
            assert total[i, j] == pytest.approx(want, rel=1e-9, abs=1e-9)
    seen = {c for p in plain.values() for c in p.counts[1]}
    for lang, context in (("aa", "the "), ("cc", "zzzz"), ("bb", chr(langid.PAD) * 4)):
        assert sum(plain[lang].p(context + c, size) for c in seen) + plain[lang].p(context + "☃", size) == pytest.approx(1)


def test_parts_are_one_text(monkeypatch, spark):
    text = "the wind, und  wasser 12 viento " * 200
    whole = np.concatenate(list(langid.characters(text)))
    model = langid.fit_languages(spark.createDataFrame(_training(), "lang string, text string"))
    total, chars = langid.entropies(model, [text, "el"])
    for part, batch in ((7, 64), (100, 300)):
        monkeypatch.setattr(langid, "PART", part)
        monkeypatch.setattr(langid, "BATCH", batch)
        assert np.concatenate(list(langid.characters(text))).tolist() == whole.tolist()
        again, n = langid.entropies(model, [text, "el"])
        assert np.allclose(total, again) and n.tolist() == chars.tolist()
    assert "".join(map(chr, whole)) == _clean(text)


def test_rare_runs_go_first(spark):
    rows = spark.createDataFrame(_training(), "lang string, text string")
    whole, small = langid.fit_languages(rows), langid.fit_languages(rows, 200)
    assert sum(len(x[0]) for x in small.runs.values()) <= 200 < sum(len(x[0]) for x in whole.runs.values())


def test_awkward_rows(spark):
    rows = [(i, t, lang, None, 1) for i, (lang, t) in enumerate(_training() * 3)]
    rows += [(1, None, "aa", None, 1), (2, "", None, None, None), (None, "der wind", "bb", None, None), (4, "123 !", "cc", "s", 1), (5, "wasser und", None, None, 1), (6, "agua " * 200_000, None, None, 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS best", "2 AS score", "3 AS known")
    got = langid.identify(df).collect()
    assert len(got) == len(rows)
    found = {r.doc_id: r for r in got if r.doc_id is None or r.doc_id > 400}
    assert found[None].lang_pred == "bb" and found[None].held_out is False
    by = Counter((r.doc_id, r.lang_pred) for r in got)
    assert by[1, "und"] and by[2, "und"] and by[4, "und"] and by[5, "bb"] and by[6, "cc"]
    for r in got:
        assert 0 <= r.score <= 1 and (r.lang_pred != "und" or (r.score == 0 and r.rejected))
        assert r.doc_id is None or r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_nothing_to_learn(spark):
    assert langid.identify(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = langid.identify(spark.createDataFrame([(1, "text", None, None, 1), (3, None, "en", None, 1)], SCHEMA)).collect()
    assert [(r.lang_pred, r.score) for r in rows] == [("und", 0.0)] * 2


def test_held_out_accuracy(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = langid.op11_kneser_ney_language(spark, SF).collect()
    own = [r for r in got if r.held_out]
    assert len(got) == len(langs) and sum(r.lang_pred == langs[r.doc_id] for r in own) >= 0.97 * len(own)


def test_held_out_languages_are_not_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from pyspark.sql import functions as F

    changed = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit(None))
    names = ("doc_id", "lang_pred", "score", "rejected")
    assert sorted(tuple(r[c] for c in names) for r in langid.identify(docs).collect()) == sorted(tuple(r[c] for c in names) for r in langid.identify(changed).collect())


def test_rare_runs_count(spark):
    rows = [(i, t, lang, None, 1) for i, (lang, t) in enumerate(_training() * 3)]
    rows += [(501, "zzzz 中 the wasser", None, None, 1), (502, None, "aa", None, 1), (502, "12", None, None, 1), (None, "agua ñu und q", None, None, 1), (503, "wind und q " * 300, None, None, 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = [sorted(map(tuple, langid.identify(df, kept).select("doc_id", "held_out", "lang_pred", "rejected", "score", "entropy").collect()), key=str) for kept in (langid.KEPT, 200, 1)]
    assert len(found[0]) == len(rows)
    for less in found[1:]:
        for whole, row in zip(found[0], less, strict=True):
            assert row[:4] == whole[:4] and row[4] == pytest.approx(whole[4], rel=1e-6) and (row[5] or 0) == pytest.approx(whole[5] or 0, rel=1e-6)


def test_joined_log_probabilities(monkeypatch, spark):
    levels = langid.probabilities(langid.run_counts(spark.createDataFrame(_training(), "lang string, text string")))
    whole, none = langid.model_of(levels), langid.model_of(levels, 0)
    texts = ["the wasser", "", None, "zzzz 中 q", "Wind und " * 50]
    monkeypatch.setattr(langid, "BATCH", 64)
    monkeypatch.setattr(langid, "PART", 32)
    total, chars = np.zeros((len(texts), len(none.langs))), np.zeros(len(texts), dtype=np.int64)
    left = [(int(i), str(r), int(n)) for batch in langid.measure(none, texts, total, chars) for i, r, n in zip(*batch)]
    assert not total.any() and len(none.frequent[0]) == 0
    with pytest.raises(ValueError):
        langid.entropies(none, texts)
    logs = {r.run: r.logs for r in langid.log_probabilities(spark.createDataFrame([(r,) for _, r, _ in left], "run string").distinct(), levels, none).collect()}
    for i, run, n in left:
        total[i] -= n * np.array(logs[run]) / langid.UNIT
    want, count = langid.entropies(whole, texts)
    assert np.allclose(total, want, rtol=1e-7) and chars.tolist() == count.tolist()
