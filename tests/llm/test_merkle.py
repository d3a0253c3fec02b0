"""The manifest against a recursive version, and against its SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from quadrille.llm import merkle
from tests.conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _h(*values):
    return hashlib.sha256("".join(values).encode()).hexdigest()


def _leaf(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def _climb(nodes):
    """(root, for each node its siblings, level by level, as (left, right))."""
    sides, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for k in range(len(nodes)):
            run, p = runs[at[k] // 16], at[k] % 16
            sides[k].append(("".join(run[:p]), "".join(run[p + 1 :])))
            at[k] //= 16
        level = [_h(*run) for run in runs]
    return level[0], sides


def _lower(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def expected(rows):
    trees = defaultdict(list)
    for r in rows:
        trees[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, _leaf(r, r["text"]), r))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for t in trees.values():
        t.sort(key=lambda x: x[:3])
    inner = {s: _climb([x[2] for x in trees[s]]) for s in names}
    root, outer = _climb([inner[s][0] for s in names])
    out = []
    for s, above in zip(names, outer):
        for (known, _, leaf, r), own in zip(trees[s], inner[s][1]):
            other = known and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            fold, path = _leaf(r, _lower(r["text"]) if other else r["text"]), own + above
            for left, right in path:
                fold = _h(left, fold, right)
            out.append((str(r["doc_id"]), leaf, inner[s][0], root, _h(*[x for p in path for x in p]), fold, fold == root))
    return sorted(out)


def _got(df):
    names = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((str(r.doc_id), *(r[c] for c in names)) for r in df.collect())


def _rows():
    rng = random.Random(3)
    rows = [(i, f"Text {i} É", "en", f"s{i % 3}" if i % 9 else None, i) for i in range(300)]
    rows += [(1000 + i, rng.choice(["", None, "AB", "é:-1"]), rng.choice(["en", None]), "big", rng.choice([None, 3])) for i in range(5000)]
    rows += [(7, "lone", None, "alone", 4), (None, None, None, None, None), (None, "no Id", "en", "big", 1), (1003, "SAME id", "en", "big", 1), (5, "x" * 200_000, "de", "", 9), (6, "Ä", "de", "ßource", 1)]
    return [*rows, rows[0], rows[0], rows[40]]


def test_brute_force(spark):
    df = spark.createDataFrame(_rows(), SCHEMA).repartition(5).selectExpr("*", "1 AS h", "2 AS i", "3 AS tree", "4 AS root")
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    assert _got(merkle.manifest(df)) == expected([dict(zip(names, r)) for r in _rows()])


@pytest.mark.parametrize("rows", [[], [(1, "Only", "en", "s", 4)], [(i, "Q", "en", "s", 1) for i in range(17)], [(i, "q", "en", f"s{i:02}", 1) for i in range(33)]])
def test_small_datasets(spark, rows):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    want = expected([dict(zip(names, r)) for r in rows]) if rows else []
    assert _got(merkle.manifest(spark.createDataFrame(rows, SCHEMA))) == want


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = merkle.op12_merkle_manifest(spark, SF)
    found = con.execute(merkle.MERKLE_SQL)
    assert [c[0] for c in found.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(found.fetchall())
