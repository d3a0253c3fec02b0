"""Places of rows in sources of many files and splits, ids, and vectors by text."""

import json

import pytest
from pyspark.sql import functions as F

from quadrille import storage
from quadrille.sources import text_rows


@pytest.fixture(scope="module")
def rows():
    return [{"text": f"text number {i} " + "x" * (i % 50), "label": i % 3, "n": i} for i in range(3000)]


@pytest.fixture
def splits(spark):
    """Files are cut into splits of a few kilobytes."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("kind", ["json", "csv", "parquet", "orc"])
def test_places_of_many_files_and_splits(spark, tmp_path, splits, rows, kind):
    cuts = [0, 1200, 1210, 3000]
    folder = tmp_path / f"all.{kind}"
    folder.mkdir()
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        spark.createDataFrame(rows[a:b]).coalesce(1).write.format(kind).option("header", True).option("parquet.block.size", 20_000).save(str(tmp_path / f"part{k}"))
        file = next((tmp_path / f"part{k}").glob("part-*"))
        file.rename(folder / f"{k:03}-{file.name}")
    raw = text_rows.read_any(spark, str(folder))
    assert raw.rdd.getNumPartitions() > 3
    got = text_rows.text_rows(raw, label_names=("a", "b", "c"), drop_labels=("B",)).collect()
    assert sorted((r.pos, r.text, r.label_name, r.id) for r in got) == [(r["n"], r["text"].strip(), "ac"[r["label"] // 2], str(r["n"])) for r in rows if r["label"] != 1]
    third = text_rows.at_index(text_rows.text_rows(raw, label_names=("a", "b", "c"), drop_labels=("B",)), 1).collect()
    assert [r.pos for r in third] == [2] and text_rows.at_index(text_rows.text_rows(raw), 5000).count() == 0


def test_places_without_files(spark):
    df = spark.range(1000, numPartitions=7).withColumnRenamed("id", "n")
    assert sorted((r.pos, r.n) for r in storage.number_rows(df).collect()) == [(i, i) for i in range(1000)]
    both = df.join(df.withColumnRenamed("n", "m"), F.col("n") == F.col("m"))
    assert sorted(r.pos for r in storage.number_rows(both).collect()) == list(range(1000))
    assert storage.number_rows(df.limit(0)).count() == 0


def test_an_id_column_is_the_id(spark, tmp_path):
    lines = [{"id": "q7", "text": "a", "label": "x", "_metadata": 1}, {"id": None, "text": "b", "label": "y", "_metadata": 2}]
    (tmp_path / "rows.json").write_text("\n".join(map(json.dumps, lines)))
    raw = text_rows.read_any(spark, str(tmp_path / "rows.json"))
    got = sorted(text_rows.text_rows(raw, provenance={"text_field": "text"}).collect(), key=lambda r: r.pos)
    assert [r.id for r in got] == ["q7", "1"] and got[0].metadata["_metadata"] == "1" and got[0].metadata["text_field"] == "text"
    assert [r.id for r in text_rows.text_rows(raw, id_field="text").orderBy("pos").collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        text_rows.text_rows(raw, id_field="gone")


def test_equal_texts_share_a_vector(spark):
    rows = spark.createDataFrame([(3, "3", "same", [3.0]), (1, "1", "same", [1.0]), (2, "2", "other", [2.0]), (4, "4", None, [4.0]), (5, "5", None, [5.0]), (6, "6", "", [6.0])], "pos long, id string, text string, embedding array<double>")
    got = {r.pos: r.embedding[0] for r in text_rows.shared_vectors(rows.withColumn("k1", F.lit(0))).collect()}
    assert got == {1: 1.0, 2: 2.0, 3: 1.0, 4: 4.0, 5: 4.0, 6: 6.0}
    known = text_rows.dictionary(rows.where("pos = 2"))
    with pytest.raises(Exception, match="no vector for"):
        text_rows.shared_vectors(rows, known).collect()


def test_running_totals(spark):
    df = spark.createDataFrame([(i, i % 5) for i in range(500)], "k long, n long").repartition(6)
    got = {r.k: r.before for r in storage.running_total(df, "n", "k").collect()}
    assert got == {i: sum(j % 5 for j in range(i)) for i in range(500)}
