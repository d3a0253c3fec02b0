"""Labelled text rows and their vectors, from whatever files Spark reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import LABEL_FIELDS, OUT_OF_SCOPE, TEXT_FIELDS, infer_field, join_fields, label_name, normalize_label
from ..functions.vectors import finite
from ..storage import number_rows, rank_rows, table

#: Columns of a text row: pos is the place in the source before any filter, from 0 without gaps.
COLUMNS = ("id", "pos", "text", "label", "label_name", "metadata")
#: Names of the two known datasets.
INTENT_NAMES = ("clinc", "clinc150", "clinc_150", "clinc_oos")
ONTOLOGY_NAMES = ("dbpedia", "dbpedia_14", "dbpedia_ontology")


def text_rows(raw: DataFrame, *, text_fields: Sequence[str] = (), label_field: str | None = None, id_field: str | None = None, pos_field: str | None = None, label_names: Sequence[str] = (), drop_labels: Sequence[str] = (), provenance: dict[str, str] | None = None) -> DataFrame:
    """COLUMNS of a raw table. Fields are inferred where none is named; other columns and the
    provenance become metadata.

    Without pos_field rows are numbered from 0 in the order of the source. The id is the id field, else the column `id`, else the
    place; a null id is the place too. Labels are dropped by normalised name, after numbering."""
    fields = list(text_fields) or [infer_field(raw.columns, TEXT_FIELDS)]
    label_field = label_field or infer_field(raw.columns, LABEL_FIELDS)
    missing = [f for f in [*fields, label_field, *([id_field] if id_field else [])] if f not in raw.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}")
    rest = [c for c in raw.columns if c not in {*fields, label_field, id_field, pos_field}]
    id_field = id_field or ("id" if "id" in rest else None)
    said = provenance or {}
    pairs = [x for c in rest if c not in said for x in (F.lit(c), F.col(f"`{c}`").cast("string"))] + [x for k, v in said.items() for x in (F.lit(k), F.lit(v).cast("string"))]
    numbered = raw.withColumn("_pos", F.col(pos_field).cast("long")) if pos_field else number_rows(raw, "_pos")
    place = F.col("_pos").cast("string")
    ids = F.coalesce(F.col(f"`{id_field}`").cast("string"), place) if id_field else place
    rows = numbered.select(F.col("_pos").alias("pos"), ids.alias("id"), join_fields(*[F.col(f"`{f}`") for f in fields]).alias("text"), F.col(f"`{label_field}`").cast("string").alias("label"), label_name(F.col(f"`{label_field}`"), label_names).alias("label_name"), (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("metadata"))
    if drop_labels:
        gone = [x.lower().strip().replace("-", "_").replace(" ", "_") for x in drop_labels]
        rows = rows.where(~F.coalesce(normalize_label(F.col("label_name")).isin(gone), F.lit(False)))
    return rows.select(*COLUMNS)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, ORC, JSON lines or CSV with a header, by the path's ending; Parquet otherwise."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("json", "jsonl"):
        return spark.read.json(path)
    if kind in ("csv", "tsv"):
        return spark.read.csv(path, header=True, sep="\t" if kind == "tsv" else ",")
    return spark.read.orc(path) if kind == "orc" else spark.read.parquet(path)


def read_first(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The first path that can be read; all errors if none can."""
    errors = []
    for path in paths:
        try:
            return read_any(spark, path)
        except Exception as e:  # noqa: BLE001  the reader's own errors differ by format
            errors.append(f"{path}: {str(e).splitlines()[0]}")
    raise RuntimeError("no source can be read: " + "; ".join(errors))


def load_intents(spark: SparkSession, paths: Sequence[str], *, remove_oos: bool = True, **options) -> DataFrame:
    """Labelled intents; out-of-scope ones go unless they are to stay. label_names give numbered labels their names."""
    return text_rows(read_first(spark, paths), drop_labels=OUT_OF_SCOPE if remove_oos else (), **options)


def load_ontology(spark: SparkSession, paths: Sequence[str], **options) -> DataFrame:
    return text_rows(read_first(spark, paths), text_fields=("title", "content"), label_field="label", **options)


def is_ontology(name: str) -> bool:
    return name.lower().replace("-", "_") in ONTOLOGY_NAMES


def load_dataset(spark: SparkSession, name: str, paths: Sequence[str], **options) -> DataFrame:
    """Text rows of a known dataset. remove_oos holds for intents only and is an error elsewhere."""
    if is_ontology(name):
        return load_ontology(spark, paths, **options)
    if name.lower().replace("-", "_") in INTENT_NAMES:
        return load_intents(spark, paths, **options)
    raise ValueError(f"unknown dataset {name}")


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """id, pos, label, label_name, embedding of a table of vectors; its ids serve as texts. Rows whose vector
    is null or not finite are refused here, since comparisons of NaN differ between engines."""
    raw = spark.read.parquet(path)
    return raw.where(finite(F.col("embedding"))).select(F.col("vec_id").cast("string").alias("id"), F.col("vec_id").alias("pos"), "label", F.concat(F.lit("class_"), F.col("label").cast("string")).alias("label_name"), "embedding")


def at_index(rows: DataFrame, index: int) -> DataFrame:
    """The row at a place among the rows (pos), counted from 0: after any filter. No row if there are fewer."""
    return rank_rows(rows, "pos", "id", name="_index").where(F.col("_index") == index + 1).drop("_index")


def text_key(text: Column | str) -> list[Column]:
    """128 bits that texts are looked up by; whoever compares them compares the texts as well."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("text"), text).alias("k2")]


def first_by_text(rows: DataFrame) -> DataFrame:
    """One row per text: that of the smallest pos. Partial aggregation keeps hot texts small."""
    others = [c for c in rows.columns if c not in ("text", "pos", "id")]
    return rows.groupBy("text").agg(F.min(F.struct("pos", "id", *[c for c in others if c != "metadata"])).alias("first")).select("text", "first.*")


def dictionary(rows: DataFrame) -> DataFrame:
    """k1, k2, text, embedding: one vector for each text of rows (text, pos, id, embedding), that of its first place. A table, so that comparators
    share it and a hot text on the other side of a join can be split."""
    return table(first_by_text(rows.select("text", "pos", "id", "embedding")).select(*text_key("text"), "text", "embedding"), "dictionary")


def shared_vectors(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """rows (text, pos, id, embedding) in which equal texts have one vector, that of the first place (of `known`, if a dictionary is given; a
    text that isn't in it is an error). Keys are joined, texts decide."""
    known = dictionary(rows) if known is None else known
    right = known.select("k1", "k2", F.col("text").alias("_text"), F.col("embedding").alias("_vector"), F.lit(1).alias("_k"))
    keyed = rows.drop("embedding").select("*", *[k.alias(f"_{n}") for n, k in zip(("k1", "k2"), text_key("text"))])
    joined = keyed.join(right, (F.col("_k1") == right.k1) & (F.col("_k2") == right.k2) & F.col("text").eqNullSafe(F.col("_text")), "left").withColumn("_known", F.col("_k").isNotNull())
    named = F.concat(F.lit("no vector for: "), F.substring(F.coalesce("text", F.lit("null")), 1, 80))
    kind = dict(known.dtypes)["embedding"]
    return joined.withColumn("embedding", F.when(F.col("_known"), F.col("_vector")).otherwise(F.raise_error(named).cast(kind))).drop("k1", "k2", "_k1", "_k2", "_text", "_vector", "_k", "_known")


def with_vectors(rows: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """rows with the embedding of their key; a key without vector is an error that names it."""
    joined = rows.join(vectors.select(key, "embedding"), key, "left")
    named = F.concat(F.lit("no vector for: "), F.substring(F.coalesce(F.col(key).cast("string"), F.lit("null")), 1, 80))
    return joined.withColumn("embedding", F.coalesce("embedding", F.raise_error(named).cast("array<float>")))
