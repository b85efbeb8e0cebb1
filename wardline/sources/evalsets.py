"""Evaluation sets: item files, manifests, splits, score caches, and the checks they must pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Invalid(ValueError):
    """A file breaks a rule; the message says which rows."""


def _none(bad: DataFrame, what: str) -> None:
    some = [r[0] for r in bad.limit(5).collect()]
    if some:
        raise Invalid(f"{what}: {some}")


def items(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of a JSON-lines file; blank lines are skipped, ids must be there and be unique."""
    rows = spark.read.schema("id string, text string, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    _none(rows.where(F.col("_corrupt").isNotNull()).select(F.concat_ws(" ", "_corrupt", "id")), "not JSON")  # a column beside it: alone it cannot be read
    _none(rows.where(F.col("id").isNull() | F.col("text").isNull()).select(F.coalesce("id", F.lit("?"))), "id or text missing")
    _none(rows.groupBy("id").count().where("count > 1").select("id"), "repeated ids")
    return rows.select("id", "text")


MANIFEST = (
    "manifest_version int, frozen_at string, seed int, selection_rule string, "
    "sources map<string, struct<repo:string,config:string,split:string,revision:string,column:string>>, "
    "attack array<struct<id:string,source:string,row_index:int,tags:array<string>,text:string>>, "
    "clean array<struct<id:string,source:string,row_index:int,tags:array<string>,text:string>>"
)


def manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(items, sources): coordinates only; an entry that carries its text is refused."""
    one = spark.read.schema(MANIFEST).json(path, multiLine=True)
    entry = lambda label: one.select(F.lit(label).alias("label"), F.posexplode(label).alias("ordinal", "e")).select("label", "ordinal", "e.*")
    rows = entry("attack").unionByName(entry("clean"))
    sources = one.select(F.explode("sources").alias("source", "s")).select("source", "s.*")
    _none(rows.where(F.col("id").isNull() | F.col("source").isNull()).select(F.coalesce("id", F.lit("?"))), "id or source missing")
    _none(rows.where(F.col("text").isNotNull()).select("id"), "entries with text")
    _none(rows.groupBy("id").count().where("count > 1").select("id"), "repeated ids")
    _none(rows.where(F.col("row_index") < 0).select("id"), "negative rows")
    _none(rows.join(sources, "source", "left_anti").select("id"), "unknown sources")
    return rows.drop("text"), sources


def resolve(listed: DataFrame, rows: DataFrame) -> DataFrame:
    """The texts of a manifest's items: ``rows`` (source, row_index, text) joined on their coordinates."""
    out = listed.join(rows.select("source", "row_index", "text"), ["source", "row_index"], "left")
    _none(out.where(F.col("text").isNull()).select("id"), "items without a row")
    return out


def check_split(split: DataFrame, listed: DataFrame) -> DataFrame:
    """``split`` (id, label, subset) must cover the listed items (id, label), each once."""
    _none(split.groupBy("id").count().where("count > 1").select("id"), "items in two subsets")
    _none(split.join(listed, ["id", "label"], "left_anti").select("id"), "items that are not listed")
    _none(listed.join(split, ["id", "label"], "left_anti").select("id"), "items without a subset")
    return split


def head(listed: DataFrame, attacks: int | None = None, clean: int | None = None) -> DataFrame:
    """The first items of each label in the manifest's order."""
    out = listed
    for label, n in (("attack", attacks), ("clean", clean)):
        if n is not None:
            out = out.where((F.col("label") != label) | (F.col("ordinal") < n))
    return out


def write_scores(scores: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").parquet(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
