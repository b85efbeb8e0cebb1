"""The stages of the corpus pipeline: each takes and returns documents, the last one returns pieces.

A stage reads and returns the columns of documents: doc_id, text, lang, source, n_chars.  Others fall away
(their names may clash with anything), a missing one is null.  Every stage keeps all rows that its operator
does not reject; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard, langid, mixing, packing, pii
from .common import col, cut, narrowed

#: Ids of removed documents that are sent to every task, at most; beyond that they are joined.
SENT_ROWS = 1_000_000


COLUMNS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}


def _documents(docs: DataFrame) -> DataFrame:
    return narrowed(docs, **COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an identified language; null texts and texts without a letter (``und``) go.

    Where no row can be learned from, nothing but the letters decides.
    """
    docs = _documents(docs)
    model = langid.train(docs.select("doc_id", "text", "lang").where(langid.learnable()))
    if not model[1]:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = langid.identify(docs, model)
    return found.where(F.col("lang_pred") != "und").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the smallest doc_id.

    Rows that repeat a doc_id are one document: its first row by text.  Rows without a doc_id stay.
    """
    docs = _documents(docs)
    found = cut(jaccard.near_duplicates(docs).where(F.col("doc_id").isNotNull()))
    # a repeated doc_id stays if one of its rows leads a group
    each = found.groupBy("doc_id").agg(F.max((F.col("component_id") == F.col("doc_id")).cast("int")).alias("leads"), F.count(F.lit(1)).alias("n"))
    each = cut(each)
    gone = each.where(F.col("leads") == 0).select("doc_id")
    if gone.limit(SENT_ROWS + 1).count() <= SENT_ROWS:  # checked: 8 MB
        gone = F.broadcast(gone)
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = each.where((F.col("leads") == 1) & (F.col("n") > 1)).select("doc_id", F.lit(True).alias("_many"))
    if repeated.isEmpty():
        return kept
    marked = kept.join(repeated, "doc_id", "left")
    several = marked.where(F.col("_many")).groupBy("doc_id").agg(F.min(F.struct(F.col("text"), *[c for c in docs.columns if c not in ("doc_id", "text")])).alias("r"))
    several = several.select(*[F.col("doc_id") if c == "doc_id" else F.col(f"r.{c}").alias(c) for c in docs.columns])
    return marked.where(F.col("_many").isNull()).select(*docs.columns).unionByName(several)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced; n_chars follows."""
    out = pii.pseudonymised(_documents(docs), key=spark.conf.get(pii.SETTING, pii.KEY))
    n_chars = F.when(F.col("n_entities") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out in the order of the schedule: files and rows by slot, then place in the source."""
    placed = mixing.mixed(_documents(docs))
    ordered = placed.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place")
    return ordered.select(*COLUMNS)


def _in_order(docs: DataFrame) -> DataFrame:
    """Rows in the order they were written in: a scan sorts files by their length, their names tell the tasks' order."""
    try:
        at = docs.metadataColumn("_metadata")
        kept = docs.select(*[col(docs, n, k).alias(n) for n, k in COLUMNS.items()], at["file_name"].alias("_file"), at["row_index"].alias("_row"))
    except AnalysisException:  # not from files
        return _documents(docs)
    return kept.repartitionByRange("_file", "_row").sortWithinPartitions("_file", "_row").drop("_file", "_row")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens; windows, and so sequence ids, follow the schedule."""
    return packing.pieces(spark, _in_order(docs))
