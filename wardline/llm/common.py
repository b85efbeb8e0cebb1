"""What the training-data operators share: reading, column hygiene, lineage cuts."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table ``name`` under ``sf_dir``; the path is only ever opened by Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that setting is absent and driver and executors are one process (tests) a local folder is made.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.conf.get("wardline.shared.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not re.match(r"local($|\[)", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
        where = os.path.join(tempfile.gettempdir(), f"wardline-{uuid.uuid4().hex}")
        spark.conf.set("wardline.shared.dir", where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that a lost executor costs nothing."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder (compact: for results wider than a few longs)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._wardline_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes the table behind a DataFrame that :func:`written` has given; others are left alone."""
    path = getattr(df, "_wardline_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def col(df: DataFrame, name: str, kind: str) -> Column:
    """The column called exactly ``name`` (clashing case variants do not matter), or a typed null."""
    for field in df.schema.fields:
        if field.name == name:
            return df[f"`{name}`"].cast(kind)
    return F.lit(None).cast(kind)


def narrowed(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, by position, cast; extra columns and clashing names fall away.

    A table may hold the same name twice or in several spellings; the first exact match counts.
    """
    names = [f.name for f in df.schema.fields]
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.select(
        *[
            (F.col(f"c{names.index(n)}") if n in names else F.lit(None)).cast(kind).alias(n)
            for n, kind in kinds.items()
        ]
    )


def rows_schema(**kinds: str) -> T.StructType:
    out = T.StructType()
    for name, kind in kinds.items():
        out = out.add(name, T._parse_datatype_string(kind))
    return out


def listed(spark: SparkSession, rows: list[tuple], **kinds: str) -> DataFrame:
    """A small table of rows that the driver holds.

    They go as Arrow: plain rows would pass Python workers of another kind, a daemon and its workers more on each executor.
    """
    schema = rows_schema(**kinds)
    fields = to_arrow_schema(schema)
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)
    return spark.createDataFrame(table, schema)


#: Bytes of one Arrow batch, about (a row that is longer makes a batch of its own).
BATCH_BYTES = 8 << 20


def arrow_size(spark: SparkSession, rows: int) -> None:
    """Rows and bytes in one Arrow batch, for the plans of this session from here on: bounds what a Python worker holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: What this worker process remembers from task to task, by operator; of one operator at a time.
_REMEMBERED: dict[str, dict] = {}


def remembered(operator: str) -> dict:
    """What this worker remembers for ``operator``.  What others had it remember goes: stages follow one another in the same workers."""
    if operator not in _REMEMBERED:
        _REMEMBERED.clear()
        trimmed()
    return _REMEMBERED.setdefault(operator, {})


def trimmed() -> None:
    """Gives a worker's freed memory back: workers wait for their next task beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to give back
        pass
