"""Audit and access events as rows, and as JSON lines with sorted keys, nested ones too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canary
from .admission import audit_client_key


def json_line(**fields: Column) -> Column:
    """One JSON object; keys in order, nulls kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def stamp(ts: Column) -> Column:
    """ISO 8601 in UTC with microseconds."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def detection_events(verdicts: DataFrame, include_text: bool = False) -> DataFrame:
    """request_id, line: the decision on each request (columns of ``plans.screening.verdicts``, latency_ms, ts)."""
    fields = {
        "event": F.lit("detection"), "request_id": F.col("request_id"), "stage": F.col("stage"), "action": F.col("action"),
        "reason": F.col("reason"), "latency_ms": F.bround("latency_ms", 2), "ts": stamp(F.col("ts")),
        "scores": F.struct(F.col("fast.categories").alias("categories"), F.bround(F.col("fast.score"), 4).alias("score")),
    }
    if include_text:
        value = F.col("value") if "value" in verdicts.columns else F.lit(None).cast("string")
        fields["text"] = canary.scrub(F.col("user_text"), value)
    return verdicts.select("request_id", json_line(**fields).alias("line"))


def access_events(log: DataFrame, *kept: str) -> DataFrame:
    """event, method, path, status, duration_ms, client_key of a request log with headers, after the columns ``kept``."""
    return log.select(
        *kept, F.lit("access").alias("event"), "method", "path", "status", F.bround(F.col("duration_ms").cast("double"), 2).alias("duration_ms"),
        audit_client_key(F.col("headers")).alias("client_key"),
    )


def write_lines(lines: DataFrame, path: str) -> None:
    """Appends the JSON lines; a task's file is there whole or not at all."""
    lines.select("line").write.mode("append").text(path)
