"""Request bodies and message tables."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MESSAGES = "array<struct<role:string,content:string,kind:string,parts:array<struct<type:string,text:string>>>>"
PAYLOAD = f"struct<model:string,stream:boolean,messages:{MESSAGES}>"


def payload(body: Column) -> Column:
    """The body as VARIANT if it is one JSON object, else null.

    A body with duplicate keys is null here though it is an object to most parsers (the last one wins), so
    :func:`parsed` reads such bodies again.
    """
    made = F.try_parse_json(F.try_validate_utf8(body.cast("binary")))
    return F.when(F.schema_of_variant(made).startswith("OBJECT"), made)


def _message(m) -> dict | None:
    if not isinstance(m, dict):
        return None
    content, role = m.get("content"), m.get("role")
    out = {"role": role if isinstance(role, str) else None, "content": None, "kind": None, "parts": None}
    if isinstance(content, str):
        out |= {"content": content, "kind": "text"}
    elif isinstance(content, list):
        text = lambda p, k: p[k] if isinstance(p.get(k), str) else None
        parts = [{"type": text(p, "type"), "text": text(p, "text")} if isinstance(p, dict) else {"type": None, "text": None} for p in content]
        out |= {"kind": "parts", "parts": parts}
    return out


def _read(body) -> dict | None:
    try:
        got = json.loads(bytes(body))
    except (ValueError, TypeError, RecursionError):
        return None
    if not isinstance(got, dict):
        return None
    messages = got.get("messages")
    listed = [_message(m) for m in messages] if isinstance(messages, list) else None
    model, stream = got.get("model"), got.get("stream")
    return {"model": model if isinstance(model, str) else None, "stream": stream if isinstance(stream, bool) else None, "messages": listed}


def parsed(requests: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``payload``: model, stream, messages (null where there is no list of messages)."""
    empty = {"model": None, "stream": None, "messages": None}

    @F.pandas_udf(PAYLOAD)
    def run(bodies: pd.Series) -> pd.DataFrame:
        rows = [_read(b) if b is not None else None for b in bodies]
        return pd.DataFrame([r or empty for r in rows], columns=list(empty))

    return requests.withColumn("payload", run(F.col(body)))


def messages(requests: DataFrame) -> DataFrame:
    """request_id, msg_idx, part_idx, role, part_type, text of the parsed requests; other shapes give no rows."""
    each = requests.select("request_id", F.posexplode("payload.messages").alias("msg_idx", "m")).where(F.col("m").isNotNull())
    whole = F.array(F.struct(F.lit(None).cast("int").alias("part_idx"), F.lit("text").alias("part_type"), F.col("m.content").alias("text")))
    parts = F.transform("m.parts", lambda p, i: F.struct(i.alias("part_idx"), p["type"].alias("part_type"), p["text"].alias("text")))
    listed = F.when(F.col("m.kind") == "parts", parts).otherwise(whole)
    return each.select("request_id", "msg_idx", F.col("m.role").alias("role"), F.inline(listed)).select(
        "request_id", "msg_idx", "part_idx", "role", "part_type", "text"
    )


def user_text(rows: DataFrame, text: str = "text") -> DataFrame:
    """request_id, user_text: the text parts of all user messages, in order, joined by line feeds."""
    spoken = rows.where((F.col("role") == "user") & (F.col("part_type") == "text") & F.col(text).isNotNull())
    parts = F.array_sort(F.collect_list(F.struct("msg_idx", F.coalesce("part_idx", F.lit(-1)).alias("p"), F.col(text).alias("t"))))
    return spoken.groupBy("request_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("user_text"))


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """A table of turns (conv_id, turn, role, text) as messages."""
    return conversations.select(
        F.col("conv_id").cast("string").alias("request_id"), F.col("turn").cast("int").alias("msg_idx"),
        F.lit(None).cast("int").alias("part_idx"), "role", F.lit("text").alias("part_type"), "text",
    )
