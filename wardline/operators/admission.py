"""Admission: client keys, body limits, token buckets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import RateLimit

# Headers that identify a client, in order, and hop-by-hop headers that are not forwarded.
CREDENTIALS = ("authorization", "x-api-key", "api-key")
AUDIT_CREDENTIALS = ("authorization", "x-api-key")
HOP_BY_HOP = ("connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")
REQUEST_DROPPED = ("host", "content-length", *HOP_BY_HOP)
RESPONSE_DROPPED = (*HOP_BY_HOP, "date", "server", "content-length")


def header(headers: Column, name: str) -> Column:
    """A header by name in any case, null if absent or empty (the first of several spellings)."""
    found = F.map_filter(headers, lambda k, v: (F.lower(k) == name) & (F.coalesce(v, F.lit("")) != ""))
    return F.get(F.map_values(found), F.lit(0))


def client_key(headers: Column, host: Column) -> Column:
    """``cred:`` and 32 hexadecimal digits of the first credential's hash, else ``ip:`` and the host."""
    credential = F.coalesce(*[header(headers, h) for h in CREDENTIALS])
    address = F.coalesce(F.when(host != "", host), F.lit("unknown"))
    return F.when(credential.isNotNull(), F.concat(F.lit("cred:"), F.left(F.sha2(credential.cast("binary"), 256), F.lit(32)))).otherwise(
        F.concat(F.lit("ip:"), address)
    )


def audit_client_key(headers: Column) -> Column:
    credential = F.coalesce(*[header(headers, h) for h in AUDIT_CREDENTIALS])
    hashed = F.concat(F.lit("sha256:"), F.left(F.sha2(credential.cast("binary"), 256), F.lit(8)))
    return F.coalesce(F.when(credential.isNotNull(), hashed), F.lit("none"))


def request_headers(headers: Column) -> Column:
    return F.map_filter(headers, lambda k, v: ~F.lower(k).isin(*REQUEST_DROPPED))


def response_headers(headers: Column, keep_content_encoding: bool = False) -> Column:
    dropped = RESPONSE_DROPPED if keep_content_encoding else (*RESPONSE_DROPPED, "content-encoding")
    return F.map_filter(headers, lambda k, v: ~F.lower(k).isin(*dropped))


def body_fits(body: Column, limit: int) -> Column:
    """Exactly at the limit passes."""
    return F.octet_length(body) <= limit


def take(tokens: float, updated: float, now: float, settings: RateLimit) -> tuple[bool, float, float]:
    """(allowed, tokens left, seconds to wait) of one request; time that runs backwards refills nothing."""
    rate = settings.requests_per_minute / 60.0
    tokens = min(float(settings.burst), tokens + max(0.0, now - updated) * rate)
    if tokens >= 1.0:
        return True, tokens - 1.0, 0.0
    return False, tokens, (1.0 - tokens) / rate


def decisions(requests: DataFrame, key: str, at: str, order: str, settings: RateLimit = RateLimit()) -> DataFrame:
    """``requests`` with allowed, limit, remaining, retry_after, retry_after_header.

    A bucket starts full.  Requests of a key are taken by ``at`` (seconds), then ``order``; a partition is
    sorted and streamed, so a key's requests are never gathered.  Null keys share the bucket ``""``.
    """
    kept = requests.columns
    ready = requests.withColumn("_key", F.coalesce(F.col(key).cast("string"), F.lit(""))).withColumn("_at", F.col(at).cast("double"))
    ready = ready.repartition("_key").sortWithinPartitions("_key", "_at", order)
    schema = ", ".join(f"`{n}` {t}" for n, t in requests.dtypes) + ", allowed boolean, limit int, remaining int, retry_after double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, tokens, updated = None, 0.0, 0.0
        for pdf in batches:
            out = []
            for k, now in zip(pdf["_key"], pdf["_at"], strict=True):
                if k != current:
                    current, tokens, updated = k, float(settings.burst), now
                allowed, tokens, wait = take(tokens, updated, now, settings)
                updated = now
                out.append((allowed, settings.burst, int(tokens), wait))
            made = pd.DataFrame(out, columns=["allowed", "limit", "remaining", "retry_after"], index=pdf.index)
            yield pd.concat([pdf[kept], made], axis=1)

    done = ready.mapInPandas(run, schema)
    header_value = F.when(~F.col("allowed"), F.greatest(F.lit(1), F.ceil("retry_after").cast("int")))
    return done.withColumn("retry_after_header", header_value)


def rate_headers(decided: DataFrame) -> DataFrame:
    """Adds ``headers`` to :func:`decisions`: limit and remaining, and when to come back if refused."""
    limit, left, wait = "X-RateLimit-Limit", "X-RateLimit-Remaining", "Retry-After"
    shown = F.create_map(F.lit(limit), F.col("limit").cast("string"), F.lit(left), F.col("remaining").cast("string"))
    late = F.map_concat(shown, F.create_map(F.lit(wait), F.col("retry_after_header").cast("string")))
    return decided.withColumn("headers", F.when(F.col("allowed"), shown).otherwise(late))
