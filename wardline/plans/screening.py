"""The cascade: normalization, pattern scoring, model scoring, verdict, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import model as deep_path
from ..operators import normalize, score
from ..settings import Settings
from ..sources import requests

# HTTP outcomes.
STATUS = {"pass": 200, "policy_block": 403, "body_too_large": 413, "rate_limited": 429, "leak_detected": 502, "bad_gateway": 502}


MESSAGES = {
    "policy_block": "Request blocked",
    "body_too_large": "Request body exceeds the limit",
    "rate_limited": "Rate limit exceeded, retry later",
    "leak_detected": "Response withheld: it repeated a protected token",
    "bad_gateway": "Upstream request failed",
}


def error_body(kind: str, message: Column | None = None) -> Column:
    """The JSON body of an error response."""
    told = F.lit(MESSAGES[kind]) if message is None else F.coalesce(message, F.lit(MESSAGES[kind]))
    return F.to_json(F.struct(F.struct(told.alias("message"), F.lit(kind).alias("type"), F.lit(STATUS[kind]).alias("code")).alias("error")))


def cleaned_messages(messages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Messages (request_id, msg_idx, part_idx, role, part_type, text) with cleaned and findings.

    Every text part of a user message is cleaned, whatever its type.
    """
    return normalize.normalize_messages(messages, settings.normalization)


def verdicts(messages: DataFrame, settings: Settings = Settings(), scorer: deep_path.Scorer | None = None, shadow: bool = False) -> DataFrame:
    """One row a request: user_text (cleaned), findings, fast, deep, action, stage, reason, changed.

    The model sees only rows that the patterns did not block; with ``shadow`` it scores all of them, and the
    verdict stays what it would be.
    """
    rows = cleaned_messages(messages, settings)
    user = F.col("role") == "user"
    spoken = user & (F.col("part_type") == "text") & F.col("text").isNotNull()
    place = [F.col("msg_idx").alias("m"), F.coalesce("part_idx", F.lit(-1)).alias("p")]
    texts = F.array_sort(F.collect_list(F.when(spoken, F.struct(*place, F.col("cleaned").alias("t")))))
    found = F.array_sort(F.collect_list(F.when(F.size("findings") > 0, F.struct(*place, F.col("findings").alias("f")))))
    one = rows.groupBy("request_id").agg(
        F.array_join(F.transform(texts, lambda x: x["t"]), "\n").alias("user_text"),
        F.flatten(F.transform(found, lambda x: x["f"])).alias("findings"),
    )
    spoke = F.col("user_text").rlike(r"(?U)\S")
    if settings.fast_path.enabled:
        one = score.scored(one, "user_text", settings.fast_path)
    else:
        one = score.scored(one.withColumn("_none", F.lit("")), "_none", settings.fast_path).drop("_none")
    normal_block = (F.size("findings") > 0) & F.lit(settings.normalization.mode == "block")
    fast_block = spoke & (F.col("fast.action") == "block") & F.lit(settings.fast_path.enabled)
    scorer = scorer if settings.deep_path.enabled or scorer is not None else None
    asked = None if shadow else ~normal_block & ~fast_block
    one = deep_path.deep_scored(one, "user_text", scorer, settings.deep_path, asked)
    deep_block = F.coalesce((F.col("deep.action") == "block") & F.col("deep.available"), F.lit(False))
    stage = F.when(normal_block, "normalization").when(fast_block, "fast_path").when(deep_block, "deep_path")
    named = F.array_join(F.array_sort(F.array_distinct(F.transform("findings", lambda f: f["category"]))), ", ")
    deep_reason = F.format_string(
        f"Deep path score=%.2f, action=%s (model={scorer.name if scorer else 'none'}; thresholds "
        f"block={settings.deep_path.block_threshold:.2f}/warn={settings.deep_path.warn_threshold:.2f})",
        F.col("deep.score"), F.col("deep.action"),
    )
    why = (
        F.when(stage == "normalization", F.concat(F.lit("Request blocked by normalization: "), named))
        .when(stage == "fast_path", score.reason(F.col("fast"), settings.fast_path)).when(stage == "deep_path", deep_reason)
    )
    return one.select(
        "request_id", "user_text", "findings", "fast", "deep", F.when(stage.isNotNull(), "block").otherwise("pass").alias("action"),
        stage.alias("stage"), why.alias("reason"), ((F.size("findings") > 0) & F.lit(settings.normalization.mode == "rewrite")).alias("changed"),
    )


def events(judged: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(request_id, stage, action, score, categories): findings, then what scored warn or block.  A warning is no verdict."""
    reached = lambda stage: ~F.coalesce(F.col("stage").isin(*stage), F.lit(False))
    found = F.array_sort(F.array_distinct(F.transform("findings", lambda f: f["category"])))
    mode = "block" if settings.normalization.mode == "block" else "warn"

    def event(stage: str, action: Column, value: Column, categories: Column) -> Column:
        return F.struct(F.lit(stage).alias("stage"), action.alias("action"), value.alias("score"), categories.alias("categories"))

    none = F.array().cast("array<string>")
    fast = (F.col("fast.action") != "allow") & F.lit(settings.fast_path.enabled) & reached(["normalization"])
    deep = F.col("deep.available") & (F.col("deep.action") != "allow") & reached(["normalization", "fast_path"])
    listed = F.array_compact(
        F.array(
            F.when(F.size("findings") > 0, event("normalization", F.lit(mode), F.lit(None).cast("double"), found)),
            F.when(fast, event("fast_path", F.col("fast.action"), F.bround("fast.score", 4), F.col("fast.categories"))),
            F.when(deep, event("deep_path", F.col("deep.action"), F.bround("deep.score", 4), none)),
        )
    )
    return judged.select("request_id", F.inline(listed))


def rewritten(messages: DataFrame, judged: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The messages to forward: of requests that pass, with cleaned texts where the mode rewrites."""
    rows = cleaned_messages(messages, settings)
    text = F.col("cleaned") if settings.normalization.mode == "rewrite" else F.col("text")
    passing = judged.where(F.col("action") == "pass").select("request_id")
    return rows.join(passing, "request_id", "left_semi").select(*[text.alias("text") if c == "text" else c for c in messages.columns])


def outcome(judged: DataFrame) -> DataFrame:
    """request_id, status and error body of the verdicts."""
    blocked = F.col("action") == "block"
    body = error_body("policy_block", F.col("reason"))
    return judged.select(
        "request_id", F.when(blocked, STATUS["policy_block"]).otherwise(STATUS["pass"]).alias("status"), F.when(blocked, body).alias("error_body")
    )


def records(judged: DataFrame, split: str = "split") -> DataFrame:
    """Evaluation records of verdicts made with ``shadow``: one row an item, without its text."""
    blocked = F.col("action") == "block"
    warned = ~blocked & ((F.col("fast.action") == "warn") | F.coalesce(F.col("deep.action") == "warn", F.lit(False)))
    return judged.select(
        F.col("request_id").alias("id"), *([split] if split in judged.columns else []),
        F.when(blocked, "block").when(warned, "warn").otherwise("allow").alias("decision"), blocked.alias("blocked"), warned.alias("warned"),
        F.col("fast.action").alias("fast_action"), F.col("fast.score").alias("fast_score"),
        F.when(F.col("deep.available"), F.col("deep.action")).alias("deep_action"), F.when(F.col("deep.available"), F.col("deep.score")).alias("deep_score"),
        (F.coalesce(F.col("deep.available"), F.lit(False)) & ~(F.coalesce(F.col("stage"), F.lit("")) == "fast_path")).alias("deep_ran_in_pipeline"),
        F.size("findings").alias("findings"),
        F.array_sort(F.array_distinct(F.transform("findings", lambda f: f["category"]))).alias("finding_categories"),
        F.coalesce("deep.char_truncated", F.lit(False)).alias("char_truncated"),
    )


def screen_requests(raw: DataFrame, settings: Settings = Settings(), scorer: deep_path.Scorer | None = None) -> DataFrame:
    """request_id, status, action, stage, reason of raw requests (request_id, body).

    Bodies over the limit are 413; bodies that are no JSON object, or hold no list of messages, pass unscreened.
    """
    from ..operators.admission import body_fits

    sized = raw.select("request_id", "body", body_fits(F.col("body"), settings.max_body_bytes).alias("fits"))
    parsed = requests.parsed(sized.withColumn("body", F.when(F.col("fits"), F.col("body"))))
    judged = verdicts(requests.messages(parsed), settings, scorer).select("request_id", "action", "stage", "reason")
    out = sized.select("request_id", "fits").join(judged, "request_id", "left")
    status = F.when(~F.col("fits"), STATUS["body_too_large"]).when(F.col("action") == "block", STATUS["policy_block"]).otherwise(STATUS["pass"])
    return out.select("request_id", status.alias("status"), F.coalesce("action", F.lit("pass")).alias("action"), "stage", "reason")
