"""Weighted pattern scoring: hits, gating, quote demotion, noisy-OR, thresholds.

Every pattern is one native ``rlike``; gating and the score are array expressions.  Texts whose verdict
depends on where a match stands (a hit and a quote character) or on Python's character classes go through
the Arrow kernel as well; for all others its input is null.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.patterns import FOLDED, KERNEL_ONLY, REGISTRY, STEMS
from ..settings import FastPath

HITS = "array<struct<pattern_id:string,snippet:string,start:int,end:int,demoted:boolean>>"

_QUOTE = "[\"“«‘`']"
_SPACED = r"(?iuU)(?:\b[a-zа-яё]\s+){4}[a-zа-яё]"
_ZERO = "[\u00ad\u200b\u200c\u200d\u2060\ufeff]"
_SPACES = r"[\x1C-\x1F]"  # white space to Python, not to Java


_CYRILLIC = "[\u0400-\u04FF]"


def folded(text: Column) -> Column:
    """Lower case, as :func:`raw_hits` looks for stems."""
    return F.lower(F.translate(text, *FOLDED))


def raw_hits(text: Column, low: Column | None = None) -> Column:
    """Ids of the patterns that match somewhere, in registry order, without the kernel-only ones.

    A pattern's expression runs only on texts that hold one of its stems; ``low``, if given, is ``folded(text)``.
    """
    low = folded(text) if low is None else low

    def hit(p) -> Column:
        stems = [F.contains(low, F.lit(s)) for s in STEMS.get(p.id, ())]
        if p.id.startswith("obf_mixed_script"):
            stems = [text.rlike(_CYRILLIC)]
        some = stems[0]
        for s in stems[1:]:
            some = some | s
        return F.when(some & text.rlike(p.java), F.lit(p.id))

    return F.array_compact(F.array(*[hit(p) for p in REGISTRY if p.id not in KERNEL_ONLY]))


def _names(ids) -> Column:
    return F.array(*[F.lit(i) for i in ids]) if ids else F.array().cast("array<string>")


def gated(ids: Column) -> Column:
    """The hits whose required tags some raw hit carries (a gated or demoted hit lends its tags too)."""
    out = ids
    for tag in sorted({t for p in REGISTRY for t in p.requires}):
        lends = F.arrays_overlap(ids, _names([p.id for p in REGISTRY if tag in p.tags]))
        needs = _names([p.id for p in REGISTRY if tag in p.requires])
        out = F.when(lends, out).otherwise(F.array_except(out, needs))
    return out


def noisy_or(weights: Column) -> Column:
    """1 - prod(1 - w), in order, weights and result clamped to [0, 1]."""

    def fold(c: Column, w: Column) -> Column:
        w = F.least(F.greatest(w, F.lit(0.0)), F.lit(1.0))
        return F.lit(1.0) - (F.lit(1.0) - c) * (F.lit(1.0) - w)

    return F.least(F.greatest(F.aggregate(weights, F.lit(0.0), fold), F.lit(0.0)), F.lit(1.0))


def weights_of(ids: Column) -> Column:
    table = F.create_map(*[x for p in REGISTRY for x in (F.lit(p.id), F.lit(p.weight))])
    return F.transform(ids, lambda i: table[i])


def categories_of(ids: Column) -> Column:
    table = F.create_map(*[x for p in REGISTRY for x in (F.lit(p.id), F.lit(p.category))])
    return F.array_sort(F.array_distinct(F.transform(ids, lambda i: table[i])))


def decision(score: Column, block: float, warn: float) -> Column:
    return F.when(score >= block, "block").when(score >= warn, "warn").otherwise("allow")


def _scan(text: Column) -> Column:
    keys = ("pattern_id", "snippet", "start", "end", "demoted")

    @F.pandas_udf(HITS)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(keys, h, strict=True)) for h in kernels.scan(t)] if isinstance(t, str) else None for t in texts])

    return run(text)


def _needs_kernel(text: Column, raw: Column) -> Column:
    quoted = (F.size(raw) > 0) & text.rlike(_QUOTE)
    return F.coalesce(quoted | text.rlike(_SPACED) | text.rlike(_ZERO) | text.rlike(_SPACES), F.lit(False))


def all_hits(text: Column) -> Column:
    """Ids of all patterns that match somewhere, in registry order: native ones, and the kernel's where it must judge."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([kernels.raw(t) if isinstance(t, str) else None for t in texts])

    plain = F.coalesce(text, F.lit(""))
    native = raw_hits(plain)
    return F.coalesce(run(F.when(_needs_kernel(plain, native), plain)), native)


def scored(df: DataFrame, text: str, settings: FastPath = FastPath(), evidence: bool = False) -> DataFrame:
    """Adds ``fast``: struct(score, action, categories, pattern_ids, demoted_ids [, hits]).

    ``evidence`` sends every text with a hit through the kernel, for snippets and spans.
    """
    plain = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_low", folded(plain)).withColumn("_raw", raw_hits(plain, F.col("_low")))
    wanted = _needs_kernel(plain, F.col("_raw"))
    if evidence:
        wanted = wanted | (F.size("_raw") > 0)
    df = df.withColumn("_hits", _scan(F.when(wanted, plain)))
    df = df.withColumn("_ids", F.coalesce(F.transform("_hits", lambda h: h["pattern_id"]), gated(F.col("_raw"))))
    off = F.transform(F.filter("_hits", lambda h: h["demoted"]), lambda h: h["pattern_id"])
    df = df.withColumn("_off", F.coalesce(off, F.array().cast("array<string>")))
    df = df.withColumn("_on", F.array_except("_ids", "_off"))
    df = df.withColumn("_score", noisy_or(weights_of(F.col("_on"))))
    parts = [
        F.col("_score").alias("score"),
        decision(F.col("_score"), settings.block_threshold, settings.warn_threshold).alias("action"),
        categories_of(F.col("_on")).alias("categories"),
        F.col("_ids").alias("pattern_ids"),
        F.col("_off").alias("demoted_ids"),
    ]
    if evidence:
        parts.append(F.coalesce("_hits", F.array().cast(HITS)).alias("hits"))
    return df.withColumn("fast", F.struct(*parts)).drop("_low", "_raw", "_hits", "_ids", "_off", "_on", "_score")


def reason(fast: Column, settings: FastPath = FastPath()) -> Column:
    named = F.when(F.size(fast["categories"]) > 0, F.array_join(fast["categories"], ", ")).otherwise("none")
    return F.format_string(
        f"Fast path score=%.2f, action=%s (thresholds block={settings.block_threshold:.2f}/warn={settings.warn_threshold:.2f}; categories: %s)",
        fast["score"], fast["action"], named,
    )
