"""Normalization of message texts: Unicode cleanup, decoding, delimiter neutralization.

A native guard tells which texts can change at all; only those reach the Arrow function, the rest of a
column passes as nulls.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..settings import Normalization

FINDINGS = "array<struct<category:string,description:string,positions:array<struct<start:int,end:int>>,preview:string>>"
RESULT = f"struct<cleaned:string,findings:{FINDINGS}>"

ROT13_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ROT13_TO = "NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm"

_TOKENS = "|".join("".join("\\" + c if not c.isalnum() else c for c in t) for t in kernels.TOKENS)
_LABELS = "|".join(kernels.LABELS)
_LINE = rf"(?m)^\s*(?:[#*\->]{{0,8}}\s*(?:{_LABELS})\s*:|#+\s*(?:{_LABELS})\s*:?\s*$)"
_BLOB = r"[A-Za-z0-9+/_-]{12}"
_RUN_MARKERS = "|".join(m for m in kernels.MARKERS if m.isalpha())


def _stable() -> str:
    """A class of the characters that no step of Unicode cleanup touches, alone or in any row of them.

    From Python's tables, over the ranges of European scripts and their punctuation: kept by NFKC, no combining
    mark (which could join the letter before it), no control or format character.
    """
    kept = [0x09, 0x0A, *range(0x20, 0x7F)]
    for point in (*range(0xA0, 0x530), *range(0x2010, 0x2060), *range(0x20A0, 0x20C0)):
        c = chr(point)
        if unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c) and unicodedata.category(c) not in ("Cc", "Cf", "Cn", "Mn", "Me"):
            kept.append(point)
    spans: list[list[int]] = []
    for point in kept:
        if spans and point == spans[-1][1] + 1:
            spans[-1][1] = point
        else:
            spans.append([point, point])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in spans)


_UNSTABLE = f"[^{_stable()}]"


def _decodes(blob: Column) -> Column:
    return unhexed(blob).isNotNull() | unbased(blob).isNotNull()


def may_change(text: Column, settings: Normalization = Normalization()) -> Column:
    """False only for texts that normalization leaves alone."""
    guards = []
    if settings.unicode:
        guards.append(text.rlike(_UNSTABLE))
    if settings.base64 or settings.hex:
        # blobs are tried natively; those that are no text at all need no kernel
        guards.append(F.when(text.rlike(_BLOB), F.exists(F.regexp_extract_all(text, F.lit(kernels.BLOB), F.lit(0)), _decodes)).otherwise(False))
    if settings.rot13:
        guards.append(F.lower(F.translate(text, ROT13_FROM, ROT13_TO)).rlike(_RUN_MARKERS))
    if settings.delimiters:
        guards.append(text.rlike(f"(?i){_TOKENS}") | text.rlike(f"(?i){_LINE}"))
    out = F.lit(False)
    for g in guards:
        out = out | g
    return F.coalesce(out, F.lit(False))


def _kernel(settings: Normalization):
    toggles = {k: getattr(settings, k) for k in ("unicode", "base64", "hex", "rot13", "delimiters")}

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        cleaned, findings = [], []
        for t in texts:
            new, found = kernels.normalize(t, **toggles) if isinstance(t, str) else (None, [])
            cleaned.append(new)
            findings.append(
                [dict(category=c, description=d, positions=[dict(start=a, end=b) for a, b in spans], preview=p) for c, d, spans, p in found]
            )
        return pd.DataFrame({"cleaned": cleaned, "findings": findings})

    return run


def normalized(text: Column, settings: Normalization = Normalization()) -> Column:
    """struct(cleaned, findings); a null text is empty and has no findings."""
    plain = F.coalesce(text, F.lit(""))
    made = _kernel(settings)(F.when(may_change(plain, settings), plain))
    return F.struct(
        F.coalesce(made["cleaned"], plain).alias("cleaned"),
        F.coalesce(made["findings"], F.array().cast(FINDINGS)).alias("findings"),
    )


def normalize_messages(messages: DataFrame, settings: Normalization = Normalization(), text: str = "text", role: str = "role") -> DataFrame:
    """Adds ``cleaned`` and ``findings``; only rows of role user are touched."""
    user = F.coalesce(F.col(role) == "user", F.lit(False))
    masked = normalized(F.when(user, F.col(text)), settings)
    out = messages.withColumn("_n", masked)
    return out.withColumn("cleaned", F.when(user, F.col("_n.cleaned")).otherwise(F.col(text))).withColumn(
        "findings", F.when(user, F.col("_n.findings")).otherwise(F.array().cast(FINDINGS))
    ).drop("_n")


# ------------------------------------------------------------ single steps, natively


def strip_zero_width(text: Column) -> Column:
    return F.regexp_replace(text, f"[{kernels.ZERO_WIDTH}]+", "")


def strip_bidi(text: Column) -> Column:
    return F.regexp_replace(text, f"[{kernels.BIDI}]+", "")


def strip_control(text: Column) -> Column:
    """Java's tables lag behind Python's by two format characters, which are named here."""
    return F.regexp_replace(text, "[\\p{Cc}\\p{Cf}\\u0890\\u0891\\x{1343F}&&[^\\n\\t]]+", "")


def defused(text: Column) -> Column:
    """Delimiters neutralized, text only; labels one by one, as their case is folded in the replacement."""
    for label in sorted(kernels.LABELS, key=len, reverse=True):
        mark = kernels.slug(label)
        text = F.regexp_replace(text, rf"(?idmU)^(\s*[#*\->]{{0,8}}\s*)(?:{label})(\s*:)(?=\s|\z)", f"$1{mark}$2")
    for label in sorted(kernels.LABELS, key=len, reverse=True):
        text = F.regexp_replace(text, rf"(?idmU)^(\s*#+\s*)(?:{label})(?=\s*:?\s*$)", f"$1{kernels.slug(label)}")
    for token in sorted(kernels.TOKENS, key=len, reverse=True):
        quoted = "".join("\\" + c if not c.isalnum() else c for c in token)
        text = F.regexp_replace(text, f"(?i){quoted}", kernels.slug(token))
    return text


def unhexed(blob: Column) -> Column:
    """The text of a hex blob, or null."""
    fits = blob.rlike(f"^(?:[0-9a-fA-F]{{2}}){{{kernels.LEAST_HEX // 2},}}$")
    return F.when(fits, F.try_validate_utf8(F.unhex(F.when(fits, blob)).cast("binary")))


def unbased(blob: Column) -> Column:
    """The text of a base64 blob (standard or URL-safe, padding optional), or null."""
    core = F.translate(F.regexp_replace(blob, "=+$", ""), "-_", "+/")
    padded = F.concat(core, F.when(F.length(core) % 4 == 2, "==").when(F.length(core) % 4 == 3, "=").otherwise(""))
    return F.when(F.length(core) % 4 != 1, F.try_validate_utf8(F.try_to_binary(padded, F.lit("base64"))))


def turned(text: Column) -> Column:
    return F.translate(text, ROT13_FROM, ROT13_TO)


def marked(text: Column) -> Column:
    return F.lower(text).rlike("|".join(kernels.MARKERS))
