"""Document fingerprints: SimHash, and all fingerprints within a Hamming radius.

The terms of a text are its adjacent word pairs (a lone word is its own term), lower case; a term's
weight is the number of its occurrences.  The 128 hash bits of a term each vote +weight or -weight; a
fingerprint has a one where the votes are positive.  Likeness is the share of equal bits.

The votes are counted in packed lanes: a long holds four 16-bit counters, and no more than ``CHUNK``
terms are added up before the lanes are widened, so texts of any length count right.

:func:`near` finds every pair of distinct fingerprints within ``radius``: cut in ``radius + 1`` blocks, two
such fingerprints agree in one block at least, so a table per block, keyed by it, holds every pair; a
pair is taken from the first block it agrees in.  Equal fingerprints are one row there, and a block value that very
many share is split over tasks.

:func:`with_next` puts each text beside the next one without a global sort: rows go to buckets of
neighbouring ids (one shuffle), and a copy of each bucket's first row closes the bucket before.

Only DataFrame functions.  Defined cases: null text is empty; an empty text has no votes and the
fingerprint of zeros; null doc_id sorts first; repeated ids are ordered by text; a table of one row
follows itself; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, narrowed

BITS = 128
CHUNK = 30_000
RADIUS = 3
#: Rows of one bucket of neighbours, at least, about.  Beyond its square, buckets and their rows grow alike, with the
#: root of the table: the buckets' bounds, which every task gets, take 1.6 MB at 10^10 rows.
BUCKET_ROWS = 250
#: Fingerprints of one block value that meet in one task; those of a more frequent value meet in squares of this side.
HOT_ROWS = 2000
#: Frequent block values that are sent to every task, at most; beyond that they are joined.
SENT_VALUES = 100_000

_LANES16 = 0x0001000100010001
_LANES32 = 0x0000FFFF0000FFFF


# ---------------------------------------------------------------- neighbours


def _bounds(docs: DataFrame) -> list[int]:
    n = docs.count()
    k = max(1, -(-n // max(BUCKET_ROWS, isqrt(n))))
    if k == 1:
        return []
    shares = [i / k for i in range(1, k)]
    got = docs.agg(F.percentile_approx("doc_id", shares, F.lit(8 * k)).alias("b")).first()["b"]
    return sorted(set(got or []))


def _bucket(bounds: list[int]) -> Column:
    """How many bounds are <= doc_id, in two steps of comparisons, each with about the root of their number."""
    if not bounds:
        return F.lit(0)
    fan = isqrt(len(bounds)) + 1
    # literals: an array that a split of a constant gives is folded into one
    listed = lambda x: F.split(F.lit(",".join(map(str, x))), ",").cast("array<bigint>")
    # as many stretches of bounds begin at or before doc_id; the last of them holds the bucket
    at = F.size(F.filter(listed(bounds[::fan]), lambda b: b <= F.col("doc_id")))
    part = F.slice(listed(bounds), F.greatest(at - 1, F.lit(0)) * fan + 1, F.lit(fan))
    inside = F.size(F.filter(part, lambda b: b <= F.col("doc_id")))
    return F.when(F.col("doc_id").isNull() | (at == 0), F.lit(0)).otherwise((at - 1) * F.lit(fan) + inside)


def with_next(documents: DataFrame) -> DataFrame:
    """(bucket, n, copy, doc_id, text, next_text): copy rows only close a bucket; n orders a bucket's rows."""
    docs = narrowed(documents, doc_id="bigint", text="string")
    bounds = _bounds(docs.select("doc_id"))
    docs = docs.withColumn("bucket", _bucket(bounds).cast("int"))
    # a row a bucket: the first id of each bucket, and the bucket before it (the last, for the first)
    firsts = docs.groupBy("bucket").agg(F.min("doc_id").alias("first"), F.count_if(F.col("doc_id").isNull()).alias("nulls"))
    firsts = firsts.select("bucket", F.when(F.col("nulls") == 0, F.col("first")).alias("first")).collect()
    order = sorted(r["bucket"] for r in firsts)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    plan = docs.sparkSession.createDataFrame(
        [(r["bucket"], r["first"], before[r["bucket"]]) for r in firsts], "bucket int, first bigint, before int"
    )
    placed = docs.join(F.broadcast(plan), "bucket")
    spots = F.filter(
        F.array(
            F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("copy")),
            F.struct(F.col("before").alias("bucket"), F.when(F.col("doc_id").eqNullSafe(F.col("first")), 1).alias("copy")),
        ),
        lambda s: s["copy"].isNotNull(),
    )
    rows = placed.select(F.inline(spots), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    inside = Window.partitionBy("bucket").orderBy("copy", "doc_id", "text")
    rows = rows.select(
        "bucket", F.row_number().over(inside).alias("n"), "copy", F.lag("copy", 1, 0).over(inside).alias("_was"),
        "doc_id", "text", F.lead("text").over(inside).alias("next_text"),
    )
    return rows.where((F.col("copy") == 0) | (F.col("_was") == 0)).drop("_was")


def edited(text: Column, other: Column) -> Column:
    """The last floor(n / 2) code points replaced by the first as many (or all) of ``other``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.left(text, F.length(text) - half), F.left(other, half))


# -------------------------------------------------------------- fingerprints


def terms(text: Column) -> Column:
    """Hashes of the adjacent word pairs, one for each occurrence."""
    words = F.filter(F.split(F.lower(text), "\\s+"), lambda w: w != F.lit(""))
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def pairs(h: Column) -> Column:
        last = F.size(h) - 1
        following = lambda i: F.get(h, i + 1)
        both = F.transform(
            h, lambda x, i: x.bitwiseXOR(F.shiftleft(following(i), 1).bitwiseOR(F.shiftrightunsigned(following(i), 63)))
        )
        return F.when(last > 0, F.slice(both, F.lit(1), last)).otherwise(h)

    return F.flatten(F.transform(F.array(hashed), pairs))


def fingerprints(rows: DataFrame, keys: list[str], texts: str) -> DataFrame:
    """``keys`` (unique), kind, hi, lo: a fingerprint for each of the (kind, text) structs in ``texts``."""
    one = rows.select(*keys, F.inline(texts)).select(*keys, "kind", F.posexplode_outer(terms(F.col("text"))).alias("p", "t"))
    chunk = F.coalesce(F.floor(F.col("p") / CHUNK), F.lit(0)).cast("int")
    hashed = one.select(*keys, "kind", chunk.alias("chunk"), "t", F.xxhash64("t").alias("h0"), F.xxhash64("t", F.lit(1)).alias("h1"))
    votes = [F.count("t").alias("votes")]
    for h in range(2):
        for i in range(16):
            lanes = F.shiftrightunsigned(F.col(f"h{h}"), i).bitwiseAND(F.lit(_LANES16))
            votes.append(F.sum(F.when(F.col("t").isNotNull(), lanes).otherwise(F.lit(0))).alias(f"s{h}_{i}"))
    narrow = hashed.groupBy(*keys, "kind", "chunk").agg(*votes)
    wide = [F.sum("votes").alias("votes")]
    for h in range(2):
        for i in range(16):
            s = F.col(f"s{h}_{i}")
            wide.append(F.sum(s.bitwiseAND(F.lit(_LANES32))).alias(f"e{h}_{i}"))
            wide.append(F.sum(F.shiftrightunsigned(s, 16).bitwiseAND(F.lit(_LANES32))).alias(f"o{h}_{i}"))
    whole = narrow.groupBy(*keys, "kind").agg(*wide)

    def word(h: int) -> Column:
        out = None
        for bit in range(64):
            lane, i = divmod(bit, 16)  # lanes 0 and 2 stand in e, 1 and 3 in o, at bit 0 or 32
            counter = F.col(f"{'eo'[lane % 2]}{h}_{i}")
            count = F.shiftrightunsigned(counter, 32 * (lane // 2)).bitwiseAND(F.lit(0xFFFFFFFF))
            term = F.when(count * 2 > F.col("votes"), F.shiftleft(F.lit(1).cast("bigint"), bit)).otherwise(F.lit(0).cast("bigint"))
            out = term if out is None else out.bitwiseOR(term)
        return out

    return whole.select(*keys, "kind", word(0).alias("hi"), word(1).alias("lo"))


def shown(hi: Column, lo: Column) -> Column:
    """32 hexadecimal digits."""
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def distance(a_hi: Column, a_lo: Column, b_hi: Column, b_lo: Column) -> Column:
    return F.bit_count(a_hi.bitwiseXOR(b_hi)) + F.bit_count(a_lo.bitwiseXOR(b_lo))


def likeness(a_hi: Column, a_lo: Column, b_hi: Column, b_lo: Column) -> Column:
    return F.lit(1.0) - distance(a_hi, a_lo, b_hi, b_lo) / F.lit(float(BITS))


# ------------------------------------------------------- within a Hamming radius


def _block(k: int, count: int) -> Column:
    """Bits [k * 128 / count, (k + 1) * 128 / count) as one long (blocks span at most 64 bits)."""
    a, b = BITS * k // count, BITS * (k + 1) // count
    mask = lambda n: F.lit((1 << n) - 1 if n < 64 else -1)
    if b <= 64:
        return F.shiftrightunsigned("lo", a).bitwiseAND(mask(b - a))
    if a >= 64:
        return F.shiftrightunsigned("hi", a - 64).bitwiseAND(mask(b - a))
    low = F.shiftrightunsigned("lo", a).bitwiseAND(mask(64 - a))
    return low.bitwiseOR(F.shiftleft(F.col("hi").bitwiseAND(mask(b - 64)), 64 - a))


def near(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a_hi, a_lo, b_hi, b_lo), a < b, of the distinct fingerprints (hi, lo) within ``radius``."""
    count = max(2, radius + 1)
    tables = F.array(*[F.struct(F.lit(k).alias("k"), _block(k, count).alias("v")) for k in range(count)])
    keyed = distinct.select("hi", "lo", F.inline(tables))
    a = keyed.select("k", "v", F.col("hi").alias("a_hi"), F.col("lo").alias("a_lo"))
    b = keyed.select("k", "v", F.col("hi").alias("b_hi"), F.col("lo").alias("b_lo"))
    on = ["k", "v"]
    counted = keyed.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_ROWS)
    hot = cut(counted.select("k", "v", F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("_parts")))
    if not hot.isEmpty():  # one side dealt over the parts, the other in each of them
        if hot.limit(SENT_VALUES + 1).count() <= SENT_VALUES:  # checked: a few megabytes
            hot = F.broadcast(hot)
        parts = F.coalesce("_parts", F.lit(1))
        a = a.join(hot, on, "left").withColumn("_part", F.pmod(F.xxhash64("a_hi", "a_lo"), parts).cast("int")).drop("_parts")
        b = b.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
        on = [*on, "_part"]
    sides = F.struct("a_hi", "a_lo") < F.struct("b_hi", "b_lo")
    apart = distance(F.col("a_hi"), F.col("a_lo"), F.col("b_hi"), F.col("b_lo")) <= radius
    differ = F.struct(F.col("a_hi").bitwiseXOR(F.col("b_hi")).alias("hi"), F.col("a_lo").bitwiseXOR(F.col("b_lo")).alias("lo"))
    met = a.join(b, on).where(sides & apart).select("k", "a_hi", "a_lo", "b_hi", "b_lo", F.inline(F.array(differ)))
    first = F.lit(count)
    for k in reversed(range(count)):
        first = F.when(_block(k, count) == 0, F.lit(k)).otherwise(first)
    return met.where(F.col("k") == first).select("a_hi", "a_lo", "b_hi", "b_lo")


# --------------------------------------------------------------------- query


def document_fingerprints(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """The contract's columns, then class_id (smallest doc_id of equal fingerprints) and n_near
    (how many other distinct fingerprints lie within ``RADIUS``)."""
    rows = with_next(documents)
    changed = F.when(F.col("copy") == 0, edited(F.col("text"), F.col("next_text"))).alias("edited")
    rows = rows.select("bucket", "n", "copy", "doc_id", "text", changed)
    rows = rows.select(
        "bucket", "n", "copy", "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.filter(
            F.array(F.struct(F.lit(0).alias("kind"), F.col("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text"))),
            lambda x: x["text"].isNotNull(),
        ).alias("texts"),
    )
    keys = ["bucket", "n", "copy", "doc_id", "n_chars", "edited_sha256"]
    prints = fingerprints(rows, keys, "texts")
    pick = lambda c, kind: F.max(F.when(F.col("kind") == kind, F.col(c)))
    both = prints.groupBy(*keys).agg(
        pick("hi", 0).alias("hi"), pick("lo", 0).alias("lo"), pick("hi", 1).alias("e_hi"), pick("lo", 1).alias("e_lo")
    )
    inside = Window.partitionBy("bucket").orderBy("n")
    both = both.select(*keys, "hi", "lo", "e_hi", "e_lo", F.lead("hi").over(inside).alias("n_hi"), F.lead("lo").over(inside).alias("n_lo"))
    done = cut(both.where(F.col("copy") == 0).drop("bucket", "n", "copy"))
    classes = cut(done.groupBy("hi", "lo").agg(F.min("doc_id").alias("class_id")))
    pairs = near(classes.select("hi", "lo"))
    ends = pairs.select(
        F.inline(F.array(F.struct(F.col("a_hi").alias("hi"), F.col("a_lo").alias("lo")), F.struct(F.col("b_hi").alias("hi"), F.col("b_lo").alias("lo"))))
    )
    degrees = ends.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n_near"))
    linked = cut(classes.join(degrees, ["hi", "lo"], "left"))
    out = done.join(linked, ["hi", "lo"])
    hi, lo = F.col("hi"), F.col("lo")
    return out.select(
        "doc_id", "n_chars", "edited_sha256",
        shown(hi, lo).alias("fingerprint"),
        shown(F.col("e_hi"), F.col("e_lo")).alias("edited_fingerprint"),
        likeness(hi, lo, F.col("e_hi"), F.col("e_lo")).alias("near_edited"),
        likeness(hi, lo, F.col("n_hi"), F.col("n_lo")).alias("near_next"),
        "class_id",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
    )
