"""Mixing sources to target weights by Pfair scheduling.

A source's documents form blocks of ``BLOCK_ROWS``.  With weight w = c / Q its i-th block (from 0) is
released at slot floor(i / w) and due by ceil((i + 1) / w); in every slot the released block with the
earliest deadline runs.  The weights add up to one, so every deadline holds and a source is never a
whole block away from its share, in any prefix of the schedule.  Weights are whole numbers out of Q,
hence the schedule repeats after Q slots: only one period is simulated (Q is a parameter, no matter how
many documents there are) and the slot of any block follows by arithmetic.  When a source has no blocks
left its slots are passed over; the others keep their proportions.  Every row stays.

Rows are numbered inside a source without gathering it: buckets of bounded size by a hash of the
doc_id, numbered one by one, offset by the counts of the buckets before.

Defined cases: a null source is the source ``""``; order inside a source is by hash of doc_id, then
doc_id, then the other columns' values and the text's hash, so ties and repeated rows keep a place each; an empty table
gives an empty result; extra columns pass through.  Weights not given: the square root of a source's
rows, scaled (small sources come earlier than their size says).  A source that a given weight map leaves
out gets the smallest positive weight, so that none of its rows is lost.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, listed, narrowed

BLOCK_ROWS = 32
#: Slots in a period, at least; a source's weight is a whole number out of these.
PERIOD = 4096
#: Rows of one numbering bucket, about.
BUCKET_ROWS = 2000


def whole_weights(weights: dict[str, float], period: int = PERIOD) -> tuple[dict[str, int], int]:
    """Whole numbers c >= 1 in proportion to ``weights``, and their sum Q (largest remainders)."""
    period = max(period, 8 * len(weights))
    total = sum(weights.values())
    ideal = {s: w / total * period for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in ideal.items()}
    short = period - sum(out.values())
    for s in sorted(ideal, key=lambda s: (int(ideal[s]) - ideal[s], s))[: max(0, short)]:
        out[s] += 1
    return out, sum(out.values())


def schedule(counts: dict[str, int], period: int) -> list[tuple[str, int, int]]:
    """(source, k, slot) of one period: earliest deadline first among the released blocks.

    Block k of a source with c blocks a period: release floor(k Q / c), deadline ceil((k + 1) Q / c).
    """
    waiting = [(0, s, 0) for s in sorted(counts)]  # release, source, k
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []  # deadline, source, k
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // counts[s]), s, k))
        deadline, s, k = heapq.heappop(ready)
        if deadline <= slot:
            raise AssertionError("a deadline was missed")
        out.append((s, k, slot))
        if k + 1 < counts[s]:
            heapq.heappush(waiting, ((k + 1) * period // counts[s], s, k + 1))
    return out


def default_weights(rows: dict[str, int]) -> dict[str, float]:
    return {s: n**0.5 for s, n in rows.items()}


def mixed(
    documents: DataFrame, weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS, period: int = PERIOD
) -> DataFrame:
    """``documents`` with block, slot and place (rank inside the source): order by slot, place."""
    spark = documents.sparkSession
    docs = documents.withColumn("_source", F.coalesce(F.col("source"), F.lit("")))
    # the bucket follows the hash, so that bucket, hash, doc_id is the order inside the source
    total = docs.count()
    buckets = max(1, -(-total // BUCKET_ROWS))
    # rows without an id are told apart by what else they have, so that they do not share a bucket
    names = documents.columns
    small = [F.col(n) for n in names if n not in ("doc_id", "text")]
    mixed_hash = F.when(F.col("doc_id").isNull(), F.xxhash64(*small, F.lit(7))).otherwise(F.xxhash64("doc_id", F.lit(7)))
    docs = docs.withColumn("_hash", mixed_hash).withColumn(
        "_bucket", F.floor((F.shiftright("_hash", 32) + F.lit(2**31)) * F.lit(buckets) / F.lit(2**32)).cast("int")
    )
    sizes = cut(docs.groupBy("_source", "_bucket").agg(F.count(F.lit(1)).alias("n")))
    # a row a source: the driver holds the sources' weights and one period of the schedule
    per_source = sizes.groupBy("_source").agg(F.sum("n").alias("n")).collect()
    rows = {r["_source"]: r["n"] for r in per_source}
    given = default_weights(rows)
    if weights is not None:
        least = min((w for w in weights.values() if w > 0), default=1.0)
        given = {s: weights[s] if weights.get(s, 0) > 0 else least for s in rows}
    shares, q = whole_weights(given, period) if given else ({}, 1)
    places = schedule(shares, q) if shares else []
    before = sizes.withColumn(
        "_before",
        F.sum("n").over(Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)),
    ).select("_source", "_bucket", F.coalesce("_before", F.lit(0)).alias("_before"))
    last = [F.xxhash64("text")] if "text" in names else []
    inside = Window.partitionBy("_source", "_bucket").orderBy("_hash", "doc_id", *small, *last)
    docs = docs.withColumn("_n", F.row_number().over(inside) - 1)
    docs = docs.join(before, ["_source", "_bucket"])
    docs = docs.withColumn("place", (F.col("_before") + F.col("_n")).cast("bigint"))
    docs = docs.withColumn("block", F.floor(F.col("place") / F.lit(block_rows)).cast("bigint"))
    # one period, a row a source: at most Q slots in all, which the parameter bounds
    by_source: dict[str, list[int]] = {}
    for s, _, slot in places:
        by_source.setdefault(s, []).append(slot)
    plan = listed(spark, list(by_source.items()), _source="string", _slots="array<bigint>")
    docs = docs.join(F.broadcast(plan), "_source")
    turn, k = F.floor(F.col("block") / F.size("_slots")), F.col("block") % F.size("_slots")
    slot = turn * F.lit(q) + F.element_at("_slots", (k + 1).cast("int"))
    return docs.select(*names, "block", slot.cast("bigint").alias("slot"), "place")


def mixture(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """doc_id, source, block, slot, place of every document."""
    docs = narrowed(documents, doc_id="bigint", source="string", n_chars="bigint")
    return mixed(docs).select("doc_id", "source", "block", "slot", "place")
