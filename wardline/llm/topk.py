"""Exact top-k inner products: norm-sorted candidates, SVD-rotated partial sums, residual bounds.

Vectors are integers (``floor(scale * x)``).  The rotation comes from the singular vectors of the
whole table (its d x d Gram matrix, summed over all rows).  Candidates are dealt by ranges of length and
sorted by descending length within each, so that a task stops looking once ``|q| |c|`` cannot reach the
k-th best score of any query, and a pair is scored exactly only if

    <q, c>  <=  partial sum of the leading rotated coordinates + |q rest| |c rest|  (Cauchy-Schwarz)

still can.  Queries travel to the candidates in rounds of at most ``ROUND_BYTES`` (a broadcast of a
checked size), one round after the other: a round's answers go to the shared folder and its broadcast is
destroyed before the next begins.  A first pass over the longest candidates sets each query's bound.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows
without vec_id; shorter vectors count as padded with zeros; rows that repeat a vec_id are candidates each,
but not for queries of that vec_id, and as queries they share its k places; ties go to the smaller
vec_id; fewer than k candidates: all of them; extra columns are ignored.  Scores are exact at any size of
the components; one beyond 64 bits is shown as the largest or smallest long, and such ones tie.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_size, cut, narrowed, shared_dir, trimmed

#: Bytes of queries broadcast at once, at most.
ROUND_BYTES = 64 << 20
#: Candidates scored at once.
BLOCK = 4096
#: Longest candidates that set the first bounds.
SEED_ROWS = 16_384
#: Share of the squared length that the leading rotated coordinates should hold.
LEADING = 0.6
#: Vectors longer than this have no part in the rotation, and are scored without bounds.
GIANT = 1e100
#: Tasks whose answers to a query meet in one place before all do.
MEET = 64

MOST = 2**63 - 1
LEAST = -(2**63)


def vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, v: the components as array<double>; rows that take no part are gone."""
    rows = narrowed(embeddings, vec_id="bigint", embedding="array<double>")
    fine = F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return rows.where(F.col("vec_id").isNotNull() & fine).select("vec_id", F.col("embedding").alias("v"))


def whole(column: pd.Series, d: int, scale: float) -> np.ndarray:
    """floor(scale * x), padded with zeros: a matrix of doubles that are whole numbers, or of Python's integers if one does not fit."""
    out = np.zeros((len(column), d))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    with np.errstate(over="ignore"):
        made = np.floor(out * scale)
    if np.isfinite(made).all():
        return made
    exact = np.zeros(out.shape, dtype=object)
    for at, x in np.ndenumerate(out):  # what overflows is a whole number itself
        exact[at] = int(np.floor(x * scale)) if abs(x) < 2.0**60 else int(x) * int(scale)
    return exact


def _floats(m: np.ndarray) -> np.ndarray:
    """The matrix for bounds: rows that are too long for them are zero, see :func:`_giants`."""
    return np.where(_giants(m)[:, None], 0.0, m).astype(np.float64)


def _giants(m: np.ndarray) -> np.ndarray:
    return (np.abs(m) > GIANT / max(m.shape[1], 1)).any(axis=1)


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows; through doubles where they are exact, else as Python's integers, held to 64 bits."""
    peak = float(min(np.abs(q).max(initial=0), 1e300)) * float(min(np.abs(c).max(initial=0), 1e300)) * max(q.shape[1], 1)
    if peak < 2.0**53:
        return np.rint(q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if peak < 2.0**63 and max(np.abs(q).max(), np.abs(c).max()) < 2.0**62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    integers = np.vectorize(int, otypes=[object])
    return np.clip(integers(q) @ integers(c).T, LEAST, MOST).astype(np.int64)


class Searcher:
    """Running top-k of a set of queries over candidates that arrive in blocks."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, basis: np.ndarray, lead: int, k: int, floor: np.ndarray):
        self.ids, self.q, self.basis, self.lead, self.k = ids, q, basis, lead, k
        rotated = _floats(q) @ basis
        self.head = rotated[:, :lead]
        self.rest = np.sqrt((rotated[:, lead:] ** 2).sum(axis=1))
        self.norm = np.where(_giants(q), np.inf, np.sqrt((rotated**2).sum(axis=1)))
        self.floor = floor.astype(np.int64).copy()
        self.best_score: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(ids)
        self.best_id: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(ids)

    def done(self, norm: float) -> bool:
        """Whether no candidate of at most this length can reach a query's bound."""
        with np.errstate(invalid="ignore"):
            most = np.nan_to_num(self.norm * norm, nan=np.inf)
        return bool((most * (1 + 1e-6) + 1e-6 < self.floor).all())

    def block(self, ids: np.ndarray, c: np.ndarray) -> None:
        if not len(ids) or not len(self.ids):
            return
        giant = _giants(c)
        if giant.any():
            self._all(np.arange(len(self.ids)), ids[giant], c[giant])
            ids, c = ids[~giant], c[~giant]
            if not len(ids):
                return
        odd = np.flatnonzero(~np.isfinite(self.norm))
        self._all(odd, ids, c)
        rotated = c.astype(np.float64) @ self.basis
        head, rest = rotated[:, : self.lead], np.sqrt((rotated[:, self.lead :] ** 2).sum(axis=1))
        norm = np.sqrt((rotated**2).sum(axis=1))
        order = np.lexsort((ids, -norm))
        ids, c, head, rest, norm = ids[order], c[order], head[order], rest[order], norm[order]
        own = np.where(np.isfinite(self.norm), self.norm, 0.0)
        slack = 1e-6 * (1.0 + norm.max(initial=0.0) * own)
        bounds = self.floor.astype(np.float64) - slack
        # |q| |c| falls along the block: what comes after the cut cannot reach the bound
        live = np.flatnonzero(np.isfinite(self.norm) & (own * norm[0] >= bounds))
        for at in range(0, len(live), 512):
            rows = live[at : at + 512]
            reach = int(np.max([np.searchsorted(-norm * own[r], -bounds[r], "right") for r in rows], initial=0))
            if not reach:
                continue
            upper = self.head[rows] @ head[:reach].T + np.outer(self.rest[rows], rest[:reach])
            may = upper >= bounds[rows][:, None]
            cols = np.flatnonzero(may.any(axis=0))
            if not len(cols):
                continue
            self._score(rows, ids[cols], c[cols], may[:, cols])

    def _all(self, rows: np.ndarray, ids: np.ndarray, c: np.ndarray) -> None:
        for at in range(0, len(rows), 64):
            some = rows[at : at + 64]
            self._score(some, ids, c, np.ones((len(some), len(ids)), dtype=bool))

    def _score(self, rows: np.ndarray, ids: np.ndarray, c: np.ndarray, may: np.ndarray) -> None:
        score = _exact(self.q[rows], c)
        may = may & (score >= self.floor[rows][:, None]) & (ids[None, :] != self.ids[rows][:, None])
        for i, r in enumerate(rows):
            hit = np.flatnonzero(may[i])
            if len(hit):
                self._take(r, score[i, hit], ids[hit])

    def _take(self, r: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.best_score[r], score]), np.concatenate([self.best_id[r], ids])
        keep = np.lexsort((ids, ~score))[: self.k]  # ~ falls as the score rises, and never overflows
        self.best_score[r], self.best_id[r] = score[keep], ids[keep]
        if len(keep) == self.k:
            self.floor[r] = max(self.floor[r], score[keep[-1]])

    def frame(self) -> pd.DataFrame:
        sizes = [len(x) for x in self.best_id]
        return pd.DataFrame(
            {
                "query_id": np.repeat(self.ids, sizes),
                "vec_id": np.concatenate(self.best_id) if sizes else np.zeros(0, dtype=np.int64),
                "score": np.concatenate(self.best_score) if sizes else np.zeros(0, dtype=np.int64),
            }
        )


def rotation(rows: DataFrame, scale: float) -> tuple[int, np.ndarray, int]:
    """(dimension, orthogonal basis by falling singular value, leading coordinates); all rows count.

    Each task gives d rows of its Gram matrix; they are added up by row, and the driver gets one d x d matrix.
    """
    d = rows.agg(F.max(F.size("v"))).first()[0] or 0
    if not d:
        return 0, np.zeros((0, 0)), 0

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((d, d))
        for pdf in batches:
            m = _floats(whole(pdf["v"], d, scale))
            total += m.T @ m
        yield pd.DataFrame({"i": np.arange(d), "row": [x.tobytes() for x in total]})
        trimmed()

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for i, row in zip(pdf["i"].tolist(), pdf["row"], strict=True):
                total[i] = total.get(i, 0) + np.frombuffer(row)
        yield pd.DataFrame({"i": list(total), "row": [x.tobytes() for x in total.values()]})

    parts = rows.select("v").mapInPandas(gram, "i int, row binary").repartition(min(d, 16), "i")
    got = parts.mapInPandas(added, "i int, row binary").toPandas()
    full = np.zeros((d, d))
    for i, row in zip(got["i"].tolist(), got["row"], strict=True):
        full[i] = np.frombuffer(row)
    values, basis = np.linalg.eigh((full + full.T) / 2)  # V of the SVD: singular values squared
    values, basis = np.maximum(values[::-1], 0.0), np.ascontiguousarray(basis[:, ::-1])
    share = np.cumsum(values) / max(values.sum(), 1e-300)
    return d, basis, int(min(d, np.searchsorted(share, LEADING) + 1))


SCHEMA = "query_id bigint, vec_id bigint, score bigint, at int"


def top_k(spark: SparkSession, embeddings: DataFrame, k: int = 20, query_step: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score for every query: the rows whose vec_id is divisible by ``query_step``."""
    arrow_size(spark, BLOCK)
    rows = vectors(embeddings)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + F.pow(F.floor(x * F.lit(scale)).cast("double"), F.lit(2.0))))
    # floor() stops at 64 bits; a vector that long counts as longer than any bound
    far = F.exists("v", lambda x: F.abs(x) * F.lit(scale) >= F.lit(2.0**62))
    rows = rows.withColumn("norm", F.when(far, F.lit(float("inf"))).otherwise(norm))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(rows.repartitionByRange(parts, F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id"))
    d, basis, lead = rotation(rows, scale)
    if not d:  # no vectors, or only empty ones: every score is 0
        d, basis, lead = 1, np.ones((1, 1)), 1
    queries = rows.where(F.pmod("vec_id", F.lit(query_step)) == 0)
    # rounds of bounded size: equal shares of the queries by hash, from their count
    n = queries.count()
    rounds = max(1, -(-n * (d + 4) * 8 // ROUND_BYTES))
    longest = rows.orderBy(F.desc("norm"), "vec_id").limit(SEED_ROWS).select("vec_id", "v").toPandas()  # bounded by SEED_ROWS
    seeds = spark.sparkContext.broadcast((longest["vec_id"].to_numpy(dtype=np.int64), whole(longest["v"], d, scale)))
    answers = f"{shared_dir(spark)}/answers-{uuid.uuid4().hex}"
    for turn in range(rounds):
        own = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == turn)
        found, sent = _round(spark, rows, own, seeds, d, basis, lead, k, scale)
        found.write.parquet(f"{answers}/turn={turn}")
        sent.destroy()
    seeds.destroy()
    pairs = spark.read.schema(SCHEMA).parquet(*[f"{answers}/turn={turn}" for turn in range(rounds)])
    best = lambda c: F.slice(F.array_sort(F.flatten(F.collect_list(c))), 1, k)
    entry = F.struct(F.bitwise_not("score").alias("s"), "vec_id")
    near = pairs.groupBy("query_id", "at").agg(best(F.array(entry)).alias("best"))
    ranked = near.groupBy("query_id").agg(best("best").alias("best"))
    return ranked.select("query_id", F.posexplode("best").alias("p", "b")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.bitwise_not("b.s").alias("score")
    )


def _round(spark, rows, own, seeds, d, basis, lead, k, scale):
    """The best candidates of each task for the queries ``own``, and the broadcast that holds these."""

    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, c = seeds.value
        for pdf in batches:
            q = Searcher(pdf["vec_id"].to_numpy(), whole(pdf["v"], d, scale), basis, lead, k, np.full(len(pdf), LEAST))
            for at in range(0, len(ids), BLOCK):
                q.block(ids[at : at + BLOCK], c[at : at + BLOCK])
            yield pd.DataFrame({"vec_id": q.ids, "v": pdf["v"], "floor": q.floor})
        trimmed()

    got = own.select("vec_id", "v").mapInPandas(bounds, "vec_id bigint, v array<double>, floor bigint").toPandas()  # at most ROUND_BYTES
    sent = (got["vec_id"].to_numpy(dtype=np.int64), whole(got["v"], d, scale), got["floor"].to_numpy(dtype=np.int64))
    sent = spark.sparkContext.broadcast(sent)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q, floor = sent.value
        searcher = Searcher(ids, q, basis, lead, k, floor)
        for pdf in batches:
            if len(pdf) and searcher.done(float(pdf["norm"].iloc[0])):
                continue  # the rest of this task's candidates is no longer
            searcher.block(pdf["vec_id"].to_numpy(), whole(pdf["v"], d, scale))
        yield searcher.frame().assign(at=TaskContext.get().partitionId() // MEET)
        del searcher
        trimmed()

    return rows.mapInPandas(search, SCHEMA), sent


ORACLE = """
WITH vecs AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM vecs q JOIN vecs c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
