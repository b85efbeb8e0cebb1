"""Exact Jaccard join of word shingle sets, and the components of its links.

Texts with equal sets are one node.  Candidates meet on shared shingles, by the prefix bound: with
``100 |x & y| >= t |x | y|`` both sets have a common shingle among their first ``n - ceil(t/100 n) + 1``, in any
fixed order of shingles (here: frequent ones last, then by hash), and from the first common one on neither has
less left than the overlap that a link needs.  No link is lost.  Candidate pairs go to size-banded tiles; there hashed parity
bitmaps bound the overlap from above (``|x ^ y|`` is at least the ones of the XORed bitmaps), and only pairs
that pass have their sorted arrays intersected.

Groups of near copies never become all their pairs: first every document is compared with a leader and a few
neighbours among those that share a minimum hash with it (linear in the documents), and what is linked
so is one component; afterwards only pairs *between* components are candidates.

What is sent to every task is checked: at most ``SENT_ROWS`` node ids, else the text is joined instead; and
the frequent shingles, of which there cannot be more than ``RARE`` times the mean set size.

Defined cases: null text, empty text and text without words have no shingle and link with nothing (their
component is themselves); repeated rows are one node; rows that repeat a doc_id are documents of their own
that share its number; components with only null doc_ids are null; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_size, cut, narrowed, remembered, trimmed
from .shingles import Hasher

WORDS, PERCENT = 5, 75
#: Minimum hashes a node is compared by in the first round.
MINIMA = 8
#: Sets next in size, and next in their other minima, that a node is compared with for each minimum hash.
NEIGHBOURS = 2
#: A shingle is frequent if more than one in RARE documents hold it.
RARE = 4096
#: Shingles among which a task looks for those that several documents hold (32 MB).
STRETCH = 4 << 20
#: Node ids sent to every task, at most (8 MB).
SENT_ROWS = 1_000_000
#: Rows that share a key and give their pairs unseen, at most; longer runs go by their bitmaps.
RUN_ROWS = 16
#: Links that one task joins to components, at most.
LOCAL_EDGES = 500_000
#: Pairs of one tile, about, and pairs of one set that stay together in it.
TILE_PAIRS, SET_PAIRS = 4000, 500
BATCH_ROWS = 1024


def required(x: int, y: int, percent: int = PERCENT) -> int:
    """The smallest overlap of sets of x and y elements that makes a link."""
    return -(-percent * (x + y) // (100 + percent))


def prefix(n: int, percent: int = PERCENT) -> int:
    """How many first shingles of a set of n hold one that a linked set shares: a link shares percent of the larger set."""
    return n - -(-percent * n // 100) + 1


def may_link(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets that first meet at places x and y can be linked (x in size order before y).

    From there on they share no more than what either has left.
    """
    n, m = x >> 32, y >> 32
    need = -(-percent * (n + m) // (100 + percent))
    low = np.int64(0xFFFFFFFF)
    return (n - (x & low) >= need) & (m - (y & low) >= need)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


# ------------------------------------------------------------------- passes over the texts


def _bitmap(s: np.ndarray) -> np.ndarray:
    """Hashed parity bitmap: bit h mod B is set if an odd number of elements h fall there; n < B <= 2n."""
    bits = 1 << max(6, len(s).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of the same set at fewer bits: halves XORed."""
    while len(bitmap) > words:
        half = len(bitmap) // 2
        bitmap = bitmap[:half] ^ bitmap[half:]
    return bitmap


def digest(s: np.ndarray) -> np.ndarray:
    """128 bits of a set, as two numbers."""
    return np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype=np.int64)


def node_of(s: np.ndarray, clashes: frozenset[int]) -> int:
    """The number of a set: the first half of its digest, or the second where different sets share the first (``clashes``)."""
    first, second = digest(s).tolist()
    return second if first in clashes else first


def sets(docs: DataFrame, words: int = WORDS, clashes: frozenset[int] = frozenset()) -> DataFrame:
    """One row a document (doc_id, n, node, minima, bitmap, half), and rows (n null) of shingles that several documents
    of a stretch hold (minima: the shingles, counts: how many).  ``half`` is the digest's second half."""
    kinds = dict(doc_id=pa.int64(), n=pa.int64(), node=pa.int64(), minima=pa.list_(pa.int64()), bitmap=pa.binary(), counts=pa.list_(pa.int64()), half=pa.int64())
    schema = pa.schema(list(kinds.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("jaccard")
        hasher = Hasher(words)
        held: dict[int, np.ndarray] = {}
        size = 0

        def common() -> pa.RecordBatch:
            every = np.sort(np.concatenate(list(held.values())))
            first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
            many = np.diff(np.r_[first, len(every)])
            some = many > 2
            columns = [[None], [None], [None], [_signed(every[first[some]]).tolist()], [None], [many[some].tolist()], [None]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], schema=schema)

        for batch in batches:
            rows: list[tuple] = []
            for s in hasher.sets(batch.column(1)):
                node = node_of(s, clashes)
                at = np.searchsorted(s, np.arange(MINIMA, dtype=np.uint64) << np.uint64(61))
                rows.append((len(s), node, _signed(np.unique(s[at[at < len(s)]])).tolist(), _bitmap(s).tobytes(), None, int(digest(s)[1])))
                if len(s) and node not in held:
                    held[node] = s
                    size += len(s)
            columns = list(zip(*rows, strict=True)) or [()] * 6
            arrays = [pa.array(c, t) for c, t in zip(columns, list(kinds.values())[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], schema=schema)
            if size > STRETCH:
                yield common()
                held, size = {}, 0
        if held:
            yield common()
        trimmed()

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id bigint, n bigint, node bigint, minima array<bigint>, bitmap binary, counts array<bigint>, half bigint"
    )


def _wanted(docs: DataFrame, nodes: DataFrame) -> tuple[DataFrame, object | None]:
    """The documents that stand for ``nodes`` (node, doc_id): by their ids where these are few, else by a join.

    A node of rows without a doc_id is known by its hash alone; all such rows are read for it.
    """
    if nodes.limit(SENT_ROWS + 1).count() > SENT_ROWS:
        chosen = docs.join(nodes.select("doc_id").distinct(), "doc_id", "left_semi")
        if nodes.where(F.col("doc_id").isNull()).isEmpty():
            return chosen, None
        return chosen.unionByName(docs.where(F.col("doc_id").isNull())), None
    got = nodes.select("node", "doc_id").toPandas()
    nameless = got["doc_id"].isna().to_numpy()
    ids = np.unique(got["doc_id"][~nameless].to_numpy(dtype=np.int64))
    return docs, docs.sparkSession.sparkContext.broadcast((ids, np.unique(got["node"][nameless].to_numpy(dtype=np.int64))))


def arrays(docs: DataFrame, nodes: DataFrame, words: int = WORDS, clashes: frozenset[int] = frozenset()) -> DataFrame:
    """(node, s): the sorted shingles (little-endian 64 bits) of ``nodes`` (node, doc_id: a document of it, or null)."""
    chosen, sent = _wanted(docs, nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("jaccard")
        hasher = Hasher(words)
        for batch in batches:
            if sent is not None:
                ids, nameless = sent.value
                named = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
                keep = np.where(named, np.isin(batch.column(0).fill_null(0).to_numpy(), ids), len(nameless) > 0)
                batch = batch.filter(pa.array(keep))
            for at in range(0, batch.num_rows, 256):
                found = list(hasher.sets(batch.column(1).slice(at, 256)))
                raw, node = [s.tobytes() for s in found], np.array([node_of(s, clashes) for s in found], dtype=np.int64)
                if sent is not None and len(nameless):
                    some = batch.column(0).slice(at, 256).is_valid().to_numpy(zero_copy_only=False) | np.isin(node, nameless)
                    raw, node = [r for r, s in zip(raw, some, strict=True) if s], node[some]
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(raw, pa.binary())], names=["node", "s"])
        trimmed()

    made = chosen.select("doc_id", "text").mapInArrow(run, "node bigint, s binary")
    # rows that share a doc_id may bring other nodes along, and repeated rows the same one twice
    return made.join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"])


def postings(docs: DataFrame, parts: DataFrame, frequent: np.ndarray, words: int, percent: int, clashes: frozenset[int] = frozenset()) -> DataFrame:
    """(key, node, place, part) of the prefix shingles; place is the set's size and, in its low half, the shingle's rank.

    ``parts`` (node, doc_id, part): the nodes that are in a component already; other nodes are their own part.
    """
    sc = docs.sparkSession.sparkContext
    rare = sc.broadcast(frequent)
    small = parts.limit(SENT_ROWS + 1).count() <= SENT_ROWS
    if small:
        got = parts.select("node", "part").toPandas().sort_values("node")
        known = sc.broadcast((got["node"].to_numpy(dtype=np.int64), got["part"].to_numpy(dtype=np.int64)))
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("place", pa.int64()), ("part", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("jaccard")
        hasher, heavy = Hasher(words), rare.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                keys, nodes, places, posted = [], [], [], set()
                for s in hasher.sets(batch.column(1).slice(at, 256)):
                    if not len(s):
                        continue
                    node = node_of(s, clashes)
                    if node in posted:
                        continue
                    posted.add(node)
                    reach = prefix(len(s), percent)
                    if len(heavy):
                        pos = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
                        late = heavy[pos] == s
                        if late.any():
                            s = np.concatenate([s[~late], s[late]])
                    keys.append(s[:reach]), nodes.append(np.full(reach, node))
                    places.append((len(s) << 32) + np.arange(reach, dtype=np.int64))
                if not keys:
                    continue
                node = np.concatenate(nodes)
                part = node
                if small and len(known.value[0]):
                    ids, to = known.value
                    pos = np.minimum(np.searchsorted(ids, node), len(ids) - 1)
                    part = np.where(ids[pos] == node, to[pos], node)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_signed(np.concatenate(keys))), pa.array(node), pa.array(np.concatenate(places)), pa.array(part)], schema=schema
                )
        trimmed()

    out = docs.select("doc_id", "text").mapInArrow(run, "key bigint, node bigint, place bigint, part bigint")
    if not small:
        joined = out.drop("part").join(parts.select("node", "part"), "node", "left")
        out = joined.select("key", "node", "place", F.coalesce("part", "node").alias("part"))
    return out


def crossing(posted: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, a_part, b_part) of nodes of different parts that share a key and may be links, and long runs.

    Short runs of a key give their pairs as they are.  The rows of a long run (key, node, place, part) are
    for :func:`meet`, where the overlap bound comes before any pair.
    """
    kinds = [("a", pa.int64()), ("b", pa.int64()), ("a_part", pa.int64()), ("b_part", pa.int64()), ("long", pa.bool_())]
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, dtype=np.int64)] * 4

        def batch_of(a, b, a_part, b_part, long) -> pa.RecordBatch:
            table = pd.DataFrame({"a": a, "b": b, "a_part": a_part, "b_part": b_part, "long": long})
            return pa.RecordBatch.from_pandas(table if long else table.drop_duplicates(["a", "b"]), schema=schema, preserve_index=False)

        def pairs(key, node, place, part) -> Iterator[pa.RecordBatch]:
            # runs of one key, rows by size inside; keys that only one part has are gone at once
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            if not len(first):
                return
            lengths = np.diff(np.r_[first, len(key)])
            several = np.repeat(np.minimum.reduceat(part, first) != np.maximum.reduceat(part, first), lengths)
            many = np.repeat(lengths > RUN_ROWS, lengths)
            rows = several & many
            if rows.any():  # key, node, place, part
                yield batch_of(key[rows], node[rows], place[rows], part[rows], True)
            rows = several & ~many
            key, node, place, part = key[rows], node[rows], place[rows], part[rows]
            last = np.repeat(*_ends(key)) if len(key) else key
            size = place >> 32
            at, out = np.arange(len(key)), []
            for d in range(1, RUN_ROWS):  # row i meets the row d further on
                at = at[at + d < last[at]]
                at = at[size[at + d] * percent <= 100 * size[at]]
                if not len(at):
                    break
                fit = (part[at] != part[at + d]) & may_link(place[at], place[at + d], percent)
                out.append((at[fit], at[fit] + d))
            if out:
                i, j = (np.concatenate(x) for x in zip(*out, strict=True))
                flip = node[i] > node[j]
                i, j = np.where(flip, j, i), np.where(flip, i, j)
                if len(i):
                    yield batch_of(node[i], node[j], part[i], part[j], False)

        waiting = [held]
        for batch in batches:
            waiting.append([batch.column(i).to_numpy() for i in range(4)])
            if not _ended(waiting):
                continue
            now = [np.concatenate(c) for c in zip(*waiting, strict=True)]
            cut_at = int(np.searchsorted(now[0], now[0][-1], "left"))
            yield from pairs(*[x[:cut_at] for x in now])
            waiting = [[x[cut_at:] for x in now]]
        yield from pairs(*[np.concatenate(c) for c in zip(*waiting, strict=True)])
        trimmed()

    n = posted.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = posted.repartition(int(n), "key").select("key", "node", "place", "part").sortWithinPartitions("key", "place")
    made = cut(dealt.mapInArrow(run, "a bigint, b bigint, a_part bigint, b_part bigint, long boolean"))
    rows = made.where("long").select(F.col("a").alias("key"), F.col("b").alias("node"), F.col("a_part").alias("place"), F.col("b_part").alias("part"))
    return made.where("not long").drop("long"), rows


def _survivors(
    place: np.ndarray, part: np.ndarray, bitmaps: list[np.ndarray], percent: int, thin: bool
) -> tuple[np.ndarray, np.ndarray, bool]:
    """Index pairs of one run (rows by size) that the bitmaps leave, between different parts; whether ``thin`` left any out.

    Rows outside the run's largest part meet all others; that part's rows do not meet one another, however many.
    ``thin`` keeps the likeliest row of each part for each row: enough to join parts, not to be sure.
    """
    names, inverse, counts = np.unique(part, return_inverse=True, return_counts=True)
    largest = inverse == int(np.argmax(counts))
    size = place >> 32
    begins, ends = np.searchsorted(size, -(-percent * size // 100), "left"), np.searchsorted(size, 100 * size // percent, "right")
    widths = np.array([len(b) for b in bitmaps])
    stacks: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def stack(width: int) -> tuple[np.ndarray, np.ndarray]:
        if width not in stacks:
            rows = np.flatnonzero((widths >= width) & (widths <= 4 * width))
            at = np.full(len(widths), -1)
            at[rows] = np.arange(len(rows))
            stacks[width] = np.stack([_folded(bitmaps[r], width) for r in rows]), at
        return stacks[width]

    out, more = [], False
    for i in np.flatnonzero(~largest):
        j = np.arange(begins[i], ends[i])
        j = j[(inverse[j] != inverse[i]) & (largest[j] | (j > i))]
        j = j[may_link(place[i], place[j], percent)]
        if not len(j):
            continue
        least = np.minimum(widths[j], widths[i])
        differ = np.zeros(len(j), dtype=np.int64)
        for width in np.unique(least):
            here = least == width
            maps, at = stack(int(width))
            differ[here] = np.bitwise_count(maps[at[j[here]]] ^ maps[at[i]]).sum(axis=1)
        need = -(-percent * (size[i] + size[j]) // (100 + percent))
        kept = (size[i] + size[j] - differ) // 2 >= need
        j, differ = j[kept], differ[kept]
        if thin and len(j) > 1:
            order = np.argsort(differ / (size[i] + size[j]), kind="stable")
            likeliest = j[order[np.unique(inverse[j[order]], return_index=True)[1]]]
            more = more or len(likeliest) < len(j)
            j = likeliest
        out.append((np.full(len(j), i), j))
    i, j = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, dtype=np.int64),) * 2
    return i, j, more


def meet(rows: DataFrame, reps: DataFrame, percent: int, thin: bool) -> DataFrame:
    """Pairs (a, b, a_part, b_part, key) that the bitmaps leave among the long runs of :func:`crossing`; key is null.

    With ``thin`` the likeliest ones alone, and a row with nothing but the key for each run that had more.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("a", "b", "a_part", "b_part", "key")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, dtype=np.int64)] * 4
        maps: list[bytes] = []

        def pairs(key, node, place, part, maps) -> Iterator[pa.RecordBatch]:
            if not len(key):
                return
            ends, lengths = _ends(key)
            found, again = [], []
            for end, n in zip(ends.tolist(), lengths.tolist(), strict=True):
                own = slice(end - n, end)
                if (part[own] == part[end - 1]).all():
                    continue
                i, j, more = _survivors(place[own], part[own], [np.frombuffer(m, dtype=np.uint64) for m in maps[own]], percent, thin)
                found.append((i + end - n, j + end - n))
                if more:
                    again.append(key[end - 1])
            if found:
                i, j = (np.concatenate(x) for x in zip(*found, strict=True))
                flip = node[i] > node[j]
                i, j = np.where(flip, j, i), np.where(flip, i, j)
                table = pd.DataFrame({"a": node[i], "b": node[j], "a_part": part[i], "b_part": part[j]}).drop_duplicates(["a", "b"])
                columns = [pa.array(table[c].to_numpy(), pa.int64()) for c in table.columns]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(table), pa.int64())], schema=schema)
            if again:
                yield pa.RecordBatch.from_arrays([*[pa.nulls(len(again), pa.int64())] * 4, pa.array(again, pa.int64())], schema=schema)

        waiting = [kept]
        for batch in batches:
            waiting.append([batch.column(c).to_numpy() for c in range(4)])
            maps += batch.column(4).to_pylist()
            if not _ended(waiting):
                continue
            now = [np.concatenate(c) for c in zip(*waiting, strict=True)]
            cut_at = int(np.searchsorted(now[0], now[0][-1], "left"))
            yield from pairs(*[x[:cut_at] for x in now], maps[:cut_at])
            waiting, maps = [[x[cut_at:] for x in now]], maps[cut_at:]
        yield from pairs(*[np.concatenate(c) for c in zip(*waiting, strict=True)], maps)
        trimmed()

    n = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    rows = rows.join(reps.select("node", "bitmap"), "node")
    dealt = rows.repartition(int(n), "key").select("key", "node", "place", "part", "bitmap").sortWithinPartitions("key", "place")
    return dealt.mapInArrow(run, "a bigint, b bigint, a_part bigint, b_part bigint, key bigint")


def _ended(waiting: list[list[np.ndarray]]) -> bool:
    """Whether a key ends within what waits: the rows of a long one are joined once, not with every batch."""
    full = [x[0] for x in waiting if len(x[0])]
    return bool(full) and full[0][0] != full[-1][-1]


def _ends(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The end of each run, and the runs' lengths."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    ends = np.r_[first[1:], len(key)]
    return ends, ends - first


# --------------------------------------------------------------------------- verification


def _tiled(pairs: DataFrame, reps: DataFrame, load, passes) -> DataFrame:
    """The rows of ``pairs`` (a, b, ...) for which ``passes(data of a, data of b)``, in size-banded tiles.

    ``load(nodes)`` gives (node, data).  A tile is a size band and a share of the pairs; it gets each set's data
    once.  A set with very many candidates is spread over several tiles.
    """
    kinds, columns = dict(pairs.dtypes), pairs.columns
    buckets = max(1, -(-pairs.count() // TILE_PAIRS))
    degree = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("degree"))
    sized = pairs.join(degree, "b").join(reps.select(F.col("node").alias("b"), "n"), "b")
    spread = F.pmod(F.xxhash64("a"), F.ceil(F.col("degree") / SET_PAIRS))
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(4 / 3))).cast("int")
    tiles = cut(sized.select(*pairs.columns, F.xxhash64(band, F.pmod(F.xxhash64("b", spread), F.lit(buckets))).alias("tile")))
    ends = tiles.select(F.col("tile").alias("at"), F.explode(F.array("a", "b")).alias("node")).distinct()
    carried = ends.join(load(ends.select("node").distinct()), "node").select("at", "node", "data")

    def tile(links: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        held = {k: np.frombuffer(v, dtype=np.uint64) for k, v in zip(members["node"], members["data"], strict=True)}
        keep = [passes(held[a], held[b]) for a, b in zip(links["a"], links["b"], strict=True)]
        return links.loc[np.array(keep, dtype=bool), columns]

    schema = ", ".join(f"{c} {kinds[c]}" for c in columns)
    return tiles.groupBy("tile").cogroup(carried.groupBy("at")).applyInPandas(tile, schema)


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, words: int, percent: int, clashes: frozenset[int] = frozenset()) -> DataFrame:
    """The rows of ``pairs`` (a, b, ...) that are links.  ``reps`` (node, doc_id, n, bitmap): a document of each node."""
    sizes = reps.select("node", "n")
    pairs = cut(pairs)

    def bounded(x: np.ndarray, y: np.ndarray) -> bool:
        # the first word is the size, the rest the bitmap
        n, m = int(x[0]), int(y[0])
        words = min(len(x), len(y)) - 1
        differ = int(np.bitwise_count(_folded(x[1:], words) ^ _folded(y[1:], words)).sum())
        return (n + m - differ) // 2 >= required(n, m, percent)

    def bitmaps(nodes: DataFrame) -> DataFrame:
        little = F.unhex(F.regexp_replace(F.lpad(F.hex("n"), 16, "0"), "(..)(..)(..)(..)(..)(..)(..)(..)", "$8$7$6$5$4$3$2$1"))
        return reps.join(nodes, "node").select("node", F.concat(little, F.col("bitmap")).alias("data"))

    likely = cut(_tiled(pairs, sizes, bitmaps, bounded))

    def whole(nodes: DataFrame) -> DataFrame:
        return arrays(docs, cut(nodes.join(reps.select("node", "doc_id"), "node")), words, clashes).withColumnRenamed("s", "data")

    def linked(x: np.ndarray, y: np.ndarray) -> bool:
        return len(np.intersect1d(x, y, assume_unique=True)) >= required(len(x), len(y), percent)

    return _tiled(likely, sizes, whole, linked)


def close(held: DataFrame, percent: int, banded: bool, *order: str) -> DataFrame:
    """(a, b): each node of ``held`` (node, n, key, ...) with a leader and the next ones, in the given order, that share a key.

    The leader is the first of the key's rows, or of those in its size band.  Linear, and streamed: however many
    share a key, a task holds a few rows.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, dtype=np.int64)] * 3
        lead: tuple[int, int, int, int] | None = None  # key, band, n, node
        for batch in batches:
            old = len(kept[0])
            key, n, node = (np.concatenate([k, batch.column(i).to_numpy()]) for i, k in enumerate(kept))
            if len(key) == old:
                continue
            found = []
            for d in range(1, NEIGHBOURS + 1):
                i = np.arange(max(0, old - d), len(key) - d)
                found.append((key[i], key[i + d], n[i], n[i + d], node[i], node[i + d]))
            own = slice(old, None)
            band = np.floor(np.log(n[own]) / math.log(100 / percent)).astype(np.int64) if banded else np.zeros(len(key) - old, np.int64)
            first = np.r_[lead is None or (key[old], band[0]) != lead[:2], (key[own][1:] != key[own][:-1]) | (band[1:] != band[:-1])]
            at = np.maximum.accumulate(np.where(first, np.arange(len(first)), -1))
            l_n, l_node = n[own][at], node[own][at]
            if lead is not None:
                l_n, l_node = np.where(at < 0, lead[2], l_n), np.where(at < 0, lead[3], l_node)
            found.append((key[own], key[own], l_n, n[own], l_node, node[own]))
            lead = (int(key[-1]), int(band[-1]), int(l_n[-1]), int(l_node[-1]))
            k, m, x, y, a, b = (np.concatenate(c) for c in zip(*found, strict=True))
            fit = (k == m) & (np.maximum(x, y) * percent <= 100 * np.minimum(x, y)) & (a != b)
            a, b = a[fit], b[fit]
            table = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()
            yield pa.RecordBatch.from_pandas(table, schema=schema, preserve_index=False)
            kept = [x[-NEIGHBOURS:] for x in (key, n, node)]

    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = held.select("key", "n", "node", *[c for c in order if c != "n"]).repartition(parts, "key")
    dealt = dealt.sortWithinPartitions("key", *order, "node").select("key", "n", "node")
    return dealt.mapInArrow(run, "a bigint, b bigint")


# ----------------------------------------------------------------------------- components


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a bounded number of edges."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(up.setdefault(u, u)), top(up.setdefault(v, v))
            up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], names=["node", "part"])


def components(links: DataFrame) -> DataFrame:
    """(node, part): the smallest node of each node's component, for nodes with links (a, b).

    Up to ``LOCAL_EDGES`` links (checked: some megabytes) one task joins them.  Beyond that, large-star and
    small-star steps in turn; a round is a few joins over the remaining edges, which the shared folder keeps.
    """
    edges = cut(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if edges.count() <= LOCAL_EDGES:
        return edges.coalesce(1).mapInArrow(_joined, "node bigint, part bigint")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("x"), "u", "m")
        small = small.select(F.explode(F.array("x", "u")).alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        edges = cut(small)
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("part")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("part")).distinct()
    )


# --------------------------------------------------------------------------------- whole


def near_duplicates(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row; links: ``100 |x & y| >= percent |x | y|``."""
    spark = documents.sparkSession
    arrow_size(spark, BATCH_ROWS)
    docs = narrowed(documents, doc_id="bigint", text="string")
    clashes: frozenset[int] = frozenset()
    while True:
        seen = cut(sets(docs, words, clashes))
        rows = seen.where(F.col("n").isNotNull())
        same = [F.first(c).alias(c) for c in ("n", "minima", "bitmap")]
        nodes = cut(rows.where(F.col("n") > 0).groupBy("node").agg(F.min("doc_id").alias("doc_id"), *same, (F.min("half") != F.max("half")).alias("clash")))
        # different sets of one number: a handful among 10^10, by the size of the number
        more = frozenset(r["node"] for r in nodes.where("clash").select("node").collect()) - clashes
        if not more:
            break
        clashes = clashes | more
    total = nodes.count()
    often = seen.where(F.col("n").isNull()).select(F.inline(F.arrays_zip(F.col("minima").alias("key"), F.col("counts").alias("c"))))
    often = often.groupBy("key").agg(F.sum("c").alias("c")).where(F.col("c") > max(16, total // RARE))
    frequent = np.sort(often.select("key").toPandas()["key"].to_numpy(dtype=np.int64).view(np.uint64))

    # round 1: with leaders and neighbours among those that share a minimum, once by size and once by the next
    # two minima (what they sort together is alike)
    held = nodes.select("node", "n", "minima", F.posexplode("minima").alias("at", "key"))
    another = lambda d: F.get("minima", (F.col("at") + d) % F.size("minima"))
    held = held.select("node", "n", "key", another(1).alias("next"), another(2).alias("after"))
    stars = close(held, percent, True, "n").unionByName(close(held, percent, False, "next", "after")).distinct()
    reps = nodes.select("node", "doc_id", "n", "bitmap")
    first = cut(components(cut(verified(stars, reps, docs, words, percent, clashes))))

    # round 2: every remaining pair that can be a link
    standing = first.join(reps.select("node", "doc_id"), "node").select("node", "doc_id", "part")
    posted = postings(docs, standing, frequent, words, percent, clashes)
    short, long = crossing(posted, percent)
    # the likeliest pairs first: what they join need not meet again
    met = cut(meet(long, reps, percent, thin=True))
    likely = met.where(F.col("key").isNull()).drop("key").dropDuplicates(["a", "b"])
    probes = verified(likely, reps, docs, words, percent, clashes)
    nearer = cut(components(cut(probes.select(F.col("a_part").alias("a"), F.col("b_part").alias("b")).distinct())))
    renamed = nearer.select(F.col("node").alias("part"), F.col("part").alias("now"))

    def moved(df: DataFrame, column: str) -> DataFrame:
        out = df.join(renamed.withColumnRenamed("part", column), column, "left")
        return out.withColumn(column, F.coalesce("now", column)).drop("now")

    # runs that gave all their pairs are done
    rest = long.join(met.select("key").where(F.col("key").isNotNull()), "key", "left_semi")
    pairs = meet(moved(rest, "part"), reps, percent, thin=False).drop("key").unionByName(moved(moved(short, "a_part"), "b_part"))
    pairs = pairs.where(F.col("a_part") != F.col("b_part")).dropDuplicates(["a", "b"])
    second = cut(verified(pairs, reps, docs, words, percent, clashes).select(F.col("a_part").alias("a"), F.col("b_part").alias("b")).distinct())
    farther = components(second).select(F.col("node").alias("now"), F.col("part").alias("whole"))
    # from the parts of the first round, by way of those after the probes, to the components
    joined = renamed.join(farther, "now", "full_outer")
    joined = cut(joined.select(F.coalesce("part", "now").alias("part"), F.coalesce("whole", "now").alias("whole")))

    named = rows.select("doc_id", "n", "node").join(first, "node", "left")
    named = named.select("doc_id", "n", F.coalesce("part", "node").alias("part")).join(joined, "part", "left")
    named = cut(named.select("doc_id", "n", F.when(F.col("n") > 0, F.coalesce("whole", "part")).alias("part")))
    least = named.where(F.col("part").isNotNull()).groupBy("part").agg(F.min("doc_id").alias("component_id"))
    out = named.join(least, "part", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def ngram_jaccard(spark: SparkSession, documents: DataFrame) -> DataFrame:
    return near_duplicates(documents)
