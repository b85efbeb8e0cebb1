"""Cost-balanced packing of token sequences.

A piece of l tokens costs ``LINEAR * l + QUADRATIC * l^2`` (attention inside a document grows with
the square).  Within a window of documents the number of sequences is fixed by the tokens, and
pieces go in descending length to the sequence of the lowest cost so far that still has room for
them; a piece that fits nowhere whole is cut at the room of the emptiest sequence.

Tokens never move: a task tokenises its rows and packs them in windows of ``WINDOW_TOKENS`` (so its
memory is bounded, however long a document is), without any shuffle.  What is left of a window beyond
full sequences is laid out in sequences of power-of-two lengths, which need no padding.  Sequence ids
are made of the task's number and a counter, so a repeated task repeats them.

Tokenising is by word: the public tokenizer's rules never look across white space, so the ids of a
text are the ids of its chunks between spaces and line ends, and a bounded dictionary remembers those.

Defined cases: null and empty texts have one token, the end id; repeated rows are packed each on their
own; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_size, narrowed, remembered, trimmed

CAPACITY = 4096
END_ID = 2
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: Tokens gathered before they are packed: 16 MB of ids.
WINDOW_TOKENS = 4 << 20
#: Pieces of one Arrow batch: of a window's ids, no more than 4 MB are copied at once.
BATCH_PIECES = 256
#: Chunks a worker remembers, about, the first ones (mostly the frequent ones) that it keeps when these are too many, and their longest length.
CACHE_CHUNKS, KEPT_CHUNKS, CACHE_BYTES = 400_000, 200_000, 64
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


class Encoder:
    """Texts to little-endian 32-bit ids, by remembered chunks.

    Chunks are bytes with A-Z lower-cased (the tokenizer lower-cases anyway).  A chunk that ends in one
    full stop or comma after a letter is its word and that mark, as the tokenizer splits there.
    """

    MARK = "|"  # stands alone between unknown chunks that are encoded as one text
    LAST = "</w>"  # how the pieces that end a word are written in the vocabulary

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = np.array([END_ID], dtype="<u4").tobytes()
        self.stops = {c: self._plain(c.decode()) for c in (b".", b",")}
        mark = np.frombuffer(self._plain(self.MARK), dtype="<u4")
        self.mark = int(mark[0]) if len(mark) == 1 else None
        self.known: dict[bytes, bytes] = {}
        pieces = self.tokenizer.get_vocab()
        self.last = np.zeros(max(pieces.values(), default=0) + 1, dtype=bool)
        self.last[[i for piece, i in pieces.items() if piece.endswith(self.LAST)]] = True

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of chunks of letters, cut after the pieces that end a word; nothing if these are not one a chunk.

        A chunk has one such piece at least, so as many of them as chunks are one each.
        """
        if not words:
            return {}
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return {}
        data, at, out = ids.tobytes(), 0, {}
        for word, end in zip(words, (4 * ends).tolist(), strict=True):
            out[word] = data[at:end]
            at = end
        return out

    def _encoded(self, chunks: list[bytes]) -> list[bytes]:
        out = self._words([c for c in chunks if c.isalpha()])  # ASCII letters
        out |= self._words([c for c in chunks if not c.isascii() and c.decode().isalpha()])
        joint = [c for c in chunks if c not in out and self.MARK.encode() not in c and c] if self.mark is not None else []
        if joint:
            text = f" {self.MARK} ".join(c.decode() for c in joint)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.r_[np.flatnonzero(ids == self.mark), len(ids)]
            data, at = ids.tobytes(), 0
            if len(ends) != len(joint):
                raise AssertionError("the mark is not alone")
            for c, end in zip(joint, ends.tolist(), strict=True):
                out[c] = data[4 * at : 4 * end]
                at = end + 1
        return [out[c] if c in out else self._plain(c.decode()) for c in chunks]

    def _learn(self, chunks: list[bytes]) -> None:
        known = self.known
        halves = [(c, c[:-1]) for c in chunks if c[-1:] in self.stops and _ends_in_letter(c[:-1].decode())]
        stopped = {c for c, _ in halves}
        words = {w for _, w in halves if w not in known}.union(c for c in chunks if c not in stopped)
        words = list(words)
        known.update(zip(words, self._encoded(words), strict=True))
        known.update((c, known[w] + self.stops[c[-1:]]) for c, w in halves)

    def batch(self, texts: list[bytes | None]) -> Iterator[bytes]:
        """``texts`` in UTF-8."""
        if len(self.known) > CACHE_CHUNKS:
            self.known = dict(islice(self.known.items(), KEPT_CHUNKS))
        known = self.known
        for at in range(0, len(texts), 256):
            some = [t or b"" for t in texts[at : at + 256]]
            # texts that may hold a special token are encoded whole: those are case-sensitive
            split = [None if b"<|" in t else t.lower().replace(b"\n", b" ").split(b" ") for t in some]
            found = [chunks and list(map(known.get, chunks)) for chunks in split]
            gaps = [list(_gaps(parts)) if parts else [] for parts in found]
            new = {chunks[i] for chunks, holes in zip(split, gaps, strict=True) for i in holes}
            long = [c for c in new if len(c) > CACHE_BYTES]
            here = dict(zip(long, self._encoded(long), strict=True))
            self._learn([c for c in new if len(c) <= CACHE_BYTES])
            for text, chunks, parts, holes in zip(some, split, found, gaps, strict=True):
                if chunks is None:
                    yield self._plain(text.decode()) + self.end
                    continue
                for i in holes:
                    c = chunks[i]
                    parts[i] = known[c] if c in known else here[c]
                yield b"".join(parts) + self.end


def _ends_in_letter(word: str) -> bool:
    """As the tokenizer sees it: composed and in lower case, which may end in a mark that a stop would join."""
    return unicodedata.normalize("NFC", word).lower()[-1:].isalpha()


def _gaps(parts: list) -> Iterator[int]:
    at = -1
    try:
        while True:
            at = parts.index(None, at + 1)
            yield at
    except ValueError:
        return


def encoder(path: str) -> Encoder:
    """One for each worker process, kept from task to task."""
    encoders = remembered("packing")
    if path not in encoders:
        encoders[path] = Encoder(path)
    return encoders[path]


def cost(length: int) -> float:
    return LINEAR * length + QUADRATIC * length * length


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one window; ``lengths`` are positive.

    All sequences but the last few are full; the last ones have power-of-two lengths.
    """
    total = sum(lengths)
    count, rest = divmod(total, capacity)
    out: list[tuple[int, int, int, int, int]] = []
    room, fill, spent = [capacity] * count, [0] * count, [0.0] * count
    # sequences with room for the current piece, by cost, and the others, by falling room: pieces only get shorter
    cheap, narrow = [(0.0, s) for s in range(count)], []
    todo = []
    for doc, n in enumerate(lengths):
        for start in range(0, n, capacity):
            todo.append((-min(capacity, n - start), doc, start))
    heapq.heapify(todo)
    tail: list[tuple[int, int, int]] = []

    def put(s: int, doc: int, start: int, n: int) -> None:
        out.append((doc, start, n, s, fill[s]))
        fill[s] += n
        room[s] -= n
        spent[s] += cost(n)
        if room[s] >= n:
            heapq.heappush(cheap, (spent[s], s))
        elif room[s]:
            heapq.heappush(narrow, (-room[s], s))

    spare = rest  # tokens that may stay for the tail
    while todo:
        n, doc, start = heapq.heappop(todo)
        n = -n
        while narrow and -narrow[0][0] >= n:
            s = heapq.heappop(narrow)[1]
            heapq.heappush(cheap, (spent[s], s))
        if cheap:
            put(heapq.heappop(cheap)[1], doc, start, n)
        elif n <= spare:
            tail.append((doc, start, n))
            spare -= n
        else:  # nowhere whole: cut it at the room of the emptiest sequence, or of the tail
            part = -narrow[0][0] if narrow else spare
            if narrow:
                put(heapq.heappop(narrow)[1], doc, start, part)
            else:
                tail.append((doc, start, part))
                spare -= part
            heapq.heappush(todo, (part - n, doc, start + part))
    sequence = count
    sizes = [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if rest >> b & 1]
    offset = 0
    for doc, start, n in tail:
        while n:
            part = min(n, sizes[0] - offset)
            out.append((doc, start, part, sequence, offset))
            start, n, offset = start + part, n - part, offset + part
            if offset == sizes[0]:
                sizes.pop(0)
                sequence, offset = sequence + 1, 0
    return out


SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)


def packed(documents: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with their token ids (little-endian 32 bits): doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    docs = narrowed(documents, doc_id="bigint", text="string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary_path(vocabulary)).batch
        base, used = TaskContext.get().partitionId() << 40, 0
        held: list[tuple[int | None, int, int, bytes]] = []  # doc_id, ids before, all ids, ids
        tokens = 0

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal used, held, tokens
            pieces = pack([len(x[3]) // 4 for x in held], capacity)
            for at in range(0, len(pieces), BATCH_PIECES):
                part = pieces[at : at + BATCH_PIECES]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([held[d][0] for d, *_ in part], pa.int64()),
                        pa.array([held[d][1] + s for d, s, *_ in part], pa.int64()),
                        pa.array([n for _, _, n, _, _ in part], pa.int64()),
                        pa.array([held[d][3][4 * s : 4 * (s + n)] for d, s, n, _, _ in part], pa.binary()),
                        pa.array([held[d][2] for d, *_ in part], pa.int64()),
                        pa.array([base + used + q for _, _, _, q, _ in part], pa.int64()),
                        pa.array([o for *_, o in part], pa.int64()),
                    ],
                    schema=_ARROW,
                )
            used += max((p[3] for p in pieces), default=-1) + 1
            held, tokens = [], 0

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            for doc, data in zip(ids, encode(texts), strict=True):
                n, before = len(data) // 4, 0
                while before < n:  # a document may be longer than a window
                    part = data[4 * before : 4 * (before + WINDOW_TOKENS - tokens)]
                    held.append((doc, before, n, part))
                    tokens += len(part) // 4
                    before += len(part) // 4
                    if tokens >= WINDOW_TOKENS:
                        yield from emit()
        if held:
            yield from emit()
        trimmed()

    return docs.mapInArrow(run, SCHEMA)


def pieces(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """The contract's columns: ids as their crc32."""
    arrow_size(spark, 1024)
    return packed(documents).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
