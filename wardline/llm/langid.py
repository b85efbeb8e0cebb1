"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary.  A word's
probability is the sum over *all* ways of cutting it into pieces (the forward algorithm), a
text's the product over its words; the language with the largest posterior wins.

Training fits the piece probabilities by expectation-maximisation (forward-backward) on the word
counts of about ``FIT_DOCS`` documents a language, chosen by a hash of the doc_id: the one
bounded sample here.  Every word of these counts; a language is fitted by one task, some words at a
time.  The model has a row of probabilities for each language; it is sent in blocks of ``BLOCK_LANGS``
languages (16 MB), however many there are.  Prediction reads every whole text.

Defined cases: null text, or text without any letter -> ``und`` with score 0.0; null lang ->
not learned from; no training rows at all -> every text with a letter is ``und`` too; repeated
rows are predicted each on their own; ties go to the language that sorts first; extra columns
are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_size, listed, narrowed, remembered, trimmed

#: Documents a language to learn from, about.
FIT_DOCS = 1500
#: Distinct words fitted at once; all take part.
STRETCH_WORDS = 20_000
#: Languages of one broadcast.
BLOCK_LANGS = 64
#: Rounds of expectation-maximisation.
ROUNDS = 3
#: Longest piece, in code points.
PIECE_CHARS = 8
#: Longest run of letters scored as one word; longer runs are cut into such stretches.
WORD_CHARS = 48
#: Words a worker remembers, at most.
CACHE_WORDS = 300_000
#: Weight of the evidence of one word: words of one text are not independent.
TEMPER = 0.5

VOCABULARY = "piece_bpe_32k.model"


def vocabulary(name: str = VOCABULARY) -> list[str]:
    """The pieces of the public vocabulary: lower case, letters only, without word-start marks."""
    import public_tokenizers
    import sentencepiece

    path = name if "/" in name else public_tokenizers.path(name)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    kept = (p.replace("▁", "").lower() for p in pieces)
    return sorted({p for p in kept if p and len(p) <= PIECE_CHARS and p.isalpha()})


def words_of(text: str) -> list[str]:
    """Maximal runs of letters, lower case, composed (NFC), long runs cut."""
    text = unicodedata.normalize("NFC", text).lower()
    runs = _LETTERS.findall(text)
    if runs and not "".join(runs).isalpha():  # superscript digits and the like count as word characters
        runs = [x for r in runs if (x := "".join(filter(str.isalpha, r)))]
    if max(map(len, runs), default=0) > WORD_CHARS:
        runs = [r[i : i + WORD_CHARS] for r in runs for i in range(0, len(r), WORD_CHARS)]
    return runs


_LETTERS = re.compile(r"[^\W\d_]+")


class Pieces:
    """Piece ids of substrings, by a tree of prefixes; unknown single characters share one extra id."""

    def __init__(self, pieces: list[str]):
        self.unknown = len(pieces)
        self.size = len(pieces) + 1
        self.chars = np.array(sorted({ord(c) for p in pieces for c in p}), dtype=np.int64)
        number = {chr(c): i + 1 for i, c in enumerate(self.chars.tolist())}  # 0: in no piece
        self.width = len(number) + 1
        steps: dict[int, int] = {}  # node and character -> node
        ends = {}
        for i, p in enumerate(pieces):
            node = 0
            for c in p:
                node = steps.setdefault(node * self.width + number[c], len(steps) + 1)
            ends[node] = i
        self.keys = np.array(sorted(steps), dtype=np.int64)
        self.nodes = np.array([steps[k] for k in self.keys.tolist()], dtype=np.int64)
        self.piece = np.full(len(steps) + 1, -1, dtype=np.int64)
        self.piece[list(ends)] = list(ends.values())

    def lattice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Edges (word, start, end, piece) of all segmentations of ``words``, word by word; all words go down the tree together."""
        lengths = np.array([len(x) for x in words], dtype=np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        if not len(codes) or not len(self.keys):
            w = np.repeat(np.arange(len(words)), lengths)
            s = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            return w, s, s + 1, np.full(len(codes), self.unknown, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.chars, codes), len(self.chars) - 1)
        char = np.where(self.chars[at] == codes, at + 1, 0)
        word = np.repeat(np.arange(len(words)), lengths)
        start = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        left = lengths[word] - start
        pos, node = np.arange(len(codes)), np.zeros(len(codes), dtype=np.int64)
        found = []
        for n in range(1, PIECE_CHARS + 1):
            some = left[pos] >= n
            pos, node = pos[some], node[some]
            key = node * self.width + char[pos + n - 1]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[at] == key
            pos, node = pos[on], self.nodes[at[on]]
            piece = self.piece[node]
            if n == 1:
                single = np.full(len(codes), -1, dtype=np.int64)
                single[pos] = piece
                found.append((np.arange(len(codes)), np.where(single < 0, self.unknown, single), 1))
            else:
                end = piece >= 0
                found.append((pos[end], piece[end], n))
            if not len(pos):
                break
        at = np.concatenate([x for x, _, _ in found])
        p = np.concatenate([x for _, x, _ in found])
        n = np.repeat([x for _, _, x in found], [len(x) for x, _, _ in found])
        order = np.argsort(at, kind="stable")
        at, p, n = at[order], p[order], n[order]
        return word[at], start[at], start[at] + n, p


def forward(words: list[str], pieces: Pieces, logp: np.ndarray) -> np.ndarray:
    """log of the summed probability of all segmentations; one row a word, one column a language."""
    if not words:
        return np.zeros((0, logp.shape[1]))
    w, s, e, p = pieces.lattice(words)
    lengths = np.array([len(x) for x in words])
    alpha = np.full((len(words), int(lengths.max()) + 1, logp.shape[1]), -np.inf)
    alpha[:, 0] = 0.0
    order = np.argsort(e, kind="stable")
    w, s, e, p = w[order], s[order], e[order], p[order]
    cuts = np.searchsorted(e, np.arange(1, alpha.shape[1] + 1))
    for end in range(1, alpha.shape[1]):
        a, b = cuts[end - 1], cuts[end]
        if a == b:
            continue
        ws, inc = w[a:b], alpha[w[a:b], s[a:b]] + logp[p[a:b]]
        # edges of one word are adjacent: they were listed word by word and the sort is stable
        first = np.flatnonzero(np.r_[True, ws[1:] != ws[:-1]])
        top = np.maximum.reduceat(inc, first, axis=0)
        spread = np.repeat(top, np.diff(np.r_[first, len(ws)]), axis=0)
        alpha[ws[first], end] = top + np.log(np.add.reduceat(np.exp(inc - spread), first, axis=0))
    return alpha[np.arange(len(words)), lengths]


def _expected(words: list[str], n: np.ndarray, table: Pieces, prob: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece in ``words`` that occur ``n`` times, by forward-backward."""
    w, s, e, p = table.lattice(words)
    lengths = np.array([len(x) for x in words], dtype=np.int64)
    width = int(lengths.max(initial=0)) + 1
    up, down = np.argsort(e, kind="stable"), np.argsort(-s, kind="stable")
    alpha, beta = np.zeros((len(words), width)), np.zeros((len(words), width))
    alpha[:, 0] = 1.0
    beta[np.arange(len(words)), lengths] = 1.0
    edge = prob[p] * 1000.0 ** (e - s)  # a factor for each character: no underflow, and it cancels
    for end in range(1, width):
        sel = up[np.searchsorted(e[up], end) : np.searchsorted(e[up], end, "right")]
        np.add.at(alpha[:, end], w[sel], alpha[w[sel], s[sel]] * edge[sel])
    starts = -s[down]
    for start in range(width - 1, -1, -1):
        sel = down[np.searchsorted(starts, -start) : np.searchsorted(starts, -start, "right")]
        np.add.at(beta[:, start], w[sel], beta[w[sel], e[sel]] * edge[sel])
    total = alpha[np.arange(len(words)), lengths]
    share = n[w] * alpha[w, s] * edge * beta[w, e] / np.maximum(total[w], 1e-300)
    return np.bincount(p, weights=share, minlength=table.size)


def fit_one(words: list[str], n: np.ndarray, table: Pieces, rounds: int = ROUNDS) -> np.ndarray:
    """log P(piece) of one language from its distinct words, ``STRETCH_WORDS`` at a time."""
    order = sorted(range(len(words)), key=lambda i: (len(words[i]), words[i]))  # words of a stretch are about as long
    words, n = [words[i] for i in order], np.asarray(n, dtype=float)[order]
    prob = np.full(table.size, 1.0 / table.size)
    for _ in range(rounds):
        expected = np.full(table.size, 0.01)
        for at in range(0, len(words), STRETCH_WORDS):
            expected += _expected(words[at : at + STRETCH_WORDS], n[at : at + STRETCH_WORDS], table, prob)
        prob = expected / expected.sum()
    return np.log(prob)


def fit(counts: dict[str, Counter], pieces: list[str], rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log P(piece | language): one row a piece, one column a language."""
    langs = sorted(counts)
    table = Pieces(pieces)
    logp = np.zeros((table.size, len(langs)))
    for at, lang in enumerate(langs):
        logp[:, at] = fit_one(list(counts[lang]), np.array(list(counts[lang].values()), dtype=float), table, rounds)
    return langs, logp


class Scorer:
    """Log likelihoods of words, remembered up to a bound."""

    def __init__(self, pieces: list[str], langs: list[str], logp: np.ndarray):
        self.pieces, self.langs, self.logp = Pieces(pieces), langs, logp
        self.ids: dict[str, int] = {}
        self.rows = np.zeros((0, len(langs)))

    def _learn(self, new: list[str], known: int) -> None:
        if known + len(new) > len(self.rows):  # by doubling: rows are not copied for each batch
            grown = np.zeros((max(2 * len(self.rows), known + len(new)), len(self.langs)))
            grown[:known] = self.rows[:known]
            self.rows = grown
        new.sort(key=len)
        for i in range(0, len(new), STRETCH_WORDS // 4):
            part = new[i : i + STRETCH_WORDS // 4]
            for x, row in zip(part, forward(part, self.pieces, self.logp), strict=True):
                self.rows[self.ids[x]] = row

    def totals(self, texts: list[str | None]) -> Iterator[np.ndarray | None]:
        """Tempered log likelihoods of each text, one for each language; None without a letter."""
        split = [words_of(t) if t else [] for t in texts]
        if len(self.ids) > CACHE_WORDS:
            self.ids, self.rows = {}, np.zeros((0, len(self.langs)))
        ids, new = self.ids, []
        known = len(ids)
        for words in split:
            for x in words:
                if x not in ids:
                    ids[x] = known + len(new)
                    new.append(x)
        if new:
            self._learn(new, known)
        for words in split:
            if not words or not self.langs:
                yield None
                continue
            at = np.fromiter(map(ids.__getitem__, words), dtype=np.int64, count=len(words))
            yield TEMPER * self.rows[at].sum(axis=0)

    def posteriors(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        langs, scores = [], np.zeros(len(texts))
        for k, total in enumerate(self.totals(texts)):
            if total is None:
                langs.append("und")
                continue
            best = int(np.argmax(total))
            langs.append(self.langs[best])
            scores[k] = 1.0 / np.exp(total - total[best]).sum()
        return langs, scores


def training_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of the bounded sample: about FIT_DOCS documents a language, with all their words.

    ``docs`` (doc_id, text, lang) are the rows that may be learned from.  What the driver holds has a row for each language.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).toPandas()
    spark = docs.sparkSession
    if not len(sizes):
        return listed(spark, [], lang="string", word="string", n="bigint")
    shares = [(lang, min(1_000_000, math.ceil(FIT_DOCS / n * 1_000_000))) for lang, n in zip(sizes["lang"], sizes["n"].tolist(), strict=True)]
    shares = F.broadcast(listed(spark, shares, lang="string", _share="int"))  # two values a language
    sample = usable.join(shares, "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < F.col("_share"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("langid")
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            langs, words = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(list(held.values()), pa.int64())], names=["lang", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.update((lang, x) for x in words_of(text))
                if len(held) > STRETCH_WORDS:
                    yield out()
                    held.clear()
        if held:
            yield out()

    counted = sample.select("lang", "text").mapInArrow(count, "lang string, word string, n bigint")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, vocabulary_file: str = VOCABULARY):
    """(pieces, languages, log probabilities) from the rows of ``docs`` that may be learned from; a task fits a language."""
    pieces = vocabulary(vocabulary_file)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        remembered("langid")
        pdf = pdf.sort_values("word")
        logp = fit_one(pdf["word"].tolist(), pdf["n"].to_numpy(), Pieces(vocabulary(vocabulary_file)))
        return pd.DataFrame({"lang": pdf["lang"].iloc[:1], "logp": [logp.tobytes()]})

    got = training_counts(docs).groupBy("lang").applyInPandas(one, "lang string, logp binary").toPandas().sort_values("lang")
    rows = [np.frombuffer(x) for x in got["logp"]]
    logp = np.stack(rows, axis=1) if rows else np.zeros((len(pieces) + 1, 0))
    return pieces, got["lang"].tolist(), logp


def _scorer(model: str, block: int, made) -> Scorer:
    """A worker's scorers are those of one model, by block of languages."""
    scorers: dict[tuple[str, int], Scorer] = remembered("langid")
    if (model, block) not in scorers:
        for key in [k for k in scorers if k[0] != model]:
            del scorers[key]
        scorers[model, block] = Scorer(*made())
    return scorers[model, block]


def identify(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score; text may be null.  No shuffle, and only ``text`` goes to Python.

    Each block of languages gives its best language, that one's log likelihood and the block's mass relative to it.
    """
    pieces, langs, logp = model
    sc = docs.sparkSession.sparkContext
    name = uuid.uuid4().hex
    arrow_size(docs.sparkSession, 1024)

    def judge(block: int):
        own = slice(block * BLOCK_LANGS, (block + 1) * BLOCK_LANGS)
        sent = sc.broadcast((pieces, langs[own], np.ascontiguousarray(logp[:, own])))  # BLOCK_LANGS x pieces doubles at most

        @F.arrow_udf("struct<lang:string,top:double,mass:double>")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            scorer = _scorer(name, block, lambda: sent.value)
            for batch in batches:
                found: list[tuple] = []
                for at in range(0, len(batch), 256):
                    for total in scorer.totals(batch.slice(at, 256).to_pylist()):
                        if total is None:
                            found.append((None, None, None))
                        else:
                            best = int(np.argmax(total))
                            found.append((scorer.langs[best], float(total[best]), float(np.exp(total - total[best]).sum())))
                columns = list(zip(*found, strict=True)) or [()] * 3
                kinds = (pa.string(), pa.float64(), pa.float64())
                yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["lang", "top", "mass"])
            trimmed()

        return run(F.col(text)).alias(f"_block{block}")

    count = -(-len(langs) // BLOCK_LANGS)
    if not count:
        return docs.select("*", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    blocks = [F.col(f"_block{i}") for i in range(count)]
    judged = docs.select("*", *[judge(i) for i in range(count)])
    best = blocks[0]
    for other in blocks[1:]:  # ties go to the earlier block, so to the language that sorts first
        best = F.when(other["top"] > best["top"], other).otherwise(best)
    if count > 1:
        judged = judged.withColumn("_best", best)
        best = F.col("_best")
    mass = sum((b["mass"] * F.exp(b["top"] - best["top"]) for b in blocks), F.lit(0.0))
    return judged.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.coalesce(best["lang"], F.lit("und")).alias("lang_pred"),
        F.coalesce(F.lit(1.0) / mass, F.lit(0.0)).alias("score"),
    )


def learnable() -> F.Column:
    """True for the rows that may be learned from: crc32(doc_id as text) mod 3 is not 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1, F.lit(False))


def language_id(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``documents``."""
    docs = narrowed(documents, doc_id="bigint", text="string", lang="string")
    model = train(docs.where(learnable()))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
