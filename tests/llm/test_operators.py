"""The training-data operators against brute force, on small fixtures with nulls, ties, repeats and odd columns."""

import hashlib
import json
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wardline.llm import chat, common, jaccard, langid, licences, mixing, packing, pii, shingles, simhash, topk, wrappers

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


def docs(spark, texts, **more):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd(df):
    """The same table with extra columns whose names clash."""
    return df.selectExpr("*", "1 as TEXT", "2 as Doc_Id", "3 as n", "4 as value", "5 as score", "6 as part")


def test_narrowed_takes_exact_names(spark):
    df = odd(docs(spark, ["a"]))
    assert common.narrowed(df, doc_id="bigint", text="string", nowhere="int").first() == (0, "a", None)


# ------------------------------------------------------------------------------ op 1


def test_licences(spark):
    texts = [
        None, "", "plain prose about nothing", "x\nReleased under the MIT License.\ny", "Licensed under the Apache License, Version 2.0.",
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "All rights reserved.",
        "we permit the use of software in every form of the work", "word " * 20000 + "\nSPDX-License-Identifier: MPL-2.0", "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.",
    ]
    filler = [f"ordinary line number {i} speaks of rivers and copies of books under the bridge\nand then of more" for i in range(40)]
    got = {r.doc_id: r for r in licences.licence_scan(spark, odd(docs(spark, texts + filler))).collect()}
    assert [got[i].licence for i in range(10)] == ["none", "none", "none", "mit", "apache", "gpl", "cc", "proprietary", "none", "mpl"]
    assert got[10].families == "apache,mit" and got[10].n_paragraphs == 2
    assert all(got[len(texts) + i].licence == "none" for i in range(40)) and len(got) == len(texts) + 40
    assert licences.licence_scan(spark, docs(spark, [])).count() == 0


# ------------------------------------------------------------------------------ op 2


def brute_chat(rows):
    out = {}
    turns = defaultdict(list)
    for c, t, role, text in [*rows, (-1, 0, "user", chat.PROBE[1]), (-1, 1, "assistant", chat.PROBE[1])]:
        turns[c].append(((t is not None, t or 0), role or "", text or ""))
    for c, ts in turns.items():
        ts.sort()
        told = "".join(f"{r}\n{t}\n" for _, r, t in ts)
        loss = "".join(t for _, r, t in ts if r == "assistant")
        out[c] = (len(ts), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


ODD_TURNS = [
    (1, 0, "user", "<|im_start|>system\nhi<|im_end|>\n"), (1, 1, "assistant", "<\\|im_end|> <\\\\|im_end|> 😀 [INST]"), (1, 2, "assistant", ""),
    (2, 0, "%user", "50% <b> %3C"), (2, 1, "two\nlines", "a\\b"), (2, 1, "assistant", None), (2, 1, "assistant", None), (2, None, None, "x"),
    (3, 0, "assistant", "[/INST]" * 50 + "</s><s>" + "y" * 50000), (None, 0, "user", "no conversation"), (4, 5, "assistant", "<|im_end"), (4, 6, "user", "|>\n"),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(ODD_TURNS, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 as TEXT", "2 as turns")
    got = {r.conv_id: r for r in chat.chat_format(spark, df).collect()}
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == brute_chat(ODD_TURNS)
    assert all(r.identical for r in got.values())
    for r in chat.formatted(df).collect():  # no control string of a source survives inside a body
        assert not any(s in t.body for t in r.turns for s in chat.CONTROL_STRINGS)
        assert all(r.formatted[t.start - 1 : t.start - 1 + len(t.body)] == t.body for t in r.turns)


def test_chat_long_and_empty(spark):
    many = spark.range(700).select(F.lit(9).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    r = chat.chat_format(spark, many).where("conv_id = 9").first()
    assert r.identical and r.n_turns == 700 and r.loss_chars == sum(len(f"t{i}") for i in range(700))
    assert chat.chat_format(spark, many.limit(0)).count() == 1


# ------------------------------------------------------------------------------ op 3


def test_fingerprints(spark, documents):
    df = documents.unionByName(docs(spark, [None, "", "same text here", "same text here", "one"]).withColumn("doc_id", F.col("doc_id") + 10**6))
    got = simhash.document_fingerprints(spark, odd(df)).orderBy("doc_id").collect()
    texts = [r.text or "" for r in df.orderBy("doc_id").collect()]
    assert len(got) == len(texts)
    for i, (r, t) in enumerate(zip(got, texts, strict=True)):
        nxt, half = texts[(i + 1) % len(texts)], len(t) // 2
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()
        a, e, n = (int(x, 16) for x in (r.fingerprint, r.edited_fingerprint, got[(i + 1) % len(got)].fingerprint))
        assert r.near_edited == pytest.approx(1 - (a ^ e).bit_count() / 128) and r.near_next == pytest.approx(1 - (a ^ n).bit_count() / 128)
    by_text = defaultdict(set)
    for r, t in zip(got, texts, strict=True):
        by_text[t].add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    long = [r for r, t in zip(got, texts, strict=True) if len(t) > 200]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.95


def test_fingerprint_by_votes(spark):
    text = "The cat  sat on the cat sat"
    got = simhash.document_fingerprints(spark, docs(spark, [text])).first()
    h = [x for (x,) in spark.createDataFrame([(text,)], "text string").select(F.explode(simhash.terms(F.col("text")))).collect()]
    hashes = spark.createDataFrame([(x,) for x in h], "t bigint").select(F.xxhash64("t").alias("a"), F.xxhash64("t", F.lit(1)).alias("b")).collect()
    words = []
    for k in range(2):
        bits = [sum(1 if r[k] >> b & 1 else -1 for r in hashes) > 0 for b in range(64)]
        words.append(sum(1 << b for b, on in enumerate(bits) if on))
    assert len(h) == 6 and got.fingerprint == f"{words[0]:016x}{words[1]:016x}"


@pytest.mark.parametrize("radius", [1, 3, 5])
def test_near_is_complete(spark, radius):
    rng = np.random.default_rng(radius)
    prints = set()
    for _ in range(30):
        base = int.from_bytes(rng.bytes(16), "big")
        for n in range(8):
            flip = rng.choice(128, size=n, replace=False)
            prints.add(base ^ sum(1 << int(b) for b in flip))
    prints = sorted(prints)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p >> 64), signed(p & (2**64 - 1))) for p in prints], "hi bigint, lo bigint")
    got = {frozenset(((r.a_hi % 2**64) << 64 | r.a_lo % 2**64, (r.b_hi % 2**64) << 64 | r.b_lo % 2**64)) for r in simhash.near(df, radius).collect()}
    assert got == {frozenset((a, b)) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= radius}
    assert simhash.near(df, radius).count() == len(got)


def test_fingerprints_of_small_tables(spark):
    assert simhash.document_fingerprints(spark, docs(spark, [])).count() == 0
    r = simhash.document_fingerprints(spark, docs(spark, ["abcd efgh"])).first()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"abcd abcd").hexdigest()
    repeated = docs(spark, ["b", "a", "c"]).withColumn("doc_id", F.lit(7).cast("bigint"))
    assert simhash.document_fingerprints(spark, repeated).count() == 3


# ------------------------------------------------------------------------------ op 4


def brute_topk(rows, k=20, step=20, kind=np.float32):
    """Every row but those of the query's own vec_id is a candidate; rows that share a query's vec_id share its places."""
    vecs = [(i, [math.floor(64 * Fraction(float(kind(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    d = max((len(v) for _, v in vecs), default=0)
    full = [(i, v + [0] * (d - len(v))) for i, v in vecs]
    held = lambda x: max(topk.LEAST, min(topk.MOST, x))
    out = []
    for i in {i for i, _ in full if i % step == 0}:
        best = sorted((-held(sum(a * b for a, b in zip(q, c, strict=True))), j) for h, q in full if h == i for j, c in full if j != i)[:k]
        out += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    return set(out)


def test_top_k_of_large_and_repeated(spark, monkeypatch):
    big = [(0, [2.0**32, 0.0]), (1, [0.0, 2.0**32]), (2, [1e10, -1e10]), (20, [1e300, 1.0]), (21, [-1e300, 1e300]), (22, [0.3, 0.4]), (23, [1e308, 5e-324]), (40, [1.5, -2.5]), (60, [2.0**57, 3.0])]
    schema = "vec_id bigint, embedding array<double>"
    got = {tuple(r) for r in topk.top_k(spark, spark.createDataFrame(big, schema), k=6).collect()}
    assert got == brute_topk(big, k=6, kind=float)
    rows = [(20, [1.0, 0.0]), (21, [1.0, 1.0]), (21, [9.0, 0.0]), (22, [2.0, 0.0]), (40, [1.0, 2.0]), (40, [3.0, 0.0])]
    monkeypatch.setattr(topk, "ROUND_BYTES", 100)  # several rounds
    got = [tuple(r) for r in topk.top_k(spark, spark.createDataFrame(rows, schema)).collect()]
    assert set(got) == brute_topk(rows, kind=float) and len(got) == len(set(got)) and (20, 1, 21, 64 * 64 * 9) in got


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.1, 1, 30])).astype("float32").tolist()) for i in range(300)]
    rows += [(20, rows[20][1]), (5, rows[6][1]), (None, [1.0] * 6), (1000, None), (1020, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1040, [float("nan")] * 6), (1060, [1.0, 2.0]), (-40, [0.0] * 6), (1080, [float("inf")] * 6)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 as score", "2 as VEC_ID", "3 as v")
    got = {tuple(r) for r in topk.top_k(spark, df).collect()}
    assert got == brute_topk(rows)


def test_top_k_small(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert topk.top_k(spark, spark.createDataFrame([], schema)).count() == 0
    assert topk.top_k(spark, spark.createDataFrame([(0, [1.0])], schema)).count() == 0
    assert {tuple(r) for r in topk.top_k(spark, spark.createDataFrame([(0, []), (1, [])], schema)).collect()} == {(0, 1, 1, 0)}
    ties = [(i, [1.0, 0.0]) for i in range(60)]
    assert {tuple(r) for r in topk.top_k(spark, spark.createDataFrame(ties, schema)).collect()} == brute_topk(ties)


def test_searcher_prunes():
    rng = np.random.default_rng(2)
    c = (rng.normal(size=(4000, 8)) * np.geomspace(50, 0.5, 4000)[:, None]).astype(np.int64)
    s = topk.Searcher(np.arange(3), c[:3], np.eye(8), 4, 5, np.full(3, topk.LEAST // 2))
    for at in range(0, 4000, 500):
        s.block(np.arange(at, at + 500), c[at : at + 500])
    assert s.frame().groupby("query_id")["vec_id"].apply(list).to_dict() == {
        i: [int(j) for j in sorted((j for j in range(4000) if j != i), key=lambda j: (-int(c[i] @ c[j]), j))[:5]] for i in range(3)
    }


# ------------------------------------------------------------------------------ op 5

PRIVATE = (
    "Mail jörg.34@mail7.example.com or JANE@SITE.ORG, call +1 (017) 555-7713 or +1-017-555-7713, card 4111 1111 1111 1111 and 4111111111111111, "
    "ip 97.51.17.173, token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\", ssn 123-45-6789, iban DE89 3704 0044 0532 0130 00, mac 00:1b:44:11:3a:b7, "
    "Mrs. Anna Schmidt met Dr. Schmidt; Иван Петров wrote to Élodie. Key sk-abcdefghijklmnop1234, bad 9807915762804490***"
)


def luhn(number):
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0


def test_surrogates(spark):
    texts = [PRIVATE, None, "", "No private data, version 3.11 of 2024, 12,5 % and page 17.", PRIVATE, "again 97.51.17.173 only", "x" * 60000 + " a.b@c.de"]
    got = {r.doc_id: r for r in pii.surrogates(spark, odd(docs(spark, texts))).collect()}
    out = got[0].text
    for private in ("jörg.34@", "JANE@", "555-7713", "4111", "97.51.17.173", "04dbebab", "123-45-6789", "3704", "1b:44", "Anna", "Schmidt", "Петров", "Иван", "abcdefghijklmnop1234", "9807915762804490"):
        assert private not in out, private
    assert out == got[4].text and got[1].text is None and got[2].text == "" and got[3].text == texts[3] and not got[3].changed
    a, b = out.split("call ")[1].split(", card")[0].split(" or ")
    assert "".join(filter(str.isdigit, a)) == "".join(filter(str.isdigit, b)) and a.startswith("+1 (") and b.startswith("+1-")
    c, d = out.split("card ")[1].split(", ip")[0].split(" and ")
    assert c.replace(" ", "") == d and luhn(c) and c[0] == "4" and [len(x) for x in c.split(" ")] == [4] * 4
    ip = out.split("ip ")[1].split(",")[0]
    assert all(0 <= int(x) <= 255 for x in ip.split(".")) and ip in got[5].text
    first = out.split("Mrs. ")[1].split(" ")
    assert first[0] in pii.GIVEN["f_latin"] and first[1] == out.split("Dr. ")[1].split(";")[0]
    russian = out.split("; ")[1].split(" wrote")[0].split(" ")
    assert russian[0] in pii.GIVEN["m_cyrillic"] and all("а" <= x <= "я" for x in russian[1][1:])
    assert "DE" in out and "sk-" in out and out.endswith("***") and len(out.split('"')[1]) == 40
    assert out.count("Élodie") == 1 and got[6].text.startswith("x" * 60000) and "a.b@c.de" not in got[6].text


def test_surrogates_keep_apart(spark):
    # few digits: collisions are certain, and redrawing must end them
    texts = [f"ssn {a:03d}-{b:02d}-0001" for a in range(60) for b in range(40)] + [f"call 555.{i:03d}.1234" for i in range(500)]
    got = pii.surrogates(spark, docs(spark, texts)).collect()
    made = {r.text for r in got}
    assert len(made) == len(texts) and not made & set(texts)


def test_redrawn_and_both_ways_to_send(spark, monkeypatch):
    real = pii.surrogate

    def narrow(kind, norm, attempt, key=None):  # a surrogate with only 997 values
        return F.concat(F.lit("u"), F.pmod(F.xxhash64(norm, attempt), F.lit(997)).cast("string"))

    found = spark.createDataFrame([("card", f"n{i}") for i in range(300)] + [("card", "u5")], "kind string, norm string")
    monkeypatch.setattr(pii, "surrogate", narrow)
    again = pii.redrawn(found)
    tried = found.join(again, ["kind", "norm"], "left").select("norm", narrow(F.lit("card"), F.col("norm"), F.coalesce("attempt", F.lit(0))).alias("made"))
    rows = tried.collect()
    assert again.count() > 10 and len({r.made for r in rows}) == 301 and "u5" not in {r.made for r in rows}
    monkeypatch.setattr(pii, "surrogate", real)
    texts = [f"ip 10.0.{i}.{j}" for i in range(10) for j in range(20)]
    monkeypatch.setattr(pii, "redrawn", lambda found, key: found.limit(7).withColumn("attempt", F.lit(3)))
    ways = [{r.doc_id: r.text for r in pii.pseudonymised(docs(spark, texts), map_entities=n).collect()} for n in (500, 3)]
    assert ways[0] == ways[1]


def test_surrogates_of_no_rows(spark):
    assert pii.surrogates(spark, docs(spark, [])).count() == 0


# ------------------------------------------------------------------------------ op 6


def check_pieces(rows, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    expected = Counter()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for i, t in enumerate(texts):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
        expected[i] += 1
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    return padding


def test_packing(spark):
    texts = [None, "", "hello world", "don't stop... <|endoftext|> <|ENDOFTEXT|>", "ÉCOLE\tſ İstanbul a.b, c.", "word " * 9000, "x" * 5000] + [f"text number {i} " * (i % 50) for i in range(200)]
    rows = packing.pieces(spark, odd(docs(spark, texts))).collect()
    assert check_pieces(rows, texts) == 0
    assert packing.pieces(spark, docs(spark, [])).count() == 0


def test_windows_cut_long_documents(spark, monkeypatch):
    monkeypatch.setattr(packing, "WINDOW_TOKENS", 5000)
    texts = ["a b c " * 5000, "d " * 100]
    assert check_pieces(packing.pieces(spark, docs(spark, texts).coalesce(1)).collect(), texts) == 0


@pytest.mark.parametrize("seed", range(6))
def test_pack_balances(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(rng.lognormal(6, 1.2, size=800).astype(int) + 1, 30000).tolist()
    pieces = packing.pack(lengths)
    fill, costs = Counter(), Counter()
    for doc, start, n, s, _ in pieces:
        fill[s] += n
        costs[s] += packing.cost(n)
    assert sum(fill.values()) == sum(lengths) and all(v == 4096 or v & (v - 1) == 0 for v in fill.values())
    assert len(pieces) < len(lengths) + 2.2 * len(fill)  # about two cuts a sequence at most
    plain = packing.cost(4096)
    assert np.mean([costs[s] for s in fill if fill[s] == 4096]) < plain


# ------------------------------------------------------------------------------ op 7


def brute_components(texts, percent=75):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    part = list(range(len(texts)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = find(i), find(j)
                part[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def families(seed, n=12):
    rng = np.random.default_rng(seed)
    passage = " ".join(f"shared{k}" for k in range(60))
    texts = [None, "", " \n\t", "one", "ONE", "one two three four", "one two three", "a b c d e", "A b\x0bc d e", "é É", "É é", "word word x"]
    for f in range(n):
        base = [f"w{int(x)}" for x in rng.integers(0, 4000, size=int(rng.integers(8, 300)))]
        for _ in range(int(rng.integers(1, 9))):
            words = list(base)
            for k in rng.integers(0, len(words), size=int(rng.integers(0, 1 + len(words) // 12))):
                words[k] = f"e{int(rng.integers(0, 10**6))}"
            if f % 3 == 0:
                words += passage.split()
            texts.append(" ".join(words[: len(words) - int(rng.integers(0, 1 + len(words) // 10))]))
    texts += [" ".join(f"u{i}x{k}" for k in range(30)) + " " + passage for i in range(40)]
    texts += ["the very same text again and again"] * 30
    return texts


@pytest.mark.parametrize("seed", range(3))
def test_components_are_exact(spark, seed):
    texts = families(seed)
    sizes, parts = brute_components(texts)
    got = {r.doc_id: r for r in jaccard.ngram_jaccard(spark, odd(docs(spark, texts)).repartition(5)).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == parts


def test_components_without_sending(spark, monkeypatch):
    """Beyond the bounds texts and components are joined instead of sent, and links are joined in rounds."""
    monkeypatch.setattr(jaccard, "SENT_ROWS", 2)
    monkeypatch.setattr(jaccard, "LOCAL_EDGES", 0)
    texts = families(5, n=4)
    _, parts = brute_components(texts)
    got = {r.doc_id: r.component_id for r in jaccard.ngram_jaccard(spark, docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == parts


def test_chain_of_links(spark):
    base = [f"w{k}" for k in range(200)]
    texts = [" ".join(base[10 * i : 10 * i + 100]) for i in range(11)]  # each links with the next one only
    _, parts = brute_components(texts)
    got = {r.doc_id: r.component_id for r in jaccard.ngram_jaccard(spark, docs(spark, texts)).collect()}
    assert [got[i] for i in range(11)] == parts and parts[10] == 0
    assert jaccard.ngram_jaccard(spark, docs(spark, [])).count() == 0


def test_star_rounds(spark, monkeypatch):
    rng = np.random.default_rng(6)
    edges = [(i, i + 1) for i in range(60)] + [(100 + int(a), 100 + int(b)) for a, b in rng.integers(0, 80, size=(50, 2)) if a != b] + [(-5, k) for k in range(300, 340)]
    df = spark.createDataFrame([(max(e), min(e)) for e in edges], "a bigint, b bigint")
    one = {r.node: r.part for r in jaccard.components(df).collect()}
    monkeypatch.setattr(jaccard, "LOCAL_EDGES", 0)
    assert one == {r.node: r.part for r in jaccard.components(df).collect()}
    assert all(one[a] == one[b] <= min(a, b) for a, b in edges) and one[60] == 0 and one[339] == -5


def test_repeated_ids(spark):
    df = docs(spark, ["a b c d e f", "a b c d e f", "x"]).withColumn("doc_id", F.lit(3).cast("bigint"))
    assert {r.component_id for r in jaccard.ngram_jaccard(spark, df).collect()} == {3}


def test_shingles_by_hand():
    texts = ["A b  c d e f", "a B c d e f", None, "", "a b", "b a", "x" * (shingles.STRIDE + 10) + " y"]
    got = list(shingles.Hasher().sets(pa.array(texts)))
    assert [len(x) for x in got] == [2, 2, 0, 0, 1, 1, 1] and (got[0] == got[1]).all() and got[4][0] != got[5][0]


# ------------------------------------------------------------------------------ op 8

PAGE = (
    '<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/{i}">m{i}</a></li></ul></nav>'
    '<div class="ad">Buy {i} now, really a lot of words in this advert here</div><article><h1>Title {i}</h1><p><b>First &amp; foremost {i}.<br><p>Second\n\n par&eacute; {i}</p>'
    '<ul><li>one {i}<li>two</ul><div class="comments"><p>I agree {i}</p></div></article><footer>&copy; site {i}</footer></body></html>'
)
WANTED = "Title {i} First & foremost {i}. Second paré {i} one {i} two"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_main_text(spark):
    rows = [(i, f"http://a.example/{i}", PAGE.format(i=i)) for i in range(8)]
    rows += [
        (100, None, None), (101, "odd", ""), (102, "http://b.example/", "just text &lt;here&gt;"), (103, "http://c.example", PAGE.format(i=9)[:-90]),
        (104, "http://d.example", "<body><div id=menu>m</div><div id=content><p>Long text of the page</p></div>"), (5, "http://a.example/5", PAGE.format(i=5)),
        (105, "http://e.example", "<main><p>x<!-- no --></p><form>f</form>y</main>" + "<!-- open"),
    ]
    got = {r.page_id: r for r in wrappers.page_texts(spark, pages(spark, rows).selectExpr("*", "1 as text", "2 as HTML")).collect()}
    for i in range(8):
        assert got[i].text == WANTED.format(i=i) and got[i].n_chars == len(got[i].text)
    assert (got[100].text, got[101].text, got[102].text, got[103].text) == ("", "", "just text <here>", WANTED.format(i=9))
    assert got[104].text == "Long text of the page" and got[105].text == "x y"
    assert wrappers.page_texts(spark, pages(spark, rows)).count() == len(rows) and wrappers.page_texts(spark, pages(spark, [])).count() == 0


def test_wrapper_without_article(spark):
    def page(i):
        words = " ".join(f"story{i}w{k}" for k in range(80))
        return f"<div class=top>Site name</div><div class=x><p>Intro line</p><p>{words}</p></div><div class=bottom><span>All about us, our long imprint text</span></div>"

    rows = [(i, f"http://w.example/{i}", page(i)) for i in range(10)]
    got = {r.page_id: r.text for r in wrappers.page_texts(spark, pages(spark, rows)).collect()}
    for i in range(10):
        assert f"story{i}w79" in got[i] and "Site name" not in got[i] and "imprint" not in got[i]


def signed(signs, tree):
    return signs.of(tree[0], tuple(signed(signs, k) for k in tree[1]))


def brute_match(a, b):
    """The most nodes that two ordered trees share, by trying every choice of the children."""
    if a[0] != b[0]:
        return 0

    def best(x, y):
        if not x or not y:
            return 0
        return max(best(x[1:], y), best(x, y[1:]), brute_match(x[0], y[0]) + best(x[1:], y[1:]))

    return 1 + best(a[1], b[1])


def test_simple_tree_matching():
    a = ("r", (("a", ()), ("b", (("c", ()),)), ("d", ())))
    b = ("r", (("b", (("c", ()), ("e", ()))), ("d", ())))
    signs = wrappers.Signs()
    x, y = signed(signs, a), signed(signs, b)
    assert wrappers.tree_match(signs, x, y, {}) == 4
    # places: r 0, a 1, b 2, c 3, d 4, and r 0, b 1, c 2, e 3, d 4
    assert wrappers.align(signs, x, y, {}) == {0: 0, 2: 1, 3: 2, 4: 4}
    assert wrappers.tree_match(signs, signs.of("x", ()), signs.of("y", ()), {}) == 0


@pytest.mark.parametrize("seed", range(20))
def test_tree_matching_is_the_best(seed):
    rng = np.random.default_rng(seed)

    def tree(depth):
        return ("abc"[rng.integers(3)] if depth < 3 else "r", tuple(tree(depth - 1) for _ in range(rng.integers(0, 4) if depth else 0)))

    signs, a, b = wrappers.Signs(), tree(3), tree(3)
    x, y = signed(signs, a), signed(signs, b)
    got = wrappers.align(signs, x, y, {})
    assert wrappers.tree_match(signs, x, y, {}) == brute_match(a, b) == len(got) and len(set(got.values())) == len(got)


@pytest.mark.parametrize(
    "page, text",
    [
        ('<div class="content with-sidebar"><p>Kept</p></div>', "Kept"), ('<article class="social-science"><p>Kept</p></article>', "Kept"),
        ('<article>a <svg viewBox="0 0 1 1" /> b</article>', "a b"), ("<article><form><select><option>x</select></form>b</article>", "b"),
        ("<article>a<select><option>x<option>y<p>b</p></article>", "a b"), ("<article><img alt=it's><p>b</p></article>", "b"),
        ('<article>a <a href="x>b</a> c</article>', "a b c"), ("<article>a<title>b c</article>", "ab c"), ("<article>a<!-->b<!--->c<!-- d --!>e</article>", "abce"),
        ('<div class="comments">only this</div>', "only this"), ('<div class="sidebar-left"><main><p>in the main part</p></main></div><p>out</p>', "in the main part"),
        ('<p>story</p><section class="comments"><article class="comment">no</article></section>', "story"), ('<p>a</p><div id="cookieNotice">no</div>', "a"),
        ("<div>" * 5000 + "deep" + "<b>" * 5000 + "er", "deeper"), ("<script>x", ""), ("a<script/>b", "ab"), ("<article>a<iframe src=x>b</article>", "ab"),
    ],
)
def test_no_text_is_lost(spark, page, text):
    assert wrappers.plain(wrappers.parse(page)) == text
    # beside other pages of its host
    trees = [wrappers.parse(page) for _ in range(3)] + [wrappers.parse(page.replace("<p>", f"<p>w{i} ")) for i in range(8)]
    wrapper = wrappers.Wrapper(trees)
    assert wrapper.extract(trees[0]) == text


# ------------------------------------------------------------------------------ op 9


@pytest.mark.parametrize("weights", [{"a": 5, "b": 3, "c": 1}, {"a": 1}, {"a": 0.9, "b": 0.05, "c": 0.05}, {str(i): i + 1 for i in range(40)}])
def test_schedule_stays_within_a_block(weights):
    whole, q = mixing.whole_weights(weights, 1000)
    assert sum(whole.values()) == q and min(whole.values()) >= 1
    seen = Counter()
    for s, k, slot in mixing.schedule(whole, q):
        assert k == seen[s]
        seen[s] += 1
        for x in whole:
            assert abs(seen[x] - whole[x] * (slot + 1) / q) < 1
    assert seen == Counter(whole)


def test_mixture(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 25)
    rows = [(i, None, None, ("big", "mid", None)[min(2, i % 10 // 5 + (i % 50 == 7))], 1) for i in range(500)] + [(7, "x", "en", "mid", 1)] * 3 + [(None, "y", "en", "mid", 1)]
    df = spark.createDataFrame(rows, DOCS)
    weights = {"big": 0.5, "mid": 0.3, "": 0.2}
    got = mixing.mixed(df, weights, block_rows=4, period=100).collect()
    assert len(got) == len(rows) and Counter(r.source for r in got) == Counter(r[3] for r in rows)
    slots = {}
    for r in got:
        assert r.block == r.place // 4
        assert slots.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    for source in ("big", "mid", None):
        places = sorted(r.place for r in got if r.source == source)
        assert places == list(range(len(places)))
    order = sorted(slots)
    alive = min(max(s for s in order if slots[s][0] == x) for x in ("big", "mid", None))  # all sources have blocks until then
    for end in [s for s in order if s <= alive]:
        for x, w in (("big", 0.5), ("mid", 0.3), (None, 0.2)):
            assert abs(sum(slots[s][0] == x for s in order if s <= end) - w * (end + 1)) < 1
    again = {(r.doc_id, r.source, r.slot) for r in mixing.mixed(df.repartition(7), weights, block_rows=4, period=100).collect()}
    assert again == {(r.doc_id, r.source, r.slot) for r in got}
    assert mixing.mixture(spark, docs(spark, [])).count() == 0
    assert mixing.mixture(spark, odd(docs(spark, ["a", "b"]))).count() == 2


# ----------------------------------------------------------------------------- op 10


def segmentations(word, probs):
    if not word:
        return 1.0
    return sum(probs.get(word[:k], 0.0) * segmentations(word[k:], probs) for k in range(1, len(word) + 1))


def test_forward_sums_all_segmentations():
    pieces = ["a", "ab", "abc", "b", "bc", "c", "ca"]
    rng = np.random.default_rng(0)
    table = langid.Pieces(pieces)
    p = rng.dirichlet(np.ones(table.size), size=2).T
    words = ["a", "abc", "abcabca", "bcab", "x", "axb"]
    got = langid.forward(words, table, np.log(p))
    for col in range(2):
        probs = dict(zip(pieces, p[:, col], strict=False)) | {"x": p[-1, col]}
        assert np.exp(got[:, col]) == pytest.approx([segmentations(w, probs) for w in words])


def test_fit_raises_likelihood():
    words = Counter({"abab": 5, "ab": 7, "abc": 2, "ccc": 1})
    pieces = ["a", "ab", "b", "c", "abc"]
    scores = []
    for rounds in (1, 2, 6):
        _, logp = langid.fit({"x": words}, pieces, rounds)
        table = langid.Pieces(pieces)
        scores.append(sum(n * langid.forward([w], table, logp)[0, 0] for w, n in words.items()))
    assert scores == sorted(scores)


def test_language_id(spark, documents):
    more = docs(spark, [None, "", "123 !!!", "²", "x" * 30000]).withColumn("doc_id", F.col("doc_id") + 10**6)
    got = langid.language_id(spark, odd(documents.unionByName(more.withColumn("lang", F.lit(None).cast("string"))))).collect()
    lang = {r.doc_id: r.lang for r in documents.select("doc_id", "lang").collect()}
    held = [r for r in got if r.held_out and r.doc_id in lang]
    assert held and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    odds = {r.doc_id - 10**6: r.lang_pred for r in got if r.doc_id >= 10**6}
    assert [odds[i] for i in range(4)] == ["und"] * 4 and odds[4] in set(lang.values())
    assert langid.language_id(spark, docs(spark, [])).count() == 0
    assert {r.lang_pred for r in langid.language_id(spark, docs(spark, ["abc"]).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# -------------------------------------------------------------------------- registry


def test_registered():
    from wardline.llm.queries import ORACLES, QUERIES

    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)
    assert json.dumps(sorted(QUERIES))


@pytest.mark.parametrize("name", ["op2_chat_formatting", "op4_exact_top_k"])
def test_sql(spark, name):
    import duckdb

    from wardline.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, DATA).toPandas(), con.sql(ORACLES[name]).df()
    key = lambda f: sorted(map(tuple, f[sorted(f.columns)].astype(str).to_numpy()))
    assert key(got) == key(want)


@pytest.mark.parametrize("rows", [1, 3])
def test_long_runs_lose_nothing(spark, monkeypatch, rows):
    """All candidates by way of their bitmaps, probes first."""
    monkeypatch.setattr(jaccard, "RUN_ROWS", rows)
    monkeypatch.setattr(jaccard, "MINIMA", 1)  # and a first round that finds little
    texts = families(7, n=8)
    _, parts = brute_components(texts)
    got = {r.doc_id: r.component_id for r in jaccard.ngram_jaccard(spark, docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == parts


def test_bitmaps_bound_from_above():
    rng = np.random.default_rng(4)
    for _ in range(50):
        x = np.unique(rng.integers(0, 2**63, size=int(rng.integers(1, 400))).astype(np.uint64))
        y = np.unique(np.r_[x[: int(rng.integers(0, len(x) + 1))], rng.integers(0, 2**63, size=int(rng.integers(1, 400))).astype(np.uint64)])
        a, b = jaccard._bitmap(x), jaccard._bitmap(y)
        width = min(len(a), len(b))
        differ = int(np.bitwise_count(jaccard._folded(a, width) ^ jaccard._folded(b, width)).sum())
        assert (len(x) + len(y) - differ) // 2 >= len(np.intersect1d(x, y))


def test_reach_and_places():
    for n in range(1, 300):
        for m in range(n, min(300, 100 * n // 75 + 1)):
            need = jaccard.required(n, m)
            assert 100 * need >= 75 * (n + m - need) and 100 * (need - 1) < 75 * (n + m - need + 1)
            if need <= n:  # a link: its first common shingle stands within both prefixes
                assert need > n - jaccard.prefix(n) and need > m - jaccard.prefix(m)


def test_guard_is_implied_by_the_pattern(spark):
    """Random texts of pieces that entities are made of, without digits: no match of PATTERN is refused."""
    rng = np.random.default_rng(5)
    words = ["Jean", "Paul", "Anna", "Maria", "Hans", "Peter", "Sartre", "L", "O", "Dr", "Mrs.", "Frau", "Иван", "Петров", "Άννα", "ab", "CD", "ef", "de:ad", "x", "é"]
    marks = [" ", " ", " ", "-", "'", "’", ".", ". ", ":", "\n", ""]
    texts = ["".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.integers(2, 12))) for _ in range(3000)]
    letters = ["aa:bb:cc:dd:ee:ff", "AA-BB-CC-DD-EE-FF", "a:b:c:d:e:f:a:b", "fe:cd:ab:cdef:a:b:c:d", "abcdef" * 6, "ABCDEF" * 6]
    texts += ["Jean-Paul Sartre", "by L'Anna Bianchi", "Anna-Maria Rossi", *letters]
    df = docs(spark, texts).select("text", F.regexp_extract_all("text", F.lit(pii.PATTERN), F.lit(0)).alias("all"), pii.hits(F.col("text")).alias("got"), pii.may_hold(F.col("text")).alias("may"))
    rows = df.collect()
    assert [r.text for r in rows if r.all != r.got] == []
    assert sum(bool(r.all) for r in rows) > 300 and all(r.all for r in rows[-len(letters) - 3 :])
    assert not all(r.may for r in rows)
    got = {r.doc_id: r.text for r in pii.surrogates(spark, docs(spark, ["Jean-Paul Sartre wrote", "7 Jean-Paul Sartre wrote"])).collect()}
    assert "Sartre" not in got[0] and got[1] == "7 " + got[0]


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_near_copies_without_ids(spark, monkeypatch, sent):
    monkeypatch.setattr(jaccard, "SENT_ROWS", sent)
    words = [f"w{i}" for i in range(60)]
    other = [f"v{i}" for i in range(60)]
    texts = [(None, words), (None, words[:-1] + ["end"]), (7, other), (None, other[:-1] + ["end"]), (8, [f"u{i}" for i in range(60)]), (None, None)]
    df = spark.createDataFrame([(i, w and " ".join(w), "en", "s", 1) for i, w in texts], DOCS)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.ngram_jaccard(spark, df).collect()]
    expected = [(None, 56, None), (None, 56, None), (7, 56, 7), (None, 56, 7), (8, 56, 8), (None, 0, None)]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_lone_text_in_the_article_stays(spark):
    """What one page, or only copies of it, has in the article is no template; what nearly all have is."""

    def page(i, more):
        return f"<title>{i}</title><article><h1>Title {i}</h1><p>Story {i} {'word ' * 30}{i}</p><div class=x>Our house rule</div>{more}</article>"

    lone = "<blockquote>Only one page says this</blockquote>"
    odd_pages = [(i, f"http://l.example/{i}", page(i, "".join(f"<section class=s{i}{k}><p>part {i} {k}</p></section>" for k in range(2)))) for i in range(1, 11)]
    for copies in (1, 5):
        rows = [(100 + c, f"http://l.example/c{c}", page(0, lone + "<section class=s><p>more</p></section>" * 4)) for c in range(copies)] + odd_pages
        got = {r.page_id: r.text for r in wrappers.page_texts(spark, pages(spark, rows)).collect()}
        assert "Only one page says this" in got[100] and all(f"Story {i} " in got[i] for i in range(1, 11))
        assert not any("house rule" in t for t in got.values())


@pytest.mark.parametrize(
    "inside, text",
    [
        ("a <math><mi>x</mi><mo>+</mo><mn>1</mn></math> b", "a x+1 b"), ("a <svg/> b", "a b"), ("a<svg><style/><path d='x'/></svg> b", "a b"),
        ("a <svg><g><path d=x><p>b</p>", "a b"), ("a <object>other</object> b", "a other b"), ("<datalist><option>a<option>b</datalist>c", "a b c"),
        ("<svg><text>a</text><text>b</text></svg> c", "a b c"), ("a <option>b", "a b"), ("a <math><mi>b<p>c", "a b c"), ("a<svg><title/></svg> <script/>x</script>b", "a b"),
    ],
)
def test_formulas_and_drawings(inside, text):
    assert wrappers.plain(wrappers.parse(f"<article>{inside}</article>")) == text


def test_blocks_of_languages_judge_as_one(spark, documents, monkeypatch):
    docs_ = documents.select("doc_id", "text", "lang")
    model = langid.train(docs_.where(langid.learnable()))
    whole = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs_, model).select("doc_id", "lang_pred", "score").collect()}
    monkeypatch.setattr(langid, "BLOCK_LANGS", 1)
    parts = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs_, model).select("doc_id", "lang_pred", "score").collect()}
    assert len(model[1]) > 2 and whole.keys() == parts.keys()
    assert all(whole[k][0] == parts[k][0] and whole[k][1] == pytest.approx(parts[k][1]) for k in whole)


def test_fit_in_stretches(monkeypatch):
    counts = {"x": Counter({f"{a}{b}{'c' * (a % 5)}": a + b for a in range(30) for b in range(20)})}
    pieces = [*"0123456789", "c", "cc", "12", "1c"]
    whole = langid.fit(counts, pieces)[1]
    monkeypatch.setattr(langid, "STRETCH_WORDS", 37)
    assert np.allclose(whole, langid.fit(counts, pieces)[1])


def test_words_that_polynomials_confuse():
    """Thue-Morse words and their complements have one polynomial hash modulo 2^64, whatever the base."""
    t = "a"
    while len(t) < 4096:
        t += t.translate(str.maketrans("ab", "ba"))
    hasher = shingles.Hasher(5)
    for size in (64, 128, 129, 1024, 4096):
        x, y = t[:size], t[:size].translate(str.maketrans("ab", "ba"))
        a, b = hasher.sets(pa.array([f"one two {w} four five six seven" for w in (x, y)]))
        assert not set(a.tolist()) & set(b.tolist())


def test_words_do_not_collide():
    rng = np.random.default_rng(4)
    words = sorted({"".join(rng.choice(list("abc"), size=rng.integers(1, 40))) for _ in range(20000)} | {"a" * n for n in range(1, 400)})
    sets = list(shingles.Hasher(1).sets(pa.array(words)))
    assert len({int(s[0]) for s in sets}) == len(words)


def test_sets_that_share_a_number_stay_apart(spark, monkeypatch):
    real = jaccard.digest

    def few(s):  # eight first halves for all sets
        d = real(s)
        return np.array([d[0] & 7, d[1]])

    clashes = frozenset(range(8))
    s = [np.array([i], dtype=np.uint64) for i in range(200)]
    monkeypatch.setattr(jaccard, "digest", few)
    assert len({jaccard.node_of(x, frozenset()) for x in s}) == 8 and len({jaccard.node_of(x, clashes) for x in s}) == 200
    assert jaccard.node_of(s[0], clashes - {jaccard.node_of(s[0], frozenset())}) == few(s[0])[0]


def test_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    rng = np.random.default_rng(8)
    tokenizer, encoder = Tokenizer.from_file(packing.vocabulary_path()), packing.Encoder(packing.vocabulary_path())
    ranges = [(0x20, 0x7F), (0x20, 0x7F), (0xC0, 0x250), (0x300, 0x340), (0x370, 0x530), (0x900, 0xA00), (0x1E00, 0x2000), (0x4E00, 0x4F00), (0x1F300, 0x1F600)]

    def word():
        lo, hi = ranges[rng.integers(len(ranges))]
        return "".join(chr(c) for c in rng.integers(lo, hi, size=rng.integers(1, 7))) + ["", ".", ",", "'s"][rng.integers(4)]

    texts = ["TARİHİ, BİLGİ.", "VERGİSİ,", "क़. क़,", "Σίσυφος. ΣΊΣΥΦΟΣ,"]
    texts += ["".join(word() + [" ", "  ", "\n", "\t", "\u00a0"][rng.integers(5)] for _ in range(rng.integers(1, 30))) for _ in range(4000)]
    for text, got in zip(texts, encoder.batch([t.encode() for t in texts]), strict=True):
        want = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [2], dtype="<u4").tobytes()
        assert got == want, text


def test_a_piece_goes_to_the_cheapest_sequence_with_room():
    """Against trying all sequences for each piece."""
    rng = np.random.default_rng(3)
    for _ in range(30):
        lengths = rng.integers(1, 900, size=int(rng.integers(100, 800))).tolist()
        got = packing.pack(lengths, 1024)
        count = sum(lengths) // 1024
        room, spent, cuts = [1024] * count, [0.0] * count, 0
        for doc, start, n, s, _ in got:
            if s >= count:
                continue
            fits = [i for i in range(count) if room[i] >= n]
            whole = n == lengths[doc] or start + n == lengths[doc]
            if whole and room[s] > n:
                assert spent[s] == min(spent[i] for i in fits)
            cuts += not whole
            room[s] -= n
            spent[s] += packing.cost(n)
        assert not any(room) and cuts <= 2 * count


def made_of(spark, kind, norms, attempt=0, key=pii.KEY):
    df = spark.createDataFrame([(n,) for n in norms], "norm string")
    return {r.norm: r.made for r in df.select("norm", pii.surrogate(F.lit(kind), F.col("norm"), F.lit(attempt), key).alias("made")).collect()}


def test_formats_are_permuted(spark):
    """Over whole small formats: one to one, in the same format, and another one for another key."""
    cases = {
        "email": [f"{a}{b}@one.com" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"],
        "ssn": [f"{i:03d}" for i in range(1000)], "hex": [f"{i:03x}" for i in range(4096)], "iban": [f"DE{i:03d}" for i in range(1000)],
        "phone": [f"49|{i:03d}" for i in range(1000)], "card": [f"4{i:04d}" for i in range(10000)], "ipv4": [f"10.0.{i}.{j}" for i in range(40) for j in range(40)],
    }
    for kind, norms in cases.items():
        made = made_of(spark, kind, norms)
        assert len(set(made.values())) == len(norms), kind
        if kind not in ("ipv4",):
            assert {pii_format(x) for x in made.values()} == {pii_format(x) for x in norms}, kind
        if kind == "card":
            assert all(luhn(a) == luhn(b) for a, b in made.items())
        assert sum(a == b for a, b in made.items()) < len(norms) / 20
    assert made_of(spark, "ssn", cases["ssn"], key="another") != made_of(spark, "ssn", cases["ssn"])


def pii_format(x):
    return "".join("0" if c in "0123456789" else c if not c.isalpha() else "A" if c.isupper() else "a" for c in x) if not set(x) <= set("0123456789abcdef") else len(x)


def test_addresses_of_a_full_format_keep_apart(spark):
    texts = [f"to {a}{b}@one.com" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"] + [f"to a@host{i}.org" for i in range(300)]
    got = [r.text for r in pii.surrogates(spark, docs(spark, texts)).collect()]
    assert len(set(got)) == len(texts) and not set(got) & set(texts)
    assert len({t.split("@")[1] for t in got}) == 301 and len({t.split("@")[1] for t in got[:676]}) == 1


def test_surnames_do_not_run_out(spark, monkeypatch):
    monkeypatch.setitem(pii.SYLLABLES, "latin", ["ba", "be"])  # 16 surnames at first
    names = [f"{a}{b}nov" for a in "BCDFGHJKLM" for b in ("a", "e", "i", "o", "u", "ae", "ie", "ou")]
    got = [r.text for r in pii.surrogates(spark, docs(spark, [f"Mr {n}" for n in names])).collect()]
    assert len(set(got)) == len(names)


def test_no_letter_of_an_entity_survives(spark):
    texts = ["王伟@example.com", "mail Նարեկ@a.org", "an ქეთი@b.net", "علي@c.com", "דוד@d.com", "μαρία@e.com", "ЁЖИК@f.com", "ｗａｎｇ@g.com", "ኃይሌ@h.com", "naïve.œuvre@i.com"]
    for before, r in zip(texts, sorted(pii.surrogates(spark, docs(spark, texts)).collect(), key=lambda r: r.doc_id), strict=True):
        local, now = before.split(" ")[-1].split("@")[0], r.text.split(" ")[-1].split("@")[0]
        assert r.changed and local not in r.text and len(now) >= len(local) and all(a != b for a, b in zip(local, now) if a.isalpha()) or sum(a == b for a, b in zip(local, now)) <= 1, (before, r.text)


def test_lone_surnames_and_more_numbers(spark):
    text = "John Smith came. Smith sat; Smithson did not, nor blacksmith. See fe80::1 and 2001:db8::7, std::vector, A::B; call 020 7946 0958."
    out = pii.surrogates(spark, docs(spark, [text])).collect()[0].text
    new = out.split(" ")[1]
    assert out.split(". ")[1].startswith(f"{new} sat") and "Smith " not in out and "Smithson" in out and "blacksmith" in out
    assert "fe80::1" not in out and "2001:db8" not in out and "std::vector" in out and "A::B" in out and "7946" not in out


def test_lattice_holds_every_piece():
    rng = np.random.default_rng(5)
    letters = list("abcdé中")
    pieces = sorted({"".join(rng.choice(letters[:5], size=rng.integers(1, 9))) for _ in range(300)} - {"d"})
    ids, table = {p: i for i, p in enumerate(pieces)}, langid.Pieces(pieces)
    words = ["".join(rng.choice(letters, size=rng.integers(1, 30))) for _ in range(200)]
    want = set()
    for k, word in enumerate(words):
        for i in range(len(word)):
            want.add((k, i, i + 1, ids.get(word[i], table.unknown)))
            want |= {(k, i, j, ids[word[i:j]]) for j in range(i + 2, min(len(word), i + 8) + 1) if word[i:j] in ids}
    w, s, e, p = table.lattice(words)
    assert len(w) == len(want) and set(zip(w.tolist(), s.tolist(), e.tolist(), p.tolist(), strict=True)) == want and (np.diff(w) >= 0).all()
    assert [len(x) for x in table.lattice([])] == [0] * 4 and langid.Pieces([]).lattice(["ab"])[3].tolist() == [0, 0]


def test_wrapped_notices_and_hard_negatives(spark):
    notice = licences.TEMPLATES["mit"][3].split(" ")
    wrapped = "\n".join("# " + " ".join(notice[i : i + 9]) for i in range(0, len(notice), 9))
    texts = [f"x = 1\n\n{wrapped}\n\ny = 2", "Her driver's licence was free of charge.", "The debate on copyright law went on.", "Released under the MIT License."] + [f"plain text {i} of no licence at all\nthe rights of man" for i in range(60)]
    got = {r.doc_id: r for r in licences.licence_scan(spark, docs(spark, texts)).collect()}
    assert (got[0].licence, got[3].licence) == ("mit", "mit") and all(got[i].licence == "none" for i in got if i not in (0, 3))


@pytest.mark.parametrize("sent", [0, 100])
def test_frequent_blocks_are_split_and_lose_nothing(spark, monkeypatch, sent):
    monkeypatch.setattr(simhash, "HOT_ROWS", 7)
    monkeypatch.setattr(simhash, "SENT_VALUES", sent)
    rng = random.Random(4)
    base = rng.getrandbits(128)
    prints = {base ^ sum({1 << rng.randrange(128) for _ in range(rng.randrange(4))}) for _ in range(60)} | {rng.getrandbits(128) for _ in range(30)}
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(signed(p >> 64), signed(p % 2**64)) for p in prints], "hi bigint, lo bigint")
    rows = simhash.near(df, 3).collect()
    got = [frozenset(((r.a_hi % 2**64) << 64 | r.a_lo % 2**64, (r.b_hi % 2**64) << 64 | r.b_lo % 2**64)) for r in rows]
    assert len(got) == len(set(got))
    assert set(got) == {frozenset((a, b)) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3}


@pytest.mark.parametrize("n", [1, 2, 7, 300])
def test_bucket_of_every_id(spark, n):
    bounds = sorted(random.Random(n).sample(range(-1000, 1000), n))
    got = spark.range(-1100, 1100).select(F.col("id").alias("doc_id")).select("doc_id", simhash._bucket(bounds).alias("b")).collect()
    assert all(r.b == sum(b <= r.doc_id for b in bounds) for r in got)


def test_words_of_letters_are_the_tokenizers(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_CHUNKS", 50)
    monkeypatch.setattr(packing, "KEPT_CHUNKS", 20)
    whole = packing.encoder(packing.vocabulary_path())
    e = packing.Encoder(packing.vocabulary_path())
    rng = random.Random(8)
    # letters that compose, grow marks in lower case, have no case, or are newer than the tokenizer's tables
    letters = [*"abcXYZäßñéİıǅſКийωΣ字學あ한אب́", "é", "İ", "ͅ", "ﬁ", "ª", "\U0001e030", "Ƛ", "\U00016d43"]
    for _ in range(60):
        text = " ".join("".join(rng.choices(letters, k=rng.randrange(1, 9))) + rng.choice(["", "", ".", ",", "!"]) for _ in range(rng.randrange(1, 12)))
        assert list(e.batch([text.encode()])) == [whole._plain(text) + whole.end]
        assert len(e.known) <= 120
