"""The pipeline's stages against brute force on a small table."""

import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from wardline.llm import langid, mixing, packing
from wardline.llm.common import written

from .test_operators import DOCS, brute_components, check_pieces, families

TEXTS = families(3, n=6) + ["mail me at someone.99@mail3.example.com about it all and more"] * 2


@pytest.fixture(scope="module")
def steps(spark):
    rows = [(i, t, "en" if i % 2 else None, ("a", "b", None)[i % 3], None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    rows.append(rows[20])  # a repeated row
    docs = spark.createDataFrame(rows, DOCS)
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], "unused")))
    return out


def texts_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_language_stage(steps):
    letters = {i for i, t in enumerate(TEXTS) if t and any(map(str.isalpha, t))}
    assert set(texts_of(steps[1])) == letters and steps[1].columns == steps[0].columns
    assert steps[1].count() == len(letters) + 1


def test_one_of_each_group_stays(steps):
    before = texts_of(steps[1])
    ids = sorted(before)
    _, parts = brute_components([before[i] for i in ids])
    assert sorted(r.doc_id for r in steps[2].collect()) == sorted({ids[p] for p in parts})


def test_private_data_goes(steps):
    before, after = texts_of(steps[2]), texts_of(steps[3])
    assert set(before) == set(after)
    changed = {i for i in before if before[i] != after[i]}
    assert changed == {i for i in before if "@" in before[i]} and all("someone.99" not in after[i] for i in changed)
    assert all(r.n_chars == len(r.text) for r in steps[3].collect())


def test_mixing_keeps_all(steps):
    assert Counter(map(tuple, steps[3].collect())) == Counter(map(tuple, steps[4].collect()))


def test_packing_stage(steps):
    docs = sorted(steps[4].collect(), key=lambda r: r.doc_id)
    number = {r.doc_id: k for k, r in enumerate(docs)}
    rows = [r.asDict() for r in steps[5].collect()]
    from pyspark.sql import Row

    assert check_pieces([Row(**(r | {"doc_id": number[r["doc_id"]]})) for r in rows], [r.text for r in docs]) == 0


def test_odd_tables(spark):
    """Clashing extra columns, nulls everywhere, and no rows at all."""
    rows = [(None, None, None, None, None), (1, "some words of a text", None, None, None), (None, "another text, without an id", "en", "s", 3)]
    for given in (rows, []):
        df = spark.createDataFrame(given, DOCS).selectExpr("*", "1 as TEXT", "2 as score", "3 as place", "4 as _source", "5 as n_entities", "6 as part")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            df = written(stage(spark, df, "unused"))
            assert k == 4 or df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert (df.count() > 0) == bool(given) and df.select("doc_id").distinct().count() == (2 if given else 0)


def test_whole_run(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and got.count() > 100
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
    assert np.uint32(zlib.crc32(b"")) == 0


def test_sequences_follow_the_schedule(spark, monkeypatch):
    """Windows of the packed sequences hold the documents in slot order, so prefixes have the sources' shares."""
    rows = [(i, "", "en", "aab"[i % 3] if i < 900 else "c", 1) for i in range(1000)]
    slot = {r.doc_id: (r.slot, r.place) for r in mixing.mixed(spark.createDataFrame(rows, DOCS)).select("doc_id", "slot", "place").collect()}
    # later documents are longer, so that a scan begins with the last file
    at = {d: k for k, d in enumerate(sorted(slot, key=slot.get))}
    docs = spark.createDataFrame([(r[0], " ".join(f"w{r[0]}x{k}" for k in range(5 + at[r[0]] // 10)), *r[2:]) for r in rows], DOCS)
    monkeypatch.setattr(packing, "WINDOW_TOKENS", 1 << 13)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stages = dict(corpus_pipeline.STAGES)
        mixed = written(stages["source_mixing"](spark, docs, "unused"))
        assert len(mixed.inputFiles()) > 1
        got = stages["packing"](spark, mixed, "unused").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    source = {r[0]: r[3] for r in rows}
    order = sorted(slot, key=slot.get)
    first = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        first.setdefault(r.doc_id, len(first))
    sequences = sorted(first, key=first.get)
    assert set(sequences) == set(order)
    for n in range(100, 1000, 100):  # a window holds fewer than 100 documents beyond a prefix
        a, b = Counter(source[i] for i in sequences[:n]), Counter(source[i] for i in order[:n])
        late = set(sequences[:n]) - set(order[: n + 200])
        assert not late and all(abs(a[s] - b[s]) <= 60 for s in "abc"), (n, a, b)


def test_a_worker_remembers_one_operator(spark):
    """Workers go from stage to stage; what an earlier operator remembers there must not stay beside the next one's."""
    docs = spark.createDataFrame([(i, f"some words of text {i} and more of them", "ab"[i % 2], "s", 9) for i in range(64)], DOCS).repartition(16)

    def probe(batches):
        import gc
        import time

        from wardline.llm import langid, packing

        for _ in batches:
            pass
        time.sleep(0.1)  # so that all workers are asked
        live = gc.get_objects()
        yield pa.RecordBatch.from_pydict({"n": [sum(any(isinstance(x, kind) for x in live) for kind in (langid.Scorer, packing.Encoder))]})

    stages, most = dict(corpus_pipeline.STAGES), []
    for name in ("language_id", "packing", "near_duplicates"):
        written(stages[name](spark, docs, "unused"))
        most.append(max(r.n for r in spark.range(0, 16, 1, 16).mapInArrow(probe, "n bigint").collect()))
    assert most[:2] == [1, 1]


def test_tables_of_the_driver_pass_no_python_worker(spark):
    """Plain rows of the driver become an RDD that a second kind of Python workers reads, beside the operators' own."""
    docs = spark.range(40).selectExpr("id doc_id", "concat('text ', id) text", "'en' lang", "concat('s', id % 3) source", "id n_chars")
    plans = [mixing.mixed(docs), langid.training_counts(docs.select("doc_id", "text", "lang"))]
    for plan in plans:
        rdds = re.findall(r"Scan ExistingRDD\[([^\]]*)", plan._jdf.queryExecution().executedPlan().toString())
        assert not any("_slots" in x or "_share" in x for x in rdds) and plan.count()


def test_a_window_goes_in_small_batches(monkeypatch):
    """A window's ids are not copied as a whole beside it."""
    monkeypatch.setattr(packing, "narrowed", lambda *_, **__: SimpleNamespace(mapInArrow=lambda run, schema: run))
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    texts = pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "text": ["a text of a few words"] * 1000})
    sizes = [b.num_rows for b in packing.packed(None)(iter([texts]))]
    assert sum(sizes) >= 1000 and max(sizes) <= 256
