import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ironlift.llm.packing import combinations, cut_documents, non_negative, pack, plan
from ironlift.llm.queries import op2_pack


def whole(rows, window):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    padding = 0
    assert sorted(by) == list(range(len(by)))
    for v in by.values():
        v.sort(key=lambda r: r.offset)
        assert [r.offset for r in v] == np.cumsum([0, *(r.length for r in v)])[:-1].tolist()
        n = sum(r.length for r in v)
        assert n <= window
        pad = 0 if n & (n - 1) == 0 else window - n
        assert {r.padding for r in v} == {pad}
        padding += pad
    return padding / max(1, sum(r.length for r in rows))


def test_query_covers_each_id_once(spark):
    rows = op2_pack(spark, "/root/testdata/sf0.01").collect()
    assert whole(rows, 1024) < 0.02
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert sorted(by) == sorted(docs)
    for k, v in by.items():
        ids = np.array([*t.encode(docs[k], add_special_tokens=False).ids, 0], "<u4")
        v.sort(key=lambda r: r.start)
        assert [r.start for r in v] == np.cumsum([0, *(r.length for r in v)])[:-1].tolist() and sum(r.length for r in v) == len(ids)
        for r in v:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())


def test_plan_uses_the_histogram_exactly():
    rnd = np.random.default_rng(1)
    for window, n in ((1024, 50_000), (64, 3000), (8, 20), (1024, 5), (16, 0)):
        counts = np.bincount(rnd.integers(1, window + 1, n), minlength=window + 1)
        used, tokens = np.zeros(window + 1, int), 0
        for repeats, sequence in plan(counts, window):
            assert repeats > 0 and sum(a * b for a, b in sequence) <= window
            tokens += repeats * window
            for a, b in sequence:
                used[a] += repeats * b
        assert (used == counts).all()
        if n > 2000:
            assert tokens / (counts * np.arange(window + 1)).sum() < (1.003 if n == 50_000 else 1.02)


def test_solver_reaches_an_exact_solution():
    uses = combinations(np.arange(1, 32), 32)
    assert ((uses.sum(1) == 32)).all()
    x = np.zeros(len(uses))
    x[[3, 20, 60]] = 5, 7, 11
    counts = np.zeros(33)
    for v, u in zip(x, uses):
        for k in u[u > 0]:
            counts[k] += v
    got = non_negative(uses, counts, 2000)
    fit = np.zeros(33)
    for v, u in zip(got, uses):
        for k in u[u > 0]:
            fit[k] += v
    assert got.min() >= 0 and np.abs(fit - counts).max() < 0.05


def test_edges(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "x " * 5000), (3, "some words")], "doc_id long, text string")
    rows = pack(cut_documents(df, "byte_bpe_50k.json")).collect()
    whole(rows, 1024)
    assert sum(r.doc_id == 1 for r in rows) == 2 and max(r.doc_tokens for r in rows if r.doc_id is None) == sum(r.length for r in rows if r.doc_id is None)
    clash = spark.createDataFrame([(5, "a"), (8, "b"), (3, None)], "length long, offset string")
    out = pack(clash, window=8)
    assert out.columns == ["length", "offset", "sequence_id", "offset_", "padding"] and out.count() == 3
    assert pack(clash.limit(0), window=8).count() == 0
    for bad in (0, 9, None):
        with pytest.raises(ValueError):
            pack(spark.createDataFrame([(bad,)], "length long"), window=8)
