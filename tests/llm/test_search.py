"""Reversed search against a plain loop over all items and documents, blocks, ties and edges."""

import math
import re
from collections import Counter

import duckdb
import pytest

from ironlift.llm.queries import ORACLE_SQL, QUERIES
from ironlift.llm.search import Heaps, search

D = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, items, top=10):
    low = {c: c + 32 for c in range(65, 91)}
    terms = lambda t: TERM.findall((t or "").translate(low))
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_all, length = sum(n > 0 for _, _, n in held), sum(n for _, _, n in held)
    df = Counter(w for _, c, _ in held for w in c)
    wanted = {}
    for i, t in items:
        if i is not None and terms(t):
            wanted.setdefault(i, set()).update(terms(t))
    out = []
    for i, words in wanted.items():
        scores = []
        for d, c, n in held:
            if d is None or not n:
                continue
            m = 100 - 90 + (90 * n * n_all) // length
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 8 * m)) for w in words if w in c)
            if s > 0:
                scores.append((-s, d))
        out += [(i, k + 1, d, -s) for k, (s, d) in enumerate(sorted(scores)[:top])]
    return sorted(out)


def got(df):
    return sorted((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect())


def test_whole_table_against_loop_and_sql(spark):
    docs, items = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got(QUERIES["op11_ranked_search"](spark, D)) == want and len(want) > 300
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    assert sorted(con.execute(f"select item_id, rank, doc_id, score from ({ORACLE_SQL['op11_ranked_search']})").fetchall()) == want


ROWS = [(3, "a b c"), (1, "a B, c"), (1, "a b c"), (None, "a a a z"), (4, None), (5, ""), (6, "!?"), (2, "Élan élan É"), (7, "x " * 20000 + "b"), (8, "a b")]
ITEMS = [(1, "A b"), (2, None), (3, "..."), (None, "a"), (4, "Élan"), (5, "b b b x"), (5, "c"), (6, "nowhere")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 3])
def test_edges(spark, block_bytes):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumnsRenamed({}).selectExpr("*", "1 as score", "2 as rank", "3 as item_id")
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "'x' as doc_id")
    out = search(docs, items, top=3, block_bytes=block_bytes)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert got(out) == brute(ROWS, ITEMS, 3)
    assert {r[2] for r in got(out) if r[0] == 4} == {2}  # capitals beyond A-Z stay


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(ROWS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search(docs.limit(0), items).count() == 0 and search(docs, items.limit(0)).count() == 0


def test_many_equal_scores_stay_bounded_and_ranked(spark):
    docs = spark.range(3000).selectExpr("2999 - id as doc_id", "'same words here' as text").union(spark.range(100).selectExpr("id + 5000 as doc_id", "'other' as text")).repartition(7)
    out = search(docs, spark.createDataFrame([(1, "words")], "item_id long, text string"))
    assert [r[1:3] for r in got(out)] == [(k + 1, k) for k in range(10)]
    heaps = Heaps(1, 2)
    import numpy as np

    for d in (5, 3, 9, 1):
        heaps.offer(d, np.array([7]))
    assert sorted(heaps.heaps[0]) == [(7, -3), (7, -1)]
