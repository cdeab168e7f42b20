import itertools
import random
import re

import numpy as np

from ironlift.llm.neardup import components, drop_near_duplicates, near_duplicates, probminhash
from ironlift.llm.queries import op7_near_duplicates

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingle_set(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(docs, least=0.8):
    parent = list(range(len(docs)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [shingle_set(t) for _, t in docs]
    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    pairs = {(i, j) for v in where.values() for i, j in itertools.combinations(v, 2)}
    texts = {}
    for i, (_, t) in enumerate(docs):
        if t is not None:
            texts.setdefault(t, []).append(i)
    pairs |= {(v[0], j) for v in texts.values() for j in v[1:]}
    for i, j in sorted(pairs):
        s, u = sets[i], sets[j]
        if docs[i][1] == docs[j][1] or len(s & u) >= least * len(s | u):
            a, b = sorted((top(i), top(j)))
            parent[b] = a
    out = {}
    for i, (k, _) in enumerate(docs):
        out.setdefault(top(i), []).append(k)
    return sorted(sorted(v, key=lambda x: (x is None, x)) for v in out.values())


def classes(rows):
    out = {}
    for k, r in enumerate(rows):
        out.setdefault(r.class_id, []).append(r.doc_id)
    return sorted(sorted(v) for v in out.values())


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    rows = op7_near_duplicates(spark, "/root/testdata/sf0.01").collect()
    assert classes(rows) == brute(docs)
    sizes = {r.class_id: r.n_class for r in rows}
    assert all(sizes[v[0]] == len(v) for v in classes(rows))


def test_large_group_of_near_copies(spark):
    rnd = random.Random(4)
    base = [f"w{rnd.randint(0, 10**6)}" for _ in range(60)]
    docs = []
    for k in range(120):
        w = list(base)
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(60)] = f"x{rnd.randint(0, 10**6)}"
        docs.append((k, " ".join(w)))
    docs += [(1000 + k, " ".join(f"y{rnd.randint(0, 10**6)}" for _ in range(50))) for k in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert classes(near_duplicates(df, few=3).collect()) == brute(docs)
    assert sorted(r.doc_id for r in drop_near_duplicates(df).collect()) == sorted(v[0] for v in brute(docs))


def test_copies_of_copies_and_deletions(spark):
    rnd = random.Random(8)
    base = [f"w{rnd.randint(0, 10**6)}" for _ in range(80)]
    docs = []
    for family in range(3):
        own = list(base)
        for _ in range(family * 3):
            own[rnd.randrange(80)] = f"f{family}{rnd.randint(0, 10**6)}"
        for k in range(30):
            w = list(own)
            for _ in range(rnd.randint(0, 3)):
                i = rnd.randrange(len(w))
                w[i : i + rnd.randint(0, 2)] = [f"x{rnd.randint(0, 10**6)}"] * rnd.randint(0, 1)
            docs.append((100 * family + k, " ".join(w[: len(w) - rnd.randint(0, 8)])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = brute(docs)
    for few in (2, 16):
        assert classes(near_duplicates(df, few=few).collect()) == want


def test_repeats_that_one_text_alone_has(spark):
    rnd = random.Random(6)
    new = lambda n: [f"w{rnd.randint(0, 10**9)}" for _ in range(n)]
    docs = []
    for k in range(40):
        base = new(100)
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base + new(16) * 50))]  # 96 shingles in both, 20 in one of which 16 occur 49 or 50 times
    want = brute(docs)
    assert len(want) == 40
    assert classes(near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()) == want


def test_edges(spark):
    docs = [(1, None), (2, None), (3, ""), (4, ""), (5, "!!"), (6, "!!"), (7, "?"), (8, "two words"), (9, "Two, words!"), (10, "long words here " * 20_000), (10, "long words here " * 20_000), (11, "a b c d e f g")]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, node int")
    got = near_duplicates(df).collect()
    assert len(got) == len(docs)
    assert classes(got) == [[1], [2], [3, 4], [5, 6], [7], [8, 9], [10, 10], [11]]
    assert sorted(r.doc_id for r in drop_near_duplicates(df).collect()) == [1, 2, 3, 5, 7, 8, 10, 11]
    assert near_duplicates(df.limit(0)).count() == 0
    null = near_duplicates(spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "a b")], "doc_id long, text string")).collect()
    assert {r.class_id for r in null} == {3} and len(null) == 3


def test_probminhash_estimates_probability_jaccard():
    rnd = np.random.default_rng(2)
    e = rnd.integers(1, 2**63, 300).astype(np.uint64)
    wa, wb = rnd.uniform(0.5, 4, 300), rnd.uniform(0.5, 4, 300)
    wa[:60] = 0
    wb[240:] = 0
    want = sum(1 / np.maximum(wa / a, wb / b).sum() for a, b in zip(wa, wb) if a and b)
    m = 4096
    sig = [probminhash(e[w > 0], w[w > 0], np.zeros((w > 0).sum(), int), 1, m)[0] for w in (wa, wb)]
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03


def test_components(spark):
    rnd = random.Random(1)
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 200)] + [(500 + rnd.randint(0, 50), 500 + rnd.randint(0, 50)) for _ in range(60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    for a, b in edges:
        for x in (a, b):
            parent.setdefault(x, {x})
        s = parent[a] | parent[b]
        for x in s:
            parent[x] = s
    assert got == {x: min(s) for x, s in parent.items() if min(s) != x}
