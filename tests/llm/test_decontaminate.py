import re

from ironlift.llm.decontaminate import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, n):
    out = {}
    for key, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, t in items:
            v = words(t)
            for k in range(max(1, len(v) - n + 1) if v else 0):
                part = v[k : k + n]
                for i in range(len(w) - len(part) + 1):
                    if w[i : i + len(part)] == part:
                        hit |= set(range(i, i + len(part)))
                        ids.add(str(item))
        out[key] = (len(w), len(hit), sorted(ids))
    return out


DOCS = [(1, "A b c D e"), (2, None), (3, ""), (4, "x b c d, x b.c.d b c d e f g"), (5, "é É a b"), (5, "é É a b"), (6, "one b one b one"), (7, "b c d " * 3000), (None, "zz b c d zz")]
ITEMS = [(1, "b c d e"), (2, "B c d"), (10, "É a"), (3, None), (4, "..."), (5, "one"), (11, "b c d e")]


def run(spark, docs, items, **more):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = decontaminate(df, spark.createDataFrame(items, "item_id long, text string"), window=3, **more).collect()
    return rows


def test_against_brute_force(spark):
    want = brute(DOCS, ITEMS, 3)
    rows = run(spark, DOCS, ITEMS)
    assert len(rows) == len(DOCS)
    for r in rows:
        assert (r.match.n_words, r.match.n_hit, r.match["items"]) == want[r.doc_id], r.doc_id


def test_blocks_agree_with_one_automaton(spark):
    key = lambda r: (r.doc_id or -1, r.match.n_words, r.match.n_hit, tuple(r.match["items"]), tuple(map(tuple, r.match.spans)))
    assert sorted(map(key, run(spark, DOCS, ITEMS))) == sorted(map(key, run(spark, DOCS, ITEMS, block_bytes=5)))


def test_spans_point_at_the_original(spark):
    r = run(spark, [(1, "Ünd: B, c -- d!")], ITEMS)[0]
    assert [("Ünd: B, c -- d!"[s.start : s.end]) for s in r.match.spans] == ["B, c -- d"]


def test_clash_and_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, match string")
    out = decontaminate(df, spark.createDataFrame([], "item_id long, text string"))
    assert out.columns[-1] == "match_" and out.count() == 0


def test_query_on_planted_rows(spark):
    from ironlift.llm.queries import op4_decontaminate

    rows = op4_decontaminate(spark, "/root/testdata/sf0.001").collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            grams.setdefault(tuple(w[k : k + 10]), set()).add(i)
    sizes = {len(g) for g in grams}
    for r in rows:
        w, hit, ids = words(dict(docs)[r.doc_id]), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if g := grams.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    ids |= g
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(ids), bool(hit))
    assert any(r.contaminated for r in rows)
