import re

import corpus_pipeline as p
from tests.llm.test_decontaminate import words
from tests.llm.test_neardup import brute as near_classes
from tests.llm.test_packing import whole
from tests.llm.test_pii import brute as spans_of

D = "/root/testdata/sf0.01"


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages_against_brute_force(spark):
    from ironlift.llm.common import saved

    docs = spark.read.parquet(f"{D}/documents.parquet")
    frames = [docs]
    for k, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, frames[-1], D)
        if k < 4:
            assert sorted(out.columns) == sorted(docs.columns)
        frames.append(saved(out, f"stage-{k}"))
    at = [texts(f) for f in frames[:5]]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    kept = [k in at[1] for k in labels if labels[k] == 1]
    assert sum(kept) > 0.97 * len(kept) and sum(k in at[1] for k in labels if not labels[k]) < 0.1 * len(labels)
    assert sorted(at[2]) == sorted(v[0] for v in near_classes(sorted(at[1].items())))
    grams = set()
    for r in spark.read.parquet(f"{D}/benchmark.parquet").collect():
        w = words(r.text)
        grams |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9) if w else 0)}
    sizes = {len(g) for g in grams}

    def clean(t):
        w = words(t)
        return not any(tuple(w[i : i + n]) in grams for n in sizes for i in range(len(w) - n + 1))

    assert sorted(at[3]) == sorted(k for k, t in at[2].items() if clean(t))
    assert sorted(at[4]) == sorted(at[3])
    assert all(not spans_of(re.sub(r"<[A-Z]+>", "\n<>\n", t)) for t in at[4].values())
    hidden = lambda t: bool(spans_of(t) or re.search(r'token = "[0-9a-f]{40}"', t))
    assert sum(at[4][k] != at[3][k] for k in at[3]) == sum(hidden(at[3][k]) for k in at[3])
    rows = frames[5].collect()
    whole(rows, 1024)
    assert {r.doc_id for r in rows} == set(at[4])


def test_run_gives_the_last_stage(spark):
    out = p.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns) and out.count() > 0


def test_stages_take_nulls_long_texts_clashing_columns_and_empty_tables(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "some words here a@b.co", "en", "s", 21), (3, "some words here a@b.co", "en", "s", 21), (4, " ".join(f"long{k % 977}" for k in range(60_000)), "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.selectExpr("*", *[f"'own' as {c}" for c in ("score", "match", "spans", "node", "root", "mark", "length", "ids", "start", "quality")])
    for k, (_, stage) in enumerate(p.STAGES):
        out = stage(spark, df, D)
        assert out.count() >= (0 if k == 0 else 3)
        if k < 4:
            assert out.columns == list(p.COLUMNS)
        if k == 0:  # repeated rows are judged alike
            assert [r.doc_id for r in out.collect()].count(3) in (0, 2)
        assert stage(spark, df.limit(0), D).count() == 0
