"""Clashing names, nulls, repeated rows, empty tables and long texts, for each operator."""

import pytest
from pyspark.sql import functions as F

from ironlift.llm import classifier, decontaminate, neardup, packing, pii, quality_rules, sharding, suffixes

CLASHING = ["x1", "d", "y1", "scale", "group__", "t__", "row__", "base__", "place__", "data__", "node__", "spans__", "cut__", "kept__", "mark", "node", "root", "score", "match", "spans", "stats", "kept", "shard", "bucket", "row", "id", "y", "v"]
WORDS = "one two three four five six seven eight nine ten eleven twelve".split()


@pytest.fixture(scope="module")
def docs(spark):
    text = " ".join(WORDS * 6)
    rows = [(1, text), (1, text), (2, None), (None, "short"), (3, ""), (4, " ".join(f"w{k}" for k in range(30_000)))]
    df = spark.createDataFrame([(k, t, "en", None) for k, t in rows], "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


def kept_own(df, rows):
    got = df.collect()
    assert len(got) == rows
    assert all(r[c] == f"own {c}" for r in got for c in CLASHING)


def applied(spark, docs):
    bench = spark.createDataFrame([(1, " ".join(WORDS))], "item_id long, text string")
    return {
        "near": lambda: neardup.drop_near_duplicates(docs), "match": lambda: decontaminate.decontaminate(docs, bench), "find": lambda: pii.find_pii(docs), "redact": lambda: pii.redact_pii(docs),
        "shards": lambda: sharding.shuffle_shards(docs, 3), "repeats": lambda: suffixes.remove_repeats(docs), "quality": lambda: quality_rules.quality(docs), "pack": lambda: packing.pack(docs.withColumn("length", F.lit(3))),
        "score": lambda: classifier.fit(docs, spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")).score(docs)}


@pytest.mark.parametrize("name", ["near", "match", "find", "redact", "shards", "repeats", "quality", "pack", "score"])
def test_columns_stay(spark, docs, name):
    kept_own(applied(spark, docs)[name](), 5 if name == "near" else 6)


@pytest.mark.parametrize("name", ["near", "match", "find", "redact", "shards", "repeats", "quality", "pack", "score"])
def test_empty_tables(spark, docs, name):
    assert applied(spark, docs.limit(0))[name]().collect() == []


def test_blocks_in_passes(spark, docs):
    items = spark.createDataFrame([(k, " ".join(WORDS[k % 3 :])) for k in range(12)], "item_id long, text string")
    few = decontaminate.decontaminate(docs.select("doc_id", "text"), items, block_bytes=200)
    one = decontaminate.decontaminate(docs.select("doc_id", "text"), items)
    row = lambda r: (str(r.doc_id), r.match.n_words, r.match.n_hit, r.match["items"])
    assert sorted(map(row, few.collect())) == sorted(map(row, one.collect()))
    assert any(r.match.n_hit for r in one.collect())


def test_secrets():
    value = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    text = f'x token = "{value}" y'
    assert pii.find(text) == [("secret", 11, 51)]
    assert pii.redacted(text, pii.find(text)) == 'x token = "<SECRET>" y'
    assert [k for k, _, _ in pii.find("API_KEY=abcd1234efgh5678.")] == ["secret"]
    assert pii.find("the token was given to everyone, and password: please") == []
    assert pii.find('token = "0123456789abcdef') == []  # its quote does not close


def test_rows_of_one_id(spark):
    a, b = " ".join(WORDS * 3), " ".join(f"z{k}" for k in range(40))
    df = spark.createDataFrame([(1, a), (0, b), (1, b), (7, None), (7, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text or "") for r in neardup.drop_near_duplicates(df).collect()))
    assert got == sorted([(0, b), (1, a), (7, ""), (7, "")])


def test_equal_sets_of_repeated_shingles(spark):
    rows = []
    for k in range(60):
        own = " ".join(f"a{k}x{j}" for j in range(60))
        phrase = " ".join(f"p{k}y{j}" for j in range(5))
        rows += [(2 * k, f"{own} {' '.join([phrase] * 2)}"), (2 * k + 1, f"{own} {' '.join([phrase] * 200)}")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.class_id == r.doc_id // 2 * 2 and r.n_class == 2 for r in got)
