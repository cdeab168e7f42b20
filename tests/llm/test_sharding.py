import zlib

from ironlift.llm.queries import op6_shuffle_shards
from ironlift.llm import common
from ironlift.llm.sharding import shuffle_shards, write_shards


def check(rows, n):
    slots = {}
    for r in rows:
        slots.setdefault(r[-2], []).append(r[-1])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    counts = [len(slots.get(k, [])) for k in range(n)]
    assert max(counts) - min(counts) <= 1
    return counts


def test_rows_law_and_whole(spark):
    rows = op6_shuffle_shards(spark, "/root/testdata/sf0.01").select("doc_id", "size", "text_crc32", "law", "shard", "slot").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    check(rows, 8)
    assert all(r.size == len(docs[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) for r in rows)
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.slot, r.shard))]
    assert sum(b == a + 1 for a, b in zip(order, order[1:])) < 20


def test_hot_null_repeated_and_clashing(spark, tmp_path):
    rows = [(None, "same", 1)] * 300 + [(1, None, 2), (2, "", 3), (3, "x" * 200_000, 4)] + [(k, f"t{k}", 0) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot int").repartition(3)
    out = shuffle_shards(df, shards=4, seed=1, bucket_bytes=2000)
    assert out.columns == ["doc_id", "text", "slot", "shard", "slot_"]
    got = out.collect()
    check(got, 4)
    key = lambda r: (r[0] or -1, r[1] or "", r[2])
    assert sorted(map(key, got)) == sorted(map(key, rows))
    write_shards(out, f"file://{tmp_path}/s", slot="slot_")
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert back.count() == len(rows) and sorted(r[0] for r in back.select("shard").distinct().collect()) == [0, 1, 2, 3]


def test_empty(spark):
    assert shuffle_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_orders_repeat_under_a_seed_and_are_uniform(spark):
    """Under one seed and split the order repeats; over many seeds each row stands everywhere equally often, and so do pairs one after the other."""
    df = spark.range(0, 12, 1, 3).selectExpr("id as doc_id", "repeat('x', 30) as text")
    order = lambda seed: [r.doc_id for r in sorted(shuffle_shards(df, shards=1, seed=seed, bucket_bytes=100).collect(), key=lambda r: r.slot)]
    assert order(5) == order(5)
    seeds = 60
    orders = [order(k) for k in range(seeds)]
    assert len({tuple(o) for o in orders}) > seeds * 0.9
    places = [[o.index(d) for o in orders] for d in range(12)]
    # a row's mean place is 5.5 with a deviation of 3.45 / sqrt(seeds)
    assert all(abs(sum(p) / seeds - 5.5) < 4 * 3.45 / seeds**0.5 for p in places)
    before = sum(o.index(0) < o.index(1) for o in orders)
    assert abs(before - seeds / 2) < 4 * (seeds / 4) ** 0.5


def test_tasks_follow_the_bytes(spark):
    df = spark.range(0, 400, 1, 2).selectExpr("id as doc_id", "repeat('x', 999) as text")
    tasks = lambda n: shuffle_shards(df, bucket_bytes=n)._jdf.queryExecution().analyzed().toString().count("RepartitionByExpression")
    import re

    number = lambda n: int(re.search(r"RepartitionByExpression \[[^\]]*\], (\d+)", shuffle_shards(df, bucket_bytes=n)._jdf.queryExecution().analyzed().toString())[1])
    assert tasks(1000) == 1 and number(1000) == 50 and number(10_000) == 5 and number(1 << 20) == 1


def test_sums_before(spark):
    rows = [(k, (k * 7) % 11) for k in range(1000) if k % 5]
    got = common.sums_before(spark.createDataFrame(rows, "k long, n long").repartition(5), "k", "n", "before", 64).collect()
    want, total = {}, 0
    for k, n in rows:
        want[k], total = total, total + n
    assert {r.k: r.before for r in got} == want
