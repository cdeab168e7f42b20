"""Two-pass external shuffle into shards: seeded scatter into memory-sized buckets, then a Fisher-Yates shuffle of each bucket.

DataFrame functions only. One law holds: `rows`, the shards' row counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, saved, sums_before

#: Bytes of text that one bucket may hold on average; a bucket is shuffled in one task's memory.
BUCKET_BYTES = 8 << 20
#: Buckets of a task: tasks grow with the bytes, and no mapper keeps a part for each bucket.
BUCKETS = 8


def size_of(text: str):
    """Bytes that a record counts as: its text in UTF-8 and an end."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def shuffle_shards(df: DataFrame, shards: int = 8, seed: int = 42, text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """df's rows with `shard` (0 to shards-1) and `slot` (gapless from 0 in its shard), in a uniformly random order.

    Pass 1 gives every row a bucket by a seeded hash of its place in the input, so a repeated row, key or text
    spreads over all buckets, and writes that. Pass 2 brings each bucket together, shuffles it with a seeded
    stream (Spark's shuffle() is Fisher-Yates) and deals the rows out in turn, starting where the bucket
    before it ended. The order depends on the seed and on how the input is split into partitions.
    Null texts count as no bytes; repeated rows stay repeated rows; an empty table gives an empty one.
    A very long text makes its bucket as much larger. Columns of df named shard or slot stay, and the new ones get underscores appended.
    """
    spark = df.sparkSession
    shard, slot, bucket, place, base, pos, packed = fresh(df, "shard", "slot", "bucket", "place", "base", "pos", "packed")
    total = df.select(F.sum(size_of(text))).first()[0] or 0
    n = max(1, -(-total // bucket_bytes))
    placed = df.withColumn(place, F.monotonically_increasing_id())
    rows = saved(placed.withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed), F.col(place)), F.lit(n))), "scatter")
    bases = sums_before(rows.groupBy(bucket).count(), bucket, "count", base)
    # a task shuffles BUCKETS buckets or so, whatever the session's number
    whole = rows.repartition(-(-n // BUCKETS), bucket).groupBy(bucket).agg(F.collect_list(F.struct(place, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))).alias(packed))
    by_place = F.array_sort(packed, lambda a, b: F.when(a[place] < b[place], -1).when(a[place] > b[place], 1).otherwise(0))  # rows arrive in any order
    mixed = whole.select(bucket, F.shuffle(by_place, F.lit(seed)).alias(packed))
    out = mixed.join(bases, bucket).select(base, F.posexplode(packed).alias(pos, "row"))
    at = F.col(base) + F.col(pos)
    return out.select("row.row.*", F.pmod(at, F.lit(shards)).cast("int").alias(shard), F.floor(at / shards).cast("long").alias(slot))


def write_shards(shuffled: DataFrame, path: str, shard: str = "shard", slot: str = "slot") -> None:
    """Writes one folder a shard (an empty table writes none; nulls and repeated rows are rows like any), the rows of each file in the order of their slots; a shard's files are ranges of its slots."""
    (shuffled.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot)
     .write.partitionBy(shard).option("compression", "zstd").parquet(path))
