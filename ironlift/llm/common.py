"""What the training-data operators share: the shared folder, saved tables, hashing in numpy."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one Arrow batch may hold on its way to a Python worker, so that a batch of long texts stays small.
ARROW_ROWS = 1000


def tune(spark: SparkSession) -> None:
    """Bounds Arrow batches of this session; texts are long, so Spark's default of 10,000 rows a batch is too much."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI below spark.checkpoint.dir, which driver and executors share; only where that is unset and all runs in one JVM, as in tests, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{qualified(spark, root).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme and authority that Spark's writers give it, so that a bare path is on the cluster's default store for all readers."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: cuts the lineage, and survives lost executors."""
    path = work_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Schemes of Spark's stores and what pyarrow calls them.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "hdfs": "hdfs", "viewfs": "viewfs", "abfs": "abfs", "abfss": "abfss", "file": "file", "s3": "s3"}


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a qualified URI, on driver and executors; a path without a scheme is refused, as it would be each machine's own disk."""
    from pyarrow import fs

    scheme, found, rest = uri.partition(":")
    if not found or scheme not in _SCHEMES:
        raise ValueError(f"{uri} names no store that files are written to")
    return fs.FileSystem.from_uri(f"{_SCHEMES[scheme]}:{rest}")


def sums_before(counts: DataFrame, order: str, value: str, name: str, size: int = 4096) -> DataFrame:
    """(order, name) of counts (order, a whole number from 0 that occurs once; value): the sum of value in the rows before.

    Sums run within slices of `size` numbers, and over the slices' totals, so that no task holds more rows than a slice or there are slices.
    """
    sliced = counts.select(order, value, F.floor(F.col(order) / size).alias("slice__"))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    totals = sliced.groupBy("slice__").agg(F.sum(value).alias("total__"))
    begun = totals.select("slice__", F.coalesce(F.sum("total__").over(earlier.orderBy("slice__")), F.lit(0)).alias("begun__"))
    within = F.coalesce(F.sum(value).over(earlier.partitionBy("slice__").orderBy(order)), F.lit(0))
    return sliced.withColumn("within__", within).join(begun, "slice__").select(order, (F.col("begun__") + F.col("within__")).alias(name))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """wanted, each with underscores added until no column of df has that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of unsigned 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RangeHash:
    """Polynomial hashes modulo 2**64 of any byte ranges of one buffer, from prefix sums."""

    BASE = 0x9E3779B97F4A7C15
    _powers = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    @classmethod
    def _grow(cls, n: int) -> None:
        if len(cls._powers) < n:
            m = 1 << (n - 1).bit_length()
            out = []
            for base in (cls.BASE, pow(cls.BASE, -1, 2**64)):
                p, k = np.ones(m, np.uint64), 1
                while k < m:
                    p[k : 2 * k] = p[:k] * np.uint64(pow(base, k, 2**64))
                    k *= 2
                out.append(p)
            cls._powers, cls._inverse = out

    def __init__(self, data: np.ndarray):
        """data: uint8"""
        n = len(data)
        self._grow(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self._powers[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self._inverse[start])
