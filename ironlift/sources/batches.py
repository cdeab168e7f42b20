"""Tables written in batches that can be retried: a batch's rows count once its manifest is whole, and the manifest tells what was processed.

Below a table's path, `rows/batch=<id>` holds rows and `manifest/seq=<n>/batch=<id>/fresh=<0 or 1>` the keys that the batch
processed. A manifest without its _SUCCESS file does not count, nor do its rows. So a batch written again after a failure is one batch, writing a committed one again does nothing, and
nothing that readers see is ever deleted or half renamed. A fresh batch hides all before it.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = re.compile(r"/manifest/seq=(\d+)/batch=([^/]+)/fresh=([01])/_SUCCESS$")


def exists(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match a pattern, in any store that Spark reaches; only names are looked at."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(s.getPath().toString() for s in found or ())


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a write to path has ended well."""
    return bool(exists(spark, f"{path}/_SUCCESS"))


def committed(spark: SparkSession, path: str) -> list[tuple[int, str, str]]:
    """(number, id, folder of the manifest) of the batches that count, in their order: the last fresh one and those after it."""
    every = sorted((int(m[1]), m[2], m[3] == "1", p.rpartition("/")[0]) for p in exists(spark, f"{path}/manifest/seq=*/batch=*/fresh=*/_SUCCESS") if (m := _MANIFEST.search(p)))
    first = max((k for k, b in enumerate(every) if b[2]), default=0)
    return [(n, b, folder) for n, b, _, folder in every[first:]]


def write_batch(rows: DataFrame | None, path: str, batch: str, keys: list[str], more: DataFrame | None = None, fresh: bool = False, partition_by: tuple[str, ...] = ()) -> bool:
    """Writes rows and commits the batch; False if it was committed before.

    The manifest has the distinct keys of the written rows, and those of `more`: what was processed and gave no rows. None for rows: there are none.
    """
    if not re.fullmatch(r"[\w.-]+", batch):
        raise ValueError("a batch's id is letters, digits, _, . and -")
    given = rows if rows is not None else more
    spark = given.sparkSession
    if any(f"/batch={batch}/" in p for p in exists(spark, f"{path}/manifest/seq=*/batch={batch}/fresh=*/_SUCCESS")):
        return False
    seq = max((int(_MANIFEST.search(p)[1]) for p in exists(spark, f"{path}/manifest/seq=*/batch=*/fresh=*/_SUCCESS")), default=0) + 1
    parts = []
    if rows is not None:
        out = f"{path}/rows/batch={batch}"
        rows.write.mode("overwrite").partitionBy(*partition_by).parquet(out)
        parts.append(spark.read.schema(rows.schema).parquet(out).select(*keys))
    if more is not None:
        parts.append(more.select(*keys))
    reduce(DataFrame.unionByName, parts).distinct().write.mode("overwrite").parquet(f"{path}/manifest/seq={seq:012d}/batch={batch}/fresh={int(fresh)}")
    return True


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """The keys of all batches that count, with seq and batch; None if there is none."""
    found = committed(spark, path)
    if not found:
        return None
    parts = [spark.read.parquet(folder).withColumns({"seq": F.lit(n).cast("long"), "batch": F.lit(b)}) for n, b, folder in found]
    return reduce(DataFrame.unionByName, parts)


def _rows_of(spark: SparkSession, path: str, batch: str) -> DataFrame | None:
    folder = f"{path}/rows/batch={batch}"
    if not finished(spark, folder):
        return None
    try:
        return spark.read.parquet(folder).withColumn("batch", F.lit(batch))
    except AnalysisException as e:  # a partitioned batch without rows has no files
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return None


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the batches that count, with their batch. Each batch is a scan of its own: compact() makes many one."""
    parts = [r for _, b, _ in committed(spark, path) if (r := _rows_of(spark, path, b)) is not None]
    if not parts:
        raise FileNotFoundError(f"no batch of {path} has rows")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The rows of each key's last batch: later batches replace what earlier ones had of a key, also by nothing. Of two that were written side by side
    under one number the later id counts. Rows of a null key are replaced by none but a fresh batch.
    """
    rows, done = read_rows(spark, path), manifest(spark, path)
    if len(committed(spark, path)) > 1:
        last = done.groupBy(*keys).agg(F.max(F.struct("seq", "batch")).alias("last__"))
        old = done.join(last, keys).where(F.struct("seq", "batch") < F.col("last__")).select(*keys, "batch")
        rows = rows.join(old, [*keys, "batch"], "left_anti")
    return rows.drop("batch")


def compact(spark: SparkSession, path: str, batch: str, keys: list[str], partition_by: tuple[str, ...] = ()) -> bool:
    """Writes what counts as one fresh batch, so that later reads need no join; earlier folders may then go."""
    return write_batch(read_latest(spark, path, keys), path, batch, keys, manifest(spark, path).select(*keys), True, partition_by)
