"""Reading and writing the tables: one scan for all files of a folder, partitioned writes, appends."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import batches
from ..functions.columns import stem_of, view_of
from ..operators.frames import nest
from ..schemas import FRAME_ANGLES, POSES, RAW_LANDMARKS


def shared_folder(spark: SparkSession) -> str:
    """A new folder's name below spark.checkpoint.dir; without that setting below the temporary folder, on a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/lifts-{uuid.uuid4().hex}"


def _named(key: str) -> Column:
    """A file's name, or that of the folder `key=<name>` which it lies in."""
    path = F.col("_metadata.file_path")
    folder = F.regexp_extract(path, f"/{key}=([^/]+)/[^/]+$", 1)
    plain = lambda name: F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
    # a path is escaped once, the value in a folder's name once more
    return F.when(folder != "", plain(plain(folder))).otherwise(plain(F.element_at(F.split(path, "/"), -1)))


def read_frames(spark: SparkSession, folder: str) -> DataFrame:
    """All per-frame CSV files of a folder in one scan, with source_file; columns that a file lacks are null, by name and not by place.

    A file's name is its clip's, or the name of its folder, as write_frame_files gives it.
    """
    raw = spark.read.schema(FRAME_ANGLES).option("header", True).option("enforceSchema", False).option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).csv(folder)
    return raw.withColumn("source_file", _named("source_file"))


def write_frame_files(rows: DataFrame, folder: str) -> None:
    """Per-frame CSV files in a folder for each clip, named by source_file, in the order of frames."""
    named = rows.select(*FRAME_ANGLES.names, "source_file").repartition("source_file").sortWithinPartitions("source_file", "frame")
    named.write.mode("overwrite").partitionBy("source_file").option("header", True).csv(folder)


def read_landmarks(spark: SparkSession, path: str) -> DataFrame:
    """A table of RAW_LANDMARKS; columns that it lacks are null."""
    return spark.read.schema(RAW_LANDMARKS).parquet(path)


def read_poses(spark: SparkSession, path: str) -> DataFrame:
    """A table of POSES, a row a pose, as a row a frame with all its poses."""
    return nest(spark.read.schema(POSES).parquet(path))


def list_videos(spark: SparkSession, folder: str, view: str | None = None) -> DataFrame:
    """Files of a view's folder: file_name, stem, view. Contents are not read. Without a view, of all folders `view=<view>` below."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    of = F.lit(view) if view else F.regexp_extract("path", "/view=([^/]+)/", 1)
    files = files.select(_named("file_name").alias("file_name"), of.alias("view"))
    return files.select("file_name", F.trim(F.regexp_replace("file_name", r"\.[^.]*$", "")).alias("stem"), "view")


def batch_id(batch: str | None) -> str:
    return batch or uuid.uuid4().hex


def write_cleaned(cleaned: DataFrame, path: str, batch: str | None = None) -> None:
    """A batch of cleaned rows, sorted by video. A video's earlier rows are replaced, other videos stay.

    Files follow the bytes: Spark cuts and joins the exchange's partitions to its advisory size, also those of one long video, so that tasks
    grow with the rows and not with a number chosen beforehand.
    """
    rows = cleaned.hint("rebalance", "video_id").sortWithinPartitions("video_id", "frame_id")
    batches.write_batch(rows, path, batch_id(batch), ["video_id"])


def read_cleaned(spark: SparkSession, path: str) -> DataFrame:
    return batches.read_latest(spark, path, ["video_id"])


def write_frames(rows: DataFrame, path: str, batch: str | None = None, clips: DataFrame | None = None, fresh: bool = False) -> bool:
    """Frame tables in a folder per view, as their source_file tells it. A clip's earlier rows are replaced; fresh replaces those of all clips.

    clips (source_file): what was processed, so that clips without any row count as done too. A batch that was written before is not written again.
    """
    return batches.write_batch(rows.withColumn("view", view_of(F.col("source_file"))), path, batch_id(batch), ["source_file"], clips, fresh, ("view",))


def read_frame_tables(spark: SparkSession, path: str) -> DataFrame:
    """What write_frames has written: of each clip the last batch's rows."""
    return batches.read_latest(spark, path, ["source_file"])


def processed_clips(spark: SparkSession, path: str) -> DataFrame:
    """(stem, view, source_file, attempts) of the clips that write_frames has processed, with or without rows."""
    found = batches.manifest(spark, path)
    if found is None:
        return spark.createDataFrame([], "stem string, view string, source_file string, attempts long")
    name = F.col("source_file")
    return found.groupBy("source_file").agg(F.count("*").alias("attempts")).select(stem_of(name).alias("stem"), view_of(name).alias("view"), "source_file", "attempts")


def append(rows: DataFrame, path: str, batch: str | None = None) -> bool:
    """Adds rows to a table as a batch; nothing is deduplicated, but a retry under the same batch adds nothing more. False if the batch was there."""
    return batches.write_batch(rows, path, batch_id(batch), ["video_id"])


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    return batches.read_rows(spark, path).drop("batch")


def latest_features(spark: SparkSession, path: str) -> DataFrame:
    """Of each video the rows of the last batch that appended some."""
    return batches.read_latest(spark, path, ["video_id"])


def write_lifts(lifts: DataFrame, path: str, csv: str | None = None) -> None:
    """The lift table as Parquet, and as one CSV file if asked: a row per lift, not per frame."""
    lifts.write.mode("overwrite").parquet(path)
    if csv:
        lifts.coalesce(1).write.mode("overwrite").option("header", True).csv(csv)


def save_model(model: PipelineModel, features: DataFrame, path: str) -> None:
    """The whole pipeline from lifts to predictions, and its features' importances."""
    model.write().overwrite().save(f"{path}/model")
    features.write.mode("overwrite").parquet(f"{path}/importances")


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/model")
