"""Summaries: clips, batches, lifts, good against bad."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import label_of
from ..schemas import FEATURES

VIDEO = r"(?i)\.(mp4|mov|avi|mkv)$"
VIEWS = ("side", "front", "angle")


def clip_summary(frames: DataFrame) -> DataFrame:
    """One row a clip: frames, mean elbows and symmetry, how often each flag is set."""
    return frames.groupBy("source_file").agg(
        F.count("*").alias("frames"), F.avg("left_elbow_angle").alias("avg_left_elbow"), F.avg("right_elbow_angle").alias("avg_right_elbow"),
        F.avg("symmetry_diff").alias("avg_symmetry"), F.sum("asymmetry_flag").alias("asymmetry_frames"), F.sum("lockout_flag").alias("lockout_frames"))


def chart_statistics(frames: DataFrame) -> DataFrame:
    """What a clip's charts show: mean angles and symmetry, and the upper end of the symmetry axis."""
    means = {f"avg_{s}_{j}": F.avg(f"{s}_{j}_angle") for j in ("elbow", "shoulder") for s in ("left", "right")}
    return frames.groupBy("source_file").agg(*[v.alias(k) for k, v in means.items()], F.avg("symmetry_diff").alias("avg_symmetry"), F.max("symmetry_diff").alias("max_symmetry"), F.greatest(F.max("symmetry_diff") + 5, F.lit(30.0)).alias("axis_top"))


def videos(inventory: DataFrame) -> DataFrame:
    """Inventory rows whose file name ends like a video."""
    return inventory.where(F.col("file_name").rlike(VIDEO))


def unprocessed(inventory: DataFrame, done: DataFrame) -> DataFrame:
    """Inventory rows (stem, view) without a result yet."""
    return inventory.join(done.select("stem", "view").distinct(), ["stem", "view"], "left_anti")


def of_view(inventory: DataFrame, view: str | None = None) -> DataFrame:
    if view is None:
        return inventory
    if view.lower() not in VIEWS:
        raise ValueError(f"view must be one of {', '.join(VIEWS)}")
    return inventory.where(F.col("view") == view.lower())


def batch_summary(inventory: DataFrame, done: DataFrame) -> DataFrame:
    """Per view: clips, how many are new and how many skipped, and the labels of the new ones."""
    marked = videos(inventory).join(done.select("stem", "view").distinct().withColumn("done", F.lit(True)), ["stem", "view"], "left")
    new = F.col("done").isNull()
    label = label_of(F.col("stem"))
    return marked.groupBy("view").agg(
        F.count("*").alias("total"), F.count_if(new).alias("processed"), F.count_if(~new).alias("skipped"),
        F.count_if(new & (label == 0)).alias("good"), F.count_if(new & (label == 1)).alias("bad"))


def master_summary(lifts: DataFrame) -> DataFrame:
    return lifts.agg(F.count("*").alias("lifts"), F.lit(len(FEATURES)).cast("long").alias("features"), F.count_if(F.col("label") == 0).alias("good"), F.count_if(F.col("label") == 1).alias("bad"), F.count_if(F.col("label").isNull()).alias("unlabeled"))


def long_features(lifts: DataFrame) -> DataFrame:
    """(lift_id, label, feature, value), a row for each feature of a lift."""
    return lifts.unpivot(["lift_id", "label"], list(FEATURES), "feature", "value")


def good_against_bad(lifts: DataFrame) -> DataFrame:
    """Per feature the means of good and bad lifts and their difference; nulls and unlabeled lifts do not count."""
    means = long_features(lifts.where("label is not null")).groupBy("feature").pivot("label", [0, 1]).agg(F.avg("value"))
    return means.select("feature", F.col("0").alias("good"), F.col("1").alias("bad"), (F.col("0") - F.col("1")).alias("difference"))
