"""Bar path: wrists to a cleaned path per video, and its geometry. One exchange by video from the filter to the features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import landmark, present
from ..functions.smoothing import smoothed
from ..params import BarPathParams
from ..schemas import BAR_FEATURES

#: Landmark slots of the wrists.
LEFT_WRIST, RIGHT_WRIST = 15, 16


def _clip() -> WindowSpec:
    return Window.partitionBy("video_id")


def _forward() -> WindowSpec:
    return _clip().orderBy("position")


def _backward() -> WindowSpec:
    """The same rows from the end: looking ahead this way costs no more than looking back."""
    return _clip().orderBy(F.col("position").desc())


def _whole() -> WindowSpec:
    return _forward().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)



def extract_wrists(poses: DataFrame) -> DataFrame:
    """First pose of each frame -> RAW_LANDMARKS: wrist places and visibilities, 0 where a frame has none, and their midpoint."""
    first = poses.where("pose_idx is null or pose_idx = 0")
    part = lambda slot, field: F.coalesce(landmark(F.col("landmarks"), slot, field), F.lit(0.0))
    wrists = first.select(
        F.col("frame_idx").alias("frame_id"),
        *[part(slot, field).alias(name.format(side)) for side, slot in (("left", LEFT_WRIST), ("right", RIGHT_WRIST)) for field, name in (("x", "{}_wrist_x"), ("y", "{}_wrist_y"), ("visibility", "{}_visibility"))],
        F.col("width").alias("frame_width"), F.col("height").alias("frame_height"), F.col("clip").alias("video_id"))
    return midpoint(wrists)


def midpoint(wrists: DataFrame) -> DataFrame:
    return wrists.withColumns({f"bar_{a}": (F.col(f"left_wrist_{a}") + F.col(f"right_wrist_{a}")) / 2 for a in "xy"})


def visible(raw: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows where both wrists are seen well enough; a missing visibility is not."""
    return raw.where((present(F.col("left_visibility")) >= least) & (present(F.col("right_visibility")) >= least))


def positions(rows: DataFrame) -> DataFrame:
    """rows with position (from 0 by frame, ties by the bar's place) and n, the rows of the video."""
    order = ["frame_id", *[c for c in ("bar_x", "bar_y") if c in rows.columns]]
    return rows.withColumns({"position": F.row_number().over(_clip().orderBy(*order)) - 1, "n": F.count("*").over(_clip())})


def interpolated(value: str) -> Column:
    """Gaps on a straight line between the neighbours by position; before the first and after the last, the nearest value."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("position").alias("p"), F.col(value).alias("v")))
    before, after = F.last(known, True).over(_forward()), F.last(known, True).over(_backward())
    slope = (after["v"] - before["v"]) / (after["p"] - before["p"])
    return F.coalesce(F.col(value), slope * (F.col("position") - before["p"]) + before["v"], before["v"], after["v"])


def fill_gaps(rows: DataFrame) -> DataFrame:
    filled = rows.withColumns({c: present(F.col(c)) for c in ("bar_x", "bar_y")})
    return filled.withColumns({c: interpolated(c) for c in ("bar_x", "bar_y")})


def smooth(rows: DataFrame, window: int = 7, degree: int = 2) -> DataFrame:
    return rows.withColumns({c: smoothed(F.col(c), F.col("position"), F.col("n"), _forward(), window, degree) for c in ("bar_x", "bar_y")})


def displacement(x: str, y: str) -> Column:
    """Distance from the row before; null on the first row."""
    dx, dy = F.col(x) - F.lag(x).over(_forward()), F.col(y) - F.lag(y).over(_forward())
    return F.sqrt(dx * dx + dy * dy)


def repair_jumps(rows: DataFrame, max_step: float = 50.0) -> DataFrame:
    """Places reached by a step of more than max_step are dropped and filled again; the step back counts too."""
    stepped = rows.withColumn("step", F.coalesce(displacement("bar_x", "bar_y"), F.lit(0.0)))
    masked = stepped.withColumns({c: F.when(~F.coalesce(F.col("step") > max_step, F.lit(False)), F.col(c)) for c in ("bar_x", "bar_y")})
    return masked.withColumns({c: interpolated(c) for c in ("bar_x", "bar_y")})


def normalise(rows: DataFrame) -> DataFrame:
    """x and y as shares of the frame; null where the frame has no size."""
    return rows.withColumns({"x": F.try_divide("bar_x", "frame_width"), "y": F.try_divide("bar_y", "frame_height")})


def clean(raw: DataFrame, params: BarPathParams = BarPathParams()) -> DataFrame:
    """RAW_LANDMARKS -> CLEANED_BAR and position, n."""
    rows = fill_gaps(positions(visible(raw, params.visibility)))
    rows = repair_jumps(smooth(rows, params.window, params.degree), params.max_step)
    return normalise(rows).drop("step")


def line_deviation(cleaned: DataFrame) -> DataFrame:
    """cleaned with deviation: the distance of each place from the line between the first and the last; 0 if those are one."""
    first, last = (f(F.struct("x", "y")).over(_whole()) for f in (F.first, F.last))
    rows = cleaned.withColumns({"s": first, "e": last})
    dx, dy = F.col("e.x") - F.col("s.x"), F.col("e.y") - F.col("s.y")
    near = lambda a: F.abs(F.col(f"s.{a}") - F.col(f"e.{a}")) <= 1e-8 + 1e-5 * F.abs(F.col(f"e.{a}"))
    cross = F.abs(dy * F.col("x") - dx * F.col("y") + F.col("e.x") * F.col("s.y") - F.col("e.y") * F.col("s.x"))
    return rows.withColumn("deviation", F.when(near("x") & near("y"), 0.0).otherwise(F.try_divide(cross, F.sqrt(dx * dx + dy * dy)))).drop("s", "e")


def features(cleaned: DataFrame) -> DataFrame:
    """One row a video with BAR_FEATURES; variances and deviations are those of a whole population."""
    rows = line_deviation(cleaned).withColumn("step", displacement("x", "y"))
    ends = {"s": F.min_by(F.struct("x", "y"), "position"), "e": F.max_by(F.struct("x", "y"), "position")}
    nx, ny = F.count("x"), F.count("y")
    # of all x and y together: within each, and between their means
    pooled = (nx * F.var_pop("x") + ny * F.var_pop("y")) / (nx + ny) + nx * ny * (F.avg("x") - F.avg("y")) ** 2 / ((nx + ny) * (nx + ny))
    out = rows.groupBy("video_id").agg(
        *[v.alias(k) for k, v in ends.items()], F.coalesce(F.sum("step"), F.lit(0.0)).alias("total_path_length"),
        (F.max("x") - F.min("x")).alias("x_range"), (F.max("y") - F.min("y")).alias("y_range"), pooled.alias("path_variance"),
        F.coalesce(F.avg("step"), F.lit(0.0)).alias("average_step_displacement"), F.coalesce(F.stddev_pop("step"), F.lit(0.0)).alias("step_standard_deviation"),
        F.max("deviation").alias("max_line_deviation"), F.avg("deviation").alias("mean_line_deviation"))
    net = F.sqrt((F.col("e.x") - F.col("s.x")) ** 2 + (F.col("e.y") - F.col("s.y")) ** 2)
    out = out.withColumn("net_displacement", net)
    out = out.withColumn("straightness_ratio", F.when(F.col("total_path_length") > 0, F.col("net_displacement") / F.col("total_path_length")).otherwise(0.0))
    return out.select("video_id", *BAR_FEATURES)


def features_of_all(clips: DataFrame, found: DataFrame) -> DataFrame:
    """A row for every clip (video_id): zeros for those of which no row was left."""
    return clips.select("video_id").distinct().join(found, "video_id", "left").fillna(0.0, list(BAR_FEATURES))
