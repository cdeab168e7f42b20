"""Per-frame tables to one row per lift: phase windows, lockout moment, features per clip and view, views joined, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import label_of, lift_id_of, number_of, phase_of, present, stem_of, view_of
from ..schemas import ELBOW_VIEWS, FEATURES, FRAME_ANGLES, FRONT_FEATURES, PHASES, SIDES, elbow_features

_DOUBLES = ("left_elbow_angle", "right_elbow_angle", "symmetry_diff", "avg_wrist_y")


def identify(frames: DataFrame) -> DataFrame:
    """frames with view, lift_id and label by source_file; files of no view are left out."""
    rows = frames.withColumn("view", view_of(F.col("source_file"))).where("view is not null")
    stem = stem_of(F.col("source_file"))
    return rows.withColumns({"lift_id": lift_id_of(stem), "label": label_of(stem)})


def phases(frames: DataFrame) -> DataFrame:
    """frames with position (from 0 in its clip by frame, rows of one frame by their values), n and phase; NaN as null."""
    rows = frames.withColumns({c: present(F.col(c)) for c in _DOUBLES if c in frames.columns})
    order = ["frame", *[c for c in FRAME_ANGLES.names if c != "frame" and c in rows.columns]]
    rows = rows.withColumns({"position": F.row_number().over(Window.partitionBy("source_file").orderBy(*order)) - 1, "n": F.count("*").over(Window.partitionBy("source_file"))})
    return rows.withColumn("phase", phase_of(F.col("position"), F.col("n")))


def _lockout():
    """The first row of the least wrist height, a missing height being less than any; null where the whole clip has none."""
    snapshot = F.struct("position", "n", "left_elbow_angle", "right_elbow_angle", "symmetry_diff")
    return F.when(F.count("avg_wrist_y") > 0, F.min_by(snapshot, F.struct("avg_wrist_y", "position")))


def lockout_frames(phased: DataFrame) -> DataFrame:
    """One row a clip: source_file, position and n of its lockout."""
    out = phased.groupBy("source_file").agg(_lockout().alias("at"))
    return out.select("source_file", F.col("at.position").alias("position"), F.col("at.n").alias("n"))


#: Features of a clip without their view.
_ELBOW = tuple(c.removeprefix("side_") for c in elbow_features("side"))
_FRONT = tuple(c.removeprefix("front_") for c in FRONT_FEATURES)


def clip_features(phased: DataFrame) -> DataFrame:
    """One row a clip: source_file, lift_id, view, `elbow` (26 features) and `front` (7, over well visible rows), in one aggregate.

    Phases are cut before badly visible rows are left out. A clip without any visibility flag is visible throughout; a single missing flag is not visible.
    """
    rows = phased.withColumn("flags", F.count("low_visibility_flag").over(Window.partitionBy("source_file")))
    rows = rows.withColumn("ok", (F.col("flags") == 0) | F.coalesce(F.col("low_visibility_flag") == 0, F.lit(False)))
    angle = {s: F.col(f"{s}_elbow_angle") for s in SIDES}
    named = {}
    for p in PHASES:
        for s in SIDES:
            mine = F.when(F.col("phase") == p, angle[s])
            named |= {f"{p}_avg_{s}_elbow": F.avg(mine), f"{p}_max_{s}_elbow": F.max(mine), f"{p}_min_{s}_elbow": F.min(mine)}
        named[f"{p}_avg_symmetry_diff"] = F.avg(F.when(F.col("ok") & (F.col("phase") == p), F.col("symmetry_diff")))
    for s in SIDES:
        named |= {f"std_{s}_elbow": F.stddev_samp(angle[s]), f"elbow_range_{s}": F.max(angle[s]) - F.min(angle[s])}
    seen = F.when(F.col("ok"), F.col("symmetry_diff"))
    named |= {"lockout_ratio": F.avg("lockout_flag"), "overall_avg_symmetry": F.avg(seen), "overall_max_symmetry": F.max(seen), "asymmetry_ratio": F.avg(F.when(F.col("ok"), F.col("asymmetry_flag")))}
    out = rows.groupBy("source_file", "lift_id", "view").agg(*[v.alias(k) for k, v in named.items()], _lockout().alias("at"))
    out = out.withColumns({"lockout_frame_ratio": F.col("at.position") / F.col("at.n"), "lockout_symmetry": F.col("at.symmetry_diff")} | {f"lockout_{s}_elbow": F.col(f"at.{s}_elbow_angle") for s in SIDES})
    return out.select("source_file", "lift_id", "view", F.struct(*_ELBOW).alias("elbow"), F.struct(*_FRONT).alias("front"))


def elbow_clip_features(phased: DataFrame, view: str) -> DataFrame:
    """One row for each clip of a side or angle view: lift_id and its 26 elbow features."""
    return clip_features(phased.where(F.col("view") == view)).select("lift_id", *[F.col(f"elbow.{c}").alias(f"{view}_{c}") for c in _ELBOW])


def front_clip_features(phased: DataFrame) -> DataFrame:
    """One row for each front clip: lift_id and 7 symmetry features over well visible rows."""
    return clip_features(phased.where("view = 'front'")).select("lift_id", *[F.col(f"front.{c}").alias(f"front_{c}") for c in _FRONT])


def master(frames: DataFrame) -> DataFrame:
    """Per-frame rows with source_file -> lift_id, 59 features, label.

    Frames are aggregated once, to a row a clip; a lift's clips then meet in one exchange. Several clips of one view multiply a lift's rows, as in a
    join of the views: a lift is as many rows as its clips have combinations.
    """
    known = identify(frames)
    if known.select("view").isEmpty():
        raise ValueError("no side, front or angle rows to build lifts from")
    of_view = lambda view, part: F.collect_list(F.when(F.col("view") == view, F.col(part))).alias(view)
    lifts = clip_features(phases(known)).groupBy("lift_id").agg(*[of_view(v, "elbow") for v in ELBOW_VIEWS], of_view("front", "front"))
    for v in (*ELBOW_VIEWS, "front"):
        lifts = lifts.withColumn(v, F.explode_outer(v))
    out = lifts.select("lift_id", *[F.col(f"{v}.{c}").alias(f"{v}_{c}") for v in ELBOW_VIEWS for c in _ELBOW], *[F.col(f"front.{c}").alias(f"front_{c}") for c in _FRONT])
    return out.select("lift_id", *FEATURES, label_of(F.regexp_extract("lift_id", "(good|bad|unlabeled)$", 1)).alias("label"))


def label_map(files: DataFrame) -> DataFrame:
    """files (source_file), an inventory or frame rows -> lift_id and label of every file of a view whose name tells a label, with or without rows of its own."""
    return parsed_names(files).where("label is not null and view is not null").select("lift_id", "label").distinct()


def ordered(lifts: DataFrame) -> DataFrame:
    """By leading number, then id; ids without a number come last."""
    number = F.regexp_extract("lift_id", r"^([0-9]+)", 1).try_cast("long")
    return lifts.orderBy(number.asc_nulls_last(), "lift_id")


def parsed_names(files: DataFrame) -> DataFrame:
    """files (source_file) with number, lift_id, label and view."""
    stem = stem_of(F.col("source_file"))
    return files.withColumns({"number": number_of(stem), "lift_id": lift_id_of(stem), "label": label_of(stem), "view": view_of(F.col("source_file"))})


def duplicate_clips(frames: DataFrame) -> DataFrame:
    """Lifts that have several clips of one view, which multiply their rows in master()."""
    return identify(frames).groupBy("lift_id", "view").agg(F.countDistinct("source_file").alias("clips")).where("clips > 1")
