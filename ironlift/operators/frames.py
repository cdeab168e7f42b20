"""Per-frame arm analysis: sampled frames, the centre pose, joint angles and flags. Map-only on nested poses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import exact_tenth, flag, joint_angle, tenth, timestamp_ms
from ..params import ArmParams

#: Landmark slots.
SLOTS = {"left_shoulder": 11, "right_shoulder": 12, "left_elbow": 13, "right_elbow": 14, "left_wrist": 15, "right_wrist": 16, "left_hip": 23, "right_hip": 24}
TORSO = ("left_shoulder", "right_shoulder", "left_hip", "right_hip")


def sample(poses: DataFrame, every: int = 3) -> DataFrame:
    """Every so-manieth frame, with its number from 1 and its time in milliseconds."""
    kept = poses.where(F.pmod("frame_idx", F.lit(every)) == 0)
    return kept.withColumns({"frame": F.col("frame_idx") + 1, "ms": timestamp_ms(F.col("frame_idx"), F.col("fps"))})


def centre_distance(landmarks: Column) -> Column:
    """How far the torso's mean x is from the middle; null where a torso landmark is missing."""
    xs = [F.get(landmarks, F.lit(SLOTS[t]))["x"] for t in TORSO]
    return F.abs((xs[0] + xs[1] + xs[2] + xs[3]) / 4 - 0.5)


def centre_pose(frames: DataFrame, poses: str = "poses") -> DataFrame:
    """frames with poses (an array of landmark arrays) -> landmarks, pose_idx of the most central whole pose, the first of equals; frames without one go."""
    tagged = F.transform(poses, lambda p, i: F.struct(centre_distance(p).alias("d"), i.alias("i")))
    whole = F.filter(tagged, lambda t: t["d"].isNotNull() & ~F.isnan(t["d"]))
    # the least (distance, index) of a frame, or no row; a generator, so that it is computed once
    best = F.inline(F.filter(F.array(F.array_min(whole)), lambda t: t.isNotNull())).alias("centre_distance", "pose_idx")
    return frames.select("*", best).withColumn("landmarks", F.get(poses, F.col("pose_idx"))).drop("centre_distance", poses)


def nest(poses: DataFrame) -> DataFrame:
    """One row a pose -> one row a frame with `poses` in the order of pose_idx; a frame has a handful of poses."""
    keys = ["clip", "frame_idx", "width", "height", "fps"]
    whole = poses.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pose_idx", "landmarks"))).alias("p__"))
    return whole.select(*keys, F.transform("p__", lambda p: p["landmarks"]).alias("poses"))


def angles(frames: DataFrame) -> DataFrame:
    """frames (landmarks, width, height) with pixels, the four joint angles and the least elbow or wrist visibility."""
    at = lambda name, field: F.get("landmarks", F.lit(SLOTS[name]))[field]
    pixel = {f"{n}_{a}": at(n, a) * F.col(size) for n in SLOTS for a, size in (("x", "width"), ("y", "height"))}
    seen = F.least(*[F.coalesce(at(n, "visibility"), F.lit(1.0)) for n in ("left_elbow", "right_elbow", "left_wrist", "right_wrist")])
    rows = frames.withColumns(pixel | {"least_visibility": seen})
    joint = lambda *names: joint_angle(*[F.col(f"{n}_{a}") for n in names for a in "xy"])
    return rows.withColumns(
        {f"{s}_elbow_angle": joint(f"{s}_shoulder", f"{s}_elbow", f"{s}_wrist") for s in ("left", "right")}
        | {f"{s}_shoulder_angle": joint(f"{s}_hip", f"{s}_shoulder", f"{s}_elbow") for s in ("left", "right")})


def symmetry(rows: DataFrame, params: ArmParams = ArmParams()) -> DataFrame:
    """rows of rounded elbow angles with symmetry_diff, asymmetry_flag and lockout_flag; both limits are strict."""
    left, right = F.col("left_elbow_angle"), F.col("right_elbow_angle")
    rows = rows.withColumn("symmetry_diff", tenth(F.abs(left - right)))
    return rows.withColumns({"asymmetry_flag": flag(F.col("symmetry_diff") > params.symmetry), "lockout_flag": flag((left < params.lockout) | (right < params.lockout))})


def wrist_heights(rows: DataFrame) -> DataFrame:
    """rows with left_wrist_y and right_wrist_y rounded, and avg_wrist_y, the rounded mean of the rounded."""
    rows = rows.withColumns({c: exact_tenth(F.col(c)) for c in ("left_wrist_y", "right_wrist_y")})
    return rows.withColumn("avg_wrist_y", exact_tenth((F.col("left_wrist_y") + F.col("right_wrist_y")) / 2))


def frame_angles(nested: DataFrame, params: ArmParams = ArmParams(), by: list[str] = ["clip"]) -> DataFrame:
    """Frames with nested poses -> what names a clip, and FRAME_ANGLES."""
    rows = angles(centre_pose(sample(nested, params.every)))
    rows = wrist_heights(symmetry(rows, params))
    rows = rows.withColumn("low_visibility_flag", flag(F.col("least_visibility") < params.visibility))
    return rows.select(
        *by, "frame", *[f"{s}_{j}_angle" for j in ("elbow", "shoulder") for s in ("left", "right")], "symmetry_diff",
        "left_wrist_y", "right_wrist_y", "avg_wrist_y", "asymmetry_flag", "lockout_flag", "low_visibility_flag")

