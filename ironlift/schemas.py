"""Explicit schemas of the tables; nothing is inferred."""

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_D, _I, _L, _S = T.DoubleType(), T.IntegerType(), T.LongType(), T.StringType()

LANDMARK = _struct(x=_D, y=_D, visibility=_D)
#: One row per pose found in a frame; coordinates 0 to 1.
POSES = _struct(clip=_S, frame_idx=_L, pose_idx=_I, width=_I, height=_I, fps=_D, landmarks=T.ArrayType(LANDMARK))
RAW_LANDMARKS = _struct(
    frame_id=_L, left_wrist_x=_D, left_wrist_y=_D, left_visibility=_D, right_wrist_x=_D, right_wrist_y=_D, right_visibility=_D,
    bar_x=_D, bar_y=_D, frame_width=_I, frame_height=_I, video_id=_S)
CLEANED_BAR = T.StructType([*RAW_LANDMARKS.fields, T.StructField("x", _D), T.StructField("y", _D)])
BAR_FEATURES = (
    "total_path_length", "net_displacement", "straightness_ratio", "x_range", "y_range", "path_variance",
    "average_step_displacement", "step_standard_deviation", "max_line_deviation", "mean_line_deviation")
FRAME_ANGLES = _struct(
    frame=_L, left_elbow_angle=_D, right_elbow_angle=_D, left_shoulder_angle=_D, right_shoulder_angle=_D, symmetry_diff=_D,
    left_wrist_y=_D, right_wrist_y=_D, avg_wrist_y=_D, asymmetry_flag=_I, lockout_flag=_I, low_visibility_flag=_I)

PHASES, SIDES, ELBOW_VIEWS = ("early", "middle", "final"), ("left", "right"), ("side", "angle")


def elbow_features(view: str) -> list[str]:
    out = [f"{view}_{p}_{f}_{s}_elbow" for p in PHASES for s in SIDES for f in ("avg", "max", "min")]
    out += [f"{view}_{name}" for s in SIDES for name in (f"std_{s}_elbow", f"elbow_range_{s}")]
    return out + [f"{view}_{name}" for name in ("lockout_ratio", "lockout_frame_ratio", "lockout_left_elbow", "lockout_right_elbow")]


FRONT_FEATURES = [f"front_{p}_avg_symmetry_diff" for p in PHASES] + ["front_overall_avg_symmetry", "front_overall_max_symmetry", "front_asymmetry_ratio", "front_lockout_symmetry"]
#: The 59 features of a lift, in their order.
FEATURES = [*elbow_features("side"), *elbow_features("angle"), *FRONT_FEATURES]
