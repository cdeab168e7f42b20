"""Deterministic inputs of the jobs, derived from the `events` table: users are clips, events are frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.frames import symmetry, wrist_heights

def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "value")


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)


def raw_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, frame_id, visibilities, bar_x with gaps, bar_y, frame size; pixels, so that jumps occur."""
    e, u = F.col("event_id"), F.col("user_id")
    even = u % 2 == 0
    return _numbered(spark, sf_dir).select(
        F.concat(F.lit("clip"), u.cast("string")).alias("video_id"), F.col("k").cast("long").alias("frame_id"),
        (0.4 + ((e * 7) % 100) / 200.0).alias("left_visibility"), (0.4 + ((e * 13 + u) % 100) / 200.0).alias("right_visibility"),
        F.when(e % 23 != 0, 500 + F.col("value")).alias("bar_x"), (400 + (e * 37) % 60).cast("double").alias("bar_y"),
        F.when(even, 1920).otherwise(1080).alias("frame_width"), F.when(even, 1080).otherwise(1920).alias("frame_height"))


def frame_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_file and FRAME_ANGLES; the file name of every tenth clip tells no view, so that lifts miss views."""
    e, u = F.col("event_id"), F.col("user_id")
    number = F.floor(u / 3) + 1
    word = F.when(number % 11 == 0, "lift").when(number % 2 == 0, "Good").otherwise("bad")
    view = F.when(u % 3 == 0, "side").when(u % 3 == 1, "front").otherwise("angle")
    rows = _numbered(spark, sf_dir).select(
        F.concat(number.cast("string"), word, F.when(u % 7 == 0, "a").otherwise(""), F.lit("_"), F.when(u % 10 == 9, "whole").otherwise(view), F.lit(".csv")).alias("source_file"), (1 + 3 * F.col("k")).cast("long").alias("frame"),
        (((e * 37) % 1800) / 10.0).alias("left_elbow_angle"), (((e * 53 + u * 11) % 1800) / 10.0).alias("right_elbow_angle"),
        (((e * 17) % 1800) / 10.0).alias("left_shoulder_angle"), (((e * 29) % 1800) / 10.0).alias("right_shoulder_angle"),
        (((e * 41) % 19200) / 10.0).alias("left_wrist_y"), (((e * 43 + u) % 19200) / 10.0).alias("right_wrist_y"), (e % 4 == 0).cast("int").alias("low_visibility_flag"))
    return wrist_heights(symmetry(rows))


def nested_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip, frame_idx, width, height, fps, poses: one to three poses a frame, the last cut short in every fifth event."""
    e, u = F.col("event_id"), F.col("user_id")
    last = e % 3

    def pose(p):
        size = F.when((p == last) & (e % 5 == 0), 20).otherwise(33)
        return F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(
            (((e * 7 + p * 31 + i * 13) % 1000) / 1000.0).alias("x"), (((e * 11 + p * 17 + i * 19) % 1000) / 1000.0).alias("y"), (((e + p + i * 3) % 100) / 100.0).alias("visibility")))

    return _numbered(spark, sf_dir).select(
        F.concat(F.lit("clip"), u.cast("string")).alias("clip"), F.col("k").cast("long").alias("frame_idx"), F.lit(1080).alias("width"), F.lit(1920).alias("height"),
        F.when(u % 4 != 0, 25.0).otherwise(0.0).alias("fps"), F.transform(F.sequence(F.lit(0), last.cast("int")), pose).alias("poses"))


def raw_with_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw_landmarks, of which some videos fail: frames without a size, wrists never seen, no place of the bar."""
    v = F.pmod(F.substring("video_id", 5, 20).cast("long"), F.lit(17))
    rows = raw_landmarks(spark, sf_dir)
    return rows.withColumns({
        "frame_width": F.when((v != 3) | (F.col("frame_id") % 5 != 0), F.col("frame_width")),
        "left_visibility": F.when(v == 4, 0.1).otherwise(F.col("left_visibility")), "bar_x": F.when(v != 5, F.col("bar_x"))})


def named_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nested_poses under the names of inventory(): clip (its stem) and view; some clips have frames and no poses."""
    u = F.substring("clip", 5, 20).cast("long")
    number = F.floor(u / 3) + 1
    word = F.when(number % 11 == 0, "lift").when(number % 2 == 0, "Good").otherwise("bad")
    return nested_poses(spark, sf_dir).withColumns({
        "view": F.when(u % 3 == 0, "side").when(u % 3 == 1, "front").otherwise("angle"), "poses": F.when(u % 13 != 5, F.col("poses")), "clip": F.concat(number.cast("string"), word)})


def inventory(spark: SparkSession, sf_dir: str, by_clip: bool = False) -> tuple[DataFrame, DataFrame]:
    """Clips (file_name, stem, view) and those that are done (stem, view); stems are lifts' names, or the clips of nested_poses."""
    u = F.col("user_id")
    number = F.floor(u / 3) + 1
    word = F.when(number % 11 == 0, "lift").when(number % 2 == 0, "Good").otherwise("bad")
    view = F.when(u % 3 == 0, "side").when(u % 3 == 1, "front").otherwise("angle")
    stem = F.concat(F.lit("clip"), u.cast("string")) if by_clip else F.concat(number.cast("string"), word)
    end = F.when(u % 4 == 0, ".mp4").when(u % 4 == 1, ".MOV").when(u % 4 == 2, ".txt").otherwise(".mkv")
    clips = events(spark, sf_dir).select("user_id").distinct().select("user_id", F.concat(stem, end).alias("file_name"), stem.alias("stem"), view.alias("view"))
    return clips.drop("user_id"), clips.where(u % 5 == 0).select("stem", "view")


# The same inputs in SQL, for the comparisons.

RAW_SQL = """raw AS (
  SELECT concat('clip', user_id) AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_id,
    0.4::DOUBLE + ((event_id * 7) % 100) / 200.0::DOUBLE AS left_visibility, 0.4::DOUBLE + ((event_id * 13 + user_id) % 100) / 200.0::DOUBLE AS right_visibility,
    CASE WHEN event_id % 23 <> 0 THEN 500 + value END AS bar_x, CAST(400 + (event_id * 37) % 60 AS DOUBLE) AS bar_y,
    CASE WHEN user_id % 2 = 0 THEN 1920 ELSE 1080 END AS frame_width, CASE WHEN user_id % 2 = 0 THEN 1080 ELSE 1920 END AS frame_height
  FROM events)"""

_NAME_SQL = """concat(user_id // 3 + 1, CASE WHEN (user_id // 3 + 1) % 11 = 0 THEN 'lift' WHEN (user_id // 3 + 1) % 2 = 0 THEN 'Good' ELSE 'bad' END)"""
_VIEW_SQL = "CASE user_id % 3 WHEN 0 THEN 'side' WHEN 1 THEN 'front' ELSE 'angle' END"

#: From base (source_file, frame, position, n, the angles, wrist heights ly and ry in tenths, low_visibility_flag) to frames.
_FRAME_TAIL = r"""heights AS (
  SELECT *, ly / 10.0::DOUBLE AS left_wrist_y, ry / 10.0::DOUBLE AS right_wrist_y, (ly / 10.0::DOUBLE + ry / 10.0::DOUBLE) / 2 AS mean_y,
    round_even(abs(left_elbow_angle - right_elbow_angle) * 10, 0) / 10 AS symmetry_diff FROM base),
split AS (SELECT *, mean_y * 16 AS p, mean_y * 4 AS q FROM heights),
sums AS (SELECT *, p + q AS s, (p + q) - p AS b FROM split),
rests AS (SELECT *, (p - (s - b)) + (q - b) AS e, floor(s / 2) AS k FROM sums),
all_frames AS (
  SELECT * EXCLUDE (ly, ry, p, q, s, b, e, k, mean_y),
    (k + CASE WHEN (s - 2 * k - 1) + e > 0 OR ((s - 2 * k - 1) + e = 0 AND abs(k % 2) = 1) THEN 1 ELSE 0 END) / 10 AS avg_wrist_y,
    CAST(symmetry_diff > 15 AS INTEGER) AS asymmetry_flag, CAST(left_elbow_angle < 160 OR right_elbow_angle < 160 AS INTEGER) AS lockout_flag,
    CASE WHEN position < n // 3 THEN 'early' WHEN position < 2 * n // 3 THEN 'middle' ELSE 'final' END AS phase,
    nullif(regexp_extract(lower(source_file), '_(side|front|angle)\.csv$', 1), '') AS view,
    concat(regexp_extract(source_file, '^([0-9]+)', 1), CASE WHEN contains(lower(source_file), 'good') THEN 'good' WHEN contains(lower(source_file), 'bad') THEN 'bad' ELSE 'unlabeled' END) AS lift_id,
    CASE WHEN contains(lower(source_file), 'good') THEN 0 WHEN contains(lower(source_file), 'bad') THEN 1 END AS label
  FROM rests),
frames AS (SELECT * FROM all_frames WHERE view IS NOT NULL)"""

FRAMES_SQL = f"""base AS (
  SELECT concat({_NAME_SQL}, CASE WHEN user_id % 7 = 0 THEN 'a' ELSE '' END, '_', CASE WHEN user_id % 10 = 9 THEN 'whole' ELSE {_VIEW_SQL} END, '.csv') AS source_file,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS position, 1 + 3 * (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) AS frame,
    ((event_id * 37) % 1800) / 10.0::DOUBLE AS left_elbow_angle, ((event_id * 53 + user_id * 11) % 1800) / 10.0::DOUBLE AS right_elbow_angle,
    ((event_id * 17) % 1800) / 10.0::DOUBLE AS left_shoulder_angle, ((event_id * 29) % 1800) / 10.0::DOUBLE AS right_shoulder_angle,
    (event_id * 41) % 19200 AS ly, (event_id * 43 + user_id) % 19200 AS ry,
    CAST(event_id % 4 = 0 AS INTEGER) AS low_visibility_flag, count(*) OVER (PARTITION BY user_id) AS n
  FROM events),
{_FRAME_TAIL}"""

#: Poses flattened: one row for each landmark.
POSES_SQL = """numbered AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx FROM events),
flat AS (
  SELECT concat('clip', user_id) AS clip, frame_idx, CASE WHEN user_id % 4 <> 0 THEN 25.0::DOUBLE ELSE 0.0::DOUBLE END AS fps, p, i, event_id,
    ((event_id * 7 + p * 31 + i * 13) % 1000) / 1000.0::DOUBLE AS x, ((event_id * 11 + p * 17 + i * 19) % 1000) / 1000.0::DOUBLE AS y, ((event_id + p + i * 3) % 100) / 100.0::DOUBLE AS visibility
  FROM numbered, range(0, 3) AS a(p), range(0, 33) AS b(i)
  WHERE p <= event_id % 3 AND NOT (i >= 20 AND p = event_id % 3 AND event_id % 5 = 0)),
torso AS (
  SELECT clip, frame_idx, p, max(CASE WHEN i = 11 THEN x END) AS a, max(CASE WHEN i = 12 THEN x END) AS b, max(CASE WHEN i = 23 THEN x END) AS c, max(CASE WHEN i = 24 THEN x END) AS d
  FROM flat WHERE i IN (11, 12, 23, 24) GROUP BY ALL HAVING count(*) = 4),
chosen AS (
  SELECT clip, frame_idx, p AS pose_idx FROM torso
  QUALIFY row_number() OVER (PARTITION BY clip, frame_idx ORDER BY abs((a + b + c + d) / 4 - 0.5::DOUBLE), p) = 1)"""

INVENTORY_SQL = f"""clips AS (
  SELECT DISTINCT user_id, concat({_NAME_SQL}, CASE user_id % 4 WHEN 0 THEN '.mp4' WHEN 1 THEN '.MOV' WHEN 2 THEN '.txt' ELSE '.mkv' END) AS file_name, {_NAME_SQL} AS stem, {_VIEW_SQL} AS view FROM events),
done AS (SELECT DISTINCT stem, view FROM clips WHERE user_id % 5 = 0)"""

#: Videos of raw that fail as a whole.
FAULTS_SQL = f"""{RAW_SQL}, marked AS (SELECT *, CAST(substring(video_id, 5) AS BIGINT) % 17 AS v FROM raw),
faulty AS (SELECT * EXCLUDE (v) REPLACE (CASE WHEN v <> 3 OR frame_id % 5 <> 0 THEN frame_width END AS frame_width, CASE WHEN v = 4 THEN 0.1::DOUBLE ELSE left_visibility END AS left_visibility, CASE WHEN v <> 5 THEN bar_x END AS bar_x) FROM marked)"""
