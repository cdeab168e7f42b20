"""The registered queries with their SQL twins. Floats are rounded to six decimals in both."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import deviation_category
from ..functions.smoothing import fit_weights
from ..operators import bar_path, frames, lift_features, reports, training
from ..schemas import BAR_FEATURES, ELBOW_VIEWS, FEATURES, FRAME_ANGLES, FRONT_FEATURES, PHASES, SIDES, elbow_features
from ..params import ArmParams, BarPathParams, TrainingParams
from ..sources import fixtures, tables
from . import jobs

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(f.name), 6).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields])


# bar path

def _raw(spark, d):
    return fixtures.raw_landmarks(spark, d)


def wrist_midpoint(spark, d):
    first = fixtures.nested_poses(spark, d).select("clip", "frame_idx", "width", "height", F.lit(0).alias("pose_idx"), F.get("poses", F.lit(0)).alias("landmarks"))
    return rounded(bar_path.extract_wrists(first).drop("frame_width", "frame_height"))


def visibility_filter(spark, d):
    return bar_path.visible(_raw(spark, d)).select("video_id", "frame_id")


def _filled(spark, d):
    return bar_path.fill_gaps(bar_path.positions(bar_path.visible(_raw(spark, d))))


def interpolate_gaps(spark, d):
    return rounded(_filled(spark, d).select("video_id", "frame_id", "position", "bar_x", "bar_y"))


def savgol_smooth(spark, d):
    return rounded(bar_path.smooth(_filled(spark, d)).select("video_id", "frame_id", "bar_x", "bar_y"))


def step_displacement(spark, d):
    return rounded(bar_path.smooth(_filled(spark, d)).select("video_id", "frame_id", F.coalesce(bar_path.displacement("bar_x", "bar_y"), F.lit(0.0)).alias("step")))


def outlier_repair(spark, d):
    return rounded(bar_path.repair_jumps(bar_path.smooth(_filled(spark, d))).select("video_id", "frame_id", "step", "bar_x", "bar_y"))


def cleaned_bar_path(spark, d):
    return rounded(bar_path.clean(_raw(spark, d)).select("video_id", "frame_id", "bar_x", "bar_y", "x", "y"))


def line_deviation(spark, d):
    return rounded(bar_path.line_deviation(bar_path.clean(_raw(spark, d))).select("video_id", "frame_id", "deviation"))


def bar_path_features(spark, d):
    return rounded(bar_path.features(bar_path.clean(_raw(spark, d))))


def append_features(spark, d):
    """Two runs that append the same features."""
    path = tables.shared_folder(spark)
    for _ in range(2):
        tables.append(bar_path.features(bar_path.clean(_raw(spark, d))), path)
    return rounded(tables.read_appended(spark, path))


def retried_append(spark, d):
    """Two runs, of which the second fails after half of its rows, is retried, and is called once more after it is whole."""
    path, found = tables.shared_folder(spark), bar_path.features(bar_path.clean(_raw(spark, d)))
    tables.append(found, path, "first")
    found.where("total_path_length > 3").write.parquet(f"{path}/rows/batch=second")  # what a run that died before its commit leaves
    for _ in range(2):
        tables.append(found, path, "second")
    return rounded(tables.read_appended(spark, path))


def written_cleaned(spark, d):
    """Written twice: the second run replaces the first one's videos."""
    path = tables.shared_folder(spark)
    for _ in range(2):
        tables.write_cleaned(bar_path.clean(_raw(spark, d)).drop("position", "n"), path)
    return rounded(tables.read_cleaned(spark, path).select("video_id", "frame_id", "bar_x", "bar_y", "x", "y"))


def job_bar_paths(spark, d):
    path = tables.shared_folder(spark)
    jobs.run_bar_paths(_raw(spark, d), path)
    return rounded(tables.read_appended(spark, f"{path}/features"))


def job_rejects(spark, d):
    """The failing videos of a job, and for each whether it left features."""
    path = tables.shared_folder(spark)
    jobs.run_bar_paths(fixtures.raw_with_faults(spark, d), path)
    made = tables.read_appended(spark, f"{path}/features").select("video_id", F.lit(True).alias("has_features"))
    return spark.read.parquet(f"{path}/rejects").join(made, "video_id", "left").select("video_id", "reason", "rows", F.coalesce("has_features", F.lit(False)).alias("has_features"))


def all_clip_features(spark, d):
    """Clips without a row that passes a strict filter get zeros."""
    raw = _raw(spark, d)
    return rounded(bar_path.features_of_all(raw, bar_path.features(bar_path.clean(raw, BarPathParams(visibility=_STRICT)))))


_STRICT = 0.8
_VISIBLE = "pos AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_id) - 1 AS position, count(*) OVER (PARTITION BY video_id) AS n FROM raw WHERE left_visibility >= 0.5 AND right_visibility >= 0.5)"


def _fill_sql(name: str, source: str, keep: str) -> str:
    """CTEs that interpolate bar_x and bar_y of source by position."""
    sides = ", ".join(f"last_value(CASE WHEN {c} IS NOT NULL THEN {v} END IGNORE NULLS) OVER {w} AS {c}_{k}{w}" for c in ("bar_x", "bar_y") for k, v in (("p", "position"), ("v", c)) for w in ("f", "b"))
    line = lambda c: f"coalesce({c}, ({c}_vb - {c}_vf) / ({c}_pb - {c}_pf) * (position - {c}_pf) + {c}_vf, {c}_vf, {c}_vb) AS {c}"
    return f"""{name}_near AS (SELECT *, {sides} FROM {source}
    WINDOW f AS (PARTITION BY video_id ORDER BY position), b AS (PARTITION BY video_id ORDER BY position DESC)),
  {name} AS (SELECT {keep}, {line('bar_x')}, {line('bar_y')} FROM {name}_near)"""


_KEEP = "video_id, frame_id, frame_width, frame_height, position, n"


def _smooth_sql() -> str:
    w = fit_weights(7, 2)
    term = lambda c, j, r: f"{c} * {float(w[r][j])!r}::DOUBLE" if j == r else f"{'lead' if j > r else 'lag'}({c}, {abs(j - r)}) OVER o * {float(w[r][j])!r}::DOUBLE"
    row = lambda c, r: " + ".join(term(c, j, r) for j in range(7))
    col = lambda c: f"CASE WHEN n < 7 THEN {c} " + " ".join(f"WHEN position = {r} THEN {row(c, r)} WHEN position = n - 1 - {r} THEN {row(c, 6 - r)}" for r in range(3)) + f" ELSE {row(c, 3)} END AS {c}"
    return f"smooth AS (SELECT {_KEEP}, {col('bar_x')}, {col('bar_y')} FROM filled WINDOW o AS (PARTITION BY video_id ORDER BY position))"


_STEP = "coalesce(sqrt((bar_x - lag(bar_x) OVER o) * (bar_x - lag(bar_x) OVER o) + (bar_y - lag(bar_y) OVER o) * (bar_y - lag(bar_y) OVER o)), 0)"
_FILLED = f"WITH {fixtures.RAW_SQL}, {_VISIBLE}, {_fill_sql('filled', 'pos', _KEEP)}"
_SMOOTH = f"{_FILLED}, {_smooth_sql()}"
_REPAIRED = f"""{_SMOOTH}, stepped AS (SELECT *, {_STEP} AS step FROM smooth WINDOW o AS (PARTITION BY video_id ORDER BY position)),
  masked AS (SELECT * REPLACE (CASE WHEN step > 50 THEN NULL ELSE bar_x END AS bar_x, CASE WHEN step > 50 THEN NULL ELSE bar_y END AS bar_y) FROM stepped), {_fill_sql('repaired', 'masked', _KEEP + ', step')}"""
_CLEANED = f"{_REPAIRED}, cleaned AS (SELECT *, bar_x / frame_width AS x, bar_y / frame_height AS y FROM repaired)"
_DEVIATION = f"""{_CLEANED}, ends AS (SELECT *, first_value(x) OVER w AS sx, first_value(y) OVER w AS sy, last_value(x) OVER w AS ex, last_value(y) OVER w AS ey, lag(x) OVER w AS px, lag(y) OVER w AS py
    FROM cleaned WINDOW w AS (PARTITION BY video_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
  deviations AS (SELECT *, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS move,
    CASE WHEN abs(sx - ex) <= 1e-8 + 1e-5 * abs(ex) AND abs(sy - ey) <= 1e-8 + 1e-5 * abs(ey) THEN 0
      ELSE abs((ey - sy) * x - (ex - sx) * y + ex * sy - ey * sx) / sqrt((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy)) END AS deviation FROM ends)"""
_FEATURES = f"""{_DEVIATION}, pooled AS (SELECT video_id, var_pop(v) AS path_variance FROM (SELECT video_id, x AS v FROM cleaned UNION ALL SELECT video_id, y FROM cleaned) GROUP BY video_id),
  features AS (SELECT video_id, coalesce(sum(move), 0) AS total_path_length, sqrt((any_value(ex) - any_value(sx)) * (any_value(ex) - any_value(sx)) + (any_value(ey) - any_value(sy)) * (any_value(ey) - any_value(sy))) AS net_displacement,
    max(x) - min(x) AS x_range, max(y) - min(y) AS y_range, any_value(path_variance) AS path_variance, coalesce(avg(move), 0) AS average_step_displacement, coalesce(stddev_pop(move), 0) AS step_standard_deviation,
    max(deviation) AS max_line_deviation, avg(deviation) AS mean_line_deviation FROM deviations JOIN pooled USING (video_id) GROUP BY video_id),
  final AS (SELECT *, CASE WHEN total_path_length > 0 THEN net_displacement / total_path_length ELSE 0 END AS straightness_ratio FROM features)"""


def _round_sql(*names: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in names)


_ALL_FEATURES = f"""{_FEATURES.replace('visibility >= 0.5', f'visibility >= {_STRICT}')} SELECT c.video_id, {', '.join(f'round(coalesce({c}, 0), 6) AS {c}' for c in BAR_FEATURES)}
  FROM (SELECT DISTINCT video_id FROM raw) c LEFT JOIN final f ON c.video_id = f.video_id"""

# frames


def _nested(spark, d):
    return fixtures.nested_poses(spark, d)


def frame_sampling(spark, d):
    return frames.sample(_nested(spark, d)).select("clip", "frame_idx", "frame")


def frame_timestamp(spark, d):
    return frames.sample(_nested(spark, d), 1).select("clip", "frame", "ms")


def center_pose(spark, d):
    return frames.centre_pose(_nested(spark, d)).select("clip", "frame_idx", "pose_idx")


def joint_angles(spark, d):
    return frames.angles(frames.centre_pose(frames.sample(_nested(spark, d)))).select("clip", "frame", "left_elbow_angle", "right_elbow_angle", "left_shoulder_angle", "right_shoulder_angle")


def frame_flags(spark, d):
    return frames.frame_angles(_nested(spark, d)).select("clip", "frame", "symmetry_diff", "asymmetry_flag", "lockout_flag", "low_visibility_flag")


def job_frames(spark, d):
    return jobs.run_frames(_nested(spark, d), *fixtures.inventory(spark, d, by_clip=True)).select("clip", "view", "source_file", "frame", "symmetry_diff", "asymmetry_flag", "lockout_flag", "low_visibility_flag")


def wrist_heights(spark, d):
    return fixtures.frame_tables(spark, d).select("source_file", "frame", "left_wrist_y", "right_wrist_y", "avg_wrist_y")


def deviation_categories(spark, d):
    return fixtures.frame_tables(spark, d).select("source_file", "frame", deviation_category(F.col("symmetry_diff"), 15.0).alias("category"))


_SLOT = {11: "ls", 12: "rs", 13: "le", 14: "re", 15: "lw", 16: "rw", 23: "lh", 24: "rh"}


def _angle_sql(a: str, b: str, c: str) -> str:
    ux, uy, vx, vy = f"({a}x - {b}x)", f"({a}y - {b}y)", f"({c}x - {b}x)", f"({c}y - {b}y)"
    cosine = f"({ux} * {vx} + {uy} * {vy}) / (sqrt({ux} * {ux} + {uy} * {uy}) * sqrt({vx} * {vx} + {vy} * {vy}) + 1e-6::DOUBLE)"
    return f"round_even(degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {cosine})))) * 10, 0) / 10"


_PIXELS = ", ".join(f"max(CASE WHEN i = {i} THEN {v} * {size} END) AS {n}{v}" for i, n in _SLOT.items() for v, size in (("x", 1080), ("y", 1920)))
_ANGLES = f"""WITH {fixtures.POSES_SQL}, pixels AS (SELECT f.clip, f.frame_idx + 1 AS frame, {_PIXELS}, min(CASE WHEN i IN (13, 14, 15, 16) THEN visibility END) AS seen
    FROM flat f JOIN chosen c ON f.clip = c.clip AND f.frame_idx = c.frame_idx AND f.p = c.pose_idx WHERE f.frame_idx % 3 = 0 GROUP BY f.clip, f.frame_idx),
  angles AS (SELECT clip, frame, seen, lwy, rwy, {_angle_sql('ls', 'le', 'lw')} AS left_elbow_angle, {_angle_sql('rs', 're', 'rw')} AS right_elbow_angle, {_angle_sql('lh', 'ls', 'le')} AS left_shoulder_angle, {_angle_sql('rh', 'rs', 're')} AS right_shoulder_angle FROM pixels)"""

# lifts


def _frame_rows(spark, d):
    return fixtures.frame_tables(spark, d)


def _phased(spark, d):
    return lift_features.phases(lift_features.identify(_frame_rows(spark, d)))


def parse_lift_id(spark, d):
    return lift_features.parsed_names(_frame_rows(spark, d).select("source_file").distinct())


def phase_windows(spark, d):
    return _phased(spark, d).select("source_file", "frame", "position", F.col("n"), "phase")


def lockout_frame(spark, d):
    return lift_features.lockout_frames(_phased(spark, d))


def elbow_features_of(view, spark, d):
    return rounded(lift_features.elbow_clip_features(_phased(spark, d), view))


def front_features(spark, d):
    return rounded(lift_features.front_clip_features(_phased(spark, d)))


def label_map(spark, d):
    """Of all clips of the inventory, most of which have no frames yet."""
    clips, _ = fixtures.inventory(spark, d)
    return lift_features.label_map(clips.select(F.concat("stem", F.lit("_"), "view", F.lit(".csv")).alias("source_file")))


def frame_csv(spark, d):
    """Frame tables as CSV files named by clip, read with the explicit schema; the names come from the paths."""
    path = tables.shared_folder(spark)
    tables.write_frame_files(_frame_rows(spark, d), path)
    return tables.read_frames(spark, path).select("source_file", *FRAME_ANGLES.names)


def landmark_tables(spark, d):
    """A row a pose, written and read as frames with their poses, and as wrists: the most central pose and the bar's place."""
    path = tables.shared_folder(spark)
    nested = _nested(spark, d)
    nested.select("clip", "frame_idx", "width", "height", "fps", F.posexplode("poses").alias("pose_idx", "landmarks")).write.parquet(f"{path}/poses")
    poses = tables.read_poses(spark, f"{path}/poses")
    bar_path.extract_wrists(poses.select("*", F.lit(0).alias("pose_idx"), F.get("poses", F.lit(0)).alias("landmarks"))).write.parquet(f"{path}/landmarks")
    wrists = tables.read_landmarks(spark, f"{path}/landmarks").select(F.col("video_id").alias("clip"), F.col("frame_id").alias("frame_idx"), "bar_x", "bar_y")
    return rounded(frames.centre_pose(poses).select("clip", "frame_idx", "pose_idx").join(wrists, ["clip", "frame_idx"]))


def frames_by_view(spark, d):
    path = tables.shared_folder(spark)
    tables.write_frames(_frame_rows(spark, d), path)
    return tables.read_frame_tables(spark, path).select("view", "source_file", "frame", "symmetry_diff", "avg_wrist_y")


def rewritten_frames(spark, d):
    """Lifts of clips that are written with wrong angles, then right, and of which those of one view are written once more."""
    path, rows = tables.shared_folder(spark), _frame_rows(spark, d)
    tables.write_frames(rows.withColumn("left_elbow_angle", F.lit(1.0)), path)
    tables.write_frames(rows, path)
    tables.write_frames(rows.where(F.col("source_file").endswith("_side.csv")), path)
    return rounded(lift_features.master(tables.read_frame_tables(spark, path)))


def resumed_frames(spark, d):
    """The clips that a frame job has processed, one view first, then all, then all again: each once, those without any pose included."""
    path, poses, (clips, _) = tables.shared_folder(spark), fixtures.named_poses(spark, d), fixtures.inventory(spark, d)
    jobs.run_frame_batch(poses, clips, path, "front-first", "front")
    for name in ("all", "all-again"):
        jobs.run_frame_batch(poses, clips, path, name)
    rows = tables.read_frame_tables(spark, path).groupBy("source_file").agg(F.count("*").alias("frames"))
    return tables.processed_clips(spark, path).join(rows, "source_file", "left").select("source_file", "view", "attempts", F.coalesce("frames", F.lit(0)).cast("long").alias("frames"))


def written_lifts(spark, d):
    path = tables.shared_folder(spark)
    tables.write_lifts(lift_features.master(_frame_rows(spark, d)), path)
    return rounded(spark.read.parquet(path))


def job_lifts(spark, d):
    """Frames to lifts, models and the comparison, which is returned."""
    path = tables.shared_folder(spark)
    jobs.run_lifts(spark, _frame_rows(spark, d), path, clean=True, run="only")
    return rounded(spark.read.parquet(f"{path}/comparison/run=only"))


def job_whole(spark, d):
    """From poses and the inventory to lifts and a model, fresh."""
    path = tables.shared_folder(spark)
    jobs.run_whole(fixtures.named_poses(spark, d), fixtures.inventory(spark, d)[0], path, "first", params=TrainingParams(trees=20))
    return rounded(spark.read.parquet(f"{path}/lifts/run=first"))


def job_whole_again(spark, d):
    """A run over frame tables of other rules, then one that cleans them, then one that skips the frames: the lifts of the last one."""
    path, poses, (clips, _) = tables.shared_folder(spark), fixtures.named_poses(spark, d), fixtures.inventory(spark, d)
    jobs.run_frame_batch(poses, clips, f"{path}/frames", "other", params=ArmParams(every=1))
    jobs.run_frame_batch(poses, clips, f"{path}/frames", "cleaned", fresh=True)
    jobs.run_whole(poses, clips, path, "last", skip_frames=True, params=TrainingParams(trees=10))
    return rounded(spark.read.parquet(f"{path}/lifts/run=last"))


def master_dataset(spark, d):
    return rounded(lift_features.master(_frame_rows(spark, d)))


def master_ordered(spark, d):
    return lift_features.ordered(lift_features.master(_frame_rows(spark, d)).select("lift_id", "label"))


def clip_summary(spark, d):
    return rounded(reports.clip_summary(_frame_rows(spark, d)))


def clip_chart_stats(spark, d):
    return rounded(reports.chart_statistics(_frame_rows(spark, d)))


def batch_summary(spark, d):
    return reports.batch_summary(*fixtures.inventory(spark, d))


def video_inventory(spark, d):
    """Files of all views' folders whose names end like a video's, listed from a store that holds one for each clip."""
    path = tables.shared_folder(spark)
    clips = fixtures.inventory(spark, d)[0]
    clips.select("view", "file_name", F.lit("frames").alias("value")).repartition("view", "file_name").write.partitionBy("view", "file_name").text(path)
    return reports.videos(tables.list_videos(spark, path))


def view_to_do(spark, d):
    """The videos of one view, named in any case, that have no result yet."""
    clips, done = fixtures.inventory(spark, d)
    return jobs.clips_to_do(clips, done, "Front")


def skip_processed(spark, d):
    return reports.unprocessed(*fixtures.inventory(spark, d))


def master_summary(spark, d):
    return reports.master_summary(lift_features.master(_frame_rows(spark, d)))


def good_vs_bad(spark, d):
    return rounded(reports.good_against_bad(lift_features.master(_frame_rows(spark, d))))


def _labelled(spark, d):
    """One row a lift, written for the several passes over it that training makes."""
    path = tables.shared_folder(spark)
    tables.write_lifts(lift_features.master(_frame_rows(spark, d)), path)
    return training.prepared(spark.read.parquet(path))


def prepared_lifts(spark, d):
    """What training takes: labelled lifts alone."""
    return _labelled(spark, d).select("lift_id", "label")


def mean_impute(spark, d):
    return rounded(training.impute(_labelled(spark, d)))


def anova_f(spark, d):
    return rounded(training.anova(training.impute(_labelled(spark, d))))


def top_k_features(spark, d):
    lifts = training.impute(_labelled(spark, d))
    return rounded(training.top_features(lifts, training.anova(lifts)))


def stratified_folds(spark, d):
    return training.with_folds(_labelled(spark, d).select("lift_id", "label"))


def fold_features(spark, d):
    """What is selected for each fold from the lifts outside it."""
    lifts = _labelled(spark, d)
    n = lifts.count()
    return rounded(training.fold_features(training.with_folds(training.impute(lifts)), training.n_folds(n), training.n_selected(n)))


def out_of_fold(spark, d):
    return jobs.predictions(_labelled(spark, d), tables.shared_folder(spark), TrainingParams())


def cv_accuracy(spark, d):
    return training.accuracies(out_of_fold(spark, d))


def feature_importance(spark, d):
    model, used = training.fit_final(_labelled(spark, d), "random_forest")
    return training.importances(spark, model, used)


def score_lifts(spark, d):
    """All lifts, labelled or not, by the model that was fitted on the labelled ones, saved and loaded."""
    path = tables.shared_folder(spark)
    tables.write_lifts(lift_features.master(_frame_rows(spark, d)), f"{path}/lifts")
    lifts = spark.read.parquet(f"{path}/lifts")
    model, used = training.fit_final(lifts, "random_forest")
    tables.save_model(model, training.importances(spark, model, used), path)
    return rounded(training.score_lifts(tables.load_model(path), lifts))


#: The frames of the whole run: videos that have poses, under their names.
_WHOLE_FRAMES = f"""{_ANGLES}, {fixtures.INVENTORY_SQL}, named AS (SELECT concat(stem, '_', view, '.csv') AS source_file, user_id FROM clips WHERE user_id % 4 <> 2),
  base AS (SELECT source_file, frame, row_number() OVER (PARTITION BY clip ORDER BY frame) - 1 AS position, count(*) OVER (PARTITION BY clip) AS n,
    left_elbow_angle, right_elbow_angle, left_shoulder_angle, right_shoulder_angle, round_even(lwy * 10, 0) AS ly, round_even(rwy * 10, 0) AS ry, CAST(seen < 0.5 AS INTEGER) AS low_visibility_flag
    FROM angles JOIN named ON clip = concat('clip', user_id) WHERE user_id % 13 <> 5), {fixtures._FRAME_TAIL}"""
_FRAMES = f"WITH {fixtures.FRAMES_SQL}"
_LOCKOUT = "lock AS (SELECT source_file, arg_min(position, (avg_wrist_y, position)) AS at FROM frames GROUP BY source_file), snap AS (SELECT f.* FROM frames f JOIN lock l ON f.source_file = l.source_file AND f.position = l.at)"


def _elbow_sql(view: str) -> str:
    parts = [f"{f}(CASE WHEN phase = '{p}' THEN {s}_elbow_angle END) AS {view}_{p}_{f}_{s}_elbow" for p in PHASES for s in SIDES for f in ("avg", "max", "min")]
    parts += [f"stddev_samp({s}_elbow_angle) AS {view}_std_{s}_elbow, max({s}_elbow_angle) - min({s}_elbow_angle) AS {view}_elbow_range_{s}" for s in SIDES]
    return f"""{view}_rows AS (SELECT a.*, s.position / s.n AS {view}_lockout_frame_ratio, s.left_elbow_angle AS {view}_lockout_left_elbow, s.right_elbow_angle AS {view}_lockout_right_elbow
    FROM (SELECT source_file, lift_id, {', '.join(parts)}, avg(lockout_flag) AS {view}_lockout_ratio FROM frames WHERE view = '{view}' GROUP BY source_file, lift_id) a JOIN snap s USING (source_file))"""


_OK = "CASE WHEN low_visibility_flag = 0{more} THEN {c} END"
_FRONT = "front_rows AS (SELECT a.*, s.symmetry_diff AS front_lockout_symmetry FROM (SELECT source_file, lift_id, " + ", ".join(
    [f"avg({_OK.format(c='symmetry_diff', more=f''' AND phase = '{p}' ''')}) AS front_{p}_avg_symmetry_diff" for p in PHASES]
    + [f"avg({_OK.format(c='symmetry_diff', more='')}) AS front_overall_avg_symmetry", f"max({_OK.format(c='symmetry_diff', more='')}) AS front_overall_max_symmetry", f"avg({_OK.format(c='asymmetry_flag', more='')}) AS front_asymmetry_ratio"]
) + " FROM frames WHERE view = 'front' GROUP BY source_file, lift_id) a JOIN snap s USING (source_file))"
_MASTER_TAIL = f"""{_LOCKOUT}, {_elbow_sql('side')}, {_elbow_sql('angle')}, {_FRONT},
  joined AS (SELECT * FROM side_rows FULL JOIN angle_rows USING (lift_id) FULL JOIN front_rows USING (lift_id)),
  master AS (SELECT lift_id, {', '.join(FEATURES)}, CASE WHEN lift_id LIKE '%good' THEN 0 WHEN lift_id LIKE '%bad' THEN 1 END AS label FROM joined)"""
_MASTER = f"{_FRAMES}, {_MASTER_TAIL}"
_IMPUTED = f"{_MASTER}, known AS (SELECT * FROM master WHERE label IS NOT NULL), imputed AS (SELECT lift_id, label, {', '.join(f'coalesce({c}, avg({c}) OVER ()) AS {c}' for c in FEATURES)} FROM known)"
_LONG = f"long AS (UNPIVOT imputed ON {', '.join(FEATURES)} INTO NAME feature VALUE value)"
_ANOVA = f"""{_IMPUTED}, {_LONG}, per AS (SELECT feature, label, count(*) AS c, avg(value) AS m, var_pop(value) AS v FROM long GROUP BY ALL),
  total AS (SELECT feature, sum(c) AS n_all, count(*) AS k, sum(c * m) / sum(c) AS mean FROM per GROUP BY feature),
  anova AS (SELECT feature, sum(c * (m - mean) * (m - mean)) * (max(n_all) - max(k)) / nullif(sum(c * v) * (max(k) - 1), 0) AS f FROM per JOIN total USING (feature) GROUP BY feature)"""

QUERIES: dict[str, Query] = {
    "wrist_midpoint": wrist_midpoint, "visibility_filter": visibility_filter, "interpolate_gaps": interpolate_gaps, "savgol_smooth": savgol_smooth,
    "step_displacement": step_displacement, "outlier_repair": outlier_repair, "cleaned_bar_path": cleaned_bar_path, "line_deviation": line_deviation,
    "bar_path_features": bar_path_features, "append_features": append_features, "all_clip_features": all_clip_features,
    "frame_sampling": frame_sampling, "frame_timestamp": frame_timestamp, "center_pose": center_pose, "joint_angles": joint_angles, "frame_flags": frame_flags,
    "wrist_heights": wrist_heights, "deviation_category": deviation_categories, "parse_lift_id": parse_lift_id, "phase_windows": phase_windows, "lockout_frame": lockout_frame,
    "elbow_features_side": partial(elbow_features_of, "side"), "elbow_features_angle": partial(elbow_features_of, "angle"), "front_features": front_features,
    "label_map": label_map, "master_dataset": master_dataset, "master_ordered": master_ordered, "clip_summary": clip_summary, "clip_chart_stats": clip_chart_stats,
    "video_inventory": video_inventory, "batch_summary": batch_summary, "skip_processed": skip_processed, "master_summary": master_summary, "good_vs_bad": good_vs_bad,
    "mean_impute": mean_impute, "anova_f": anova_f, "top_k_features": top_k_features, "stratified_folds": stratified_folds,
    "cv_accuracy": cv_accuracy, "feature_importance": feature_importance,
    "written_cleaned": written_cleaned, "frame_csv": frame_csv, "frames_by_view": frames_by_view, "written_lifts": written_lifts,
    "job_bar_paths": job_bar_paths, "job_frames": job_frames, "job_lifts": job_lifts,
    "rewritten_frames": rewritten_frames, "resumed_frames": resumed_frames, "retried_append": retried_append, "job_rejects": job_rejects,
    "job_whole": job_whole, "job_whole_again": job_whole_again, "landmark_tables": landmark_tables, "prepared_lifts": prepared_lifts, "view_to_do": view_to_do, "fold_features": fold_features, "out_of_fold": out_of_fold, "score_lifts": score_lifts,
}

_WRISTS = ", ".join(f"coalesce(max(CASE WHEN i = {i} THEN {v} END), 0) AS {n}" for s, i in (("left", 15), ("right", 16)) for v, n in (("x", f"{s}_wrist_x"), ("y", f"{s}_wrist_y"), ("visibility", f"{s}_visibility")))
_MEANS = ", ".join(f"round(avg({s}_{j}_angle), 6) AS avg_{s}_{j}" for j in ("elbow", "shoulder") for s in SIDES)
ORACLE_SQL: dict[str, str] = {
    "wrist_midpoint": f"WITH {fixtures.POSES_SQL}, w AS (SELECT clip AS video_id, frame_idx AS frame_id, {_WRISTS} FROM flat WHERE p = 0 GROUP BY clip, frame_idx) SELECT *, round((left_wrist_x + right_wrist_x) / 2, 6) AS bar_x, round((left_wrist_y + right_wrist_y) / 2, 6) AS bar_y FROM w",
    "visibility_filter": f"WITH {fixtures.RAW_SQL}, {_VISIBLE} SELECT video_id, frame_id FROM pos",
    "interpolate_gaps": f"{_FILLED} SELECT video_id, frame_id, position, {_round_sql('bar_x', 'bar_y')} FROM filled",
    "savgol_smooth": f"{_SMOOTH} SELECT video_id, frame_id, {_round_sql('bar_x', 'bar_y')} FROM smooth",
    "step_displacement": f"{_SMOOTH} SELECT video_id, frame_id, round({_STEP}, 6) AS step FROM smooth WINDOW o AS (PARTITION BY video_id ORDER BY position)",
    "outlier_repair": f"{_REPAIRED} SELECT video_id, frame_id, {_round_sql('step', 'bar_x', 'bar_y')} FROM repaired",
    "cleaned_bar_path": f"{_CLEANED} SELECT video_id, frame_id, {_round_sql('bar_x', 'bar_y', 'x', 'y')} FROM cleaned",
    "line_deviation": f"{_DEVIATION} SELECT video_id, frame_id, {_round_sql('deviation')} FROM deviations",
    "bar_path_features": f"{_FEATURES} SELECT video_id, {_round_sql(*BAR_FEATURES)} FROM final",
    "append_features": f"{_FEATURES}, t AS (SELECT video_id, {_round_sql(*BAR_FEATURES)} FROM final) SELECT * FROM t UNION ALL SELECT * FROM t",
    "all_clip_features": _ALL_FEATURES,
    "frame_sampling": f"WITH {fixtures.POSES_SQL} SELECT concat('clip', user_id) AS clip, frame_idx, frame_idx + 1 AS frame FROM numbered WHERE frame_idx % 3 = 0",
    "frame_timestamp": f"WITH {fixtures.POSES_SQL} SELECT concat('clip', user_id) AS clip, frame_idx + 1 AS frame, CAST(floor(frame_idx / (CASE WHEN user_id % 4 <> 0 THEN 25.0::DOUBLE ELSE 30.0::DOUBLE END) * 1000) AS BIGINT) AS ms FROM numbered",
    "center_pose": f"WITH {fixtures.POSES_SQL} SELECT clip, frame_idx, CAST(pose_idx AS INTEGER) AS pose_idx FROM chosen",
    "joint_angles": f"{_ANGLES} SELECT * EXCLUDE (seen, lwy, rwy) FROM angles",
    "frame_flags": f"{_ANGLES}, s AS (SELECT *, round_even(abs(left_elbow_angle - right_elbow_angle) * 10, 0) / 10 AS symmetry_diff FROM angles) SELECT clip, frame, symmetry_diff, CAST(symmetry_diff > 15 AS INTEGER) AS asymmetry_flag, CAST(left_elbow_angle < 160 OR right_elbow_angle < 160 AS INTEGER) AS lockout_flag, CAST(seen < 0.5 AS INTEGER) AS low_visibility_flag FROM s",
    "wrist_heights": f"{_FRAMES} SELECT source_file, frame, left_wrist_y, right_wrist_y, avg_wrist_y FROM all_frames",
    "deviation_category": f"{_FRAMES} SELECT source_file, frame, CASE WHEN symmetry_diff > 15 THEN 'red' ELSE 'green' END AS category FROM all_frames",
    "parse_lift_id": f"{_FRAMES} SELECT DISTINCT source_file, regexp_extract(source_file, '^([0-9]+)', 1) AS number, lift_id, label, view FROM all_frames",
    "phase_windows": f"{_FRAMES} SELECT source_file, frame, position, n, phase FROM frames",
    "lockout_frame": f"{_FRAMES}, {_LOCKOUT} SELECT source_file, position, n FROM snap",
    **{f"elbow_features_{v}": f"{_FRAMES}, {_LOCKOUT}, {_elbow_sql(v)} SELECT lift_id, {_round_sql(*elbow_features(v))} FROM {v}_rows" for v in ELBOW_VIEWS},
    "front_features": f"{_FRAMES}, {_LOCKOUT}, {_FRONT} SELECT lift_id, {_round_sql(*FRONT_FEATURES)} FROM front_rows",
    "label_map": f"WITH {fixtures.INVENTORY_SQL}, named AS (SELECT concat(regexp_extract(stem, '^([0-9]+)', 1), CASE WHEN contains(stem, 'Good') THEN 'good' WHEN contains(stem, 'bad') THEN 'bad' END) AS lift_id, CASE WHEN contains(stem, 'Good') THEN 0 WHEN contains(stem, 'bad') THEN 1 END AS label FROM clips) SELECT DISTINCT lift_id, label FROM named WHERE label IS NOT NULL",
    "master_dataset": f"{_MASTER} SELECT lift_id, {_round_sql(*FEATURES)}, label FROM master",
    "master_ordered": f"{_MASTER} SELECT lift_id, label FROM master ORDER BY CAST(regexp_extract(lift_id, '^([0-9]+)', 1) AS BIGINT), lift_id",
    "clip_summary": f"{_FRAMES} SELECT source_file, count(*) AS frames, round(avg(left_elbow_angle), 6) AS avg_left_elbow, round(avg(right_elbow_angle), 6) AS avg_right_elbow, round(avg(symmetry_diff), 6) AS avg_symmetry, CAST(sum(asymmetry_flag) AS BIGINT) AS asymmetry_frames, CAST(sum(lockout_flag) AS BIGINT) AS lockout_frames FROM all_frames GROUP BY source_file",
    "clip_chart_stats": f"{_FRAMES} SELECT source_file, {_MEANS}, round(avg(symmetry_diff), 6) AS avg_symmetry, max(symmetry_diff) AS max_symmetry, round(greatest(max(symmetry_diff) + 5, 30), 6) AS axis_top FROM all_frames GROUP BY source_file",
    "video_inventory": f"WITH {fixtures.INVENTORY_SQL} SELECT file_name, stem, view FROM clips WHERE user_id % 4 <> 2",
    "batch_summary": f"WITH {fixtures.INVENTORY_SQL}, m AS (SELECT c.*, d.stem IS NOT NULL AS done FROM clips c LEFT JOIN done d ON c.stem = d.stem AND c.view = d.view WHERE user_id % 4 <> 2) SELECT view, count(*) AS total, count_if(NOT done) AS processed, count_if(done) AS skipped, count_if(NOT done AND contains(lower(stem), 'good')) AS good, count_if(NOT done AND contains(lower(stem), 'bad')) AS bad FROM m GROUP BY view",
    "skip_processed": f"WITH {fixtures.INVENTORY_SQL} SELECT file_name, stem, view FROM clips c WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.stem = c.stem AND d.view = c.view)",
    "master_summary": f"{_MASTER} SELECT count(*) AS lifts, CAST({len(FEATURES)} AS BIGINT) AS features, count_if(label = 0) AS good, count_if(label = 1) AS bad, count_if(label IS NULL) AS unlabeled FROM master",
    "good_vs_bad": f"{_MASTER}, long AS (UNPIVOT (SELECT * FROM master WHERE label IS NOT NULL) ON {', '.join(FEATURES)} INTO NAME feature VALUE value), m AS (SELECT feature, avg(CASE WHEN label = 0 THEN value END) AS good, avg(CASE WHEN label = 1 THEN value END) AS bad FROM long GROUP BY feature) SELECT feature, round(good, 6) AS good, round(bad, 6) AS bad, round(good - bad, 6) AS difference FROM m",
    "mean_impute": f"{_IMPUTED} SELECT lift_id, {_round_sql(*FEATURES)}, label FROM imputed",
    "anova_f": f"{_ANOVA} SELECT feature, round(f, 6) AS f FROM anova",
    "top_k_features": f"{_ANOVA} SELECT feature, round(f, 6) AS f FROM anova WHERE f IS NOT NULL ORDER BY anova.f DESC, feature LIMIT (SELECT greatest(3, least(8, count(*) // 2)) FROM known)",
    "stratified_folds": f"{_MASTER}, known AS (SELECT lift_id, label FROM master WHERE label IS NOT NULL) SELECT lift_id, label, CAST(CASE WHEN (SELECT count(*) FROM known) <= 20 THEN row_number() OVER (ORDER BY md5(lift_id), lift_id) - 1 ELSE (row_number() OVER (PARTITION BY label ORDER BY md5(lift_id), lift_id) - 1) % 5 END AS INTEGER) AS fold FROM known",
}
_K = "(SELECT greatest(3, least(8, count(*) // 2)) FROM known)"
_WHOLE = f"{_WHOLE_FRAMES}, {_MASTER_TAIL} SELECT lift_id, {_round_sql(*FEATURES)}, label FROM master"
ORACLE_SQL |= {
    "prepared_lifts": f"{_MASTER} SELECT lift_id, label FROM master WHERE label IS NOT NULL",
    "view_to_do": f"WITH {fixtures.INVENTORY_SQL} SELECT DISTINCT stem AS clip, view FROM clips c WHERE view = 'front' AND user_id % 4 <> 2 AND NOT EXISTS (SELECT 1 FROM done d WHERE d.stem = c.stem AND d.view = c.view)",
    "rewritten_frames": ORACLE_SQL["master_dataset"], "retried_append": ORACLE_SQL["append_features"], "job_whole": _WHOLE, "job_whole_again": _WHOLE,
    "resumed_frames": f"{_WHOLE_FRAMES}, per AS (SELECT source_file, count(*) AS frames FROM frames GROUP BY source_file) SELECT named.source_file, regexp_extract(named.source_file, '_([a-z]+)\\.csv$', 1) AS view, 1::BIGINT AS attempts, coalesce(frames, 0) AS frames FROM named LEFT JOIN per USING (source_file)",
    "job_rejects": f"""WITH {fixtures.FAULTS_SQL}, judged AS (SELECT video_id, count(*) AS rows, count_if(coalesce(frame_width, 0) <= 0) AS unsized, count_if(left_visibility >= 0.5 AND right_visibility >= 0.5) AS seen,
        count_if(left_visibility >= 0.5 AND right_visibility >= 0.5 AND bar_x IS NOT NULL) AS placed FROM faulty GROUP BY video_id)
      SELECT video_id, CASE WHEN unsized > 0 THEN 'a frame has no size' WHEN seen = 0 THEN 'no frame is visible' ELSE 'no place of the bar' END AS reason, rows, false AS has_features FROM judged WHERE unsized > 0 OR placed = 0""",
    "fold_features": f"""{_IMPUTED}, dealt AS (SELECT *, CASE WHEN (SELECT count(*) FROM known) <= 20 THEN row_number() OVER (ORDER BY md5(lift_id), lift_id) - 1 ELSE (row_number() OVER (PARTITION BY label ORDER BY md5(lift_id), lift_id) - 1) % 5 END AS fold FROM imputed),
      long AS (UNPIVOT dealt ON {', '.join(FEATURES)} INTO NAME feature VALUE value), outs AS (SELECT DISTINCT fold AS out FROM dealt),
      per AS (SELECT out, feature, label, count(*) AS c, avg(value) AS m, var_pop(value) AS v FROM long JOIN outs ON out <> fold GROUP BY ALL),
      total AS (SELECT out, feature, sum(c) AS n_all, count(*) AS k, sum(c * m) / sum(c) AS mean FROM per GROUP BY ALL),
      f AS (SELECT out AS fold, feature, sum(c * (m - mean) * (m - mean)) * (max(n_all) - max(k)) / nullif(sum(c * v) * (max(k) - 1), 0) AS f FROM per JOIN total USING (out, feature) GROUP BY ALL),
      ranked AS (SELECT CAST(fold AS INTEGER) AS fold, feature, f, row_number() OVER (PARTITION BY fold ORDER BY round(f, 9) DESC, feature) AS rank FROM f WHERE f IS NOT NULL)
      SELECT fold, feature, round(f, 6) AS f, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= {_K}""",
    "written_cleaned": ORACLE_SQL["cleaned_bar_path"],
    "job_bar_paths": ORACLE_SQL["bar_path_features"],
    "frame_csv": f"{_FRAMES} SELECT source_file, {', '.join(FRAME_ANGLES.names)} FROM all_frames",
    "landmark_tables": f"WITH {fixtures.POSES_SQL}, w AS (SELECT clip, frame_idx, {_WRISTS} FROM flat WHERE p = 0 GROUP BY clip, frame_idx) SELECT clip, frame_idx, CAST(pose_idx AS INTEGER) AS pose_idx, round((left_wrist_x + right_wrist_x) / 2, 6) AS bar_x, round((left_wrist_y + right_wrist_y) / 2, 6) AS bar_y FROM chosen JOIN w USING (clip, frame_idx)",
    "frames_by_view": f"{_FRAMES} SELECT view, source_file, frame, symmetry_diff, avg_wrist_y FROM all_frames",
    "written_lifts": ORACLE_SQL["master_dataset"],
    "job_frames": f"WITH {fixtures.INVENTORY_SQL}, flags AS ({ORACLE_SQL['frame_flags']}) SELECT clip, view, concat(clip, '_', view, '.csv') AS source_file, frame, symmetry_diff, asymmetry_flag, lockout_flag, low_visibility_flag FROM flags JOIN clips ON clip = concat('clip', user_id) WHERE user_id % 4 <> 2 AND user_id % 5 <> 0",
    "job_lifts": ORACLE_SQL["good_vs_bad"],
}
