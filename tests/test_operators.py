"""Operators on hand-made rows: rounding, missing values, short clips, names, plans, jobs."""

import numpy as np
import pytest
from pyspark.ml.feature import UnivariateFeatureSelector, VectorAssembler
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ironlift.functions.columns import exact_tenth, label_of, lift_id_of, present, tenth, view_of
from ironlift.functions.smoothing import fit_weights
from ironlift.operators import bar_path, frames, lift_features, reports, training
from ironlift.params import TrainingParams
from ironlift.schemas import BAR_FEATURES, FEATURES, FRAME_ANGLES
from ironlift.sources import tables

RAW = "video_id string, frame_id long, left_visibility double, right_visibility double, bar_x double, bar_y double, frame_width int, frame_height int"


def path(video, xs, ys=None, seen=1.0, width=100, height=200):
    ys = ys or [float(k) for k in range(len(xs))]
    return [(video, k, seen, seen, x, y, width, height) for k, (x, y) in enumerate(zip(xs, ys))]


def test_rounding(spark):
    rows = spark.createDataFrame([(847.05,), (605.95,), (0.05,), (0.15,), (0.25,), (1234.55,), (-0.05,)], "v double")
    got = [r[0] for r in rows.select(exact_tenth(F.col("v"))).collect()]
    assert got == [round(v, 1) for v in (847.05, 605.95, 0.05, 0.15, 0.25, 1234.55, -0.05)]
    rnd = np.random.default_rng(0)
    pairs = [(float(a) / 10, float(b) / 10) for a, b in rnd.integers(0, 19200, (3000, 2))]
    got = [r[0] for r in spark.createDataFrame(pairs, "a double, b double").select(exact_tenth((F.col("a") + F.col("b")) / 2)).collect()]
    assert sorted(got) == sorted(round((a + b) / 2, 1) for a, b in pairs)
    assert spark.range(1).select(tenth(F.lit(0.25)), exact_tenth((F.lit(845.3) + F.lit(848.8)) / 2), exact_tenth((F.lit(607.2) + F.lit(604.7)) / 2)).first()[:] == (0.2, 847.0, 606.0)


def test_smoothing_leaves_quadratics_and_short_clips(spark):
    w = fit_weights(7, 2) * 42
    assert np.allclose(w[0], [32, 15, 3, -4, -6, -3, 5]) and np.allclose(w[3], [-4, 6, 12, 14, 12, 6, -4])
    quad = [0.5 * k * k - 3 * k + 2 for k in range(12)]
    short = [5.0, 1.0, 7.0, 2.0, 9.0, 3.0]
    df = spark.createDataFrame(path("q", quad) + path("s", short), RAW)
    out = bar_path.smooth(bar_path.fill_gaps(bar_path.positions(df))).orderBy("video_id", "frame_id").collect()
    assert np.allclose([r.bar_x for r in out if r.video_id == "q"], quad) and [r.bar_x for r in out if r.video_id == "s"] == short


def test_gaps_and_visibility(spark):
    nan = float("nan")
    rows = path("a", [None, 1.0, None, nan, 4.0, None]) + path("none", [None] * 8) + [("a", 9, 0.4, 1.0, 99.0, 9.0, 100, 200), ("a", 10, nan, 1.0, 99.0, 9.0, 100, 200), ("a", 11, None, 1.0, 99.0, 9.0, 100, 200), ("zero", 0, 1.0, 1.0, 1.0, 1.0, 0, 0)]
    out = bar_path.clean(spark.createDataFrame(rows, RAW)).orderBy("video_id", "frame_id").collect()
    assert [r.bar_x for r in out if r.video_id == "a"] == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]
    assert all(r.bar_x is None and r.x is None for r in out if r.video_id == "none") and [r.x for r in out if r.video_id == "zero"] == [None]


def test_jump_and_return_are_masked(spark):
    xs = [0.0, 1.0, 200.0, 3.0, 4.0, 5.0]
    out = bar_path.repair_jumps(bar_path.positions(spark.createDataFrame(path("j", xs, [0.0] * 6), RAW))).orderBy("frame_id").collect()
    assert [r.bar_x for r in out] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0][:1] + [1.0, 2.0, 3.0, 4.0, 5.0] and [r.step > 50 for r in out] == [False, False, True, True, False, False]


def test_features(spark):
    line = [float(k) for k in range(8)]
    df = spark.createDataFrame(path("line", line, line, width=1, height=1) + path("still", [2.0] * 8, [3.0] * 8, width=1, height=1) + path("one", [2.0], [3.0]), RAW)
    out = {r.video_id: r for r in bar_path.features(bar_path.clean(df)).collect()}
    assert out["line"].straightness_ratio == pytest.approx(1) and out["line"].max_line_deviation == pytest.approx(0, abs=1e-12) and out["line"].path_variance == pytest.approx(np.var(line * 2))
    assert out["still"].mean_line_deviation == 0 and out["still"].total_path_length < 1e-12 and out["one"].straightness_ratio == 0 and out["one"].total_path_length == 0 and out["one"].step_standard_deviation == 0
    clips = spark.createDataFrame([("line",), ("gone",)], "video_id string")
    every = {r.video_id: r for r in bar_path.features_of_all(clips, bar_path.features(bar_path.clean(df))).collect()}
    assert set(every) == {"line", "gone"} and all(every["gone"][c] == 0 for c in BAR_FEATURES)
    assert bar_path.features(bar_path.clean(df.limit(0))).count() == 0


def test_one_exchange_from_filter_to_features(spark):
    df = spark.createDataFrame(path("a", [1.0] * 9), RAW)
    plan = bar_path.features(bar_path.clean(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def pose(x, n=33):
    return [(x + 0.001 * i, 0.3 + 0.01 * i, 0.9) for i in range(n)]


def test_centre_pose(spark):
    schema = "clip string, frame_idx long, width int, height int, fps double, poses array<array<struct<x double, y double, visibility double>>>"
    rows = [("c", 0, 10, 10, 25.0, [pose(0.9), pose(0.48), pose(0.5, 20)]), ("c", 3, 10, 10, None, [pose(0.1), pose(0.1)]), ("c", 6, 10, 10, 0.0, []), ("c", 9, 10, 10, 0.0, None), ("c", 4, 10, 10, 25.0, [pose(0.4)])]
    df = spark.createDataFrame(rows, schema)
    got = {r.frame_idx: r.pose_idx for r in frames.centre_pose(df).collect()}
    assert got == {0: 1, 3: 0, 4: 0}
    sampled = {r.frame: r.ms for r in frames.sample(df).collect()}
    assert sampled == {1: 0, 4: 100, 7: 200, 10: 300}
    out = frames.frame_angles(df).collect()
    assert sorted(r.frame for r in out) == [1, 4] and all(0 <= r.left_elbow_angle <= 180 for r in out)
    flat = df.select("clip", "frame_idx", "width", "height", "fps", F.posexplode("poses").alias("pose_idx", "landmarks"))
    assert {r.frame_idx: r.pose_idx for r in frames.centre_pose(frames.nest(flat)).collect()} == got


def test_a_joint_without_length_is_90(spark):
    same = [(0.5, 0.5, None)] * 33
    df = spark.createDataFrame([("c", 0, 10, 10, 25.0, [same])], "clip string, frame_idx long, width int, height int, fps double, poses array<array<struct<x double, y double, visibility double>>>")
    r = frames.frame_angles(df).first()
    assert r.left_elbow_angle == 90.0 and r.low_visibility_flag == 0 and r.lockout_flag == 1


def test_names(spark):
    names = ["64Good_side.csv", "16gooda_FRONT.csv", " 9bad_angle.csv", "lift7_side.csv", "12goodbad_side.csv", "notes.csv"]
    df = spark.createDataFrame([(n,) for n in names], "source_file string")
    got = {r.source_file: (r.lift_id, r.label, r.view) for r in lift_features.parsed_names(df).collect()}
    assert got["64Good_side.csv"] == ("64good", 0, "side") and got["16gooda_FRONT.csv"] == ("16good", 0, "front") and got[" 9bad_angle.csv"] == ("9bad", 1, "angle")
    assert got["lift7_side.csv"] == ("lift7unlabeled", None, "side") and got["12goodbad_side.csv"][:2] == ("12good", 0) and got["notes.csv"][2] is None


def frame_rows(spark, clips):
    out = []
    for name, n, more in clips:
        for k in range(n):
            r = {"source_file": name, "frame": 1 + 3 * k, "left_elbow_angle": 100.0 + k, "right_elbow_angle": 90.0 + 2 * k, "left_shoulder_angle": 1.0, "right_shoulder_angle": 1.0, "symmetry_diff": float(k), "left_wrist_y": 1.0, "right_wrist_y": 1.0, "avg_wrist_y": float((k - 2) ** 2), "asymmetry_flag": k % 2, "lockout_flag": 1, "low_visibility_flag": 0}
            out.append(r | more)
    return spark.createDataFrame(out, T.StructType([*FRAME_ANGLES.fields, T.StructField("source_file", T.StringType())]) if "source_file" not in FRAME_ANGLES.fieldNames() else FRAME_ANGLES)


@pytest.mark.parametrize("n", [1, 2, 3, 6, 7, 8])
def test_phases_partition_a_clip(spark, n):
    rows = lift_features.phases(frame_rows(spark, [("1good_side.csv", n, {})])).groupBy("phase").count().collect()
    assert {r.phase: r["count"] for r in rows} == {k: v for k, v in {"early": n // 3, "middle": 2 * n // 3 - n // 3, "final": n - 2 * n // 3}.items() if v}


def test_master_rules(spark):
    df = frame_rows(spark, [("1good_side.csv", 9, {}), ("1good_front.csv", 9, {"low_visibility_flag": None}), ("2bad_front.csv", 6, {"low_visibility_flag": 1}), ("3lift_angle.csv", 1, {"avg_wrist_y": None}), ("other.csv", 3, {}), ("1good_side.csv".replace("1good", "1gooda"), 3, {})])
    out = lift_features.master(df)
    assert out.columns == ["lift_id", *FEATURES, "label"]
    rows = out.collect()
    assert sorted(r.lift_id for r in rows) == ["1good", "1good", "2bad", "3liftunlabeled".replace("3lift", "3")]
    by = {r.lift_id: r for r in rows if r.side_std_left_elbow is None or r.side_middle_avg_left_elbow == 104.0}
    assert by["1good"].side_lockout_frame_ratio == pytest.approx(2 / 9) and by["1good"].front_overall_avg_symmetry == 4.0  # no flag at all: all rows count
    assert by["2bad"].front_overall_avg_symmetry is None and by["2bad"].front_lockout_symmetry == 2.0 and by["2bad"].label == 1
    assert by["3unlabeled"].angle_lockout_frame_ratio is None and by["3unlabeled"].angle_std_left_elbow is None and by["3unlabeled"].label is None
    assert lift_features.duplicate_clips(df).collect()[0].clips == 2
    with pytest.raises(ValueError):
        lift_features.master(df.where("source_file = 'other.csv'"))


def lifts(spark, n):
    rng = np.random.default_rng(1)
    rows = [(f"{k}{'good' if k % 2 else 'bad'}", *[None if c.startswith("angle_std") else float(v + (k % 2) * (c == "side_lockout_ratio") * 50) for c, v in zip(FEATURES, rng.normal(size=len(FEATURES)))], 1 - k % 2) for k in range(n)]
    return spark.createDataFrame(rows, "lift_id string, " + ", ".join(f"{c} double" for c in FEATURES) + ", label int")


def test_training(spark, tmp_path):
    params = TrainingParams(trees=20, folds=3)
    df = lifts(spark, 24)
    assert training.top_features(df, training.anova(training.impute(df))).first().feature == "side_lockout_ratio"
    assert sorted(r.fold for r in training.with_folds(df.limit(7)).collect()) == list(range(7))
    folds = training.with_folds(df, params).groupBy("fold", "label").count().collect()
    assert len(folds) == 6 and all(r["count"] == 4 for r in folds)
    from ironlift.plans.jobs import predictions as predicted

    predictions = predicted(df, f"file://{tmp_path}/dealt", params).cache()
    assert sorted((r.model, r.lift_id) for r in predictions.collect()) == sorted((m, r.lift_id) for m in training.classifiers() for r in df.collect())
    scores = training.cross_validate(predictions, params)
    assert scores == {r.model: r.accuracy for r in training.accuracies(predictions).collect()}
    assert scores["boosted_trees"] > 0.8 and scores["random_forest"] > 0.5 and training.best_of({"a": 1.0, "b": 1.0}) == "a"
    model, used = training.fit_final(df, "boosted_trees", params)
    found = training.importances(spark, model, used).collect()
    assert used[0] == found[0].feature == "side_lockout_ratio" and len(found) == 8
    with pytest.raises(ValueError):
        training.prepared(df.where("label > 5"))


@pytest.mark.parametrize("n", [9, 24, 40])
def test_fold_features_are_those_that_a_fit_selects(spark, n):
    """Moments merged over the other folds choose what Spark's selector chooses when it is fitted anew on the lifts outside each fold."""
    params = TrainingParams(leave_one_out=10, folds=4)
    rows = training.with_folds(training.impute(lifts(spark, n)), params).cache()
    folds, k = training.n_folds(n, params), training.n_selected(n)
    got = {}
    for r in training.fold_features(rows, folds, k).collect():
        got.setdefault(r.fold, {})[r.feature] = (r.rank, r.f)
    assert len(got) == folds
    used = [c for c in FEATURES if not c.startswith("angle_std")]
    vectors = VectorAssembler(inputCols=used, outputCol="all").transform(rows)
    for fold, chosen in got.items():
        selector = UnivariateFeatureSelector(featuresCol="all", outputCol="s", labelCol="label", selectionMode="numTopFeatures").setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(k)
        assert {used[i] for i in selector.fit(vectors.where(F.col("fold") != fold)).selectedFeatures} == set(chosen)
        whole = {r.feature: r.f for r in training.anova(rows.where(F.col("fold") != fold)).collect()}
        assert sorted(r for r, _ in chosen.values()) == list(range(1, k + 1)) and all(f == pytest.approx(whole[c]) for c, (_, f) in chosen.items())


def test_a_saved_model_scores_lifts_with_missing_features(spark, tmp_path):
    df = lifts(spark, 24)
    model, used = training.fit_final(df, "random_forest", TrainingParams(trees=10))
    tables.save_model(model, training.importances(spark, model, used), f"file://{tmp_path}")
    loaded = tables.load_model(f"file://{tmp_path}")
    assert training.features_of(loaded) == used and {r.feature for r in spark.read.parquet(f"file://{tmp_path}/importances").collect()} == set(used)
    bare = df.select("lift_id", *[F.lit(None).cast("double").alias(c) if c != "side_lockout_ratio" else F.col(c) for c in FEATURES])
    for some in (df, bare, df.withColumn("label", F.lit(None).cast("int")), df.limit(0)):
        a, b = (sorted(map(tuple, training.score_lifts(m, some).collect())) for m in (model, loaded))
        assert a == b and len(a) == some.count() and all(0 <= r[2] <= 1 and r[1] == int(r[2] > 0.5) for r in a)
    means = {c: m for c, m in zip(used, df.agg(*[F.avg(c) for c in used]).first())}
    filled = bare.withColumns({c: F.lit(means[c]) for c in used if c != "side_lockout_ratio"})
    assert sorted(map(tuple, training.score_lifts(loaded, bare).collect())) == sorted(map(tuple, training.score_lifts(loaded, filled).collect()))


def test_reports(spark):
    inventory = spark.createDataFrame([("1good.MP4", "1good", "side"), ("2bad.mov", "2bad", "side"), ("3.txt", "3", "side"), ("4.mkv", "4", "front")], "file_name string, stem string, view string")
    done = spark.createDataFrame([("2bad", "side")], "stem string, view string")
    got = {r.view: tuple(r)[1:] for r in reports.batch_summary(inventory, done).collect()}
    assert got == {"side": (2, 1, 1, 1, 0), "front": (1, 1, 0, 0, 0)}
    assert reports.of_view(inventory, "SIDE").count() == 3 and reports.of_view(inventory).count() == 4
    with pytest.raises(ValueError):
        reports.of_view(inventory, "back")


def test_files(spark, tmp_path):
    from ironlift.plans.jobs import run_bar_paths

    (tmp_path / "csv").mkdir()
    head = ",".join(c for c in FRAME_ANGLES.fieldNames() if c != "source_file")
    (tmp_path / "csv" / "1good_side.csv").write_text(head + "\n1,1.5,2.5,3,4,1,5,6,NaN,0,1,0\n4,1.5,,3,4,1,5,6,7,0,1,0\n")
    (tmp_path / "csv" / "2bad_side.csv").write_text(head + "\n")
    rows = tables.read_frames(spark, f"file://{tmp_path}/csv").orderBy("frame").collect()
    assert [(r.frame, r.right_elbow_angle, r.source_file) for r in rows] == [(1, 2.5, "1good_side.csv"), (4, None, "1good_side.csv")]
    for name in ("a.mp4", "b.MOV", "c.txt"):
        (tmp_path / "csv" / name).write_text("x")
    assert sorted(r.stem for r in reports.videos(tables.list_videos(spark, f"file://{tmp_path}/csv", "side")).collect()) == ["a", "b"]
    names = ["10Good a_side.csv", "9bad+x%_front.csv"]
    tables.write_frame_files(frame_rows(spark, [(n, 3, {}) for n in names]), f"file://{tmp_path}/named")
    assert sorted((r.source_file, r.frame) for r in tables.read_frames(spark, f"file://{tmp_path}/named").collect()) == [(n, f) for n in names for f in (1, 4, 7)]
    full = spark.createDataFrame(path("v1", [1.0] * 9) + path("v2", [2.0] * 9) + path("bad", [2.0] * 9, width=0), RAW)
    out = f"file://{tmp_path}/out"
    assert run_bar_paths(full, out, batch="a") == {"videos": 3, "rejected_videos": 1, "rows": 27, "rejected_rows": 9}
    assert [tuple(r) for r in spark.read.parquet(f"{out}/rejects").collect()] == [("bad", "a frame has no size", 9)]
    again = lambda batch: run_bar_paths(full.where("video_id = 'v1'"), out, batch=batch)
    assert again("b") == again("b") == {"videos": 1, "rejected_videos": 0, "rows": 9, "rejected_rows": 0}
    assert tables.read_appended(spark, f"{out}/features").count() == 3 and tables.latest_features(spark, f"{out}/features").count() == 2
    assert tables.read_cleaned(spark, f"{out}/interim").count() == tables.read_cleaned(spark, f"{out}/processed").count() == 18
    assert spark.createDataFrame([(float("nan"),)], "v double").select(present(F.col("v"))).first()[0] is None
    assert spark.createDataFrame([("5Good",)], "s string").select(label_of(F.col("s")), lift_id_of(F.col("s")), view_of(F.col("s"))).first()[:] == (0, "5good", None)


def test_lift_job(spark, tmp_path):
    from ironlift.plans.jobs import run_frames, run_lifts

    out = f"file://{tmp_path}"
    df = frame_rows(spark, [(f"{k}{'good' if k % 2 else 'bad'}_{v}.csv", 9 + k, {}) for k in range(1, 7) for v in ("side", "front", "angle")])
    scores = run_lifts(spark, df, out, clean=True, params=TrainingParams(leave_one_out=3, folds=2, trees=2), run="a")
    assert set(scores) == {"random_forest", "boosted_trees"} and spark.read.parquet(f"{out}/comparison/run=a").count() == len(FEATURES)
    assert run_lifts(spark, None, out, skip_frames=True, params=TrainingParams(leave_one_out=3, folds=2, trees=2)) == scores
    table = lambda run: sorted(map(str, spark.read.parquet(f"{out}/lifts/run={run}").collect()))
    run_lifts(spark, df.where("source_file like '1good%'"), out, params=TrainingParams(leave_one_out=3, folds=2, trees=2), run="b")  # clips written again
    assert table("b") == table("a")
    run_lifts(spark, df.where("source_file not like '1good%'"), out, clean=True, params=TrainingParams(leave_one_out=3, folds=2, trees=2), run="c")
    assert len(table("c")) == len(table("a")) - 1
    schema = "clip string, frame_idx long, width int, height int, fps double, poses array<array<struct<x double, y double, visibility double>>>"
    nested = spark.createDataFrame([("1good", 0, 10, 10, 25.0, [pose(0.4)]), ("2bad", 0, 10, 10, 25.0, [pose(0.4)])], schema)
    inventory = spark.createDataFrame([("1good.mp4", "1good", "side"), ("2bad.mp4", "2bad", "side")], "file_name string, stem string, view string")
    done = spark.createDataFrame([("2bad", "side")], "stem string, view string")
    assert [r.source_file for r in run_frames(nested, inventory, done, "side").collect()] == ["1good_side.csv"]


def test_cleaned_rows_of_a_video_are_replaced(spark, tmp_path):
    out = f"file://{tmp_path}/cleaned"
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 1.0), ("b", 1, 2.0)], "video_id string, frame_id long, x double")
    tables.write_cleaned(rows, out)
    tables.write_cleaned(rows.where("frame_id = 1 and video_id = 'a'").withColumn("x", F.lit(9.0)), out)
    assert sorted(tuple(r) for r in tables.read_cleaned(spark, out).select("video_id", "frame_id", "x").collect()) == [("a", 1, 9.0), ("b", 1, 2.0)]


def test_tasks_of_cleaned_rows_follow_the_bytes(spark, tmp_path):
    """Ten times the rows make many times the files, of one hot video too, whatever the number of shuffle partitions."""
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "64k")
    try:
        files = {}
        for n in (10_000, 100_000):
            rows = spark.range(n).selectExpr("if(id % 3 = 0, 'hot', concat('v', id % 50)) as video_id", "id as frame_id", "rand(1) as x", "rand(2) as y")
            tables.write_cleaned(rows, f"file://{tmp_path}/{n}", "b")
            files[n] = len(list((tmp_path / str(n) / "rows" / "batch=b").glob("part-*")))
            assert tables.read_cleaned(spark, f"file://{tmp_path}/{n}").count() == n
        assert files[100_000] >= 5 * files[10_000] and files[100_000] > 12, files
    finally:
        spark.conf.unset(size)


def test_phases_do_not_depend_on_the_order_of_rows(spark):
    df = frame_rows(spark, [("1good_side.csv", 9, {})]).withColumn("frame", (F.col("frame") / 7).cast("long"))
    orders = [lift_features.phases(df.orderBy(F.xxhash64("left_elbow_angle", F.lit(k))).coalesce(1)).select("position", "phase", "left_elbow_angle").collect() for k in range(4)]
    assert all(sorted(o) == sorted(orders[0]) for o in orders)
