"""Batches: commits, retries, replacement by key, fresh batches, and a whole run that goes on after a failure."""

import pytest
from pyspark.sql import functions as F

from ironlift.operators import training
from ironlift.params import TrainingParams
from ironlift.plans import jobs
from ironlift.sources import batches, fixtures, tables

D = "/root/testdata/sf0.001"
ROWS = "k string, v long"


def rows_of(df):
    return sorted(tuple(r) for r in df.select("k", "v").collect())


def test_a_retried_batch_is_one(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], ROWS)
    assert batches.manifest(spark, path) is None
    with pytest.raises(FileNotFoundError):
        batches.read_rows(spark, path)
    assert batches.write_batch(df, path, "001", ["k"]) and not batches.write_batch(df, path, "001", ["k"])
    # a run that dies while it writes rows, and one that dies while it writes the manifest
    df.limit(1).write.parquet(f"{path}/rows/batch=002")
    df.limit(1).select("k").write.parquet(f"{path}/manifest/seq=000000000002/batch=002/fresh=0")
    (tmp_path / "t/manifest/seq=000000000002/batch=002/fresh=0/_SUCCESS").unlink()
    assert rows_of(batches.read_rows(spark, path)) == rows_of(df) and [b for _, b, _ in batches.committed(spark, path)] == ["001"]
    assert batches.write_batch(df, path, "002", ["k"])
    assert rows_of(batches.read_rows(spark, path)) == sorted(2 * rows_of(df)) and {r.batch for r in batches.read_rows(spark, path).collect()} == {"001", "002"}
    with pytest.raises(ValueError):
        batches.write_batch(df, path, "a/b", ["k"])


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = spark.createDataFrame([("a", 1)], ROWS)
    batches.write_batch(df, path, "one", ["k"])
    broken = df.withColumn("v", F.raise_error("lost").cast("long"))
    for fresh in (False, True):
        with pytest.raises(Exception, match="lost"):
            batches.write_batch(broken, path, "two", ["k"], fresh=fresh)
        assert rows_of(batches.read_latest(spark, path, ["k"])) == [("a", 1)]
    batches.write_batch(df.withColumn("v", F.lit(7).cast("long")), path, "two", ["k"])
    assert rows_of(batches.read_latest(spark, path, ["k"])) == [("a", 7)]


def test_later_batches_replace_keys(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    batches.write_batch(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], ROWS), path, "x", ["k"], partition_by=("k",))
    batches.write_batch(spark.createDataFrame([("a", 9)], ROWS), path, "y", ["k"], more=spark.createDataFrame([("b", 0), ("c", 0)], ROWS), partition_by=("k",))
    want = [("a", 9), (None, 4)]
    assert sorted(rows_of_any(batches.read_latest(spark, path, ["k"]))) == sorted(map(str, want))
    assert sorted(str(r.k) for r in batches.manifest(spark, path).where("seq = 2").collect()) == ["a", "b", "c"]
    batches.compact(spark, path, "z", ["k"])
    assert len(batches.committed(spark, path)) == 1 and sorted(rows_of_any(batches.read_latest(spark, path, ["k"]))) == sorted(map(str, want))
    assert sorted(str(r.k) for r in batches.manifest(spark, path).collect()) == ["None", "a", "b", "c"]  # what gave no rows stays processed
    batches.write_batch(None, path, "none", ["k"], more=spark.createDataFrame([("a", 0)], ROWS))
    assert rows_of_any(batches.read_latest(spark, path, ["k"])) == [str((None, 4))]


def test_two_batches_of_one_number(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    for b, v in (("x", 1), ("y", 2)):
        df = spark.createDataFrame([("a", v)], ROWS)
        df.write.parquet(f"{path}/rows/batch={b}")
        df.select("k").write.parquet(f"{path}/manifest/seq=000000000001/batch={b}/fresh=0")
    assert rows_of(batches.read_latest(spark, path, ["k"])) == [("a", 2)]


def rows_of_any(df):
    return [str((r.k, r.v)) for r in df.collect()]


def test_a_second_run_processes_nothing(spark, tmp_path):
    path, poses, (clips, _) = f"file://{tmp_path}/f", fixtures.named_poses(spark, D), fixtures.inventory(spark, D)
    assert jobs.run_frame_batch(poses, clips, path, "a")
    done = tables.processed_clips(spark, path)
    without = done.join(tables.read_frame_tables(spark, path), "source_file", "left_anti").count()
    assert without > 0 and done.count() == jobs.clips_to_do(clips, spark.createDataFrame([], "stem string, view string")).count()
    assert jobs.clips_to_do(clips, done.select("stem", "view")).isEmpty()
    jobs.run_frame_batch(poses, clips, path, "b")
    assert batches.manifest(spark, path).where("batch = 'b'").isEmpty() and {r.attempts for r in tables.processed_clips(spark, path).collect()} == {1}


def test_a_whole_run_goes_on_after_a_failure(spark, tmp_path, monkeypatch):
    out, poses, (clips, _) = f"file://{tmp_path}/w", fixtures.named_poses(spark, D), fixtures.inventory(spark, D)
    params = TrainingParams(leave_one_out=3, folds=2, trees=2)
    calls = []
    whole = training.out_of_fold
    real_frames = jobs.run_frames

    def failing(*a, **b):
        calls.append("folds")
        if len(calls) == 1:
            raise RuntimeError("lost")
        return whole(*a, **b)

    monkeypatch.setattr(jobs.training, "out_of_fold", failing)
    with pytest.raises(RuntimeError):
        jobs.run_whole(poses, clips, out, "r", params=params)
    written = {p: p.stat().st_mtime_ns for p in tmp_path.glob("w/*/**/*.parquet")}
    assert any("/lifts/" in str(p) for p in written) and not any("/predictions/" in str(p) for p in written)
    monkeypatch.setattr(jobs.lift_features, "master", None)  # not called again
    scores = jobs.run_whole(poses, clips, out, "r", params=params)
    assert all(p.stat().st_mtime_ns == t for p, t in written.items()) and real_frames is jobs.run_frames
    predictions = spark.read.parquet(f"{out}/predictions/run=r")
    assert scores == {r.model: r.accuracy for r in training.accuracies(predictions).collect()} and len(calls) == 2
    model = tables.load_model(f"{out}/model/run=r")
    lifts = spark.read.parquet(f"{out}/lifts/run=r")
    assert training.score_lifts(model, lifts).count() == lifts.count()
    before = {p.stat().st_mtime_ns for p in tmp_path.glob("w/**/*.parquet")}
    assert jobs.run_whole(poses, clips, out, "r", params=params) == scores and before == {p.stat().st_mtime_ns for p in tmp_path.glob("w/**/*.parquet")}
