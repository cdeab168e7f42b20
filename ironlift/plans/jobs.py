"""The jobs from end to end: bar paths, frames of a view, lifts with training, and the whole run from poses to a model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import present
from ..operators import bar_path, frames, lift_features, reports, training
from ..params import ArmParams, BarPathParams, TrainingParams
from ..sources import batches, tables


def judged(raw: DataFrame, params: BarPathParams = BarPathParams()) -> DataFrame:
    """One row a video: video_id, rows, and the reason why it fails, null where it does not; the first of several reasons.

    Videos fail as wholes: a row without a frame size; no row in which both wrists are seen well enough; no place of the bar in any such row.
    """
    sized = F.coalesce((F.col("frame_width") > 0) & (F.col("frame_height") > 0), F.lit(False))
    seen = F.coalesce((present(F.col("left_visibility")) >= params.visibility) & (present(F.col("right_visibility")) >= params.visibility), F.lit(False))
    placed = seen & present(F.col("bar_x")).isNotNull() & present(F.col("bar_y")).isNotNull()
    reason = F.when(F.count_if(~sized) > 0, "a frame has no size").when(F.count_if(seen) == 0, "no frame is visible").when(F.count_if(placed) == 0, "no place of the bar")
    return raw.groupBy("video_id").agg(F.count("*").alias("rows"), reason.alias("reason"))


def run_bar_paths(raw: DataFrame, out: str, params: BarPathParams = BarPathParams(), batch: str | None = None) -> dict[str, int]:
    """Cleans all videos but the failing ones, writes interim and processed rows, and appends features. Returns the counts of videos, of rows and of those rejected.

    Failing videos are in `rejects` with their reason, as of this run; they do not stop the others. The counts are summed over `judged`, a row a video, without
    another pass over frames (an Observation would do too, but a session that has used one can no longer send a fitted forest to its tasks, in this version of Spark).
    A run that is retried under its batch adds its features once.
    """
    spark, failed = raw.sparkSession, F.col("reason").isNotNull()
    judged(raw, params).write.mode("overwrite").parquet(f"{out}/judged")
    videos = spark.read.parquet(f"{out}/judged")
    rejects = videos.where(failed)
    rejects.select("video_id", "reason", "rows").write.mode("overwrite").parquet(f"{out}/rejects")
    counts = videos.agg(F.count("*").alias("videos"), F.count_if(failed).alias("rejected_videos"), F.sum("rows").alias("rows"), F.sum(F.when(failed, F.col("rows"))).alias("rejected_rows")).first()
    name = tables.batch_id(batch)
    cleaned = bar_path.clean(raw.join(rejects.select("video_id"), "video_id", "left_anti"), params)
    tables.write_cleaned(cleaned, f"{out}/interim", batch=name)
    kept = spark.read.schema(cleaned.schema).parquet(f"{out}/interim/rows/batch={name}")
    batches.write_batch(kept.drop("position", "n"), f"{out}/processed", name, ["video_id"])
    tables.append(bar_path.features(kept), f"{out}/features", name)
    return {k: int(v or 0) for k, v in counts.asDict().items()}


def run_frames(nested: DataFrame, inventory: DataFrame, done: DataFrame, view: str | None = None, params: ArmParams = ArmParams()) -> DataFrame:
    """Frame tables of the clips (stem of inventory = clip of nested, and its view if nested tells one) of a view that have no result yet."""
    wanted = clips_to_do(inventory, done, view)
    by = ["clip", "view"] if "view" in nested.columns else ["clip"]
    out = frames.frame_angles(nested.join(wanted.select(*by).distinct(), by, "left_semi"), params, by)
    return out.join(wanted, by).withColumn("source_file", _file(F.col("clip"), F.col("view")))


def clips_to_do(inventory: DataFrame, done: DataFrame, view: str | None = None) -> DataFrame:
    """(clip, view) of the videos of a view that have no result yet."""
    todo = reports.unprocessed(reports.of_view(reports.videos(inventory), view), done)
    return todo.select(F.col("stem").alias("clip"), "view").distinct()


def _file(clip, view):
    return F.concat(F.trim(clip), F.lit("_"), view, F.lit(".csv"))


def run_frame_batch(nested: DataFrame, inventory: DataFrame, path: str, batch: str, view: str | None = None, fresh: bool = False, params: ArmParams = ArmParams()) -> bool:
    """Writes the frame tables of all clips of the inventory that the table at path has not processed; False if the batch was there.

    What is done is what the table's own manifest tells, clips without any pose included. fresh processes all clips, and hides what was there
    once the new batch is whole.
    """
    spark = nested.sparkSession
    done = tables.processed_clips(spark, path).select("stem", "view") if not fresh else spark.createDataFrame([], "stem string, view string")
    clips = clips_to_do(inventory, done, view).select(_file(F.col("clip"), F.col("view")).alias("source_file"))
    return tables.write_frames(run_frames(nested, inventory, done, view, params).drop("clip", "view"), path, batch, clips, fresh)


def _once(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """path, written if a run before has not finished it."""
    if not batches.finished(spark, path):
        write(path)
    return path


def run_lifts(spark: SparkSession, frame_rows: DataFrame | None, out: str, clean: bool = False, skip_frames: bool = False, params: TrainingParams = TrainingParams(), run: str | None = None) -> dict[str, float]:
    """Frame tables to the lift table, the comparison of good and bad, and the best model. Returns each classifier's accuracy.

    clean hides the frame tables of clips of earlier runs, else only those of the same clips; skip_frames starts from those already written. What a run
    writes lies below its name; called again under that name it goes on after the last part that it finished.
    """
    run = tables.batch_id(run)
    if not skip_frames:
        tables.write_frames(frame_rows, f"{out}/frames", run, fresh=clean)
    return _lifts_and_model(spark, out, run, params)


def predictions(lifts: DataFrame, path: str, params: TrainingParams) -> DataFrame:
    """Out-of-fold predictions; the folds are dealt once below path."""
    dealt = _once(lifts.sparkSession, path, lambda to: training.deal(lifts, to, params))
    return training.out_of_fold(lifts.sparkSession.read.parquet(dealt), params)


def _lifts_and_model(spark: SparkSession, out: str, run: str, params: TrainingParams) -> dict[str, float]:
    lifts = spark.read.parquet(_once(spark, f"{out}/lifts/run={run}", lambda path: tables.write_lifts(lift_features.master(tables.read_frame_tables(spark, f"{out}/frames")), path)))
    _once(spark, f"{out}/comparison/run={run}", lambda path: reports.good_against_bad(lifts).write.mode("overwrite").parquet(path))
    predicted = lambda path: predictions(lifts, f"{out}/dealt/run={run}", params).write.mode("overwrite").parquet(path)
    scores = training.cross_validate(spark.read.parquet(_once(spark, f"{out}/predictions/run={run}", predicted)), params)

    def fit(path: str) -> None:
        model, used = training.fit_final(lifts, training.best_of(scores), params)
        tables.save_model(model, training.importances(spark, model, used), f"{out}/model/run={run}")  # importances are written last

    _once(spark, f"{out}/model/run={run}/importances", fit)
    return scores


def run_whole(nested: DataFrame, inventory: DataFrame, out: str, run: str, clean: bool = False, skip_frames: bool = False, arm: ArmParams = ArmParams(), params: TrainingParams = TrainingParams()) -> dict[str, float]:
    """From poses and the inventory of videos to lifts, comparison, predictions and the model, each a written table below out. Returns each classifier's accuracy.

    Only clips without a result are processed; clean processes all anew; skip_frames starts from the frame tables that are there. Called again under the
    same run, after a failure, it goes on after the last table that is whole.
    """
    if not skip_frames:
        run_frame_batch(nested, inventory, f"{out}/frames", run, fresh=clean, params=arm)
    return _lifts_and_model(nested.sparkSession, out, run, params)
