"""Training on the lift table: imputation, F-test, feature selection inside folds, tree classifiers, predictions."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..params import TrainingParams
from ..schemas import FEATURES


def prepared(lifts: DataFrame) -> DataFrame:
    """Labelled lifts; none is an error."""
    rows = lifts.where("label is not null")
    if rows.isEmpty():
        raise ValueError("no labelled lifts to train on")
    return rows


def impute(lifts: DataFrame) -> DataFrame:
    """Missing features become their column's mean over all rows; a column without any value stays null."""
    means = lifts.agg(*[F.avg(c).alias(c) for c in FEATURES]).first()
    return lifts.withColumns({c: F.coalesce(F.col(c), F.lit(means[c]).cast("double")) for c in FEATURES})


def moments(lifts: DataFrame, *by: str) -> DataFrame:
    """(feature, *by, n, mean, m2): counts, means and sums of squared deviations of each feature's known values, by partial sums."""
    long = lifts.select(*by, *FEATURES).unpivot(list(by), list(FEATURES), "feature", "value").where("value is not null")
    return long.groupBy("feature", *by).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("value")).alias("m2"))


def merged(cells: Column) -> Column:
    """One (n, mean, m2) of an array of them."""
    total = lambda of: F.aggregate(cells, F.lit(0.0), lambda acc, c: acc + of(c))
    n = total(lambda c: c["n"])
    mean = F.try_divide(total(lambda c: c["n"] * c["mean"]), n)
    return F.struct(n.alias("n"), mean.alias("mean"), total(lambda c: c["m2"] + c["n"] * (c["mean"] - mean) * (c["mean"] - mean)).alias("m2"))


def f_value(groups: Column) -> Column:
    """Between-label over within-label mean squares, from an array with one (n, mean, m2) for each label; null where a divisor is 0."""
    total = lambda of: F.aggregate(groups, F.lit(0.0), lambda acc, c: acc + of(c))
    n, k = total(lambda c: c["n"]), F.size(groups)
    mean = F.try_divide(total(lambda c: c["n"] * c["mean"]), n)
    return F.try_divide(total(lambda c: c["n"] * (c["mean"] - mean) * (c["mean"] - mean)) * (n - k), total(lambda c: c["m2"]) * (k - 1))


def anova(lifts: DataFrame) -> DataFrame:
    """(feature, f): between-label over within-label mean squares, from one aggregate per feature and label."""
    cells = moments(lifts.where("label is not null"), "label")
    # a list as long as there are labels
    return cells.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("label", "n", "mean", "m2"))).alias("g")).select("feature", f_value(F.col("g")).alias("f"))


def fold_features(lifts: DataFrame, folds: int, k: int) -> DataFrame:
    """lifts with fold (0 to folds - 1) -> (fold, feature, f, rank): the k features of largest F over the lifts outside each fold.

    One pass over the lifts gives the moments by feature, label and fold; those of the lifts outside a fold are merged from the other folds',
    so nothing is fitted again. F counts to nine decimals, equal ones go by name.
    """
    cells = moments(lifts.where("label is not null"), "label", "fold")
    outside = cells.withColumn("out", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where("out <> fold")
    cell = F.sort_array(F.collect_list(F.struct("fold", "n", "mean", "m2")))  # as long as there are folds
    labels = outside.groupBy("out", "feature", "label").agg(merged(cell).alias("m")).select("out", "feature", "label", "m.*")
    f = labels.groupBy("out", "feature").agg(F.array_sort(F.collect_list(F.struct("label", "n", "mean", "m2"))).alias("g")).select(F.col("out").alias("fold"), "feature", f_value(F.col("g")).alias("f"))
    rank = F.row_number().over(Window.partitionBy("fold").orderBy(F.round("f", 9).desc(), "feature"))
    return f.where("f is not null").withColumn("rank", rank).where(F.col("rank") <= k)


def n_selected(lifts: int, features: int = len(FEATURES)) -> int:
    return min(max(3, min(8, lifts // 2)), features)


def top_features(lifts: DataFrame, f_values: DataFrame) -> DataFrame:
    """The features of largest F, so many as the number of lifts allows."""
    return f_values.where("f is not null").orderBy(F.desc("f"), "feature").limit(n_selected(lifts.count()))


def with_folds(lifts: DataFrame, params: TrainingParams = TrainingParams()) -> DataFrame:
    """lifts with fold: few lifts are a fold each, more are dealt to folds in turn within each label, in the order of their ids' hashes.

    A label's lifts are ranked within slices of the hash, and counts of the slices before are added, so that no task holds a whole label.
    """
    n = lifts.count()
    order = [F.md5("lift_id"), "lift_id"]
    if n <= params.leave_one_out:
        return lifts.withColumn("fold", (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)) - 1).cast("int"))
    sliced = lifts.withColumn("slice__", F.coalesce(F.substring(F.md5("lift_id"), 1, 3), F.lit("")))
    earlier = F.sum("k__").over(Window.partitionBy("label").orderBy("slice__").rowsBetween(Window.unboundedPreceding, -1))
    before = sliced.groupBy("label", "slice__").agg(F.count("*").alias("k__")).withColumn("before__", F.coalesce(earlier, F.lit(0))).drop("k__")
    rank = F.row_number().over(Window.partitionBy("label", "slice__").orderBy(*order)) - 1
    return sliced.withColumn("rank__", rank).join(before, ["label", "slice__"]).withColumn("fold", F.pmod(F.col("rank__") + F.col("before__"), F.lit(params.folds)).cast("int")).select(*lifts.columns, "fold")


def classifiers(params: TrainingParams = TrainingParams()) -> dict:
    return {
        "random_forest": RandomForestClassifier(featuresCol="selected", labelCol="label", numTrees=params.trees, maxDepth=params.forest_depth, seed=params.seed),
        "boosted_trees": GBTClassifier(featuresCol="selected", labelCol="label", maxDepth=params.boosted_depth, maxIter=params.trees, seed=params.seed)}


def pipeline(classifier, features: list[str], known: bool = False) -> Pipeline:
    """From lifts to predictions: means for what is missing (unless all is known), one vector of the features, the classifier. Saved and loaded as a whole."""
    if known:
        return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="selected"), classifier])
    filled = [f"{c}__known" for c in features]
    return Pipeline(stages=[Imputer(strategy="mean", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="selected"), classifier])


def n_folds(lifts: int, params: TrainingParams = TrainingParams()) -> int:
    return lifts if lifts <= params.leave_one_out else params.folds


def deal(lifts: DataFrame, path: str, params: TrainingParams = TrainingParams()) -> None:
    """Writes the labelled lifts with the features filled and their fold, in a folder for each fold."""
    rows = with_folds(impute(prepared(lifts)), params).withColumn("label", F.col("label").cast("double"))
    rows.hint("rebalance", "fold").write.mode("overwrite").partitionBy("fold").parquet(path)


def out_of_fold(dealt: DataFrame, params: TrainingParams = TrainingParams()) -> DataFrame:
    """(lift_id, label, fold, model, predicted) from what deal() has written: each lift once a classifier, predicted by the model that was fitted without its fold.

    Missing features have the mean of all labelled lifts; features are selected anew for each fold, from moments of the lifts outside it.
    """
    n = dealt.count()
    chosen: dict[int, list[str]] = {}
    for r in fold_features(dealt, n_folds(n, params), n_selected(n)).orderBy("fold", "rank").collect():  # folds times the features selected
        chosen.setdefault(r["fold"], []).append(r["feature"])

    def predictions(job: tuple[str, int]) -> DataFrame:
        name, fold = job
        model = pipeline(classifiers(params)[name], chosen[fold], True).fit(dealt.where(F.col("fold") != fold))
        return model.transform(dealt.where(F.col("fold") == fold)).select("lift_id", F.col("label").cast("int").alias("label"), "fold", F.lit(name).alias("model"), F.col("prediction").cast("int").alias("predicted"))

    with ThreadPool(params.parallel) as pool:  # small fits, side by side
        parts = pool.map(predictions, [(name, fold) for name in classifiers(params) for fold in sorted(chosen)])
    return reduce(DataFrame.unionByName, parts)


def accuracies(predictions: DataFrame) -> DataFrame:
    """(model, accuracy): the mean over folds of the share of right predictions."""
    of_fold = predictions.groupBy("model", "fold").agg(F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("accuracy"))
    return of_fold.groupBy("model").agg(F.avg("accuracy").alias("accuracy"))


def cross_validate(predictions: DataFrame, params: TrainingParams = TrainingParams()) -> dict[str, float]:
    """Mean accuracy over the folds for each classifier, in the classifiers' order."""
    found = {r["model"]: r["accuracy"] for r in accuracies(predictions).collect()}
    return {name: found[name] for name in classifiers(params)}


def best_of(scores: dict[str, float]) -> str:
    """The classifier of the highest accuracy, the first named of equals."""
    return max(scores, key=scores.get)


def fit_final(lifts: DataFrame, name: str, params: TrainingParams = TrainingParams()) -> tuple[PipelineModel, list[str]]:
    """The named classifier on all labelled lifts, and the features it uses, those of largest F first."""
    rows = prepared(lifts)
    filled = impute(rows)
    used = [r["feature"] for r in top_features(filled, anova(filled)).collect()]
    model = pipeline(classifiers(params)[name], used).fit(rows.withColumn("label", F.col("label").cast("double")))
    return model, used


def features_of(model: PipelineModel) -> list[str]:
    """The features that a fitted pipeline reads, in its order."""
    return model.stages[0].getInputCols()


def score_lifts(model: PipelineModel, lifts: DataFrame) -> DataFrame:
    """(lift_id, predicted, bad): predictions for lifts with or without labels and with any features missing; bad is the probability of label 1."""
    out = model.transform(lifts.select("lift_id", *features_of(model)))
    return out.select("lift_id", F.col("prediction").cast("int").alias("predicted"), vector_to_array("probability")[1].alias("bad"))


def importances(spark: SparkSession, model: PipelineModel, features: list[str]) -> DataFrame:
    """(feature, importance), the most important first."""
    weights = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, weights)), "feature string, importance double").orderBy(F.desc("importance"), "feature")
