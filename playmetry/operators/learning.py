"""Model fitting on feature tables with the built-in distributed learners."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import (
    BinaryClassificationEvaluator,
    ClusteringEvaluator,
    MulticlassClassificationEvaluator,
    RegressionEvaluator,
)
from pyspark.ml.feature import (
    IDF,
    PCA,
    HashingTF,
    StandardScaler,
    StringIndexer,
    Tokenizer,
    VectorAssembler,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playmetry.scale import null_safe_join, ordered_positions

SKILL_LABELS = ["Expert", "Advanced", "Intermediate", "Casual", "Beginner"]


def stratified_split(df: DataFrame, label: str, key: str, test_percent: int = 20) -> tuple[DataFrame, DataFrame]:
    """Train and test rows; each class gives exactly round(n * test_percent / 100) rows to the test.

    Which ones follows from a hash of key and label, so every run and retry splits alike. Rows
    are numbered per class and hash bucket, and only bucket counts are summed per class.
    """
    draw = F.xxhash64(F.col(key).cast("string"), F.col(label).cast("string"))
    placed = ordered_positions(df, [label], F.shiftright(draw, 54), [draw, F.col(key)], "__place")
    quota = df.groupBy(label).agg(F.round(F.count(F.lit(1)) * test_percent / 100).cast("long").alias("__quota"))
    sided = null_safe_join(placed, quota, [label])
    parts = (F.col("__place") > F.col("__quota"), F.col("__place") <= F.col("__quota"))
    return tuple(sided.where(p).drop("__place", "__quota") for p in parts)


def _quality(predictions: DataFrame, label: str, names: dict[str, str]) -> dict[str, float]:
    def measure(metric: str) -> float:
        return MulticlassClassificationEvaluator(
            labelCol=label, predictionCol="prediction", metricName=metric
        ).evaluate(predictions)

    return {name: measure(metric) for name, metric in names.items()}


def _macro_f1(predictions: DataFrame, label: str) -> float:
    """Plain mean of the F1 of each class, from the counts of (label, prediction)."""
    from playmetry.operators.experiments import classification_report

    return (
        classification_report(predictions, label, "prediction").where(F.col("class") == "macro").first()["f1"]
    )


def fit_difficulty_classifier(
    df: DataFrame,
    features: list[str],
    label: str = "difficulty",
    key: str = "puzzle_id",
    trees: tuple[int, ...] = (40,),
    depths: tuple[int, ...] = (6, 10),
    folds: int = 5,
):
    """Random forest chosen by cross-validation; accuracy, macro F1 and importances on the test part."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)  # folds and grid points read it again
    train, test = stratified_split(kept, label, key)
    indexer = StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc")
    assembler = VectorAssembler(inputCols=features, outputCol="vector")
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", seed=42)
    grid = ParamGridBuilder().addGrid(forest.numTrees, list(trees)).addGrid(forest.maxDepth, list(depths))
    search = CrossValidator(
        estimator=forest,
        estimatorParamMaps=grid.build(),
        evaluator=MulticlassClassificationEvaluator(labelCol="label", metricName="f1"),
        numFolds=folds,
        seed=42,
        parallelism=2,
    )
    model = Pipeline(stages=[indexer, assembler, search]).fit(train)
    predicted = model.transform(test)
    best = model.stages[-1]
    metrics = {
        "cv_f1": max(best.avgMetrics),
        **_quality(predicted, "label", {"test_accuracy": "accuracy"}),
        "test_f1_macro": _macro_f1(predicted, "label"),
        "feature_importances": dict(zip(features, best.bestModel.featureImportances.toArray().tolist())),
    }
    kept.unpersist()
    return model, metrics


def fit_churn_model(
    df: DataFrame,
    features: list[str],
    label: str = "churned",
    key: str = "user_id",
    penalties: tuple[float, ...] = (0.01, 0.1),
    mixes: tuple[float, ...] = (0.0, 1.0),
    folds: int = 3,
):
    """Standardised logistic regression over L2 (mix 0) and L1 (mix 1); AUC, F1, coefficients."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)  # folds and grid points read it again
    train, test = stratified_split(kept, label, key)
    regression = LogisticRegression(featuresCol="scaled", labelCol=label)
    grid = (
        ParamGridBuilder()
        .addGrid(regression.regParam, list(penalties))
        .addGrid(regression.elasticNetParam, list(mixes))
        .build()
    )
    area = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC")
    search = CrossValidator(
        estimator=regression, estimatorParamMaps=grid, evaluator=area, numFolds=folds, seed=42, parallelism=2
    )
    model = Pipeline(
        stages=[
            VectorAssembler(inputCols=features, outputCol="vector"),
            StandardScaler(inputCol="vector", outputCol="scaled", withMean=True),
            search,
        ]
    ).fit(train)
    predicted = model.transform(test)
    f1 = MulticlassClassificationEvaluator(
        labelCol=label, predictionCol="prediction", metricName="fMeasureByLabel", metricLabel=1.0
    )
    metrics = {
        "cv_auc": max(model.stages[-1].avgMetrics),
        "test_auc_roc": area.evaluate(predicted),
        "test_f1": f1.evaluate(predicted),
        "coefficients": dict(zip(features, model.stages[-1].bestModel.coefficients.toArray().tolist())),
    }
    kept.unpersist()
    return model, metrics


def fit_skill_clusters(
    df: DataFrame, features: list[str], k: int = 5, ks: range = range(2, 11), easy: str = "avg_solve_time_easy"
):
    """Standardised k-means; inertia and silhouette for each k; clusters named by the order
    of their mean easy solve time, fastest first."""
    prepared = Pipeline(
        stages=[
            VectorAssembler(inputCols=features, outputCol="vector"),
            StandardScaler(inputCol="vector", outputCol="scaled", withMean=True),
        ]
    ).fit(df)
    scaled = prepared.transform(df).persist(StorageLevel.MEMORY_AND_DISK)  # every k reads it again
    silhouette = ClusteringEvaluator(featuresCol="scaled", metricName="silhouette")

    def fit(n: int):
        return KMeans(k=n, featuresCol="scaled", seed=42).fit(scaled)

    inertia, scores = {}, {}
    for n in ks:
        candidate = fit(n)
        inertia[n] = candidate.summary.trainingCost
        scores[n] = silhouette.evaluate(candidate.transform(scaled))
    model = fit(k)
    place = features.index(easy)
    by_speed = sorted(range(k), key=lambda c: (model.clusterCenters()[c][place], c))
    names = SKILL_LABELS if k == len(SKILL_LABELS) else [f"Cluster {i}" for i in range(k)]
    label_map = {cluster: names[rank] for rank, cluster in enumerate(by_speed)}
    metrics = {
        "k": k,
        "silhouette_score": silhouette.evaluate(model.transform(scaled)),
        "inertia": model.summary.trainingCost,
        "elbow_inertias": inertia,
        "silhouette_scores": scores,
    }
    scaled.unpersist()
    return (prepared, model), label_map, metrics


def centroid_distances(scaled: DataFrame, centers: list, vector: str = "scaled") -> DataFrame:
    """Distance of each row to every centroid, in centroid order (feeds the confidence rule)."""
    x = vector_to_array(vector)

    def distance(center) -> Column:
        c = F.array(*[F.lit(float(v)) for v in center])
        return F.sqrt(
            F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
        )

    return scaled.withColumn("distances", F.array(*[distance(c) for c in centers]))


def fit_difficulty_regressor(
    df: DataFrame, features: list[str], label: str = "target", key: str = "user_id", rounds: int = 30
):
    """Gradient-boosted trees; RMSE, MAE and R2 on the test part."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)  # folds and grid points read it again
    # A number has no classes: all rows are one.
    train, test = stratified_split(kept.withColumn("__all", F.lit(1)), "__all", key)
    model = Pipeline(
        stages=[
            VectorAssembler(inputCols=features, outputCol="vector"),
            GBTRegressor(featuresCol="vector", labelCol=label, maxIter=rounds, maxDepth=4, seed=42),
        ]
    ).fit(train)
    predicted = model.transform(test)
    metrics = {
        f"test_{name}": RegressionEvaluator(labelCol=label, metricName=name).evaluate(predicted)
        for name in ("rmse", "mae", "r2")
    }
    kept.unpersist()
    return model, metrics


@dataclass
class Reconstruction:
    """Means and main components (features x k) of the training rows, and the error limit."""

    features: list[str]
    means: list[float]
    parts: list[list[float]]
    threshold: float | None = None


def _held_out(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(100)) < 20


def fit_reconstruction(df: DataFrame, features: list[str], k: int = 3, sigma: float = 2.0, key: str = "id") -> Reconstruction:
    """Components from the training rows; the limit is mean + `sigma` deviations of the
    errors of held-out rows. Fitting sums a features x features matrix, so what reaches the
    driver does not grow with the rows. The features are kept in memory and on disk meanwhile."""
    kept = df.select(key, *[F.col(f).cast("double").alias(f) for f in features]).persist(StorageLevel.MEMORY_AND_DISK)
    train = kept.where(~_held_out(key))
    means = train.agg(*[F.avg(f).alias(f) for f in features]).first()
    model = Reconstruction(list(features), [float(means[f] or 0.0) for f in features], [])
    centred = train.select(array_to_vector(F.array(*[F.col(f) - F.lit(m) for f, m in zip(features, model.means)])).alias("__x"))
    model.parts = PCA(k=k, inputCol="__x", outputCol="__z").fit(centred).pc.toArray().tolist()
    error = apply_reconstruction(kept.where(_held_out(key)), model)
    model.threshold = error.agg(F.avg("reconstruction_error") + F.lit(sigma) * F.stddev_pop("reconstruction_error")).first()[0]
    kept.unpersist()
    return model


def apply_reconstruction(df: DataFrame, model: Reconstruction) -> DataFrame:
    """All columns with reconstruction_error (mean square per feature), threshold,
    anomaly_score and is_anomalous: plain expressions over the given numbers."""
    x = [F.col(f).cast("double") - F.lit(m) for f, m in zip(model.features, model.means)]
    k = len(model.parts[0])
    z = [reduce(lambda a, b: a + b, [F.lit(float(model.parts[i][j])) * x[i] for i in range(len(x))]) for j in range(k)]
    made = df.withColumn("__x", F.array(*x)).withColumn("__z", F.array(*z))
    error = F.lit(0.0)
    for i in range(len(x)):
        gap = F.col("__x")[i] - reduce(lambda a, b: a + b, [F.lit(float(model.parts[i][j])) * F.col("__z")[j] for j in range(k)])
        error = error + gap * gap
    scored = made.withColumn("reconstruction_error", error / len(x)).drop("__x", "__z")
    limit = F.lit(model.threshold).cast("double")
    return (
        scored.withColumn("threshold", limit)
        .withColumn("anomaly_score", F.col("reconstruction_error") / F.nullif(limit, F.lit(0.0)))
        .withColumn("is_anomalous", F.col("reconstruction_error") > limit)
    )


def reconstruction_anomaly(
    df: DataFrame, features: list[str], k: int = 3, sigma: float = 2.0, key: str = "id"
) -> DataFrame:
    """Fit and apply: error of rebuilding each row from its `k` main components, and whether
    it is above the limit of the held-out rows."""
    model = fit_reconstruction(df, features, k, sigma, key)
    return apply_reconstruction(df, model).withColumn("held_out", _held_out(key))


def detection_rates(scored: DataFrame, truth: str) -> DataFrame:
    """Share of rows over the threshold, for true anomalies and for the rest."""
    return scored.groupBy(F.col(truth).alias("truth")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("is_anomalous").cast("double")).alias("flagged_share")
    )


def text_toxicity_model(df: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", dim: int = 1 << 14):
    """Word-hash TF-IDF and logistic regression; accuracy, F1, precision, recall of the toxic class."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)  # folds and grid points read it again
    train, test = stratified_split(kept, label, key)
    model = Pipeline(
        stages=[
            Tokenizer(inputCol=text, outputCol="__words"),
            HashingTF(inputCol="__words", outputCol="__tf", numFeatures=dim),
            IDF(inputCol="__tf", outputCol="__idf"),
            LogisticRegression(featuresCol="__idf", labelCol=label, regParam=0.01),
        ]
    ).fit(train)
    predicted = model.transform(test)

    def of_toxic(metric: str) -> float:
        return MulticlassClassificationEvaluator(
            labelCol=label, predictionCol="prediction", metricName=metric, metricLabel=1.0
        ).evaluate(predicted)

    metrics = {
        **_quality(predicted, label, {"accuracy": "accuracy"}),
        "f1": of_toxic("fMeasureByLabel"),
        "precision": of_toxic("precisionByLabel"),
        "recall": of_toxic("recallByLabel"),
    }
    kept.unpersist()
    return model, metrics
