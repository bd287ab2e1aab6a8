"""Model fits on feature tables derived from the given data."""

import pytest
from pyspark.sql import functions as F

from playmetry.functions import scoring
from playmetry.operators import boards as bd
from playmetry.operators import experiments as ex
from playmetry.operators import features, learning
from playmetry.plans import binding as b


@pytest.fixture(scope="module")
def boards(spark, sf):
    # Shifted Latin patterns with regular blanks; clue counts follow from extra blanks by row.
    solved = "((3 * ((i div 9) % 3) + (i div 9) div 3 + i % 9 + k) % 9 + 1)"
    shown = f"CASE WHEN k % 4 = 0 AND i = 0 THEN {solved} % 9 + 1 WHEN k % 4 = 0 AND i = 1 THEN {solved} WHEN (i * 7 + k * 3 + i * i) % 11 < 5 THEN 0 ELSE {solved} END"
    keys = b.table(spark, sf, "part").selectExpr("p_partkey AS puzzle_id", "int(p_partkey) AS k")
    base = keys.selectExpr("puzzle_id", f"transform(sequence(0, 80), i -> int({shown})) AS board")
    cells = F.sequence(F.lit(0), F.lit(80))
    cut = (F.col("puzzle_id") % 5) * 6
    thinner = base.withColumn(
        "board", F.transform(cells, lambda i: F.when(i < cut, 0).otherwise(F.col("board")[i]).cast("int"))
    )
    table = bd.puzzle_features(thinner)
    return table.withColumn("difficulty", scoring.difficulty_by_clues(F.col("clue_count"))).cache()


def test_classifier(boards):
    model, metrics = learning.fit_difficulty_classifier(boards, bd.FEATURES, trees=(10,), depths=(4,), folds=2)
    assert set(metrics) == {"cv_f1", "test_accuracy", "test_f1_macro", "feature_importances"}
    assert metrics["test_accuracy"] >= 0.88 and metrics["test_f1_macro"] > 0.6
    assert sum(metrics["feature_importances"].values()) == pytest.approx(1.0)
    assert metrics["feature_importances"]["clue_count"] > 0
    assert "prediction" in model.transform(boards).columns


@pytest.fixture(scope="module")
def churn(spark, sf):
    table = features.churn_features(
        b.people(spark, sf), b.session_streaks(spark, sf), b.plain_sessions(spark, sf), b.SESSIONS_AS_OF
    )
    return table.withColumn("churned", (F.col("days_since_last_play") > 200).cast("int")).cache()


CHURN = [
    "days_since_last_play", "session_frequency", "avg_session_duration", "total_games_played", "win_rate_trend",
    "difficulty_variety", "completion_rate", "longest_streak",
]


def test_churn_model(churn):
    model, metrics = learning.fit_churn_model(churn, CHURN, penalties=(0.01,), folds=2)
    assert metrics["test_auc_roc"] >= 0.8 and 0 <= metrics["test_f1"] <= 1
    assert set(metrics["coefficients"]) == set(CHURN)
    scored = ex.score_users(churn, model=model)
    assert scored.where("churn_prob < 0 OR churn_prob > 1").count() == 0
    assert scored.count() == churn.count()


@pytest.fixture(scope="module")
def skills(spark, sf):
    return features.skill_features_weekly(b.people(spark, sf), b.sessions(spark, sf), b.SESSIONS_AS_OF).cache()


SKILLS = ["avg_solve_time_easy", "avg_solve_time_medium", "avg_solve_time_hard", "hint_rate", "error_rate", "session_length_avg"]


def test_clusters(skills):
    (prepared, model), labels, metrics = learning.fit_skill_clusters(skills, SKILLS, ks=range(2, 4))
    assert sorted(labels.values()) == sorted(learning.SKILL_LABELS)
    centers = model.clusterCenters()
    fastest = min(range(5), key=lambda c: centers[c][0])
    assert labels[fastest] == "Expert"
    assert set(metrics["elbow_inertias"]) == {2, 3} and -1 <= metrics["silhouette_score"] <= 1
    distances = learning.centroid_distances(prepared.transform(skills), centers)
    worst = distances.select(scoring.cluster_confidence(F.col("distances")).alias("c")).agg(F.min("c"), F.max("c")).first()
    assert 0 <= worst[0] <= worst[1] <= 1


def test_regressor(skills):
    table = skills.withColumn("target", F.col("avg_solve_time_easy") / 100)
    model, metrics = learning.fit_difficulty_regressor(table, SKILLS, rounds=5)
    assert metrics["test_r2"] > 0.5 and metrics["test_mae"] <= metrics["test_rmse"]


def test_reconstruction(spark):
    rows = [(i, float(i % 7), float(2 * (i % 7)) + (0.01 if i % 2 else -0.01), float(-(i % 7))) for i in range(200)]
    rows.append((500, 3.0, -40.0, 9.0))
    frame = spark.createDataFrame(rows, "id long, a double, b double, c double")
    got = learning.reconstruction_anomaly(frame, ["a", "b", "c"], k=1).withColumn("odd", F.col("id") == 500)
    rates = {r["truth"]: r["flagged_share"] for r in learning.detection_rates(got, "odd").collect()}
    assert rates[True] == 1.0 and rates[False] < 0.3


def test_text_model(spark, sf):
    docs = b.table(spark, sf, "documents").join(b.table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id")
    _, metrics = learning.text_toxicity_model(docs, dim=1 << 10)
    assert set(metrics) == {"accuracy", "f1", "precision", "recall"} and all(0 <= v <= 1 for v in metrics.values())


def test_split_is_stable(boards):
    train, test = learning.stratified_split(boards, "difficulty", "puzzle_id")
    assert train.count() + test.count() == boards.count()
    assert train.join(test, "puzzle_id", "left_semi").count() == 0
