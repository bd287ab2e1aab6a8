"""Experiment assignment, drift, gates, registry, feature versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from playmetry.functions import vocab
from playmetry.functions.ids import ab_bucket, model_uri
from playmetry.operators.frames import class_union
from playmetry.operators.metrics import class_distribution
from playmetry.operators.ranking import FEATURE_KEY
from playmetry.scale import exact_quantiles, null_safe_join, ordered_positions, value_buckets


def _n() -> Column:
    return F.count(F.lit(1))


def assign_variant(users: DataFrame, config: DataFrame, as_of) -> DataFrame:
    """Variant and model address of each (user, experiment).

    Control when the experiment is unknown (without address), not active, past its end,
    or when the user's bucket is outside the treatment share.
    """
    joined = users.select("user_id", "experiment_name").join(config, "experiment_name", "left")
    known = F.col("model_name").isNotNull()
    ended = F.col("end_date").isNotNull() & (F.lit(str(as_of)).cast("timestamp") > F.col("end_date"))
    open_now = known & (F.col("status") == "active") & ~ended
    bucket = ab_bucket(F.col("user_id"), F.col("experiment_name"))
    chosen = open_now & (bucket < F.floor(F.col("traffic_split") * 100))
    stage = F.when(chosen, F.col("treatment_variant")).otherwise(F.col("control_variant"))
    return joined.select(
        "user_id",
        "experiment_name",
        bucket.alias("bucket"),
        F.when(chosen, "treatment").otherwise("control").alias("variant"),
        F.coalesce(model_uri(F.col("model_name"), stage), F.lit("")).alias("model_uri"),
    )


def score_users(features: DataFrame, threshold: float = 0.7, model=None, scorer=None) -> DataFrame:
    """Churn probability and risk per user, and whether it reaches the queue threshold.

    The default is the heuristic column; a fitted pipeline `model` (its probability of
    class 1) or a `scorer` pandas_udf over the feature columns may take its place.
    """
    from pyspark.ml.functions import vector_to_array

    from playmetry.functions.scoring import churn_heuristic, risk_level

    if model is not None:
        scored = model.transform(features).withColumn(
            "churn_prob", vector_to_array("probability")[1]
        )
    elif scorer is not None:
        scored = features.withColumn(
            "churn_prob", scorer(*[F.col(c) for c in features.columns if c != "user_id"])
        )
    else:
        scored = features.withColumn(
            "churn_prob", churn_heuristic(F.col("days_since_last_play"), F.col("session_frequency"))
        )
    return scored.select(
        "user_id",
        "churn_prob",
        risk_level(F.col("churn_prob")).alias("risk_level"),
        (F.col("churn_prob") >= threshold).alias("queued"),
    )


# --- drift and service levels --------------------------------------------------


def psi_drift(current: DataFrame, reference: DataFrame) -> DataFrame:
    """Population stability index of two class distributions (class, share): one row."""
    both = class_union(reference, current)
    term = (F.col("cur_share") - F.col("ref_share")) * F.ln(F.col("cur_share") / F.col("ref_share"))
    psi = F.round(F.coalesce(F.col("__psi"), F.lit(0.0)), 4)
    empty = F.col("__seen") == 0
    return (
        both.agg(F.sum(term).alias("__psi"), F.count_if("in_current").alias("__seen"))
        .select(
            F.when(empty, 0.0).otherwise(psi).alias("psi"),
            (~empty & (psi > 0.1)).alias("drift_detected"),
            F.when(empty, "no_data")
            .when(psi > 0.25, "significant_drift")
            .when(psi > 0.1, "moderate_drift")
            .otherwise("no_drift")
            .alias("status"),
        )
    )


def psi_of_predictions(predictions: DataFrame, reference: DataFrame) -> DataFrame:
    return psi_drift(class_distribution(predictions).select("class", "share"), reference)


def sla_table(spark: SparkSession) -> DataFrame:
    """The fixed model service levels."""
    return spark.createDataFrame(
        vocab.SLA_TABLE,
        "model_id string, metric string, threshold double, comparison string, full_only boolean",
    )


def sla_check(metrics: DataFrame, sla: DataFrame, full: bool = False) -> DataFrame:
    """Each service level with the measured value: passed, skipped, and why not.

    `metrics` has (model_id, metric, value, error); an entry with `error` failed to run.
    """
    evaluated = metrics.groupBy("model_id").agg(F.max("error").alias("__error")).withColumn(
        "__ran", F.lit(True)
    )
    values = metrics.select("model_id", "metric", "value")
    joined = sla.join(evaluated, "model_id", "left").join(values, ["model_id", "metric"], "left")
    skipped = F.col("full_only") & F.lit(not full)
    value = F.when(~skipped & F.col("__error").isNull(), F.col("value"))
    meets = F.when(F.col("comparison") == "gte", value >= F.col("threshold")).otherwise(
        value <= F.col("threshold")
    )
    reason = (
        F.when(skipped, "full check only")
        .when(F.col("__ran").isNull(), "not evaluated")
        .when(F.col("__error").isNotNull(), F.col("__error"))
        .when(F.col("value").isNull(), F.concat(F.lit("missing metric "), F.col("metric")))
    )
    return joined.select(
        "model_id",
        "metric",
        F.round(value, 4).alias("value"),
        "threshold",
        "comparison",
        F.when(skipped, True).otherwise(F.coalesce(meets, F.lit(False))).alias("passed"),
        skipped.alias("skipped"),
        reason.alias("reason"),
    )


def promotion_gate(checks: DataFrame) -> DataFrame:
    """A run may be promoted only when every check passed."""
    return checks.groupBy("model_id").agg(
        F.min("passed").alias("promotable"),
        F.count_if(~F.col("passed")).alias("n_failed"),
    )


def baseline_regression_gate(
    samples: DataFrame, baselines: DataFrame, slack: float = 1.2
) -> DataFrame:
    """Exact p95 per script against its baseline with slack. A script without samples does not pass."""
    p95 = exact_quantiles(samples, ["script"], "latency_ms", {"p95_ms": 0.95})
    limit = F.col("baseline_ms") * F.lit(float(slack))
    return (
        baselines.join(p95, "script", "left")
        .withColumn("limit_ms", limit)
        .withColumn("passed", F.coalesce(F.col("p95_ms") <= limit, F.lit(False)))
    )


def registry_promote(events: DataFrame) -> DataFrame:
    """Stage of every model version after its log of registrations and promotions.

    `events` has (name, version, action, target_stage, ts, event_id). The first version
    registered goes to production, a later one without a stage to development; each promotion to production archives the version it
    replaces; otherwise the version's last own event decides.
    """
    moment = F.struct("ts", "event_id")
    register = F.col("action") == "register"
    first = events.where(register).groupBy("name").agg(
        F.min_by("version", moment).alias("__first")
    )
    known = events.where(register).select("name", "version").distinct()
    applied = (
        events.join(known, ["name", "version"], "left_semi")
        .join(first, "name")
        .withColumn(
            "stage",
            F.when(register & (F.col("version") == F.col("__first")), "production").otherwise(
                F.coalesce("target_stage", F.lit("development"))
            ),
        )
    )
    last_own = applied.groupBy("name", "version").agg(
        F.max_by("stage", moment).alias("__stage"), F.max(moment).alias("__at")
    )
    # Promotions only; a registry holds few of them per name.
    promoted = applied.where("stage = 'production'").select("name", "version", moment.alias("__p"))
    follower = promoted.withColumn(
        "__replaced_at", F.lead("__p").over(Window.partitionBy("name").orderBy("__p"))
    )
    last_promotion = follower.groupBy("name", "version").agg(
        F.max_by(F.struct("__replaced_at"), "__p").alias("__r")
    )
    pointer = promoted.groupBy("name").agg(F.max_by("version", "__p").alias("__prod"))
    replaced_at = F.col("__r.__replaced_at")
    current = F.col("version") == F.col("__prod")
    archived = ~current & replaced_at.isNotNull() & (F.col("__at") < replaced_at)
    return (
        last_own.join(last_promotion, ["name", "version"], "left")
        .join(pointer, "name", "left")
        .select(
            "name",
            "version",
            F.when(archived, "archived").otherwise(F.col("__stage")).alias("stage"),
            F.coalesce(current, F.lit(False)).alias("is_production"),
        )
    )


# --- evaluation ----------------------------------------------------------------


def classification_report(df: DataFrame, label: str = "actual", prediction: str = "predicted") -> DataFrame:
    """Precision, recall, F1 and support per class, and their plain mean as `macro`.

    One pass counts (label, prediction) pairs; all else works on those counts.
    """
    pairs = (
        df.where(F.col(label).isNotNull())
        .groupBy(F.col(label).cast("string").alias("y"), F.col(prediction).cast("string").alias("p"))
        .agg(_n().alias("n"))
    )
    # Each pair counts for its true class and for its predicted class.
    marks = pairs.select(
        F.explode(
            F.array(
                F.struct(
                    F.col("y").alias("class"),
                    F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(F.lit(0)).alias("hit"),
                    F.col("n").alias("support"),
                    F.lit(0).cast("long").alias("claimed"),
                ),
                F.struct(
                    F.col("p").alias("class"),
                    F.lit(0).cast("long").alias("hit"),
                    F.lit(0).cast("long").alias("support"),
                    F.col("n").alias("claimed"),
                ),
            )
        ).alias("m")
    ).select("m.*")
    sums = marks.groupBy("class").agg(
        F.sum("hit").alias("hit"), F.sum("support").alias("support"), F.sum("claimed").alias("claimed")
    )

    def share(bottom: str) -> Column:
        return F.coalesce(F.col("hit") / F.nullif(F.col(bottom), F.lit(0)), F.lit(0.0))

    p, r = share("claimed"), share("support")
    per_class = sums.select(
        "class",
        p.alias("precision"),
        r.alias("recall"),
        F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)).alias("f1"),
        "support",
    )
    macro = per_class.agg(
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1"),
        F.sum("support").alias("support"),
    ).select(F.lit("macro").alias("class"), "precision", "recall", "f1", "support")
    return per_class.unionByName(macro)


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve from mean ranks: one row (auc, positives, negatives).

    Rows are counted per score first. Ranks are summed per fine bucket of scores, then per
    coarse bucket, about one percent wide; only the coarse sums meet in one ordered window.
    Any double falls into one of less than 300,000 of these, so margins and log-odds do as
    well as shares.
    """
    # Rows without a score or label weigh nothing. A filter would be pushed down and have
    # the score computed twice.
    counts = F.col(score).isNotNull() & F.col(label).isNotNull()
    per_score = (
        df.groupBy(F.col(score).cast("double").alias("s"))
        .agg(
            F.count_if(counts).alias("n"),
            F.sum(F.when(counts, F.col(label).cast("long")).otherwise(0)).alias("pos"),
        )
        .withColumns(dict(zip(("b", "fine"), value_buckets("s"))))
    )

    def lift(rows: DataFrame, inside: list[str], order: str) -> DataFrame:
        """Adds the rows that come before within `inside` to the rank sums, and folds them up."""
        w = Window.partitionBy(*inside).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        below = F.coalesce(F.sum("n").over(w), F.lit(0))
        lifted = rows.withColumn("r", F.col("r") + F.col("pos") * below)
        return lifted.groupBy(*inside).agg(F.sum("r").alias("r"), F.sum("pos").alias("pos"), F.sum("n").alias("n"))

    ranked = per_score.withColumn("r", F.col("pos") * (F.col("n") + 1) / F.lit(2.0))
    buckets = lift(lift(ranked, ["b", "fine"], "s"), ["b"], "fine")
    earlier = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    sums = buckets.withColumn("r", F.col("r") + F.col("pos") * before).agg(
        F.sum("r").alias("r"),
        F.sum("pos").alias("positives"),
        F.sum(F.col("n") - F.col("pos")).alias("negatives"),
    )
    p, q = F.col("positives"), F.col("negatives")
    area = (F.col("r") - p * (p + 1) / F.lit(2.0)) / F.nullif(p.cast("double") * q, F.lit(0.0))
    return sums.select(area.alias("auc"), "positives", "negatives")


# --- feature versions ----------------------------------------------------------


def feature_id(*columns: str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256)


def write_feature_version(
    new: DataFrame, store: DataFrame, source_table: str, source_filter: str, pipeline: str
) -> tuple[DataFrame, DataFrame]:
    """The store after appending `new` snapshots as next versions, and their lineage rows.

    `new` has the key columns, `features` and `computed_at`; several snapshots of one
    entity are numbered by time. Ids are hashes of key and version, so a retry repeats them.
    """
    base = store.groupBy(*FEATURE_KEY).agg(F.max("feature_version").alias("__base"))
    # Days number the snapshots, so an entity written very often is spread over days.
    placed = ordered_positions(
        new, FEATURE_KEY, F.to_date("computed_at"), [F.col("computed_at")], "__place"
    )
    newest = new.groupBy(*FEATURE_KEY).agg(_n().alias("__count"))
    added = (
        null_safe_join(null_safe_join(placed, newest, FEATURE_KEY), base, FEATURE_KEY, "left")
        .withColumn(
            "feature_version", (F.coalesce("__base", F.lit(0)) + F.col("__place")).cast("int")
        )
        .withColumn("is_current", F.col("__place") == F.col("__count"))
        .withColumn("pipeline_name", F.lit(pipeline))
        .withColumn("id", feature_id(*FEATURE_KEY, "feature_version"))
    )
    touched = newest.select(*FEATURE_KEY, F.lit(True).alias("__touched"))
    demoted = null_safe_join(store, touched, FEATURE_KEY, "left").withColumn(
        "is_current", F.col("is_current") & F.col("__touched").isNull()
    )
    after = demoted.select(*store.columns).unionByName(added.select(*store.columns))
    lineage = added.select(
        F.sha2(F.concat_ws("|", "id", F.lit(source_table)), 256).alias("id"),
        F.col("id").alias("feature_id"),
        F.lit(source_table).alias("source_table"),
        F.lit(source_filter).alias("source_filter"),
        F.col("row_count").cast("long").alias("row_count"),
        "computed_at",
    )
    return after, lineage


def append_feature_versions(
    new: DataFrame, log: DataFrame, source_table: str, source_filter: str, pipeline: str
) -> tuple[DataFrame, DataFrame]:
    """Rows to append to a log of feature versions, and their lineage rows; nothing stored is rewritten.

    The log has the columns of the store and `entry`: `version`, a snapshot under its number,
    or `demotion`, which says that a version is no longer current and holds its key, number
    and id alone. Appended are the snapshots of `new` as next versions, numbered as by
    `write_feature_version`, and one demotion for each current version of a touched entity,
    so the rows written follow from the rows that are new. `feature_view` gives the store.
    """
    touched = new.select(*FEATURE_KEY).distinct()
    mine = null_safe_join(log, touched, FEATURE_KEY, "left_semi")
    state = mine.groupBy(*FEATURE_KEY, "feature_version").agg(
        F.max("id").alias("id"), (F.bool_or("is_current") & ~F.bool_or(F.col("entry") == "demotion")).alias("is_current")
    )
    empty = log.drop("entry").limit(0)
    numbered = empty.unionByName(state, allowMissingColumns=True)
    after, lineage = write_feature_version(new, numbered, source_table, source_filter, pipeline)
    base = state.groupBy(*FEATURE_KEY).agg(F.max("feature_version").alias("__base"))
    added = null_safe_join(after, base, FEATURE_KEY, "left").where(F.col("feature_version") > F.coalesce("__base", F.lit(0)))
    demoted = state.where("is_current").withColumn("is_current", F.lit(False)).withColumn("entry", F.lit("demotion"))
    snapshots = added.drop("__base").withColumn("entry", F.lit("version"))
    return log.limit(0).unionByName(snapshots).unionByName(demoted, allowMissingColumns=True).select(*log.columns), lineage


def feature_view(log: DataFrame) -> DataFrame:
    """The store that a log of versions and demotions stands for: each version once, current
    unless it was demoted. A version appended twice by a retry counts once."""
    rest = [c for c in log.columns if c not in (*FEATURE_KEY, "feature_version", "is_current", "entry")]
    version = F.col("entry") == "version"
    folded = log.groupBy(*FEATURE_KEY, "feature_version").agg(
        F.max(F.when(version, F.struct(*rest))).alias("__row"),
        (F.bool_or(version & F.col("is_current")) & ~F.bool_or(~version)).alias("is_current"),
    )
    return folded.where(F.col("__row").isNotNull()).select(*FEATURE_KEY, "feature_version", "is_current", "__row.*").select(*[c for c in log.columns if c != "entry"])


def feature_lineage_of(lineage: DataFrame, wanted_id: str | Column) -> DataFrame:
    return lineage.where(F.col("feature_id") == wanted_id).orderBy("computed_at", "id")
