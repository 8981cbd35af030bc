"""Detectors and the attack-type classifier on Spark ML."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.times import parse_local
from ..params import TRAINING_COST, CostRecord
from ..schema import CLASSIFIER_FEATURES, RETRAIN_REQUIRED, RUNTIME_FEATURES
from .evaluate import classification_report
from .filters import require_rows, valid_timestamps
from .columns import classifier_features, runtime_features_from_dataset
from .prep import apply_minmax, balanced_weights, fit_minmax, stratified_split, train_val_split
from .scan import materialise
from .trees import fit_forest

SCORE_STEPS = 10_000


# ---------------------------------------------------------------------------
# attack type
# ---------------------------------------------------------------------------

def fit_attack_classifier(
    train: DataFrame,
    label: str = "attack_type",
    features=CLASSIFIER_FEATURES,
    model_type: str = "rf",
    trees: int = 300,
    depth: int = 12,
    seed: int = 42,
) -> PipelineModel:
    """Random forest with balanced class weights, or a perceptron with layers 128 and 64.

    Feature order and class names are part of the returned pipeline.
    """
    if model_type not in ("rf", "mlp"):
        raise ValueError("model_type must be 'rf' or 'mlp'")
    indexer = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="skip")
    fitted = indexer.fit(train)
    names = IndexToString(inputCol="_p", outputCol="predicted_type", labels=fitted.labels)
    weighted = fitted.transform(balanced_weights(train, label, "_w"))
    if model_type == "rf":
        return PipelineModel(stages=[fit_forest(weighted, features, trees, depth, seed), names])
    prepared = [
        VectorAssembler(inputCols=list(features), outputCol="_x"),
        # byte counts next to ports in 0..1: a perceptron needs them on one scale
        StandardScaler(inputCol="_x", outputCol="_z", withMean=True, withStd=True),
    ]
    learner = MultilayerPerceptronClassifier(
        featuresCol="_z", labelCol="_y", predictionCol="_p",
        layers=[len(features), 128, 64, len(fitted.labels)], maxIter=100, seed=seed,
    )
    body = Pipeline(stages=[*prepared, learner, names]).fit(weighted)
    return PipelineModel(stages=body.stages)


def score_attack_type(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Adds ``predicted_type``; works on batch tables and streams."""
    return model.transform(df).select(*df.columns, "predicted_type")


def train_attack_classifier(
    attacks: DataFrame, path: str | None = None, label: str = "attack_type", model_type: str = "rf",
    trees: int = 300, depth: int = 12, seed: int = 42, id_col: str = "event_id",
) -> tuple[PipelineModel, DataFrame]:
    """Split, fit, report on the held-out rows, optionally save."""
    require_rows(attacks)
    marked = materialise(stratified_split(materialise(attacks), label, 0.2, seed, id_col))  # read by every later step
    model = fit_attack_classifier(marked.filter("NOT is_test"), label, CLASSIFIER_FEATURES, model_type, trees, depth, seed)
    report = classification_report(score_attack_type(marked.filter("is_test"), model), label, "predicted_type")
    if path:
        model.write().overwrite().save(path)
    return model, report


# ---------------------------------------------------------------------------
# detector: cost-sensitive decision between allow (0) and block (1)
# ---------------------------------------------------------------------------

@dataclass(frozen=True)
class Detector:
    scaler: DataFrame
    model: PipelineModel
    threshold: int
    features: tuple[str, ...] = RUNTIME_FEATURES

    def save(self, path: str) -> None:
        self.scaler.write.mode("overwrite").parquet(f"{path}/scaler")
        self.model.write().overwrite().save(f"{path}/model")
        spark = self.scaler.sparkSession
        meta = spark.createDataFrame([(self.threshold, list(self.features))], "threshold int, features array<string>")
        meta.write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Detector:
        meta = spark.read.parquet(f"{path}/meta").first()
        return cls(
            spark.read.parquet(f"{path}/scaler"), PipelineModel.load(f"{path}/model"),
            meta["threshold"], tuple(meta["features"]),
        )


def _scores(df: DataFrame, scaler: DataFrame, model: PipelineModel, features) -> DataFrame:
    scaled = apply_minmax(df, scaler, features)
    p = vector_to_array(F.col("_prob"))[1]
    return model.transform(scaled).withColumn("_score", F.floor(p * SCORE_STEPS).cast("int")).drop("_x", "_raw", "_prob", "_p")


def best_threshold(scored: DataFrame, label: str, cost: CostRecord = TRAINING_COST) -> DataFrame:
    """Threshold with the greatest total reward: one row ``threshold, total_reward``.

    Scores are whole numbers, so the cumulative sum runs over at most ``SCORE_STEPS + 1`` rows
    however large the table is.  The row above the greatest score stands for never blocking.
    """
    y = F.col(label)
    hist = scored.groupBy(F.col("_score").alias("threshold")).agg(
        F.count_if(y == 1).alias("_pos"), F.count_if(y == 0).alias("_neg")
    )
    never = scored.agg(
        F.lit(SCORE_STEPS + 1).alias("threshold"), F.lit(0).cast("bigint").alias("_pos"), F.lit(0).cast("bigint").alias("_neg")
    )
    allrows = hist.unionByName(never)
    everyone = W.partitionBy(F.lit(0))
    above = everyone.orderBy(F.col("threshold").desc())
    pos, neg = F.sum("_pos").over(above), F.sum("_neg").over(above)
    all_pos, all_neg = F.sum("_pos").over(everyone), F.sum("_neg").over(everyone)
    reward = pos * cost.tp + neg * cost.fp + (all_pos - pos) * cost.fn + (all_neg - neg) * cost.tn
    return allrows.select("threshold", reward.alias("total_reward")).orderBy(
        F.col("total_reward").desc(), F.col("threshold").desc()
    ).limit(1)


LEARNERS = ("logistic", "boosted")


def _learner(kind: str, max_iter: int):
    common = {"featuresCol": "_x", "labelCol": "_y", "weightCol": "_w", "maxIter": max_iter, "predictionCol": "_p"}
    if kind == "logistic":
        learner = LogisticRegression(regParam=1e-4, family="binomial", **common)
    elif kind == "boosted":
        learner = GBTClassifier(maxDepth=4, stepSize=0.2, seed=42, **common)
    else:
        raise ValueError(f"learner must be one of {LEARNERS}")
    return learner.setRawPredictionCol("_raw").setProbabilityCol("_prob")


def train_detector(
    train: DataFrame, validation: DataFrame, label: str = "y", features=RUNTIME_FEATURES,
    cost: CostRecord = TRAINING_COST, max_iter: int = 50, learner: str = "logistic",
) -> tuple[Detector, float]:
    """Scaler fitted on ``train`` only, cost-weighted model, threshold from ``validation``.

    The model is logistic or of boosted trees (``max_iter`` of them).  A row weighs what a wrong
    decision about it costs.  Returns the detector and its total reward on the validation
    rows, which is never below that of a constant decision.
    """
    scaler = materialise(fit_minmax(train, features))
    weight = F.when(F.col(label) == 1, F.lit(cost.tp - cost.fn)).otherwise(F.lit(cost.tn - cost.fp))
    prepared = materialise(
        apply_minmax(train, scaler, features).withColumns({"_w": weight, "_y": F.col(label).cast("double")})
    )
    model = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x"), _learner(learner, max_iter)]).fit(prepared)
    best = best_threshold(_scores(validation, scaler, model, features), label, cost).first()
    return Detector(scaler, model, best["threshold"], tuple(features)), best["total_reward"]


def total_reward(df: DataFrame, detector: Detector, label: str = "y", cost: CostRecord = TRAINING_COST) -> float:
    """Reward of the detector's decisions on labelled rows."""
    scored = score_detector(df, detector)
    act, y = F.col("action") == 1, F.col(label) == 1
    value = F.when(act & y, cost.tp).when(act, cost.fp).when(y, cost.fn).otherwise(cost.tn)
    return float(scored.agg(F.coalesce(F.sum(value), F.lit(0)).cast("double")).first()[0])


def choose_detector(
    train: DataFrame, validation: DataFrame, choice: DataFrame, label: str = "y", features=RUNTIME_FEATURES,
    cost: CostRecord = TRAINING_COST, max_iter: dict[str, int] | None = None,
) -> tuple[Detector, DataFrame]:
    """The learner with the greatest total reward on ``choice``, rows that neither fit nor threshold has seen.

    Also gives one row per learner: ``learner, validation_reward, choice_reward, chosen``; of
    equal rewards the simpler learner's is taken.
    """
    rounds = {"logistic": 50, "boosted": 20} | (max_iter or {})
    tried = []
    for kind in LEARNERS:
        detector, reward = train_detector(train, validation, label, features, cost, rounds[kind], kind)
        tried.append((kind, float(reward), total_reward(choice, detector, label, cost), detector))
    best = max(tried, key=lambda t: t[2])
    report = [(kind, reward, unseen, kind == best[0]) for kind, reward, unseen, _ in tried]
    return best[3], train.sparkSession.createDataFrame(
        report, "learner string, validation_reward double, choice_reward double, chosen boolean")


def score_detector(df: DataFrame, detector: Detector) -> DataFrame:
    """Adds the model's ``action`` (0/1) and its fixed confidence (.80 to block, .75 to allow)."""
    scored = _scores(df, detector.scaler, detector.model, detector.features)
    act = F.col("_score") >= detector.threshold
    kept = [F.col(c) for c in df.columns if c not in detector.features]
    return scored.select(
        *kept, act.cast("int").alias("action"), F.when(act, F.lit(0.80)).otherwise(F.lit(0.75)).alias("confidence")
    )


def as_model(detector: Detector, classifier: PipelineModel | None = None):
    """The trained models as one function over enriched alerts, as the pipeline takes it.

    It keeps all columns and adds ``action``, ``confidence`` and, with a classifier, ``attack_type``.
    The features are computed beside the alert's own columns, from its flow features and ``timestamp``.
    In batches the alerts and what comes out are written as tables, so the expressions before, within and
    after the models are planned and compiled apart and no forest is asked twice.
    """

    def model(alerts: DataFrame) -> DataFrame:
        return typed(alerts) if alerts.isStreaming else materialise(typed(materialise(alerts)))

    def typed(alerts: DataFrame) -> DataFrame:
        whole = F.struct(*[F.col(c) for c in alerts.columns]).alias("_alert")
        scored = score_detector(runtime_features_from_dataset(alerts, (whole,)), detector)
        out = scored.select("_alert.*", "action", "confidence")
        if classifier is None:
            return out
        whole = F.struct(*[F.col(c) for c in out.columns]).alias("_alert")
        rows = out.withColumn("_local", parse_local("timestamp"))
        found = score_attack_type(classifier_features(rows, (whole,), local="_local"), classifier)
        return found.select("_alert.*", F.col("predicted_type").alias("attack_type"))

    return model


def retrain_job(dataset: DataFrame, prepare, path: str, version: str, label: str = "y",
                cost: CostRecord = TRAINING_COST, min_rows: int = 100, seed: int = 42) -> DataFrame:
    """Validates the data set, trains, saves under ``path/version`` and points ``path/current`` at it.

    ``prepare`` turns the validated rows into ``event_id``, the features and ``label``.
    """
    valid = require_rows(valid_timestamps(dataset, "timestamp", RETRAIN_REQUIRED), min_rows)
    marked = materialise(train_val_split(materialise(prepare(valid)), 0.8, seed))
    detector, reward = train_detector(marked.filter("is_train"), marked.filter("NOT is_train"), label, cost=cost)
    detector.save(f"{path}/{version}")
    spark = dataset.sparkSession
    row = spark.createDataFrame(
        [(version, f"{path}/{version}", detector.threshold, float(reward))],
        "version string, path string, threshold int, validation_reward double",
    )
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/current")
    return row
