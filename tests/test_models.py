from __future__ import annotations

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from sentrylake.operators import evaluate as E
from sentrylake.operators import models as M
from sentrylake.operators import prep
from sentrylake.params import TRAINING_COST
from sentrylake.schema import CLASSIFIER_FEATURES, RETRAIN_REQUIRED, RUNTIME_FEATURES


def rows(spark, features, n=300):
    """``y`` follows the fourth feature, with some noise; the others carry nothing."""
    base = spark.range(n).withColumnRenamed("id", "event_id")
    signal = F.pmod(F.hash("event_id"), F.lit(100)).cast("double")
    noise = F.pmod(F.hash(F.col("event_id") + 7), F.lit(10)) == 0
    df = base.select("event_id", *[(signal if i == 3 else F.lit(1.0)).alias(f) for i, f in enumerate(features)])
    return df.withColumn("y", ((F.col(features[3]) > 60) != noise).cast("int"))


def test_detector_beats_constant_decisions(spark, tmp_path):
    marked = prep.train_val_split(rows(spark, RUNTIME_FEATURES))
    train, val = marked.filter("is_train"), marked.filter("NOT is_train")
    detector, reward = M.train_detector(train, val, max_iter=10)
    detector.save(str(tmp_path / "d"))
    scored = M.score_detector(val, M.Detector.load(spark, str(tmp_path / "d")))
    got = E.cost_score(scored, "action", "y", TRAINING_COST).first()
    assert got.total_reward == pytest.approx(reward)
    for constant in (0, 1):
        other = E.cost_score(val.withColumn("action", F.lit(constant)), "action", "y", TRAINING_COST).first()
        assert reward >= other.total_reward
    assert {(r.action, r.confidence) for r in scored.collect()} <= {(0, 0.75), (1, 0.80)}


def test_best_threshold(spark):
    scored = spark.createDataFrame([(10, 0), (20, 1), (30, 0), (40, 1), (40, 1)], "_score int, y int")
    by_hand = {}
    for t in (10, 20, 30, 40, M.SCORE_STEPS + 1):
        by_hand[t] = sum(
            (TRAINING_COST.tp if y else TRAINING_COST.fp) if s >= t else (TRAINING_COST.fn if y else TRAINING_COST.tn)
            for s, y in [(10, 0), (20, 1), (30, 0), (40, 1), (40, 1)]
        )
    best = M.best_threshold(scored, "y").first()
    assert best.total_reward == pytest.approx(max(by_hand.values())) and by_hand[best.threshold] == best.total_reward
    quiet = M.best_threshold(spark.createDataFrame([(10, 0), (99, 0)], "_score int, y int"), "y").first()
    assert quiet.threshold == M.SCORE_STEPS + 1


@pytest.mark.parametrize("kind", ["rf", "mlp"])
def test_attack_classifier(spark, tmp_path, kind):
    df = rows(spark, CLASSIFIER_FEATURES).withColumn("attack_type", F.when(F.col("y") == 1, F.lit("scan")).otherwise(F.lit("dos"))).drop("y")
    _, report = M.train_attack_classifier(df, str(tmp_path / kind), model_type=kind, trees=60, depth=4)
    lines = {r["class"]: r for r in report.collect()}
    assert {"scan", "dos", "accuracy", "macro avg", "weighted avg"} <= set(lines)
    if kind == "rf":
        assert lines["accuracy"].f1 > 0.7
    scored = M.score_attack_type(df, PipelineModel.load(str(tmp_path / kind)))
    assert {r[0] for r in scored.select("predicted_type").distinct().collect()} <= {"scan", "dos"}
    with pytest.raises(ValueError):
        M.fit_attack_classifier(df, model_type="other")


def test_retrain_job(spark, tmp_path):
    def prepare(df):
        return df.select("event_id", *RUNTIME_FEATURES, "y")

    data = rows(spark, RUNTIME_FEATURES)
    extra = {c: F.lit("1") for c in RETRAIN_REQUIRED if c not in data.columns}
    data = data.withColumns(extra | {"timestamp": F.when(F.col("event_id") < 250, F.lit("2024-01-01T00:00:00Z")).otherwise(F.lit("?"))})
    row = M.retrain_job(data, prepare, str(tmp_path), "v1").first()
    assert row.version == "v1" and spark.read.parquet(str(tmp_path / "current")).first().path.endswith("v1")
    assert M.Detector.load(spark, row.path).threshold == row.threshold
    with pytest.raises(ValueError):
        M.retrain_job(data.limit(50), prepare, str(tmp_path), "v2")
    with pytest.raises(ValueError):
        M.retrain_job(data.drop("proto"), prepare, str(tmp_path), "v3")


def test_boosted_trees_are_chosen_where_the_rule_has_corners(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("event_id"), (F.xxhash64("id") % 1000 / 1000.0).alias("a"), (F.xxhash64("id", F.lit(1)) % 1000 / 1000.0).alias("b"))
    rows = M.materialise(rows.withColumn("y", ((F.abs("a") < 0.5) & (F.abs("b") < 0.5)).cast("int")))
    parts = [rows.filter("event_id % 5 < 3"), rows.filter("event_id % 5 = 3"), rows.filter("event_id % 5 = 4")]
    detector, report = M.choose_detector(*parts, features=("a", "b"), max_iter={"boosted": 10, "logistic": 10})
    found = {r.learner: r for r in report.collect()}
    assert found["boosted"].chosen and not found["logistic"].chosen
    assert found["boosted"].choice_reward > found["logistic"].choice_reward
    assert M.total_reward(parts[2], detector) == found["boosted"].choice_reward
    scored = M.score_detector(parts[2], detector)
    assert scored.filter("action <> y").count() < 0.05 * parts[2].count()
    with pytest.raises(ValueError):
        M.train_detector(parts[0], parts[1], features=("a", "b"), learner="none")
