"""The forest that grows by levels: bins, splits, counts over tasks, and the saved model."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from sentrylake.operators import models as M
from sentrylake.operators import trees as T
from sentrylake.operators.scan import materialise


def corners(spark, n=4000, parts=5):
    """Three classes by a rule with corners; ``c`` says nothing."""
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1000.0
    rows = spark.range(0, n, 1, parts).select("id", u(1).alias("a"), u(2).alias("b"), u(3).alias("c"))
    return materialise(rows.withColumn("_y", F.when((F.col("a") > 0.5) & (F.col("b") > 0.5), 0.0).when(F.col("a") > 0.8, 1.0).otherwise(2.0))
                       .withColumn("_w", F.when(F.col("_y") == 1, 5.0).otherwise(1.0)))


def right(df):
    return df.filter("_p = _y").count() / df.count()


def test_cuts_and_bins():
    v = np.array([3.0, 1.0, 1.0, 2.0, np.inf])
    cuts = T.cuts_of(v, np.ones(5))
    assert cuts.tolist() == [1.5, 2.5, 3.0]
    assert T.binned([v], [cuts])[0].tolist() == [2, 0, 0, 1, 3]
    many = T.cuts_of(np.arange(10_000.0), np.ones(10_000))
    assert len(many) == T.BINS - 1 and np.bincount(T.binned([np.arange(10_000.0)], [many])[0]).min() > 300
    assert T.cuts_of(np.ones(7), np.ones(7)).size == 0 and T.cuts_of(np.zeros(0), np.zeros(0)).size == 0
    with pytest.raises(ValueError):
        T.binned([np.array([np.nan])], [cuts])


def test_best_split_by_hand():
    counts = np.zeros((2, 2, T.BINS, 2), np.int64)
    counts[0, 0, 0], counts[0, 0, 1] = (3, 1), (1, 3)
    counts[0, 1, 0], counts[0, 1, 4] = (4, 0), (0, 4)
    counts[1, :, 2] = (2, 2)  # one bin only: nothing to split
    feature, cut, every, left = T.best_splits(counts, np.array([1.0, 2.0]))
    assert feature.tolist() == [1, -1] and cut[0] == 0
    assert every.tolist() == [[4, 4], [2, 2]] and left[0].tolist() == [4, 0]


def test_one_tree_is_spark_mls(spark):
    """Without draws and with all features offered, the tree is that of Spark ML, for any dealing of the rows."""
    rows = corners(spark)
    old = RandomForestClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", numTrees=1, maxDepth=4, predictionCol="_p", featureSubsetStrategy="all")
    x = VectorAssembler(inputCols=["a", "b", "c"], outputCol="_x").transform(rows)
    theirs = old.fit(x).transform(x)
    for dealt in (rows, rows.repartition(13)):
        ours = T.fit_forest(dealt, ["a", "b", "c"], trees=1, depth=4).transform(rows)
        assert right(ours) >= right(theirs) - 0.01
        assert ours.select("id", "_p").join(theirs.select("id", F.col("_p").alias("q")), "id").filter("_p <> q").count() <= 80


def test_passes_over_few_nodes_give_the_same_forest(spark, monkeypatch):
    rows = corners(spark)
    whole = T.fit_forest(rows, ["a", "b", "c"], trees=8, depth=6)
    monkeypatch.setattr(T, "CELLS", 3 * 2 * T.BINS * 3)  # three nodes
    parted = T.fit_forest(rows, ["a", "b", "c"], trees=8, depth=6)
    for (n, c, k), (m, d, j) in zip(whole.trees, parted.trees, strict=True):
        assert n.tolist() == m.tolist() and c.tolist() == d.tolist() and k == j <= 6
    assert right(whole.transform(rows)) > 0.95


def test_votes_are_of_all_trees(spark, tmp_path):
    rows = corners(spark, 500)
    model = T.fit_forest(rows, ["a", "b", "c"], trees=20, depth=5)
    model.write().save(str(tmp_path / "m"))
    back = T.ForestModel.load(str(tmp_path / "m"))
    got, again = (m.transform(rows).orderBy("id").collect() for m in (model, back))
    assert got == again and model.uid == back.uid
    assert all(abs(r.rawPrediction.values.sum() - 20) < 1e-9 and abs(r.probability.values.sum() - 1) < 1e-9 for r in got)
    assert all(r._p == int(np.argmax(r.rawPrediction.values)) for r in got)
    with pytest.raises(Exception, match="null or not a number"):
        model.transform(rows.withColumn("a", F.lit(None).cast("double"))).select("_p").collect()
    with pytest.raises(ValueError):
        T.fit_forest(rows.limit(0), ["a"])


def test_classifier_grows_its_trees_together(spark, tmp_path):
    """A level is one pass for all trees; Spark ML's forest, used before, has no such model."""
    rows = corners(spark, 600).withColumn("kind", F.when(F.col("_y") == 0, "x").when(F.col("_y") == 1, "y").when(F.col("id") % 50 != 0, "z"))
    rows = rows.drop("_y", "_w")
    model = M.fit_attack_classifier(rows, "kind", ("a", "b", "c"), trees=30, depth=6)
    model.write().overwrite().save(str(tmp_path / "p"))
    forest = PipelineModel.load(str(tmp_path / "p")).stages[0]
    assert isinstance(forest, T.ForestModel) and len(forest.trees) == 30
    scored = M.score_attack_type(rows, PipelineModel.load(str(tmp_path / "p")))
    assert scored.columns == [*rows.columns, "predicted_type"] and scored.filter("predicted_type = kind").count() > 500
    one = M.fit_attack_classifier(rows.filter("kind = 'x'"), "kind", ("a", "b", "c"), trees=3)
    assert M.score_attack_type(rows, one).filter("predicted_type = 'x'").count() == 600
