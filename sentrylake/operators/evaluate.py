"""Counts, cost scores and classification reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import ENV_COST, CostRecord


def attack_type_counts(log: DataFrame, column: str = "jenis_serangan") -> DataFrame:
    return log.groupBy(column).agg(F.count("*").alias("n_events"))


def blocked_count(active: DataFrame) -> DataFrame:
    return active.agg(F.count("*").alias("n_blocked"))


def dataset_info(df: DataFrame, label: str, n_features: int) -> DataFrame:
    positive = F.coalesce(F.col(label), F.lit(0)) != 0
    return df.agg(
        F.count("*").alias("n_samples"),
        F.count_if(positive).alias("n_positive"),
        F.count_if(~positive).alias("n_negative"),
        F.lit(n_features).alias("n_features"),
    )


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n_rows"))


def can_stratify(counts: DataFrame) -> DataFrame:
    """One row: at least two classes and at least two rows in each."""
    enough = (F.count("*") >= 2) & (F.coalesce(F.min("n_rows"), F.lit(0)) >= 2)
    return counts.agg(enough.alias("stratify"))


def reward(action, label, cost: CostRecord = ENV_COST) -> Column:
    a, y = F.col(action), F.col(label)
    return (
        F.when((a == 1) & (y == 1), F.lit(cost.tp))
        .when((a == 0) & (y == 0), F.lit(cost.tn))
        .when((a == 1) & (y == 0), F.lit(cost.fp))
        .when((a == 0) & (y == 1), F.lit(cost.fn))
        .otherwise(F.lit(cost.other))
    )


def cost_score(df: DataFrame, action: str, label: str, cost: CostRecord = ENV_COST) -> DataFrame:
    """Total and mean reward with the four confusion counts, in one pass."""
    a, y = F.col(action), F.col(label)
    r = reward(action, label, cost)
    return df.agg(
        F.sum(r).alias("total_reward"),
        F.avg(r).alias("mean_reward"),
        F.count_if((a == 1) & (y == 1)).alias("tp"),
        F.count_if((a == 0) & (y == 0)).alias("tn"),
        F.count_if((a == 1) & (y == 0)).alias("fp"),
        F.count_if((a == 0) & (y == 1)).alias("fn"),
    )


def category_cost_score(df: DataFrame, predicted: str, actual: str,
                        right: float = 10.0, allow: float = -5.0, wrong: float = -10.0) -> DataFrame:
    """Reward of category decisions; 0 means allow, categories count from 1."""
    r = (
        F.when(F.col(predicted) == F.col(actual), F.lit(right))
        .when(F.col(predicted) == 0, F.lit(allow))
        .otherwise(F.lit(wrong))
    )
    return df.agg(F.sum(r).alias("total_reward"), F.avg(r).alias("mean_reward"), F.count("*").alias("n_events"))


def classification_report(df: DataFrame, label: str, predicted: str, digits: int = 3) -> DataFrame:
    """Per class, then accuracy, macro and weighted averages; a zero division gives 0.

    Only the first grouping reads the rows; the rest works on the confusion table.
    """
    cells = df.groupBy(F.col(label).cast("string").alias("_y"), F.col(predicted).cast("string").alias("_p")).agg(
        F.count("*").alias("_n")
    )
    right = F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(F.lit(0))
    per_class = (
        cells.select(F.explode(F.array(
            F.struct(F.col("_y").alias("class"), F.col("_n").alias("sup"), F.lit(0).cast("bigint").alias("pred"), right.cast("bigint").alias("tp")),
            F.struct(F.col("_p").alias("class"), F.lit(0).cast("bigint").alias("sup"), F.col("_n").alias("pred"), F.lit(0).cast("bigint").alias("tp")),
        )).alias("_c"))
        .select("_c.*")
        .groupBy("class")
        .agg(F.sum("sup").alias("support"), F.sum("pred").alias("_pred"), F.sum("tp").alias("_tp"))
    )
    zero = F.lit(0.0)
    scored = per_class.select(
        "class",
        F.coalesce(F.try_divide(F.col("_tp").cast("double"), F.col("_pred").cast("double")), zero).alias("precision"),
        F.coalesce(F.try_divide(F.col("_tp").cast("double"), F.col("support").cast("double")), zero).alias("recall"),
        F.coalesce(F.try_divide(2.0 * F.col("_tp"), (F.col("_pred") + F.col("support")).cast("double")), zero).alias("f1"),
        "support", "_tp",
    )
    n = F.sum("support")
    names = ("precision", "recall", "f1")

    def weighted(c: str) -> Column:
        return F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), n.cast("double")), zero)

    total = scored.agg(
        F.coalesce(F.try_divide(F.sum("_tp").cast("double"), n.cast("double")), zero).alias("_acc"),
        *[F.avg(c).alias(f"_m_{c}") for c in names],
        *[weighted(c).alias(f"_w_{c}") for c in names],
        n.alias("support"),
    )

    def line(name: str, p: str, r: str, f: str) -> Column:
        return F.struct(
            F.lit(name).alias("class"), F.col(p).alias("precision"), F.col(r).alias("recall"), F.col(f).alias("f1"),
            F.col("support"),
        )

    summary = total.select(F.explode(F.array(
        line("accuracy", "_acc", "_acc", "_acc"),
        line("macro avg", "_m_precision", "_m_recall", "_m_f1"),
        line("weighted avg", "_w_precision", "_w_recall", "_w_f1"),
    )).alias("_l")).select("_l.*")
    both = scored.drop("_tp").unionByName(summary)
    return both.select("class", *[F.round(c, digits).alias(c) for c in names], "support")


def hit_rate(enriched: DataFrame) -> DataFrame:
    """Share of enrichment look-ups that found a flow; 0 when there was none."""
    return enriched.agg(
        F.count_if("hit").alias("hits"),
        F.count_if(~F.col("hit")).alias("misses"),
        F.coalesce(F.avg(F.col("hit").cast("double")), F.lit(0.0)).alias("hit_rate"),
    )
