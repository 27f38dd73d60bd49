"""Scores of binary predictions, over all rows or per group, in one aggregation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def binary_metrics(df: DataFrame, target: str, predicted: str, *groups: str) -> DataFrame:
    """n, accuracy, precision, recall and f1 (0 where a denominator is 0); rows without target are left out."""
    hit = lambda t, p: F.count_if((F.col(target) == t) & (F.col(predicted) == p))
    counts = df.where(F.col(target).isNotNull()).groupBy(*groups).agg(F.count("*").alias("n"), hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return counts.select(*groups, "n", _ratio(tp + tn, F.col("n")).alias("accuracy"), _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def confusion(df: DataFrame, target: str, predicted: str) -> DataFrame:
    return df.where(F.col(target).isNotNull()).groupBy(target).pivot(predicted, [0, 1]).count().na.fill(0).withColumnsRenamed({"0": "predicted_0", "1": "predicted_1"})


def best(df: DataFrame, score: str, *order: str) -> DataFrame:
    """The row of the highest score; among equals the first by ``order``."""
    return df.orderBy(F.desc(score), *order).limit(1)


def best_per(df: DataFrame, score: str, groups: list[str], *order: str) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*groups).orderBy(F.desc(score), *order))).where("_r = 1").drop("_r")


def preferred(vulnerable: list[Column], safe: list[Column]) -> Column:
    """1 if the best score of the one side is strictly above that of the other."""
    top = lambda cs: F.greatest(*cs) if len(cs) > 1 else cs[0]
    return F.when(top(vulnerable) > top(safe), 1).otherwise(0)
