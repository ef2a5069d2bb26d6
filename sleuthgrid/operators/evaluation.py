"""Predictions against gold labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scores(predicted: DataFrame, expected: DataFrame, keys: list[str], by: str | None = None) -> DataFrame:
    """true_positives, false_positives, false_negatives, precision, recall, f1 (4 places) of predicted against expected rows (keys, and by): in all, or for each value of by. Repeated rows count once; 0 where nothing could be right."""
    columns = [*keys, *([by] if by else [])]
    rows = predicted.select(*columns).distinct().withColumn("p", F.lit(1)).unionByName(expected.select(*columns).distinct().withColumn("p", F.lit(2)))
    each = rows.groupBy(*columns).agg(F.sum("p").alias("p"))
    counts = each.groupBy(*([by] if by else [])).agg(F.count_if(F.col("p") == 3).alias("true_positives"), F.count_if(F.col("p") == 1).alias("false_positives"), F.count_if(F.col("p") == 2).alias("false_negatives"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    return counts.withColumns({"precision": F.round(share(tp, tp + fp), 4), "recall": F.round(share(tp, tp + fn), 4), "f1": F.round(share(2 * tp, 2 * tp + fp + fn), 4)})
