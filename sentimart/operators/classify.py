"""Classify scores into buckets by thresholds (V7, V8).

Same contract as ``pyspark.ml.feature.Bucketizer`` with the default
``handleInvalid='error'``: bucket ``k`` holds ``[splits[k], splits[k+1])``,
the last bucket is closed, NULL stays NULL, and NaN or a value outside the
splits raises. It is written as a ``CASE`` so the plan stays inside
whole-stage codegen and is visible to the optimizer.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentimart.schema import THRESHOLDS_DEFAULT


def check_splits(splits: list[float]) -> list[float]:
    splits = [float(s) for s in splits]
    if len(splits) < 3:
        raise ValueError(f"need at least 3 splits (2 buckets), got {splits}")
    if any(math.isnan(s) for s in splits):
        raise ValueError("splits must not be NaN")
    if any(b <= a for a, b in zip(splits, splits[1:])):
        raise ValueError(f"splits must be strictly increasing, got {splits}")
    return splits


def bucket(score: Column, splits: list[float]) -> Column:
    """Bucket index as a double, like Bucketizer."""
    splits = check_splits(splits)
    lo, hi = splits[0], splits[-1]
    invalid = F.raise_error(F.concat(
        F.lit("score out of the bucket range or NaN: "), score.cast("string")))
    expr = F.when(score.isNull(), F.lit(None).cast("double"))
    expr = expr.when(F.isnan(score) | (score < F.lit(lo)) | (score > F.lit(hi)),
                     invalid.cast("double"))
    for k, upper in enumerate(splits[1:-1]):
        expr = expr.when(score < F.lit(upper), F.lit(float(k)))
    return expr.otherwise(F.lit(float(len(splits) - 2)))


def classify(df: DataFrame, score_col: str = "vaderScore", out_col: str = "vaderClassifier",
             thresholds: list[float] | None = None) -> DataFrame:
    return df.withColumn(out_col, bucket(F.col(score_col), thresholds or THRESHOLDS_DEFAULT))
