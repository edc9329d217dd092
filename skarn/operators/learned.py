"""A logistic reranker: fitting with Spark ML, scoring as one expression."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def logistic_score(features: dict[str, float], bias: float, means: dict[str, float] | None = None, scales: dict[str, float] | None = None) -> Column:
    """Sigmoid of the weighted, standardised features; a null feature counts as its mean."""
    means, scales = means or {}, scales or {}
    terms = [(F.coalesce(F.col(c), F.lit(means.get(c, 0.0))) - means.get(c, 0.0)) / (scales.get(c) or 1.0) * w for c, w in features.items()]
    return 1 / (1 + F.exp(-reduce(add, terms, F.lit(bias))))


def fit_logistic(rows: DataFrame, features: list[str], label: str, penalty: float = 0.01) -> Column:
    """The fitted score as an expression over ``features`` (means and scales of the fitting rows inside).

    Standard deviations of 0 count as 1. Needs rows of both labels.
    """
    filled = rows.select(F.col(label).cast("double").alias("__y"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    stats = filled.agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features]).first()
    means, scales = {c: stats[f"m_{c}"] for c in features}, {c: stats[f"s_{c}"] or 1.0 for c in features}
    scaled = filled.select("__y", *[((F.col(c) - means[c]) / scales[c]).alias(c) for c in features])
    model = LogisticRegression(featuresCol="__x", labelCol="__y", regParam=penalty, standardization=False).fit(VectorAssembler(inputCols=features, outputCol="__x").transform(scaled))
    return logistic_score(dict(zip(features, map(float, model.coefficients), strict=True)), float(model.intercept), means, scales)
