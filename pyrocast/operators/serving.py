"""Forecast serving: stitched series, derived humidity, model input, probability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import physics as P
from . import timeseries as S


def stitched(requests: DataFrame, history: DataFrame, forecast: DataFrame, features: list[str], before: int = 60, after: int = 14) -> DataFrame:
    """request_id, day and a column for each feature over the whole window, without gaps inside it.

    requests: request_id, cell, at (date); history and forecast: cell, feature, day, value. Of a
    feature and day that both have, history wins. Gaps are filled in proportion to time, ends with
    the nearest value.
    """
    days = S.calendar(requests, F.date_add("at", -before), F.date_add("at", after))
    both = history.withColumn("source", F.lit(0)).unionByName(forecast.withColumn("source", F.lit(1)))
    best = S.first_by_priority(both, ["cell", "feature", "day"], [F.col("source")]).drop("source")
    names = days.select("request_id", "cell", "at", "day", F.explode(F.array(*map(F.lit, features))).alias("feature"))
    filled = S.interpolate(names.join(best, ["cell", "feature", "day"], "left"), ["request_id", "feature"], "day", "value")
    return filled.groupBy("request_id", "at", "day").pivot("feature", features).agg(F.first("filled"))


def with_humidity(rows: DataFrame) -> DataFrame:
    """rmax and rmin from temperatures and vpd where they are missing."""
    for name, kelvin in (("rmax", "tmmn"), ("rmin", "tmmx")):
        known = F.col("tmmn").isNotNull() & F.col("tmmx").isNotNull() & F.col("vpd").isNotNull()
        rows = rows.withColumn(name, F.coalesce(name, F.when(known, F.expr(P.relative_humidity(kelvin, "(tmmn + tmmx) / 2", "vpd")))))
    return rows


def model_input(rows: DataFrame, features: list[str], scaling: dict[str, tuple[float, float]]) -> DataFrame:
    """request_id, tensor: scaled features and the request's month as sine and cosine, a row for each day in order."""
    sin, cos = P.month_angle("month(at)")
    scaled = [(F.col(f).cast("double") - scaling.get(f, (0.0, 1.0))[0]) / scaling.get(f, (0.0, 1.0))[1] for f in features]
    row = F.struct("day", F.array(*scaled, F.expr(sin), F.expr(cos)).alias("x"))
    return rows.groupBy("request_id").agg(F.sort_array(F.collect_list(row)).alias("rows")).select("request_id", F.col("rows.x").alias("tensor"))


def predict(inputs: DataFrame, weights: list[float], bias: float = 0.0, threshold: float = 0.5) -> DataFrame:
    """probability and label of a linear stand-in for the model: the mean of its days' weighted features."""
    w = F.array(*map(F.lit, weights))
    each = F.transform("tensor", lambda x: F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    logit = F.aggregate(each, F.lit(0.0), lambda s, v: s + v) / F.size("tensor") + bias
    out = inputs.withColumn("probability", 1 / (1 + F.exp(-logit)))
    return out.select("request_id", "probability", (F.col("probability") > threshold).alias("wildfire"))
