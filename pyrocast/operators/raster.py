"""Rasters in long form: resampling, lines of cells, scaling to bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resample(pixels: DataFrame, image: str, width: int, height: int, interpolate: bool) -> DataFrame:
    """image, x, y, value of a grid whose origin is at the bottom left. pixels: image, row, col, value (row 0 at the top).

    Nearest: the pixel whose area holds the cell's corner. Bilinear: between the four pixels around
    the cell's place, edges repeated. Cells join the pixels they need by equal keys.
    """
    size = pixels.groupBy(image).agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))
    cells = size.select("*", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    if not interpolate:
        at = cells.withColumn("col", F.floor(F.col("x") * F.col("cols") / width)).withColumn("row", F.col("rows") - 1 - F.floor(F.col("y") * F.col("rows") / height))
        return at.join(pixels, [image, "row", "col"]).select(image, "x", "y", "value")
    fx = F.col("x") * (F.col("cols") - 1) / max(1, width - 1) if width > 1 else F.lit(0.0)
    fy = F.col("y") * (F.col("rows") - 1) / max(1, height - 1) if height > 1 else F.lit(0.0)
    at = cells.withColumn("fx", fx).withColumn("fy", fy).withColumn("c", F.floor("fx")).withColumn("r", F.floor("fy"))
    corners = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (0, 1) for j in (0, 1)])
    near = at.withColumn("k", F.explode(corners))
    near = near.withColumn("w", (1 - F.abs(F.col("fx") - F.col("c") - F.col("k.dx"))) * (1 - F.abs(F.col("fy") - F.col("r") - F.col("k.dy"))))
    near = near.withColumn("col", F.least(F.col("c") + F.col("k.dx"), F.col("cols") - 1)).withColumn("row", F.col("rows") - 1 - F.least(F.col("r") + F.col("k.dy"), F.col("rows") - 1))
    return near.join(pixels, [image, "row", "col"]).groupBy(image, "x", "y").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def line_cells(x0: str, y0: str, x1: str, y1: str) -> Column:
    """Cells of a Bresenham line from one end to the other: array of (i, x, y).

    The error term's walk in closed form: after i steps along the longer axis the other one has moved
    by the rounded share, halves away from the start.
    """
    dx, dy = f"abs({x1} - {x0})", f"abs({y1} - {y0})"
    n = f"greatest({dx}, {dy})"
    minor = f"CASE WHEN {n} = 0 THEN 0 ELSE (2 * i * least({dx}, {dy}) + {n} - 1) DIV (2 * {n}) END"
    x = f"{x0} + sign({x1} - {x0}) * (CASE WHEN {dx} >= {dy} THEN i ELSE {minor} END)"
    y = f"{y0} + sign({y1} - {y0}) * (CASE WHEN {dx} >= {dy} THEN {minor} ELSE i END)"
    return F.expr(f"transform(sequence(0, CAST({n} AS INT)), i -> named_struct('i', i, 'x', CAST({x} AS INT), 'y', CAST({y} AS INT)))")


def two_bytes(values: DataFrame, group: str, value: str) -> DataFrame:
    """Values scaled to 16 bits by the least and largest of their group, as high and low byte; 0 where all are equal."""
    ends = values.groupBy(group).agg(F.min(value).alias("__a"), F.max(value).alias("__b"))
    scaled = F.when(F.col("__b") > F.col("__a"), F.floor((F.col(value) - F.col("__a")) / (F.col("__b") - F.col("__a")) * 65535)).otherwise(0).cast("int")
    rows = values.join(ends, group).withColumn("__s", scaled)
    return rows.withColumn("high", F.shiftright("__s", 8)).withColumn("low", F.col("__s").bitwiseAND(255)).drop("__a", "__b", "__s")
