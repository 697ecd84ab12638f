"""Polygons from GeoJSON, and points in them by tiles.

A polygon's edges are rows. Tiles of a grid are edge tiles where an edge may pass, inside tiles
where none does and the tile's middle is inside, and else outside. Points join their tile: those of
inside tiles are in, those of edge tiles alone are tested against edges, and only against those of their row of tiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written

_RING = "array<array<array<double>>>"
_GEOJSON = "features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"


def geojson(spark: SparkSession, path: str, name: str = "NAME") -> DataFrame:
    """name, part, ring (from 0; the first of a part is its outer one), points (array of [x, y]) of the polygons of a FeatureCollection.

    Features of other kinds are left out. Polygons of one name belong together.
    """
    rows = spark.read.schema(_GEOJSON).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    parts = F.when(kind == "Polygon", F.array(F.from_json(text, _RING))).when(kind == "MultiPolygon", F.from_json(text, f"array<{_RING}>"))
    rows = rows.select(F.col("f.properties")[name].alias("name"), F.posexplode(parts).alias("part", "rings"))
    return rows.select("name", "part", F.posexplode("rings").alias("ring", "points"))


def edges(rings: DataFrame) -> DataFrame:
    """name, x1, y1, x2, y2: the edges of rings, closed or not; level ones are left out, as no level ray crosses them.

    A name's holes and parts need no signs: a point is inside if a ray crosses an odd number of all edges.
    """
    p = F.col("points")
    n = F.size(p)
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(*[F.get(F.get(p, F.pmod(i + k, n)), F.lit(c)).alias(f"{'xy'[c]}{k + 1}") for k in (0, 1) for c in (0, 1)]))
    return rings.filter(n > 2).select("name", F.explode(each).alias("e")).select("name", "e.*").filter("y1 <> y2")


def _cell(x: Column, size: float) -> Column:
    return F.floor(x / size)


def tiles(rows: DataFrame, size: float) -> tuple[DataFrame, DataFrame]:
    """(tiles: name, ty, tx, inside; edges by row: name, ty, x1, y1, x2, y2) of edges (name, x1, y1, x2, y2), with tiles of so many degrees.

    inside is false for edge tiles; outside tiles are not listed.
    """
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = rows.withColumn("ty", F.explode(F.sequence(_cell(low, size), _cell(high, size))))
    # the part of an edge in its row of tiles, a little wider than it is
    x_at = lambda y: F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    a, b = x_at(F.greatest(low, F.col("ty") * size)), x_at(F.least(high, (F.col("ty") + 1) * size))
    ends = F.least("x1", "x2"), F.greatest("x1", "x2")
    west, east = F.greatest(F.least(a, b), ends[0]) - 1e-9, F.least(F.greatest(a, b), ends[1]) + 1e-9
    touched = rows.select("name", "ty", F.explode(F.sequence(_cell(west, size), _cell(east, size))).alias("tx")).distinct()
    # where the middle line of a row of tiles crosses edges; from one crossing to the next the line is inside
    middle = (F.col("ty") + 0.5) * size
    crossed = rows.filter((F.col("y1") < middle) != (F.col("y2") < middle)).select("name", "ty", x_at(middle).alias("x"))
    order = Window.partitionBy("name", "ty").orderBy("x")
    spans = crossed.withColumns({"k": F.row_number().over(order), "to": F.lead("x").over(order)}).filter("k % 2 = 1 AND to IS NOT NULL")
    first, last = F.ceil(F.col("x") / size - 0.5), F.floor(F.col("to") / size - 0.5)
    within = spans.filter(first <= last).select("name", "ty", F.explode(F.sequence(first, last)).alias("tx"))
    kinds = touched.withColumn("inside", F.lit(False)).unionByName(within.join(touched, ["name", "ty", "tx"], "left_anti").withColumn("inside", F.lit(True)))
    return kinds, rows.select("name", "ty", "x1", "y1", "x2", "y2")


def inside(points: DataFrame, rings: DataFrame, x: str, y: str, size: float = 0.25) -> DataFrame:
    """points with name: a row for each point and each name whose polygons hold it; rings: as of geojson.

    A point is inside if the ray to the right crosses an odd number of edges (a point on a border may be either).
    Points without a place are in none. The columns of points other than name stay; points needn't differ.
    """
    kinds, by_row = tiles(written(edges(rings)), size)
    kinds, by_row = written(kinds), written(by_row)
    placed = points.drop("name").withColumns({"__id": F.monotonically_increasing_id(), "ty": _cell(F.col(y), size), "tx": _cell(F.col(x), size)})
    placed = written(placed.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).join(kinds, ["ty", "tx"]))
    sure = placed.filter("inside")
    # a name's edges in one row of tiles are few; the sum is made before rows meet again
    crosses = ((F.col("y1") < F.col(y)) != (F.col("y2") < F.col(y))) & (F.col(x) < F.col("x1") + (F.col(y) - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    near = placed.filter("NOT inside")
    odd = near.select("__id", "name", "ty", x, y).join(by_row, ["name", "ty"]).filter(crosses).groupBy("__id", "name").agg(F.count("*").alias("n")).filter("n % 2 = 1").select("__id", "name")
    return sure.unionByName(near.join(odd, ["__id", "name"], "left_semi")).drop("__id", "ty", "tx", "inside")
