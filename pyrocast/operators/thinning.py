"""Thinning of a whole table from the last row kept, by links and pointer doubling.

The rows kept are a chain: each leads to the first later row that is far enough in time and place. This
successor depends on the row alone, so it is found for all rows at once, and the chain from the first
row is followed in rounds that double its known length. A successor is looked for in an index of the
rows in order: nodes of 64 rows, nodes of 64 such nodes, and so on, each with the box around its rows. A
node whose box is all near is passed over, so long stretches near one place cost a few steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.physics import haversine_km
from ..session import written
from .ordering import numbered, running

_WIDE = 64


def _index(rows: DataFrame, n: int) -> tuple[DataFrame, int]:
    """(nodes: level, node, kids (place, box of each child, by place); the top level) of rows (i, lat, lon) from 0 to n - 1."""
    kids = rows.select(F.col("i").alias("id"), F.col("lat").alias("s"), F.col("lat").alias("n"), F.col("lon").alias("w"), F.col("lon").alias("e"))
    levels, level = [], 0
    while True:
        node = F.floor(F.col("id") / _WIDE).alias("node")
        kid = F.struct((F.col("id") % _WIDE).cast("int").alias("at"), "s", "n", "w", "e")
        grouped = written(kids.groupBy(node).agg(F.sort_array(F.collect_list(kid)).alias("kids")))  # at most _WIDE children
        levels.append(grouped.select(F.lit(level).alias("level"), "node", "kids"))
        n = -(-n // _WIDE)
        if n <= 1:
            break
        level += 1
        end = lambda f, c: f(F.transform("kids", lambda k: k[c])).alias(c)
        kids = grouped.select(F.col("node").alias("id"), end(F.array_min, "s"), end(F.array_max, "n"), end(F.array_min, "w"), end(F.array_max, "e"))
    nodes = levels[0]
    for rows in levels[1:]:
        nodes = nodes.unionByName(rows)
    return nodes, level


def _successors(starts: DataFrame, nodes: DataFrame, top: int, km: float) -> DataFrame:
    """i, next: the first row from `start` on and before `end` that is at least km away; starts: i, lat, lon, start, end."""
    # a box is all near if its corners are, for boxes that are not wide
    corners = ", ".join(haversine_km("lat", "lon", f"k.{a}", f"k.{b}") for a in "sn" for b in "we")
    far = f"(k.e - k.w > 1 OR CASE WHEN k.s = k.n AND k.w = k.e THEN {haversine_km('lat', 'lon', 'k.s', 'k.w')} ELSE greatest({corners}) END >= {km})"
    first = F.get(F.expr(f"filter(kids, k -> k.at >= since AND {far})"), F.lit(0))["at"]
    left = starts.filter("start < end").select("i", "lat", "lon", "end", F.lit(0).alias("level"), F.floor(F.col("start") / _WIDE).alias("node"), (F.col("start") % _WIDE).cast("int").alias("since"))
    found = []
    while True:
        step = written(left.join(nodes, ["level", "node"]).withColumn("hit", first).drop("kids"))
        at = F.col("node") * _WIDE + F.col("hit")
        found.append(step.filter("level = 0 AND hit IS NOT NULL").select("i", at.alias("next"), "end").filter("next < end").drop("end"))
        down = step.filter("level > 0 AND hit IS NOT NULL").select("i", "lat", "lon", "end", (F.col("level") - 1).alias("level"), at.alias("node"), F.lit(0).alias("since"))
        up = step.filter((F.col("hit").isNull()) & (F.col("level") < top))
        up = up.select("i", "lat", "lon", "end", (F.col("level") + 1).alias("level"), F.floor(F.col("node") / _WIDE).alias("node"), (F.col("node") % _WIDE + 1).cast("int").alias("since"))
        # what stands at or behind the end of the row's key is not looked at
        begins = (F.col("node") * _WIDE + F.col("since")) * F.pow(F.lit(_WIDE), F.col("level"))
        left = down.unionByName(up).filter(begins < F.col("end"))
        if left.isEmpty():
            out = found[0]
            for rows in found[1:]:
                out = out.unionByName(rows)
            return out


def chain(starts: DataFrame, links: DataFrame) -> DataFrame:
    """i of all rows that links (i, next) lead to from starts (i), these included; each row has at most one link, and no circle is made."""
    jump = written(links.join(links.select(F.col("next").alias("i")).unionByName(starts).distinct(), "i", "left_semi"))
    known = starts
    while True:
        # known holds the first 2**k rows of each chain, jump leads 2**k rows on
        new = written(known.join(jump, "i").select(F.col("next").alias("i")))
        if new.isEmpty():
            return known
        known = known.unionByName(new)
        jump = written(jump.join(jump.select(F.col("i").alias("next"), F.col("next").alias("then")), "next").select("i", F.col("then").alias("next")))


def thin_all(rows: DataFrame, order: list[str], lat: str, lon: str, at: str, km: float, hours: float, keys: list[str] = ()) -> DataFrame:
    """Rows kept greedily: the first, then each that is at least km and hours from the last one kept; for each key, or of the whole table.

    Gives keys, order, at, lat, lon of the rows kept, as folds.thin does, but holds no key in one group.
    order begins with at. Rows without a time or place are left out; of rows equal in all of these one is kept at most.
    """
    assert order[0] == at
    keys = list(keys)
    fields = list(dict.fromkeys([*keys, *order, at, lat, lon]))
    rows = rows.filter(" AND ".join(f"{c} IS NOT NULL" for c in (*keys, lat, lon, at))).select(*fields).distinct()
    rows = written(numbered(rows, [F.col(c) for c in (*keys, *order)], "i"))
    time = F.unix_micros(F.col(at).cast("timestamp"))
    ends = rows.groupBy(*keys).agg((F.max("i") + 1).alias("end"), F.min("i").alias("first"))
    n = rows.count()
    if not n:
        return rows.drop("i")
    # the first row that is late enough: as many rows stand before it as have an earlier time
    both = rows.select(*keys, time.alias("t"), F.lit(1).alias("row"), F.lit(0).cast("long").alias("i"))
    both = both.unionByName(rows.select(*keys, (time + int(hours * 3_600_000_000)).alias("t"), F.lit(0).alias("row"), "i"))
    late = running(both, [*[F.col(c) for c in keys], F.col("t"), F.col("row"), F.col("i")], F.col("row"), "start").filter("row = 0").select("i", "start")
    placed = rows.select(*keys, "i", F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    starts = placed.join(late, "i")
    starts = starts.join(ends.drop("first"), keys) if keys else starts.withColumn("end", F.lit(n))
    nodes, top = _index(placed.select("i", "lat", "lon"), n)
    links = written(_successors(starts.select("i", "lat", "lon", "start", "end"), nodes, top, km))
    kept = chain(written(ends.select(F.col("first").alias("i"))), links)
    return rows.join(kept, "i", "left_semi").drop("i")
