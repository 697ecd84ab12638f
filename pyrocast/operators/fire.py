"""Grid fire spread: cells in long form, one step as joins, whole episodes by episode."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.physics import spread_columns

UNBURNT, BURNING, BURNT = 0, 1, 2
MIN_BURN_TIME = 200.0
NEIGHBOUR_DISTANCE = 2.5


def offsets(distance: float = NEIGHBOUR_DISTANCE) -> list[tuple[int, int]]:
    """Steps to all cells within a distance."""
    r = int(distance)
    return [(x, y) for y in range(-r, r + 1) for x in range(-r, r + 1) if (x or y) and x * x + y * y <= distance * distance]


def line(x0: int, y0: int, x1: int, y1: int) -> list[tuple[int, int]]:
    """Cells of a line, both ends included: of two equally near cells beside the longer axis the one nearer the start."""
    dx, dy = abs(x1 - x0), abs(y1 - y0)
    n = max(dx, dy)
    minor = [(2 * i * min(dx, dy) + n - 1) // (2 * n) if n else 0 for i in range(n + 1)]
    steps = [(i, m) if dx >= dy else (m, i) for i, m in enumerate(minor)]
    return [(x0 + (a if x1 > x0 else -a), y0 + (b if y1 > y0 else -b)) for a, b in steps]


def _reach(distance: float):
    """An array column of steps within a distance, each with the cells on its line from the far end to the near one."""
    cells = [F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy"), F.array(*[F.struct(F.lit(a).alias("lx"), F.lit(b).alias("ly")) for a, b in line(x, y, 0, 0)[:-1]]).alias("line")) for x, y in offsets(distance)]
    return F.array(*cells)


def neighbours(sources: DataFrame, cells: DataFrame, distance: float = NEIGHBOUR_DISTANCE) -> DataFrame:
    """Rows of sources (episode, sx, sy, ...) with dx, dy, x, y for each burnable cell in sight within a distance.

    cells: episode, x, y, burnable. A cell is in sight if no cell that cannot burn lies on the line
    to it: the lines' cells are joined with those, and what they hit is taken out.
    """
    reach = sources.withColumn("o", F.explode(_reach(distance)))
    reach = reach.select(*sources.columns, (F.col("sx") + F.col("o.dx")).alias("x"), (F.col("sy") + F.col("o.dy")).alias("y"), "o.dx", "o.dy", "o.line")
    walls = cells.filter(~F.col("burnable")).select("episode", F.col("x").alias("wx"), F.col("y").alias("wy"))
    steps = reach.select("episode", "sx", "sy", "x", "y", F.explode("line").alias("l")).withColumns({"wx": F.col("sx") + F.col("l.lx"), "wy": F.col("sy") + F.col("l.ly")})
    hidden = steps.join(walls, ["episode", "wx", "wy"]).select("episode", "sx", "sy", "x", "y").distinct()
    return reach.drop("line").join(cells.filter("burnable").select("episode", "x", "y"), ["episode", "x", "y"], "left_semi").join(hidden, ["episode", "sx", "sy", "x", "y"], "left_anti")


def spread_rate(pairs: DataFrame) -> DataFrame:
    """pairs with spread_rate; columns as spread_columns expects them."""
    names = pairs.columns
    for name, expression in spread_columns():
        pairs = pairs.withColumn(name, F.expr(expression))
    return pairs.select(*names, "spread_rate")


def step(cells: DataFrame, time: float, wind: float, wind_dir: float, cell_size: float) -> DataFrame:
    """The cells of all episodes one step later, as one job.

    cells: episode, x, y, elevation, moisture, sav, beta, load, mx, depth, burnable, state,
    ignition (infinity: none), burn_time, rate. Burning cells whose time is over are burnt; unburnt
    cells whose ignition has come burn, and relax the unburnt cells around them: earliest ignition,
    shortest burn time by it, largest rate.
    """
    now = F.when((F.col("state") == BURNING) & (time - F.col("ignition") > F.col("burn_time")), BURNT)
    now = now.when((F.col("state") == UNBURNT) & (time > F.col("ignition")), BURNING).otherwise(F.col("state"))
    moved = cells.withColumn("next", now)
    lit = moved.filter((F.col("state") == UNBURNT) & (F.col("next") == BURNING)).select("episode", F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("elevation").alias("sz"), F.col("ignition").alias("since"))
    reach = neighbours(lit, cells).drop("sx", "sy")
    targets = cells.filter(F.col("state") == UNBURNT)
    pairs = reach.join(targets, ["episode", "x", "y"]).withColumns({"dz": F.col("elevation") - F.col("sz"), "wind": F.lit(wind), "wind_dir": F.lit(wind_dir), "cell_size": F.lit(cell_size)})
    rated = spread_rate(pairs).withColumn("due", F.col("since") + F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) * cell_size / F.col("spread_rate"))
    new = rated.groupBy("episode", "x", "y").agg(F.min("due").alias("due"), F.min(F.col("due") - F.col("since") + MIN_BURN_TIME).alias("short"), F.max("spread_rate").alias("fast"))
    out = moved.join(new, ["episode", "x", "y"], "left").withColumn("state", F.col("next")).drop("next")
    out = out.withColumn("ignition", F.least("ignition", F.coalesce("due", "ignition"))).withColumn("burn_time", F.least("burn_time", F.coalesce("short", "burn_time")))
    return out.withColumn("rate", F.greatest("rate", F.coalesce("fast", "rate"))).select(*cells.columns)


def _rates(dx, dy, dz, moisture, fuel, wind, wind_dir, cell_size):
    """spread_columns on arrays."""
    scope = {"dx": dx, "dy": dy, "dz": dz, "moisture": moisture, "wind": wind, "wind_dir": wind_dir, "cell_size": cell_size, **fuel}
    beta_rel = scope["beta"] / (3.348 * scope["sav"] ** -0.8189)
    sav, beta, load, mx, depth = (scope[k] for k in ("sav", "beta", "load", "mx", "depth"))
    fa, fb, fc, fe = 133 * sav**-0.7913, 0.02526 * sav**0.54, 7.47 * np.exp(-0.133 * sav**0.55), 0.715 * (-0.000359 * sav)
    velocity = sav**1.5 / (495 + 0.0594 * sav**1.5) * beta_rel**fa * np.exp(fa * (1 - beta_rel))
    mr = moisture / mx
    damping = (1 - 2.59 * mr + 5.11 * mr**2 - 3.52 * mr**3) * 0.174 * 0.01**-0.19
    flux = np.exp((0.792 + 0.681 * np.sqrt(sav)) * (beta + 0.1)) / (192 + 0.2595 * sav)
    r0 = velocity * load * 8000 * damping * flux / (load / (1 - 0.0555) / depth * np.exp(-138 / sav) * (250 + 1116 * moisture))
    run = np.sqrt(dx * dx + dy * dy)
    push, climb = r0 * fc * (wind * 88) ** fb * beta_rel**-fe, r0 * 5.275 * beta**-0.3 * (dz / (run * cell_size)) ** 2
    up, a = np.where(dz >= 0, 1, -1), math.radians(wind_dir)
    vx, vy = push * -math.sin(a) + climb * up * dx / run, push * -math.cos(a) + climb * up * dy / run
    rh = r0 + np.sqrt(vx * vx + vy * vy)
    effective = ((rh / r0 - 1) / (fc * beta_rel**-fe)) ** (1 / fb)
    z = 1 + 0.25 * effective / 88
    e = np.sqrt(z * z - 1) / z
    turn = np.abs(np.arctan2(dy, dx) % (2 * np.pi) - np.arctan2(vy, vx) % (2 * np.pi))
    return rh * (1 - e) / (1 - e * np.cos(turn))


def simulate(cells: DataFrame, times: list[float], wind: float, wind_dir: float, cell_size: float) -> DataFrame:
    """episode, time, unburnt, burning, burnt after each of the times: step, again and again, one episode to a group.

    An episode is one grid of bounded size; episodes are spread over the cluster.
    """
    around = np.array(offsets())
    lines = [np.array(line(x, y, 0, 0)[:-1]) for x, y in offsets()]
    fuel_names = ["sav", "beta", "load", "mx", "depth"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w, h = int(pdf["x"].max()) + 1, int(pdf["y"].max()) + 1
        pdf = pdf.sort_values(["y", "x"])
        grid = {c: pdf[c].to_numpy().reshape(h, w) for c in ("elevation", "moisture", "burnable", *fuel_names)}
        state, ignition, burn = (pdf[c].to_numpy(dtype=t).reshape(h, w).copy() for c, t in (("state", int), ("ignition", float), ("burn_time", float)))
        rows = []
        for time in times:
            over, lit = (state == BURNING) & (time - ignition > burn), (state == UNBURNT) & (time > ignition)
            new_ignition, new_burn = ignition.copy(), burn.copy()
            ys, xs = np.nonzero(lit)
            if len(ys):
                ty, tx = ys[:, None] + around[:, 1], xs[:, None] + around[:, 0]
                ok = (ty >= 0) & (ty < h) & (tx >= 0) & (tx < w)
                s, o = np.nonzero(ok)
                ty, tx = ty[s, o], tx[s, o]
                free = state[ty, tx] == UNBURNT
                for k, cells_on in enumerate(lines):
                    mine = np.flatnonzero(o == k)
                    for lx, ly in cells_on:
                        free[mine] &= grid["burnable"][ys[s[mine]] + ly, xs[s[mine]] + lx]
                s, o, ty, tx = s[free], o[free], ty[free], tx[free]
                dx, dy = around[o, 0].astype(float), around[o, 1].astype(float)
                dz = grid["elevation"][ty, tx] - grid["elevation"][ys[s], xs[s]]
                rate = _rates(dx, dy, dz, grid["moisture"][ty, tx], {k: grid[k][ty, tx] for k in fuel_names}, wind, wind_dir, cell_size)
                since = ignition[ys[s], xs[s]]
                due = since + np.sqrt(dx * dx + dy * dy) * cell_size / rate
                np.minimum.at(new_ignition, (ty, tx), due)
                np.minimum.at(new_burn, (ty, tx), due - since + MIN_BURN_TIME)
            state[over], state[lit] = BURNT, BURNING
            ignition, burn = new_ignition, new_burn
            rows.append((pdf["episode"].iloc[0], time, *[int((state == k).sum()) for k in (UNBURNT, BURNING, BURNT)]))
        return pd.DataFrame(rows, columns=["episode", "time", "unburnt", "burning", "burnt"])

    return cells.groupBy("episode").applyInPandas(run, "episode long, time double, unburnt long, burning long, burnt long")
