"""Thinning, polygons, axes, geodesics, outlines and slabs against plain versions on rows made to be awkward."""

import json
import math
import random
import shutil
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pyrocast.functions import physics as P
from pyrocast.operators import folds, outline, polygons, reports, samples, spatial, thinning
from pyrocast.sources import slabs

START = datetime(2020, 1, 1)


def km(a, b):
    la, lo, lb, lp = map(math.radians, (*a, *b))
    x = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1, x)))


def thinned(rows, far, hours):
    """Rows (key, at, id, lat, lon) by one fold over each key."""
    kept, last = [], {}
    for r in sorted(set(rows), key=lambda r: r[:3]):
        if r[0] not in last or ((r[1] - last[r[0]][1]).total_seconds() >= hours * 3600 and km(r[3:], last[r[0]][3:]) >= far):
            kept.append(r)
            last[r[0]] = r
    return kept


@pytest.mark.parametrize("wide,keys", [(64, []), (4, []), (3, ["key"])])
def test_thinning_by_a_fold(spark, monkeypatch, wide, keys):
    """Long stretches at one place, over the date line, equal times, repeated rows; by key and of all."""
    monkeypatch.setattr(thinning, "_WIDE", wide)
    rng = random.Random(wide)
    rows, at = [], START
    for i in range(400):
        at += timedelta(minutes=rng.choice([0, 1, 30, 59, 60, 120]))
        lat, lon = (10.0 + rng.random() * 0.01, 179.999 + rng.random() * 0.0005) if 60 < i < 300 and rng.random() < 0.98 else (10.0 + rng.random() / 5, rng.choice([179.95, -179.95, -179.99]) + rng.random() / 50)
        rows.append((rng.randint(0, 3) if keys else 0, at, i, lat, lon))
    rows += rows[5:9]
    df = spark.createDataFrame([*rows, (0, None, 900, 1.0, 1.0), (0, START, 901, None, 1.0)], "key int, at timestamp, id int, lat double, lon double").repartition(5)
    got = thinning.thin_all(df, ["at", "id"], "lat", "lon", "at", 5, 2, keys).select("id").collect()
    assert sorted(r.id for r in got) == sorted(r[2] for r in thinned(rows, 5, 2))
    assert thinning.thin_all(df.limit(0), ["at", "id"], "lat", "lon", "at", 5, 2, keys).count() == 0


def test_positives_of_the_whole_table(spark):
    """Rows over the edge of what were tiles know of one another."""
    rows = [(34.999, -100.0, START), (35.001, -100.0, START + timedelta(hours=3)), (35.2, -100.0, START + timedelta(hours=6)), (35.2, -100.0, START + timedelta(hours=7))]
    df = spark.createDataFrame(rows, "lat double, lon double, discovered_at timestamp")
    assert sorted((r.lat, r.lon) for r in samples.positives(df).collect()) == [(34.999, -100.0), (35.2, -100.0)]


def inside(x, y, rings):
    n = 0
    for points in rings:
        for (x1, y1), (x2, y2) in zip(points, [*points[1:], points[0]]):
            n += (y1 < y) != (y2 < y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1)
    return n % 2 == 1


@pytest.mark.parametrize("size", [0.25, 1.0, 3.7])
def test_polygons_by_crossings(spark, tmp_path, size):
    """Rough rings with holes and islands, closed and open, against a test of every point with every edge."""
    rng = random.Random(int(size * 10))
    star = lambda x, y, r, n: [[x + r * (0.6 + 0.4 * rng.random()) * math.cos(2 * math.pi * k / n), y + r * (0.6 + 0.4 * rng.random()) * math.sin(2 * math.pi * k / n)] for k in range(n)]
    shapes = {"A": [[star(0, 0, 5, 200), star(0, 0, 1.5, 30)], [star(9, 1, 1, 12)]], "B": [[star(3, 2, 4, 90)]], "C": [[[[-7.0, -7.0], [-5.0, -7.0], [-5.0, -5.0], [-7.0, -5.0], [-7.0, -7.0]]]]}
    features = [{"type": "Feature", "properties": {"NAME": n, "n": 1}, "geometry": {"type": "MultiPolygon", "coordinates": c} if len(c) > 1 else {"type": "Polygon", "coordinates": c[0]}} for n, c in shapes.items()]
    features.append({"type": "Feature", "properties": {"NAME": "P"}, "geometry": {"type": "Point", "coordinates": [1, 2]}})
    (tmp_path / "w.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    points = [(i, rng.uniform(-11, 11), rng.uniform(-8, 8)) for i in range(3000)] + [(9000, None, 1.0)]
    df = spark.createDataFrame(points, "id int, x double, y double")
    rings = polygons.geojson(spark, str(tmp_path / "w.geojson"))
    got = sorted((r.id, r.name) for r in polygons.inside(df, rings, "x", "y", size).collect())
    assert got == sorted((i, n) for i, x, y in points if x is not None for n, parts in shapes.items() if inside(x, y, [ring for part in parts for ring in part]))
    kinds, _ = polygons.tiles(polygons.edges(rings), size)
    if size == 0.25:
        assert kinds.filter("inside").count() > kinds.filter("NOT inside").count() > 0


def test_nearest_of_irregular_axes(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        axis = [round(rng.uniform(-5, 5), 1) for _ in range(rng.randint(1, 12))]
        if rng.random() < 0.5:
            axis.sort(reverse=rng.random() < 0.5)
        rows.append((i, axis, round(rng.uniform(-7, 7), 1)))
    rows += [(900, [], 1.0), (901, [1.0], None)]
    df = spark.createDataFrame(rows, "id int, axis array<double>, v double")
    for r in df.select("*", spatial.nearest_index(F.col("v"), spatial.sorted_axis(F.col("axis"))).alias("i")).collect():
        want = None if r.v is None or not r.axis else min(range(len(r.axis)), key=lambda k: (abs(r.axis[k] - r.v), k))
        assert r.i == want, r


def test_axes_of_rows(spark):
    """Axes gathered from rows hold distinct points only, with the places that these have among all rows of their key; null points are never nearest."""
    rng = random.Random(2)
    rows = [(key, 7 * i + key, None if rng.random() < 0.1 else float(rng.randint(-4, 4))) for key in range(5) for i in range(rng.randint(1, 60))] + [(9, 1, None)]
    points, asked = spark.createDataFrame(rows, "key int, n long, x double").repartition(3), [k / 4 for k in range(-20, 21)]
    axes = spatial.axes(points, "key", "n", F.col("x"))
    by_key = {key: [x for k, _, x in sorted(rows, key=lambda r: r[:2]) if k == key] for key in {r[0] for r in rows}}
    want = {(key, v): min(((abs(x - v), i) for i, x in enumerate(xs) if x is not None), default=(0, None))[1] for key, xs in by_key.items() for v in asked}
    values = axes.withColumn("v", F.explode(F.array(*map(F.lit, asked))))
    assert {(r.key, r.v): r.i for r in values.select("key", "v", spatial.nearest_index(F.col("v"), F.col("axis")).alias("i")).collect()} == want
    assert all(len(r.axis) == len({x for x in by_key[r.key] if x is not None}) for r in axes.collect())
    whole = spark.createDataFrame([(key, xs, v) for key, xs in by_key.items() for v in asked], "key int, axis array<double>, v double")
    assert {(r.key, r.v): r.i for r in whole.select("key", "v", spatial.nearest_index(F.col("v"), spatial.sorted_axis(F.col("axis"))).alias("i")).collect()} == want


def test_axis_is_sorted_once(spark):
    """Not again for each of its points."""
    plan = spark.createDataFrame([([2.0, 1.0],)], "axis array<double>").select(spatial.sorted_axis(F.col("axis")).alias("a"))
    assert plan._jdf.queryExecution().analyzed().toString().count("array_sort(") == 1


def integrated(lat, lon, metres, bearing, a=6378137.0, f=1 / 298.257223563, steps=4000):
    """The geodesic's differential equations by Runge and Kutta."""
    e2 = f * (2 - f)

    def slope(phi, alpha):
        w = 1 - e2 * math.sin(phi) ** 2
        n, m = a / math.sqrt(w), a * (1 - e2) / w**1.5
        return np.array([math.cos(alpha) / m, math.sin(alpha) / (n * math.cos(phi)), math.sin(alpha) * math.tan(phi) / n])

    s, h = np.array([math.radians(lat), math.radians(lon), math.radians(bearing)]), metres / steps
    for _ in range(steps):
        k1 = slope(s[0], s[2])
        k2 = slope(s[0] + h / 2 * k1[0], s[2] + h / 2 * k1[2])
        k3 = slope(s[0] + h / 2 * k2[0], s[2] + h / 2 * k2[2])
        k4 = slope(s[0] + h * k3[0], s[2] + h * k3[2])
        s = s + h / 6 * (k1 + 2 * k2 + 2 * k3 + k4)
    return math.degrees(s[0]), math.degrees(s[1])


def test_geodesics(spark):
    """Within a millimetre of integrated geodesics, and of the surveyed line from Flinders Peak to Buninyong."""
    rows = [(40.0, -100.0, 0.1, 10.0), (40.0, -100.0, 100.0, 200.0), (-33.0, 151.0, 1500.0, 75.0), (0.0, 0.0, 900.0, 90.0), (60.0, 170.0, 1000.0, 80.0)]
    df = spark.createDataFrame(rows, "lat double, lon double, km double, b double")
    lat, lon = P.geodesic_point("lat", "lon", "km", "b")
    for r in df.select("*", F.expr(lat).alias("y"), F.expr(lon).alias("x")).collect():
        y, x = integrated(r.lat, r.lon, r.km * 1000, r.b)
        assert abs(r.y - y) < 1e-8 and abs(r.x - x) < 1e-8
    degrees = lambda d, m, s: math.copysign(abs(d) + m / 60 + s / 3600, d)
    lat, lon = P.geodesic_point(str(degrees(-37, 57, 3.72030)), str(degrees(144, 25, 29.52440)), "54.972271", str(degrees(306, 52, 5.37)), 6378.137, 1 / 298.257222101)
    r = spark.sql(f"SELECT {lat} AS y, {lon} AS x").first()
    assert abs(r.y - degrees(-37, 39, 10.15610)) < 1e-8 and abs(r.x - degrees(143, 55, 35.38390)) < 2e-8


def test_outline(spark):
    """Chapter labels, front matter, and headings that skip levels."""
    pages = [
        (1, 1, "Intro words stand here.\n\nCHAPTER 2\n\nSafety First\n\nkeep one foot in the black."),
        (1, 2, "Chapter 3\n\nplain text that follows a label.\n \nA Much Longer Heading With Many Words In It\n\nmore text here.\n\nUnit 9"),
        (1, 3, "the next page starts with text.\n\n\nESCAPE ROUTES\n\n   \n\nlast words."),
        (2, 1, "Table of Contents\nchapter 1\nunit 2"),
        (2, 2, "\n\n Chapter 1 \n\n"),
        (2, 3, "said under the label."),
    ]
    df = spark.createDataFrame(pages, "doc int, page int, text string")
    got = outline.chunks(df, "doc", "page", "text", F.lit(1), F.concat(F.lit("d"), "doc"), F.lit("general")).orderBy("doc", "n").collect()
    assert [(r.doc, r.n, r.path, r.text, r.page_start, r.page_end, r.chunk_id) for r in got] == [
        (1, 1, "Front Matter", "Intro words stand here.", 1, 1, "d1_front_matter_01"),
        (1, 2, "Front Matter > Safety First", "keep one foot in the black. plain text that follows a label.", 1, 2, "d1_safety_first_02"),
        (1, 3, "Chapter 3 > A Much Longer Heading With Many Words In It", "more text here. the next page starts with text.", 2, 3, "d1_a_much_longer_heading_with_many_words_in_it_03"),
        (1, 4, "ESCAPE ROUTES", "last words.", 3, 3, "d1_escape_routes_04"),
        (2, 1, "Chapter 1", "said under the label.", 3, 3, "d2_chapter_1_01"),
    ]
    assert got[1].domain == "safety" and got[0].domain == "general"


def packed(text, most):
    def segments(parts):
        done, now = [], ""
        for p in parts:
            if len(p) > most:
                done += [now] if now else []
                now = ""
                done += [p[i : i + most] for i in range(0, len(p), most)]
            elif not now:
                now = p
            elif len(now) + 1 + len(p) <= most:
                now += "\n" + p
            else:
                done, now = [*done, now], p
        return done + ([now] if now else [])

    import re

    done, now = [], ""
    for p in (" ".join(x.split()) for x in re.split(r"\n\s*\n", text)):
        sentences = re.split(r"(?<=[.!?])\s+", p)
        for part in [] if not p else [p] if len(p) <= most else segments(sentences) if len(sentences) > 1 else [p[i : i + most] for i in range(0, len(p), most)]:
            if now and len(now) + 2 + len(part) <= most:
                now += "\n\n" + part
            else:
                done += [now] if now else []
                now = part
    return done + ([now] if now else [])


def test_semantic_blocks(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("ab.!? \n\t", k=rng.randint(1, 9)))
    texts = ["", "  \n \n ", "one", "x" * 200, "a. " * 90, *["".join(word() + rng.choice(["\n\n", "\n \n", " ", ". "]) for _ in range(rng.randint(1, 60))) for _ in range(150)]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", folds.semantic_blocks("text", 40).alias("b"))
    for r in df.collect():
        assert list(r.b) == packed(texts[r.i], 40), texts[r.i]


def test_reports_of_few_words(spark):
    """A report without sections or labels has a name from its file alone; an empty value of a label counts as none."""
    pages = [(1, 1, "Location:\nRidge  top\nweather\nDry, windy.", "big_fire"), (2, 1, "", "none_here"), (3, 1, "Fire name: Elk\nhazards\nSnags.\nHazards\nRocks.", "x")]
    df = spark.createDataFrame(pages, "id int, page int, text string, file string")
    profiles, chunks = reports.ingest(df, "id", "page", "text", "file", F.lit("2024-01-02").cast("timestamp"))
    got = {r.id: r for r in profiles.collect()}
    assert (got[1].incident_name, got[1].location, got[1].weather, got[1].incident_id) == ("big fire", "Ridge top", "Dry, windy.", "big_fire_2024_01_02")
    assert (got[2].incident_name, got[2].location, got[2].unresolved_risks) == ("none here", "", "")
    assert (got[3].incident_name, got[3].safety_concerns, got[3].unresolved_risks) == ("Elk", "Rocks.", "Rocks.")
    assert [(r.id, r.chunk_id, r.section, r.text) for r in chunks.orderBy("id", "n").collect()][-2:] == [(3, "elk_2024_01_02_safety_concerns_02", "Safety Concerns", "Snags."), (3, "elk_2024_01_02_safety_concerns_03", "Safety Concerns", "Rocks.")]


def test_slabs_open_no_chunk_outside(spark, tmp_path):
    """Values as written, fill values and missing chunks as none; with filters, chunks and slabs outside may be broken."""
    lats, lons = [10.0 + i * i / 100 for i in range(30)], [50.0 - i / 2 for i in range(25)]
    rng = random.Random(5)
    cells = {(f, START.date() + timedelta(days=rng.randint(350, 380)), rng.randint(0, 29), rng.randint(0, 24)): rng.choice([None, 32767, *range(100)]) for f in ("tmmx", "vpd") for _ in range(400)}
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "feature string, day date, lat_idx int, lon_idx int, raw int")
    path = "file://" + str(tmp_path / "s")
    slabs.write_slabs(df, path, lats, lons, (16, 8, 8), 0.5, 3.0)
    key = lambda r: (r.feature, r.day, r.lat_idx, r.lon_idx, r.lat, r.lon, r.value)
    want = sorted((*k, lats[k[2]], lons[k[3]], v * 0.5 + 3.0) for k, v in cells.items() if v not in (None, 32767))
    assert sorted(map(key, slabs.read_slabs(spark, path).collect())) == want
    told = json.loads((tmp_path / "s/vpd/2020/data/.zarray").read_text())
    assert told["shape"] == [366, 30, 25] and told["chunks"] == [16, 8, 8] and told["zarr_format"] == 2
    shutil.rmtree(tmp_path / "s/tmmx")
    (tmp_path / "s/tmmx/2020/data").mkdir(parents=True)
    for file in (tmp_path / "s/vpd").glob("*/data/*.*.*"):
        b, y, x = map(int, file.name.split("."))
        if file.parts[-3] == "2020" and (y > 0 or x < 1 or b < 22):
            file.write_text("broken")
    where = "feature = 'vpd' AND day >= DATE'2020-12-20' AND lat_idx <= 7 AND lon < 46 AND value > 10"
    rows = slabs.read_slabs(spark, path).filter(where)
    low = START.date() + timedelta(days=354)
    assert sorted(map(key, rows.collect())) == [r for r in want if r[0] == "vpd" and r[1] >= low and r[2] <= 7 and r[5] < 46 and r[6] > 10]
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "formatted")
    assert "EqualTo(feature,vpd)" in plan and "GreaterThanOrEqual(day,2020-12-20)" in plan and "LessThan(lon,46.0)" in plan
    with pytest.raises(Exception, match="outside the axes"):
        slabs.write_slabs(spark.createDataFrame([("a", START.date(), 30, 0, 1)], df.schema), path, lats, lons)
