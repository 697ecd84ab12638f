"""Composites on small rows: samples, reports, serving, evaluation."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pyrocast.functions.physics import haversine_km
from pyrocast.operators import evaluation, reports, samples, serving

RING = [(-124.0, 30.0), (-70.0, 30.0), (-70.0, 48.0), (-124.0, 48.0)]


@pytest.fixture(scope="module")
def incidents(spark):
    rows = [(32.0 + i % 13, -120.0 + (i * 7) % 45, datetime(2018, 1, 1) + timedelta(days=i * 11 % 1500, hours=i)) for i in range(150)] + [(10.0, -100.0, datetime(2020, 1, 1)), (40.0, -100.0, None)]
    return spark.createDataFrame(rows, "lat double, lon double, discovered_at timestamp")


def test_samples(spark, incidents):
    s = samples.Settings(far_count=40)
    yes = samples.positives(incidents, RING, s).cache()
    assert 100 < yes.count() <= 150
    far = samples.far_negatives(spark, yes, RING, s, draws=60)
    assert far.count() == 40
    assert far.crossJoin(yes.select(F.col("lat").alias("b"), F.col("lon").alias("c"))).filter(F.expr(haversine_km("lat", "lon", "b", "c")) < 100).count() == 0
    near, years = samples.near_negatives(yes, RING, s), samples.year_negatives(yes, s)
    assert near.count() > 20 and years.count() > 100
    assert samples.near_negatives(yes, RING, s, parity=True).count() == 0
    assert years.join(yes, ["lat", "lon", "at"]).count() == 0 and years.join(yes, ["lat", "lon"]).count() > 0
    out = samples.coordinates(spark, incidents, RING, samples.Settings(far_count=5)).groupBy("Wildfire").count().collect()
    assert {r.Wildfire for r in out} == {"Yes", "No"}


def test_sections(spark):
    pages = [(1, 1, "Big Fire\nOverall Risk Level\nLOW\n\n2. Weather:\nWind is 5 mph"), (1, 2, "more wind\nSAFETY CONCERNS\nResources\nTen engines")]
    rows = reports.lines(spark.createDataFrame(pages, "doc int, page int, text string"), "doc", "page", "text")
    aliases = {"Weather": ["weather"], "Safety Concerns": ["safety concerns"], "Resources": ["resources"]}
    got = [(r.section, r.text, r.page_start, r.page_end) for r in reports.sections(rows, "doc", aliases).orderBy("number").collect()]
    assert got == [("Incident Overview", "Big Fire\nOverall Risk Level\nLOW", 1, 1), ("Weather", "Wind is 5 mph\nmore wind", 1, 2), ("Resources", "Ten engines", 2, 2)]
    df = spark.createDataFrame([("Name: The Fire\nRegion - North: East\nOverall Risk Level\nLOW\n",)], "t string")
    r = df.select(*[reports.label_value(F.col("t"), [x]).alias(x) for x in ("name", "region", "none")], reports.adjacent_value(F.col("t"), ["overall risk level"]).alias("risk")).first()
    assert (r.name, r.region, r.none, r.risk) == ("The Fire", "North: East", None, "LOW")


def test_chunks(spark):
    text = "CHAPTER ONE\nbody text of one.\nSafety Zones\nlookouts, and lces.\nmore of it.\nCHAPTER TWO\nlast words here."
    rows = reports.lines(spark.createDataFrame([(1, 1, text)], "doc int, page int, text string"), "doc", "page", "text")
    got = [(r.path, r.text, r.domain) for r in reports.chunks(rows, "doc").orderBy("section").collect()]
    assert got == [("CHAPTER ONE", "body text of one.", "doctrine"), ("CHAPTER ONE > Safety Zones", "lookouts, and lces.  more of it.", "safety"), ("CHAPTER TWO", "last words here.", "doctrine")]


def test_serving(spark):
    at = date(2024, 3, 10)
    requests = spark.createDataFrame([(1, 7, at)], "request_id int, cell int, at date")
    day = lambda i: at + timedelta(days=i)
    history = spark.createDataFrame([(7, f, day(i), v + i) for i in (-3, -1, 0) for f, v in (("tmmn", 280.0), ("tmmx", 290.0), ("vpd", 0.5))], "cell int, feature string, day date, value double")
    forecast = spark.createDataFrame([(7, "tmmn", day(0), 999.0), (7, "tmmn", day(2), 282.0)], "cell int, feature string, day date, value double")
    rows = serving.with_humidity(serving.stitched(requests, history, forecast, ["rmax", "rmin", "tmmn", "tmmx", "vpd"], 3, 2)).orderBy("day")
    got = rows.collect()
    assert [r.tmmn for r in got] == [277, 278, 279, 280, 281, 282] and all(0 <= r.rmin <= r.rmax <= 100 for r in got)
    x = serving.model_input(rows, ["tmmn", "vpd"], {"tmmn": (280.0, 2.0)})
    assert x.first().tensor[0][0] == -1.5 and len(x.first().tensor) == 6 and len(x.first().tensor[0]) == 4
    p = serving.predict(x, [0.0, 0.0, 1.0, 0.0]).first()
    assert p.probability == pytest.approx(1 / (1 + 2.718281828 ** -(3**0.5 / 2))) and p.wildfire


def test_evaluation(spark):
    chunks = spark.createDataFrame([("a", "T", "Safety – Zones", "Keep  one foot"), ("b", "T", "Other", "x")], "chunk_id string, doc_title string, section_path string, text string")
    cases = spark.createDataFrame([(1, [("T", "safety - zones", None)]), (2, [(None, None, None)]), (3, [("U", None, None), (None, None, "ONE FOOT")])], "case_id int, matchers array<struct<doc_title: string, section_contains: string, text_contains: string>>")
    assert sorted(map(tuple, evaluation.relevant(chunks, cases).collect())) == [(1, "a"), (2, "a"), (2, "b"), (3, "a")]
    assert evaluation.runs(cases.select("case_id"), chunks.select("chunk_id"), 3).count() == 6
    r = spark.createDataFrame([('ok {"score": 4, "why": "x"} end', "HTTP 429")], "t string, e string").select(evaluation.judged(F.col("t"), "score int, why string").alias("j"), evaluation.rate_limited(F.col("e")).alias("l")).first()
    assert r.j.score == 4 and r.l
