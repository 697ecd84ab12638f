"""Sources and sinks on files of a few lines."""

import json

import pytest
from pyspark.sql import functions as F

from pyrocast.sources import readers, sinks


def test_incidents(spark, tmp_path):
    p = tmp_path / "i.csv"
    p.write_text("id,x,Fire Discovery Date Time,y\n1,-120.5,2020-05-06 07:08:09,38.5\n2,-121.0,05/06/2020 01:00:00 PM,39\n3,,bad,\n")
    got = readers.incidents(spark, str(p)).collect()
    assert [(r.lat, r.lon) for r in got] == [(38.5, -120.5), (39.0, -121.0), (None, None)]
    assert [r.discovered_at and r.discovered_at.hour for r in got] == [7, 13, None]


@pytest.mark.parametrize("name,text", [("a.jsonl", '{"id": "1"}\n\n{"id": "2"}\n'), ("b.json", '[{"id": "1"}, {"id": "2"}]'), ("c.json", '{"items": [{"id": "1"}, {"id": "2"}]}')])
def test_json_records(spark, tmp_path, name, text):
    (tmp_path / name).write_text(text)
    assert sorted(r.id for r in readers.json_records(spark, str(tmp_path / name), "id string, tags array<string>").collect()) == ["1", "2"]


def test_small_readers(spark):
    lines = spark.createDataFrame([("[0][1], 5.5",), ("junk",), ("[2], x",), ("[3], -1",)], "value string")
    assert [(r.idx, r.value) for r in readers.ascii_slice(lines).collect()] == [(0, 5.5), (3, -1.0)]
    docs = spark.createDataFrame([(1, "a\f \fb")], "doc int, text string")
    assert [(r.page, r.text) for r in readers.pages_of(docs, "doc", "text").collect()] == [(1, "a"), (3, "b")]
    q = spark.createDataFrame([("38.5, -120",), ("x",), ("99,1",)], "q string").select(readers.lat_lon(F.col("q")).alias("p")).collect()
    assert [r.p and (r.p.lat, r.p.lon) for r in q] == [(38.5, -120.0), None, None]
    a, b = (sorted(map(tuple, readers.random_points(spark, 50, 3, (20, 30), (-10, 0), "2020-01-01", 30).collect())) for _ in range(2))
    assert a == b and all(20 <= r[1] <= 30 and -10 <= r[2] <= 0 for r in a)
    assert readers.settings({"n": 1, "on": False, "l": []}, {"n": "3"}, {"on": "true", "l": "[1]"}) == {"n": 3, "on": True, "l": [1]}


def test_patch_and_lookup(spark):
    report = spark.createDataFrame([(1, "rate limit", None), (2, "", 0.5), (3, "oops", None)], "id int, error string, score double")
    fixes = spark.createDataFrame([(1, None, 0.9), (2, None, 0.1)], "id int, error string, score double")
    got = {r.id: (r.error, r.score) for r in sinks.patched(report, fixes, "id", ["error", "score"], "error").collect()}
    assert got == {1: (None, 0.9), 2: ("", 0.5), 3: ("oops", None)}
    with pytest.raises(Exception, match="no entry for 3"):
        sinks.required(report, fixes.select("id"), "id").collect()


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}", [i]) for i in range(50)], "id int, t string, l array<int>")
    assert sinks.wide_csv(rows, ["t", "l"], str(tmp_path / "w")) and not sinks.wide_csv(rows.limit(0), ["t"], str(tmp_path / "n"))
    assert spark.read.option("header", True).csv(str(tmp_path / "w")).columns == ["t", "l"]
    sinks.shuffled_csv(rows.drop("l"), str(tmp_path / "s"), 4)
    assert sorted(int(r.id) for r in spark.read.option("header", True).csv(str(tmp_path / "s")).collect()) == list(range(50))
    text = sinks.summary(rows.withColumn("title", F.col("id") % 2), "title").first().summary
    assert json.loads(text)["chunks"] == 50


def test_reports_and_windows(spark, tmp_path):
    rows = spark.createDataFrame([("a", "é", 2), ("b", "x", 1)], "id string, name string, day int")
    sinks.json_lines(rows, str(tmp_path / "ascii"), ascii_only=True)
    text = "".join(p.read_text() for p in (tmp_path / "ascii").glob("part*"))
    assert text.isascii() and {json.loads(x)["name"] for x in text.splitlines()} == {"é", "x"}
    sinks.report(rows.selectExpr("count(*) AS n"), rows, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report/header")).first().n == 2 and spark.read.json(str(tmp_path / "report/rows")).count() == 2
    sinks.window_csv(rows, "day", str(tmp_path / "window"))
    (file,) = (tmp_path / "window").glob("part*.csv")
    assert file.read_text().splitlines() == ["id,name,day", "b,x,1", "a,é,2"]
