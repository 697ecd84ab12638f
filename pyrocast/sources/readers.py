"""Sources: incidents and samples as CSV, JSON records, weather slabs, rasters, manifests, messages."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INCIDENTS = T.StructType([T.StructField("Fire Discovery Date Time", T.StringType()), T.StructField("y", T.DoubleType()), T.StructField("x", T.DoubleType())])
SAMPLES = "latitude double, longitude double, datetime timestamp, Wildfire string"
CHUNKS = (
    "doc_type string, doc_title string, section_path string, chunk_id string, text string, page_start int, page_end int, domain string, "
    "priority string, source_type string, agency string, topic_tags array<string>, doc_year int, authority_rank int"
)


def incidents(spark: SparkSession, path: str, formats: tuple[str, ...] = ("yyyy/MM/dd HH:mm:ssX", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy hh:mm:ss a")) -> DataFrame:
    """lat, lon, discovered_at; columns are found by name, and no schema is inferred."""
    header = spark.read.option("header", True).csv(path)
    read = spark.read.option("header", True).schema(T.StructType([INCIDENTS[c] if c in INCIDENTS.names else T.StructField(c, T.StringType()) for c in header.columns])).csv(path)
    at = F.coalesce(*[F.try_to_timestamp(F.col("`Fire Discovery Date Time`"), F.lit(f)) for f in formats])
    return read.select(F.col("y").alias("lat"), F.col("x").alias("lon"), at.alias("discovered_at"))


def samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SAMPLES).option("header", True).csv(path)


def years(rows: DataFrame, at: str = "datetime") -> DataFrame:
    return rows.select(F.year(at).alias("year")).distinct()


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a .jsonl file, of an array, or of an object's `items`."""
    if path.rstrip("/").endswith((".jsonl", ".ndjson")):
        return spark.read.schema(schema).json(path)
    one = spark.read.schema(f"items array<struct<{', '.join(x.strip().replace(' ', ': ', 1) for x in _fields(schema))}>>").option("multiLine", True).json(path)
    plain = spark.read.schema(schema).option("multiLine", True).json(path)
    listed = one.filter("items IS NOT NULL").select(F.explode("items").alias("r")).select("r.*")
    names = listed.columns
    filled = F.lit(False)
    for c in names:
        filled = filled | F.col(c).isNotNull()
    return listed.unionByName(plain.filter(filled))


def _fields(schema: str) -> list[str]:
    """The fields of a DDL string, split at its outer commas."""
    out, depth, now = [], 0, ""
    for c in schema:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now]


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return json_records(spark, path, CHUNKS)


def slab_values(raw: DataFrame, fill: Column, scale: Column, offset: Column) -> DataFrame:
    """A landed slab (feature, day, lat_idx, lon_idx, raw) with `value`; fill is tested before scaling."""
    return raw.withColumn("value", F.when(F.col("raw") != fill, F.col("raw") * scale + offset)).drop("raw")


def ascii_slice(lines: DataFrame, text: str = "value") -> DataFrame:
    """Values of the lines `[..][..], value` of a text slice; other lines are skipped."""
    value = F.trim(F.get(F.split(text, ",", 2), F.lit(1))).try_cast("double")
    return lines.select(F.regexp_extract(text, r"\[(\d+)\]", 1).try_cast("int").alias("idx"), value.alias("value")).filter("value IS NOT NULL")


def pages_of(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """A row for each page of a text with form feeds: pages are numbered first, then blank ones go."""
    rows = docs.select(doc, F.posexplode(F.split(text, "\f")).alias("page", "text")).withColumn("page", F.col("page") + 1)
    return rows.filter(F.trim("text") != "")


def latest_image(images: DataFrame, before: Column) -> DataFrame:
    """The last image before a time, or the last of all where there is none."""
    pick = F.coalesce(F.max_by("image", F.when(F.col("ts") < before, F.col("ts"))), F.max_by("image", "ts"))
    return images.agg(pick.alias("image"))


def uploads(spark: SparkSession, path: str, most_bytes: int) -> DataFrame:
    """Files of at most most_bytes, by their listing: larger ones are never opened."""
    return spark.read.format("binaryFile").load(path).filter(F.col("length") <= most_bytes)


def lat_lon(text: Column) -> Column:
    """The struct (lat, lon) that a query like "38.5, -120.1" spells; null for others."""
    pattern = r"^\s*(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)\s*$"
    lat, lon = (F.regexp_extract(text, pattern, i).try_cast("double") for i in (1, 2))
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("lat"), lon.alias("lon")))


def random_points(spark: SparkSession, n: int, seed: int, lat: tuple[float, float], lon: tuple[float, float], start: str, days: int) -> DataFrame:
    """Points spread evenly over a box and a span of days; equal for equal seeds."""
    u = lambda k: (F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(k)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    day = F.date_add(F.lit(start).cast("date"), F.floor(u(3) * days).cast("int"))
    return spark.range(n).select("id", (lat[0] + u(1) * (lat[1] - lat[0])).alias("lat"), (lon[0] + u(2) * (lon[1] - lon[0])).alias("lon"), day.alias("day"))


def settings(defaults: dict, *layers: dict[str, str]) -> dict:
    """Later layers win; texts become what the default's type asks for: flag, number, list or JSON."""
    out = dict(defaults)
    for layer in layers:
        for key, value in layer.items():
            if key in out and isinstance(value, str) and not isinstance(out[key], str):
                kind = out[key]
                value = value.lower() in ("1", "true", "yes", "") if isinstance(kind, bool) else json.loads(value) if isinstance(kind, (list, dict)) else type(kind)(value) if kind is not None else value
            out[key] = value
    return out


def manifest(path_of: dict[str, str], root: str) -> dict[str, str]:
    """Relative paths of a manifest below its root."""
    return {k: v if "://" in v or v.startswith("/") else f"{root.rstrip('/')}/{v}" for k, v in path_of.items()}
