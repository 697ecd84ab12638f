"""Queries on fixed tables, and small ones on orders and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import charts, dimensions, timeseries
from ..session import table


def burn_index(spark, sf):
    """Customers as cells of their nation, a zone with a vegetation and a drought: moisture, burn index by spread rate, and the code of state and index."""
    zones = table(spark, sf, "nation").select("n_nationkey", (F.pmod("n_nationkey", F.lit(17)) + 1).alias("vegetation"), F.pmod("n_nationkey", F.lit(4)).alias("drought"))
    cells = table(spark, sf, "customer").join(zones, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = dimensions.with_moisture(cells, "vegetation", "drought").withColumn("rate", F.abs("c_acctbal") / 100)
    rows = rows.withColumn("index", dimensions.burn_index(F.col("vegetation_name"), F.col("rate")))
    state = F.when(F.col("c_acctbal") < 0, 2).when(F.col("c_acctbal") < 2000, 1).otherwise(0)
    return rows.select("c_custkey", F.col("vegetation_name").alias("vegetation"), "moisture", F.col("index").cast("long").alias("burn_index"), (state * 3 + F.col("index")).cast("long").alias("code"))


def document_specs(spark, sf):
    """Parts as files, known and unknown, with their specification."""
    files = ["RedBook_Final.pdf", "field_operations_guide.pdf", "pms461.pdf", "sm_0610.pdf", "cal_fire_prescribed_fire_guidebook.pdf", "how_to_prepare_your_home_for_wildfires.pdf", "docs/My Own-Plan.v2.pdf", "plain"]
    rows = table(spark, sf, "part").select("p_partkey", F.get(F.array(*map(F.lit, files)), F.pmod("p_partkey", F.lit(len(files))).cast("int")).alias("file"))
    out = dimensions.with_specs(rows, "file")
    return out.select("p_partkey", "doc_title", "doc_short", "default_domain", *[F.col(c).cast("long").alias(c) for c in ("start_page", "doc_year", "authority_rank")], "agency")


def sorted_points(spark, sf):
    """Points of each customer's orders in order of time, with their places."""
    return charts.ordered(table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", F.col("pos").cast("long").alias("pos"))


def joined_years(spark, sf):
    """Each nation's daily totals of every year as arrays, joined over the years in order."""
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    daily = orders.groupBy("c_nationkey", F.to_date("o_orderdate").alias("day")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    yearly = daily.groupBy("c_nationkey", F.year("day").alias("year")).agg(F.transform(F.sort_array(F.collect_list(F.struct("day", "cents"))), lambda x: x["cents"]).alias("values"))
    out = timeseries.joined_years(yearly, "c_nationkey", "year", "values")
    return out.select("c_nationkey", F.size("values").cast("long").alias("n"), F.md5(F.array_join(F.transform("values", lambda x: x.cast("string")), ",")).alias("md5"))


def batched_union(spark, sf):
    """Results of seven batches of orders, made one by one and put together, with sorted years."""
    batches = [table(spark, sf, "orders").filter(F.pmod("o_orderkey", F.lit(7)) == i).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sort_array(F.collect_set(F.year("o_orderdate"))).alias("years")) for i in range(7)]
    out = timeseries.concat(batches, "batch")
    return out.select("batch", "o_orderstatus", "n", F.array_join(F.transform("years", lambda y: y.cast("string")), ",").alias("years"))


QUERIES = {f.__name__: f for f in (burn_index, document_specs, sorted_points, joined_years, batched_union)}
SQL = {
    "burn_index": """WITH m AS (SELECT * FROM (VALUES (1, 'evergreen_needleleaf', [0.25, 0.27, 0.22, 0.26]), (2, 'evergreen_broadleaf', [0.28, 0.3, 0.25, 0.29]), (3, 'deciduous_needleleaf', [0.2, 0.24, 0.18, 0.21]), (4, 'deciduous_broadleaf', [0.22, 0.26, 0.2, 0.23]),
  (5, 'mixed_forest', [0.19, 0.23, 0.17, 0.21]), (6, 'closed_shrublands', [0.14, 0.18, 0.12, 0.15]), (7, 'open_shrublands', [0.1, 0.14, 0.08, 0.11]), (8, 'woody_savannas', [0.12, 0.16, 0.1, 0.13]), (9, 'savannas', [0.09, 0.13, 0.08, 0.1]),
  (10, 'grasslands', [0.08, 0.12, 0.07, 0.09]), (11, 'permanent_wetlands', [0.3, 0.33, 0.28, 0.31]), (12, 'croplands', [0.13, 0.16, 0.12, 0.15]), (13, 'urban_built', [0.05, 0.08, 0.04, 0.06]), (14, 'cropland_mosaic', [0.12, 0.15, 0.1, 0.13]),
  (15, 'snow_ice', [0.0, 0.01, 0.0, 0.0]), (16, 'barren', [0.01, 0.02, 0.01, 0.01]), (17, 'water', [0.0, 0.0, 0.0, 0.0])) t(k, vegetation, levels)),
c AS (SELECT c_custkey, c_acctbal, abs(c_acctbal) / 100 AS rate, vegetation, CAST(levels[c_nationkey % 4 + 1] AS DOUBLE) AS moisture FROM customer JOIN m ON k = c_nationkey % 17 + 1),
i AS (SELECT *, CASE WHEN vegetation = 'grasslands' THEN CASE WHEN rate < 45 THEN 0 ELSE 1 END WHEN vegetation LIKE '%shrublands' THEN CASE WHEN rate < 10 THEN 0 WHEN rate < 50 THEN 1 ELSE 2 END
  WHEN vegetation LIKE '%leaf' OR vegetation = 'mixed_forest' THEN CASE WHEN rate < 25 THEN 0 ELSE 1 END ELSE 0 END AS x FROM c)
SELECT c_custkey, vegetation, moisture, CAST(x AS BIGINT) AS burn_index, CAST(CASE WHEN c_acctbal < 0 THEN 2 WHEN c_acctbal < 2000 THEN 1 ELSE 0 END * 3 + x AS BIGINT) AS code FROM i""",
    "document_specs": """WITH s AS (SELECT * FROM (VALUES (0, 'Red Book', 'redbook', 'doctrine', 6, 'NIFC', 2025, 10), (1, 'Field Operations Guide', 'fog', 'operations', 7, 'USFA/NFA', 2016, 9), (2, 'IRPG', 'irpg', 'safety', 1, 'NWCG', 2025, 10),
  (3, 'WUI Firefighting for the Structural Company Officer', 'wuifsco', 'operations', 15, 'USFA/NFA', 2014, 8), (4, 'CAL FIRE Prescribed Fire Guidebook', 'calfire_rx_guidebook', 'doctrine', 1, 'CAL FIRE', 2019, 7),
  (5, 'How to Prepare Your Home for Wildfires', 'firewise_home_wildfires', 'wui', 1, 'NFPA Firewise', 2024, 6), (6, 'My Own-Plan.v2', 'my_own_plan_v2', 'doctrine', 1, 'Unknown', 0, 5), (7, 'plain', 'plain', 'doctrine', 1, 'Unknown', 0, 5)) t(k, doc_title, doc_short, default_domain, a, agency, b, c))
SELECT p_partkey, doc_title, doc_short, default_domain, CAST(a AS BIGINT) AS start_page, CAST(b AS BIGINT) AS doc_year, CAST(c AS BIGINT) AS authority_rank, agency FROM part JOIN s ON k = p_partkey % 8""",
    "sorted_points": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders",
    "joined_years": """WITH d AS (SELECT c_nationkey, CAST(o_orderdate AS DATE) AS day, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT c_nationkey, count(*) AS n, md5(string_agg(cents::VARCHAR, ',' ORDER BY day)) AS md5 FROM d GROUP BY c_nationkey""",
    "batched_union": "SELECT CAST(o_orderkey % 7 AS INT) AS batch, o_orderstatus, count(*) AS n, string_agg(DISTINCT year(o_orderdate)::VARCHAR, ',' ORDER BY year(o_orderdate)::VARCHAR) AS years FROM orders GROUP BY ALL",
}
