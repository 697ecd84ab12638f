"""Small fixed tables and the lookups on them: moisture by vegetation and drought, burn index, document specifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Classes of the land-cover map by their codes from 1 on, with the moisture at no, mild, medium and severe drought.
MOISTURE = [
    ("evergreen_needleleaf", 0.25, 0.27, 0.22, 0.26),
    ("evergreen_broadleaf", 0.28, 0.3, 0.25, 0.29),
    ("deciduous_needleleaf", 0.2, 0.24, 0.18, 0.21),
    ("deciduous_broadleaf", 0.22, 0.26, 0.2, 0.23),
    ("mixed_forest", 0.19, 0.23, 0.17, 0.21),
    ("closed_shrublands", 0.14, 0.18, 0.12, 0.15),
    ("open_shrublands", 0.1, 0.14, 0.08, 0.11),
    ("woody_savannas", 0.12, 0.16, 0.1, 0.13),
    ("savannas", 0.09, 0.13, 0.08, 0.1),
    ("grasslands", 0.08, 0.12, 0.07, 0.09),
    ("permanent_wetlands", 0.3, 0.33, 0.28, 0.31),
    ("croplands", 0.13, 0.16, 0.12, 0.15),
    ("urban_built", 0.05, 0.08, 0.04, 0.06),
    ("cropland_mosaic", 0.12, 0.15, 0.1, 0.13),
    ("snow_ice", 0.0, 0.01, 0.0, 0.0),
    ("barren", 0.01, 0.02, 0.01, 0.01),
    ("water", 0.0, 0.0, 0.0, 0.0),
]
# File, title, short name, domain, first page, agency, year and authority of the manuals; others get the last row, with names from their file.
DOCUMENTS = [
    ("RedBook_Final.pdf", "Red Book", "redbook", "doctrine", 6, "NIFC", 2025, 10),
    ("field_operations_guide.pdf", "Field Operations Guide", "fog", "operations", 7, "USFA/NFA", 2016, 9),
    ("pms461.pdf", "IRPG", "irpg", "safety", 1, "NWCG", 2025, 10),
    ("sm_0610.pdf", "WUI Firefighting for the Structural Company Officer", "wuifsco", "operations", 15, "USFA/NFA", 2014, 8),
    ("cal_fire_prescribed_fire_guidebook.pdf", "CAL FIRE Prescribed Fire Guidebook", "calfire_rx_guidebook", "doctrine", 1, "CAL FIRE", 2019, 7),
    ("how_to_prepare_your_home_for_wildfires.pdf", "How to Prepare Your Home for Wildfires", "firewise_home_wildfires", "wui", 1, "NFPA Firewise", 2024, 6),
    (None, None, None, "doctrine", 1, "Unknown", 0, 5),
]
_SPECS = ("doc_title", "doc_short", "default_domain", "start_page", "agency", "doc_year", "authority_rank")


def with_moisture(rows: DataFrame, vegetation: str, drought: str) -> DataFrame:
    """rows with vegetation_name and moisture, by the class' code and the drought (0 to 3); null where either is unknown."""
    spark = rows.sparkSession
    told = [(i + 1, name, d, m) for i, (name, *levels) in enumerate(MOISTURE) for d, m in enumerate(levels)]
    table = spark.createDataFrame(told, "__v int, vegetation_name string, __d int, moisture double")
    return rows.join(F.broadcast(table), (F.col(vegetation) == F.col("__v")) & (F.col(drought) == F.col("__d")), "left").drop("__v", "__d")


def burn_index(vegetation: Column, rate: Column) -> Column:
    """0 (low) to 2 (high), from the class' name and the spread rate in feet a minute."""
    forests = ["evergreen_needleleaf", "deciduous_needleleaf", "mixed_forest", "evergreen_broadleaf", "deciduous_broadleaf"]
    shrubs = F.when(rate < 10, 0).when(rate < 50, 1).otherwise(2)
    medium = lambda least: F.when(rate < least, 0).otherwise(1)
    return F.when(vegetation == "grasslands", medium(45)).when(vegetation.isin("closed_shrublands", "open_shrublands"), shrubs).when(vegetation.isin(forests), medium(25)).otherwise(0)


def with_specs(rows: DataFrame, file: str) -> DataFrame:
    """rows with the specification of their file; unknown files are titled by their stem."""
    table = rows.sparkSession.createDataFrame(DOCUMENTS[:-1], "__f string, doc_title string, doc_short string, default_domain string, start_page int, agency string, doc_year int, authority_rank int")
    stem = F.regexp_replace(F.regexp_extract(file, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    other = dict(zip(_SPECS, [stem, T.slug(stem), *map(F.lit, DOCUMENTS[-1][3:])], strict=True))
    joined = rows.join(F.broadcast(table), F.col(file) == F.col("__f"), "left").drop("__f")
    return joined.select(*rows.columns, *[F.coalesce(c, other[c]).alias(c) for c in _SPECS])
