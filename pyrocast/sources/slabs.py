"""Slabs of daily grids as chunked arrays (Zarr, version 2), written by Spark and read through a data source with pushdown.

A slab is a feature's year: arrays day, lat, lon and data (day, lat, lon), the last in chunks, each a file
of its own. The source has a partition for each slab and block of days, and takes filters on feature,
day, latitude, longitude and their indices: slabs, blocks of days and chunks outside are never opened.
"""

from __future__ import annotations

import datetime
import json
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

_EPOCH = datetime.date(1970, 1, 1)
_TYPE = np.dtype("<i4")
SCHEMA = "feature string, day date, lat_idx int, lon_idx int, lat double, lon double, value double"


def _put(system, path: str, data: bytes) -> None:
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path, compression=None) as out:
        out.write(data)


def _get(system, path: str) -> bytes | None:
    if system.get_file_info(path).type != fs.FileType.File:
        return None
    with system.open_input_stream(path, compression=None) as f:
        return f.read()


def _array(system, path: str, values: np.ndarray) -> None:
    """A one-dimensional array of one chunk."""
    told = {"zarr_format": 2, "shape": [len(values)], "chunks": [len(values)], "dtype": values.dtype.str, "compressor": None, "fill_value": None, "order": "C", "filters": None}
    _put(system, f"{path}/.zarray", json.dumps(told).encode())
    _put(system, f"{path}/0", values.tobytes())


def write_slabs(cells: DataFrame, path: str, lats: list[float], lons: list[float], chunk: tuple[int, int, int] = (32, 16, 16), scale: float = 0.1, offset: float = 0.0, fill: int = 32767) -> None:
    """Writes cells (feature, day, lat_idx, lon_idx, raw) as slabs below path, which tasks share.

    A value is raw * scale + offset; cells without a row, or with a null or the fill value, have none. Of rows of one
    cell the largest raw counts. Cells outside the axes are an error. A task that runs again writes the same files.
    """
    cd, ca, co = chunk
    days = F.dayofyear("day") - 1
    rows = cells.filter("raw IS NOT NULL").groupBy("feature", F.year("day").alias("year"), days.alias("d"), "lat_idx", "lon_idx").agg(F.max("raw").cast("int").alias("raw"))
    blocks = {"b": F.floor(F.col("d") / cd), "y": F.floor(F.col("lat_idx") / ca), "x": F.floor(F.col("lon_idx") / co)}
    rows = rows.withColumns({k: v.cast("int") for k, v in blocks.items()})
    out = pa.schema([("feature", pa.string()), ("year", pa.int32())])

    def chunk_of(group: pa.Table) -> pa.Table:
        """One chunk: its cells are rows of one group, as many as it has places at most."""
        system, root = fs.FileSystem.from_uri(path)
        feature, year, b, y, x = (group.column(c)[0].as_py() for c in ("feature", "year", "b", "y", "x"))
        at = [np.asarray(group.column(c)) - first for c, first in (("d", b * cd), ("lat_idx", y * ca), ("lon_idx", x * co))]
        if any(x.min() < 0 or x.max() >= n for x, n in ((np.asarray(group.column("lat_idx")), len(lats)), (np.asarray(group.column("lon_idx")), len(lons)))):
            raise ValueError("a cell lies outside the axes")
        data = np.full(chunk, fill, _TYPE)
        data[at[0], at[1], at[2]] = np.asarray(group.column("raw"))
        _put(system, f"{root}/{feature}/{year}/data/{b}.{y}.{x}", data.tobytes())
        return pa.table({"feature": [feature], "year": [year]}, out)

    def head_of(group: pa.Table) -> pa.Table:
        """The axes and descriptions of one slab."""
        system, root = fs.FileSystem.from_uri(path)
        feature, year = group.column("feature")[0].as_py(), group.column("year")[0].as_py()
        base, first = f"{root}/{feature}/{year}", (datetime.date(year, 1, 1) - _EPOCH).days
        n = (datetime.date(year + 1, 1, 1) - datetime.date(year, 1, 1)).days
        _put(system, f"{base}/.zgroup", json.dumps({"zarr_format": 2}).encode())
        for name, values in (("day", np.arange(first, first + n, dtype="<i4")), ("lat", np.array(lats, "<f8")), ("lon", np.array(lons, "<f8"))):
            _array(system, f"{base}/{name}", values)
        told = {"zarr_format": 2, "shape": [n, len(lats), len(lons)], "chunks": list(chunk), "dtype": _TYPE.str, "compressor": None, "fill_value": fill, "order": "C", "filters": None}
        _put(system, f"{base}/data/.zarray", json.dumps(told).encode())
        _put(system, f"{base}/data/.zattrs", json.dumps({"scale_factor": scale, "add_offset": offset, "units": "days since 1970-01-01"}).encode())
        return pa.table({"feature": [feature], "year": [year]}, out)

    done = rows.groupBy("feature", "year", "b", "y", "x").applyInArrow(chunk_of, "feature string, year int")
    done.distinct().groupBy("feature", "year").applyInArrow(head_of, "feature string, year int").count()


@dataclass
class _Block(InputPartition):
    base: str
    feature: str
    block: int


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.features: set[str] | None = None
        self.low: dict[str, float] = {}
        self.high: dict[str, float] = {}

    def _bound(self, column: str, low=None, high=None) -> None:
        if low is not None:
            self.low[column] = max(low, self.low.get(column, low))
        if high is not None:
            self.high[column] = min(high, self.high.get(column, high))

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column == "feature" and isinstance(f, (EqualTo, In)):
                told = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.features = told if self.features is None else self.features & told
            elif column in ("day", "lat", "lon", "lat_idx", "lon_idx") and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                v = (f.value - _EPOCH).days if column == "day" else f.value
                if isinstance(f, (EqualTo, GreaterThanOrEqual)):
                    self._bound(column, low=v)
                if isinstance(f, (EqualTo, LessThanOrEqual)):
                    self._bound(column, high=v)
                # the next number, where there is one between two numbers
                if isinstance(f, GreaterThan):
                    self._bound(column, low=v + 1 if column not in ("lat", "lon") else math.nextafter(v, math.inf))
                if isinstance(f, LessThan):
                    self._bound(column, high=v - 1 if column not in ("lat", "lon") else math.nextafter(v, -math.inf))
            elif not (isinstance(f, IsNotNull) and column in ("feature", "day", "lat", "lon", "lat_idx", "lon_idx")):
                yield f

    def _kept(self, axis: np.ndarray, *columns: str) -> np.ndarray:
        """Places of an axis that the bounds on its values (first column) and indices (second) leave."""
        ok = np.ones(len(axis), bool)
        for column, values in zip(columns, (axis, np.arange(len(axis))), strict=False):
            ok &= (values >= self.low.get(column, -np.inf)) & (values <= self.high.get(column, np.inf))
        return np.flatnonzero(ok)

    def partitions(self):
        system, root = fs.FileSystem.from_uri(self.path)
        out = []
        for feature in system.get_file_info(fs.FileSelector(root)):
            if self.features is not None and feature.base_name not in self.features:
                continue
            for year in system.get_file_info(fs.FileSelector(feature.path)):
                first = (datetime.date(int(year.base_name), 1, 1) - _EPOCH).days
                if first > self.high.get("day", math.inf) or first + 366 <= self.low.get("day", -math.inf):
                    continue
                n, step = (json.loads(_get(system, f"{year.path}/data/.zarray"))[k][0] for k in ("shape", "chunks"))
                days = self._kept(first + np.arange(n), "day")
                out += [_Block(year.path, feature.base_name, int(b)) for b in np.unique(days // step)]
        return out

    def read(self, partition: _Block):
        system, _ = fs.FileSystem.from_uri(self.path)
        base = partition.base
        told = json.loads(_get(system, f"{base}/data/.zarray"))
        attrs = json.loads(_get(system, f"{base}/data/.zattrs") or b"{}")
        axis = lambda name: np.frombuffer(_get(system, f"{base}/{name}/0"), json.loads(_get(system, f"{base}/{name}/.zarray"))["dtype"])
        lats, lons, days = axis("lat"), axis("lon"), axis("day")
        (cd, ca, co), kind, b = told["chunks"], np.dtype(told["dtype"]), partition.block
        d = self._kept(days, "day")
        d = d[d // cd == b] - b * cd
        y_kept, x_kept = self._kept(lats, "lat", "lat_idx"), self._kept(lons, "lon", "lon_idx")
        schema = pa.schema([("feature", pa.string()), ("day", pa.date32()), ("lat_idx", pa.int32()), ("lon_idx", pa.int32()), ("lat", pa.float64()), ("lon", pa.float64()), ("value", pa.float64())])
        for y in np.unique(y_kept // ca):
            for x in np.unique(x_kept // co):
                data = _get(system, f"{base}/data/{b}.{y}.{x}")
                if data is None:  # a chunk without values
                    continue
                own_y, own_x = y_kept[y_kept // ca == y] - y * ca, x_kept[x_kept // co == x] - x * co
                part = np.frombuffer(data, kind).reshape(cd, ca, co)[np.ix_(d, own_y, own_x)]
                at = np.nonzero(part != told["fill_value"])
                i, j, k = d[at[0]] + b * cd, own_y[at[1]] + y * ca, own_x[at[2]] + x * co
                value = part[at] * attrs.get("scale_factor", 1.0) + attrs.get("add_offset", 0.0)
                columns = [pa.array([partition.feature] * len(i), pa.string()), pa.array(days[i].astype(np.int32)).cast(pa.date32()), pa.array(j.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(lats[j]), pa.array(lons[k]), pa.array(value)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)


class Slabs(DataSource):
    """spark.read.format("slabs").load(path): the cells that have a value."""

    @classmethod
    def name(cls) -> str:
        return "slabs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])


def read_slabs(spark: SparkSession, path: str) -> DataFrame:
    """feature, day, lat_idx, lon_idx, lat, lon, value of all slabs below path; filters on all but value reach the source."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Slabs)
    return spark.read.format("slabs").load(path)
