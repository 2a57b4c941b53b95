"""N-dimensional arrays in tiles: a Spark data source over chunk files, with a partition per tile and filters that choose the tiles.

A folder holds one file per tile of a regular (lat, lon) grid, named ``row_col.npz``: ``values`` (day, lat, lon) in raw units with NaN where
nothing is known, its ``days``, ``lats`` and ``lons``, and ``scale`` and ``offset`` of the physical unit (value = raw * scale + offset), as
array stores keep them. Files are opened through Arrow's file systems (local, HDFS, S3), by the tasks.

``spark.read.format("tiles").options(path=..., size=...)`` gives rows (lat, lon, day, value) of the known cells. Comparisons of lat and lon with
numbers drop tiles before any is opened; ``opened`` in the rows names the tile they came from.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "lat long, lon long, day long, value double, opened string"


def write_tiles(df: DataFrame, path: str, size: int, scale: float, offset: float) -> list[str]:
    """Writes (lat, lon, day, value), one row a cell and day, as tiles of ``size`` by ``size`` cells; a tile is one task's group. Returns their names."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        name = f"{rows['lat'].iloc[0] // size}_{rows['lon'].iloc[0] // size}"
        axes = [np.unique(rows[c]) for c in ("day", "lat", "lon")]
        values = np.full([len(a) for a in axes], np.nan)
        values[tuple(np.searchsorted(a, rows[c]) for a, c in zip(axes, ("day", "lat", "lon")))] = (rows["value"] - offset) / scale
        blob = io.BytesIO()
        np.savez(blob, values=values, days=axes[0], lats=axes[1], lons=axes[2], scale=scale, offset=offset)
        store, folder = pyarrow.fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{name}.npz") as out:
            out.write(blob.getvalue())
        return pd.DataFrame({"name": [name]})

    tiles = df.groupBy(F.floor(F.col("lat") / size), F.floor(F.col("lon") / size)).applyInPandas(run, "name string")
    return sorted(r["name"] for r in tiles.collect())  # names of files


class Tile(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class TileReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size
        self.box = {"lat": [-np.inf, np.inf], "lon": [-np.inf, np.inf]}  # both ends within

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Narrows the box of tiles. Every filter is also given back, as a tile holds cells outside the box."""
        for f in filters:
            axis = self.box.get(f.attribute[0]) if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1 else None
            if axis is not None:
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    axis[0] = max(axis[0], f.value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    axis[1] = min(axis[1], f.value)
            yield f

    def partitions(self) -> list[Tile]:
        store, folder = pyarrow.fs.FileSystem.from_uri(self.path)
        names = sorted(x.base_name.removesuffix(".npz") for x in store.get_file_info(pyarrow.fs.FileSelector(folder)) if x.base_name.endswith(".npz"))
        return [Tile(n) for n in names if all(self._meets(axis, int(k)) for axis, k in zip(("lat", "lon"), n.split("_")))]

    def _meets(self, axis: str, k: int) -> bool:
        low, high = self.box[axis]
        return k * self.size <= high and (k + 1) * self.size - 1 >= low

    def read(self, partition: Tile) -> Iterator[pa.RecordBatch]:
        store, folder = pyarrow.fs.FileSystem.from_uri(self.path)
        with store.open_input_stream(f"{folder}/{partition.name}.npz") as f:
            tile = np.load(io.BytesIO(f.read()))
        values = tile["values"] * float(tile["scale"]) + float(tile["offset"])
        for day, plane in zip(tile["days"].tolist(), values):
            i, j = np.nonzero(~np.isnan(plane))
            yield pa.RecordBatch.from_arrays([pa.array(tile["lats"][i]), pa.array(tile["lons"][j]), pa.array(np.full(len(i), day)), pa.array(plane[i, j]), pa.array([partition.name] * len(i), pa.string())], names=["lat", "lon", "day", "value", "opened"])


class TileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TileReader:
        return TileReader(self.options["path"], int(self.options["size"]))


def read_tiles(spark: SparkSession, path: str, size: int) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TileSource)
    return spark.read.format("tiles").options(path=path, size=size).load()
