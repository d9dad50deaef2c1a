"""Rasters from and to TIFF files as tables.

``register`` adds the format ``raster`` to a session. A row is a tile of one
band: raster_id (the path), band (from 1), tile_row, tile_col, row0, col0,
n_rows, n_cols and data (values by rows, null where the file has no data).
Tasks read the blocks of their tiles only; the options ``window`` (c0,c1,r0,r1,
inclusive) and ``bands`` keep others from being read. Filters of a query aren't
pushed into the reader, as Spark 4.1 shares what was pushed between queries of
one loaded table.
"""

from __future__ import annotations

import glob
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..kernels import tiff

TILES = "raster_id string, band int, tile_row int, tile_col int, row0 int, col0 int, n_rows int, n_cols int, data array<double>"
META = "raster_id string, width int, height int, bands int, dtype string, nodata double, descriptions array<string>, epsg int, valid_map_info boolean, transform array<double>, res_x double, res_y double, rpc array<double>"


def paths_of(path: str) -> list[str]:
    """Of a file, a folder's .tif and .tiff files, or a pattern, in order."""
    if os.path.isdir(path):
        return sorted(p for p in glob.glob(os.path.join(path, "*")) if p.lower().endswith((".tif", ".tiff")))
    return sorted(glob.glob(path)) if glob.has_magic(path) else [path]


@dataclass
class TileRow(InputPartition):
    """A row of tiles of one band."""

    path: str
    band: int
    tile_row: int


class RasterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return TILES

    def reader(self, schema) -> DataSourceReader:
        return TileReader(dict(self.options))


class TileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for x in options["path"].split(",") for p in paths_of(x.strip())]
        self.size = int(options.get("tilesize", 256))
        self.window = [int(v) for v in options["window"].split(",")] if options.get("window") else None
        self.bands = [int(v) for v in options["bands"].split(",")] if options.get("bands") else None

    def _ranges(self, h: tiff.Header) -> tuple[range, range]:
        c0, c1, r0, r1 = self.window or (0, h.width - 1, 0, h.height - 1)
        rows, cols = (max(0, r0), min(r1, h.height - 1)), (max(0, c0), min(c1, h.width - 1))
        return tuple(range(a // self.size, b // self.size + 1) if a <= b else range(0) for a, b in (rows, cols))

    def partitions(self) -> list[TileRow]:
        out = []
        for path in self.paths:
            with open(path, "rb") as f:
                h = tiff.header(f)
            rows, cols = self._ranges(h)
            if cols:
                out += [TileRow(path, b, r) for b in self.bands or range(1, h.bands + 1) for r in rows]
        return out or [TileRow("", 0, 0)]

    def read(self, partition: TileRow):
        if not partition.path:
            return
        with open(partition.path, "rb") as f:
            h = tiff.header(f)
            c0, c1, r0, r1 = self.window or (0, h.width - 1, 0, h.height - 1)
            a, b = max(partition.tile_row * self.size, r0), min((partition.tile_row + 1) * self.size, h.height, r1 + 1)
            for j in self._ranges(h)[1]:
                x, y = max(j * self.size, c0), min((j + 1) * self.size, h.width, c1 + 1)
                image = tiff.read_window(f, h, partition.band, a, b, x, y).astype(float)
                gone = np.isnan(image) | ((image == h.nodata) if h.nodata is not None else False)
                data = pa.ListArray.from_arrays(pa.array([0, image.size], pa.int32()), pa.array(image.ravel(), mask=gone.ravel()))
                whole = [partition.band, partition.tile_row, j, a, x, b - a, y - x]
                yield pa.RecordBatch.from_arrays([pa.array([partition.path]), *[pa.array([v], pa.int32()) for v in whole], data], names=["raster_id", "band", "tile_row", "tile_col", "row0", "col0", "n_rows", "n_cols", "data"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RasterSource)


def read_tiles(spark: SparkSession, path: str, tile: int = 256, window: tuple[int, int, int, int] | None = None, bands: list[int] | None = None) -> DataFrame:
    """Tiles of files; window: first and last column, first and last row."""
    register(spark)
    r = spark.read.format("raster").option("path", path).option("tilesize", tile)
    if window:
        r = r.option("window", ",".join(map(str, window)))
    if bands:
        r = r.option("bands", ",".join(map(str, bands)))
    return r.load()


def pixels(tiles: DataFrame) -> DataFrame:
    """(raster_id, band, row, col, value) of tiles."""
    at = tiles.select("raster_id", "band", "row0", "col0", "n_cols", F.posexplode("data").alias("_i", "value"))
    return at.select("raster_id", "band", (F.col("row0") + F.floor(F.col("_i") / F.col("n_cols"))).cast("int").alias("row"), (F.col("col0") + F.col("_i") % F.col("n_cols")).cast("int").alias("col"), "value")


def tiles_of(px: DataFrame, size: int) -> DataFrame:
    """Tiles of a table of pixels; pixels that it lacks are null. A tile's pixels meet in one task, at most size * size of them."""
    at = [F.floor(F.col(c) / size).cast("int").alias(f"tile_{c}") for c in ("row", "col")]

    def run(t: pa.Table) -> pa.Table:
        r, c = t.column("row").to_numpy(), t.column("col").to_numpy()
        r0, c0 = int(r.min()), int(c.min())
        h, w = int(r.max()) - r0 + 1, int(c.max()) - c0 + 1
        image = np.full((h, w), np.nan)
        image[r - r0, c - c0] = t.column("value").to_numpy()
        data = pa.ListArray.from_arrays(pa.array([0, h * w], pa.int32()), pa.array(image.ravel(), mask=np.isnan(image.ravel())))
        whole = [t.column(k)[0].as_py() for k in ("band", "tile_row", "tile_col")] + [r0, c0, h, w]
        return pa.table([pa.array([t.column("raster_id")[0].as_py()]), *[pa.array([v], pa.int32()) for v in whole], data], names=["raster_id", "band", "tile_row", "tile_col", "row0", "col0", "n_rows", "n_cols", "data"])

    dealt = px.select("raster_id", F.col("band").cast("int").alias("band"), *at, "row", "col", F.col("value").cast("double").alias("value"))
    return dealt.groupBy("raster_id", "band", "tile_row", "tile_col").applyInArrow(run, TILES)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """A row a file, read from its header alone. valid_map_info is false without a projection or a transform."""
    found = [p for x in path.split(",") for p in paths_of(x.strip())]

    def run(batches):
        for batch in batches:
            for p in batch.column(0).to_pylist():
                with open(p, "rb") as f:
                    h = tiff.header(f)
                t = list(h.transform) if h.transform else None
                row = [p, h.width, h.height, h.bands, h.dtype.newbyteorder("=").name, h.nodata, h.descriptions, h.epsg, bool(h.epsg and t), t, abs(t[1]) if t else 1.0, abs(t[5]) if t else 1.0, h.rpc]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(META))
    kinds, names = [f.type for f in arrow], arrow.names
    files = spark.createDataFrame([(p,) for p in found], "path string")
    return files.repartition(max(1, min(len(found), 64))).mapInArrow(run, META)


def band_names(meta: DataFrame) -> DataFrame:
    """(raster_id, bands): a map from each band's name, or its number as text without one, to its number."""
    names = F.transform("descriptions", lambda d, i: F.when(F.trim(d) != "", d).otherwise((i + 1).cast("string")))
    return meta.select("raster_id", F.map_from_arrays(names, F.sequence(F.lit(1), F.col("bands"))).alias("bands"))


def correlation_product(px: DataFrame) -> DataFrame:
    """(raster_id, row, col, ew, ns, snr) of files whose bands 1, 2 and 3 they are."""
    pick = lambda b: F.max(F.when(F.col("band") == b, F.col("value")))
    return px.filter("band <= 3").groupBy("raster_id", "row", "col").agg(pick(1).alias("ew"), pick(2).alias("ns"), pick(3).alias("snr"))


def write_rasters(tiles: DataFrame, folder: str, dtype: str = "float32", transform: tuple[float, ...] | None = None, epsg: int | None = None, nodata: float | None = None, descriptions: list[str] | None = None) -> DataFrame:
    """Writes a file a raster_id into a folder that the executors share; (raster_id, path, bytes) of what was written.

    An image is put together in one task, so it has to fit there; larger
    mosaics stay tables of tiles, or are written tile by tile with their own
    transforms (``write_tiles``). Files appear whole: each is written beside
    its place and then renamed, so a task that is tried again does no harm.
    """
    spark = tiles.sparkSession
    name = F.regexp_extract("raster_id", r"([^/]+?)(\.[^./]*)?$", 1)

    def run(t: pa.Table) -> pa.Table:
        r = {c: t.column(c).to_pylist() for c in t.column_names}
        h, w, n = max(a + b for a, b in zip(r["row0"], r["n_rows"])), max(a + b for a, b in zip(r["col0"], r["n_cols"])), max(r["band"])
        fill = nodata if nodata is not None else (np.nan if np.dtype(dtype).kind == "f" else 0)
        image = np.full((n, h, w), fill, float)
        for b, a, c, x, y, d in zip(r["band"], r["row0"], r["col0"], r["n_rows"], r["n_cols"], r["data"]):
            image[b - 1, a : a + x, c : c + y] = np.array([fill if v is None else v for v in d], float).reshape(x, y)
        if np.dtype(dtype).kind in "ui":
            limits = np.iinfo(dtype)
            image = np.clip(np.rint(np.nan_to_num(image, nan=fill)), limits.min, limits.max)
        data = tiff.encode([b.astype(dtype) for b in image], transform, epsg, nodata, descriptions)
        path = os.path.join(folder, f"{r['_name'][0]}.tif")
        os.makedirs(folder, exist_ok=True)
        part = f"{path}.{os.getpid()}.part"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, path)
        return pa.table({"raster_id": [r["raster_id"][0]], "path": [path], "bytes": [len(data)]})

    return tiles.withColumn("_name", name).groupBy("raster_id").applyInArrow(run, "raster_id string, path string, bytes long")


def write_tiles(tiles: DataFrame, folder: str, dtype: str, transform: tuple[float, ...], epsg: int | None = None, nodata: float | None = None) -> DataFrame:
    """Each tile (all its bands) as a file of its own, placed by its transform: (path, tile_row, tile_col)."""
    x0, dx, rx, y0, ry, dy = transform

    def run(t: pa.Table) -> pa.Table:
        r = t.to_pylist()
        r.sort(key=lambda x: x["band"])
        fill = nodata if nodata is not None else 0
        bands = [np.array([fill if v is None else v for v in x["data"]], float).reshape(x["n_rows"], x["n_cols"]).astype(dtype) for x in r]
        a, c = r[0]["row0"], r[0]["col0"]
        data = tiff.encode(bands, (x0 + c * dx + a * rx, dx, rx, y0 + c * ry + a * dy, ry, dy), epsg, nodata)
        path = os.path.join(folder, f"tile_{r[0]['tile_row']}_{r[0]['tile_col']}.tif")
        os.makedirs(folder, exist_ok=True)
        part = f"{path}.{os.getpid()}.part"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, path)
        return pa.table({"path": [path], "tile_row": pa.array([r[0]["tile_row"]], pa.int32()), "tile_col": pa.array([r[0]["tile_col"]], pa.int32())})

    return tiles.groupBy("raster_id", "tile_row", "tile_col").applyInArrow(run, "path string, tile_row int, tile_col int")
