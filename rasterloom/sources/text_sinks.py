"""Text and table sinks: tie points, control points, models, corrections, factors, configurations, file listings."""

from __future__ import annotations

import fnmatch
import json
import os
import tarfile
import zipfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GCP_SCHEMA = "lon double, lat double, alt double, xPix double, yPix double, weight double, opti double, dE double, dN double, dA double, x_map double, y_map double, epsg int, ref_img string, dem string, raw_img string, gcp_id string"


def tie_point_lines(tps: DataFrame, ref: str, raw: str) -> DataFrame:
    """(i, value): comment lines that name the images, then a line a point of six digits, tab separated."""
    spark = tps.sparkSession
    head = spark.createDataFrame([(i, x) for i, x in enumerate(["; tie points", f"; reference: {ref}", f"; raw: {raw}", "; ref_x ref_y raw_x raw_y"])], "i int, value string")
    line = F.concat_ws("\t", *[F.format_string("%.6f", F.col(c).cast("double")) for c in ("ref_x", "ref_y", "raw_x", "raw_y")])
    return head.unionByName(tps.select(F.lit(9).alias("i"), line.alias("value")))


def write_gcps(gcps: DataFrame, path: str, ref_img: str = "", dem: str = "", raw_img: str = "") -> None:
    """Control points as CSV files with a header under a folder, with the names of their images."""
    names = {"ref_img": ref_img, "dem": dem, "raw_img": raw_img}
    out = gcps.withColumns({k: F.lit(v) for k, v in names.items() if k not in gcps.columns})
    out.select(*[c.split()[0] for c in GCP_SCHEMA.split(", ")]).write.mode("overwrite").option("header", True).csv(path)


def write_model(lines: DataFrame, cols: DataFrame, path: str) -> None:
    """A sensor model as tables instead of a pickled object."""
    lines.write.mode("overwrite").parquet(f"{path}/lines")
    cols.write.mode("overwrite").parquet(f"{path}/cols")


def read_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/lines"), spark.read.parquet(f"{path}/cols")


def correction_text(c: np.ndarray) -> str:
    """Three lines of three numbers."""
    return "".join(" ".join(f"{v:.18e}" for v in row) + "\n" for row in np.asarray(c, float).reshape(3, 3))


def optimisation_tables(report: DataFrame, points: DataFrame, path: str) -> None:
    """Reports and control points by loop, a folder a loop."""
    report.write.mode("overwrite").partitionBy("loop").option("header", True).csv(f"{path}/report")
    points.write.mode("overwrite").partitionBy("loop").option("header", True).csv(f"{path}/gcps")


def matrix_lines(df: DataFrame, order: str, values: str) -> DataFrame:
    """(order, value): a line a row of numbers, 25 digits in 15 columns or more."""
    return df.select(order, F.concat_ws(" ", F.transform(values, lambda v: F.format_string("%15.25f", v))).alias("value"))


def components_table(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """(band_name, row, col, value) of component maps or reconstructions, one name a table."""
    out = None
    for name, df in parts:
        now = df.select(F.lit(name).alias("band_name"), "row", "col", "value")
        out = now if out is None else out.unionByName(now)
    return out


def as_json(*columns: str | Column) -> Column:
    return F.to_json(F.struct(*columns))


def plain(value):
    """Numbers and arrays of numpy as Python's, for ``json``."""
    if isinstance(value, np.generic):
        return value.item()
    if isinstance(value, np.ndarray):
        return value.tolist()
    if hasattr(value, "as_tuple"):
        return float(value)
    raise TypeError(type(value).__name__)


def read_config(path: str) -> dict:
    """A JSON or YAML mapping; empty texts are None. YAML is read as far as nested mappings, lists and scalars go."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    return blank(json.loads(text) if path.endswith(".json") else yaml_mapping(text))


def blank(v):
    return {k: blank(x) for k, x in v.items()} if isinstance(v, dict) else [blank(x) for x in v] if isinstance(v, list) else None if v == "" else v


def yaml_mapping(text: str) -> dict:
    """Indented mappings, lists in brackets or with dashes, and scalars; comments go."""
    rows = []
    for line in text.split("\n"):
        line = line.split(" #")[0].rstrip()
        if line.strip() and not line.lstrip().startswith(("#", "---")):
            rows.append((len(line) - len(line.lstrip()), line.strip()))

    def scalar(s: str):
        s = s.strip()
        if s[:1] == "[" and s[-1:] == "]":
            return [scalar(x) for x in s[1:-1].split(",") if x.strip()]
        if s[:1] in "'\"" and s[-1:] == s[:1] and len(s) > 1:
            return s[1:-1]
        low = s.lower()
        if low in ("true", "yes", "on", "false", "no", "off"):
            return low in ("true", "yes", "on")
        if low in ("null", "none", "~", ""):
            return None
        for kind in (int, float):
            try:
                return kind(s)
            except ValueError:
                pass
        return s

    def block(i: int, depth: int):
        if rows[i][1].startswith("- ") or rows[i][1] == "-":
            out = []
            while i < len(rows) and rows[i][0] == depth and rows[i][1].startswith("-"):
                out.append(scalar(rows[i][1][1:]))
                i += 1
            return out, i
        found: dict = {}
        while i < len(rows) and rows[i][0] == depth:
            key, _, rest = rows[i][1].partition(":")
            i += 1
            if rest.strip():
                found[key.strip()] = scalar(rest)
            elif i < len(rows) and (rows[i][0] > depth or rows[i][0] == depth and rows[i][1].startswith("-")):
                found[key.strip()], i = block(i, rows[i][0])
            else:
                found[key.strip()] = None
        return found, i

    return block(0, rows[0][0])[0] if rows else {}


def at(config: dict, dotted: str, default=None):
    """A value by its path, the default where a step is missing."""
    for step in dotted.split("."):
        if not isinstance(config, dict) or step not in config:
            return default
        config = config[step]
    return config


def listing(spark: SparkSession, folder: str, patterns: list[str] | None = None, without: list[str] | None = None, suffixes: list[str] | None = None, deep: bool = False) -> DataFrame:
    """(path, bytes) of files whose names match a pattern or suffix and hold none of the excluded words. Names only; files aren't read."""
    got = spark.read.format("binaryFile").option("recursiveFileLookup", deep).load(folder).select("path", F.col("length").alias("bytes"))
    name = F.element_at(F.split("path", "/"), -1)
    if patterns:
        got = got.filter(name.rlike("|".join(f"(?:{fnmatch.translate(p)})" for p in patterns)))
    if suffixes:
        got = got.filter(F.exists(F.array(*[F.lit(s) for s in suffixes]), lambda s: F.endswith(name, s)))
    for word in without or []:
        got = got.filter(~F.contains(name, F.lit(word)))
    return got.orderBy("path")


def expand_images(text: str) -> list[str]:
    """Paths of a list: comma separated names and patterns, or a .txt file with one a line."""
    import glob

    if text.endswith(".txt"):
        with open(text, encoding="utf-8") as f:
            parts = f.read().split("\n")
    else:
        parts = text.split(",")
    out: list[str] = []
    for p in (x.strip() for x in parts):
        if p:
            out += sorted(glob.glob(p)) if glob.has_magic(p) else [p]
    return out


def archive_members(path: str) -> list[str]:
    """Names in a tar or zip archive, in order."""
    if tarfile.is_tarfile(path):
        with tarfile.open(path) as t:
            return sorted(m.name for m in t.getmembers() if m.isfile())
    with zipfile.ZipFile(path) as z:
        return sorted(n for n in z.namelist() if not n.endswith("/"))


def extract(path: str, folder: str) -> list[str]:
    """Unpacks an archive's files into a folder; members that would leave it are an error."""
    os.makedirs(folder, exist_ok=True)
    names = archive_members(path)
    for n in names:
        if not os.path.realpath(os.path.join(folder, n)).startswith(os.path.realpath(folder) + os.sep):
            raise ValueError(f"{n} lies outside the folder")
    if tarfile.is_tarfile(path):
        with tarfile.open(path) as t:
            t.extractall(folder, members=[t.getmember(n) for n in names], filter="data")
    else:
        with zipfile.ZipFile(path) as z:
            z.extractall(folder, names)
    return [os.path.join(folder, n) for n in names]
