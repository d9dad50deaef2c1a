"""Small text formats: tie points, correction matrices, ground control points, path lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GCP_SCHEMA = "lon double, lat double, alt double, xPix double, yPix double, weight double, opti int, dE double, dN double, dA double, x_map double, y_map double, epsg int, ref_img string, dem string, raw_img string, gcp_id string"


def parse_tie_points(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """ref_x, ref_y, raw_x, raw_y; lines that begin with ; or hold fewer than four numbers are left out."""
    parts = F.split(F.trim(line_col), r"[\s,]+")
    v = [F.try_element_at(parts, F.lit(i)).try_cast("double") for i in (1, 2, 3, 4)]
    named = lines.filter(~F.ltrim(line_col).startswith(";")).select(*[c.alias(n) for c, n in zip(v, ("ref_x", "ref_y", "raw_x", "raw_y"), strict=True)])
    return named.dropna()


def read_tie_points(spark: SparkSession, path: str) -> DataFrame:
    return parse_tie_points(spark.read.text(path))


def read_gcps(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of ground control points with a header; an unnamed index column is ignored."""
    raw = spark.read.option("header", True).csv(path)
    kinds = dict(x.strip().rsplit(" ", 1) for x in GCP_SCHEMA.split(","))
    return raw.select(*[F.col(c).cast(kinds[c]).alias(c) for c in kinds if c in raw.columns])


def write_tie_points(df: DataFrame, path: str) -> None:
    """Tab-separated lines with six decimals."""
    df.select(F.concat_ws("\t", *[F.format_string("%.6f", c) for c in ("ref_x", "ref_y", "raw_x", "raw_y")]).alias("value")).write.text(path)


def read_correction(spark: SparkSession, path: str | None) -> list[float]:
    """Nine numbers of a 3 x 3 matrix by rows; zeros where no file is named."""
    if path is None:
        return [0.0] * 9
    got = [float(x) for r in spark.read.text(path, wholetext=True).limit(1).collect() for x in r.value.split()]
    if len(got) != 9:
        raise ValueError("a correction has nine numbers")
    return got


def expand_list(value: str) -> list[str]:
    """Comma-separated paths or patterns, trimmed, empty ones left out."""
    return [x.strip() for x in value.split(",") if x.strip()]


def stem(path: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def correlation_name(base: Column, target: Column, correlator: str, window: int, step: int) -> Column:
    return F.concat(stem(base), F.lit("_VS_"), stem(target), F.lit(f"_{correlator}_wz_{window}_step_{step}.tif"))
