"""RPC text: parsing on the driver for one model, and as a table for many files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALARS = ("LINE_OFF", "SAMP_OFF", "LAT_OFF", "LONG_OFF", "HEIGHT_OFF", "LINE_SCALE", "SAMP_SCALE", "LAT_SCALE", "LONG_SCALE", "HEIGHT_SCALE")
VECTORS = ("LINE_NUM_COEFF", "LINE_DEN_COEFF", "SAMP_NUM_COEFF", "SAMP_DEN_COEFF")


@dataclass(frozen=True)
class Rfm:
    """Offsets and scales by key, and four vectors of 20 coefficients (ground to image)."""

    scalars: dict[str, float]
    line_num: tuple[float, ...]
    line_den: tuple[float, ...]
    samp_num: tuple[float, ...]
    samp_den: tuple[float, ...]


def parse_rpc(text: str) -> Rfm:
    """A model from ``KEY: value`` lines, units after the value allowed; a missing key is a ValueError."""
    found: dict[str, float] = {}
    for line in text.splitlines():
        key, colon, value = line.partition(":")
        if colon and value.split():
            found.setdefault(key.strip(), float(value.split()[0]))
    wanted = [*SCALARS, *(f"{v}_{i}" for v in VECTORS for i in range(1, 21))]
    if missing := [k for k in wanted if k not in found]:
        raise ValueError(f"RPC text without {', '.join(missing[:3])}")
    return Rfm({k: found[k] for k in SCALARS}, *(tuple(found[f"{v}_{i}"] for i in range(1, 21)) for v in VECTORS))


def from_tag(values: list[float]) -> Rfm:
    """A model from an image's RPC tag: two errors, the offsets and scales, then the four vectors."""
    if values is None or len(values) < 92:
        raise ValueError("the image has no RPC tag of 92 numbers")
    v = [float(x) for x in values]
    return Rfm(dict(zip(SCALARS, v[2:12], strict=True)), *(tuple(v[12 + 20 * i : 32 + 20 * i]) for i in range(4)))


def from_metadata(tags: dict[str, str]) -> Rfm:
    """A model from named texts, the vectors as 20 numbers with spaces between."""
    try:
        vectors = [tuple(float(x) for x in tags[k].split()) for k in VECTORS]
        scalars = {k: float(tags[k].split()[0]) for k in SCALARS}
    except KeyError as e:
        raise ValueError(f"the metadata lack {e.args[0]}") from e
    if any(len(x) != 20 for x in vectors):
        raise ValueError("a vector of the metadata hasn't 20 numbers")
    return Rfm(scalars, *vectors)


def load_rfm(path: str) -> Rfm:
    """By the file's extension: TIFF images by their tag, RPC XML and RPB aren't read, anything else is RPC text."""
    end = path.lower().rsplit(".", 1)[-1]
    if end in ("xml", "rpb"):
        raise NotImplementedError(f"models in {end} files aren't read")
    try:
        if end in ("tif", "tiff"):
            from ..kernels import tiff

            with open(path, "rb") as f:
                return from_tag(tiff.header(f).rpc)
        with open(path, encoding="utf-8") as f:
            return parse_rpc(f.read())
    except (OSError, ValueError) as e:
        raise OSError(f"no model in {path}: {e}") from e


def rpc_entries(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """(key, idx, coeff) of a table of RPC lines: scalars have idx 0, vectors 1 to 20; other lines are dropped."""
    m = F.regexp_extract(line_col, r"^\s*([A-Z_]+?)(?:_(\d+))?\s*:\s*([-+0-9.eE]+)", 0)
    key = F.regexp_extract(line_col, r"^\s*([A-Z_]+?)(?:_(\d+))?\s*:\s*([-+0-9.eE]+)", 1)
    idx = F.regexp_extract(line_col, r"^\s*([A-Z_]+?)(?:_(\d+))?\s*:\s*([-+0-9.eE]+)", 2)
    val = F.regexp_extract(line_col, r"^\s*([A-Z_]+?)(?:_(\d+))?\s*:\s*([-+0-9.eE]+)", 3)
    return lines.filter(m != "").select(key.alias("key"), F.coalesce(F.nullif(idx, F.lit("")).cast("int"), F.lit(0)).alias("idx"), val.cast("double").alias("coeff"))
