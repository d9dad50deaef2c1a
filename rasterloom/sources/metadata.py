"""Metadata of satellite scenes: DIMAP (SPOT 1-5, SPOT 6/7) and DigitalGlobe (XML and ASCII) to the builders' dictionaries."""

from __future__ import annotations

import os
import re
import xml.etree.ElementTree as ET
from datetime import datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checks import SENSORS
from ..kernels import pushbroom


def seconds(text: str, year: int = 1950) -> float:
    """Since the beginning of a year, with or without a Z at the end."""
    text = text.strip().removesuffix("Z")
    whole, _, part = text.partition(".")
    return (datetime.strptime(whole, "%Y-%m-%dT%H:%M:%S") - datetime(year, 1, 1)).total_seconds() + float(f"0.{part or 0}")


class _Tree:
    def __init__(self, text: str):
        self.root = ET.fromstring(text)

    def all(self, path: str) -> list[str]:
        return [(e.text or "").strip() for e in self.root.findall(f".//{path}")]

    def one(self, path: str, default=None) -> str:
        found = self.all(path)
        if not found and default is None:
            raise ValueError(f"the metadata lack {path}")
        return found[0] if found else default

    def numbers(self, *paths: str) -> np.ndarray:
        return np.array([[float(v) for v in self.all(p)] for p in paths]).T

    def times(self, path: str) -> np.ndarray:
        return np.array([seconds(v) for v in self.all(path)])


def spot15(text: str) -> dict:
    """Of a SPOT 1-5 DIMAP file."""
    x = _Tree(text)
    d = {
        "cols": int(x.one("NCOLS")), "lines": int(x.one("NROWS")), "bands": int(x.one("NBANDS")), "mission": int(x.one("MISSION_INDEX")), "instrument": int(x.one("INSTRUMENT_INDEX")),
        "sun_azimuth": float(x.one("SUN_AZIMUTH")), "sun_elevation": float(x.one("SUN_ELEVATION")), "incidence": float(x.one("INCIDENCE_ANGLE")), "date": x.one("IMAGING_DATE"), "time": x.one("IMAGING_TIME"),
        "line_period": float(x.one("Sensor_Configuration//Time_Stamp//LINE_PERIOD")), "centre_time": seconds(x.one("Sensor_Configuration//Time_Stamp//SCENE_CENTER_TIME")), "centre_line": int(x.one("Sensor_Configuration//Time_Stamp//SCENE_CENTER_LINE")),
        "mirror_step": int(x.one("Mirror_Position//STEP_COUNT", "0")), "ephemeris_time": x.times("Points//TIME"),
    }
    looks = x.numbers("Look_Angles_List//Look_Angles//PSI_X", "Look_Angles_List//Look_Angles//PSI_Y")
    d |= {"psi_x": looks[:, 0], "psi_y": looks[:, 1], "position": x.numbers(*(f"Points//Location//{c}" for c in "XYZ")), "velocity": x.numbers(*(f"Points//Velocity//{c}" for c in "XYZ"))}
    angles = ("YAW", "PITCH", "ROLL")
    flags = lambda p: np.array([v == "Y" for v in x.all(p)])
    if d["mission"] == 5:
        at = "Corrected_Attitude//"
        return d | {"attitude_time": x.times(at + "TIME"), "attitude": x.numbers(*(at + a for a in angles)), "attitude_bad": flags(at + "OUT_OF_RANGE")}
    raw = "Raw_Attitudes//Aocs_Attitude//"
    once, rate = raw + "Angles_List//Angles//", raw + "Angular_Speeds_List//Angular_Speeds//"
    return d | {"angle_time": x.times(once + "TIME"), "angle": x.numbers(*(once + a for a in angles)), "angle_bad": flags(once + "OUT_OF_RANGE"), "rate_time": x.times(rate + "TIME"), "rate": x.numbers(*(rate + a for a in angles)), "rate_bad": flags(rate + "OUT_OF_RANGE")}


def spot67(text: str) -> dict:
    """Of a SPOT 6/7 DIMAP file; quaternions have their scalar last."""
    x = _Tree(text)
    triples = lambda p: np.array([[float(v) for v in t.split()] for t in x.all(p)])
    return {
        "cols": int(x.one("NCOLS")), "lines": int(x.one("NROWS")), "bands": int(x.one("NBANDS")), "instrument": x.one("INSTRUMENT", ""), "date": x.one("IMAGING_DATE", ""), "time": x.one("IMAGING_TIME", ""),
        "sun_azimuth": float(x.one("Use_Area//SUN_AZIMUTH")), "sun_elevation": float(x.one("Use_Area//SUN_ELEVATION")), "azimuth": float(x.one("Use_Area//AZIMUTH_ANGLE")), "viewing": float(x.one("Use_Area//VIEWING_ANGLE")), "incidence": float(x.one("Use_Area//INCIDENCE_ANGLE")), "altitude": float(x.one("Use_Area//SATELLITE_ALTITUDE")),
        "gsd": (float(x.one("Use_Area//GSD_ACROSS_TRACK")) + float(x.one("Use_Area//GSD_ALONG_TRACK"))) / 2,
        "start": seconds(x.one("Refined_Model/Time/Time_Range/START")), "end": seconds(x.one("Refined_Model/Time/Time_Range/END")), "line_period": float(x.one("Refined_Model/Time/Time_Stamp/LINE_PERIOD")) / 1e6, "focal": float(x.one("Refined_Model//FOCAL_LENGTH")),
        "los_x": [float(x.one(f"Refined_Model//Polynomial_Look_Angles/XLOS_{i}")) for i in (0, 1)], "los_y": [float(x.one(f"Refined_Model//Polynomial_Look_Angles/YLOS_{i}")) for i in (0, 1)],
        "ephemeris_time": x.times("Refined_Model/Ephemeris//Point/TIME"), "position": triples("Refined_Model/Ephemeris//Point/LOCATION_XYZ"), "velocity": triples("Refined_Model/Ephemeris//Point/VELOCITY_XYZ"),
        "attitude_time": x.times("Refined_Model/Attitudes//Quaternion/TIME"), "quaternion": x.numbers(*(f"Refined_Model/Attitudes//Quaternion/Q{i}" for i in (1, 2, 3, 0))),
    }


def _frames(lines: int, first: float, rate: float, direction: str, eph: np.ndarray, eph_at: tuple[float, float], att: np.ndarray, att_at: tuple[float, float]) -> dict:
    """Rows of the lists are put in the order of their first column."""
    eph, att = eph[np.argsort(eph[:, 0])], att[np.argsort(att[:, 0])]
    return {
        "lines": lines, "first_line_time": first, "line_rate": rate, "forward": "forward" in direction.lower(), "position": eph[:, 1:4], "velocity": eph[:, 4:7], "quaternion": att[:, 1:5],
        "ephemeris_time": eph_at[0] + eph_at[1] * np.arange(len(eph)), "attitude_time": att_at[0] + att_at[1] * np.arange(len(att)),
    }


def digital_globe_xml(text: str) -> dict:
    x = _Tree(text)
    rows = lambda p: np.array([[float(v) for v in t.split()] for t in x.all(p)])
    at = lambda part: (seconds(x.one(f"{part}//STARTTIME"), 2000), float(x.one(f"{part}//TIMEINTERVAL")))
    d = _frames(int(x.one("NUMROWS")), seconds(x.one("FIRSTLINETIME"), 2000), float(x.one("AVGLINERATE")), x.one("SCANDIRECTION"), rows("EPH//EPHEMLIST"), at("EPH"), rows("ATT//ATTLIST"), at("ATT"))
    return d | {
        "cols": int(x.one("NUMCOLUMNS")), "platform": x.one("SATID"), "band": x.one("BANDID"), "level": x.one("IMAGEDESCRIPTOR"), "gsd": float(x.one("MEANPRODUCTGSD", x.one("MEANCOLLECTEDCOLGSD", "nan"))),
        "sun_azimuth": float(x.one("MEANSUNAZ")), "sun_elevation": float(x.one("MEANSUNEL")), "sat_elevation": float(x.one("MEANSATEL")), "sat_azimuth": float(x.one("MEANSATAZ")), "off_nadir": float(x.one("MEANOFFNADIRVIEWANGLE")),
        "focal": float(x.one("GEO//PD")), "camera_quaternion": [float(x.one(f"GEO//QCS{i}")) for i in (1, 2, 3, 4)], "detector_origin": [float(x.one("GEO//DETORIGINX")), float(x.one("GEO//DETORIGINY"))], "detector_pitch": float(x.one("GEO//DETPITCH")),
    }


def entry(text: str, key: str, default=None) -> str:
    """The value of ``key = value;``, without quotes."""
    m = re.search(rf"(?m)^\s*{re.escape(key)}\s*=\s*(.*?)\s*;", text)
    if not m and default is None:
        raise ValueError(f"the metadata lack {key}")
    return m[1].strip('"') if m else default


def rows_of(text: str, key: str) -> np.ndarray:
    """The rows of ``key = ((...), (...));``."""
    m = re.search(rf"{re.escape(key)}\s*=\s*\((.*?)\)\s*;", text, re.S)
    if not m:
        raise ValueError(f"the metadata lack {key}")
    return np.array([[float(v) for v in row.split(",")] for row in re.findall(r"\(([^()]*)\)", m[1] + ")")])


def digital_globe_ascii(imd: str, eph: str, att: str, geo: str) -> dict:
    at = lambda t: (seconds(entry(t, "startTime"), 2000), float(entry(t, "timeInterval")))
    d = _frames(int(entry(imd, "numRows")), seconds(entry(imd, "firstLineTime"), 2000), float(entry(imd, "avgLineRate")), entry(imd, "scanDirection"), rows_of(eph, "ephemList"), at(eph), rows_of(att, "attList"), at(att))
    return d | {
        "cols": int(entry(imd, "numColumns")), "platform": entry(imd, "satId"), "band": entry(imd, "bandId"), "level": entry(imd, "imageDescriptor"), "gsd": float(entry(imd, "meanProductGSD", "nan")),
        "sun_azimuth": float(entry(imd, "meanSunAz", entry(imd, "sunAz", "nan"))), "sun_elevation": float(entry(imd, "meanSunEl", entry(imd, "sunEl", "nan"))), "sat_elevation": float(entry(imd, "meanSatEl", "nan")), "sat_azimuth": float(entry(imd, "meanSatAz", "nan")), "off_nadir": float(entry(imd, "meanOffNadirViewAngle", "nan")),
        "focal": float(entry(geo, "PD")), "camera_quaternion": [float(entry(geo, f"qcs{i}")) for i in (1, 2, 3, 4)], "detector_origin": [float(entry(geo, "detOriginX")), float(entry(geo, "detOriginY"))], "detector_pitch": float(entry(geo, "detPitch")),
    }


def read_scene(path: str, sensor: str) -> dict:
    """The dictionary of a metadata file; ASCII files of DigitalGlobe need their .IMD, .EPH, .ATT and .GEO beside each other."""
    kind = builder_of(sensor)
    if kind == "dg" and not path.lower().endswith(".xml"):
        base = os.path.splitext(path)[0]
        return digital_globe_ascii(*(_text(base + e) for e in (".IMD", ".EPH", ".ATT", ".GEO")))
    return {"spot15": spot15, "spot67": spot67, "dg": digital_globe_xml}[kind](_text(path))


def _text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def builder_of(sensor: str) -> str:
    for kind, names in SENSORS.items():
        if sensor.lower() in (n.lower() for n in names):
            return kind
    raise ValueError(f"sensor {sensor} isn't supported")


def build(path: str, sensor: str, ccd: np.ndarray | None = None) -> pushbroom.Sensor:
    """The model of a scene from its metadata. ccd: misalignment of its detectors."""
    d = read_scene(path, sensor)
    return pushbroom.BUILDERS[builder_of(sensor)](d | {"ccd": ccd} if ccd is not None else d)


def ccd_table(spark: SparkSession, path: str) -> DataFrame:
    """(col, dx, dy, dz) of a detector misalignment table, three numbers a line; the line's place is the column."""
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")).alias("col", "v"))
    part = lambda k: F.element_at(F.split(F.trim("v"), r"\s+"), k).cast("double")
    return lines.select("col", part(1).alias("dx"), part(2).alias("dy"), part(3).alias("dz"))
