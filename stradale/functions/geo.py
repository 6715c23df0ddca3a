"""Geodesics on the WGS84 ellipsoid by Vincenty's inverse formula, five iterations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 5
_A, _F = "6378137e0", "(1e0/298257223563e-9)"
_B = f"({_A}*(1-{_F}))"
_ROUND = [
    ("sl", "sin(lam)"), ("cl", "cos(lam)"),
    ("ss", "sqrt((cu2*sl)*(cu2*sl)+(cu1*su2-su1*cu2*cl)*(cu1*su2-su1*cu2*cl))"),
    ("cs", "su1*su2+cu1*cu2*cl"), ("sg", "atan2(ss,cs)"),
    ("sa", "case when ss=0 then 0e0 else cu1*cu2*sl/ss end"), ("ca", "1-sa*sa"),
    ("cm", "case when ca=0 then 0e0 else cs-2*su1*su2/ca end"),
    ("cc", f"{_F}/16*ca*(4+{_F}*(4-3*ca))"),
    ("lam", f"ll+(1-cc)*{_F}*sa*(sg+cc*ss*(cm+cc*cs*(-1+2*cm*cm)))"),
]


def steps(lon1: str, lat1: str, lon2: str, lat2: str, rounds: int = ROUNDS) -> list[tuple[str, str]]:
    """Names and SQL expressions in order; the last are ``dist`` in metres and ``azimuth`` in degrees from north, 0 to 360."""
    out = [("ll", f"radians({lon2}-{lon1})"), ("u1", f"atan((1-{_F})*tan(radians({lat1})))"), ("u2", f"atan((1-{_F})*tan(radians({lat2})))")]
    out += [("su1", "sin(u1)"), ("cu1", "cos(u1)"), ("su2", "sin(u2)"), ("cu2", "cos(u2)"), ("lam", "ll")]
    for _ in range(rounds):
        out += _ROUND
    out += [("w", f"ca*({_A}*{_A}-{_B}*{_B})/({_B}*{_B})"), ("aa", "1+w/16384*(4096+w*(-768+w*(320-175*w)))"), ("bb", "w/1024*(256+w*(-128+w*(74-47*w)))")]
    out += [("ds", "bb*ss*(cm+bb/4*(cs*(-1+2*cm*cm)-bb/6*cm*(-3+4*ss*ss)*(-3+4*cm*cm)))")]
    out += [("dist", f"case when ss=0 then 0e0 else {_B}*aa*(sg-ds) end"), ("az", "degrees(atan2(cu2*sl,cu1*su2-su1*cu2*cl))")]
    return [*out, ("azimuth", "az-360*floor(az/360)")]


def _inverse(lon1, lat1, lon2, lat2) -> tuple[np.ndarray, np.ndarray]:
    names = {"lon1": lon1, "lat1": lat1, "lon2": lon2, "lat2": lat2}
    known = {k: np.asarray(v, float) for k, v in names.items()}
    a, f = 6378137.0, 1 / 298.257223563
    b = a * (1 - f)
    delta = np.radians(known["lon2"] - known["lon1"])
    u1, u2 = np.arctan((1 - f) * np.tan(np.radians(known["lat1"]))), np.arctan((1 - f) * np.tan(np.radians(known["lat2"])))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam = delta
    with np.errstate(all="ignore"):
        for _ in range(ROUNDS):
            sl, cl = np.sin(lam), np.cos(lam)
            ss, cs = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl), s1 * s2 + c1 * c2 * cl
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss == 0, 0.0, c1 * c2 * sl / ss)
            ca = 1 - sa * sa
            cm = np.where(ca == 0, 0.0, cs - 2 * s1 * s2 / ca)
            k = f / 16 * ca * (4 + f * (4 - 3 * ca))
            lam = delta + (1 - k) * f * sa * (sigma + k * ss * (cm + k * cs * (2 * cm * cm - 1)))
        w = ca * (a * a - b * b) / (b * b)
        big, small = 1 + w / 16384 * (4096 + w * (w * (320 - 175 * w) - 768)), w / 1024 * (256 + w * (w * (74 - 47 * w) - 128))
        shift = small * ss * (cm + small / 4 * (cs * (2 * cm * cm - 1) - small / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
        dist = np.where(ss == 0, 0.0, b * big * (sigma - shift))
    return dist, np.degrees(np.arctan2(c2 * sl, c1 * s2 - s1 * c2 * cl)) % 360


def _geodesic(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(("dist", "azimuth"), _inverse(lon1, lat1, lon2, lat2))))


def with_geodesic(df: DataFrame, lon1: str, lat1: str, lon2: str, lat2: str, dist: str = "dist", azimuth: str = "azimuth") -> DataFrame:
    """``df`` with the distance and forward azimuth between two points; null coordinates give nulls, equal points 0.

    The five rounds are a vectorized kernel: as column expressions every use of a step repeats all steps before it once a filter
    on the distance is pushed down, and planning does not end.
    """
    kernel = F.pandas_udf(_geodesic, "dist double, azimuth double")
    out = df.withColumn("_g", kernel(*(F.col(c).cast("double") for c in (lon1, lat1, lon2, lat2))))
    return out.select(*df.columns, F.col("_g.dist").alias(dist), F.col("_g.azimuth").alias(azimuth))


def geodesic_sql(source: str, lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    """A subquery that adds ``dist`` and ``azimuth`` to ``source``, one level for each independent step."""
    query = f"SELECT * FROM {source}"
    for name, expr in steps(lon1, lat1, lon2, lat2):
        column = f"* REPLACE ({expr} AS {name})" if f" AS {name}" in query else f"*, {expr} AS {name}"
        query = f"SELECT {column} FROM ({query})"
    return query


def angular_difference(a: Column, b: Column) -> Column:
    """Smallest angle between two bearings, 0 to 180."""
    return F.abs(F.pmod(a - b + 180, F.lit(360.0)) - 180)


def reverse_bearing(a: Column) -> Column:
    return F.pmod(a + 180, F.lit(360.0))
