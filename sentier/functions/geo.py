"""Distance expressions (F15, F16, F17) as native column maths."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from sentier import constants as K


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _central_angle(p1, l1, p2, l2) -> Column:
    """Central angle (radians) between two points given in radians, in the
    atan2 form that stays accurate for tiny and antipodal separations."""
    dl = l2 - l1
    num = F.sqrt(F.pow(F.cos(p2) * F.sin(dl), 2)
                 + F.pow(F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl), 2))
    den = F.sin(p1) * F.sin(p2) + F.cos(p1) * F.cos(p2) * F.cos(dl)
    return F.atan2(num, den)


def great_circle_km(lat1, lon1, lat2, lon2, radius_km: float = K.GREAT_CIRCLE_RADIUS_KM) -> Column:
    """great-circle distance on a sphere of ``radius_km``."""
    p1, l1 = F.radians(_c(lat1)), F.radians(_c(lon1))
    p2, l2 = F.radians(_c(lat2)), F.radians(_c(lon2))
    return F.lit(radius_km) * _central_angle(p1, l1, p2, l2)


def geodesic_m(lat1, lon1, lat2, lon2) -> Column:
    """F16: distance on the WGS-84 ellipsoid in metres, Lambert's formula.

    Reduced latitudes give the central angle; a first-order flattening
    correction brings it to the ellipsoid (relative error ~1e-6 at city scale).
    """
    f = K.WGS84_F
    b1 = F.atan(F.lit(1 - f) * F.tan(F.radians(_c(lat1))))
    b2 = F.atan(F.lit(1 - f) * F.tan(F.radians(_c(lat2))))
    sigma = _central_angle(b1, F.radians(_c(lon1)), b2, F.radians(_c(lon2)))
    p = (b1 + b2) / 2
    q = (b2 - b1) / 2
    x = (sigma - F.sin(sigma)) * F.pow(F.sin(p), 2) * F.pow(F.cos(q), 2) / F.pow(F.cos(sigma / 2), 2)
    y = F.try_divide((sigma + F.sin(sigma)) * F.pow(F.cos(p), 2) * F.pow(F.sin(q), 2), F.pow(F.sin(sigma / 2), 2))
    d = F.lit(K.WGS84_A_M) * (sigma - F.lit(f / 2) * (x + y))
    return F.when(sigma == 0, F.lit(0.0)).otherwise(d)


def with_geodesic_m(df, out: str, lat1, lon1, lat2, lon2):
    """F16 added as a column in three small projections (reduced latitudes,
    central angle, flattening correction). Same value as ``geodesic_m`` but
    each step stays far below the code-generation size limit."""
    f = K.WGS84_F
    t = "_g" + out
    df = df.withColumns({t + "b1": F.atan(F.lit(1 - f) * F.tan(F.radians(_c(lat1)))),
                         t + "b2": F.atan(F.lit(1 - f) * F.tan(F.radians(_c(lat2)))),
                         t + "dl": F.radians(_c(lon2)) - F.radians(_c(lon1))})
    b1, b2 = F.col(t + "b1"), F.col(t + "b2")
    df = df.withColumn(t + "s", _central_angle(b1, F.lit(0.0), b2, F.col(t + "dl")))
    sigma = F.col(t + "s")
    p = (b1 + b2) / 2
    q = (b2 - b1) / 2
    x = (sigma - F.sin(sigma)) * F.pow(F.sin(p), 2) * F.pow(F.cos(q), 2) / F.pow(F.cos(sigma / 2), 2)
    y = F.try_divide((sigma + F.sin(sigma)) * F.pow(F.cos(p), 2) * F.pow(F.sin(q), 2), F.pow(F.sin(sigma / 2), 2))
    d = F.lit(K.WGS84_A_M) * (sigma - F.lit(f / 2) * (x + y))
    keep = [F.col(c) for c in df.columns if c not in (t + "b1", t + "b2", t + "dl", t + "s", out)]
    return df.select(*keep, F.when(sigma == 0, F.lit(0.0)).otherwise(d).alias(out))


def point_terms(df, lat: str, lon: str, prefix: str, metric: str):
    """Per-point terms of the distance formulas, computed once per row of each
    side before a join so the per-pair expression stays small: latitude
    (reduced latitude on the ellipsoid) and its sine/cosine, longitude in radians."""
    if metric == "geodesic":
        beta = F.atan(F.lit(1 - K.WGS84_F) * F.tan(F.radians(F.col(lat))))
    else:
        beta = F.radians(F.col(lat))
    df = df.withColumn(prefix + "b", beta)
    return df.withColumns({prefix + "sb": F.sin(F.col(prefix + "b")), prefix + "cb": F.cos(F.col(prefix + "b")),
                           prefix + "l": F.radians(F.col(lon))})


def pair_distance_km(metric: str, a: str, b: str) -> Column:
    """Distance between two points given by their ``point_terms`` prefixes."""
    dl = F.col(b + "l") - F.col(a + "l")
    sdl, cdl = F.sin(dl), F.cos(dl)
    sb1, cb1, sb2, cb2 = F.col(a + "sb"), F.col(a + "cb"), F.col(b + "sb"), F.col(b + "cb")
    num = F.sqrt(F.pow(cb2 * sdl, 2) + F.pow(cb1 * sb2 - sb1 * cb2 * cdl, 2))
    den = sb1 * sb2 + cb1 * cb2 * cdl
    sigma = F.atan2(num, den)
    if metric == "sphere":
        return F.lit(K.GREAT_CIRCLE_RADIUS_KM) * sigma
    f = K.WGS84_F
    p = (F.col(a + "b") + F.col(b + "b")) / 2
    q = (F.col(b + "b") - F.col(a + "b")) / 2
    x = (sigma - F.sin(sigma)) * F.pow(F.sin(p), 2) * F.pow(F.cos(q), 2) / F.pow(F.cos(sigma / 2), 2)
    y = F.try_divide((sigma + F.sin(sigma)) * F.pow(F.cos(p), 2) * F.pow(F.sin(q), 2), F.pow(F.sin(sigma / 2), 2))
    d = F.lit(K.WGS84_A_M / 1000.0) * (sigma - F.lit(f / 2) * (x + F.coalesce(y, F.lit(0.0))))
    return d


def with_pair_distance_km(df, out: str, metric: str, a: str, b: str):
    """``pair_distance_km`` added in two projections: the central angle first
    (its own column), then the formula that uses it several times, so no
    generated method repeats the angle's trigonometry."""
    df = df.withColumn("_sig", central_angle(*({c: F.col(p + c) for c in ("sb", "cb", "l")} for p in (a, b))))
    return df.withColumn(out, angle_km(metric, F.col(a + "b"), F.col(b + "b"), F.col("_sig"))).drop("_sig")


def central_angle(a, b) -> Column:
    """The central angle between two points whose terms (sb, cb, l) are given by name."""
    dl = b["l"] - a["l"]
    num = F.sqrt(F.pow(b["cb"] * F.sin(dl), 2) + F.pow(a["cb"] * b["sb"] - a["sb"] * b["cb"] * F.cos(dl), 2))
    den = a["sb"] * b["sb"] + a["cb"] * b["cb"] * F.cos(dl)
    return F.atan2(num, den)


def angle_km(metric: str, b1: Column, b2: Column, sigma: Column) -> Column:
    """Kilometres for a central angle between two (reduced) latitudes."""
    if metric == "sphere":
        return F.lit(K.GREAT_CIRCLE_RADIUS_KM) * sigma
    f = K.WGS84_F
    p = (b1 + b2) / 2
    q = (b2 - b1) / 2
    x = (sigma - F.sin(sigma)) * F.pow(F.sin(p), 2) * F.pow(F.cos(q), 2) / F.pow(F.cos(sigma / 2), 2)
    y = F.try_divide((sigma + F.sin(sigma)) * F.pow(F.cos(p), 2) * F.pow(F.sin(q), 2), F.pow(F.sin(sigma / 2), 2))
    return F.lit(K.WGS84_A_M / 1000.0) * (sigma - F.lit(f / 2) * (x + F.coalesce(y, F.lit(0.0))))


def with_distance_km(df, out: str, metric: str, lat1, lon1, lat2, lon2):
    if metric == "geodesic":
        df = with_geodesic_m(df, "_gm" + out, lat1, lon1, lat2, lon2)
        return df.withColumnRenamed("_gm" + out, out).withColumn(out, F.col(out) / 1000.0)
    return df.withColumn(out, distance_km(metric, lat1, lon1, lat2, lon2))


def distance_km(metric: str, lat1, lon1, lat2, lon2) -> Column:
    if metric == "sphere":
        return great_circle_km(lat1, lon1, lat2, lon2)
    if metric == "geodesic":
        return geodesic_m(lat1, lon1, lat2, lon2) / 1000.0
    raise ValueError(f"unknown metric {metric!r}")


def postal_distance(a, b) -> Column:
    """|a - b| when both codes are all digits, else +infinity."""
    a, b = _c(a), _c(b)
    digits = a.rlike("^[0-9]+$") & b.rlike("^[0-9]+$")
    return F.when(F.coalesce(digits, F.lit(False)),
                  F.abs(a.cast("double") - b.cast("double"))).otherwise(F.lit(math.inf))
