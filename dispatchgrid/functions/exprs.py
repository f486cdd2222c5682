"""Column expressions of the cost model; all stay inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the cost model: tour constant of a random travelling-salesman tour, vehicle speed in km/h, earth radius.
TOUR_CONSTANT = 0.7120
SPEED_KMH = 30.0
EARTH_KM = 6371.0
KM_PER_MILE = 1.60934
NEWTON_STEPS = 30


def hash_uniform(key: Column, salt: str) -> Column:
    """A uniform draw in [0, 1) that depends on the key and a purpose alone; SQL: `uniform_sql`."""
    digest = F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(salt))), 1, 8)
    return F.conv(digest, 16, 10).cast("double") / 4294967296.0


def uniform_sql(key: str, salt: str) -> str:
    return f"(cast(('0x' || substr(md5(concat_ws(':', cast({key} as varchar), '{salt}')), 1, 8)) as bigint)::double / 4294967296.0::double)"


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """From a point to a segment, the foot clamped to its ends."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / length)))
    return distance(px, py, ax + t * dx, ay + t * dy)


def equal_area_xy(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Spherical Lambert azimuthal equal-area coordinates in metres about 45 N, 100 W."""
    r, p0, l0 = 6370997.0, math.radians(45), math.radians(-100)
    p, d = F.radians(lat), F.radians(lon) - l0
    k = F.sqrt(2 / (1 + math.sin(p0) * F.sin(p) + math.cos(p0) * F.cos(p) * F.cos(d)))
    return r * k * F.cos(p) * F.sin(d), r * k * (math.cos(p0) * F.sin(p) - math.sin(p0) * F.cos(p) * F.cos(d))


def dispatch_interval(fixed: Column, alpha: Column, arrivals: Column, wr: Column, wv: float = 1.0) -> Column:
    """The interval T = c*c that minimises fixed/c**2 + tour*alpha/c + (wr/wv)*alpha*c + wr*c**2 over c in [0.01, 20], by
    NEWTON_STEPS clamped Newton steps; tour is the constant of a random tour times the root of the arrivals."""
    a1, a2 = TOUR_CONSTANT * F.sqrt(arrivals) * alpha, (wr / wv) * alpha
    start = F.greatest(F.lit(0.1), F.least(F.lit(10.0), F.pow(fixed / F.greatest(wr, F.lit(1e-9)), 0.25)))

    def step(c: Column, _: Column) -> Column:
        slope = -2 * fixed / F.pow(c, 3) - a1 / F.pow(c, 2) + a2 + 2 * wr * c
        bend = 6 * fixed / F.pow(c, 4) + 2 * a1 / F.pow(c, 3) + 2 * wr
        return F.least(F.lit(20.0), F.greatest(F.lit(0.01), c - slope / F.greatest(bend, F.lit(1e-12))))

    c = F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), start, step)
    return c * c


def fleet_sizes(km: Column, interval_h: Column, speed: float = SPEED_KMH) -> tuple[Column, Column]:
    """Vehicles a district ties up on average, and the whole vehicles it needs; 0 where there is nothing to drive."""
    amortised = F.when((interval_h <= 0) | (km <= 0), F.lit(0.0)).otherwise(km / (speed * interval_h))
    return amortised, F.when(amortised <= 0, F.lit(0.0)).otherwise(F.ceil(F.greatest(amortised - 1e-12, F.lit(0.0))).cast("double"))


def tour_km(alpha: Column, arrivals: Column, interval_h: Column) -> Column:
    return TOUR_CONSTANT * F.sqrt(arrivals * interval_h) * alpha


def mean_walk_km(radius: Column, detour: Column) -> Column:
    """Mean walk to the stop of a disk when the vehicle comes within detour of the rider: 0 once it reaches all."""
    return F.when(detour >= radius, F.lit(0.0)).otherwise(2 * radius / 3 - detour + F.pow(detour, 3) / (3 * radius * radius))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^0-9a-z]+", "_"), "^_+|_+$", "")


def first_int(c: Column, default: int = 1) -> Column:
    return F.coalesce(F.split_part(c, F.lit(";"), F.lit(1)).try_cast("int"), F.lit(default))


def digits_only(c: Column) -> Column:
    d = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.length(d) > 0, d.try_cast("int"))


def gtfs_hour(c: Column) -> Column:
    """Hour of a schedule time, which may run past 24; 0 where it is none."""
    return F.coalesce(F.split_part(c, F.lit(":"), F.lit(1)).try_cast("int"), F.lit(0)) % 24
