"""Time, text and traffic functions as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Angles that part turn classes, in degrees.
TURN_ANGLES = (30.0, 60.0, 120.0, 150.0)


def hhmm(minutes: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(minutes / 60).cast("int"), F.pmod(minutes.cast("int"), F.lit(60)))


def minutes_of(text: Column) -> Column:
    p = F.split(F.trim(text), ":")
    return F.try_element_at(p, F.lit(1)).try_cast("int") * 60 + F.try_element_at(p, F.lit(2)).try_cast("int")


def minute_of_timestamp(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def floor_to(minutes: Column, step: int) -> Column:
    return (F.floor(minutes / step) * step).cast("int")


def slot(ts: Column, minutes: int) -> Column:
    """Start of the interval of a timestamp (UTC)."""
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts.cast("timestamp")) / (minutes * 60)) * (minutes * 60)).cast("timestamp_ntz")


def duration_seconds(text: Column, unit: float = 60.0) -> Column:
    """Seconds of a length of time: '8:30' or '08:30:15' (hours first), a plain number (of `unit` seconds), or parts such
    as '1h 30 min', '2 d', '45s', 'PT1H30M'; null where it is none of these."""
    t = F.lower(F.trim(text))
    part = lambda k: F.coalesce(F.try_element_at(F.split(t, ":"), F.lit(k)).try_cast("bigint"), F.lit(0))
    clock = part(1) * 3600 + part(2) * 60 + part(3)
    of = lambda units: F.coalesce(F.regexp_extract(t, f"(\\d+)\\s*(?:{units})(?![a-z])", 1).try_cast("bigint"), F.regexp_extract(t, f"(\\d+)\\s*(?:{units})(?=\\d)", 1).try_cast("bigint"), F.lit(0))
    parts = of("d|days?") * 86_400 + of("h|hours?|ore") * 3600 + of("m|min|mins|minutes?") * 60 + of("s|sec|secs|seconds?")
    shape = t.rlike("^p?t?(\\d+\\s*(d|days?|h|hours?|ore|m|min|mins|minutes?|s|sec|secs|seconds?)\\s*t?)+$")
    return F.when(t.rlike("^\\d+:\\d{2}(:\\d{2})?$"), clock).when(t.rlike("^\\d+(\\.\\d+)?$"), F.floor(t.try_cast("double") * unit).cast("bigint")).when(shape, parts)


def series(start: Column, stop: Column, step: Column, included: str = "both") -> Column:
    """The array of start, start + step, ... up to stop, numbers or timestamps; `included` says which ends count:
    both, left, right or neither."""
    s = F.sequence(start, stop, step)
    if included in ("right", "neither"):
        s = F.filter(s, lambda v: v > start)
    return F.filter(s, lambda v: v < stop) if included in ("left", "neither") else s


def series_of(start: Column, stop: Column, n: int) -> Column:
    """The array of n numbers from start to stop at even distances."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: start + (stop - start) * k / max(1, n - 1))


def day_of_week(ts: Column) -> Column:
    """0 for Sunday to 6."""
    return F.dayofweek(ts) - 1


def day_type(ts: Column) -> Column:
    return F.when(F.dayofweek(ts).isin(1, 7), "weekend").otherwise("weekday")


def normal_name(text: Column) -> Column:
    """Lower case, accents off, every other run of signs an underscore, none at the ends."""
    plain = F.translate(F.lower(text), "àáâãäåèéêëìíîïòóôõöùúûüçñ", "aaaaaaeeeeiiiiooooouuuucn")
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def azimuth(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north, 0 to 360."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def angle_between(a: Column, b: Column) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360.0 - d)


def angle_likelihood(angle: Column, engine: Column) -> Column:
    return F.when((angle <= 5) | engine.isin(0, 2), 0.1).otherwise(0.1 * F.exp(-(angle - 5) / 5))


def distance_likelihood(d: Column) -> Column:
    return 0.183024 * F.exp(-d / 5.46376)


def turn_class(dx1: Column, dy1: Column, dx2: Column, dy2: Column) -> Column:
    """Straight, slight, elbow, sharp or u-turn, left or right, from the last and the first segment's direction."""
    angle = F.degrees(F.atan2(dx1 * dy2 - dy1 * dx2, dx1 * dx2 + dy1 * dy2))
    side = F.when(angle > 0, "left").otherwise("right")
    a = F.abs(angle)
    straight, slight, elbow, sharp = TURN_ANGLES
    kind = F.when(a <= slight, "slight").when(a <= elbow, "elbow").otherwise("sharp")
    return F.when(a <= straight, "straight").when(a > sharp, "u_turn").otherwise(F.concat_ws("_", kind, side))


def free_flow_minutes(km: Column, kmh: Column) -> Column:
    return F.try_divide(km, kmh) * 60


def bpr(t0: Column, flow: Column, capacity: Column, a: float = 0.15, b: float = 4.0) -> Column:
    """Travel time under flow (Bureau of Public Roads); a link without capacity keeps t0."""
    return t0 * (1 + a * F.pow(F.coalesce(F.try_divide(flow, capacity), F.lit(0.0)), F.lit(b)))


def density_speed(v0: Column, density: Column, critical: Column, alpha: Column, least: float = 5.0) -> Column:
    return F.greatest(v0 * F.exp(-(1 / alpha) * F.pow(F.try_divide(density, critical), alpha)), F.lit(least))


def weather_factor(rain: Column, fog: Column, wind: Column, snow: Column) -> Column:
    r, f, w, s = (F.coalesce(c, F.lit(0.0)) for c in (rain, fog, wind, snow))
    return F.greatest(F.lit(0.5), 1 - (r + f + w + s + f * r + f * s))


def yield_capacity(flow: Column, capacity: Column, limit: float) -> Column:
    return (1 - limit) * F.exp(F.try_divide(F.lit(-5.4), capacity) * flow) + limit


def mercator_to_degrees(x: Column, y: Column, meridian: float, scale: float, easting: float) -> tuple[Column, Column]:
    """Longitude and latitude of northern transverse-Mercator metres on GRS 80 / WGS 84 (series to sub-millimetre)."""
    a, f = 6_378_137.0, 1 / 298.257223563
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi, eta = y / (scale * big), (x - easting) / (scale * big)
    xp, ep = xi, eta
    for j, c in enumerate(beta, 1):
        xp = xp - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        ep = ep - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xp) / F.cosh(ep))
    lat = chi
    for j, c in enumerate(delta, 1):
        lat = lat + c * F.sin(2 * j * chi)
    return F.degrees(F.lit(math.radians(meridian)) + F.atan2(F.sinh(ep), F.cos(xp))), F.degrees(lat)


def utm_to_degrees(x: Column, y: Column, zone: int) -> tuple[Column, Column]:
    return mercator_to_degrees(x, y, zone * 6 - 183, 0.9996, 500_000.0)
