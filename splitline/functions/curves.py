"""Curves, ratings and physics as Column arithmetic. Where a divisor is 0 the result is null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def riegel(seconds: Column, distance: Column, target: float, exponent: float = 1.06) -> Column:
    return seconds * F.pow(F.try_divide(F.lit(target), distance), F.lit(exponent))


def piecewise(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Linear interpolation through ascending knots, extrapolated from the end segments."""
    out = None
    for i, ((x0, y0), (x1, y1)) in enumerate(zip(knots, knots[1:])):
        line = F.lit(y0) + (x - F.lit(x0)) * F.lit((y1 - y0) / (x1 - x0))
        last = i == len(knots) - 2
        out = line if out is None and last else F.when(x < x1, line) if out is None else out.otherwise(line) if last else out.when(x < x1, line)
    return out


def transfer(seconds: Column, distance: Column, target: float, knots: list[tuple[float, float]]) -> Column:
    """Time at ``target``: seconds * exp(g(ln target) - g(ln distance)), g piecewise linear in log distance."""
    return seconds * F.exp(piecewise(F.log(F.lit(target)), knots) - piecewise(F.log(distance), knots))


def race_rating(norm: Column, difficulty: Column, pool_mean: Column) -> Column:
    """100 * pool mean / (normalised time / (1 + difficulty)), two decimals."""
    return F.round(F.try_divide(100 * pool_mean * (1 + difficulty), norm), 2)


def tilt(rating: Column, k: float = -0.031, low: float = 0.5, high: float = 1.5) -> Column:
    """Ability tilt h = 1 + k (r - 100) / 10, clamped."""
    return F.greatest(F.lit(low), F.least(F.lit(high), 1 + F.lit(k) * (rating - 100) / 10))


def tilted(rating: Column, difficulty: Column, k: float = -0.031) -> Column:
    return F.try_divide(rating * (1 + difficulty * tilt(rating, k)), 1 + difficulty)


def relative_humidity(temp_c: Column, dew_c: Column) -> Column:
    """Magnus form, per cent, at most 100."""
    e = lambda t: F.exp(17.625 * t / (243.04 + t))
    return F.least(F.lit(100.0), 100 * e(dew_c) / e(temp_c))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371000.0 * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def apparent_temperature(temp_c: Column, humidity: Column, wind_kmh: Column, solar_wm2: Column) -> Column:
    """Steadman's apparent temperature with radiation, in degrees Celsius: air, vapour pressure (hPa), wind (m/s), absorbed radiation."""
    vapour = humidity / 100 * 6.105 * F.exp(17.27 * temp_c / (237.7 + temp_c))
    wind = wind_kmh / 3.6
    return temp_c + 0.348 * vapour - 0.70 * wind + 0.70 * (0.1 * solar_wm2) / (wind + 10) - 4.25


def length_factor(track_m: Column, banked: Column, per_curve: float, bank_gain: float) -> Column:
    """Factor from a track's length to 400 m: shorter laps have more curve; banked tracks give a part of it back. Null counts as 400 m, flat."""
    laps = F.try_divide(F.lit(400.0), F.coalesce(track_m, F.lit(400.0))) - 1
    return F.exp(-F.lit(per_curve) * laps) * F.when(F.coalesce(banked, F.lit(False)), 1 + bank_gain * laps).otherwise(1.0)


def era_factor(season: Column, levels: dict[int, float]) -> Column:
    """exp(-level) of a season; 1 for a season without a level."""
    table = F.create_map(*[F.lit(x) for pair in levels.items() for x in pair])
    return F.exp(-F.coalesce(F.try_element_at(table, season), F.lit(0.0)))


def weather_factor(temp_c: Column, reference: float, knots: list[tuple[float, float]], low: float = -30.0, high: float = 50.0) -> Column:
    """exp(-(s(t) - s(reference))), s piecewise linear; 1 where the temperature is null or not plausible."""
    s = F.exp(-(piecewise(temp_c, knots) - piecewise(F.lit(reference), knots)))
    return F.when(temp_c.between(low, high), s).otherwise(1.0)


def ability_log(log_t: Column, log_d: Column, log_ref: float, slope: float, bend: float) -> Column:
    """Log time at the reference distance of a runner with log time ``log_t``: the exponent falls by ``bend`` per unit of log pace at the distance."""
    return log_t + (log_ref - log_d) * (slope + bend * (log_t - log_d))


def ability_log_inverse(log_ref_t: Column, log_d: Column, log_ref: float, slope: float, bend: float) -> Column:
    """The inverse of :func:`ability_log` in closed form; null where the curve has no inverse."""
    x = log_ref - log_d
    return F.try_divide(log_ref_t - x * slope + x * bend * log_d, 1 + x * bend)


def power_map(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Scale map through knots of positive values, a power law between neighbours (linear in logs), extrapolated at both ends."""
    import math

    return F.when(x > 0, F.exp(piecewise(F.log(x), [(math.log(a), math.log(b)) for a, b in knots])))
