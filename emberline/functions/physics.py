"""Column functions: humidity, vapour pressure, wind and precipitation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS = 86400


def es_sonntag(t: Column) -> Column:
    """Saturation vapour pressure over water in Pa, of kelvin."""
    return F.exp(-6096.9385 / t + 21.2409642 - 2.711193e-2 * t + 1.673952e-5 * t * t + 2.433502 * F.log(t))


def vapour_pressure(q: Column, p: Column) -> Column:
    return q * p / (0.622 + 0.378 * q)


def at_least_zero(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def percent(x: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(100.0)))


def vpd_from_rh(t: Column, rh: Column) -> Column:
    """Vapour-pressure deficit in kPa."""
    return at_least_zero(es_sonntag(t) * (1 - rh / 100) / 1000)


def vpd_from_huss(t: Column, q: Column, p: Column) -> Column:
    return at_least_zero((es_sonntag(t) - vapour_pressure(q, p)) / 1000)


def rh_from_huss(t: Column, q: Column, p: Column) -> Column:
    return percent(100 * vapour_pressure(q, p) / es_sonntag(t))


def wind_speed(u: Column, v: Column, ratio: Column | float = 1.0) -> Column:
    """Speed from components, times a monthly ratio where one is known."""
    return F.hypot(u, v) * ratio


def mm_per_day(flux: Column) -> Column:
    return flux * SECONDS


def daily_vpd(method: str, t: str = "tas", tmax: str = "tasmax", rh: str = "hurs", rhmin: str = "hursmin", q: str = "huss", p: str = "ps") -> Column:
    """VPD by method: ``mean`` of means, ``max`` of the day's highest temperature and lowest humidity (mean humidity where that lacks), ``huss`` from specific humidity."""
    if method == "mean":
        return vpd_from_rh(F.col(t), F.col(rh))
    if method == "max":
        return vpd_from_rh(F.col(tmax), F.coalesce(rhmin, rh))
    if method == "huss":
        return vpd_from_huss(F.col(t), F.col(q), F.col(p))
    raise ValueError("method is mean, max or huss")
