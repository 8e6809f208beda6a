"""Annual, zonal and band means of monthly fields, ensemble envelopes, and injection logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import calendars
from emberline.operators.regions import spatial_mean
from emberline.schema import BANDS


def weighted_annual_mean(monthly: DataFrame, value: str, keys: list[str], days: str = "days_in_month") -> DataFrame:
    """Year means weighted by the days of the months; a null month adds nothing above the line but its days below."""
    return monthly.groupBy(*keys, "year").agg((F.sum(F.col(value) * F.col(days)) / F.sum(days)).alias(value))


def with_month_days(monthly: DataFrame) -> DataFrame:
    """days_in_month by each series' own calendar (a column calendar), the standard one without."""
    own = F.col("calendar") if "calendar" in monthly.columns else F.lit("standard")
    return monthly.withColumn("days_in_month", calendars.days_in_month(own, F.col("year"), F.col("month")))


def by_calendar(df: DataFrame, keys: list[str]) -> list[str]:
    """The keys of series, whose calendar goes with them."""
    return [*keys, "calendar"] if "calendar" in df.columns and "calendar" not in keys else keys


def global_annual_series(monthly: DataFrame, value: str, keys: list[str], band: str = "Global", drop_years: tuple[int, ...] = ()) -> DataFrame:
    means = spatial_mean(monthly, value, [*by_calendar(monthly, keys), "year", "month"], BANDS[band])
    return weighted_annual_mean(with_month_days(means.where(~F.col("year").isin(list(drop_years)) if drop_years else F.lit(True))), value, keys)


def zonal_mean_period(monthly: DataFrame, value: str, keys: list[str], years: tuple[int, int]) -> DataFrame:
    """By latitude: mean over longitudes, then over the months of a year, then over the years."""
    rows = monthly.where(F.col("year").between(*years)).groupBy(*by_calendar(monthly, keys), "lat", "year", "month").agg(F.avg(value).alias(value))
    return weighted_annual_mean(with_month_days(rows), value, [*keys, "lat"]).groupBy(*keys, "lat").agg(F.avg(value).alias(value))


def ensemble_envelope(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))


def align_members(a: DataFrame, b: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, member_no, a, b): members by place in name order, as many as the shorter ensemble has."""
    number = lambda df: df.withColumn("member_no", F.dense_rank().over(Window.partitionBy(*keys).orderBy("member")))
    return number(a).select(*keys, "member_no", F.col(value).alias("a")).join(number(b).select(*keys, "member_no", F.col(value).alias("b")), [*keys, "member_no"])


def zonal_anomaly(zonal: DataFrame, base: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Envelope over members of the difference from the baseline, by the keys."""
    return ensemble_envelope(align_members(zonal, base, value, keys).withColumn("anomaly", F.col("a") - F.col("b")), "anomaly", keys)


def merge_logs(logs: dict[str, DataFrame], value: str, keys: tuple[str, ...] = ("year",)) -> DataFrame:
    """Logs side by side: a row per key that any log has, a column per log, null where it has none. One union and one pivot, whatever their number."""
    long = reduce(lambda a, b: a.unionByName(b), [log.select(*keys, F.lit(name).alias("_log"), F.col(value).alias("_v")) for name, log in logs.items()])
    return long.groupBy(*keys).pivot("_log", list(logs)).agg(F.min("_v"))


def injection_totals(log: DataFrame) -> DataFrame:
    """Both hemispheres together, per member and year."""
    return log.select("model", "scenario", "member", "year", (F.col("north_tg") + F.col("south_tg")).alias("so2_tg"))


def injection_efficiency(totals: DataFrame, years: tuple[int, int], of: str, to: str, drop_year: int = 2034) -> DataFrame:
    """Per model the mean yearly injection (over members, then years after the first and up to the last) of both scenarios, their ratio and the share saved."""
    kept = totals.where((F.col("year") > years[0]) & (F.col("year") <= years[1]) & (F.col("year") != drop_year))
    means = kept.groupBy("model", "scenario", "year").agg(F.avg("so2_tg").alias("_y")).groupBy("model").pivot("scenario", [of, to]).agg(F.avg("_y"))
    a, b = F.col(f"`{of}`"), F.col(f"`{to}`")
    return means.select("model", a.alias("injection"), b.alias("reference"), (a / b).alias("ratio"), (1 - a / b).alias("saved"))
