"""Climatologies, fire seasons and seasonal means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.schema import MONTH_DAYS


def month_days(month: str = "month") -> Column:
    """Days of a month in a climatology, February 28.25."""
    return F.element_at(F.array(*[F.lit(float(d)) for d in MONTH_DAYS]), F.col(month).cast("int"))


def monthly_climatology(daily: DataFrame, values: list[str], keys: list[str]) -> DataFrame:
    return daily.groupBy(*keys, "month").agg(*[F.avg(v).alias(v) for v in values])


def resample_monthly(daily: DataFrame, values: list[str], keys: list[str], scale: dict[str, float] | None = None) -> DataFrame:
    """Means by year and month, each times its scale."""
    scale = scale or {}
    return daily.groupBy(*keys, "year", "month").agg(*[(F.avg(v) * scale.get(v, 1.0)).alias(v) for v in values])


def fire_season_mask(climatology: DataFrame, value: str, keys: list[str], n: int = 3) -> DataFrame:
    """(keys, month, in_season): the n consecutive months, around the year's end too, of highest sum; the earliest start on ties. A start with a null month is out; without any start no month is in season."""
    wide = climatology.groupBy(*keys).agg(F.array(*[F.max(F.when(F.col("month") == m, F.col(value))) for m in range(1, 13)]).alias("_v"))
    total = lambda m: sum((F.col("_v")[(m + k) % 12] for k in range(1, n)), F.col("_v")[m])
    sums = F.array(*[total(m) for m in range(12)])
    start = wide.withColumn("_s", sums).withColumn("_start", F.array_position("_s", F.array_max("_s")) - 1)
    return start.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"), "_start").select(*keys, "month", F.coalesce(F.pmod(F.col("month") - 1 - F.col("_start"), F.lit(12)) < n, F.lit(False)).alias("in_season"))


def seasonal_mean(monthly: DataFrame, mask: DataFrame, value: str, keys: list[str], mask_keys: list[str]) -> DataFrame:
    """Day-weighted mean over the season's months. A null month adds nothing above the line but its days below."""
    w = F.when(F.col("in_season"), month_days()).otherwise(0.0)
    both = monthly.join(mask, [*mask_keys, "month"])
    return both.groupBy(*keys).agg((F.coalesce(F.sum(F.col(value) * w), F.lit(0.0)) / F.when(F.sum(w) > 0, F.sum(w))).alias(value))


def fire_season_annual(monthly: DataFrame, mask: DataFrame, value: str, keys: list[str], mask_keys: list[str]) -> DataFrame:
    """The same by calendar year of a monthly series: a season across the new year is split; null without a season."""
    return seasonal_mean(monthly, mask, value, [*keys, "year"], mask_keys)


def doy_climatology(daily: DataFrame, value: Column, keys: list[str], name: str = "value") -> DataFrame:
    return daily.groupBy(*keys, "doy").agg(F.avg(value).alias(name))


def smooth_doy(climatology: DataFrame, value: str, keys: list[str], window: int = 31) -> DataFrame:
    """Centred running mean over the days of a year, around its end. Days are taken in order, whatever the calendar."""
    half = window // 2
    whole = Window.partitionBy(*keys)
    numbered = climatology.withColumn("_k", F.row_number().over(whole.orderBy("doy"))).withColumn("_n", F.count(F.lit(1)).over(whole))
    padded = numbered.withColumn("_at", F.explode(F.array(F.col("_k") - F.col("_n"), F.col("_k"), F.col("_k") + F.col("_n"))))
    padded = padded.where((F.col("_at") > -window) & (F.col("_at") <= F.col("_n") + window))
    near = whole.orderBy("_at").rowsBetween(-half, half)
    full = F.count(value).over(near) == window
    return padded.withColumn(value, F.when(full, F.avg(value).over(near))).where("_at = _k").drop("_k", "_n", "_at")


def wind_climatology(daily: DataFrame, donors: DataFrame, keys: list[str], scenario: str, years: tuple[int, int], window: int = 31) -> DataFrame:
    """(keys, doy, sfcWind): smoothed speed of the components by day of year, of the donors (model, member) in one scenario and the given years."""
    days = daily.where((F.col("scenario") == scenario) & F.col("year").between(*years)).join(donors, ["model", "member"], "left_semi")
    return smooth_doy(doy_climatology(days, F.hypot("uas", "vas"), keys, "sfcWind"), "sfcWind", keys, window).withColumn("sfcWind", F.col("sfcWind").cast("float"))


def wind_uv_ratio(daily: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(ratio by cell and month, verdict by model): mean wind over mean component speed where that is above 0.1, within 0.8 and 3, 1 where unknown. A model's ratio is plausible if its median is within 0.95 and 2."""
    clim = daily.groupBy(*keys, "month").agg(F.avg("sfcWind").alias("_s"), F.avg(F.hypot("uas", "vas")).alias("_uv"))
    r = F.col("_s") / F.when(F.col("_uv") > 0.1, F.col("_uv"))
    ratio = clim.select(*keys, "month", F.coalesce(F.when(r.isNotNull(), F.least(F.greatest(r, F.lit(0.8)), F.lit(3.0))), F.lit(1.0)).alias("ratio"))
    return ratio, ratio.groupBy("model").agg(F.percentile("ratio", F.lit(0.5)).alias("median")).withColumn("plausible", F.col("median").between(0.95, 2.0))
