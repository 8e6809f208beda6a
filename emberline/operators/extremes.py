"""Local thresholds, days above them, spells and monthly statistics of a daily index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators.lineage import kept


def pooled_quantile(daily: DataFrame, value: str, keys: list[str], q: float = 0.95, single: bool = True) -> DataFrame:
    """Exact quantile with linear interpolation over all days and members of each key; single: cast to float, as daily fields are."""
    p = F.percentile(F.col(value).cast("double"), F.lit(q))
    return daily.groupBy(*keys).agg((p.cast("float") if single else p).alias("threshold"))


def selected_quantile(daily: DataFrame, value: str, keys: list[str], q: float = 0.95, bins: int = 1024, held: int = 10_000) -> DataFrame:
    """(keys, threshold): the same quantile to the bit, for keys of any number of rows: no task holds a key's values.

    A key's range is cut into bins and counted, and what lies outside the bins of its two order statistics goes, until at most ``held`` values are left
    for each key or all that are left are equal. Counting is done where the rows are, so one key with all rows is as good as many. The driver
    sees one number a round."""
    if q < 0 or q > 1:
        raise ValueError("q lies within 0 and 1")
    x = F.col("_x")
    rows = daily.select(*keys, F.col(value).cast("double").alias("_x")).where(x.isNotNull())
    span = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    place = (F.col("_n") - 1) * F.lit(float(q))
    span = span.withColumns({"_at": place, "_first": F.floor(place), "_last": F.ceil(place), "_below": F.lit(0).cast("long"), "_in": F.col("_n")})
    size = None
    while True:
        # A row per key, cut so that rounds don't pile up.
        span = kept(span)
        most = span.where("_lo < _hi").agg(F.max("_in")).first()[0] or 0
        if most <= held or most == size:
            break
        size = most
        inside = rows.join(span, keys).where(x.between(F.col("_lo"), F.col("_hi")))
        # Halves first: the width itself may be beyond the largest number.
        share = (x / 2 - F.col("_lo") / 2) / F.nullif(F.col("_hi") / 2 - F.col("_lo") / 2, F.lit(0.0))
        binned = inside.withColumn("_bin", F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(bins - 1)))
        counts = binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_c"), F.min(x).alias("_a"), F.max(x).alias("_b"), *[F.first(c).alias(c) for c in ("_n", "_at", "_first", "_last", "_below")])
        before = F.col("_below") + F.coalesce(F.sum("_c").over(Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        hit = counts.withColumn("_before", before).where((F.col("_first") < F.col("_before") + F.col("_c")) & (F.col("_last") >= F.col("_before")))
        span = hit.groupBy(*keys).agg(F.first("_n").alias("_n"), F.min("_a").alias("_lo"), F.max("_b").alias("_hi"), F.first("_at").alias("_at"), F.first("_first").alias("_first"), F.first("_last").alias("_last"), F.min("_before").alias("_below"), F.sum("_c").alias("_in"))
    left = rows.join(span.where("_lo < _hi"), keys).where(x.between(F.col("_lo"), F.col("_hi"))).groupBy(*keys).agg(F.sort_array(F.collect_list(x)).alias("_v"))
    both = span.join(left, keys, "left")
    pick = lambda k: F.coalesce(F.get("_v", (F.col(k) - F.col("_below")).cast("int")), F.col("_lo"))
    a, b = pick("_first"), pick("_last")
    mixed = F.when((F.col("_first") == F.col("_last")) | (a == b), a).otherwise((F.col("_last") - F.col("_at")) * a + (F.col("_at") - F.col("_first")) * b)
    return both.select(*keys, mixed.alias("threshold"))


def with_threshold(daily: DataFrame, thresholds: DataFrame, on: list[str]) -> DataFrame:
    """Left join: days of cells without a threshold stay, with a null one. Grid-sized thresholds are broadcast by their statistics, larger ones shuffled."""
    return daily.join(thresholds, on, "left")


def exceeds(value: str, threshold: Column) -> Column:
    """1 or 0; a missing day does not exceed."""
    return F.when(F.col(value) > threshold, 1).otherwise(0)


def yearly_metrics(daily: DataFrame, value: str, keys: list[str], absolute: float | None = None, day: str = "day_idx", prefix: str = "") -> DataFrame:
    """Per key and year: days above ``threshold``, days above ``absolute``, and the longest run of days above the threshold.

    Runs are of consecutive stored days and end with the year. All counts are null where the threshold is. The rows of a year are
    shuffled once: the window, the runs and the years share one partitioning.
    """
    year = [*keys, "year"]
    per_year = Window.partitionBy(*year)
    flagged = daily.withColumn("_above", exceeds(value, F.col("threshold")))
    # A run is numbered by the days not above so far.
    run = F.sum(1 - F.col("_above")).over(per_year.orderBy(day).rowsBetween(Window.unboundedPreceding, 0))
    runs = (
        flagged.withColumn("_run", run)
        .groupBy(*year, "_run")
        .agg(F.sum("_above").alias("_days"), F.sum(exceeds(value, F.lit(absolute)) if absolute is not None else F.lit(0)).alias("_abs"), F.max("threshold").alias("_t"))
    )
    known = lambda c: F.when(F.max("_t").isNotNull(), c).cast("int")
    out = runs.groupBy(*year).agg(known(F.sum("_days")).alias(f"{prefix}days_p95"), known(F.sum("_abs")).alias(f"{prefix}days_abs"), known(F.max("_days")).alias(f"{prefix}spell_max"))
    return out if absolute is not None else out.drop(f"{prefix}days_abs")


def days_above_local(daily: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Days a year above the local threshold, null without one."""
    return daily.groupBy(*keys, "year").agg(F.when(F.max("threshold").isNotNull(), F.sum(exceeds(value, F.col("threshold")))).cast("int").alias("days_p95"))


def days_above_abs(daily: DataFrame, value: str, keys: list[str], limit: float) -> DataFrame:
    return daily.groupBy(*keys, "year").agg(F.sum(exceeds(value, F.lit(limit))).cast("int").alias("days_abs"))


def monthly_metrics(daily: DataFrame, value: str, keys: list[str], prefix: str = "") -> DataFrame:
    """Per key and month of the year: the share of all days above the threshold, and the mean of the days with a value."""
    return daily.groupBy(*keys, "month").agg(
        F.when(F.max("threshold").isNotNull(), F.avg(exceeds(value, F.col("threshold")))).alias(f"{prefix}exc_freq"), F.avg(F.col(value).cast("double")).alias(f"{prefix}mean_month")
    )


def exceedance_metrics(daily: DataFrame, thresholds: DataFrame, value: str, keys: list[str], on: list[str], absolute: float | None = None, prefix: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(yearly, monthly, overall mean) of one index."""
    days = with_threshold(daily, thresholds, on)
    return yearly_metrics(days, value, keys, absolute, prefix=prefix), monthly_metrics(days, value, keys, prefix), daily.groupBy(*keys).agg(F.avg(F.col(value).cast("double")).alias(f"{prefix}mean"))
