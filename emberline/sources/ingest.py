"""From raw values to one wide daily table: names, coordinates, days, units, coverage, merging, staging."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.functions import calendars
from emberline.functions.physics import at_least_zero, mm_per_day, percent, rh_from_huss, wind_speed
from emberline.operators.grid import wrap_lon
from emberline.operators.regions import area_weight, weighted_mean
from emberline.schema import ALIASES, SCENARIOS
from emberline.sources.catalog import BAD_VARIABLES

SERIES = ["model", "scenario", "member", "var"]

# Names of coordinates, unit labels in normal form, plausible ranges of land means.
COORDINATES = {"latitude": "lat", "longitude": "lon", "nav_lat": "lat", "nav_lon": "lon", "t": "time", "Time": "time", "valid_time": "time"}
CELSIUS, FRACTION = ["c", "degc", "celsius", "°c", "deg_c"], ["1", "fraction", "0-1"]
METRES, PER_DAY = ["m/s", "ms-1", "m/sec"], ["mm/day", "mmd-1", "mm/d", "mmday-1", "kgm-2d-1"]
FLUX = ["kgm-2s-1", "kg/m2/s", "kg/m2s", "kgm-2/s", "mm/s", "mms-1"]
WIND, KMH = ["m/s", "ms-1", "m/sec", "km/h", "kmh-1", "km/hr", "knot"], ["km/h", "kmh-1", "km/hr"]
PLAUSIBLE = {"tasmax": (240, 320), "tas": (235, 315), "hurs": (20, 98), "sfcWind": (0.5, 15), "pr": (0.05, 20)}
FILL = 1e10


def harmonize_columns(df: DataFrame) -> DataFrame:
    """Coordinates as lat, lon, time. NaN values become null."""
    out = df
    for k, v in COORDINATES.items():  # the first of several names for a coordinate
        if k in out.columns and v not in out.columns:
            out = out.withColumnRenamed(k, v)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in out.dtypes if t in ("float", "double")})


def drop_singletons(df: DataFrame, dims: list[str]) -> DataFrame:
    """Without those further dimensions (a height, a realisation) that have one value only. One row of bounds is read."""
    dims = [d for d in dims if d in df.columns]
    if not dims:
        return df
    low_high = df.agg(*[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return df.drop(*[d for d in dims if low_high[f"lo_{d}"] == low_high[f"hi_{d}"]])


def number_cells(points: DataFrame) -> DataFrame:
    """(cell_id, lat, lon) of the distinct points, numbered by ascending latitude, then longitude, by their places on both axes."""
    place = lambda n: points.select(n).distinct().withColumn(f"_{n}", F.row_number().over(Window.orderBy(n)) - 1)  # noqa: E731  axes, never fields
    lat, lon = place("lat"), place("lon")
    width = lon.agg(F.count(F.lit(1)).alias("_width"))
    ids = points.select("lat", "lon").distinct().join(lat, "lat").join(lon, "lon").join(F.broadcast(width))
    return ids.select((F.col("_lat") * F.col("_width") + F.col("_lon")).cast("long").alias("cell_id"), "lat", "lon")


def wrap_longitudes(df: DataFrame, keys: list[str]) -> DataFrame:
    """Longitudes of each key's grid as -180 to 180, if the grid goes beyond 180."""
    top = df.groupBy(*keys).agg(F.max("lon").alias("_top"))
    return df.join(top, keys).withColumn("lon", wrap_lon(F.col("lon"), F.col("_top"))).drop("_top")


def label_day(lo: Column, hi: Column, stamp: Column) -> Column:
    """Day number: the middle of the bounds where there are some, else the stamp, rounded down."""
    return F.floor(F.coalesce((lo + hi) / 2, stamp)).cast("int")


def shift_end_stamps(df: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Series without bounds that begin on 2 January at hour 0 and have over 300 stamps mark the ends of days: their days move one back. Needs month, day, hour of the stamps, day_idx, has_bounds."""
    first = df.groupBy(*keys).agg(F.min_by(F.struct("month", "day", "hour"), F.struct("day_idx", "hour")).alias("_f"), F.count_distinct("day_idx", "hour").alias("_n"), F.max("has_bounds").alias("_b"))
    ends = ~F.coalesce("_b", F.lit(False)) & (F.col("_f") == F.struct(F.lit(1).alias("month"), F.lit(2).alias("day"), F.lit(0).alias("hour"))) & (F.col("_n") > 300)
    # One row per series.
    marks = first.where(ends).select(*keys, F.lit(1).alias("_end"))
    return df.join(marks, keys, "left").withColumn("day_idx", F.col("day_idx") - F.coalesce("_end", F.lit(0))).drop("_end")


def dedupe_days(df: DataFrame, keys: list[str] = SERIES, day: str = "day_idx") -> DataFrame:
    """Of the files that hold a day of a series the first in file order stays, with the whole day."""
    winners = df.groupBy(*keys, day).agg(F.min("file_seq").alias("file_seq"))
    return df.join(winners, [*keys, day, "file_seq"], "left_semi").select(*df.columns)


def drop_bad_time(df: DataFrame, day: str = "day_idx") -> DataFrame:
    return df.where(F.col(day).isNotNull())


def plain_unit(label: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), r"[\s^.]|\*\*", "")


def unit_medians(df: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Median of each series over its first 31 days, or days 32 to 155 if those have no value, without fill values for humidity. One row per series."""
    days = df.groupBy(*keys).agg(F.min("day_idx").alias("_d0"))
    near = df.join(days, keys).where(F.col("day_idx") < F.col("_d0") + 155).withColumn("_early", F.col("day_idx") < F.col("_d0") + 31)
    x = F.when(~F.col("var").startswith("hurs") | (F.abs("value") < FILL), F.col("value").cast("double"))
    half = lambda when: F.percentile(F.when(when, x), F.lit(0.5))
    return near.groupBy(*keys).agg(F.coalesce(half(F.col("_early")), half(~F.col("_early"))).alias("median"))


def to_target_units(var: str, value: Column, unit: Column, median: Column) -> Column:
    """Values in target units. Temperature, humidity and pressure go by the values' median rather than the label; the label decides only without values."""
    if var in ("tas", "tasmax"):
        return F.when(F.coalesce(median < 150, unit.isin(CELSIUS)), value + 273.15).otherwise(value)
    if var in ("hurs", "hursmin"):
        real = F.when(F.abs(value) < FILL, value)
        return percent(F.when(F.coalesce(median <= 1.5, unit.isin(FRACTION)), real * 100).otherwise(real))
    if var == "pr":
        return at_least_zero(F.when(unit.isin(METRES), value * 1000).when(unit.isin(PER_DAY), value / 86400).otherwise(value))
    if var in ("sfcWind", "uas", "vas"):
        known = F.lit(False)
        for u in WIND:
            known |= F.contains(unit, F.lit(u))
        speed = F.when((unit == "") | known, F.when(unit.isin(KMH), value / 3.6).otherwise(value))  # not a wind: null
        return at_least_zero(speed) if var == "sfcWind" else speed
    if var == "huss":
        return F.when(unit.isin("g/kg", "gkg-1"), value / 1000).otherwise(value)
    if var == "ps":
        return F.when(unit.isin("hpa", "mb", "mbar") | F.coalesce(median < 2000, F.lit(False)), value * 100).otherwise(value)
    raise ValueError(f"unknown variable {var}")


def convert_units(df: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """All variables of a long table (var, units, value). The medians are one row per series, and joined so."""
    out = df.join(unit_medians(df, keys), keys, "left").withColumn("_u", plain_unit(F.col("units")))
    value = F.when(F.lit(False), F.lit(0.0))
    for v in ALIASES:
        value = value.when(F.col("var") == v, to_target_units(v, F.col("value"), F.col("_u"), F.col("median")))
    return out.withColumn("value", value.cast("float")).drop("_u", "median")


def resolve_variable(fields: DataFrame, keys: list[str]) -> DataFrame:
    """Per file and canonical variable the field to read. fields: keys, var_name, canon, explicit, standard_name, cell_methods, n_fields. The explicit name comes first, then aliases in order, the standard name (the field whose cell methods fit), then an only field."""
    place = F.lit(None).cast("int")
    for canon, names in ALIASES.items():
        place = F.when(F.col("canon") == canon, F.array_position(F.array(*map(F.lit, names)), F.col("var_name")).cast("int")).otherwise(place)
    standard = F.when(F.col("canon").isin("tas", "tasmax"), "air_temperature").when(F.col("canon").isin("hurs", "hursmin"), "relative_humidity").when(F.col("canon") == "sfcWind", "wind_speed").when(F.col("canon") == "pr", "precipitation_flux").when(F.col("canon") == "huss", "specific_humidity").when(F.col("canon") == "ps", "surface_air_pressure").when(F.col("canon") == "uas", "eastward_wind").when(F.col("canon") == "vas", "northward_wind")
    method = F.when(F.col("canon") == "tasmax", "time: maximum").when(F.col("canon") == "hursmin", "time: minimum").otherwise("time: mean")
    fits = F.coalesce(F.contains(F.col("cell_methods"), method), F.lit(False))
    rank = F.when(F.col("var_name") == F.col("explicit"), 0).when(place > 0, place).when(F.col("standard_name") == standard, F.when(fits, 100).otherwise(101)).when(F.col("n_fields") == 1, 200)
    best = Window.partitionBy(*keys, "canon").orderBy("_rank", "var_name")
    return fields.withColumn("_rank", rank).where("_rank IS NOT NULL").withColumn("_k", F.row_number().over(best)).where("_k = 1").select(*keys, "canon", "var_name")


def slice_years(df: DataFrame, years: tuple[int, int]) -> DataFrame:
    return df.where(F.col("year").between(*years))


def subset_bbox(df: DataFrame, bbox: tuple[float, float, float, float] | None) -> DataFrame:
    return df if bbox is None else df.where(F.col("lon").between(bbox[0], bbox[1]) & F.col("lat").between(bbox[2], bbox[3]))


def days_per_year(df: DataFrame, keys: list[str], years: tuple[int, int]) -> DataFrame:
    """(keys, year, days): every year of the span, 0 where a series has none."""
    have = slice_years(df, years).groupBy(*keys, "year").agg(F.count_distinct("day_idx").alias("days"))
    wanted = df.select(*keys).distinct().withColumn("year", F.explode(F.sequence(F.lit(years[0]), F.lit(years[1]))))
    return wanted.join(have, [*keys, "year"], "left").fillna(0, ["days"])


def check_completeness(df: DataFrame, keys: list[str], years: tuple[int, int], least: int | None = 360) -> DataFrame:
    """Per series its missing years and its short ones: those of fewer than ``least`` days, or with least None those that lack a day of the series' own calendar (a column calendar, the standard one without)."""
    d = days_per_year(df, keys, years)
    if least is None:
        own = df.groupBy(*keys).agg(F.first("calendar", ignorenulls=True).alias("_c")) if "calendar" in df.columns else df.select(*keys, F.lit("standard").alias("_c")).distinct()
        d, least = d.join(own, keys).withColumn("_least", calendars.days_in_year(calendars.known(F.col("_c")), F.col("year"))), F.col("_least")
    some = lambda when: F.sort_array(F.collect_list(F.when(when, F.col("year"))))
    return d.groupBy(*keys).agg(some(F.col("days") == 0).alias("missing"), some((F.col("days") > 0) & (F.col("days") < least)).alias("short")).withColumn("complete", (F.size("missing") == 0) & (F.size("short") == 0))


def drop_incomplete(daily: DataFrame, runs: list[tuple[str, str, int, int]], least: int = 300, scenarios: list[str] = SCENARIOS) -> DataFrame:
    """Without members that have a year of under 300 days in any run of their scenario, and without models that so lose a scenario."""
    key = ["model", "scenario", "member"]
    have = daily.groupBy(*key, "year").agg(F.count_distinct("day_idx").alias("_days"))
    # The years of all runs: a small table, so the cube is read once whatever their number.
    years = sorted({(s, y) for _, s, y0, y1 in runs for y in range(y0, y1 + 1)})
    wanted = F.broadcast(daily.sparkSession.createDataFrame(years, "scenario string, year int"))
    series = have.select(*key).distinct()
    bad = series.join(wanted, "scenario").join(have, [*key, "year"], "left").where(F.coalesce("_days", F.lit(0)) < least).select(*key).distinct()
    good = series.join(bad, key, "left_anti")
    whole = good.where(F.col("scenario").isin(scenarios)).groupBy("model").agg(F.count_distinct("scenario").alias("_n")).where(F.col("_n") == len(scenarios)).select("model")
    # A few rows per model.
    return daily.join(good.join(whole, "model", "left_semi"), key, "left_semi")


def merge_variables(long: DataFrame, variables: list[str], keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(wide, lost): a row per key with all variables, by one shuffle; and how many days (keys, if they have no day) of each variable found no partner.

    Of several values of a key and variable the first in file order counts, else the smallest."""
    value = F.min_by("value", F.when(F.col("value").isNotNull(), F.col("file_seq"))) if "file_seq" in long.columns else F.min("value")
    wide = long.groupBy(*keys).pivot("var", variables).agg(value)
    present = long.groupBy(*keys).agg(F.collect_set("var").alias("_have"))
    lone = present.where(F.size(F.array_intersect("_have", F.array(*map(F.lit, variables)))) < len(variables)).withColumn("var", F.explode("_have"))
    lost = lone.groupBy("var").agg((F.count_distinct("day_idx") if "day_idx" in keys else F.count(F.lit(1))).alias("lost"))
    return wide.dropna(subset=variables), lost


def fill_derived(daily: DataFrame, ratio: DataFrame | None = None) -> DataFrame:
    """Wind from its components (times the monthly ratio of the cell) and humidity from specific humidity, where they lack."""
    r = F.lit(1.0)
    if ratio is not None:
        daily, r = daily.join(ratio.withColumnRenamed("ratio", "_ratio"), ["model", "cell_id", "month"], "left"), F.coalesce("_ratio", F.lit(1.0))
    out = daily.withColumn("sfcWind", F.coalesce("sfcWind", wind_speed(F.col("uas"), F.col("vas"), r).cast("float")))
    return out.withColumn("hurs", F.coalesce("hurs", rh_from_huss(F.col("tas"), F.col("huss"), F.col("ps")).cast("float"))).drop("_ratio")


def read_daily(spark: SparkSession, path: str, years: tuple[int, int] | None = None, bbox=None, **keys: list[str]) -> DataFrame:
    """A staged cube with partitions pruned by keys, and years and box pushed to the files."""
    df = spark.read.parquet(path)
    for c, values in keys.items():
        df = df.where(F.col(c).isin(values))
    return subset_bbox(slice_years(df, years) if years else df, bbox)


def expand_paths(spark: SparkSession, paths: list[str]) -> list[str]:
    """Paths with their globs expanded, each pattern's files in name order; a pattern that finds nothing is an error."""
    out = []
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
        if not found:
            raise ValueError(f"no file at {path}")
        out += sorted(f.getPath().toString() for f in found)
    return list(dict.fromkeys(out))


def read_files(spark: SparkSession, paths: list[str], keys: list[str] = SERIES, years: tuple[int, int] | None = None, bbox=None, day: str = "day_idx") -> DataFrame:
    """Many files of raw values as one table, first file wins: of the files that hold a day of a series the first in the order given stays, with the whole day. Rows without a day go (see time_report).

    paths: files or folders of Parquet, or globs. Columns that only some have are null in the others. file_seq is the place in the expanded list. Years and the box are
    pushed to the files."""
    expanded = expand_paths(spark, paths)
    # A row per file, as many as the caller named.
    order = spark.createDataFrame([(p, k) for k, p in enumerate(expanded)], "_path string, file_seq int")
    df = spark.read.option("mergeSchema", "true").parquet(*expanded)
    file = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/")
    df = subset_bbox(slice_years(df, years) if years else df, bbox).select("*", F.array(file, F.regexp_replace(file, "/[^/]*$", "")).alias("_files"))
    named = df.join(F.broadcast(order) if len(expanded) <= 100_000 else order, F.array_contains("_files", F.col("_path"))).drop("_files", "_path")
    return dedupe_days(drop_bad_time(named, day), keys, day)


def time_report(df: DataFrame, keys: list[str] = SERIES, day: str = "day_idx") -> DataFrame:
    """(keys, rows, bad, days): how many rows of each series have no day and are skipped, and how many days are left."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(day).isNull()).alias("bad"), F.count_distinct(day).alias("days"))


def rain_report(df: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """(keys, units, mean, note) of precipitation as it is given: notes on labels that are not known, and on series whose mean in target units, over the first 31 days, is above 0.01 kg m-2 s-1."""
    rain = df.where("var = 'pr'")
    first = rain.groupBy(*keys).agg(F.min("day_idx").alias("_d0"))
    unit = plain_unit(F.col("units"))
    near = rain.join(first, keys).where(F.col("day_idx") < F.col("_d0") + 31).withColumn("_v", to_target_units("pr", F.col("value").cast("double"), unit, F.lit(None).cast("double")))
    out = near.groupBy(*keys, "units").agg(F.avg("_v").alias("mean"))
    notes = F.concat_ws("; ", F.when(~unit.isin(METRES + PER_DAY + FLUX), "unknown units, taken as kg m-2 s-1"), F.when(F.col("mean") > 1e-2, "mean too large, check units"))
    return out.select(*keys, "units", "mean", notes.alias("note"))


def write_cube(df: DataFrame, path: str, keys: list[str] = ("model", "scenario", "member")) -> None:
    """Parquet by series; a tile's cells in one file, each cell's days in order, so that what follows reads whole histories."""
    df.repartition(*keys, "tile").sortWithinPartitions("tile", "cell_id", "day_idx").write.mode("overwrite").partitionBy(*keys).parquet(path)


def tile_of(cell: Column, size: int = 128) -> Column:
    """Blocks of neighbouring cells."""
    return F.floor(cell / size).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def cached(spark: SparkSession, make, path: str, **fingerprint) -> DataFrame:
    """The table at a path if it was made with the same parameters, else made anew. The parameters' digest is part of the name, and the writer's mark of success of the check."""
    digest = hashlib.sha256(json.dumps(fingerprint, sort_keys=True, default=str).encode()).hexdigest()[:16]
    target = f"{path.rstrip('/')}-{digest}"
    if not _exists(spark, f"{target}/_SUCCESS"):
        make().write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def stage_inputs(spark: SparkSession, make, path: str, keys: list[str], late=None, most_lost: int = 2, **fingerprint) -> DataFrame:
    """Stage once, reuse after. ``late`` makes a table of further variables, joined by keys; a loss of more than most_lost days is an error."""
    base = cached(spark, make, path, **fingerprint)
    if late is None:
        return base
    both = base.join(cached(spark, late, f"{path}-late", **fingerprint), keys)
    days = lambda df: df.select("day_idx").distinct().count()
    if (lost := days(base) - days(both)) > most_lost:
        raise ValueError(f"{lost} days have no late variables")
    return both


def bool_to_tinyint(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("tinyint") for c, t in df.dtypes if t == "boolean"})


def write_csv(df: DataFrame, path: str) -> None:
    """One file with a header: for tables of regions or models."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_injection(spark: SparkSession, path: str, columns: list[str], sep: str = ",", header: bool = True, first_year: int | None = None) -> DataFrame:
    """A log of yearly rows; without a header its years follow from the order of its lines."""
    reader = spark.read.option("sep", sep).option("inferSchema", False).option("ignoreLeadingWhiteSpace", True)
    df = reader.option("header", header).csv(path).toDF(*columns)
    df = df.select(*[F.col(c).cast("int" if c == "year" else "double").alias(c) for c in columns])
    if first_year is not None:  # a log has some dozens of lines, in one file
        df = df.withColumn("year", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) - 1 + first_year)
    return df


def extract_sample(daily: DataFrame, spans: dict[str, tuple[str, int, int]], members: list[str], bbox) -> DataFrame:
    """A small box of some members, days numbered from 0 within each run."""
    runs = daily.sparkSession.createDataFrame([(r, s, y0, y1) for r, (s, y0, y1) in spans.items()], "run string, scenario string, _y0 int, _y1 int")
    some = subset_bbox(daily.where(F.col("member").isin(members)), bbox).join(F.broadcast(runs), "scenario").where(F.col("year").between(F.col("_y0"), F.col("_y1")))
    key = ["model", "run", "member"]
    days = some.select(*key, "day_idx").distinct().withColumn("day_index", F.row_number().over(Window.partitionBy(*key).orderBy("day_idx")) - 1)
    return some.join(days, [*key, "day_idx"]).select(*daily.columns, "run", "day_index")


def choose_fwi_temp(daily: DataFrame, required: tuple[str, ...] = ("tasmax", "hurs", "sfcWind", "pr"), scenarios: list[str] | None = None, days: int = 60, least: float = 0.5) -> DataFrame:
    """(model, temperature): ``tasmax`` if every scenario (those given, or all the model has) has a member with all inputs whose tasmax is genuine, else ``tas``.

    Genuine: over the member's first days on average at least half a kelvin above its tas, or without a tas to compare with. The first
    such member by name speaks for its scenario. Models with a known bad tasmax take tas."""
    key, has = ["model", "scenario", "member"], lambda v: F.count(v) > 0 if v in daily.columns else F.lit(False)
    full = F.lit(True)
    for v in required:
        full &= has(v)
    series = daily.groupBy(*key).agg(full.alias("_full"), F.min("day_idx").alias("_d0"))
    first = series.where("_full").groupBy("model", "scenario").agg(F.min("member").alias("member"), F.min_by("_d0", "member").alias("_d0"))
    warmer = F.avg(F.col("tasmax") - F.col("tas")) if {"tas", "tasmax"} <= set(daily.columns) else F.lit(None).cast("double")
    genuine = daily.join(first, key).where(F.col("day_idx") < F.col("_d0") + days).groupBy("model", "scenario").agg((F.coalesce(warmer, F.lit(least)) >= least).alias("_ok"))
    wanted = daily.select("model", "scenario").distinct() if scenarios is None else daily.select("model").distinct().withColumn("scenario", F.explode(F.array(*map(F.lit, scenarios))))
    bad = F.col("model").isin([m for m, v in BAD_VARIABLES if v == "tasmax"])
    ok = F.min(F.coalesce("_ok", F.lit(False)) & ~bad)
    return wanted.join(genuine, ["model", "scenario"], "left").groupBy("model").agg(F.when(ok, "tasmax").otherwise("tas").alias("temperature"))


def compare_fields(daily: DataFrame, a: str, b: str, keys: list[str], days: int = 10) -> DataFrame:
    """Means of two variables and their largest difference over the first days."""
    first = daily.groupBy(*keys).agg(F.min("day_idx").alias("_d0"))
    near = daily.join(first, keys).where(F.col("day_idx") < F.col("_d0") + days)
    return near.groupBy(*keys).agg(F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.max(F.abs(F.col(a) - F.col(b))).alias("max_diff"))


def wind_diagnostics(daily: DataFrame, keys: list[str]) -> DataFrame:
    """What a model's wind is: magnitudes, days, median step, ratio to the components and correlation of the daily area means."""
    by_day = daily.groupBy(*keys, "day_idx").agg(F.avg("sfcWind").alias("s"), F.avg(F.hypot("uas", "vas")).alias("uv"), F.avg(F.abs("sfcWind")).alias("a"), F.max("sfcWind").alias("top"))
    stepped = by_day.withColumn("step", F.col("day_idx") - F.lag("day_idx").over(Window.partitionBy(*keys).orderBy("day_idx")))
    return stepped.groupBy(*keys).agg(F.avg("s").alias("mean"), F.avg("a").alias("mean_abs"), F.max("top").alias("max"), F.percentile("step", F.lit(0.5)).alias("step_days"), F.count(F.lit(1)).alias("n_days"), (F.avg("s") / F.avg("uv")).alias("ratio"), F.corr("s", "uv").alias("corr"))


def input_sanity(daily: DataFrame, cells: DataFrame, keys: list[str], days: int = 365) -> DataFrame:
    """Land means of the inputs over the first days and the names of those that are implausible."""
    first = daily.groupBy(*keys).agg(F.min("day_idx").alias("_d0"))
    near = daily.join(first, keys).where(F.col("day_idx") < F.col("_d0") + days)
    have = [v for v in PLAUSIBLE if v in daily.columns]
    per_cell = near.groupBy(*keys, "cell_id").agg(*[F.avg(mm_per_day(F.col(v)) if v == "pr" else F.col(v)).alias(v) for v in have])
    means = per_cell.join(cells.where("land").select("cell_id", F.col("lat").alias("_lat")), "cell_id").groupBy(*keys).agg(*[weighted_mean(v, area_weight("_lat")).alias(v) for v in have])
    flags = F.array_join(F.filter(F.array(*[F.when(~F.col(v).between(*PLAUSIBLE[v]), F.lit(v)) for v in have]), lambda x: x.isNotNull()), ", ")
    return means.withColumn("check", F.when(flags == "", "ok").otherwise(F.concat(F.lit("IMPLAUSIBLE: "), flags)))


def check_results(yearly: DataFrame, days: int = 365) -> DataFrame:
    """Per model and run: mean days above the threshold against 5 % of a year, and the extremes of the index (index_min, index_max per row)."""
    out = yearly.groupBy("model", "run").agg(F.avg("days_p95").alias("days"), F.percentile("days_p95", F.lit(0.5)).alias("median_days"), F.min("index_min").alias("low"), F.max("index_max").alias("high"))
    return out.withColumn("expected", F.lit(0.05 * days)).withColumn("ok", (F.abs(F.col("days") - F.col("expected")) <= 0.5) & (F.col("low") >= 0) & (F.col("high") <= 200))
