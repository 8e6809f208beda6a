"""The three workloads end to end: daily fire-weather extremes, vapour-pressure demand, and the overview of a cooling scenario. Each takes tables and returns tables. What is costly is written once as a stage; only a row per model reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions import calendars
from emberline.functions.physics import daily_vpd
from emberline.jobs.stages import Stage, Stages
from emberline.operators import attribution, classify, extremes, fwi, grid, overview, regions, season, stats
from emberline.schema import PAIRS, RUNS, TARGET_PERIOD
from emberline.sources import catalog, ingest, resolve

MEMBER_CELL = ["model", "run", "member", "cell_id"]


def with_runs(daily: DataFrame, runs=RUNS, spinup: int = 0) -> DataFrame:
    """Days of the named runs: scenario and years. A day may belong to two runs."""
    named = daily.sparkSession.createDataFrame([(r, s, y0 - spinup, y1) for r, s, y0, y1 in runs], "run string, scenario string, _y0 int, _y1 int")
    return daily.join(F.broadcast(named), (daily["scenario"] == named["scenario"]) & F.col("year").between(F.col("_y0"), F.col("_y1"))).drop(named["scenario"]).drop("_y0", "_y1")


def staged_metrics(stages: Stages, index: Stage, value: str, target: str, absolute: float | None) -> dict[str, Stage]:
    """Thresholds from the target run, and the yearly and monthly metrics of all runs against them, each table a stage. The metrics read the thresholds as they were written."""
    thresholds = stages.stage("thresholds_" + value, lambda: extremes.pooled_quantile(index.table.where(F.col("run") == target), value, ["model", "cell_id"]), (index,), target=target)
    metrics = lambda k: extremes.exceedance_metrics(index.table, thresholds.table, value, MEMBER_CELL, ["model", "cell_id"], absolute)[k]
    yearly = stages.stage("yearly_" + value, lambda: metrics(0), (index, thresholds), absolute=absolute)
    monthly = stages.stage("monthly_" + value, lambda: metrics(1), (index, thresholds))
    return {"thresholds": thresholds, "yearly": yearly, "monthly": monthly}


def changes(annual: DataFrame, value: str, pairs=PAIRS, alpha: float = 0.10) -> DataFrame:
    """All pairs of runs in one plan: delta, p value and significance within each model's map."""
    m = stats.moments(annual, value, ["model", "run", "cell_id"])
    named = F.broadcast(stats.run_pairs(m, pairs))
    a = m.join(named.select("pair", F.col("a").alias("run")), "run").drop("run")
    b = m.join(named.select("pair", F.col("b").alias("run")), "run").drop("run")
    return stats.fdr_significant(stats.welch(a, b, ["pair", "model", "cell_id"]), ["pair", "model"], alpha)


def complete_inputs(daily: DataFrame, ratio: DataFrame | None = None, wind_doy: DataFrame | None = None) -> DataFrame:
    """Wind and humidity where they lack: wind from the climatology by day of year (model, cell_id, doy, sfcWind) of the models that have one, else from its components times the monthly ratio (model, cell_id, month, ratio); humidity from specific humidity."""
    lacking = [c for c in ("sfcWind", "hurs", "uas", "vas", "huss", "ps") if c not in daily.columns]
    if not {"sfcWind", "hurs"} & set(lacking) and ratio is None and wind_doy is None and {"uas", "vas", "huss", "ps"} <= set(lacking):
        return daily
    out = daily.withColumns({c: F.lit(None).cast("float") for c in lacking})
    if wind_doy is not None:
        clim = wind_doy.select("model", "cell_id", "doy", F.col("sfcWind").alias("_clim"))
        out = grid.lookup_doy(out, clim, ["model", "cell_id"], ["_clim"]).withColumn("sfcWind", F.coalesce("_clim", "sfcWind")).drop("_clim")
    return ingest.fill_derived(out, ratio).select(*daily.columns, *[c for c in ("sfcWind", "hurs") if c not in daily.columns])


def fwi_by_chunks(stages: Stages, daily: DataFrame, keys: list[str], chunks: list[tuple[int, int]], temperature: str, flux: bool = True, **source) -> list[Stage]:
    """The index of a history in chunks of years (first and last year, in order), each a stage that goes on from the state that the one before ended with.

    A task holds a chunk's years of a tile and no more. With a chunk added at the end only that one is walked, and daily need not hold older years. The
    last state of a chunk is a row per cell."""
    if any(a > b for a, b in chunks) or any(x[1] >= y[0] for x, y in zip(chunks, chunks[1:])):
        raise ValueError("chunks are spans of years in order that don't overlap")
    made, state = [], None
    for y0, y1 in chunks:
        days, before = daily.where(F.col("year").between(y0, y1)), state
        walked = lambda days=days, before=before: fwi.compute_fwi(days, keys, temperature, codes=("ffmc", "dmc", "dc", "fwi"), flux=flux, state=before and before.table)
        codes = stages.stage(f"codes_{y0}_{y1}", walked, (before,) if before else (), temperature=temperature, flux=flux, keys=keys, **source)
        state = stages.stage(f"state_{y0}_{y1}", lambda codes=codes, before=before: fwi.final_codes(codes.table, keys, before and before.table), (codes, before) if before else (codes,))
        made.append(codes)
    return made


def chunked_index(stages: Stages, chunks: list[Stage]) -> DataFrame:
    """The codes of all chunks as one table of many folders, whose plan doesn't grow with their number."""
    return stages.spark.read.schema(chunks[0].table.schema).parquet(*[c.path for c in chunks])


def fire_weather(
    daily: DataFrame, cells: DataFrame, cell_region: DataFrame, runs=RUNS, target: str = "target", temperature: str | None = None, pairs=PAIRS, absolute: float = 30.0, flux: bool = True,
    common_res: float | None = 1.0, ratio: DataFrame | None = None, wind_doy: DataFrame | None = None, stages: Stages | None = None, archive: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Daily index, thresholds, days above them, spells, fire season, changes, multi-model mean and regional means.

    Each model uses the temperature that choose_fwi_temp finds, unless one is named for all. Series that start with a run's first year run
    up on a copy of it. The multi-model mean is taken on the common grid; common_res None says that all models share one grid.

    archive: the catalog of the members. With it the catalog decides where wind and humidity come from (see resolve), the ratio corrects derived wind, and members that it
    lacks are left out; without it gaps are filled where they are found (see complete_inputs).

    The inputs of all runs, the index, the thresholds, the yearly and monthly metrics and the changes are stages: they are written when this is
    called, unless ``stages`` has them, and every output reads them. The inputs hold both temperatures, so another choice makes the index and
    what follows anew but not the inputs."""
    spark, stages = daily.sparkSession, stages or Stages.of_session(daily.sparkSession)
    starts = spark.createDataFrame([(r, y0) for r, _, y0, _ in runs], "run string, _y0 int")

    def run_inputs() -> DataFrame:
        if archive is not None:
            wanted = ["sfcWind", "hurs", "pr", *[v for v in ("tas", "tasmax") if v in daily.columns]]
            base = next(((s, (y0, y1)) for r, s, y0, y1 in runs if r == target), (resolve.DONOR_SCENARIO, TARGET_PERIOD))
            filled = resolve.resolve_inputs(daily, resolve.plan_inputs(archive, wanted, base[0]), ratio, *base)
        else:
            filled = complete_inputs(daily, ratio, wind_doy)
        named = with_runs(filled, runs, spinup=1)
        return fwi.prepend_spinup(named.join(F.broadcast(starts), "run"), ["model", "run", "member"], "_y0").drop("_y0").repartition("model", "run", "member", "tile").sortWithinPartitions("tile", "cell_id", "day_idx")

    inputs = stages.stage("inputs", run_inputs, partition_by=("model", "run", "member"), runs=runs, columns=sorted(daily.columns), ratio=ratio is not None, wind_doy=wind_doy is not None, archive=archive is not None)
    both = {"tas", "tasmax"} <= set(daily.columns)
    if temperature is None and both:
        # A row per model: small enough to be part of the index's name.
        choice = sorted((r["model"], r["temperature"]) for r in stages.stage("temperature", lambda: ingest.choose_fwi_temp(daily), (inputs,)).table.collect())
    else:
        choice = temperature or ("tasmax" if "tasmax" in daily.columns else "tas")

    def walked() -> DataFrame:
        rows, column = inputs.table, choice
        if not isinstance(choice, str):
            rows, column = rows.join(F.broadcast(spark.createDataFrame(choice, "model string, _of string")), "model").withColumn("_warm", F.when(F.col("_of") == "tasmax", F.col("tasmax")).otherwise(F.col("tas"))), "_warm"
        index = fwi.compute_fwi(rows, ["model", "run", "member", "tile"], column, flux=flux)
        return index.join(F.broadcast(starts), "run").where("year >= _y0").drop("_y0")

    index = stages.stage("index", walked, (inputs,), partition_by=("model", "run", "member"), temperature=choice, flux=flux)
    metrics = staged_metrics(stages, index, "fwi", target, absolute)
    out = {"index": index.table} | {k: s.table for k, s in metrics.items()}
    out["mean"] = index.table.groupBy(*MEMBER_CELL).agg(F.avg(F.col("fwi").cast("double")).alias("mean"))
    out["season"] = season.fire_season_mask(out["monthly"].where(F.col("run") == target).groupBy("model", "cell_id", "month").agg(F.avg("mean_month").alias("v")), "v", ["model", "cell_id"])
    out["seasonal"] = season.seasonal_mean(out["monthly"].select(*MEMBER_CELL, "month", F.col("mean_month").alias("fwi")), out["season"], "fwi", MEMBER_CELL, ["model", "cell_id"])
    out["changes"] = stages.stage("changes_fwi", lambda: changes(out["yearly"], "days_p95", pairs), (metrics["yearly"],), pairs=pairs).table
    # The change of the fire-season index, which tells classes of evaporative_demand apart.
    by_run = stats.ensemble_mean(out["seasonal"], ["fwi"], ["model", "run", "cell_id"])
    out["season_change"] = stats.pair_delta(by_run, "fwi", ["model", "cell_id"], pairs)
    own = out["changes"].select("model", "pair", "cell_id", "delta", "significant")
    stacked = grid.with_model_count(own, own) if common_res is None else grid.stack_models(own, cells, ["delta", "significant"], ["pair"], common_res)
    out["multimodel"] = stats.multimodel(stacked, ["pair", "cell_id"], models="n_models")
    means = stats.ensemble_mean(out["yearly"], ["days_p95", "days_abs", "spell_max"], ["model", "run", "cell_id"])
    out["regional"] = regions.regional_means(means, cell_region, cells, ["days_p95", "days_abs", "spell_max"], ["model", "run"])
    return out


def evaporative_demand(
    daily: DataFrame, cells: DataFrame, cell_region: DataFrame, season_mask: DataFrame | None = None, runs=RUNS, target: str = "target", method: str = "mean", pairs=PAIRS, season_change: DataFrame | None = None, stages: Stages | None = None,
) -> dict[str, DataFrame]:
    """Daily VPD with its extremes, fire-season changes of VPD and rain, decomposition, classes and their areas.

    season_change: (pair, model, cell_id, delta) of the fire-season index from fire_weather; without it no cell is of class 3. The daily VPD of
    the runs, thresholds, metrics, monthly series and climatology are stages, as in fire_weather; none depends on the index or its temperature."""
    stages = stages or Stages.of_session(daily.sparkSession)
    vpd = stages.stage("vpd", lambda: with_runs(daily, runs).withColumn("vpd", daily_vpd(method)), partition_by=("model", "run", "member"), runs=runs, method=method)
    out = {k: s.table for k, s in staged_metrics(stages, vpd, "vpd", target, None).items()}
    out["mean"] = vpd.table.groupBy(*MEMBER_CELL).agg(F.avg(F.col("vpd").cast("double")).alias("mean"))
    series = stages.stage("series", lambda: season.resample_monthly(vpd.table, ["vpd", "pr"], MEMBER_CELL, {"pr": 86400.0}), (vpd,)).table
    clim = stages.stage("climatology", lambda: season.monthly_climatology(vpd.table, ["tas", "hurs", "vpd"], ["model", "run", "cell_id"]), (vpd,)).table
    mask = season_mask or season.fire_season_mask(clim.where(F.col("run") == target), "vpd", ["model", "cell_id"])
    yearly = {v: season.fire_season_annual(series, mask, v, MEMBER_CELL, ["model", "cell_id"]) for v in ("vpd", "pr")}
    key = ["pair", "model", "cell_id"]
    both = changes(yearly["vpd"], "vpd", pairs).select(*key, F.col("delta").alias("dvpd"), F.col("pvalue").alias("p_vpd"), F.col("significant").alias("sig_vpd"))
    both = both.join(changes(yearly["pr"], "pr", pairs).select(*key, F.col("delta").alias("dpr"), F.col("significant").alias("sig_pr")), key)
    index = None
    if season_change is not None:
        both, index = both.join(season_change.select(*key, F.col("delta").alias("dfwi")), key, "left"), F.col("dfwi")
    out["changes"] = both.withColumn("offset_class", classify.classify_offset(F.col("dvpd"), F.col("dpr"), index))
    named = F.broadcast(stats.run_pairs(clim, pairs))
    of = lambda side: clim.join(named.select("pair", F.col(side).alias("run")), "run").drop("run")
    split = attribution.vpd_decomposition(of("a"), of("b"), key)
    out["terms"] = season.seasonal_mean(split, mask, "t_term", key, ["model", "cell_id"])
    for term in ("rh_term", "total", "residual"):
        out["terms"] = out["terms"].join(season.seasonal_mean(split, mask, term, key, ["model", "cell_id"]), key)
    out["areas"] = regions.area_fractions(out["changes"].select("pair", "model", "cell_id", "offset_class"), cells, ["pair", "model"])
    out["regional"] = regions.regional_means(out["changes"].select(*key, "dvpd", "dpr"), cell_region, cells, ["dvpd", "dpr"], ["pair", "model"])
    return out


def model_summary(thresholds: DataFrame, means: DataFrame, deltas: DataFrame, runs: list[str], pairs: list[str]) -> DataFrame:
    """Wide table per model and cell: threshold, a column per run's mean, and per pair delta, pvalue, significant. means: model, run, cell_id, value."""
    a = means.groupBy("model", "cell_id").pivot("run", runs).agg(F.first("value"))
    b = deltas.groupBy("model", "cell_id").pivot("pair", pairs).agg(F.first("delta").alias("delta"), F.first("pvalue").alias("pvalue"), F.first("significant").alias("significant"))
    return thresholds.join(a, ["model", "cell_id"], "left").join(b, ["model", "cell_id"], "left")


def temperature_response(monthly: DataFrame, years: tuple[int, int], base_years: tuple[int, int], base: str) -> dict[str, DataFrame]:
    """Global annual series, their envelopes, and zonal anomalies against a baseline scenario and period."""
    key = ["model", "scenario", "member"]
    series = overview.global_annual_series(monthly, "tas", key)
    zonal = overview.zonal_mean_period(monthly, "tas", key, years)
    reference = overview.zonal_mean_period(monthly.where(F.col("scenario") == base), "tas", key, base_years).drop("scenario")
    cross = zonal.join(reference.select("model", "member", "lat", F.col("tas").alias("_base")), ["model", "member", "lat"])
    return {
        "series": series,
        "envelope": overview.ensemble_envelope(series, "tas", ["model", "scenario", "year"]),
        "zonal": zonal,
        "anomaly": overview.ensemble_envelope(cross.withColumn("anomaly", F.col("tas") - F.col("_base")), "anomaly", ["model", "scenario", "lat"]),
    }


def discovery(listing: DataFrame, required: list[str], extra: DataFrame | None = None, max_members: int | None = None) -> dict[str, DataFrame]:
    """From a table of paths to the catalog, its inventory and readiness, and the coverage of the archive."""
    found = catalog.classify_paths(listing)
    entries = catalog.build_catalog(found)
    entries = catalog.apply_known_issues(catalog.merge_catalog(entries, extra) if extra is not None else entries)
    by_freq, years, unknown = catalog.coverage(found)
    members = catalog.select_members(entries, required, max_members)
    return {"catalog": entries, "inventory": catalog.catalog_inventory(entries, required), "readiness": catalog.readiness_table(entries, required, max_members), "members": members, "models": catalog.select_models(members), "by_freq": by_freq, "years": years, "unknown": unknown}


def harmonise(raw: DataFrame, variables: list[str], years: tuple[int, int], bbox=None) -> DataFrame:
    """Raw values (model, scenario, member, file_seq, var, units, lat, lon, year, month, day, hour, doy, day_idx, has_bounds, cell_id, value) to one wide daily table. Bounds of the days, if there are any, are bounds_lo and bounds_hi in days.

    With a column calendar, day_idx counts days in it (see calendars), and year, month, day and doy are taken from that number instead of being given."""
    df = ingest.harmonize_columns(raw)
    if {"bounds_lo", "bounds_hi"} <= set(df.columns):
        df = df.withColumn("day_idx", ingest.label_day(F.col("bounds_lo"), F.col("bounds_hi"), F.col("day_idx"))).drop("bounds_lo", "bounds_hi")
    df = ingest.drop_bad_time(df)
    if "calendar" in df.columns:
        df = calendars.decode_days(df, F.col("day_idx"))
    df = ingest.dedupe_days(ingest.shift_end_stamps(ingest.wrap_longitudes(df, ingest.SERIES)))
    if "calendar" in df.columns:  # once more: a stamp at a day's end may have moved to the year before
        df = calendars.decode_days(df, F.col("day_idx"))
    df = ingest.convert_units(ingest.subset_bbox(ingest.slice_years(df, years), bbox))
    keys = ["model", "scenario", "member", *(["calendar"] if "calendar" in df.columns else []), "cell_id", "lat", "lon", "year", "month", "day", "doy", "day_idx"]
    return ingest.merge_variables(df, variables, keys)[0].withColumn("tile", ingest.tile_of(F.col("cell_id")))
