"""Climatological deltas, driver attribution and the decomposition of vapour-pressure deficit."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.physics import percent, vpd_from_rh
from emberline.operators import fwi
from emberline.operators.fwi import prepend_spinup
from emberline.operators.season import fire_season_mask, seasonal_mean

# How a variable's change is applied, what keeps a ratio finite, and its limits.
ADDED, SCALED, RATIO_LIMITS = ["tasmax", "tas", "hurs", "hursmin"], {"pr": 1e-9, "sfcWind": 1e-3}, (0.2, 5.0)
DRIVERS = {"T": ["tasmax", "tas"], "RH": ["hurs", "hursmin"], "wind": ["sfcWind"], "precip": ["pr"]}


def climatological_deltas(scenario: DataFrame, base: DataFrame, values: list[str], keys: list[str]) -> DataFrame:
    """Monthly change per cell (keys, month): differences of temperature and humidity, bounded ratios of wind and rain."""
    both = scenario.select(*keys, "month", *[F.col(v).alias(f"_s_{v}") for v in values]).join(base.select(*keys, "month", *[F.col(v).alias(f"_b_{v}") for v in values]), [*keys, "month"])

    def delta(v: str):
        s, b = F.col(f"_s_{v}"), F.col(f"_b_{v}")
        if v in ADDED:
            return s - b
        r = (s + SCALED[v]) / (b + SCALED[v])
        return F.when(r.isNotNull(), F.least(F.greatest(r, F.lit(RATIO_LIMITS[0])), F.lit(RATIO_LIMITS[1])))

    return both.select(*keys, "month", *[delta(v).alias(v) for v in values])


def apply_deltas(base: DataFrame, deltas: DataFrame, values: list[str], keys: list[str]) -> DataFrame:
    """Daily baseline with the changes of its months. Humidity stays within 0 and 100."""
    named = deltas.select(*keys, "month", *[F.col(v).alias(f"_d_{v}") for v in values])
    out = base.join(named, [*keys, "month"])
    changed = {v: (F.col(v) + F.col(f"_d_{v}") if v in ADDED else F.col(v) * F.col(f"_d_{v}")) for v in values}
    return out.withColumns({v: (percent(x) if v.startswith("hurs") else x).cast("float") for v, x in changed.items()}).select(*base.columns)


def set_names(scenarios: list[str]) -> list[tuple[str, str | None, str | None]]:
    """(name, scenario, driver): the baseline, and for each scenario its drivers one by one and all together."""
    return [("baseline", None, None)] + [(f"{s}:{d}", s, d) for s in scenarios for d in [*DRIVERS, "all"]]


def driver_walk(base: DataFrame, deltas: DataFrame, thresholds: DataFrame, scenarios: list[str], values: list[str], series: list[str], temperature: str = "tas", start_year: int | None = None) -> DataFrame:
    """(driver_set, series, cell_id, year, month, above, total, n): days above the cell's threshold, and sum and number of the index's days, with the changes of one driver, of all or of none.

    A task gets a tile's days once, with the monthly changes and thresholds of its cells beside them, and walks days × cells × driver sets as
    one array; it hands on counts by month, so neither way is wider than one set."""
    inputs = (temperature, "hurs", "sfcWind", "pr")
    used = [v for v in values if v in inputs]
    cells = base.select(*series, "cell_id").distinct().join(thresholds.select("cell_id", "threshold"), "cell_id")
    changes = deltas.where(F.col("scenario").isin(scenarios)).select("scenario", "cell_id", "month", *[F.col(v).cast("double").alias(v) for v in used])
    # Twelve rows for each cell and scenario, and one row where a cell has no change at all.
    side = cells.join(changes, "cell_id", "left").select(*series, "cell_id", "threshold", "scenario", F.col("month").alias("_month"), *[F.col(v).alias(f"_d_{v}") for v in used])
    sets, kinds = set_names(scenarios), dict(base.select(*series).dtypes)
    schema = ", ".join(["driver_set string", *(f"{c} {kinds[c]}" for c in series), "cell_id long, year int, month int, above long, total double, n long"])

    def tile(days: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(days) and len(other):
            rows = days.sort_values(["day_idx", "cell_id"])
            plain = rows.assign(**{v: rows[v].astype("float32") for v in inputs})
            _, month, lat, k, j, cells = fwi.dense(plain, inputs, True)
            raw = np.full((4, len(month), len(cells)), np.nan)
            for i, v in enumerate(inputs):
                raw[i, k, j] = rows[v].to_numpy(dtype=float)
            change = {s: {v: np.full((13, len(cells)), np.nan) for v in used} for s in scenarios}
            other = other[other["cell_id"].isin(cells)]
            for s, part in other.dropna(subset=["scenario"]).groupby("scenario"):
                for v in used:
                    change[s][v][part["_month"].to_numpy(int), np.searchsorted(cells, part["cell_id"].to_numpy())] = part[f"_d_{v}"].to_numpy(dtype=float)
            grids = np.empty((4, len(month), len(sets), len(cells)))
            for q, (_, s, d) in enumerate(sets):
                for i, v in enumerate(inputs):
                    x = raw[i]
                    if s is not None and v in used and (d == "all" or v in DRIVERS[d]):
                        by_day = change[s][v][month]
                        x = x + by_day if v in ADDED else x * by_day
                        x = np.clip(x, 0, 100) if v.startswith("hurs") else x
                    grids[i, :, q] = x.astype(np.float32)
            scale = np.array([1, 1, 3.6, 86400])[:, None, None, None]
            grids = grids * scale + np.array([-273.15, 0, 0, 0])[:, None, None, None]
            index = fwi.walk(*grids.reshape(4, len(month), -1), month, np.tile(lat, len(sets)))["fwi"].reshape(len(month), len(sets), len(cells))
            limit = np.full(len(cells), np.nan)
            limit[np.searchsorted(cells, other["cell_id"].to_numpy())] = other["threshold"].to_numpy(dtype=float)
            own = {c: rows[c].iloc[0] for c in series}
            kept = rows.assign(_k=k, _j=j)[["cell_id", "year", "month", "_k", "_j"]]
            kept = kept[kept["cell_id"].isin(other["cell_id"])]
            if start_year is not None:
                kept = kept[kept["year"] >= start_year]
            for q, (name, _, _) in enumerate(sets):
                x = index[kept["_k"].to_numpy(), q, kept["_j"].to_numpy()]
                with np.errstate(invalid="ignore"):
                    part = kept.assign(above=(x > limit[kept["_j"].to_numpy()]).astype(np.int64), total=np.nan_to_num(x), n=np.isfinite(x).astype(np.int64))
                out.append(part.groupby(["cell_id", "year", "month"], as_index=False)[["above", "total", "n"]].sum().assign(driver_set=name, **own))
        names = ["driver_set", *series, "cell_id", "year", "month", "above", "total", "n"]
        return pd.concat(out)[names] if out else pd.DataFrame(columns=names)

    rows = base.select(*series, "cell_id", "lat", "year", "month", "day_idx", *inputs)
    # The cells come from the days: named anew, or the two sides' columns couldn't be told apart.
    return rows.groupBy(*series).cogroup(side.toDF(*side.columns).groupBy(*series)).applyInPandas(tile, schema)


def driver_changes(counts: DataFrame, series: list[str], season_mask: DataFrame | None = None) -> DataFrame:
    """From driver_walk, per driver set and cell: change against the baseline of the mean days a year above the threshold (over the years of all series) and of the fire-season mean index.

    The season is season_mask (cell_id, month, in_season), or else the one of the baseline's index. counts is read several times, so it should be a written table."""
    days = counts.groupBy("driver_set", *series, "cell_id", "year").agg(F.sum("above").alias("_d")).groupBy("driver_set", "cell_id").agg(F.avg("_d").alias("days"))
    monthly = counts.groupBy("driver_set", "cell_id", "month").agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("fwi"))
    mask = season_mask if season_mask is not None else fire_season_mask(monthly.where("driver_set = 'baseline'"), "fwi", ["cell_id"])
    means = days.join(seasonal_mean(monthly, mask, "fwi", ["driver_set", "cell_id"], ["cell_id"]), ["driver_set", "cell_id"], "left")
    at_base = means.where("driver_set = 'baseline'").select("cell_id", F.col("days").alias("_d"), F.col("fwi").alias("_f"))
    return means.where("driver_set <> 'baseline'").join(at_base, "cell_id").select("driver_set", "cell_id", (F.col("days") - F.col("_d")).alias("delta_days"), (F.col("fwi") - F.col("_f")).alias("delta_fwi"))


def attribution(
    base: DataFrame, deltas: DataFrame, thresholds: DataFrame, values: list[str], series: list[str], temperature: str = "tas", start_year: int | None = None, season_mask: DataFrame | None = None, scenarios: list[str] | None = None,
    keep: Callable[[DataFrame], DataFrame] = lambda counts: counts,
) -> DataFrame:
    """driver_changes of driver_walk. keep writes the walk's counts and returns them as they were written, so that the walk runs once. scenarios: names in
    deltas, all of them (a few) by default. Cells without a threshold are left out."""
    if start_year is not None:  # a series that starts with it runs up on a copy of its first year
        base = prepend_spinup(base, series, start_year)
    if scenarios is None:
        scenarios = [r[0] for r in deltas.select("scenario").distinct().orderBy("scenario").collect()]
    return driver_changes(keep(driver_walk(base, deltas, thresholds, scenarios, values, series, temperature, start_year)), series, season_mask)


def vpd_decomposition(scenario: DataFrame, base: DataFrame, keys: list[str], t: str = "tas", rh: str = "hurs") -> DataFrame:
    """From monthly climatologies: the change of VPD with temperature alone, with humidity alone, in all, and what both leave over."""
    both = scenario.select(*keys, "month", F.col(t).alias("_t1"), F.col(rh).alias("_h1")).join(base.select(*keys, "month", F.col(t).alias("_t0"), F.col(rh).alias("_h0")), [*keys, "month"])
    at = lambda a, b: vpd_from_rh(F.col(a), F.col(b))
    terms = both.select(*keys, "month", (at("_t1", "_h0") - at("_t0", "_h0")).alias("t_term"), (at("_t0", "_h1") - at("_t0", "_h0")).alias("rh_term"), (at("_t1", "_h1") - at("_t0", "_h0")).alias("total"))
    return terms.withColumn("residual", F.col("total") - F.col("t_term") - F.col("rh_term"))
