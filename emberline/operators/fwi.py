"""Daily fire weather index: the moisture codes of a cell depend on all its days before, so a task walks through the days of a tile of cells with numpy.

What the days before have left are three codes per cell. So a history can be walked in chunks of years, each from the codes that the chunk before ended with,
and a new year is added without the old ones."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions import calendars

# Start of the codes; effective day lengths of DMC and day length adjustments of DC, by latitude band and month.
START = (85.0, 6.0, 15.0)
CODES = ["dc", "dmc", "ffmc", "isi", "bui", "fwi"]
DMC_HOURS = np.array([
    [11.5, 10.5, 9.2, 7.9, 6.8, 6.2, 6.5, 7.4, 8.7, 10.0, 11.2, 11.8],
    [10.1, 9.6, 9.1, 8.5, 8.1, 7.8, 7.9, 8.3, 8.9, 9.4, 9.9, 10.2],
    [9.0] * 12,
    [7.9, 8.4, 8.9, 9.5, 9.9, 10.2, 10.1, 9.7, 9.1, 8.6, 8.1, 7.8],
    [6.5, 7.5, 9.0, 12.8, 13.9, 13.9, 12.4, 10.9, 9.4, 8.0, 7.0, 6.0],
])
DC_HOURS = np.array([
    [6.4, 5.0, 2.4, 0.4, -1.6, -1.6, -1.6, -1.6, -1.6, 0.9, 3.8, 5.8],
    [1.39] * 12,
    [-1.6, -1.6, -1.6, 0.9, 3.8, 5.8, 6.4, 5.0, 2.4, 0.4, -1.6, -1.6],
])


def dmc_band(lat: np.ndarray) -> np.ndarray:
    return np.where(lat >= 30, 4, np.where(lat >= 15, 3, np.where(lat >= -15, 2, np.where(lat >= -30, 1, 0))))


def dc_band(lat: np.ndarray) -> np.ndarray:
    return np.where(lat >= 15, 2, np.where(lat >= -15, 1, 0))


def ffmc_step(f0, t, h, w, p):
    m = 147.2 * (101 - f0) / (59.5 + f0)
    r = np.maximum(p - 0.5, 1e-12)
    wet = m + 42.5 * r * np.exp(-100 / (251 - m)) * (1 - np.exp(-6.93 / r))
    wet = wet + np.where(m > 150, 0.0015 * (m - 150) ** 2 * np.sqrt(r), 0.0)
    m = np.where(p > 0.5, np.minimum(wet, 250), m)
    common = 0.18 * (21.1 - t) * (1 - np.exp(-0.115 * h))
    ed = 0.942 * h**0.679 + 11 * np.exp((h - 100) / 10) + common
    ew = 0.618 * h**0.753 + 10 * np.exp((h - 100) / 10) + common
    rate = lambda x: (0.424 * (1 - x**1.7) + 0.0694 * np.sqrt(w) * (1 - x**8)) * 0.581 * np.exp(0.0365 * t)
    drying = ed + (m - ed) * 10.0 ** -rate(h / 100)
    wetting = ew - (ew - m) * 10.0 ** -rate((100 - h) / 100)
    m = np.where(m > ed, drying, np.where((m < ed) & (m < ew), wetting, m))
    return np.clip(59.5 * (250 - m) / (147.2 + m), 0, 101)


def dmc_step(d0, t, h, p, hours):
    k = np.where(t < -1.1, 0.0, 1.894 * (t + 1.1) * (100 - h) * hours * 1e-4)
    rw = 0.92 * p - 1.27
    safe = np.maximum(d0, 1e-9)
    b = np.where(d0 <= 33, 100 / (0.5 + 0.3 * d0), np.where(d0 <= 65, 14 - 1.3 * np.log(safe), 6.2 * np.log(safe) - 17.2))
    wmr = 20 + 280 * np.exp(-0.023 * d0) + 1000 * rw / (48.77 + b * rw)
    wet = np.maximum(43.43 * (5.6348 - np.log(np.maximum(wmr - 20, 1e-9))), 0)
    return np.where(p > 1.5, wet, d0) + k


def dc_step(d0, t, p, hours):
    pe = np.maximum((0.36 * (np.maximum(t, -2.8) + 2.8) + hours) / 2, 0)
    wet = np.maximum(d0 - 400 * np.log(1 + 3.937 * (0.83 * p - 1.27) / (800 * np.exp(-d0 / 400))), 0)
    return np.where(p > 2.8, wet, d0) + pe


def behaviour(ffmc, dmc, dc, w):
    """isi, bui and fwi of the day. Where both moisture codes are zero, bui is zero and fwi follows from isi alone."""
    m = 147.2 * (101 - ffmc) / (59.5 + ffmc)
    isi = 19.1152 * np.exp(-0.1386 * m) * (1 + m**5.31 / 4.93e7) * np.exp(0.05039 * w)
    total = dmc + 0.4 * dc
    part = np.where(total > 0, 0.8 * dc / np.where(total > 0, total, 1), 0.0)
    bui = np.where(dmc <= 0.4 * dc, part * dmc, dmc - (1 - part) * (0.92 + (0.0114 * dmc) ** 1.7))
    bui = np.where(total > 0, np.maximum(bui, 0), 0.0)
    duff = np.where(bui <= 80, 0.626 * bui**0.809 + 2, 1000 / (25 + 108.64 * np.exp(-0.023 * bui)))
    b = 0.1 * isi * duff
    fwi = np.where(b <= 1, b, np.exp(2.72 * (0.434 * np.log(np.maximum(b, 1))) ** 0.647))
    return isi, bui, fwi


def walk(t, h, w, p, month, lat, start=START) -> dict[str, np.ndarray]:
    """Codes of days × cells: celsius, percent, km/h, mm. start: ffmc, dmc and dc before the first day, for all cells or for each. A day without all inputs has null codes and passes the codes of the day before on."""
    shape = t.shape
    out = {c: np.full(shape, np.nan) for c in CODES}
    f, d, c = (np.full(shape[1], x, float) for x in start)
    dmc_hours, dc_hours = DMC_HOURS[dmc_band(lat)], DC_HOURS[dc_band(lat)]
    each = np.arange(shape[1])
    with np.errstate(all="ignore"):
        for k in range(shape[0]):
            mon = month[k] - 1
            ok = np.isfinite(t[k]) & np.isfinite(h[k]) & np.isfinite(w[k]) & np.isfinite(p[k])
            f = np.where(ok, ffmc_step(f, t[k], h[k], w[k], p[k]), f)
            d = np.where(ok, dmc_step(d, t[k], h[k], p[k], dmc_hours[each, mon]), d)
            c = np.where(ok, dc_step(c, t[k], p[k], dc_hours[each, mon]), c)
            isi, bui, fwi = behaviour(f, d, c, w[k])
            for name, x in zip(CODES, (c, d, f, isi, bui, fwi)):
                out[name][k] = np.where(ok, x, np.nan)
    return out


def prepend_spinup(daily: DataFrame, keys: list[str], start: int | str) -> DataFrame:
    """Where a series has no day before the start year (a number, or a column of daily), its first year comes once more as the year before, without 29 February where that year has none.

    Years are those of the series' calendar (a column calendar); without one, a series that never has a 31st has months of 30 days."""
    begin = F.first(start) if isinstance(start, str) else F.lit(start)
    own = F.first("calendar", ignorenulls=True) if "calendar" in daily.columns else F.when(F.max("day") > 30, "standard").otherwise("360_day")
    first = daily.groupBy(*keys).agg(F.min("year").alias("_first"), begin.alias("_start"), own.alias("_calendar")).where(F.col("_first") >= F.col("_start"))
    copy = daily.join(first.drop("_start"), keys).where("year = _first").withColumn("year", F.col("year") - 1)
    calendar = calendars.known(F.col("_calendar"))
    gone = (F.col("month") == 2) & (F.col("day") == 29) & ~calendar.isin(calendars.THIRTY) & ~calendars.is_leap(calendar, F.col("year"))
    copy = copy.where(~gone).withColumn("day_idx", F.col("day_idx") - 366)
    return daily.unionByName(copy.select(*daily.columns))


def dense(pdf: pd.DataFrame, inputs: tuple[str, str, str, str], flux: bool, more: np.ndarray | tuple = ()) -> tuple:
    """(grid, month, lat, k, j, cells): inputs of a tile's rows as 4 × days × cells in the index's units, months of the days, latitudes and numbers of the cells (those of ``more`` too), and each row's day and cell."""
    days, k = np.unique(pdf["day_idx"].to_numpy(), return_inverse=True)
    own = pdf["cell_id"].to_numpy()
    cells = np.union1d(own, np.asarray(more, own.dtype))
    j = np.searchsorted(cells, own)
    grid = np.full((4, len(days), len(cells)), np.nan)
    for i, (name, scale, shift) in enumerate(zip(inputs, (1, 1, 3.6, 86400 if flux else 1), (-273.15, 0, 0, 0), strict=True)):
        grid[i, k, j] = pdf[name].to_numpy(dtype=float) * scale + shift
    month, lat = np.zeros(len(days), int), np.zeros(len(cells))
    month[k], lat[j] = pdf["month"].to_numpy(), pdf["lat"].to_numpy()
    return grid, month, lat, k, j, cells


def compute_fwi(
    daily: DataFrame, keys: list[str], temperature: str = "tasmax", humidity: str = "hurs", wind: str = "sfcWind", rain: str = "pr", codes: tuple[str, ...] = ("fwi",), start_year: int | None = None, flux: bool = True, state: DataFrame | None = None,
) -> DataFrame:
    """(keys, cell_id, lat, year, month, day_idx, codes) from kelvin, percent, m/s and kg m-2 s-1 (or mm a day: flux False).

    keys name a series and a tile of its cells: one task holds a tile's history, so choose tiles of some hundred cells. Spin-up
    years before start_year are computed and dropped. state: (keys, cell_id, ffmc, dmc, dc), the codes to go on from (see final_codes); cells
    that it lacks start anew.
    """
    cols, inputs = [*keys, "cell_id", "lat", "year", "month", "day_idx"], (temperature, humidity, wind, rain)
    schema = ", ".join([*(f"{c} {t}" for c, t in daily.select(*cols).dtypes), *(f"{c} double" for c in codes)])

    def tile(pdf: pd.DataFrame, before: pd.DataFrame | None = None) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame(columns=[*cols, *codes])
        pdf = pdf.sort_values(["day_idx", "cell_id"])
        grid, month, lat, k, j, cells = dense(pdf, inputs, flux, () if before is None else before["cell_id"].to_numpy())
        start = [np.full(len(cells), x, float) for x in START]
        if before is not None and len(before):
            at = np.searchsorted(cells, before["cell_id"].to_numpy())
            for s, c in zip(start, ("ffmc", "dmc", "dc"), strict=True):
                s[at] = before[c].to_numpy()
        found = walk(*grid, month, lat, start)
        return pdf[cols].assign(**{c: found[c][k, j] for c in codes})

    rows = daily.select(*cols, *inputs).groupBy(*keys)
    if state is None:
        out = rows.applyInPandas(lambda pdf: tile(pdf), schema)
    else:
        names = [*keys, "cell_id", "ffmc", "dmc", "dc"]
        out = rows.cogroup(state.select(*names).toDF(*names).groupBy(*keys)).applyInPandas(lambda pdf, before: tile(pdf, before), schema)
    for c in codes:  # a missing code is null, never NaN
        out = out.withColumn(c, F.when(~F.isnan(c), F.col(c)))
    return out.where(F.col("year") >= start_year) if start_year is not None else out


def final_codes(index: DataFrame, keys: list[str], before: DataFrame | None = None) -> DataFrame:
    """(keys, cell_id, ffmc, dmc, dc) after the last day that has codes; of cells without such a day those of ``before``. The index needs ffmc, dmc and dc."""
    last = index.where("ffmc IS NOT NULL").groupBy(*keys, "cell_id").agg(F.max_by(F.struct("ffmc", "dmc", "dc"), "day_idx").alias("_s")).select(*keys, "cell_id", "_s.*")
    if before is None:
        return last
    return last.unionByName(before.select(*last.columns).join(last, [*keys, "cell_id"], "left_anti"))
