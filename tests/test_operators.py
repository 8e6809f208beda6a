"""Hand-computed answers and invariants of the climate operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.functions import physics
from emberline.operators import attribution, classify, extremes, fwi, grid, overview, regions, season, stats
from emberline.sources import catalog, ingest


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()] if by else [tuple(r) for r in df.collect()]


def test_saturation_pressure_and_vpd(spark):
    r = spark.range(1).select(physics.es_sonntag(F.lit(293.15)), physics.vpd_from_rh(F.lit(293.15), F.lit(100.0)), physics.vpd_from_rh(F.lit(293.15), F.lit(110.0)), physics.vpd_from_rh(F.lit(293.15), F.lit(None).cast("double"))).first()
    assert r[0] == pytest.approx(2339.25, abs=0.01) and r[1] == 0 and r[2] == 0 and r[3] is None


def test_fwi_check_days():
    days = [(17, 42, 25, 0), (20, 21, 25, 2.4), (8.5, 40, 17, 0), (6.5, 25, 6, 0), (13, 34, 24, 0), (6, 40, 22, 0.4)]
    want = [(87.7, 8.5, 19.0, 10.9, 8.5, 10.1), (86.2, 10.4, 23.6, 8.8, 10.4, 9.3), (87.0, 11.8, 26.1, 6.5, 11.7, 7.6), (88.8, 13.2, 28.2, 4.9, 13.1, 6.2), (89.1, 15.4, 31.5, 12.6, 15.3, 14.8), (88.7, 16.5, 33.5, 10.7, 16.4, 13.5)]
    t, h, w, p = (np.array([[d[k]] for d in days], float) for k in range(4))
    got = fwi.walk(t, h, w, p, np.full(6, 4), np.array([45.0]))
    for k, expected in enumerate(want):
        assert [round(float(got[c][k, 0]), 1) for c in ("ffmc", "dmc", "dc", "isi", "bui", "fwi")] == list(expected)


def test_fwi_missing_day_carries_codes_and_zero_codes_give_zero_bui(spark):
    t = np.array([[17.0], [np.nan], [17.0]])
    h, w, p = (np.full((3, 1), x) for x in (42.0, 25.0, 0.0))
    got, two = fwi.walk(t, h, w, p, np.full(3, 4), np.array([45.0])), fwi.walk(t[[0, 2]], h[:2], w[:2], p[:2], np.full(2, 4), np.array([45.0]))
    assert np.isnan(got["fwi"][1, 0]) and got["fwi"][2, 0] == two["fwi"][1, 0]
    _, bui, index = fwi.behaviour(np.array([85.0]), np.array([0.0]), np.array([0.0]), np.array([10.0]))
    assert bui[0] == 0 and np.isfinite(index[0]) and index[0] > 0
    df = spark.createDataFrame([("s", 0, 1, 45.0, 2000, 4, d, 290.15, 42.0, 25 / 3.6, 0.0) for d in range(3)], "k string, tile int, cell_id long, lat double, year int, month int, day_idx int, tas double, hurs double, sfcWind double, pr double")
    out = fwi.compute_fwi(df, ["k", "tile"], temperature="tas").orderBy("day_idx").collect()
    assert round(out[0]["fwi"], 1) == 10.1


def test_spells_end_with_the_year_and_null_thresholds(spark):
    data = [(1, 2000 if d < 2 else 2001, d, 1.0) for d in range(5)] + [(2, 2000, d, 1.0) for d in range(2)]
    df = spark.createDataFrame(data, "cell_id long, year int, day_idx int, v double")
    thr = spark.createDataFrame([(1, 0.5), (2, None)], "cell_id long, threshold double")
    out = rows(extremes.yearly_metrics(extremes.with_threshold(df, thr, ["cell_id"]), "v", ["cell_id"], 2.0), "cell_id", "year")
    assert out == [(1, 2000, 2, 0, 2), (1, 2001, 3, 0, 3), (2, 2000, None, None, None)]


def test_missing_days_do_not_exceed_and_break_runs(spark):
    df = spark.createDataFrame([(1, 2000, d, v) for d, v in enumerate([1.0, 1.0, None, 1.0, 0.0])], "cell_id long, year int, day_idx int, v double").withColumn("threshold", F.lit(0.5))
    assert rows(extremes.yearly_metrics(df, "v", ["cell_id"])) == [(1, 2000, 3, 2)]


def test_pooled_quantile_is_linear_and_skips_nulls(spark):
    df = spark.createDataFrame([(1, v) for v in [1.0, 2.0, 3.0, 4.0, None]], "cell_id long, v double")
    assert extremes.pooled_quantile(df, "v", ["cell_id"], 0.5).first()[1] == 2.5


def test_fire_season_wraps_ties_and_nulls(spark):
    def start(values):
        df = spark.createDataFrame([(1, m + 1, None if v is None else float(v)) for m, v in enumerate(values)], "cell_id long, month int, v double")
        return [r["month"] for r in season.fire_season_mask(df, "v", ["cell_id"]).where("in_season").orderBy("month").collect()]

    assert start([5, 4, 0, 0, 0, 0, 0, 0, 0, 0, 0, 6]) == [1, 2, 12]
    assert start([1] * 12) == [1, 2, 3]
    assert start([None] + [1.0] * 11) == [2, 3, 4]
    assert start([None, 1.0, 1.0] * 4) == []


def test_seasonal_mean_counts_days_of_null_months(spark):
    m = spark.createDataFrame([(1, 1, 2.0), (1, 2, None), (1, 3, 9.0)], "cell_id long, month int, v double")
    mask = spark.createDataFrame([(1, 1, True), (1, 2, True), (1, 3, False)], "cell_id long, month int, in_season boolean")
    assert season.seasonal_mean(m, mask, "v", ["cell_id"], ["cell_id"]).first()["v"] == pytest.approx(62 / 59.25)


def test_smooth_doy_is_cyclic(spark):
    df = spark.createDataFrame([(1, d, 1.0 if d == 1 else 0.0) for d in range(1, 361)], "cell_id long, doy int, v double")
    out = {r["doy"]: r["v"] for r in season.smooth_doy(df, "v", ["cell_id"]).collect()}
    assert out[1] == out[16] == out[360] == out[346] == pytest.approx(1 / 31) and out[17] == out[345] == 0 and len(out) == 360


def test_welch_and_tail(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4)] + [("b", float(v)) for v in (2, 4, 6, 8, 10)], "k string, v double").withColumn("cell", F.lit(1))
    of = lambda k: stats.moments(df.where(F.col("k") == k), "v", ["cell"])
    r = stats.welch(of("a"), of("b"), ["cell"]).first()
    assert r["t"] == pytest.approx(-3.5 / np.sqrt(5 / 3 / 4 + 2)) and r["df"] == pytest.approx(5.5207, abs=1e-3)
    assert r["pvalue"] == pytest.approx(0.0700, abs=2e-3)
    same = spark.createDataFrame([(1, 5.0)] * 3, "cell int, v double")
    assert stats.welch(stats.moments(same, "v", ["cell"]), stats.moments(same, "v", ["cell"]), ["cell"]).first()["pvalue"] == 1.0
    assert stats.t_tail(np.array([0.0, 1.0, 12.706]), np.array([5.0, 1.0, 1.0])) == pytest.approx([1.0, 0.5, 0.05], abs=1e-4)


def test_fdr(spark):
    df = spark.createDataFrame([("m", 0.01), ("m", 0.02), ("m", 0.03), ("m", 0.5), ("m", None), ("n", 0.9)], "map string, pvalue double")
    out = {(r[0], r[1]): r["significant"] for r in stats.fdr_significant(df, ["map"]).collect()}
    assert [out["m", p] for p in (0.01, 0.02, 0.03, 0.5, None)] == [True, True, True, False, False] and not out["n", 0.9]
    masked = stats.fdr_significant(df.withColumn("land", F.col("pvalue") > 0.015), ["map"], mask=F.col("land")).where("significant").collect()
    assert sorted(r["pvalue"] for r in masked) == [0.02, 0.03]


def test_multimodel_needs_all_models(spark):
    df = spark.createDataFrame([(1, 1.0, True), (1, 2.0, False), (1, None, None), (2, 1.0, True)], "cell_id long, delta double, significant boolean")
    out = rows(stats.multimodel(df, ["cell_id"]), "cell_id")
    assert out == [(1, 1.5, 3, False), (2, 1.0, 1, True)]


def test_offset_classes_partition(spark):
    cases = [(-1.0, 1.0, 0.0, 1), (-1.0, -1.0, -1.0, 2), (-1.0, -1.0, 1.0, 3), (1.0, -1.0, 0.0, 4), (0.0, 0.0, 0.0, 5), (None, 1.0, 1.0, None), (1.0, None, 1.0, None), (-1.0, -1.0, None, None)]
    df = spark.createDataFrame(cases, "v double, p double, f double, want int")
    got = df.select("want", classify.classify_offset(F.col("v"), F.col("p"), F.col("f")).alias("k"), classify.classify_offset(F.col("v"), F.col("p")).alias("merged")).collect()
    assert all(r["want"] == r["k"] for r in got) and [r["merged"] for r in got][:5] == [1, 2, 2, 4, 5]


def test_unit_rules(spark):
    long = spark.createDataFrame(
        [("tas", "K", 20.0), ("hurs", "fraction", 55.0), ("hursmin", "%", 0.5), ("pr", "m s-1", 1e-7), ("sfcWind", "W m-2", 5.0), ("uas", "km h-1", 36.0), ("ps", "Pa", 1000.0), ("huss", "g kg-1", 8.0)],
        "var string, units string, value double",
    ).withColumns({"model": F.lit("m"), "scenario": F.lit("s"), "member": F.lit("r1"), "day_idx": F.lit(1)})
    fills = long.where("var = 'hursmin'").withColumn("value", F.lit(1e20))
    out = {(r["var"], r["value"]) for r in ingest.convert_units(long.unionByName(fills)).collect()}
    near = {v: x for v, x in out if x is not None}
    assert near["tas"] == pytest.approx(293.15) and near["hurs"] == 55 and near["hursmin"] == 50 and ("hursmin", None) in out
    assert near["pr"] == pytest.approx(1e-4) and ("sfcWind", None) in out and near["uas"] == pytest.approx(10) and near["ps"] == 100000 and near["huss"] == pytest.approx(0.008)


def test_overlapping_files_keep_whole_days_of_the_first(spark):
    df = spark.createDataFrame([(0, 1, 1, 1.0), (1, 1, 1, 9.0), (1, 1, 2, 9.0), (1, 2, 1, 3.0)], "file_seq int, day_idx int, cell_id long, value double").withColumns({k: F.lit("x") for k in ingest.SERIES})
    assert sorted((r["day_idx"], r["cell_id"], r["value"]) for r in ingest.dedupe_days(df).collect()) == [(1, 1, 1.0), (2, 1, 3.0)]


def test_end_stamps_move_back(spark):
    days = [(1 if d < 30 else 3, d + 2, 0, d + 1, False) for d in range(301)]
    df = spark.createDataFrame(days, "month int, day int, hour int, day_idx int, has_bounds boolean").withColumns({k: F.lit("x") for k in ingest.SERIES})
    assert ingest.shift_end_stamps(df).agg(F.min("day_idx")).first()[0] == 0
    assert ingest.shift_end_stamps(df.withColumn("has_bounds", F.lit(True))).agg(F.min("day_idx")).first()[0] == 1


def test_paths_by_the_most_specific_segment(spark):
    paths = [
        "root/CESM2-WACCM/SSP245/r1/DAY/b.e21.BSSP245.f09.001.cam.h1.TREFHTMX.20190101-20231231.nc",
        "root/E3SM/G6-1.5K-HiLLA/v3.LR.ssp245_0201.x/day/tas/E3SM_tas.nc",
        "root/MIROC-ES2H/G6-1.5K-SAI/r2/3hr/pr_3hr.nc",
        "x",
    ]
    out = [tuple(r)[1:] for r in catalog.classify_paths(spark.createDataFrame([(p,) for p in paths], "path string")).collect()]
    assert out[0] == ("CESM2-WACCM", "ssp245", "r1", "tasmax", "TREFHTMX", "day", 2019, 2023, "atm")
    assert out[1][:4] == ("E3SMv3", "ssp245", "r3", "tas") and out[2][5] == "subdaily" and out[3][0] == "?" and out[3][1] == "?"


def test_known_issues(spark):
    cat = spark.createDataFrame([("MIROC-ES2H", "ssp245", "r1", "sfcWind", "netcdf", ["a/day/x.nc"], "sfcWind"), ("M", "ssp245", "r1", "tas", "netcdf", ["a/clm2/x.nc"], "tas"), ("M", "ssp245", "r1", "pr", "netcdf", ["a/x.nc", "a/LDAY/x.nc"], "pr")], "model string, scenario string, member string, var string, kind string, paths array<string>, var_name string")
    out = {(r["model"], r["var"]): (r["kind"], r["paths"]) for r in catalog.apply_known_issues(cat).collect()}
    assert out == {("MIROC-ES2H", "sfcWind"): ("wind_climatology", None), ("M", "pr"): ("netcdf", ["a/x.nc"])}


def test_resolve_variable_order(spark):
    f = spark.createDataFrame([("f1", "TREFHT", "tas", None, None, None, 2), ("f1", "odd", "tas", None, "air_temperature", "time: mean", 2), ("f2", "a", "tasmax", None, "air_temperature", "time: maximum", 2), ("f2", "b", "tasmax", None, "air_temperature", "time: mean", 2), ("f3", "z", "pr", None, None, None, 1), ("f4", "z", "pr", None, None, None, 2)], "file string, var_name string, canon string, explicit string, standard_name string, cell_methods string, n_fields int")
    assert rows(ingest.resolve_variable(f, ["file"]), "file") == [("f1", "tas", "TREFHT"), ("f2", "tasmax", "a"), ("f3", "pr", "z")]


def test_snap_grid(spark):
    ref = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0)], "cell_id long, lat double, lon double")
    near = ref.withColumn("lat", F.col("lat") + 0.001)
    assert rows(grid.snap_grid(near, ref), "cell_id") == [(1, 0.0, 0.0), (2, 1.0, 0.0)]
    with pytest.raises(ValueError):
        grid.snap_grid(ref.withColumn("lat", F.col("lat") + 0.5), ref)


def test_common_grid_is_periodic_and_fills_caps(spark):
    cells = spark.createDataFrame([(i * 4 + j, lat, -135.0 + 90 * j) for i, lat in enumerate((-45.0, 45.0)) for j in range(4)], "cell_id long, lat double, lon double")
    field = cells.select("cell_id", F.col("lat").alias("v"), (F.col("lat") > 0).alias("b"))
    out = {(r["lat"], r["lon"]): (r["v"], r["b"]) for r in grid.to_common_grid(field, cells, ["v", "b"], [], 30.0).join(grid.common_grid(spark, 30.0).withColumnRenamed("target_id", "cell_id"), "cell_id").collect()}
    assert len(out) == 72 and out[75.0, -165.0] == (45.0, True) and out[-75.0, 165.0] == (-45.0, False) and out[15.0, 165.0][0] == pytest.approx(15.0)
    box = cells.where("lon < 0")
    assert grid.to_common_grid(field.join(box, "cell_id", "left_semi"), box, ["v"], [], 30.0).count() < 72


def test_doy_lookup_takes_the_nearest(spark):
    clim = spark.createDataFrame([(1, d, float(d)) for d in range(1, 361)], "cell_id long, doy int, w double")
    days = spark.createDataFrame([(1, 366), (1, 10)], "cell_id long, doy int")
    assert rows(grid.lookup_doy(days, clim, ["cell_id"], ["w"]), "doy") == [(1, 10, 10.0), (1, 366, 360.0)]


def test_doy_lookup_makes_no_days_between(spark):
    present = [(1, 10, 1.0), (1, 21, 2.0), (1, 30, None), (2, 366, 3.0), (3, 0, 9.0), (None, 5, 9.0)]
    clim = spark.createDataFrame(present, "cell_id long, doy int, w double")
    asked = [(c, d) for c in (1, 2, 3, None) for d in (None, 0, 1, 10, 15, 16, 25, 26, 366, 367)]
    days = spark.createDataFrame([(d, c, k) for k, (c, d) in enumerate(asked + asked[:5])], "doy int, cell_id long, k int")
    out = grid.lookup_doy(days, clim, ["cell_id"], ["w"])
    assert out.columns == ["cell_id", "doy", "k", "w"] and out.schema["doy"].dataType == days.schema["doy"].dataType
    own = lambda c, d: [(abs(d - x), x, w) for i, x, w in present if i == c and c in (1, 2)] if d is not None and 1 <= d <= 366 else []
    want = [(c, d, k, min(own(c, d), key=lambda v: v[:2])[2] if own(c, d) else None) for k, (c, d) in enumerate(asked + asked[:5])]
    assert sorted(map(tuple, out.collect()), key=lambda r: r[2]) == want
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()  # 366 rows for each key


def test_region_in_two_polygons_and_land(spark):
    cells = spark.createDataFrame([(1, 10.0, 10.0), (2, -70.0, 10.0), (3, 50.0, 50.0)], "cell_id long, lat double, lon double")
    ring = lambda lo, hi: [(lo, lo), (hi, lo), (hi, hi), (lo, hi)]
    poly = spark.createDataFrame([("A", "a", ring(0.0, 20.0)), ("B", "b", ring(5.0, 30.0)), ("GIC", "ice", ring(40.0, 60.0))], "region string, region_name string, ring array<struct<lon double, lat double>>")
    bridge = regions.assign_regions(cells, poly)
    assert rows(bridge.select("cell_id", "region"), "cell_id", "region") == [(1, "A"), (1, "B"), (3, "GIC")]
    assert rows(regions.land_mask(cells, bridge).select("cell_id", "land"), "cell_id") == [(1, True), (2, False), (3, False)]


def test_regional_mean_drops_null_cells_from_the_weight(spark):
    cells = spark.createDataFrame([(1, 0.0, True), (2, 60.0, True), (3, 0.0, False)], "cell_id long, lat double, land boolean")
    bridge = spark.createDataFrame([(i, "A", "a") for i in (1, 2, 3)], "cell_id long, region string, region_name string")
    f = spark.createDataFrame([(1, 1.0, None), (2, 4.0, 3.0), (3, 99.0, 99.0)], "cell_id long, v double, w double")
    r = regions.regional_means(f, bridge, cells, ["v", "w"], []).first()
    assert r["v"] == pytest.approx(2.0) and r["w"] == pytest.approx(3.0)


def test_spatial_mean_is_two_staged(spark):
    f = spark.createDataFrame([(0.0, 1.0), (0.0, 3.0), (60.0, 8.0), (60.0, None)], "lat double, v double").withColumn("k", F.lit(1))
    assert regions.spatial_mean(f, "v", ["k"], (-90, 90)).first()["v"] == pytest.approx((2 + 8 * 0.5) / 1.5)


def test_spinup_drops_29_february(spark):
    df = spark.createDataFrame([("s", 2020, 2, 28, 1), ("s", 2020, 2, 29, 2), ("s", 2020, 3, 31, 3)], "k string, year int, month int, day int, day_idx int")
    out = rows(fwi.prepend_spinup(df, ["k"], 2020).where("year = 2019").select("month", "day"), "month")
    assert out == [(2, 28), (3, 31)] and fwi.prepend_spinup(df, ["k"], 2021).count() == 3


def test_vpd_terms_add_up_and_ratio_limits(spark):
    a = spark.createDataFrame([(1, 1, 300.0, 50.0, 5e-5)], "cell_id long, month int, tas double, hurs double, pr double")
    b = spark.createDataFrame([(1, 1, 295.0, 60.0, 1e-6)], "cell_id long, month int, tas double, hurs double, pr double")
    r = attribution.vpd_decomposition(a, b, ["cell_id"]).first()
    assert r["t_term"] > 0 and r["rh_term"] > 0 and r["total"] == pytest.approx(r["t_term"] + r["rh_term"] + r["residual"])
    assert attribution.climatological_deltas(a, b, ["tas", "pr"], ["cell_id"]).first()["pr"] == 5.0


def test_injection_window_is_open_at_its_start(spark):
    t = spark.createDataFrame([("M", s, "r1", y, v) for s, k in (("A", 1.0), ("B", 2.0)) for y, v in ((2034, 99.0), (2035, 99.0), (2036, 2 * k), (2037, 4 * k))], "model string, scenario string, member string, year int, so2_tg double")
    assert rows(overview.injection_efficiency(t, (2035, 2037), "A", "B")) == [("M", 3.0, 6.0, 0.5, 0.5)]


def test_staged_tables_are_reused(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for k in (1, 1, 2):
        assert ingest.cached(spark, make, f"{tmp_path}/t", years=k).count() == 3
    assert len(made) == 2


def test_calendars_against_python(spark):
    """Every day of some years, leap and century years among them, by counting; and offsets from a reference date."""
    import datetime

    from emberline.functions import calendars

    lengths = {"standard": None, "noleap": [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31], "all_leap": [31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31], "360_day": [30] * 12}
    want = {}
    for name, months in lengths.items():
        if months is None:
            first = datetime.date(1899, 1, 1)
            for k in range(3 * 366 + 1):
                d = first + datetime.timedelta(k)
                want[name, (d - datetime.date(1970, 1, 1)).days] = (d.year, d.month, d.day, d.timetuple().tm_yday)
        else:
            for y in (1968, 1969, 1970, 2000, 2100):
                n = (y - 1970) * sum(months)
                for doy, (m, d) in enumerate(((m, d) for m in range(1, 13) for d in range(1, months[m - 1] + 1)), 1):
                    want[name, n + doy - 1] = (y, m, d, doy)
    df = spark.createDataFrame([(c, n) for c, n in want], "calendar string, n int")
    out = calendars.decode_days(df, F.col("n") + 0.75)
    back = calendars.day_number(F.col("calendar"), F.col("year"), F.col("month"), F.col("day"))
    assert {(r["calendar"], r["n"]): (r["year"], r["month"], r["day"], r["doy"]) for r in out.collect()} == want and out.where(back != F.col("n")).count() == 0
    since = spark.createDataFrame([("360_day", 30.5, "1850-02-30 12:00:00"), ("noleap", 59.0, "2000-01-01"), (None, 59.0, "2000-01-01"), ("365_day", None, "2000-01-01")], "calendar string, x double, since string")
    assert [tuple(r) for r in calendars.decode_days(since, F.col("x"), F.col("since")).select("year", "month", "day").collect()] == [(1850, 4, 1), (2000, 3, 1), (2000, 2, 29), (None, None, None)]
    with pytest.raises(Exception, match="unknown calendar mayan"):
        calendars.decode_days(since.withColumn("calendar", F.lit("Mayan")), F.col("x")).collect()


def test_spin_up_in_calendars(spark):
    """The copied year has the days that the year before has in the series' calendar."""
    rows = [(c, 2020, m, d, 0) for c in ("standard", "noleap", "all_leap", "360_day") for m, d in ((2, 28), (2, 29), (2, 30), (12, 30)) if not (d == 30 and m == 2 and c != "360_day") and not (d == 29 and c == "noleap")]
    df = spark.createDataFrame(rows, "calendar string, year int, month int, day int, day_idx int")
    out = fwi.prepend_spinup(df.withColumn("series", F.col("calendar")), ["series"], 2020).where("year = 2019").groupBy("series").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r["series"]: r["n"] for r in out} == {"standard": 2, "noleap": 2, "all_leap": 3, "360_day": 4}


def test_selection_equals_percentile_to_the_bit(spark):
    """One key with most rows, one with a single row, equal values, extremes of the range, nulls; in few bins, so that several rounds run."""
    import random

    rng = random.Random(0)
    rows = [("a", rng.gauss(0, 1) * 10 ** rng.randint(-3, 3)) for _ in range(5000)] + [("b", 7.0)] + [("c", 2.5)] * 400 + [("d", x) for x in (-1e308, 1e308, 0.0, 1.0)] + [("e", None)] + [("f", 1.0)] * 300 + [("f", 2.0)] * 200
    df = spark.createDataFrame(rows, "k string, v double")
    for q in (0.0, 0.5, 0.95, 1.0):
        want = {r["k"]: r["threshold"] for r in extremes.pooled_quantile(df, "v", ["k"], q, single=False).collect()}
        got = {r["k"]: r["threshold"] for r in extremes.selected_quantile(df, "v", ["k"], q, bins=4, held=5).collect()}
        assert want.pop("e") is None and got == want
    assert extremes.selected_quantile(df.where("k = 'none'"), "v", ["k"]).count() == 0


def test_nearest_points_against_all(spark):
    """Clusters, a lone source on the other side, poles, the dateline, and points without a place."""
    import math
    import random

    rng = random.Random(2)
    source = [(k, rng.gauss(10, 0.5), rng.gauss(179.9, 0.5)) for k in range(200)] + [(500, -60.0, 20.0), (501, 89.9, 0.0), (502, None, 1.0)]
    target = [(k, rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(300)] + [(900, 90.0, 77.0), (901, 10.0, -179.9), (902, 10.0, None)]
    unit = lambda lat, lon: (math.cos(math.radians(lat)) * math.cos(math.radians(lon)), math.cos(math.radians(lat)) * math.sin(math.radians(lon)), math.sin(math.radians(lat)))
    want = {t: min((math.dist(unit(a, b), unit(x, y)), c) for c, x, y in source if x is not None)[1] for t, a, b in target if b is not None}
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, lat double, lon double")
    for start in (None, 0.01):
        got = grid.nearest_points(frame(source, "cell_id"), frame(target, "target_id"), start).collect()
        assert {r["target_id"]: r["cell_id"] for r in got} == want and len(got) == len(want)
    assert grid.nearest_points(frame(source, "cell_id").limit(0), frame(target, "target_id")).count() == 0
