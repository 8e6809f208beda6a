"""Listing, catalogs, ingest, sinks and logs that no query covers."""

import pytest
from pyspark.sql import functions as F

from emberline.operators import grid, overview, regions, stats
from emberline.sources import catalog, ingest


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_listing_and_variables(spark, tmp_path):
    for name in ("a/tas_day.nc", "a/b/hurs_day.nc4", "a/readme.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x" * 5)
    listing = catalog.list_archive(spark, str(tmp_path))
    assert {(r["path"].rsplit("/", 1)[1], r["length"]) for r in listing.collect()} == {("tas_day.nc", 5), ("hurs_day.nc4", 5)}
    assert rows(catalog.find_variables(listing, {"tas": "tas_", "pr": "pr_"})) == [("pr", 0), ("tas", 1)]


def test_probe_frequency_takes_one_file(spark):
    stamps = [("m", "a", float(d)) for d in range(60)] + [("m", "b", d * 30.0) for d in range(5)] + [("n", "c", d / 4) for d in range(9)] + [("o", "d", d * 30.0) for d in range(5)] + [("p", "e", 1.0)]
    got = catalog.probe_frequency(spark.createDataFrame(stamps, "model string, path string, t double"), ["model"])
    assert rows(got.select("model", "freq")) == [("m", "day"), ("n", "subdaily"), ("o", "mon"), ("p", "unknown")]


def test_overlay_and_stores(spark):
    ddl = "model string, scenario string, member string, var string, kind string, paths array<string>, var_name string"
    base = spark.createDataFrame([("A", "s", "r1", "tas", "netcdf", ["x"], "tas"), ("A", "s", "r1", "pr", "netcdf", ["y"], "pr")], ddl)
    docs = spark.createDataFrame([('{"A": {"s": {"r1": {"tas": {"kind": "zarr", "store": "s3://b", "group": "g"}, "_note": null}}}, "_c": null}',)], "json string")
    over = catalog.load_catalog(docs)
    assert rows(over.select("model", "var", "kind", "store", "group")) == [("A", "tas", "zarr", "s3://b", "g")]
    assert rows(catalog.overlay_catalog(base, over).select("var", "kind", "store").fillna("")) == [("pr", "netcdf", ""), ("tas", "zarr", "s3://b")]
    assert rows(catalog.merge_catalog(base, over).select("var", "kind")) == [("pr", "netcdf"), ("tas", "netcdf")]
    again = catalog.load_catalog(catalog.save_catalog(over))
    assert rows(again.select("store", "group")) == [("s3://b", "g")]


def test_external_catalog(spark):
    stores = spark.createDataFrame([("A", "tas", "r1", "s1"), ("A", "tas", "r1", "s2"), ("B", "tas", "r1", "s3"), ("A", "pr", "r2", "s4")], "model string, var string, member string, store string")
    assert rows(catalog.query_catalog(stores, model=["A"], var=["tas", "pr"])) == [("A", "pr", "r2", "s4"), ("A", "tas", "r1", "s2")]
    assert rows(catalog.describe_stores(stores, ["model"])) == [("A", 3, 2, 2, 3), ("B", 1, 1, 1, 1)]


def test_coordinates(spark):
    df = spark.createDataFrame([(1.0, 10.0, 3, 2.0, float("nan")), (2.0, 5.0, 4, 2.0, 1.0)], "nav_lat double, longitude double, t int, height double, v double")
    got = ingest.drop_singletons(ingest.harmonize_columns(df), ["height", "none"])
    assert got.columns == ["lat", "lon", "time", "v"] and {r[0] for r in got.select("v").collect()} == {None, 1.0}
    points = spark.createDataFrame([(lat, lon) for lat in (30.0, -10.0, 5.0) for lon in (20.0, 10.0)] * 2, "lat double, lon double")
    assert rows(ingest.number_cells(points)) == [(0, -10.0, 10.0), (1, -10.0, 20.0), (2, 5.0, 10.0), (3, 5.0, 20.0), (4, 30.0, 10.0), (5, 30.0, 20.0)]
    labels = spark.createDataFrame([(10.0, 11.0, 11.0), (None, None, 7.9)], "lo double, hi double, at double")
    assert sorted(r[0] for r in labels.select(ingest.label_day(F.col("lo"), F.col("hi"), F.col("at"))).collect()) == [7, 10]


def test_cube_and_stages(spark, tmp_path):
    ddl = "model string, scenario string, member string, tile int, cell_id long, lat double, lon double, year int, day_idx int, tas double"
    cube = spark.createDataFrame([("A", "s", f"r{k}", c // 2, c, c * 10.0, 0.0, 2020 + d // 3, d, float(d)) for k in (1, 2) for c in range(4) for d in range(6)], ddl)
    path = str(tmp_path / "cube")
    ingest.write_cube(cube, path)
    got = ingest.read_daily(spark, path, (2021, 2021), (-1, 1, 0, 15), member=["r1"])
    assert sorted((r["cell_id"], r["day_idx"]) for r in got.collect()) == [(c, d) for c in (0, 1) for d in (3, 4, 5)]
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(member" in plan or "(member" in plan.split("PartitionFilters")[1][:80]
    keys = ["model", "scenario", "member", "cell_id", "day_idx"]
    late = lambda: cube.where("day_idx < 5").select(*keys, (F.col("tas") * 2).alias("pr"))
    both = ingest.stage_inputs(spark, lambda: cube, str(tmp_path / "s"), keys, late, years=1)
    assert both.count() == 40 and "pr" in both.columns
    with pytest.raises(ValueError, match="3 days"):
        ingest.stage_inputs(spark, lambda: cube, str(tmp_path / "t"), keys, lambda: late().where("day_idx < 3"), years=1)
    sample = ingest.extract_sample(cube, {"a": ("s", 2020, 2020), "b": ("s", 2021, 2021)}, ["r2"], (-1, 1, 0, 5))
    assert rows(sample.select("run", "member", "cell_id", "day_idx", "day_index")) == [("a", "r2", 0, d, d) for d in range(3)] + [("b", "r2", 0, d, d - 3) for d in range(3, 6)]


def test_sinks_and_logs(spark, tmp_path):
    df = ingest.bool_to_tinyint(spark.createDataFrame([("a", True, 1), ("b", None, 2)], "k string, f boolean, n int"))
    assert dict(df.dtypes) == {"k": "string", "f": "tinyint", "n": "int"}
    ingest.write_csv(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
    (tmp_path / "log.txt").write_text("1.5 2\n2.5 3\n")
    assert rows(ingest.read_injection(spark, str(tmp_path / "log.txt"), ["north", "south"], " ", False, 2035).select("year", "north", "south")) == [(2035, 1.5, 2.0), (2036, 2.5, 3.0)]
    (tmp_path / "log.csv").write_text("year,a\n2035,1\n2036,x\n")
    log = lambda *ys: spark.createDataFrame([(y, float(y)) for y in ys], "year int, so2 double")
    assert rows(overview.merge_logs({"r1": log(2035, 2036), "r2": log(2036, 2037)}, "so2").fillna(-1.0)) == [(2035, 2035.0, -1.0), (2036, 2036.0, 2036.0), (2037, -1.0, 2037.0)]


def test_result_sanity(spark):
    yearly = spark.createDataFrame([("A", "target", 18.0, 0.0, 90.0), ("A", "target", 18.5, 1.0, 80.0), ("B", "target", 40.0, 0.0, 300.0)], "model string, run string, days_p95 double, index_min double, index_max double")
    assert rows(ingest.check_results(yearly).select("model", "ok")) == [("A", True), ("B", False)]


def test_staggered_components_meet_at_centres(spark):
    lat, lon = (0.0, 10.0, 20.0), (0.0, 20.0, 40.0)
    u_cells = spark.createDataFrame([(i * 4 + j, x, y) for i, x in enumerate(lat) for j, y in enumerate((-10.0, 10.0, 30.0, 50.0))], "cell_id long, lat double, lon double")
    v_cells = spark.createDataFrame([(i * 3 + j, x, y) for i, x in enumerate((-5.0, 5.0, 15.0, 25.0)) for j, y in enumerate(lon)], "cell_id long, lat double, lon double")
    # Fields that are linear in place come back exactly.
    u = u_cells.select(F.lit(1).alias("day_idx"), "cell_id", (F.col("lat") + 2 * F.col("lon")).alias("uas"))
    v = v_cells.select(F.lit(1).alias("day_idx"), "cell_id", (F.col("lat") - F.col("lon")).alias("vas"))
    got = rows(grid.uv_to_centres(u, v, u_cells, v_cells, ["day_idx"]).select("cell_id", "uas", "vas"))
    assert got == [(i * 3 + j, x + 2 * y, x - y) for i, x in enumerate(lat) for j, y in enumerate(lon)]


def test_tiles_of_any_size(spark):
    square = lambda x: [(x, 0.0), (x + 10, 0.0), (x + 10, 10.0), (x, 10.0)]
    polygons = spark.createDataFrame([("a", "A", square(0.0)), ("b", "B", square(5.0)), ("b", "B", square(40.0))], "region string, region_name string, ring array<struct<lon double, lat double>>")
    cells = spark.createDataFrame([(i, 5.0, i * 3.0 + 1) for i in range(18)], "cell_id long, lat double, lon double")
    want = sorted([(i, "a", "A") for i in range(18) if i * 3 + 1 < 10] + [(i, "b", "B") for i in range(18) if 5 < i * 3 + 1 < 15 or 40 <= i * 3 + 1 < 50])
    assert rows(regions.assign_regions(cells, polygons)) == want
    assert rows(regions.assign_regions(cells, polygons, 90.0)) == want and rows(regions.assign_regions(cells, polygons, 0.5)) == want


def test_ensemble_delta_needs_maps(spark):
    with pytest.raises(ValueError):
        stats.ensemble_delta(None, "v", ["cell_id"], "a", "b", map_keys=())


def test_inputs_that_lack_wind_and_humidity(spark):
    from emberline.jobs import tasks

    ddl = "model string, cell_id long, month int, doy int, tas double, sfcWind float, uas double, vas double, huss double, ps double"
    daily = spark.createDataFrame([("A", 0, 1, d, 290.0, None, 3.0, 4.0, 0.01, 1e5) for d in (1, 2)] + [("B", 0, 1, 5, 290.0, None, 3.0, 4.0, 0.01, 1e5)], ddl)
    ratio = spark.createDataFrame([("A", 0, 1, 1.2)], "model string, cell_id long, month int, ratio double")
    clim = spark.createDataFrame([("B", 0, 4, 7.0), ("B", 0, 200, 9.0)], "model string, cell_id long, doy int, sfcWind double")
    got = tasks.complete_inputs(daily, ratio, clim).collect()
    assert {(r["model"], round(r["sfcWind"], 4)) for r in got} == {("A", 6.0), ("B", 7.0)} and all(70 < r["hurs"] < 100 for r in got)


def test_polygons_against_all_edges(spark):
    """Random stars with holes, some across 180°, on tiles of two sizes, against a plain test of every edge of every ring."""
    import math
    import random

    rng = random.Random(3)

    def star(x, y, r, n):
        return [(x + r * rng.uniform(0.3, 1) * math.cos(2 * math.pi * k / n), max(-89.0, min(89.0, y + r * rng.uniform(0.3, 1) * math.sin(2 * math.pi * k / n)))) for k in range(n)]

    shapes = [(f"R{k}", [star(x, y, r, 9), star(x, y, r / 4, 5), star(x + 2 * r, y, r / 3, 4)]) for k, (x, y, r) in enumerate([(10, 10, 30), (175, -20, 25), (-178, 60, 20), (0, 0, 5), (200, 30, 12)])]
    place = [(k, rng.uniform(-89, 89), rng.uniform(-180, 180)) for k in range(1500)] + [(9000, None, 1.0), (9001, 10.0, 350.0), (9002, 10.0, -10.0)]

    def within(rings, lat, lon):
        n = 0
        for turn in (-360, 0, 360):
            for ring in rings:
                for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
                    n += (y1 > lat) != (y2 > lat) and lon + turn < x1 + (lat - y1) / (y2 - y1) * (x2 - x1)
        return n % 2 == 1

    want = {(c, name) for c, lat, lon in place if lat is not None for name, rings in shapes if within(rings, lat, lon)}
    short = lambda x: (x + 180) % 360 - 180
    given = [(name, name, [[(short(x), y) for x, y in ring] for ring in rings], True) for name, rings in shapes]
    polygons = spark.createDataFrame(given + given[:1], "region string, region_name string, rings array<array<struct<lon double, lat double>>>, wraps boolean")
    cells = spark.createDataFrame(place, "cell_id long, lat double, lon double")
    for tile in (1.0, 10.0):
        assert {(r["cell_id"], r["region"]) for r in regions.assign_regions(cells, polygons, tile).collect()} == want
    assert regions.assign_regions(cells, polygons.where("region = 'none'")).count() == 0
    with pytest.raises(ValueError):
        regions.assign_regions(cells, polygons, 7.0)


def test_many_files_first_wins(spark, tmp_path):
    """Overlapping files of a series, a folder of parts, a further column in one, days without a number."""
    ddl = "model string, scenario string, member string, var string, year int, day_idx int, cell_id long, value double"
    row = lambda d, v, c=0, y=2020: ("m", "s", "r1", "tas", y, d, c, v)
    spark.createDataFrame([row(1, 1.0), row(2, 1.0), row(2, 1.5, 1)], ddl).coalesce(1).write.parquet(f"{tmp_path}/b")
    spark.createDataFrame([row(2, 2.0), row(3, 2.0), row(None, 9.0)], ddl).repartition(3).write.parquet(f"{tmp_path}/a1")
    spark.createDataFrame([row(3, 3.0), row(4, 3.0), row(400, 3.0, y=2021)], ddl).withColumn("note", F.lit("x")).coalesce(1).write.parquet(f"{tmp_path}/a2")
    got = ingest.read_files(spark, [f"{tmp_path}/b", f"{tmp_path}/a*"], years=(2020, 2020))
    assert rows(got.select("day_idx", "cell_id", "value", "file_seq")) == [(1, 0, 1.0, 0), (2, 0, 1.0, 0), (2, 1, 1.5, 0), (3, 0, 2.0, 1), (4, 0, 3.0, 2)] and "note" in got.columns
    report = ingest.time_report(spark.read.parquet(f"{tmp_path}/a1")).first()
    assert (report["rows"], report["bad"], report["days"]) == (3, 1, 2)
    with pytest.raises(ValueError, match="no file"):
        ingest.read_files(spark, [f"{tmp_path}/none*"])


def test_rain_report(spark):
    days = [(m, "s", "r", "pr", u, d, v) for m, u, v in (("ok", "kg m-2 s-1", 3e-5), ("mm", "mm/day", 4.0), ("big", "kg m-2 s-1", 4.0), ("odd", "inch", 1e-5), ("none", None, 5.0)) for d in range(40)]
    got = ingest.rain_report(spark.createDataFrame(days, "model string, scenario string, member string, var string, units string, day_idx int, value double")).collect()
    assert {r["model"]: r["note"] for r in got} == {"ok": "", "mm": "", "big": "mean too large, check units", "odd": "unknown units, taken as kg m-2 s-1", "none": "unknown units, taken as kg m-2 s-1; mean too large, check units"}


def test_conservative_remap_keeps_the_integral(spark):
    import math

    lat = [-90.0, -50.0, -7.0, 33.0, 90.0]
    lon = [-175.0, -60.0, 10.0, 100.0, 185.0]
    cells = [(4 * i + j, a, b, w, e) for i, (a, b) in enumerate(zip(lat, lat[1:])) for j, (w, e) in enumerate(zip(lon, lon[1:]))]
    frame = spark.createDataFrame(cells, "cell_id long, lat_lo double, lat_hi double, lon_lo double, lon_hi double")
    weights = grid.conservative_weights(frame, 30.0)
    whole = weights.groupBy("target_id").agg(F.sum("w").alias("w")).collect()
    assert len(whole) == 72 and all(r["w"] == pytest.approx(1.0) for r in whole)
    area = lambda a, b, w, e: (math.sin(math.radians(b)) - math.sin(math.radians(a))) * math.radians(e - w)
    own = spark.createDataFrame([(c, area(*x)) for c, *x in cells], "cell_id long, area double")
    target = spark.createDataFrame([(i * 12 + j, area(30 * i - 90, 30 * i - 60, 0, 30)) for i in range(6) for j in range(12)], "cell_id long, area double")
    field = frame.select(F.lit("k").alias("k"), "cell_id", F.when(F.col("cell_id") != 5, F.col("cell_id") + 1.0).alias("v"))
    out = grid.remap_conservative(field, weights, ["v"], ["k"])
    total = lambda f, a: grid.integral(f, a, "v", ["k"]).first()["integral"]
    assert total(out, target) == pytest.approx(total(field, own))
    mean = grid.remap_conservative(field.withColumn("v", F.when(F.col("v").isNotNull(), 3.0)), weights, ["v"], ["k"], by_covered=True).collect()
    assert all(r["v"] == pytest.approx(3.0) for r in mean if r["v"] is not None) and any(r["covered"] < 0.99 for r in mean)
