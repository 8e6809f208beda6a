"""The workloads end to end on a small synthetic archive."""

import random

import pytest
from pyspark.sql import functions as F

from emberline.jobs import tasks
from emberline.jobs.stages import Stages
from emberline.operators import attribution, fwi, grid, stats
from emberline.sources import catalog, resolve

RUNS = [("target", "ssp245", 2020, 2021), ("ssp245", "ssp245", 2064, 2065), ("exp", "exp", 2064, 2065)]
PAIRS = [("exp-target", "exp", "target"), ("exp-ssp245", "exp", "ssp245")]


@pytest.fixture(scope="module")
def archive(spark):
    rng = random.Random(0)
    rows = []
    for model in ("A", "B"):
        for scenario, years in (("ssp245", (2019, 2020, 2021, 2063, 2064, 2065)), ("exp", (2063, 2064, 2065))):
            for member in ("r1", "r2"):
                for cell, lat in ((0, 40.0), (1, -10.0)):
                    for y in years:
                        if model == "B" and y in (2019, 2063):
                            continue  # B starts with its runs
                        for d in range(1, 361):
                            warm = 2.0 if scenario == "ssp245" and y > 2050 else 0.0
                            m = (d - 1) // 30 + 1
                            rows.append((model, scenario, member, cell, lat, 10.0, 0, y, m, (d - 1) % 30 + 1, d, (y - 2000) * 360 + d, 285 + warm + 8 * (m in (6, 7, 8)) + rng.gauss(0, 3), 60 - warm + rng.gauss(0, 10), 3.0, max(0.0, rng.gauss(0, 2)) / 86400))
    ddl = "model string, scenario string, member string, cell_id long, lat double, lon double, tile int, year int, month int, day int, doy int, day_idx int, tas double, hurs double, sfcWind double, pr double"
    cells = spark.createDataFrame([(0, 40.0, 10.0, True), (1, -10.0, 10.0, True)], "cell_id long, lat double, lon double, land boolean")
    bridge = spark.createDataFrame([(0, "N", "north"), (1, "S", "south")], "cell_id long, region string, region_name string")
    return spark.createDataFrame(rows, ddl).cache(), cells, bridge


def test_fire_weather(archive):
    out = tasks.fire_weather(*archive, runs=RUNS, pairs=PAIRS, absolute=5.0, common_res=None)
    days = {r[0]: r[1] for r in out["yearly"].groupBy("run").agg(F.avg("days_p95")).collect()}
    assert days["target"] == pytest.approx(18.0, abs=0.6) and out["index"].where("fwi < 0").count() == 0
    assert {tuple(r) for r in out["index"].groupBy("model").agg(F.min("year"), F.count_distinct("year")).collect()} == {("A", 2020, 4), ("B", 2020, 4)}
    # B runs up on a copy of its first year: its first index is not the one of fresh codes.
    fresh = fwi.compute_fwi(archive[0].where("model = 'B' AND scenario = 'exp'"), ["model", "member", "tile"], "tas").where("day_idx % 360 = 1").agg(F.avg("fwi")).first()[0]
    run_up = out["index"].where("model = 'B' AND run = 'exp' AND day_idx % 360 = 1 AND year = 2064").agg(F.avg("fwi")).first()[0]
    assert fresh is not None and abs(run_up - fresh) > 1e-6
    assert out["multimodel"].count() == 4 and out["regional"].count() == 2 * 3 * 2
    assert {r["month"] for r in out["season"].where("in_season AND cell_id = 0").collect()} >= {6, 7}
    assert out["changes"].where("pvalue BETWEEN 0 AND 1").count() == 8 and out["seasonal"].where("fwi IS NULL").count() == 0


@pytest.fixture(scope="module")
def three_grids(spark):
    """Three models on grids of their own, two over the globe and one box; B has a tasmax that is warmer than its tas."""
    rng, rows, cells = random.Random(1), [], []
    grids = {"A": ((-45.0, 45.0), (-90.0, 0.0, 90.0, 180.0)), "B": ((-60.0, 0.0, 60.0), (-120.0, 0.0, 120.0)), "C": ((30.0, 50.0), (10.0, 30.0))}
    for k, (model, (lats, lons)) in enumerate(grids.items()):
        points = [(100 * k + i, lat, lon) for i, (lat, lon) in enumerate((a, b) for a in lats for b in lons)]
        cells += [(model, c, lat, lon, True) for c, lat, lon in points]
        for scenario, years in (("ssp245", (2020, 2064)), ("exp", (2064,))):
            for c, lat, lon in points:
                for y in years:
                    warm = 3.0 if scenario == "ssp245" and y > 2050 else 0.0
                    for d in range(1, 61):
                        t = 285 + warm + rng.gauss(0, 3)
                        rows.append((model, scenario, "001", c, lat, lon, k, y, (d - 1) // 30 + 6, (d - 1) % 30 + 1, d, (y - 2000) * 360 + d, t, t + 5 if model == "B" else t, 60 - warm + rng.gauss(0, 10), 3.0, max(0.0, rng.gauss(0, 2)) / 86400))
    ddl = "model string, scenario string, member string, cell_id long, lat double, lon double, tile int, year int, month int, day int, doy int, day_idx int, tas double, tasmax double, hurs double, sfcWind double, pr double"
    frame = spark.createDataFrame(cells, "model string, cell_id long, lat double, lon double, land boolean")
    bridge = spark.createDataFrame([(c[1], "W", "world") for c in cells], "cell_id long, region string, region_name string")
    return spark.createDataFrame(rows, ddl).cache(), frame, bridge


WALK = "FlatMapGroupsIn"
ONE_YEAR = [("target", "ssp245", 2020, 2020), ("ssp245", "ssp245", 2064, 2064), ("exp", "exp", 2064, 2064)]


def walks(df):
    return df._jdf.queryExecution().executedPlan().toString().count(WALK)


def test_stages_of_fire_weather(spark, three_grids, tmp_path):
    """With the default grid: no output walks through the index again, a second call makes nothing, another temperature makes what depends on it."""
    run = lambda **more: (s := Stages(spark, str(tmp_path), archive="three grids"), tasks.fire_weather(*three_grids, runs=ONE_YEAR, pairs=PAIRS, absolute=5.0, stages=s, **more))
    stages, out = run()
    rest = ["index", "thresholds_fwi", "yearly_fwi", "monthly_fwi", "changes_fwi"]
    assert stages.made == ["inputs", "temperature", *rest] and {name: walks(df) for name, df in out.items()} == dict.fromkeys(out, 0)
    # Members named by digits stay strings, and B alone uses tasmax.
    assert dict(out["index"].dtypes)["member"] == "string" and out["index"].select("member").distinct().collect() == [("001",)]
    assert {tuple(r) for r in stages.used["temperature"].table.collect()} == {("A", "tas"), ("B", "tasmax"), ("C", "tas")}
    again, same = run()
    assert again.made == [] and sorted(same["yearly"].collect()) == sorted(out["yearly"].collect())
    cooler, other = run(temperature="tas")
    assert cooler.made == rest and cooler.used["inputs"] == stages.used["inputs"] and cooler.used["index"] != stages.used["index"]
    means = lambda o, m: o["index"].where(F.col("model") == m).agg(F.avg("fwi")).first()[0]
    assert means(other, "B") < means(out, "B") and means(other, "A") == pytest.approx(means(out, "A"))
    last, _ = run(temperature="tas")
    assert last.made == [] and len(last.sweep()) == len(rest) and run(temperature="tas")[0].made == [] and run()[0].made == rest


def test_absent_models_are_counted_on_the_default_grid(spark, three_grids):
    out = tasks.fire_weather(*three_grids, runs=ONE_YEAR, pairs=PAIRS, absolute=5.0)
    cells = out["multimodel"].where("pair = 'exp-ssp245'").collect()
    assert len(cells) == 180 * 360 and {r["models"] for r in cells} == {3}
    assert {r["valued"] for r in cells} == {2, 3} and sum(r["valued"] == 3 for r in cells) == 20 * 20
    # Where the box has no value, both others must agree and one of three be significant is too few.
    by_model = {r["model"]: r["significant"] for r in out["changes"].where("pair = 'exp-ssp245' AND significant").collect()}
    assert any(r["robust"] for r in cells) == (len(by_model) >= 2) and all(not r["robust"] for r in cells if r["mean"] is None)


def test_plan_of_stacking_does_not_grow_with_models(spark):
    grids = [(m, 100 * m + 10 * i + j, 10.0 * i, 10.0 * j) for m in range(5) for i in range(3) for j in range(3)]
    size = {}
    for n in (1, 5):
        own = spark.createDataFrame([(str(m), c, x, y) for m, c, x, y in grids if m < n], "model string, cell_id long, lat double, lon double")
        field = own.withColumns({"delta": F.lit(1.0), "significant": F.lit(True)}).select("model", "cell_id", "delta", "significant")
        stacked = grid.stack_models(field, own, ["delta", "significant"], [], 10.0)
        size[n] = len(stacked._jdf.queryExecution().optimizedPlan().toString().splitlines())
        assert {tuple(r) for r in stats.multimodel(stacked, ["cell_id"], models="n_models").select(F.round("mean", 9), "models", "valued", "robust").collect()} == {(1.0, n, n, True)}
    assert size[1] == size[5]


def test_a_model_without_a_value_disagrees(spark):
    """One global model and two boxes elsewhere: one of three is below two thirds."""
    points = lambda m, first, lats, lons: [(m, first + i * len(lons) + j, x, y) for i, x in enumerate(lats) for j, y in enumerate(lons)]
    own = points("A", 0, [-60.0, 0.0, 60.0], [-120.0, 0.0, 120.0]) + points("B", 100, [5.0, 15.0], [5.0, 15.0]) + points("C", 200, [5.0, 25.0], [5.0, 25.0])
    cells = spark.createDataFrame(own, "model string, cell_id long, lat double, lon double")
    stacked = grid.stack_models(cells.select("model", "cell_id", F.lit(2.0).alias("delta"), F.lit(True).alias("significant")), cells, ["delta", "significant"], [], 10.0)
    got = stats.multimodel(stacked, ["cell_id"], models="n_models").collect()
    assert len(got) == 18 * 36 and {(r["models"], r["valued"], r["robust"]) for r in got} == {(3, 1, False), (3, 2, True), (3, 3, True)}
    assert sum(r["valued"] == 3 for r in got) == 4 and sum(r["valued"] == 2 for r in got) == 5


def test_evaporative_demand(archive):
    out = tasks.evaporative_demand(*archive, runs=RUNS, pairs=PAIRS)
    assert all(abs(r[1] - 1) < 1e-9 for r in out["areas"].groupBy("pair", "model").agg(F.sum("fraction").alias("s")).select("pair", "s").collect())
    colder = out["changes"].where("pair = 'exp-ssp245'").collect()
    assert len(colder) == 4 and all(r["dvpd"] < 0 and r["offset_class"] in (1, 2) for r in colder)
    assert out["terms"].where("pair = 'exp-ssp245' AND t_term >= 0").count() == 0
    means = out["yearly"].groupBy("model", "run", "cell_id").agg(F.avg("days_p95").alias("value"))
    deltas = tasks.changes(out["yearly"], "days_p95", PAIRS)
    wide = tasks.model_summary(out["thresholds"], means, deltas, ["target", "exp"], ["exp-target"])
    assert wide.count() == 4 and "exp-target_delta" in wide.columns


def test_temperature_response(archive):
    monthly = archive[0].groupBy("model", "scenario", "member", "lat", "lon", "year", "month").agg(F.avg("tas").alias("tas"))
    out = tasks.temperature_response(monthly, (2064, 2065), (2020, 2021), "ssp245")
    warm = {r["scenario"]: r["mean"] for r in out["anomaly"].where("model = 'A' AND lat = 40").collect()}
    assert warm["ssp245"] == pytest.approx(2.0, abs=0.4) and warm["exp"] == pytest.approx(0.0, abs=0.4)


def test_discovery(spark):
    paths = [f"root/CESM2-WACCM/{s}/r{k}/day/{v}_day_20200101-20291231.nc" for s in ("ssp245", "G6-1.5K-SAI", "G6-1.5K-HiLLA") for k in (1, 2) for v in ("tas", "hurs")]
    out = tasks.discovery(spark.createDataFrame([(p,) for p in [*paths, "root/X/what.nc"]], "path string"), ["tas", "hurs"], max_members=1)
    assert {r["missing"] for r in out["readiness"].collect()} == {"ok"} and out["models"].first()[0] == "CESM2-WACCM" and out["members"].count() == 3 and out["unknown"].first()[0] == "what.nc"


def test_harmonise(spark):
    base = [("A", "s", "r1", seq, v, u, 10.0, lon, 2020, 1, d, 12, d, d, False, c, x) for seq, dup in ((0, 0.0), (1, 5.0)) for d in range(1, 4 - seq) for c, lon in ((0, 10.0), (1, 350.0)) for v, u, x in (("tas", "K", 290.0 + dup), ("hurs", "1", 0.5 + dup / 100))]
    raw = spark.createDataFrame(base, "model string, scenario string, member string, file_seq int, var string, units string, latitude double, longitude double, year int, month int, day int, hour int, doy int, day_idx int, has_bounds boolean, cell_id long, value double")
    out = tasks.harmonise(raw, ["tas", "hurs"], (2020, 2020)).collect()
    assert len(out) == 6 and {(r["tas"], r["hurs"], r["lon"]) for r in out} == {(290.0, 50.0, 10.0), (290.0, 50.0, -10.0)}


def test_demand_returns_all_terms(archive):
    terms = tasks.evaporative_demand(*archive, runs=RUNS, pairs=PAIRS)["terms"].collect()
    change = archive[0].sparkSession.createDataFrame([("exp-ssp245", m, c, 1.0) for m in ("A", "B") for c in (0, 1)], "pair string, model string, cell_id long, delta double")
    classes = tasks.evaporative_demand(*archive, runs=RUNS, pairs=PAIRS, season_change=change)["changes"].where("pair = 'exp-ssp245'").collect()
    assert len(classes) == 4 and all(r["offset_class"] in (1, 3) for r in classes)
    assert len(terms) == 8 and all(r["total"] == pytest.approx(r["t_term"] + r["rh_term"] + r["residual"], abs=1e-9) for r in terms)


def test_attribution_compares_the_fire_season(spark):
    days = [(s, "r1", 1, 2020, m, 3 if s != "baseline" and m in (7, 8, 9) else 0, 3 * (10.0 + (4.0 if s != "baseline" and m in (7, 8, 9) else 0.0) + (m in (7, 8, 9))), 3) for s in ("baseline", "x:T") for m in range(1, 13)]
    counts = spark.createDataFrame(days, "driver_set string, member string, cell_id long, year int, month int, above long, total double, n long")
    mask = spark.createDataFrame([(1, m, m in (6, 7)) for m in range(1, 13)], "cell_id long, month int, in_season boolean")
    own, given = attribution.driver_changes(counts, ["member"]).first(), attribution.driver_changes(counts, ["member"], mask).first()
    assert (own["delta_fwi"], own["delta_days"]) == (pytest.approx(4.0), 9.0) and given["delta_fwi"] == pytest.approx(4.0 * 31 / 61)


def test_driver_sets_are_walked_as_one_array(spark, archive):
    """Every set's counts equal those of its own walk over a table with that set's changes, and the days go through one shuffle of one set's width."""
    v = ["tas", "hurs", "sfcWind", "pr"]
    base = archive[0].where("model = 'A' AND scenario = 'ssp245' AND year < 2022")
    deltas = spark.createDataFrame([(s, c, m, 2.0 * k + c, -5.0, 1.1, 0.5) for k, s in enumerate(("x", "y")) for c in (0, 1) for m in range(1, 13) if (c, m) != (1, 7)], "scenario string, cell_id long, month int, tas double, hurs double, sfcWind double, pr double")
    limit = spark.createDataFrame([(0, 4.0), (1, 3.0)], "cell_id long, threshold double")
    counts = attribution.driver_walk(base, deltas, limit, ["x", "y"], v, ["member", "tile"])
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "Cartesian" not in plan and plan.count("FlatMapCoGroups") == 1
    got = {tuple(r)[:4]: (r["above"], round(r["total"], 6), r["n"]) for r in counts.groupBy("driver_set", "member", "cell_id", "month").agg(F.sum("above").alias("above"), F.sum("total").alias("total"), F.sum("n").alias("n")).collect()}
    assert {k[0] for k in got} == {"baseline"} | {f"{s}:{d}" for s in "xy" for d in ("T", "RH", "wind", "precip", "all")}
    for name, s, changed in (("x:T", "x", ["tas"]), ("y:all", "y", v), ("baseline", "x", [])):
        named = deltas.where(F.col("scenario") == s).select("cell_id", "month", *[F.col(x).alias(f"_{x}") for x in v])
        rows = base.join(named, ["cell_id", "month"], "left")
        new = {x: F.col(x) + F.col(f"_{x}") if x in ("tas", "hurs") else F.col(x) * F.col(f"_{x}") for x in v}
        rows = rows.withColumns({x: (F.least(F.greatest(new[x], F.lit(0.0)), F.lit(100.0)) if x == "hurs" and x in changed else new[x] if x in changed else F.col(x)).cast("float") for x in v})
        own = fwi.compute_fwi(rows, ["member", "tile"], "tas").join(limit, "cell_id")
        want = own.groupBy("member", "cell_id", "month").agg(F.count_if(F.col("fwi") > F.col("threshold")), F.coalesce(F.sum("fwi"), F.lit(0.0)), F.count("fwi")).collect()
        assert len(want) == 2 * 2 * 12
        for member, cell, month, above, total, n in want:
            assert got[name, member, cell, month] == (above, pytest.approx(total, abs=2e-6), n)


def test_years_in_chunks_equal_the_whole(spark, archive, tmp_path):
    """Chunks go on from the codes of the chunk before, to the bit; a new year reads no old one."""
    days = archive[0].where("model = 'A' AND scenario = 'ssp245'").withColumn("hurs", F.when(~((F.col("year") == 2020) & (F.col("doy") > 300)), F.col("hurs")))
    key, codes = ["model", "member", "tile"], ("ffmc", "dmc", "dc", "fwi")
    whole = fwi.compute_fwi(days, key, "tas", codes=codes)
    stages = Stages(spark, str(tmp_path))
    parts = tasks.fwi_by_chunks(stages, days, key, [(2019, 2019), (2020, 2021), (2063, 2065)], source="a", temperature="tas")
    got = tasks.chunked_index(stages, parts)
    assert got.count() == whole.count() and got.exceptAll(whole.select(*got.columns)).count() == 0
    assert stages.made == ["codes_2019_2019", "state_2019_2019", "codes_2020_2021", "state_2020_2021", "codes_2063_2065", "state_2063_2065"]
    more = Stages(spark, str(tmp_path))
    new = days.where("year = 2065").withColumns({"year": F.lit(2066), "day_idx": F.col("day_idx") + 360})
    only_new = new.withColumn("_", F.assert_true(F.col("year") == 2066)).drop("_")
    added = tasks.fwi_by_chunks(more, only_new, key, [(2019, 2019), (2020, 2021), (2063, 2065), (2066, 2066)], source="a", temperature="tas")
    assert more.made == ["codes_2066_2066", "state_2066_2066"]
    longer = fwi.compute_fwi(days.unionByName(new), key, "tas", codes=codes)
    got = tasks.chunked_index(more, added)
    assert got.count() == longer.count() and got.exceptAll(longer.select(*got.columns)).count() == 0


def test_multimodel_on_grids_of_their_own(spark):
    points = lambda lats, lons, first: [(first + i * len(lons) + j, x, y) for i, x in enumerate(lats) for j, y in enumerate(lons)]
    a, b = points((0.0, 10.0, 20.0), (0.0, 10.0, 20.0), 0), points((5.0, 15.0), (5.0, 15.0), 100)
    cells = spark.createDataFrame(a + b, "cell_id long, lat double, lon double")
    rows = [("A", "p", c, x + y, True) for c, x, y in a] + [("B", "p", c, 2 * (x + y), True) for c, x, y in b]
    field = spark.createDataFrame(rows, "model string, pair string, cell_id long, delta double, significant boolean")
    stacked = grid.stack_models(field, cells, ["delta", "significant"], ["pair"], 10.0).where("delta IS NOT NULL")
    got = {r["cell_id"]: (r["mean"], r["models"], r["robust"]) for r in stats.multimodel(stacked, ["pair", "cell_id"]).collect()}
    at = lambda lat, lon: int((lat + 90) // 10 * 36 + (lon + 180) // 10)
    assert got == {at(x, y): (pytest.approx(1.5 * (x + y)), 2, True) for x in (5.0, 15.0) for y in (5.0, 15.0)}


def test_catalog_decides_where_wind_comes_from(spark, archive):
    """A model whose catalog entry names the climatology runs on its donor's wind; the other's file stays."""
    daily = archive[0].where("cell_id = 0 AND model IN ('A', 'B')").withColumns({"uas": F.lit(6.0), "vas": F.lit(8.0), "model": F.when(F.col("model") == "A", "MIROC-ES2H").otherwise("B")})
    entries = [(m, s, r, v, "netcdf", [f"{v}.nc"]) for m in ("MIROC-ES2H", "B") for s in ("ssp245", "exp") for r in ("r1", "r2") for v in ("tas", "hurs", "sfcWind", "pr", *(("uas", "vas") if s == "ssp245" and r == "r2" else ()))]
    found = catalog.apply_known_issues(spark.createDataFrame(entries, "model string, scenario string, member string, var string, kind string, paths array<string>").withColumn("var_name", F.col("var")))
    plan = resolve.plan_inputs(found, ["sfcWind", "hurs", "tasmax", "huss"])
    how = {(r["model"], r["var"]): (r["how"], r["donor"]) for r in plan.collect()}
    assert how == {("MIROC-ES2H", "sfcWind"): ("climatology", "r2"), ("B", "sfcWind"): ("file", None), **{(m, "hurs"): ("file", None) for m in ("MIROC-ES2H", "B")}, **{(m, "tasmax"): ("absent", None) for m in ("MIROC-ES2H", "B")}, **{(m, "huss"): ("missing", None) for m in ("MIROC-ES2H", "B")}}
    out = tasks.fire_weather(daily, *archive[1:], runs=RUNS, pairs=PAIRS, absolute=5.0, common_res=None, archive=found)
    plain = tasks.fire_weather(daily, *archive[1:], runs=RUNS, pairs=PAIRS, absolute=5.0, common_res=None)
    mean = lambda o: {r[0]: r[1] for r in o["index"].groupBy("model").agg(F.avg("fwi")).collect()}
    a, b = mean(out), mean(plain)
    assert a["MIROC-ES2H"] > 1.5 * b["MIROC-ES2H"] and a["B"] == pytest.approx(b["B"])
    with pytest.raises(Exception, match="no source for hurs"):
        resolve.resolve_inputs(daily, resolve.plan_inputs(found.where("var <> 'hurs'"), ["sfcWind", "hurs"])).collect()
