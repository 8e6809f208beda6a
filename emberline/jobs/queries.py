"""Queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.functions import calendars, physics
from emberline.jobs import tasks
from emberline.jobs.cube import CELLS_SQL, DAILY_SQL, OFF_TIES, cells, daily, table, with_vpd
from emberline.jobs.stages import Stages
from emberline.operators import attribution, classify, extremes, fwi, grid, overview, regions, season, stats
from emberline.sources import catalog, ingest, resolve

QUERIES: dict = {}
SQL: dict[str, str] = {}
CM = ["scenario", "member", "cell_id"]
WITH = f"WITH {CELLS_SQL}, {DAILY_SQL}"
PAIR = [("F-O", "F", "O")]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + OFF_TIES, digits) for c in columns})


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_vpd(daily(spark, sf_dir))


def thresholds(d: DataFrame, value: str = "vpd") -> DataFrame:
    return extremes.pooled_quantile(d, value, ["cell_id"], single=False)


THRESHOLD = "thr AS (SELECT cell_id, quantile_cont(vpd, 0.95) AS threshold FROM daily GROUP BY cell_id)"
FLAGGED = f"{THRESHOLD}, f AS (SELECT daily.*, threshold, CASE WHEN vpd > threshold THEN 1 ELSE 0 END AS above FROM daily LEFT JOIN thr USING (cell_id))"
YEARLY = f"""{FLAGGED}, r AS (SELECT *, sum(1 - above) OVER (PARTITION BY scenario, member, cell_id, year ORDER BY day_idx) AS run FROM f),
s AS (SELECT scenario, member, cell_id, year, run, sum(above) AS days, sum(CASE WHEN vpd > 1.5 THEN 1 ELSE 0 END) AS over FROM r GROUP BY ALL),
yearly AS (SELECT scenario, member, cell_id, year, sum(days)::INT AS days_p95, sum(over)::INT AS days_abs, max(days)::INT AS spell_max FROM s GROUP BY ALL)"""
MONTHLY = "clim AS (SELECT scenario, cell_id, month, avg(vpd) AS vpd, avg(tas) AS tas, avg(hurs) AS hurs, avg(pr) AS pr, avg(sfcWind) AS sfcWind FROM daily GROUP BY ALL)"
DAYS_IN = "[31, 28.25, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]"
SEASON = f"""{MONTHLY},
sums AS (SELECT a.scenario, a.cell_id, a.month, a.vpd + b.vpd + c.vpd AS s FROM clim a JOIN clim b ON a.scenario = b.scenario AND a.cell_id = b.cell_id AND b.month = a.month % 12 + 1
  JOIN clim c ON a.scenario = c.scenario AND a.cell_id = c.cell_id AND c.month = (a.month + 1) % 12 + 1),
best AS (SELECT scenario, cell_id, arg_min(month, struct_pack(x := -s, m := month)) AS start FROM sums WHERE s IS NOT NULL GROUP BY ALL),
mask AS (SELECT k.scenario, k.cell_id, m.month::INT AS month, coalesce((m.month - start + 12) % 12 < 3, false) AS in_season
  FROM (SELECT DISTINCT scenario, cell_id FROM clim) k CROSS JOIN (SELECT unnest(range(1, 13)) AS month) m LEFT JOIN best USING (scenario, cell_id))"""


@query("vpd_daily", f"{WITH} SELECT scenario, member, cell_id, day_idx, round(vpd + 1.7e-8, 6) AS vpd, round(pr / 86400 * 86400 + 1.7e-8, 6) AS pr_mm, round(hypot_ws + 1.7e-8, 6) AS speed FROM (SELECT *, sqrt(sfcWind * sfcWind * 2) AS hypot_ws FROM daily)")
def vpd_daily(spark, sf):
    d = cube(spark, sf)
    return rounded(d.select(*CM, "day_idx", "vpd", physics.mm_per_day(F.col("pr") / 86400).alias("pr_mm"), physics.wind_speed(F.col("sfcWind"), F.col("sfcWind")).alias("speed")), "vpd", "pr_mm", "speed")


@query(
    "vpd_methods",
    f"""{WITH}, x AS (SELECT *, exp(-6096.9385 / tas + 21.2409642 - 2.711193e-2 * tas + 1.673952e-5 * tas * tas + 2.433502 * ln(tas)) AS es, hurs / 1e4 AS q, 101325.0 AS p FROM daily)
SELECT scenario, member, cell_id, day_idx, round(greatest((es - q * p / (0.622 + 0.378 * q)) / 1000, 0) + 1.7e-8, 6) AS vpd_huss, round(least(greatest(100 * (q * p / (0.622 + 0.378 * q)) / es, 0), 100) + 1.7e-8, 6) AS rh, round(greatest(es * (1 - hurs / 100) / 1000, 0) + 1.7e-8, 6) AS vpd_max FROM x""",
)
def vpd_methods(spark, sf):
    d = cube(spark, sf).withColumns({"huss": F.col("hurs") / 1e4, "ps": F.lit(101325.0), "tasmax": F.col("tas"), "hursmin": F.lit(None).cast("double")})
    return rounded(d.select(*CM, "day_idx", physics.daily_vpd("huss").alias("vpd_huss"), physics.rh_from_huss(F.col("tas"), F.col("huss"), F.col("ps")).alias("rh"), physics.daily_vpd("max").alias("vpd_max")), "vpd_huss", "rh", "vpd_max")


@query("pooled_p95", f"{WITH}, {THRESHOLD} SELECT cell_id, round(threshold + 1.7e-8, 6) AS threshold FROM thr")
def pooled_p95(spark, sf):
    return rounded(thresholds(cube(spark, sf)), "threshold")


@query("selected_p95", f"{WITH}, k AS (SELECT scenario, quantile_cont(vpd, 0.95) AS threshold, quantile_cont(pr, 0.5) AS rain FROM daily GROUP BY scenario) SELECT scenario, round(threshold + 1.7e-8, 6) AS threshold, round(rain + 1.7e-8, 6) AS rain FROM k")
def selected_p95(spark, sf):
    """Quantiles of two keys that hold all rows, by selection; half of the rain values are alike."""
    d = cube(spark, sf)
    rain = extremes.selected_quantile(d, "pr", ["scenario"], 0.5, bins=16, held=100).withColumnRenamed("threshold", "rain")
    return rounded(extremes.selected_quantile(d, "vpd", ["scenario"], bins=64, held=100).join(rain, "scenario"), "threshold", "rain")


@query("yearly_metrics", f"{WITH}, {YEARLY} SELECT * FROM yearly")
def yearly_metrics(spark, sf):
    d = cube(spark, sf)
    return extremes.yearly_metrics(extremes.with_threshold(d, thresholds(d), ["cell_id"]), "vpd", CM, 1.5)


@query("days_above", f"{WITH}, {YEARLY} SELECT scenario, member, cell_id, year, days_p95, days_abs FROM yearly")
def days_above(spark, sf):
    d = cube(spark, sf)
    local = extremes.days_above_local(extremes.with_threshold(d, thresholds(d), ["cell_id"]), "vpd", CM)
    return local.join(extremes.days_above_abs(d, "vpd", CM, 1.5), [*CM, "year"])


@query("monthly_metrics", f"{WITH}, {FLAGGED} SELECT scenario, member, cell_id, month, round(avg(above) + 1.7e-8, 6) AS exc_freq, round(avg(vpd) + 1.7e-8, 6) AS mean_month FROM f GROUP BY ALL")
def monthly_metrics(spark, sf):
    d = cube(spark, sf)
    return rounded(extremes.monthly_metrics(extremes.with_threshold(d, thresholds(d), ["cell_id"]), "vpd", CM), "exc_freq", "mean_month")


REGIONAL = f"""{YEARLY}, m AS (SELECT scenario, cell_id, avg(days_p95) AS days, avg(spell_max) AS spell FROM yearly GROUP BY ALL),
regional AS (SELECT scenario, region, region_name, sum(days * cos(radians(lat))) / sum(cos(radians(lat))) FILTER (days IS NOT NULL) AS days,
  sum(spell * cos(radians(lat))) / sum(cos(radians(lat))) FILTER (spell IS NOT NULL) AS spell FROM m JOIN cells USING (cell_id) WHERE land GROUP BY ALL)"""


def regional(spark, sf):
    d, c = cube(spark, sf), cells(spark, sf)
    yearly = extremes.yearly_metrics(extremes.with_threshold(d, thresholds(d), ["cell_id"]), "vpd", CM)
    means = stats.ensemble_mean(yearly.withColumnsRenamed({"days_p95": "days", "spell_max": "spell"}), ["days", "spell"], ["scenario", "cell_id"])
    return regions.regional_means(means, c.select("cell_id", "region", "region_name"), c.select("cell_id", "lat", "land"), ["days", "spell"], ["scenario"])


@query("regional_extremes", f"{WITH}, {REGIONAL} SELECT scenario, region, region_name, round(days + 1.7e-8, 6) AS days, round(spell + 1.7e-8, 6) AS spell FROM regional")
def regional_extremes(spark, sf):
    """Days per year above the local 95th percentile of VPD, and longest spells, by region."""
    return rounded(regional(spark, sf), "days", "spell")


@query("regional_pivot", f"{WITH}, {REGIONAL} SELECT region, round(avg(days) + 1.7e-8, 6) AS days, round(avg(spell) + 1.7e-8, 6) AS spell FROM regional WHERE region IN ('4', '2', '0') GROUP BY region")
def regional_pivot(spark, sf):
    long = regional(spark, sf).select("scenario", "region", F.expr("stack(2, 'days', days, 'spell', spell) AS (quantity, value)"))
    return rounded(regions.regional_pivot(long, ["days", "spell"], ["4", "2", "0"]), "days", "spell")


@query(
    "regional_summary",
    f"{WITH}, {REGIONAL} SELECT region, round(o.days + 1.7e-8, 6) AS base, round(f.days + 1.7e-8, 6) AS exp, round(f.days - o.days + 1.7e-8, 6) AS shift, round(CASE WHEN o.days <> 0 THEN 100 * (f.days - o.days) / o.days ELSE 0 END + 1.7e-8, 6) AS percent "
    "FROM (SELECT * FROM regional WHERE scenario = 'O') o JOIN (SELECT * FROM regional WHERE scenario = 'F') f USING (region) ORDER BY f.days - o.days DESC, region LIMIT 3",
)
def regional_summary(spark, sf):
    r = regional(spark, sf)
    s = regions.regional_summary(r.where("scenario = 'O'"), r.where("scenario = 'F'"), "days")
    return rounded(regions.top_regions(s, 3), "base", "exp", "shift", "percent")


@query(
    "regional_seasonality",
    f"""{WITH}, {FLAGGED}, m AS (SELECT scenario, cell_id, month, avg(above) * {DAYS_IN}[month] AS days FROM f GROUP BY scenario, cell_id, month)
SELECT scenario, month, region, region_name, round(sum(days * cos(radians(lat))) / sum(cos(radians(lat))) + 1.7e-8, 6) AS days FROM m JOIN cells USING (cell_id) WHERE land GROUP BY ALL""",
)
def regional_seasonality(spark, sf):
    d, c = cube(spark, sf), cells(spark, sf)
    m = extremes.monthly_metrics(extremes.with_threshold(d, thresholds(d), ["cell_id"]), "vpd", ["scenario", "cell_id"])
    return rounded(regions.regional_seasonality(m, c.select("cell_id", "region", "region_name"), c.select("cell_id", "lat", "land"), ["scenario"]), "days")


def climatology(d: DataFrame) -> DataFrame:
    return season.monthly_climatology(d, ["vpd", "tas", "hurs", "pr", "sfcWind"], ["scenario", "cell_id"])


def mask(d: DataFrame) -> DataFrame:
    return season.fire_season_mask(climatology(d), "vpd", ["scenario", "cell_id"])


@query("monthly_climatology", f"{WITH}, {MONTHLY} SELECT scenario, cell_id, month, round(vpd + 1.7e-8, 6) AS vpd, round(tas + 1.7e-8, 6) AS tas, round(hurs + 1.7e-8, 6) AS hurs, round(pr + 1.7e-8, 6) AS pr, round(sfcWind + 1.7e-8, 6) AS sfcWind FROM clim")
def monthly_climatology(spark, sf):
    return rounded(climatology(cube(spark, sf)), "vpd", "tas", "hurs", "pr", "sfcWind")


@query("monthly_resample", f"{WITH} SELECT scenario, member, cell_id, year, month, round(avg(vpd) + 1.7e-8, 6) AS vpd, round(avg(pr) * 2 + 1.7e-8, 6) AS pr FROM daily GROUP BY ALL")
def monthly_resample(spark, sf):
    return rounded(season.resample_monthly(cube(spark, sf), ["vpd", "pr"], CM, {"pr": 2.0}), "vpd", "pr")


@query("fire_season", f"{WITH}, {SEASON} SELECT * FROM mask")
def fire_season(spark, sf):
    return mask(cube(spark, sf))


@query("seasonal_mean", f"{WITH}, {SEASON} SELECT scenario, cell_id, round(sum(vpd * {DAYS_IN}[month]) FILTER (in_season) / sum({DAYS_IN}[month]) FILTER (in_season) + 1.7e-8, 6) AS vpd FROM clim JOIN mask USING (scenario, cell_id, month) GROUP BY ALL")
def seasonal_mean(spark, sf):
    d = cube(spark, sf)
    return rounded(season.seasonal_mean(climatology(d).select("scenario", "cell_id", "month", "vpd"), mask(d), "vpd", ["scenario", "cell_id"], ["scenario", "cell_id"]), "vpd")


@query(
    "fire_season_annual",
    f"{WITH}, {SEASON}, series AS (SELECT scenario, member, cell_id, year, month, avg(vpd) AS vpd FROM daily GROUP BY ALL) "
    f"SELECT scenario, member, cell_id, year, round(sum(vpd * {DAYS_IN}[month]) FILTER (in_season) / sum({DAYS_IN}[month]) FILTER (in_season) + 1.7e-8, 6) AS vpd FROM series JOIN mask USING (scenario, cell_id, month) GROUP BY ALL",
)
def fire_season_annual(spark, sf):
    d = cube(spark, sf)
    return rounded(season.fire_season_annual(season.resample_monthly(d, ["vpd"], CM), mask(d), "vpd", CM, ["scenario", "cell_id"]), "vpd")


@query(
    "smooth_doy",
    f"""{WITH}, c AS (SELECT cell_id, doy, avg(sfcWind) AS wind FROM daily GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY doy) AS k, count(*) OVER (PARTITION BY cell_id) AS n FROM c)
SELECT a.cell_id, a.doy, round(avg(b.wind) + 1.7e-8, 6) AS wind FROM n a JOIN n b ON a.cell_id = b.cell_id AND least((a.k - b.k + a.n) % a.n, (b.k - a.k + a.n) % a.n) <= 15 GROUP BY ALL""",
)
def smooth_doy(spark, sf):
    c = season.doy_climatology(cube(spark, sf), F.col("sfcWind"), ["cell_id"], "wind")
    return rounded(season.smooth_doy(c, "wind", ["cell_id"]), "wind")


def with_components(d: DataFrame) -> DataFrame:
    """Components of the wind for all members but A, and specific humidity and pressure."""
    return d.withColumns({"uas": F.when(F.col("member") != "A", F.col("sfcWind") * 0.6), "vas": F.when(F.col("member") != "A", F.col("sfcWind") * 0.3), "huss": F.col("hurs") / 1e4, "ps": F.lit(101325.0)})


def entries(d: DataFrame) -> DataFrame:
    """A catalog: A has wind files in F and lacks all wind files in O, where the catalog names a climatology; N has components; R has wind and specific humidity."""
    m, s = F.col("member"), F.col("scenario")
    names = F.when(m == "A", F.when(s == "O", F.array(*map(F.lit, ("tas", "hurs", "pr", "clim")))).otherwise(F.array(*map(F.lit, ("tas", "hurs", "pr", "sfcWind"))))).when(m == "N", F.array(*map(F.lit, ("tas", "hurs", "pr", "uas", "vas")))).otherwise(F.array(*map(F.lit, ("tas", "huss", "ps", "pr", "sfcWind"))))
    rows = d.select("model", "scenario", "member").distinct().withColumn("var", F.explode(names))
    return rows.select("model", "scenario", "member", F.when(F.col("var") == "clim", "sfcWind").otherwise(F.col("var")).alias("var"), F.when(F.col("var") == "clim", "wind_climatology").otherwise("netcdf").alias("kind"))


CLIM = """donor AS (SELECT cell_id, doy, avg(sqrt(power(sfcWind * 0.6, 2) + power(sfcWind * 0.3, 2))) AS w FROM daily WHERE scenario = 'F' AND member = 'N' AND year BETWEEN 1996 AND 1997 GROUP BY ALL), dn AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY doy) AS k, count(*) OVER (PARTITION BY cell_id) AS n FROM donor),
three AS (SELECT cell_id, doy, k + j * n AS at, k, w, n FROM dn, (SELECT unnest([-1, 0, 1]) AS j)), sm AS (SELECT a.cell_id, a.doy, CASE WHEN count(b.w) = 31 THEN avg(b.w) END::FLOAT AS w FROM dn a JOIN three b ON a.cell_id = b.cell_id AND b.at BETWEEN a.k - 15 AND a.k + 15 GROUP BY ALL)"""


@query("wind_climatology", f"{WITH}, {CLIM} SELECT cell_id, doy, round(w::DOUBLE, 4) AS wind FROM sm")
def wind_climatology(spark, sf):
    """Wind by day of year of the donor that the catalog leads to: the first member with both components, in the baseline's years."""
    d = with_components(cube(spark, sf))
    donors = resolve.donors_of(resolve.plan_inputs(entries(d), ["sfcWind"], "F"))
    return season.wind_climatology(d, donors, ["cell_id"], "F", (1996, 1997)).select("cell_id", "doy", F.round(F.col("sfcWind").cast("double"), 4).alias("wind"))


@query(
    "resolve_inputs",
    f"""{WITH}, {CLIM}, near AS (SELECT d.scenario, d.member, d.cell_id, d.day_idx, arg_min(sm.w, struct_pack(x := abs(sm.doy - d.doy), y := sm.doy)) AS w FROM daily d JOIN sm ON d.cell_id = sm.cell_id WHERE d.scenario = 'O' AND d.member = 'A' GROUP BY ALL)
SELECT scenario, member, cell_id, day_idx, round(CASE WHEN member = 'A' AND scenario = 'O' THEN near.w::DOUBLE WHEN member = 'N' THEN (sqrt(power(sfcWind * 0.6, 2) + power(sfcWind * 0.3, 2)) * (1 + month / 10.0))::FLOAT::DOUBLE ELSE sfcWind END, 3) AS wind,
  round(CASE WHEN member = 'R' THEN least(greatest(100 * (hurs / 1e4 * 101325.0 / (0.622 + 0.378 * (hurs / 1e4))) / exp(-6096.9385 / tas + 21.2409642 - 2.711193e-2 * tas + 1.673952e-5 * tas * tas + 2.433502 * ln(tas)), 0), 100)::FLOAT::DOUBLE ELSE hurs END, 3) AS hurs
FROM daily LEFT JOIN near USING (scenario, member, cell_id, day_idx)""",
)
def resolve_inputs(spark, sf):
    """Wind and humidity from where the catalog says: files, components with a monthly ratio, specific humidity, and a donor's climatology."""
    d = with_components(cube(spark, sf))
    ratio = d.select("model", "cell_id", "month").distinct().withColumn("ratio", 1 + F.col("month") / 10.0)
    out = resolve.resolve_inputs(d, resolve.plan_inputs(entries(d), ["sfcWind", "hurs", "tas", "pr"], "F"), ratio, "F", (1996, 1997))
    return out.select(*CM, "day_idx", F.round(F.col("sfcWind").cast("double"), 3).alias("wind"), F.round(F.col("hurs").cast("double"), 3).alias("hurs"))


@query(
    "wind_uv_ratio",
    f"""{WITH}, c AS (SELECT model, cell_id, month, avg(sfcWind) AS s, avg(sqrt(power(sfcWind * 0.6, 2) + power(sfcWind * 0.3, 2))) AS uv FROM daily GROUP BY ALL)
SELECT model, cell_id, month, round(coalesce(least(greatest(s / CASE WHEN uv > 0.1 THEN uv END, 0.8), 3.0), 1.0) + 1.7e-8, 6) AS ratio FROM c""",
)
def wind_uv_ratio(spark, sf):
    d = cube(spark, sf).withColumns({"uas": F.col("sfcWind") * 0.6, "vas": F.col("sfcWind") * 0.3})
    return rounded(season.wind_uv_ratio(d, ["model", "cell_id"])[0], "ratio")


SAMPLES = f"{YEARLY}, mo AS (SELECT scenario, cell_id, avg(days_p95) AS mean, var_samp(days_p95) AS var, count(*)::DOUBLE AS n FROM yearly GROUP BY ALL), w AS (SELECT a.cell_id, a.mean - b.mean AS delta, a.var / a.n AS sa, b.var / b.n AS sb, a.n AS na, b.n AS nb FROM mo a JOIN mo b ON a.cell_id = b.cell_id AND a.scenario = 'F' AND b.scenario = 'O'), welch AS (SELECT cell_id, delta, delta / sqrt(CASE WHEN sa + sb > 0 THEN sa + sb END) AS t, CASE WHEN sa + sb > 0 THEN (sa + sb) * (sa + sb) / (sa * sa / (na - 1) + sb * sb / (nb - 1)) END AS df FROM w)"


def annual(spark, sf) -> DataFrame:
    d = cube(spark, sf)
    return extremes.yearly_metrics(extremes.with_threshold(d, thresholds(d), ["cell_id"]), "vpd", CM)


def welch_of(y: DataFrame, p_value: bool) -> DataFrame:
    of = lambda s: stats.moments(y.where(F.col("scenario") == s), "days_p95", ["cell_id"])
    return stats.welch(of("F"), of("O"), ["cell_id"], p_value)


@query("welch", f"{WITH}, {SAMPLES} SELECT cell_id, round(delta + 1.7e-8, 6) AS delta, round(t + 1.7e-8, 6) AS t, round(df + 1.7e-8, 6) AS df FROM welch")
def welch(spark, sf):
    return rounded(welch_of(annual(spark, sf), False), "delta", "t", "df")


@query(
    "welch_pvalue",
    f"""{WITH}, {SAMPLES}, g AS (SELECT unnest(range(0, 4000)) AS k)
SELECT cell_id, round(coalesce(1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi() * df) * abs(t) / 3 / 4000 *
  sum((CASE WHEN k = 0 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * power(1 + power(abs(t) * k / 4000, 2) / df, -(df + 1) / 2)) - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi() * df) * abs(t) / 3 / 4000 * power(1 + t * t / df, -(df + 1) / 2), 1), 5) AS pvalue
FROM welch CROSS JOIN g GROUP BY cell_id, t, df""",
)
def welch_pvalue(spark, sf):
    return welch_of(annual(spark, sf), True).select("cell_id", F.round("pvalue", 5).alias("pvalue"))


@query(
    "fdr",
    f"""{WITH}, {SAMPLES}, p AS (SELECT cell_id, cell_id % 2 AS map, 1 / (1 + t * t * t * t) AS pvalue FROM welch), k AS (SELECT *, row_number() OVER (PARTITION BY map ORDER BY pvalue) AS k, count(*) OVER (PARTITION BY map) AS n FROM p WHERE pvalue IS NOT NULL),
c AS (SELECT map, max(pvalue) AS crit FROM k WHERE pvalue <= 0.4 * k / n GROUP BY map) SELECT cell_id, map, round(pvalue + 1.7e-8, 6) AS pvalue, coalesce(pvalue <= crit, false) AS significant FROM p LEFT JOIN c USING (map)""",
)
def fdr(spark, sf):
    p = welch_of(annual(spark, sf), False).select("cell_id", (F.col("cell_id") % 2).alias("map"), (1 / (1 + F.col("t") * F.col("t") * F.col("t") * F.col("t"))).alias("pvalue"))
    return rounded(stats.fdr_significant(p, ["map"], 0.4), "pvalue")


MEMBERS = f"{YEARLY}, a AS (SELECT member, cell_id, avg(days_p95) AS x FROM yearly WHERE scenario = 'F' GROUP BY ALL), b AS (SELECT cell_id, avg(days_p95) AS y FROM yearly WHERE scenario = 'O' GROUP BY ALL), md AS (SELECT member, cell_id, round(x - y, 9) + 0.001 * (cell_id % 7 + 1) AS delta FROM a JOIN b USING (cell_id)), mm AS (SELECT *, avg(delta) OVER (PARTITION BY cell_id) AS m FROM md)"


def member_deltas(spark, sf) -> DataFrame:
    y = annual(spark, sf)
    a = y.where("scenario = 'F'").groupBy("member", "cell_id").agg(F.avg("days_p95").alias("x"))
    b = y.where("scenario = 'O'").groupBy("cell_id").agg(F.avg("days_p95").alias("y"))
    return a.join(b, "cell_id").select("member", "cell_id", (F.round(F.col("x") - F.col("y"), 9) + 0.001 * (F.col("cell_id") % 7 + 1)).alias("delta"))


@query("sign_agreement", f"{WITH}, {MEMBERS} SELECT cell_id, round(avg(CASE WHEN sign(delta) = sign(m) THEN 1.0 ELSE 0.0 END) + 1.7e-8, 6) AS agreement FROM mm GROUP BY cell_id")
def sign_agreement(spark, sf):
    return rounded(stats.sign_agreement(member_deltas(spark, sf), ["cell_id"]), "agreement")


@query("multimodel", f"{WITH}, {MEMBERS} SELECT cell_id, round(avg(delta) + 1.7e-8, 6) AS mean, count(*) AS models, avg(CASE WHEN sign(delta) = sign(m) THEN 1.0 ELSE 0.0 END) >= 2/3 AND avg(CASE WHEN abs(delta) > 0.3 THEN 1.0 ELSE 0.0 END) >= 0.5 AS robust FROM mm GROUP BY cell_id")
def multimodel(spark, sf):
    return rounded(stats.multimodel(member_deltas(spark, sf).withColumn("significant", F.abs("delta") > 0.3), ["cell_id"]), "mean")


@query("pair_delta", f"{WITH}, m AS (SELECT scenario, cell_id, avg(vpd) AS vpd FROM daily GROUP BY ALL) SELECT 'F-O' AS pair, cell_id, round(a.vpd - b.vpd + 1.7e-8, 6) AS delta FROM m a JOIN m b USING (cell_id) WHERE a.scenario = 'F' AND b.scenario = 'O'")
def pair_delta(spark, sf):
    m = stats.ensemble_mean(cube(spark, sf), ["vpd"], ["scenario", "cell_id"])
    return rounded(stats.pair_delta(m, "vpd", ["cell_id"], PAIR, "scenario"), "delta")


P_VALUE = """g AS (SELECT unnest(range(0, 4000)) AS k), p AS (SELECT cell_id, delta, t, df, coalesce(1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi() * df) * abs(t) / 3 / 4000 *
  (sum((CASE WHEN k = 0 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * power(1 + power(abs(t) * k / 4000, 2) / df, -(df + 1) / 2)) + power(1 + t * t / df, -(df + 1) / 2)), 1) AS pvalue FROM welch CROSS JOIN g GROUP BY cell_id, delta, t, df)"""


@query(
    "ensemble_delta",
    f"""{WITH}, {SAMPLES}, {P_VALUE}, k AS (SELECT cell_id, pvalue, row_number() OVER (PARTITION BY cell_id % 2 ORDER BY pvalue) AS k, count(*) OVER (PARTITION BY cell_id % 2) AS n FROM p),
c AS (SELECT cell_id % 2 AS map, max(pvalue) AS crit FROM k WHERE pvalue <= 0.3 * k / n GROUP BY ALL),
md AS (SELECT cell_id, x - y AS d, avg(x - y) OVER (PARTITION BY cell_id) AS m FROM (SELECT member, cell_id, avg(days_p95) AS x FROM yearly WHERE scenario = 'F' GROUP BY ALL) JOIN (SELECT cell_id, avg(days_p95) AS y FROM yearly WHERE scenario = 'O' GROUP BY ALL) USING (cell_id)),
ag AS (SELECT cell_id, avg(CASE WHEN sign(d) = sign(m) THEN 1.0 ELSE 0.0 END) AS agreement FROM md GROUP BY cell_id)
SELECT p.cell_id % 2 AS map, p.cell_id, round(delta + 1.7e-8, 6) AS delta, round(t + 1.7e-8, 6) AS t, round(df + 1.7e-8, 6) AS df, round(pvalue, 5) AS pvalue, coalesce(pvalue <= crit, false) AS significant, round(agreement + 1.7e-8, 6) AS member_agreement
FROM p LEFT JOIN c ON p.cell_id % 2 = c.map LEFT JOIN ag ON ag.cell_id = p.cell_id""",
)
def ensemble_delta(spark, sf):
    y = annual(spark, sf).withColumnRenamed("scenario", "run").withColumn("map", F.col("cell_id") % 2)
    out = stats.ensemble_delta(y, "days_p95", ["map", "cell_id"], "F", "O", alpha=0.3, map_keys=("map",))
    return rounded(out, "delta", "t", "df", "member_agreement").withColumn("pvalue", F.round("pvalue", 5))


CHANGES = f"{MONTHLY}, m AS (SELECT scenario, cell_id, avg(vpd) AS vpd, avg(pr) AS pr, avg(tas) AS tas FROM clim GROUP BY ALL), x AS (SELECT cell_id, round(a.vpd - b.vpd, 9) AS dvpd, round(a.pr - b.pr, 9) AS dpr, round(a.tas - b.tas, 9) AS dfwi, b.pr AS base FROM m a JOIN m b USING (cell_id) WHERE a.scenario = 'F' AND b.scenario = 'O'), k AS (SELECT *, CASE WHEN dvpd < 0 AND dpr >= 0 THEN 1 WHEN dvpd < 0 AND dpr < 0 AND dfwi <= 0 THEN 2 WHEN dvpd < 0 AND dpr < 0 AND dfwi > 0 THEN 3 WHEN dvpd >= 0 AND dpr < 0 THEN 4 WHEN dvpd >= 0 THEN 5 END::INT AS offset_class FROM x)"


def classes(spark, sf) -> DataFrame:
    m = stats.ensemble_mean(climatology(cube(spark, sf)), ["vpd", "pr", "tas"], ["scenario", "cell_id"])
    a, b = (m.where(F.col("scenario") == s).select("cell_id", *[F.col(c).alias(f"{s}_{c}") for c in ("vpd", "pr", "tas")]) for s in ("F", "O"))
    d = lambda c: F.round(F.col(f"F_{c}") - F.col(f"O_{c}"), 9)
    x = a.join(b, "cell_id").select("cell_id", d("vpd").alias("dvpd"), d("pr").alias("dpr"), d("tas").alias("dfwi"), F.col("O_pr").alias("base"))
    return x.withColumn("offset_class", classify.classify_offset(F.col("dvpd"), F.col("dpr"), F.col("dfwi"))).withColumn("percent", classify.pct_change(F.col("dpr"), F.col("base")))


@query("offset_classes", f"{WITH}, {CHANGES} SELECT cell_id, offset_class, round(CASE WHEN base > 0.05 THEN 100 * dpr / base END + 1.7e-8, 6) AS percent FROM k")
def offset_classes(spark, sf):
    return rounded(classes(spark, sf).select("cell_id", "offset_class", "percent"), "percent")


@query("area_fractions", f"{WITH}, {CHANGES}, w AS (SELECT offset_class, sum(cos(radians(lat))) AS w FROM k JOIN cells USING (cell_id) WHERE land AND offset_class IS NOT NULL GROUP BY ALL) SELECT 'm' AS map, c::INT AS offset_class, round(coalesce(w, 0) / (SELECT sum(w) FROM w) + 1.7e-8, 6) AS fraction FROM (SELECT unnest([1, 2, 3, 4, 5]) AS c) LEFT JOIN w ON c = offset_class")
def area_fractions(spark, sf):
    k = classes(spark, sf).select(F.lit("m").alias("map"), "cell_id", "offset_class")
    return rounded(regions.area_fractions(k, cells(spark, sf).select("cell_id", "lat", "land"), ["map"]), "fraction")


ES = "exp(-6096.9385 / {0} + 21.2409642 - 2.711193e-2 * {0} + 1.673952e-5 * {0} * {0} + 2.433502 * ln({0})) * (1 - {1} / 100) / 1000"
TERMS = ", ".join([f"{ES.format('a.tas', 'b.hurs')} - {ES.format('b.tas', 'b.hurs')} AS t_term", f"{ES.format('b.tas', 'a.hurs')} - {ES.format('b.tas', 'b.hurs')} AS rh_term", f"{ES.format('a.tas', 'a.hurs')} - {ES.format('b.tas', 'b.hurs')} AS total"])


@query("vpd_decomposition", f"{WITH}, {MONTHLY}, x AS (SELECT a.cell_id, a.month, {TERMS} FROM clim a JOIN clim b ON a.cell_id = b.cell_id AND a.month = b.month AND a.scenario = 'F' AND b.scenario = 'O') SELECT cell_id, month, round(t_term + 1.7e-8, 6) AS t_term, round(rh_term + 1.7e-8, 6) AS rh_term, round(total + 1.7e-8, 6) AS total, round(round(total - t_term - rh_term, 9) + 1.7e-8, 6) AS residual FROM x")
def vpd_decomposition(spark, sf):
    c = climatology(cube(spark, sf))
    out = attribution.vpd_decomposition(c.where("scenario = 'F'"), c.where("scenario = 'O'"), ["cell_id"]).withColumn("residual", F.round("residual", 9))
    return rounded(out, "t_term", "rh_term", "total", "residual")


DELTAS = f"{MONTHLY}, dl AS (SELECT a.cell_id, a.month, a.tas - b.tas AS d_tas, a.hurs - b.hurs AS d_hurs, least(greatest((a.pr + 1e-9) / (b.pr + 1e-9), 0.2), 5.0) AS d_pr, least(greatest((a.sfcWind + 1e-3) / (b.sfcWind + 1e-3), 0.2), 5.0) AS d_wind FROM clim a JOIN clim b ON a.cell_id = b.cell_id AND a.month = b.month AND a.scenario = 'F' AND b.scenario = 'O')"


@query("apply_deltas", f"{WITH}, {DELTAS} SELECT scenario, member, cell_id, day_idx, round((tas + d_tas)::FLOAT::DOUBLE, 3) AS tas, round(least(greatest(hurs + d_hurs, 0), 100)::FLOAT::DOUBLE, 3) AS hurs, round((pr * d_pr)::FLOAT::DOUBLE, 3) AS pr, round((sfcWind * d_wind)::FLOAT::DOUBLE, 3) AS sfcWind FROM daily JOIN dl USING (cell_id, month) WHERE scenario = 'O'")
def apply_deltas(spark, sf):
    d, v = cube(spark, sf), ["tas", "hurs", "pr", "sfcWind"]
    c = climatology(d)
    deltas = attribution.climatological_deltas(c.where("scenario = 'F'"), c.where("scenario = 'O'"), v, ["cell_id"])
    out = attribution.apply_deltas(d.where("scenario = 'O'"), deltas, v, ["cell_id"])
    return out.select(*CM, "day_idx", *[F.round(F.col(x).cast("double"), 3).alias(x) for x in v])


BAND_HOURS = lambda table: "[" + ", ".join("[" + ", ".join(map(str, row)) + "]" for row in table.tolist()) + "]"


def fwi_sql(source: str, keys: str) -> str:
    """Recursive CTE over the days of a cell: the table ``walked`` (keys, k, f, d, c) of codes after day k of ``source`` (keys, k, month, lat, t, h, w, p), and ``fwi`` with all codes."""
    on = " AND ".join(f"s.{k.strip()} = z.{k.strip()}" for k in keys.split(","))
    s_keys = ", ".join(f"s.{k.strip()}" for k in keys.split(","))
    return f"""walked AS (
  SELECT {keys}, 0::BIGINT AS k, 85.0::DOUBLE AS f, 6.0::DOUBLE AS d, 15.0::DOUBLE AS c FROM (SELECT DISTINCT {keys} FROM {source})
  UNION ALL
  SELECT {keys}, k, least(greatest(59.5 * (250 - m3) / (147.2 + m3), 0), 101) AS f,
    CASE WHEN p > 1.5 THEN greatest(43.43 * (5.6348 - ln(greatest(20 + 280 * exp(-0.023 * d) + 1000 * (0.92 * p - 1.27) / (48.77 + b * (0.92 * p - 1.27)) - 20, 1e-9))), 0) ELSE d END
      + CASE WHEN t < -1.1 THEN 0.0 ELSE 1.894 * (t + 1.1) * (100 - h) * dmc_hours * 1e-4 END AS d,
    CASE WHEN p > 2.8 THEN greatest(c - 400 * ln(1 + 3.937 * (0.83 * p - 1.27) / (800 * exp(-c / 400))), 0) ELSE c END + greatest((0.36 * (greatest(t, -2.8) + 2.8) + dc_hours) / 2, 0) AS c
  FROM (SELECT *, CASE WHEN m1 > ed THEN ed + (m1 - ed) * power(10, -((0.424 * (1 - power(h / 100, 1.7)) + 0.0694 * sqrt(w) * (1 - power(h / 100, 8))) * 0.581 * exp(0.0365 * t)))
      WHEN m1 < ed AND m1 < ew THEN ew - (ew - m1) * power(10, -((0.424 * (1 - power((100 - h) / 100, 1.7)) + 0.0694 * sqrt(w) * (1 - power((100 - h) / 100, 8))) * 0.581 * exp(0.0365 * t))) ELSE m1 END AS m3
    FROM (SELECT *, CASE WHEN p > 0.5 THEN least(m0 + 42.5 * (p - 0.5) * exp(-100 / (251 - m0)) * (1 - exp(-6.93 / (p - 0.5))) + CASE WHEN m0 > 150 THEN 0.0015 * power(m0 - 150, 2) * sqrt(p - 0.5) ELSE 0 END, 250) ELSE m0 END AS m1,
        0.942 * power(h, 0.679) + 11 * exp((h - 100) / 10) + 0.18 * (21.1 - t) * (1 - exp(-0.115 * h)) AS ed,
        0.618 * power(h, 0.753) + 10 * exp((h - 100) / 10) + 0.18 * (21.1 - t) * (1 - exp(-0.115 * h)) AS ew,
        CASE WHEN d <= 33 THEN 100 / (0.5 + 0.3 * d) WHEN d <= 65 THEN 14 - 1.3 * ln(greatest(d, 1e-9)) ELSE 6.2 * ln(greatest(d, 1e-9)) - 17.2 END AS b
      FROM (SELECT {s_keys}, s.k, s.t, s.h, s.w, s.p, s.dmc_hours, s.dc_hours, z.f, z.d, z.c, 147.2 * (101 - z.f) / (59.5 + z.f) AS m0 FROM walked z JOIN {source} s ON {on} AND s.k = z.k + 1)))),
fwi AS (SELECT *, CASE WHEN bb <= 1 THEN bb ELSE exp(2.72 * power(0.434 * ln(greatest(bb, 1)), 0.647)) END AS fwi
  FROM (SELECT *, 0.1 * isi * CASE WHEN bui <= 80 THEN 0.626 * power(bui, 0.809) + 2 ELSE 1000 / (25 + 108.64 * exp(-0.023 * bui)) END AS bb
    FROM (SELECT *, CASE WHEN d + 0.4 * c > 0 THEN greatest(CASE WHEN d <= 0.4 * c THEN 0.8 * c / (d + 0.4 * c) * d ELSE d - (1 - 0.8 * c / (d + 0.4 * c)) * (0.92 + power(0.0114 * d, 1.7)) END, 0) ELSE 0 END AS bui
      FROM (SELECT s.*, z.f, z.d, z.c, 19.1152 * exp(-0.1386 * (147.2 * (101 - z.f) / (59.5 + z.f))) * (1 + power(147.2 * (101 - z.f) / (59.5 + z.f), 5.31) / 4.93e7) * exp(0.05039 * s.w) AS isi
        FROM {source} s JOIN walked z ON {on} AND s.k = z.k))))"""


def fwi_source(name: str, table_: str, keys: str, t: str = "tas", h: str = "hurs", w: str = "sfcWind", p: str = "pr") -> str:
    band = "CASE WHEN lat >= 30 THEN 5 WHEN lat >= 15 THEN 4 WHEN lat >= -15 THEN 3 WHEN lat >= -30 THEN 2 ELSE 1 END"
    half = "CASE WHEN lat >= 15 THEN 3 WHEN lat >= -15 THEN 2 ELSE 1 END"
    return f"""{name} AS MATERIALIZED (SELECT {keys}, year, month, day_idx, {t} - 273.15 AS t, {h}::DOUBLE AS h, {w} * 3.6 AS w, {p}::DOUBLE AS p, {BAND_HOURS(fwi.DMC_HOURS)}[{band}][month] AS dmc_hours, {BAND_HOURS(fwi.DC_HOURS)}[{half}][month] AS dc_hours,
  row_number() OVER (PARTITION BY {keys} ORDER BY day_idx) AS k FROM {table_})"""


RECURSIVE = WITH.replace("WITH", "WITH RECURSIVE", 1)
CODES_SQL = ", ".join(f"round({c} + 1.7e-8, 6) AS {n}" for c, n in (("f", "ffmc"), ("d", "dmc"), ("c", "dc"), ("isi", "isi"), ("bui", "bui"), ("fwi", "fwi")))


@query("fwi_daily", f"{RECURSIVE}, {fwi_source('src', 'daily', 'scenario, member, cell_id')}, {fwi_sql('src', 'scenario, member, cell_id')} SELECT scenario, member, cell_id, day_idx, {CODES_SQL} FROM fwi")
def fwi_daily(spark, sf):
    d = daily(spark, sf).withColumn("tile", ingest.tile_of(F.col("cell_id")))
    return rounded(fwi.compute_fwi(d, ["model", "scenario", "member", "tile"], temperature="tas", flux=False, codes=("ffmc", "dmc", "dc", "isi", "bui", "fwi")).select(*CM, "day_idx", "ffmc", "dmc", "dc", "isi", "bui", "fwi"), "ffmc", "dmc", "dc", "isi", "bui", "fwi")


WORKLOAD_RUNS = [("target", "F", 1996, 1997), ("exp", "O", 1999, 2000)]
RUN_DAYS = " UNION ALL ".join(f"SELECT '{r}' AS run, {y0} AS y0, * FROM daily WHERE scenario = '{s}' AND year BETWEEN {y0 - 1} AND {y1}" for r, s, y0, y1 in WORKLOAD_RUNS)


@query(
    "fire_weather",
    f"""{RECURSIVE}, rd AS ({RUN_DAYS}), {fwi_source('src', 'rd', 'run, y0, member, cell_id')}, {fwi_sql('src', 'run, y0, member, cell_id')}, kept AS MATERIALIZED (SELECT * FROM fwi WHERE year >= y0),
thr AS (SELECT cell_id, quantile_cont(fwi, 0.95)::FLOAT AS threshold FROM kept WHERE run = 'target' GROUP BY cell_id), fl AS (SELECT kept.*, threshold, CASE WHEN fwi > threshold::DOUBLE THEN 1 ELSE 0 END AS above FROM kept LEFT JOIN thr USING (cell_id)),
n AS (SELECT *, sum(1 - above) OVER (PARTITION BY run, member, cell_id, year ORDER BY day_idx) AS no FROM fl), sp AS (SELECT run, member, cell_id, year, no, sum(above) AS days, sum(CASE WHEN fwi > 5 THEN 1 ELSE 0 END) AS over, max(threshold) AS t FROM n GROUP BY ALL)
SELECT 'M1' AS model, run, member, cell_id, year, CASE WHEN max(t) IS NOT NULL THEN sum(days) END::INT AS days_p95, CASE WHEN max(t) IS NOT NULL THEN sum(over) END::INT AS days_abs, CASE WHEN max(t) IS NOT NULL THEN max(days) END::INT AS spell_max FROM sp GROUP BY ALL""",
)
def fire_weather(spark, sf):
    """The workload: staged inputs and index of two runs with their run-up, thresholds of the first, and the yearly metrics of both."""
    grids = cells(spark, sf)
    out = tasks.fire_weather(daily(spark, sf), grids.select("cell_id", "lat", "lon", "land"), grids.select("cell_id", "region", "region_name"), runs=WORKLOAD_RUNS, pairs=[("exp-target", "exp", "target")], absolute=5.0, flux=False, common_res=None)
    return out["yearly"]


@query("spinup", f"{WITH}, f AS (SELECT scenario, member, cell_id, min(year) AS y0 FROM daily GROUP BY ALL), j AS (SELECT daily.*, y0 FROM daily JOIN f USING (scenario, member, cell_id)), a AS (SELECT scenario, member, cell_id, year, month, day FROM j UNION ALL SELECT scenario, member, cell_id, year - 1, month, day FROM j WHERE year = y0 AND y0 >= 1990 AND NOT (month = 2 AND day = 29 AND NOT ((year - 1) % 4 = 0 AND ((year - 1) % 100 <> 0 OR (year - 1) % 400 = 0)))) SELECT scenario, member, cell_id, year, count(*) AS days FROM a GROUP BY ALL")
def spinup(spark, sf):
    return fwi.prepend_spinup(cube(spark, sf), CM, 1990).groupBy(*CM, "year").agg(F.count(F.lit(1)).alias("days"))


DRIVEN = {"baseline": "", "F:T": "T", "F:RH": "H", "F:wind": "W", "F:precip": "P", "F:all": "THWP"}
DRIVER_TABLE = "(SELECT " + ", ".join(f"unnest([{', '.join(x)}]) AS {n}" for n, x in (("driver_set", [f"'{k}'" for k in DRIVEN]), ("how", [f"'{v}'" for v in DRIVEN.values()]))) + ")"
DRIVER_DAYS = f"""dd AS (SELECT driver_set, member, cell_id, lat, year, month, day_idx, (CASE WHEN contains(how, 'T') THEN tas + d_tas ELSE tas END)::FLOAT::DOUBLE AS tas, (CASE WHEN contains(how, 'H') THEN least(greatest(hurs + d_hurs, 0), 100) ELSE hurs END)::FLOAT::DOUBLE AS hurs,
  (CASE WHEN contains(how, 'W') THEN sfcWind * d_wind ELSE sfcWind END)::FLOAT::DOUBLE AS sfcWind, (CASE WHEN contains(how, 'P') THEN pr * d_pr ELSE pr END)::FLOAT::DOUBLE * 86400 AS pr FROM flux JOIN dl USING (cell_id, month) CROSS JOIN {DRIVER_TABLE} WHERE scenario = 'O')"""
FLUX_DELTAS = DELTAS.replace(MONTHLY, "").lstrip(", ")


@query(
    "attribution",
    f"""{RECURSIVE}, flux AS (SELECT * REPLACE (pr / 86400 AS pr) FROM daily), clim AS (SELECT scenario, cell_id, month, avg(tas) AS tas, avg(hurs) AS hurs, avg(pr) AS pr, avg(sfcWind) AS sfcWind FROM flux GROUP BY ALL), {FLUX_DELTAS},
plain AS (SELECT * REPLACE (pr * 86400 AS pr) FROM flux WHERE scenario = 'O'), {fwi_source('src', 'plain', 'member, cell_id')}, {fwi_sql('src', 'member, cell_id')}, thr AS (SELECT cell_id, quantile_cont(fwi, 0.95) AS threshold FROM fwi GROUP BY cell_id),
{DRIVER_DAYS}, {fwi_source('dsrc', 'dd', 'driver_set, member, cell_id')}, {fwi_sql('dsrc', 'driver_set, member, cell_id').replace('walked', 'dwalked').replace('fwi AS (SELECT *, CASE WHEN bb', 'dfwi AS MATERIALIZED (SELECT *, CASE WHEN bb', 1)},
yr AS (SELECT driver_set, member, cell_id, year, sum(CASE WHEN fwi > threshold THEN 1 ELSE 0 END) AS d FROM dfwi JOIN thr USING (cell_id) GROUP BY ALL), dy AS (SELECT driver_set, cell_id, avg(d) AS days FROM yr GROUP BY ALL), mo AS (SELECT driver_set, cell_id, month, avg(fwi) AS fwi FROM dfwi GROUP BY ALL),
s3 AS (SELECT a.cell_id, a.month, a.fwi + b.fwi + c.fwi AS s FROM mo a JOIN mo b ON a.driver_set = 'baseline' AND b.driver_set = 'baseline' AND a.cell_id = b.cell_id AND b.month = a.month % 12 + 1 JOIN mo c ON c.driver_set = 'baseline' AND a.cell_id = c.cell_id AND c.month = (a.month + 1) % 12 + 1),
st AS (SELECT cell_id, arg_min(month, struct_pack(x := -s, m := month)) AS start FROM s3 WHERE s IS NOT NULL GROUP BY ALL),
se AS (SELECT driver_set, cell_id, sum(fwi * {DAYS_IN}[month]) FILTER ((month - start + 12) % 12 < 3) / sum({DAYS_IN}[month]) FILTER ((month - start + 12) % 12 < 3) AS f FROM mo JOIN st USING (cell_id) GROUP BY ALL),
al AS (SELECT * FROM dy JOIN se USING (driver_set, cell_id))
SELECT a.driver_set, a.cell_id, round(a.days - b.days + 1.7e-8, 6) AS delta_days, round(a.f - b.f + 1.7e-8, 6) AS delta_fwi FROM al a JOIN al b ON a.cell_id = b.cell_id AND b.driver_set = 'baseline' WHERE a.driver_set <> 'baseline'""",
)
def attribution_(spark, sf):
    """Days above the baseline's threshold and its fire-season index, with the changes of one driver from O to F, or of all."""
    d, v = daily(spark, sf).withColumn("pr", F.col("pr") / 86400), ["tas", "hurs", "pr", "sfcWind"]
    c = season.monthly_climatology(d, v, ["scenario", "cell_id"])
    deltas = attribution.climatological_deltas(c.where("scenario = 'F'"), c.where("scenario = 'O'"), v, ["cell_id"]).withColumn("scenario", F.lit("F"))
    base, series, stages = d.where("scenario = 'O'"), ["model", "member", "tile"], Stages.of_session(spark)
    index = fwi.compute_fwi(base, series, temperature="tas")
    keep = lambda counts: stages.stage("drivers", lambda: counts).table
    out = attribution.attribution(base, deltas, extremes.pooled_quantile(index, "fwi", ["cell_id"], single=False), v, series, scenarios=["F"], keep=keep)
    return rounded(out, "delta_days", "delta_fwi")


BANDED = " UNION ALL ".join(f"SELECT '{b}' AS band, * FROM zonal WHERE lat BETWEEN {lo} AND {hi}" for b, (lo, hi) in overview.BANDS.items())


@query("spatial_mean", f"{WITH}, zonal AS (SELECT scenario, year, month, lat, avg(tas) AS tas FROM daily GROUP BY ALL), z AS ({BANDED}) SELECT band, scenario, year, month, round(sum(tas * cos(radians(lat))) / sum(cos(radians(lat))) + 1.7e-8, 6) AS tas FROM z GROUP BY ALL")
def spatial_mean(spark, sf):
    d, out = cube(spark, sf), None
    for band, span in overview.BANDS.items():
        one = regions.spatial_mean(d, "tas", ["scenario", "year", "month"], span).withColumn("band", F.lit(band))
        out = one if out is None else out.unionByName(one)
    return rounded(out, "tas")


MD = "day(last_day(make_date(year, month, 1)))"


@query("global_annual_series", f"{WITH}, zonal AS (SELECT scenario, member, year, month, lat, avg(tas) AS tas FROM daily GROUP BY ALL), g AS (SELECT scenario, member, year, month, sum(tas * cos(radians(lat))) / sum(cos(radians(lat))) AS tas FROM zonal GROUP BY ALL) SELECT scenario, member, year, round(sum(tas * {MD}) / sum({MD}) + 1.7e-8, 6) AS tas FROM g WHERE year <> 1995 GROUP BY ALL")
def global_annual_series(spark, sf):
    return rounded(overview.global_annual_series(cube(spark, sf), "tas", ["scenario", "member"], drop_years=(1995,)), "tas")


ZONAL = f"zm AS (SELECT scenario, member, lat, year, month, avg(tas) AS tas FROM daily WHERE year BETWEEN 1996 AND 2000 GROUP BY ALL), zy AS (SELECT scenario, member, lat, year, sum(tas * {MD}) / sum({MD}) AS tas FROM zm GROUP BY ALL), zp AS (SELECT scenario, member, lat, avg(tas) AS tas FROM zy GROUP BY ALL)"


@query("zonal_mean", f"{WITH}, {ZONAL} SELECT scenario, member, lat, round(tas + 1.7e-8, 6) AS tas FROM zp")
def zonal_mean(spark, sf):
    return rounded(overview.zonal_mean_period(cube(spark, sf), "tas", ["scenario", "member"], (1996, 2000)), "tas")


@query("zonal_anomaly", f"{WITH}, {ZONAL}, k AS (SELECT *, dense_rank() OVER (PARTITION BY scenario, lat ORDER BY member) AS no FROM zp), a AS (SELECT f.lat, f.tas - o.tas AS x FROM k f JOIN k o ON f.lat = o.lat AND f.no = o.no AND f.scenario = 'F' AND o.scenario = 'O') SELECT lat, round(avg(x) + 1.7e-8, 6) AS mean, round(min(x) + 1.7e-8, 6) AS low, round(max(x) + 1.7e-8, 6) AS high FROM a GROUP BY lat")
def zonal_anomaly(spark, sf):
    z = overview.zonal_mean_period(cube(spark, sf), "tas", ["scenario", "member"], (1996, 2000))
    return rounded(overview.zonal_anomaly(z.where("scenario = 'F'"), z.where("scenario = 'O'"), "tas", ["lat"]), "mean", "low", "high")


#: Members in calendars of their own, whose day numbers are decoded there: standard, 365 days and 360 days.
CALENDARS = {"A": "standard", "N": "noleap", "R": "360_day"}
STARTS = "[0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334]"
OWN_DAYS = f"""own AS (SELECT scenario, member, CASE member WHEN 'A' THEN 'standard' WHEN 'N' THEN 'noleap' ELSE '360_day' END AS calendar, cell_id, lat, tas, day_idx AS n, CASE member WHEN 'N' THEN 365 WHEN 'R' THEN 360 END AS size FROM daily),
od AS (SELECT *, n - floor(n / size) * size AS rest, 1970 + floor(n / size) AS y FROM own),
dt AS (SELECT scenario, member, calendar, cell_id, lat, tas, n, (CASE WHEN size IS NULL THEN year(DATE '1970-01-01' + n) ELSE y END)::INT AS year,
  (CASE calendar WHEN 'standard' THEN month(DATE '1970-01-01' + n) WHEN 'noleap' THEN len(list_filter({STARTS}, lambda x: x <= rest)) ELSE floor(rest / 30) + 1 END)::INT AS month,
  (CASE calendar WHEN 'standard' THEN day(DATE '1970-01-01' + n) WHEN 'noleap' THEN rest - {STARTS}[len(list_filter({STARTS}, lambda x: x <= rest))] + 1 ELSE rest % 30 + 1 END)::INT AS day,
  (CASE WHEN size IS NULL THEN dayofyear(DATE '1970-01-01' + n) ELSE rest + 1 END)::INT AS doy FROM od)"""
OWN_MONTH = "CASE calendar WHEN '360_day' THEN 30 WHEN 'noleap' THEN [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][month] ELSE day(last_day(make_date(year, month, 1))) END"


def in_own_calendars(spark, sf) -> DataFrame:
    named = F.element_at(F.create_map(*[F.lit(x) for kv in CALENDARS.items() for x in kv]), F.col("member"))
    return calendars.decode_days(daily(spark, sf).withColumn("calendar", named), F.col("day_idx"))


@query("calendar_days", f"{WITH}, {OWN_DAYS} SELECT scenario, member, cell_id, n AS day_idx, year, month, day, doy, {OWN_MONTH} AS month_days, n AS back FROM dt")
def calendar_days(spark, sf):
    """Dates of day numbers in three calendars, and back."""
    d, c = in_own_calendars(spark, sf), F.col("calendar")
    parts = [F.col(x) for x in ("year", "month", "day")]
    return d.select(*CM, "day_idx", "year", "month", "day", "doy", calendars.days_in_month(c, *parts[:2]).alias("month_days"), calendars.day_number(c, *parts).cast("int").alias("back"))


@query("calendar_annual", f"{WITH}, {OWN_DAYS}, z AS (SELECT scenario, member, calendar, year, month, lat, avg(tas) AS tas FROM dt GROUP BY ALL), g AS (SELECT scenario, member, calendar, year, month, sum(tas * cos(radians(lat))) / sum(cos(radians(lat))) AS tas FROM z GROUP BY ALL) SELECT scenario, member, year, round(sum(tas * {OWN_MONTH}) / sum({OWN_MONTH}) + 1.7e-8, 6) AS tas FROM g GROUP BY ALL")
def calendar_annual(spark, sf):
    """Annual means of series in three calendars: months of 360-day years weigh alike."""
    return rounded(overview.global_annual_series(in_own_calendars(spark, sf), "tas", ["scenario", "member"]), "tas")


@query(
    "calendar_completeness",
    f"""{WITH}, {OWN_DAYS}, c AS (SELECT scenario, member, calendar, year, count(DISTINCT n) AS days FROM dt WHERE year BETWEEN 1994 AND 2001 GROUP BY ALL), k AS (SELECT DISTINCT scenario, member, calendar FROM dt),
y AS (SELECT k.*, u.year, coalesce(days, 0) AS days, CASE k.calendar WHEN '360_day' THEN 360 WHEN 'noleap' THEN 365 ELSE dayofyear(make_date(u.year, 12, 31)) END AS whole FROM k CROSS JOIN (SELECT unnest(range(1994, 2002)) AS year) u LEFT JOIN c ON k.scenario = c.scenario AND k.member = c.member AND u.year = c.year)
SELECT scenario, member, coalesce(array_to_string(list_sort(list(year) FILTER (days = 0)), ','), '') AS missing, coalesce(array_to_string(list_sort(list(year) FILTER (days > 0 AND days < whole)), ','), '') AS short, count(*) FILTER (days < whole) = 0 AS complete FROM y GROUP BY ALL""",
)
def calendar_completeness(spark, sf):
    """Missing and short years by the length of a year in the series' calendar."""
    join = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))).alias(c)
    return ingest.check_completeness(in_own_calendars(spark, sf), ["scenario", "member"], (1994, 2001), None).select("scenario", "member", join("missing"), join("short"), "complete")


LOG = "log AS (SELECT 'M' AS model, o_orderstatus AS scenario, (c_nationkey % 3)::VARCHAR AS member, year(o_orderdate)::INT AS year, round(sum(CASE WHEN c_nationkey < 12 THEN o_totalprice ELSE 0 END) / 1e6 + 1.7e-8, 6) AS north_tg, round(sum(CASE WHEN c_nationkey >= 12 THEN o_totalprice ELSE 0 END) / 1e6 + 1.7e-8, 6) AS south_tg FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"


@query("injection_efficiency", f"WITH {LOG}, y AS (SELECT scenario, year, avg(north_tg + south_tg) AS x FROM log WHERE year > 1995 AND year <= 2000 AND year <> 1998 GROUP BY ALL), p AS (SELECT avg(x) FILTER (scenario = 'F') AS f, avg(x) FILTER (scenario = 'O') AS o FROM y) SELECT 'M' AS model, round(f + 1.7e-8, 6) AS injection, round(o + 1.7e-8, 6) AS reference, round(f / o + 1.7e-8, 6) AS ratio, round(1 - f / o + 1.7e-8, 6) AS saved FROM p")
def injection_efficiency(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    half = lambda when: F.round(F.sum(F.when(when, F.col("o_totalprice")).otherwise(0)) / 1e6, 6)
    log = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.lit("M").alias("model"), F.col("o_orderstatus").alias("scenario"), (F.col("c_nationkey") % 3).cast("string").alias("member"), F.year("o_orderdate").alias("year")).agg(half(F.col("c_nationkey") < 12).alias("north_tg"), half(F.col("c_nationkey") >= 12).alias("south_tg"))
    return rounded(overview.injection_efficiency(overview.injection_totals(log), (1995, 2000), "F", "O", 1998), "injection", "reference", "ratio", "saved")


EVENTS = "ev AS (SELECT 'M' AS model, 'S' AS scenario, event_type AS member, 'x' AS var, user_id AS cell_id, event_id % 7 AS file_seq, (CAST(ts AS DATE) - DATE '1970-01-01')::INT AS day_idx, value FROM events)"


def event_rows(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(F.lit("M").alias("model"), F.lit("S").alias("scenario"), F.col("event_type").alias("member"), F.lit("x").alias("var"), F.col("user_id").alias("cell_id"), (F.col("event_id") % 7).alias("file_seq"), F.unix_date(F.to_date("ts")).alias("day_idx"), "value")


@query("merge_logs", f"WITH {LOG}, y AS (SELECT scenario, year, round(sum(north_tg + south_tg) + 1.7e-8, 6) AS so2 FROM log GROUP BY ALL) SELECT year, max(so2) FILTER (scenario = 'F') AS F, max(so2) FILTER (scenario = 'O') AS O, max(so2) FILTER (scenario = 'P') AS P FROM y GROUP BY year")
def merge_logs(spark, sf):
    """Yearly totals of three scenarios side by side, null in years that a log lacks."""
    c = F.col("c_nationkey")
    both = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    part = lambda ok: F.round(F.sum(F.when(ok, F.col("o_totalprice")).otherwise(0)) / 1e6 + OFF_TIES, 6)
    log = both.groupBy(F.col("o_orderstatus").alias("scenario"), (c % 3).cast("string").alias("member"), F.year("o_orderdate").alias("year")).agg(part(c < 12).alias("north_tg"), part(c >= 12).alias("south_tg"))
    yearly = rounded(overview.injection_totals(log.withColumn("model", F.lit("M"))).groupBy("scenario", "year").agg(F.sum("so2_tg").alias("so2")), "so2")
    return overview.merge_logs({s: yearly.where(F.col("scenario") == s) for s in ("F", "O", "P")}, "so2")


@query("month_lookup", f"{WITH}, {MONTHLY} SELECT d.scenario, member, year, round(avg(d.tas - clim.tas) + 1.7e-8, 6) AS anomaly FROM daily d LEFT JOIN clim ON d.scenario = clim.scenario AND d.cell_id = clim.cell_id AND d.month = clim.month GROUP BY ALL")
def month_lookup(spark, sf):
    """Mean departure of a year's days from their month's climatology."""
    d = cube(spark, sf)
    table_ = season.monthly_climatology(d, ["tas"], ["scenario", "cell_id"]).withColumnRenamed("tas", "usual")
    return rounded(grid.lookup_month(d, table_, ["scenario", "cell_id"]).groupBy("scenario", "member", "year").agg(F.avg(F.col("tas") - F.col("usual")).alias("anomaly")), "anomaly")


@query("doy_lookup", """WITH clim AS (SELECT o_custkey, dayofyear(o_orderdate)::INT AS doy, avg(o_totalprice) AS price FROM orders GROUP BY ALL), want AS (SELECT DISTINCT o_custkey, unnest([1, 60, 200, 366])::INT AS doy FROM orders)
SELECT w.o_custkey, w.doy, round(arg_min(price, struct_pack(x := abs(w.doy - c.doy), y := c.doy)) + 1.7e-8, 6) AS price FROM want w JOIN clim c USING (o_custkey) GROUP BY ALL""")
def doy_lookup(spark, sf):
    """Prices of four days of the year from each customer's nearest day with one, the earlier on ties."""
    o = table(spark, sf, "orders")
    clim = o.groupBy("o_custkey", F.dayofyear("o_orderdate").alias("doy")).agg(F.avg("o_totalprice").alias("price"))
    want = o.select("o_custkey").distinct().withColumn("doy", F.explode(F.array(*map(F.lit, (1, 60, 200, 366)))))
    return rounded(grid.lookup_doy(want, clim, ["o_custkey"], ["price"]), "price")


@query("dedupe_days", f"WITH {EVENTS}, w AS (SELECT member, day_idx, min(file_seq) AS file_seq FROM ev GROUP BY ALL) SELECT ev.* FROM ev JOIN w USING (member, day_idx, file_seq)")
def dedupe_days(spark, sf):
    return ingest.dedupe_days(ingest.drop_bad_time(event_rows(spark, sf)))


@query("probe_frequency", """WITH st AS (SELECT user_id, (event_id % 2)::VARCHAR AS path, epoch_us(ts) / 86400e6 AS t FROM events), one AS (SELECT * FROM (SELECT *, min(path) OVER (PARTITION BY user_id) AS first FROM st) WHERE path = first),
n AS (SELECT *, row_number() OVER w AS k, t - lag(t) OVER w AS d FROM one WINDOW w AS (PARTITION BY user_id ORDER BY t)), p AS (SELECT user_id, quantile_cont(d, 0.5) AS step FROM n WHERE k <= 50 GROUP BY ALL)
SELECT user_id, round(step + 1.7e-8, 6) AS step, CASE WHEN step < 0.9 THEN 'subdaily' WHEN step < 1.5 THEN 'day' WHEN step >= 20 THEN 'mon' ELSE 'unknown' END AS freq FROM p""")
def probe_frequency(spark, sf):
    """Frequency of each user's events, by the stamps of one of two files."""
    stamps = table(spark, sf, "events").select("user_id", (F.col("event_id") % 2).cast("string").alias("path"), (F.unix_micros(F.col("ts").cast("timestamp")) / 86400e6).alias("t"))
    return rounded(catalog.probe_frequency(stamps, ["user_id"]), "step")


@query("label_days", "WITH d AS (SELECT l_linenumber % 3 = 0 AS bare, l_shipdate::DATE - DATE '1970-01-01' AS lo, l_shipdate::DATE - DATE '1970-01-01' + l_quantity::INT AS hi, l_shipdate::DATE - DATE '1970-01-01' + 0.75 AS stamp FROM lineitem) SELECT CASE WHEN bare THEN floor(stamp) ELSE floor((lo + hi) / 2.0) END::INT AS day_idx, count(*) AS n FROM d GROUP BY ALL")
def label_days(spark, sf):
    """Days by the middle of their bounds, or by the stamp where there are none."""
    day, bounded = F.unix_date(F.to_date("l_shipdate")), F.col("l_linenumber") % 3 != 0
    lo, hi = F.when(bounded, day), F.when(bounded, day + F.col("l_quantity").cast("int"))
    return table(spark, sf, "lineitem").groupBy(ingest.label_day(lo, hi, day + 0.75).alias("day_idx")).agg(F.count(F.lit(1)).alias("n"))


@query("end_stamps", f"{WITH}, s AS (SELECT scenario, member, cell_id, day_idx - min(day_idx) OVER (PARTITION BY scenario, member) + CASE WHEN member = 'N' THEN 7305 ELSE 7306 END AS day_idx FROM daily), e AS (SELECT scenario, member, member <> 'N' AND count(DISTINCT day_idx) > 300 AS ends FROM s GROUP BY scenario, member) SELECT scenario, member, cell_id, (day_idx - CASE WHEN ends THEN 1 ELSE 0 END)::INT AS day_idx FROM s JOIN e USING (scenario, member)")
def end_stamps(spark, sf):
    """Series moved to begin on 1 or 2 January 1990: of the latter those with enough stamps mark the ends of days."""
    d = daily(spark, sf).select("model", *CM, F.lit("tas").alias("var"), "day_idx")
    begin = F.min("day_idx").over(Window.partitionBy("scenario", "member"))
    moved = d.withColumn("day_idx", (F.col("day_idx") - begin + F.when(F.col("member") == "N", 7305).otherwise(7306)).cast("int"))
    date = F.date_from_unix_date("day_idx")
    stamped = moved.withColumns({"month": F.month(date), "day": F.dayofmonth(date), "hour": F.lit(0), "has_bounds": F.lit(False)})
    return ingest.shift_end_stamps(stamped).select(*CM, "day_idx")


@query("completeness", f"{WITH}, d AS (SELECT scenario, member, cell_id, year, count(DISTINCT day_idx) AS days FROM daily WHERE year BETWEEN 1994 AND 2000 GROUP BY ALL), k AS (SELECT DISTINCT scenario, member, cell_id FROM daily), y AS (SELECT k.*, u.year, coalesce(days, 0) AS days FROM k CROSS JOIN (SELECT unnest(range(1994, 2001)) AS year) u LEFT JOIN d ON k.scenario = d.scenario AND k.member = d.member AND k.cell_id = d.cell_id AND u.year = d.year) SELECT scenario, member, cell_id, array_to_string(list_sort(list(year) FILTER (days = 0)), ',') AS missing, coalesce(array_to_string(list_sort(list(year) FILTER (days > 0 AND days < 360)), ','), '') AS short, count(*) FILTER (days < 360) = 0 AS complete FROM y GROUP BY ALL")
def completeness(spark, sf):
    join = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))).alias(c)
    return ingest.check_completeness(cube(spark, sf), CM, (1994, 2000)).select(*CM, join("missing"), join("short"), "complete")


@query("member_gate", f"{WITH}, d AS (SELECT scenario, member, year, count(DISTINCT day_idx) AS days FROM daily WHERE (scenario = 'F' AND year BETWEEN 1995 AND 1997) OR (scenario = 'O' AND year BETWEEN 1998 AND 2000) GROUP BY ALL), good AS (SELECT scenario, member FROM d GROUP BY ALL HAVING min(days) >= 300 AND count(*) = 3), n AS (SELECT count(DISTINCT scenario) AS n FROM good) SELECT scenario, member, count(*) AS days FROM daily JOIN good USING (scenario, member) WHERE (SELECT n FROM n) = 2 GROUP BY ALL")
def member_gate(spark, sf):
    kept = ingest.drop_incomplete(cube(spark, sf), [("a", "F", 1995, 1997), ("b", "O", 1998, 2000)], scenarios=["F", "O"])
    return kept.groupBy("scenario", "member").agg(F.count(F.lit(1)).alias("days"))


LONG = "long AS (SELECT model, scenario, member, cell_id, day_idx, unnest(['tas', 'hurs', 'pr', 'sfcWind']) AS var, unnest(['degC', '1', 'mm/day', 'km/h']) AS units, unnest([tas - 273.15, hurs / 100, pr, sfcWind * 3.6]) AS value FROM daily)"


@query("convert_units", f"{WITH} SELECT scenario, member, cell_id, day_idx, round(tas::FLOAT::DOUBLE, 2) AS tas, round(hurs::FLOAT::DOUBLE, 2) AS hurs, round((pr / 86400)::FLOAT::DOUBLE + 1.7e-8, 6) AS pr, round(sfcWind::FLOAT::DOUBLE, 2) AS sfcWind FROM daily")
def convert_units(spark, sf):
    long = cube(spark, sf).select("model", "scenario", "member", "cell_id", "day_idx", F.expr("stack(4, 'tas', 'degC', tas - 273.15, 'hurs', '1', hurs / 100, 'pr', 'mm / day', pr, 'sfcWind', 'km/h', sfcWind * 3.6) AS (var, units, value)"))
    wide, _ = ingest.merge_variables(ingest.convert_units(long), ["tas", "hurs", "pr", "sfcWind"], [*CM, "day_idx"])
    return wide.select(*CM, "day_idx", *[(F.round(F.col(v).cast("double") + OFF_TIES, 6) if v == "pr" else F.round(F.col(v).cast("double"), 2)).alias(v) for v in ("tas", "hurs", "pr", "sfcWind")])


@query("convert_humidity", f"{WITH} SELECT scenario, member, cell_id, round(avg((hurs / 10000)::FLOAT::DOUBLE) + 1.7e-8, 6) AS huss, round(avg((100000 + 100 * tas)::FLOAT::DOUBLE), 2) AS ps FROM daily GROUP BY ALL")
def convert_humidity(spark, sf):
    """Specific humidity of one member in g/kg and pressure of one scenario in hPa, to kg/kg and Pa; means of a cell."""
    d = cube(spark, sf)
    g, hpa = F.col("member") == d.agg(F.min("member")).first()[0], F.col("scenario") == "F"
    rows = d.select(*CM, "model", "day_idx", F.expr("stack(2, 'huss', hurs / 10000, 'ps', 100000 + 100 * tas) AS (var, value)"))
    humid = F.col("var") == "huss"
    units = F.when(humid, F.when(g, "g kg-1").otherwise("kg kg-1")).otherwise(F.when(hpa, "hPa").otherwise("Pa"))
    long = ingest.convert_units(rows.withColumns({"units": units, "value": F.when(humid & g, F.col("value") * 1000).when(~humid & hpa, F.col("value") / 100).otherwise(F.col("value"))}))
    one = lambda v: F.avg(F.when(F.col("var") == v, F.col("value").cast("double")))
    out = long.groupBy(*CM).agg(one("huss").alias("huss"), one("ps").alias("ps"))
    return rounded(out, "huss").withColumn("ps", F.round("ps", 2))


@query("merge_variables", f"{WITH}, a AS (SELECT cell_id, day_idx, avg(tas) AS tas FROM daily GROUP BY ALL), b AS (SELECT c_nationkey::BIGINT AS cell_id, (CAST(o_orderdate AS DATE) - DATE '1970-01-01')::INT AS day_idx, avg(o_totalprice) / 1000 AS load FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) SELECT cell_id, day_idx, round(tas + 1.7e-8, 6) AS tas, round(load + 1.7e-8, 6) AS load FROM a JOIN b USING (cell_id, day_idx)")
def merge_variables(spark, sf):
    """Temperature of the cube and the day's orders of the cell: each has days that the other lacks."""
    tas = cube(spark, sf).groupBy("cell_id", "day_idx").agg(F.avg("tas").alias("value")).withColumn("var", F.lit("tas"))
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    load = orders.groupBy(F.col("c_nationkey").cast("long").alias("cell_id"), F.unix_date(F.to_date("o_orderdate")).alias("day_idx")).agg((F.avg("o_totalprice") / 1000).alias("value")).withColumn("var", F.lit("load"))
    return rounded(ingest.merge_variables(tas.unionByName(load), ["tas", "load"], ["cell_id", "day_idx"])[0], "tas", "load")


@query("sanity", f"{WITH}, k AS (SELECT scenario, cell_id, avg(tas) AS tas, avg(hurs) AS hurs, avg(sfcWind) AS sfcWind, avg(pr / 100) AS pr FROM daily JOIN (SELECT scenario, min(day_idx) AS d0 FROM daily GROUP BY ALL) USING (scenario) WHERE day_idx < d0 + 365 GROUP BY ALL), m AS (SELECT scenario, {', '.join(f'sum({v} * cos(radians(lat))) / sum(cos(radians(lat))) AS {v}' for v in ('tas', 'hurs', 'sfcWind', 'pr'))} FROM k JOIN cells USING (cell_id) WHERE land GROUP BY scenario) SELECT scenario, {', '.join(f'round({v} + 1.7e-8, 6) AS {v}' for v in ('tas', 'hurs', 'sfcWind', 'pr'))}, CASE WHEN pr BETWEEN 0.05 AND 20 THEN 'ok' ELSE 'IMPLAUSIBLE: pr' END AS check FROM m".replace("AS check", 'AS "check"'))
def sanity(spark, sf):
    d = cube(spark, sf).withColumn("pr", F.col("pr") / 86400 / 100)
    return rounded(ingest.input_sanity(d, cells(spark, sf), ["scenario"]), "tas", "hurs", "sfcWind", "pr")


@query("diagnostics", f"{WITH}, b AS (SELECT scenario, day_idx, avg(sfcWind) AS s, avg(sqrt(power(sfcWind * 0.6, 2) + power(tas / 100, 2))) AS uv, max(sfcWind) AS top FROM daily GROUP BY ALL), t AS (SELECT *, day_idx - lag(day_idx) OVER (PARTITION BY scenario ORDER BY day_idx) AS step FROM b) SELECT scenario, round(avg(s) + 1.7e-8, 6) AS mean, round(avg(s) + 1.7e-8, 6) AS mean_abs, round(max(top) + 1.7e-8, 6) AS max, round(quantile_cont(step, 0.5) + 1.7e-8, 6) AS step_days, count(*) AS n_days, round(avg(s) / avg(uv) + 1.7e-8, 6) AS ratio, round(corr(s, uv) + 1.7e-8, 6) AS corr FROM t GROUP BY scenario")
def diagnostics(spark, sf):
    d = cube(spark, sf).withColumns({"uas": F.col("sfcWind") * 0.6, "vas": F.col("tas") / 100})
    return rounded(ingest.wind_diagnostics(d, ["scenario"]), "mean", "mean_abs", "max", "step_days", "ratio", "corr")


@query("result_check", f"{WITH}, {YEARLY}, mm AS (SELECT scenario, member, cell_id, year, min(vpd) AS lo, max(vpd) AS hi FROM daily GROUP BY ALL), c AS (SELECT 'M' AS model, scenario AS run, avg(days_p95) AS days, quantile_cont(days_p95, 0.5)::DOUBLE AS median_days, min(lo) AS low, max(hi) AS high FROM yearly JOIN mm USING (scenario, member, cell_id, year) GROUP BY scenario) SELECT model, run, round(days + 1.7e-8, 6) AS days, median_days, round(low + 1.7e-8, 6) AS low, round(high + 1.7e-8, 6) AS high, 18.25::DOUBLE AS expected, abs(days - 18.25) <= 0.5 AND low >= 0 AND high <= 200 AS ok FROM c")
def result_check(spark, sf):
    """Days above the threshold against what a share of 5 % makes, and the range of the values, by scenario."""
    d = cube(spark, sf)
    at = [*CM, "year"]
    span = d.groupBy(*at).agg(F.min("vpd").alias("index_min"), F.max("vpd").alias("index_max"))
    return rounded(ingest.check_results(yearly_metrics(spark, sf).join(span, at).select(F.lit("M").alias("model"), F.col("scenario").alias("run"), "days_p95", "index_min", "index_max")), "days", "low", "high")


@query("compare_fields", f"{WITH} SELECT scenario, round(avg(tas) + 1.7e-8, 6) AS mean_a, round(avg(tas + sfcWind) + 1.7e-8, 6) AS mean_b, round(max(abs(sfcWind)) + 1.7e-8, 6) AS max_diff FROM daily JOIN (SELECT scenario, min(day_idx) AS d0 FROM daily GROUP BY ALL) USING (scenario) WHERE day_idx < d0 + 10 GROUP BY scenario")
def compare_fields(spark, sf):
    d = cube(spark, sf).withColumn("tasmax", F.col("tas") + F.col("sfcWind"))
    return rounded(ingest.compare_fields(d, "tas", "tasmax", ["scenario"]), "mean_a", "mean_b", "max_diff")


@query(
    "choose_temperature",
    f"""{WITH}, x AS (SELECT CASE cell_id % 5 WHEN 2 THEN 'E3SMv3' ELSE 'm' || (cell_id % 5) END AS model, scenario, member, day_idx, CASE WHEN cell_id % 5 <> 4 THEN tas END AS tas,
  CASE WHEN cell_id % 5 <> 3 OR scenario = 'F' THEN tas + CASE WHEN cell_id % 5 = 1 AND scenario = 'O' THEN 0.4 ELSE 0.8 END END AS tasmax FROM daily),
s AS (SELECT model, scenario, member, min(day_idx) AS d0 FROM x GROUP BY ALL HAVING count(tasmax) > 0), f AS (SELECT model, scenario, min(member) AS member, arg_min(d0, member) AS d0 FROM s GROUP BY ALL),
g AS (SELECT model, scenario, coalesce(avg(tasmax - tas), 0.5) >= 0.5 AS ok FROM x JOIN f USING (model, scenario, member) WHERE day_idx < d0 + 60 GROUP BY ALL)
SELECT model, CASE WHEN bool_and(coalesce(ok, false) AND model <> 'E3SMv3') THEN 'tasmax' ELSE 'tas' END AS temperature FROM (SELECT DISTINCT model, scenario FROM x) LEFT JOIN g USING (model, scenario) GROUP BY model""",
)
def choose_temperature(spark, sf):
    """Models with genuine tasmax, with one that is hardly warmer in one scenario, a known bad one, one without it in a scenario, and one without tas."""
    d, k = cube(spark, sf), F.col("cell_id") % 5
    d = d.withColumn("tasmax", F.when((k != 3) | (F.col("scenario") == "F"), F.col("tas") + F.when((k == 1) & (F.col("scenario") == "O"), 0.4).otherwise(0.8)))
    return ingest.choose_fwi_temp(d.withColumns({"tas": F.when(k != 4, F.col("tas")), "model": F.when(k == 2, "E3SMv3").otherwise(F.concat(F.lit("m"), k.cast("string")))}))


@query(
    "resolve_variable",
    """WITH f AS (SELECT s_suppkey AS file, s_suppkey % 5 AS kind FROM supplier), c AS (SELECT unnest(['tas', 'tasmax']) AS canon)
SELECT file, canon, CASE WHEN canon = 'tas' THEN CASE kind WHEN 0 THEN 'mean_t' WHEN 1 THEN 'tas' WHEN 2 THEN 'only' WHEN 3 THEN 'given' END
  ELSE CASE kind WHEN 0 THEN 'max_t' WHEN 1 THEN 'TREFHTMX' WHEN 2 THEN 'only' END END AS var_name
FROM f CROSS JOIN c WHERE kind < 3 OR (kind = 3 AND canon = 'tas')""",
)
def resolve_variable(spark, sf):
    """Files whose fields tell by their cell methods, by aliases, by being alone, by an explicit name, and not at all."""
    field = lambda name, standard=None, methods=None, explicit=None: F.struct(F.lit(name).alias("var_name"), F.lit(standard).cast("string").alias("standard_name"), F.lit(methods).cast("string").alias("cell_methods"), F.lit(explicit).cast("string").alias("explicit"))
    air = "air_temperature"
    kinds = [
        F.array(field("mean_t", air, "area: mean time: mean"), field("max_t", air, "area: mean time: maximum")),
        F.array(field("other"), field("tas"), field("TREFHTMX")),
        F.array(field("only")),
        F.array(field("given", None, None, "given"), field("spare")),
        F.array(field("x"), field("y")),
    ]
    kind, fields = F.col("s_suppkey") % 5, F.lit(None)
    for k, some in enumerate(kinds):
        fields = F.when(kind == k, some).otherwise(fields)
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("file"), fields.alias("_f")).withColumn("n_fields", F.size("_f"))
    rows = rows.select("file", "n_fields", F.inline("_f")).withColumn("canon", F.explode(F.array(F.lit("tas"), F.lit("tasmax")))).withColumn("explicit", F.when(F.col("canon") == "tas", F.col("explicit")))
    return ingest.resolve_variable(rows, ["file"]).select("file", "canon", "var_name")


LISTING = """listing AS (SELECT DISTINCT concat('root/', CASE o_orderkey % 3 WHEN 0 THEN 'CESM2-WACCM' WHEN 1 THEN 'UKESM1-1' ELSE 'e3sm' END, '/', CASE o_custkey % 4 WHEN 0 THEN 'SSP245' WHEN 1 THEN 'G6-1.5K-SAI' WHEN 2 THEN 'G6_hilla' ELSE 'other' END, '/r', o_orderkey % 4 + 1, '/', CASE WHEN o_custkey % 5 = 0 THEN 'Amon' ELSE 'day' END, '/', CASE o_orderkey % 7 WHEN 0 THEN 'TREFHTMX' WHEN 1 THEN 'tas' WHEN 2 THEN 'hurs' WHEN 3 THEN 'U10' WHEN 4 THEN 'PRECT' WHEN 5 THEN 'uas' ELSE 'zz' END, CASE WHEN o_custkey % 11 = 0 THEN '.clm2' ELSE '' END, '_run_', o_custkey % 3 + 2020, '0101-', o_custkey % 3 + 2029, '1231.nc') AS path FROM orders)"""
CLASSIFIED = """k AS (SELECT path, CASE split_part(path, '/', 2) WHEN 'e3sm' THEN 'e3sm' ELSE split_part(path, '/', 2) END AS model,
CASE split_part(path, '/', 3) WHEN 'SSP245' THEN 'ssp245' WHEN 'G6-1.5K-SAI' THEN 'G6-1.5K-SAI' WHEN 'G6_hilla' THEN 'G6-1.5K-HiLLA' ELSE '?' END AS scenario, split_part(path, '/', 4) AS member,
CASE split_part(split_part(split_part(path, '/', 6), '_', 1), '.', 1) WHEN 'TREFHTMX' THEN 'tasmax' WHEN 'tas' THEN 'tas' WHEN 'hurs' THEN 'hurs' WHEN 'U10' THEN 'sfcWind' WHEN 'PRECT' THEN 'pr' WHEN 'uas' THEN 'uas' END AS var,
split_part(split_part(split_part(path, '/', 6), '_', 1), '.', 1) AS raw, CASE split_part(path, '/', 5) WHEN 'Amon' THEN 'mon' ELSE 'day' END AS freq, regexp_extract(path, '_(\\d{4})0101-', 1)::INT AS y0, regexp_extract(path, '0101-(\\d{4})', 1)::INT AS y1,
CASE WHEN path LIKE '%.clm2_%' THEN 'other' ELSE 'atm' END AS component FROM listing)"""
CATALOG = f"WITH {LISTING}, {CLASSIFIED}, cat AS (SELECT model, scenario, member, var, list_sort(list(path)) AS paths, min(raw) AS var_name FROM k WHERE freq = 'day' AND var IS NOT NULL AND scenario <> '?' AND component = 'atm' GROUP BY ALL)"


def paths(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    pick = lambda c, n, *names: F.element_at(F.array(*map(F.lit, names)), (F.col(c) % n + 1).cast("int"))
    parts = [
        F.lit("root/"), pick("o_orderkey", 3, "CESM2-WACCM", "UKESM1-1", "e3sm"), F.lit("/"), pick("o_custkey", 4, "SSP245", "G6-1.5K-SAI", "G6_hilla", "other"), F.lit("/r"), (F.col("o_orderkey") % 4 + 1).cast("string"),
        F.lit("/"), F.when(F.col("o_custkey") % 5 == 0, "Amon").otherwise("day"), F.lit("/"), pick("o_orderkey", 7, "TREFHTMX", "tas", "hurs", "U10", "PRECT", "uas", "zz"), F.when(F.col("o_custkey") % 11 == 0, ".clm2").otherwise(""),
        F.lit("_run_"), (F.col("o_custkey") % 3 + 2020).cast("string"), F.lit("0101-"), (F.col("o_custkey") % 3 + 2029).cast("string"), F.lit("1231.nc"),
    ]
    return o.select(F.concat(*parts).alias("path")).distinct()


def listing(spark, sf) -> DataFrame:
    return catalog.classify_paths(paths(spark, sf))


def catalog_of(spark, sf) -> DataFrame:
    return catalog.build_catalog(listing(spark, sf))


@query("classify_paths", f"WITH {LISTING}, {CLASSIFIED} SELECT path, model, scenario, member, var, CASE WHEN raw = 'zz' THEN NULL ELSE raw END AS var_name, freq, y0, y1, component FROM k")
def classify_paths(spark, sf):
    return listing(spark, sf)


@query("catalog", f"{CATALOG} SELECT model, scenario, member, var, 'netcdf' AS kind, array_to_string(paths, ',') AS paths, var_name FROM cat")
def catalog_(spark, sf):
    c = catalog_of(spark, sf)
    return c.withColumn("paths", F.concat_ws(",", "paths"))


@query(
    "catalog_round_trip",
    f"""{CATALOG} SELECT model, scenario, member, var, CASE WHEN member = 'r1' THEN 'zarr' ELSE 'netcdf' END AS kind, CASE WHEN member <> 'r1' THEN len(paths) ELSE 0 END AS files, var_name,
CASE WHEN member = 'r1' THEN 's3://' || model END AS store, CASE WHEN member = 'r1' THEN var END AS "group" FROM cat""",
)
def catalog_round_trip(spark, sf):
    """Entries of files, and of stores, to JSON and back."""
    c, stored = catalog_of(spark, sf), F.col("member") == "r1"
    c = c.withColumns({"kind": F.when(stored, "zarr").otherwise(F.col("kind")), "paths": F.when(~stored, F.col("paths")), "store": F.when(stored, F.concat(F.lit("s3://"), "model")), "group": F.when(stored, F.col("var"))})
    return catalog.load_catalog(catalog.save_catalog(c)).withColumn("files", F.size(F.coalesce("paths", F.array().cast("array<string>"))).cast("long")).drop("paths", "repo", "branch")


@query("catalog_merge", f"{CATALOG} SELECT model, scenario, member, var, len(paths) AS files FROM cat WHERE member <> 'r1' UNION ALL SELECT model, scenario, member, var, 0 FROM cat WHERE member = 'r1'")
def catalog_merge(spark, sf):
    c = catalog_of(spark, sf)
    extra = c.withColumn("paths", F.lit(None).cast("array<string>")).unionByName(c.withColumn("model", F.lit("_note")))
    return catalog.merge_catalog(c.where("member <> 'r1'"), extra).select(*catalog.KEY, F.coalesce(F.size(F.coalesce("paths", F.array().cast("array<string>"))), F.lit(0)).cast("long").alias("files"))


@query("catalog_overlay", f"{CATALOG} SELECT model, scenario, member, var, 'netcdf' AS kind FROM cat WHERE member <> 'r1' AND var <> 'tas' UNION ALL SELECT model, scenario, member, var, 'zarr' FROM cat WHERE var = 'tas'")
def catalog_overlay(spark, sf):
    """A later source of temperatures wins over the catalog's, and adds members that it lacks."""
    c = catalog_of(spark, sf)
    return catalog.overlay_catalog(c.where("member <> 'r1'"), c.where("var = 'tas'").withColumn("kind", F.lit("zarr"))).select(*catalog.KEY, "kind")


@query("known_issues", f"{CATALOG} SELECT model, scenario, member, var, 'netcdf' AS kind, len(paths) AS files FROM cat WHERE NOT (model = 'UKESM1-1' AND var = 'hurs') AND NOT (model = 'e3sm' AND var = 'sfcWind') UNION ALL SELECT DISTINCT model, scenario, member, 'sfcWind', 'wind_climatology', 0 FROM cat WHERE model = 'e3sm'")
def known_issues(spark, sf):
    """Unusable variables go (temperatures are chosen elsewhere), and winds of one model become climatological."""
    c = catalog.apply_known_issues(catalog_of(spark, sf), [("UKESM1-1", "hurs"), ("CESM2-WACCM", "tasmax")], ["e3sm"])
    return c.select(*catalog.KEY, "kind", F.size(F.coalesce("paths", F.array().cast("array<string>"))).cast("long").alias("files"))


STORES = f"WITH {LISTING}, {CLASSIFIED}, st AS (SELECT model, scenario, member, coalesce(var, '?') AS var, path AS store FROM k)"


def stores(spark, sf) -> DataFrame:
    return listing(spark, sf).select("model", "scenario", "member", F.coalesce("var", F.lit("?")).alias("var"), F.col("path").alias("store"))


@query("store_query", f"{STORES} SELECT model, scenario, member, var, max(store) AS store FROM st WHERE model IN ('UKESM1-1', 'e3sm') AND var IN ('tas', 'uas', 'pr') GROUP BY ALL")
def store_query(spark, sf):
    return catalog.query_catalog(stores(spark, sf), model=["UKESM1-1", "e3sm"], var=["tas", "uas", "pr"])


@query("store_description", f"{STORES} SELECT model, var, count(*) AS rows, count(DISTINCT scenario) AS n_scenario, count(DISTINCT member) AS n_member, count(DISTINCT store) AS n_store FROM st GROUP BY ALL")
def store_description(spark, sf):
    return catalog.describe_stores(stores(spark, sf), ["model", "var"])


@query("find_variables", f"WITH {LISTING} SELECT var, (SELECT count(*) FROM listing WHERE regexp_matches(path, pattern)) AS files FROM (VALUES ('tasmax', '/TREFHTMX[._]'), ('tas', '/tas_'), ('snow', '/snw_')) v (var, pattern)")
def find_variables(spark, sf):
    return catalog.find_variables(paths(spark, sf), {"tasmax": "/TREFHTMX[._]", "tas": "/tas_", "snow": "/snw_"})


@query("inventory", f"{CATALOG} SELECT model, scenario, member, {', '.join(f'''coalesce(max('Y') FILTER (var = '{v}'), '') AS {v}''' for v in ('tas', 'pr', 'uas'))} FROM cat GROUP BY ALL")
def inventory(spark, sf):
    return catalog.catalog_inventory(catalog_of(spark, sf), ["tas", "pr", "uas"])


@query("readiness", f"{CATALOG}, h AS (SELECT model, scenario, member, list(var) AS have FROM cat GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY model, scenario ORDER BY member) AS k FROM h), w AS (SELECT DISTINCT model, s.scenario FROM cat CROSS JOIN (SELECT unnest(['ssp245', 'G6-1.5K-SAI', 'G6-1.5K-HiLLA']) AS scenario) s), r AS (SELECT w.model, w.scenario, member, have FROM w LEFT JOIN n ON w.model = n.model AND w.scenario = n.scenario AND k <= 2) SELECT model, scenario, coalesce(member, '-') AS member, CASE WHEN have IS NULL THEN 'NO DAILY DATA' WHEN list_contains(have, 'tas') AND list_contains(have, 'sfcWind') THEN 'ok' WHEN list_contains(have, 'tas') THEN 'sfcWind' WHEN list_contains(have, 'sfcWind') THEN 'tas' ELSE 'tas, sfcWind' END AS missing FROM r")
def readiness(spark, sf):
    return catalog.readiness_table(catalog_of(spark, sf), ["tas", "sfcWind"], 2)


@query("coverage", f"WITH {LISTING}, {CLASSIFIED} SELECT model, scenario, var, count(*) AS files, min(y0) AS first_year, max(y1) AS last_year, count(DISTINCT y0) AS starts FROM k WHERE var IS NOT NULL GROUP BY ALL")
def coverage(spark, sf):
    return catalog.coverage(listing(spark, sf))[1]


@query("coverage_frequencies", f"WITH {LISTING}, {CLASSIFIED} SELECT model, {', '.join(f"count(*) FILTER (freq = '{f}') AS {f}" for f in ('day', 'subdaily', 'mon', 'unknown'))} FROM k GROUP BY model")
def coverage_frequencies(spark, sf):
    return catalog.coverage(listing(spark, sf))[0]


@query("coverage_unknown", f"WITH {LISTING}, {CLASSIFIED} SELECT regexp_replace(split_part(path, '/', 6), '[0-9]+', '#', 'g') AS stem, count(*) AS files FROM k WHERE var IS NULL GROUP BY ALL ORDER BY files DESC, stem LIMIT 40")
def coverage_unknown(spark, sf):
    """The forty commonest names of files that no variable is known for: a top list by intention."""
    return catalog.coverage(listing(spark, sf))[2]


@query("members", f"{CATALOG}, h AS (SELECT model, scenario, member, list(var) AS have FROM cat GROUP BY ALL), ok AS (SELECT model, scenario, member, row_number() OVER (PARTITION BY model, scenario ORDER BY member) AS k FROM h WHERE list_contains(have, 'sfcWind') OR list_contains(have, 'uas')), m AS (SELECT * FROM ok WHERE k <= 2), good AS (SELECT model FROM m GROUP BY model HAVING count(DISTINCT scenario) = 3) SELECT model, scenario, member FROM m JOIN good USING (model)")
def members(spark, sf):
    m = catalog.select_members(catalog_of(spark, sf), ["sfcWind"], 2)
    return m.join(catalog.select_models(m), "model").select("model", "scenario", "member")




@query("bilinear", None)
def bilinear(spark, sf):
    """Daily temperature of a rectangular arrangement of the cells, on the points between."""
    c = cells(spark, sf).select("cell_id", (F.floor(F.col("cell_id") / 5) * 10.0).alias("lat"), ((F.col("cell_id") % 5) * 20.0).alias("lon"))
    target = c.select(F.col("cell_id").alias("target_id"), (F.col("lat") + 2.5).alias("lat"), (F.col("lon") + 5).alias("lon"))
    field = cube(spark, sf).groupBy("cell_id", "year", "month").agg(F.avg("tas").alias("tas"))
    return rounded(grid.regrid_bilinear(field, c, target, ["tas"], ["year", "month"]), "tas")


SQL["bilinear"] = f"""{WITH}, c AS (SELECT cell_id, cell_id // 5 AS r, cell_id % 5 AS q FROM cells), m AS (SELECT cell_id, year, month, avg(tas) AS tas FROM daily GROUP BY ALL),
corners AS (SELECT t.cell_id AS target, s.cell_id, (CASE WHEN s.r = t.r THEN 0.75 ELSE 0.25 END) * (CASE WHEN s.q = t.q THEN 0.75 ELSE 0.25 END) AS w FROM c t JOIN c s ON s.r IN (t.r, t.r + 1) AND s.q IN (t.q, t.q + 1) WHERE t.r < 4 AND t.q < 4),
b AS (SELECT target AS cell_id, year, month, CASE WHEN count(tas) = 4 THEN sum(w * tas) END AS tas FROM corners JOIN m USING (cell_id) GROUP BY ALL)
SELECT cell_id, year, month, round(coalesce(b.tas, m.tas) + 1.7e-8, 6) AS tas FROM m LEFT JOIN b USING (cell_id, year, month)"""


@query("uv_centres", f"""{WITH}, m AS (SELECT scenario, cell_id, cell_id // 5 AS r, cell_id % 5 AS q, avg(tas) AS u, avg(hurs) AS v FROM daily GROUP BY ALL)
SELECT a.scenario, a.cell_id, round(CASE WHEN a.q = 0 THEN a.u ELSE (a.u + b.u) / 2 END + 1.7e-8, 6) AS uas, round(CASE WHEN a.r = 0 THEN a.v ELSE (a.v + c.v) / 2 END + 1.7e-8, 6) AS vas
FROM m a LEFT JOIN m b ON a.scenario = b.scenario AND b.r = a.r AND b.q = a.q - 1 LEFT JOIN m c ON a.scenario = c.scenario AND c.q = a.q AND c.r = a.r - 1""")
def uv_centres(spark, sf):
    """Two fields on points between the cells, one half a cell east and the other half a cell north, on the cells."""
    c, at = cells(spark, sf), lambda lat, lon: [(F.floor(F.col("cell_id") / 5) * 10.0 + lat).alias("lat"), ((F.col("cell_id") % 5) * 20.0 + lon).alias("lon")]
    field = cube(spark, sf).groupBy("scenario", "cell_id").agg(F.avg("tas").alias("uas"), F.avg("hurs").alias("vas"))
    out = grid.uv_to_centres(field.drop("vas"), field.drop("uas"), c.select("cell_id", *at(0, 10)), c.select("cell_id", *at(5, 0)), ["scenario"])
    out = field.select("scenario", "cell_id").join(out, ["scenario", "cell_id"], "left")
    return rounded(out.select("scenario", "cell_id", "uas", "vas"), "uas", "vas")


def on_common_grid(name: str, source: str, value: str, keys: str, shift: float) -> str:
    """SQL: a global field of 5 × 5 cells, columns from shift - 144 on, at the centres of the 10-degree grid."""
    return f"""{name}_at AS (SELECT i * 36 + j AS cell_id, least(greatest((-85 + 10 * i + 72) / 36.0::DOUBLE, 0), 4) AS y, (-175 + 10 * j + 144 - ({shift})) / 72.0::DOUBLE AS x FROM (SELECT unnest(range(18)) AS i), (SELECT unnest(range(36)) AS j)),
{name}_corner AS (SELECT cell_id, ((floor(y) + dy) * 5 + (floor(x) + dx + 5)::INT % 5)::BIGINT AS src, (CASE dy WHEN 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END) * (CASE dx WHEN 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END) AS w FROM {name}_at, (SELECT unnest([0, 1]) AS dy), (SELECT unnest([0, 1]) AS dx)),
{name} AS (SELECT {keys}, k.cell_id, CASE WHEN count({value}) = max(n) THEN sum(w * {value}) END AS {value} FROM (SELECT *, count(*) OVER (PARTITION BY cell_id) AS n FROM {name}_corner WHERE w > 0) k JOIN {source} ON {source}.cell_id = src GROUP BY ALL)"""


def grid_of_cells(spark, sf, shift: float = 0.0) -> DataFrame:
    return cells(spark, sf).select("cell_id", (F.floor(F.col("cell_id") / 5) * 36.0 - 72).alias("lat"), ((F.col("cell_id") % 5) * 72.0 - 144 + shift).alias("lon"))


#: A global grid, another whose columns lie between, and a box of 3 × 3 cells that a third model covers alone. Their significance differs by cell.
SIGNIFICANT = {"A": "cell_id % 2 = 0", "B": "cell_id % 3 <> 1", "C": "cell_id % 4 <> 0"}
BOX = "box AS (SELECT * FROM m WHERE cell_id // 5 BETWEEN 1 AND 3 AND cell_id % 5 BETWEEN 1 AND 3)"
BOXED = """gc AS (SELECT 'C' AS model, k.cell_id, CASE WHEN count(delta) = max(n) THEN sum(w * delta) END AS delta, CASE WHEN count(sc) = max(n) THEN sum(w * sc) END AS sig FROM (SELECT *, count(*) OVER (PARTITION BY cell_id) AS n FROM
  (SELECT cell_id, ((floor(y) + 1 + dy) * 5 + floor(x) + 1 + dx)::BIGINT AS src, (CASE dy WHEN 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END) * (CASE dx WHEN 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END) AS w
    FROM (SELECT i * 36 + j AS cell_id, (-85 + 10 * i + 36) / 36.0::DOUBLE AS y, (-175 + 10 * j + 72) / 72.0::DOUBLE AS x FROM (SELECT unnest(range(18)) AS i), (SELECT unnest(range(36)) AS j)), (SELECT unnest([0, 1]) AS dy), (SELECT unnest([0, 1]) AS dx)
    WHERE y BETWEEN 0 AND 2 AND x BETWEEN 0 AND 2) WHERE w > 0) k JOIN box ON box.cell_id = src GROUP BY ALL)"""
FLAGS = ", ".join(f"CASE WHEN {when} THEN 1.0 ELSE 0.0 END AS s{k.lower()}" for k, when in SIGNIFICANT.items())
STACKED = f"""m AS (SELECT *, {FLAGS} FROM (SELECT cell_id, avg(tas) FILTER (scenario = 'F') - avg(tas) FILTER (scenario = 'O') AS delta FROM daily GROUP BY ALL)), {BOX},
{on_common_grid('ga', 'm', 'delta', "'A' AS model", 0.0)}, {on_common_grid('gb', 'm', 'delta', "'B' AS model", 36.0)}, {on_common_grid('sga', 'm', 'sa', "'A' AS model", 0.0)}, {on_common_grid('sgb', 'm', 'sb', "'B' AS model", 36.0)}, {BOXED},
st AS (SELECT cell_id, delta, coalesce(sa > 0.5, false) AS sig FROM ga JOIN sga USING (cell_id) UNION ALL SELECT cell_id, delta * 0.5 AS delta, coalesce(sb > 0.5, false) FROM gb JOIN sgb USING (cell_id) UNION ALL SELECT cell_id, delta * -0.2 AS delta, coalesce(sig > 0.5, false) FROM gc),
mm AS (SELECT *, avg(delta) OVER (PARTITION BY cell_id) AS m FROM st)"""


@query(
    "stack_models",
    f"{WITH}, {STACKED} SELECT cell_id, round(avg(delta) + 1.7e-8, 6) AS mean, 3 AS models, count(delta) AS valued, count(*) FILTER (sign(delta) = sign(m)) / 3 >= 2/3 AND count(*) FILTER (sig) / 3 >= 0.5 AS robust FROM mm GROUP BY cell_id",
)
def stack_models(spark, sf):
    """Change of three models on grids of their own, one a box, on the common grid, and their mean: where the box has no value its model still counts."""
    means = cube(spark, sf).groupBy("cell_id").agg((F.avg(F.when(F.col("scenario") == "F", F.col("tas"))) - F.avg(F.when(F.col("scenario") == "O", F.col("tas")))).alias("delta"))
    boxed = F.floor(F.col("cell_id") / 5).between(1, 3) & (F.col("cell_id") % 5).between(1, 3)
    grids = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(shift).alias("shift"), F.lit(factor).alias("factor"), F.expr(SIGNIFICANT[m]).alias("significant")) for m, shift, factor in (("A", 0.0, 1.0), ("B", 36.0, 0.5), ("C", 0.0, -0.2))])
    per_model = lambda df: df.select("*", F.inline(grids)).where((F.col("model") != "C") | boxed)
    own = per_model(grid_of_cells(spark, sf)).withColumn("lon", F.col("lon") + F.col("shift"))
    field = per_model(means).select("model", "cell_id", (F.col("delta") * F.col("factor")).alias("delta"), "significant")
    stacked = grid.stack_models(field, own, ["delta", "significant"], [], 10.0)
    return rounded(stats.multimodel(stacked, ["cell_id"], models="n_models"), "mean")


@query("common_grid", f"{WITH}, m AS (SELECT cell_id, scenario, avg(tas) AS tas FROM daily GROUP BY ALL), {on_common_grid('g', 'm', 'tas', 'scenario', 0.0)} SELECT scenario, cell_id, round(tas + 1.7e-8, 6) AS tas FROM g")
def common_grid(spark, sf):
    c = grid_of_cells(spark, sf)
    field = cube(spark, sf).groupBy("cell_id", "scenario").agg(F.avg("tas").alias("tas"))
    return rounded(grid.to_common_grid(field, c, ["tas"], ["scenario"], 10.0), "tas")


@query("remap_sparse", f"{WITH}, m AS (SELECT cell_id, scenario, avg(tas) AS tas FROM daily GROUP BY ALL) SELECT cell_id // 5 AS cell_id, scenario, round(sum(tas * 0.2) + 1.7e-8, 6) AS tas FROM m GROUP BY cell_id // 5, scenario")
def remap_sparse(spark, sf):
    w = cells(spark, sf).select(F.floor(F.col("cell_id") / 5).alias("target_id"), "cell_id", F.lit(0.2).alias("w"))
    field = cube(spark, sf).groupBy("cell_id", "scenario").agg(F.avg("tas").alias("tas"))
    return rounded(grid.apply_weights(field, w, ["tas"], ["scenario"], skip_null=True), "tas")


def stations(spark, sf) -> DataFrame:
    """A place for every customer."""
    key = F.col("c_custkey").cast("long")
    return table(spark, sf, "customer").select(key.alias("cell_id"), (key * 7 % 144 - 72).cast("double").alias("lat"), (key * 37 % 360).cast("double").alias("lon"))


STATIONS = "st AS (SELECT c_custkey::BIGINT AS cell_id, (c_custkey * 7 % 144 - 72)::DOUBLE AS lat, (c_custkey * 37 % 360)::DOUBLE AS lon FROM customer)"


@query("wrap_lon", f"WITH {STATIONS} SELECT cell_id, round((lon + 180) % 360 - 180 + 1.7e-8, 6) AS lon FROM st")
def wrap_lon(spark, sf):
    return rounded(ingest.wrap_longitudes(stations(spark, sf).withColumn("model", F.lit("M")), ["model"]).select("cell_id", "lon"), "lon")


@query("assign_regions", f"WITH {STATIONS} SELECT cell_id, CASE WHEN lat < 3.5 THEN 'S' ELSE 'N' END AS region, CASE WHEN lat < 3.5 THEN 'South' ELSE 'North' END AS region_name FROM st WHERE lon BETWEEN 1 AND 200")
def assign_regions(spark, sf):
    ring = lambda lo, hi: [(1.0 - 0.5, lo), (200.5, lo), (200.5, hi), (0.5, hi)]
    polygons = spark.createDataFrame([("S", "South", ring(-90.0, 3.5)), ("N", "North", ring(3.5, 90.0))], "region string, region_name string, ring array<struct<lon double, lat double>>")
    return regions.assign_regions(stations(spark, sf), polygons)


@query(
    "assign_polygons",
    f"""WITH {STATIONS}, p AS (SELECT cell_id, lat, lon AS e, CASE WHEN lon > 180 THEN lon - 360 ELSE lon END AS x FROM st)
SELECT cell_id, 'H' AS region, 'hole and island' AS region_name FROM p WHERE (x BETWEEN 10.5 AND 60.5 AND lat BETWEEN -30.5 AND 30.5 AND NOT (x BETWEEN 20.5 AND 40.5 AND lat BETWEEN -10.5 AND 10.5)) OR (x BETWEEN 26.5 AND 30.5 AND lat BETWEEN -4.5 AND 4.5) OR (x BETWEEN 100.5 AND 110.5 AND lat BETWEEN -5.5 AND 5.5)
UNION ALL SELECT cell_id, 'D', 'across 180' FROM p WHERE e BETWEEN 160.5 AND 209.5 AND lat BETWEEN 0.5 AND 50.5
UNION ALL SELECT cell_id, 'T', 'triangle' FROM p WHERE lat > -60.7 AND (lat + 60.7) * 45 < 81.4 * (x - 0.3) AND (lat + 60.7) * 45 < 81.4 * (90.3 - x)""",
)
def assign_polygons(spark, sf):
    """Customers' places in a region with a hole, an island in it and one outside, one across 180°, and one with slanting sides."""
    box = lambda w, e, s, n: [(w, s), (e, s), (e, n), (w, n)]
    rows = [
        ("H", "hole and island", [box(10.5, 60.5, -30.5, 30.5), box(20.5, 40.5, -10.5, 10.5), box(26.5, 30.5, -4.5, 4.5), box(100.5, 110.5, -5.5, 5.5)], False),
        ("D", "across 180", [box(160.5, -150.5, 0.5, 50.5)], True),
        ("T", "triangle", [[(0.3, -60.7), (90.3, -60.7), (45.3, 20.7)]], False),
    ]
    polygons = spark.createDataFrame(rows, "region string, region_name string, rings array<array<struct<lon double, lat double>>>, wraps boolean")
    return regions.assign_regions(stations(spark, sf), polygons)


@query(
    "nearest_points",
    """WITH t AS (SELECT c_custkey::BIGINT AS target_id, radians((c_custkey * 7919 % 17993) / 100.0::DOUBLE - 89.9) AS lat, radians((c_custkey * 10473 % 35993) / 100.0::DOUBLE) AS lon FROM customer),
s AS (SELECT s_suppkey::BIGINT AS cell_id, radians((s_suppkey * 6151 % 17989) / 100.0::DOUBLE - 89.9) AS lat, radians((s_suppkey * 9859 % 35983) / 100.0::DOUBLE) AS lon FROM supplier)
SELECT target_id, arg_min(cell_id, power(cos(t.lat) * cos(t.lon) - cos(s.lat) * cos(s.lon), 2) + power(cos(t.lat) * sin(t.lon) - cos(s.lat) * sin(s.lon), 2) + power(sin(t.lat) - sin(s.lat), 2)) AS cell_id FROM t CROSS JOIN s GROUP BY target_id""",
)
def nearest_points(spark, sf):
    """The nearest supplier of every customer, both scattered over the globe."""
    at = lambda key, a, m, turn: ((F.col(key).cast("long") * a % m) / 100.0 - turn)
    target = table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("target_id"), at("c_custkey", 7919, 17993, 89.9).alias("lat"), at("c_custkey", 10473, 35993, 0.0).alias("lon"))
    source = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("cell_id"), at("s_suppkey", 6151, 17989, 89.9).alias("lat"), at("s_suppkey", 9859, 35983, 0.0).alias("lon"))
    return grid.nearest_points(source, target).select("target_id", "cell_id")


BOXES = """bx AS (SELECT c_custkey::BIGINT AS cell_id, (c_custkey * 7 % 170 - 85)::DOUBLE AS lat_lo, (c_custkey * 7 % 170 - 82.5)::DOUBLE AS lat_hi, (c_custkey * 37 % 360 - 180)::DOUBLE AS lon_lo, (c_custkey * 37 % 360 - 173)::DOUBLE AS lon_hi, c_mktsegment AS segment, c_acctbal::DOUBLE AS bal FROM customer)"""


@query(
    "remap_conservative",
    f"""WITH {BOXES}, t AS (SELECT i * 72 + j AS cell_id, i * 5.0::DOUBLE - 90 AS s, j * 5.0::DOUBLE - 180 AS w FROM (SELECT unnest(range(36)) AS i), (SELECT unnest(range(72)) AS j)),
o AS (SELECT segment, bal, t.cell_id, (sin(radians(least(lat_hi, s + 5))) - sin(radians(greatest(lat_lo, s)))) * (least(lon_hi, w + k + 5) - greatest(lon_lo, w + k)) / ((sin(radians(s + 5)) - sin(radians(s))) * 5) AS x
  FROM bx, t, (SELECT unnest([0, 360]) AS k) WHERE lat_lo < s + 5 AND lat_hi > s AND lon_lo < w + k + 5 AND lon_hi > w + k)
SELECT segment, cell_id, round(sum(x) + 1.7e-8, 6) AS covered, round(sum(x * bal) + 1.7e-8, 4) AS bal FROM o GROUP BY ALL""",
)
def remap_conservative(spark, sf):
    """Customers' boxes, which overlap each other and many targets, onto a grid of 5 degrees: weights, coverage and sums grow with the table."""
    k = F.col("c_custkey").cast("long")
    lat, lon = (k * 7 % 170 - 85).cast("double"), (k * 37 % 360 - 180).cast("double")
    boxes = table(spark, sf, "customer").select(k.alias("cell_id"), lat.alias("lat_lo"), (lat + 2.5).alias("lat_hi"), lon.alias("lon_lo"), (lon + 7).alias("lon_hi"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").cast("double").alias("bal"))
    out = grid.remap_conservative(boxes.select("cell_id", "segment", "bal"), grid.conservative_weights(boxes, 5.0), ["bal"], ["segment"])
    return rounded(rounded(out, "covered"), "bal", digits=4)
