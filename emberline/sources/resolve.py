"""Where each variable of a member comes from: read off the catalog as a plan table, and carried out on the daily table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.physics import rh_from_huss, wind_speed
from emberline.operators.grid import lookup_doy
from emberline.operators.season import wind_climatology
from emberline.schema import TARGET_PERIOD
from emberline.sources.catalog import ALTERNATES, literals

#: Variables that a member may lack, and the scenario whose wind stands in.
OPTIONAL, DONOR_SCENARIO = ["hursmin", "tasmax", "tas"], "ssp245"
MEMBER = ["model", "scenario", "member"]


def plan_inputs(catalog: DataFrame, variables: list[str], donor_scenario: str = DONOR_SCENARIO) -> DataFrame:
    """(model, scenario, member, var, how, uses, donor) for every member of the catalog and wanted variable.

    how: ``climatology`` if the catalog says so (the donor is then the model's first member of donor_scenario with both wind components, null if
    there is none), ``file`` if it has the variable, ``derived`` if it has all that the variable follows from (uses), ``absent`` if the
    variable is optional, else ``missing``."""
    have = catalog.groupBy(*MEMBER).agg(F.collect_set("var").alias("_have"), F.collect_set(F.when(F.col("kind") == "wind_climatology", F.col("var"))).alias("_clim"))
    donors = have.where((F.col("scenario") == donor_scenario) & F.array_contains("_have", "uas") & F.array_contains("_have", "vas")).groupBy("model").agg(F.min("member").alias("donor"))
    uses = F.lit(None).cast("array<string>")
    for v, parts in ALTERNATES.items():
        uses = F.when(F.col("var") == v, literals(parts)).otherwise(uses)
    rows = have.select("*", F.explode(literals(variables)).alias("var")).withColumn("_uses", uses).join(donors, "model", "left")
    derived = F.coalesce(F.size(F.array_except("_uses", "_have")) == 0, F.lit(False))
    how = F.when(F.array_contains("_clim", F.col("var")), "climatology").when(F.array_contains("_have", F.col("var")), "file").when(derived, "derived").when(F.col("var").isin(OPTIONAL), "absent").otherwise("missing")
    rows = rows.withColumn("how", how)
    return rows.select(*MEMBER, "var", "how", F.when(F.col("how") == "derived", F.col("_uses")).alias("uses"), F.when(F.col("how") == "climatology", F.col("donor")).alias("donor"))


def donors_of(plan: DataFrame) -> DataFrame:
    """(model, member): whose wind stands in for a model's."""
    return plan.where("how = 'climatology' AND donor IS NOT NULL").select("model", F.col("donor").alias("member")).distinct()


def resolve_inputs(daily: DataFrame, plan: DataFrame, ratio: DataFrame | None = None, donor_scenario: str = DONOR_SCENARIO, years: tuple[int, int] = TARGET_PERIOD) -> DataFrame:
    """daily with sfcWind and hurs from where the plan says; members with a missing variable, or a climatology without a donor, are an error where their rows are met.

    A file's values stay as they are. Derived wind is the speed of the components, times the monthly ratio of the cell (model, cell_id, month, ratio) where one is
    known; derived humidity follows from huss, ps and tas. Climatological wind is the donor's, by day of year, of the given years, for all
    days, whatever the member's own files hold. Members that the plan lacks are left out; variables that it doesn't want are untouched."""
    lacking = [c for c in ("sfcWind", "hurs", "uas", "vas", "huss", "ps", "tas") if c not in daily.columns]
    rows = daily.withColumns({c: F.lit(None).cast("double") for c in lacking})
    bad = F.array_join(F.sort_array(F.collect_list(F.when((F.col("how") == "missing") | ((F.col("how") == "climatology") & F.col("donor").isNull()), F.col("var")))), ", ")
    # A row per member.
    wide = plan.groupBy(*MEMBER).agg(*[F.max(F.when(F.col("var") == v, F.col("how"))).alias(f"_{v}") for v in ("sfcWind", "hurs")], bad.alias("_bad"))
    climate = wind_climatology(rows, donors_of(plan), ["model", "cell_id"], donor_scenario, years).select("model", "cell_id", "doy", F.col("sfcWind").alias("_clim"))
    both = lookup_doy(rows.join(wide, MEMBER), climate, ["model", "cell_id"], ["_clim"])
    factor = F.lit(1.0)
    if ratio is not None:
        both, factor = both.join(ratio.select("model", "cell_id", "month", F.col("ratio").alias("_ratio")), ["model", "cell_id", "month"], "left"), F.coalesce("_ratio", F.lit(1.0))
    speed = wind_speed(F.col("uas"), F.col("vas"), factor).cast("float")
    wind = F.when(F.col("_sfcWind") == "climatology", F.col("_clim")).when(F.col("_sfcWind") == "derived", speed).otherwise(F.col("sfcWind"))
    humid = F.when(F.col("_hurs") == "derived", rh_from_huss(F.col("tas"), F.col("huss"), F.col("ps")).cast("float")).otherwise(F.col("hurs"))
    label = F.concat_ws("/", *MEMBER)
    checked = lambda x: F.when(F.col("_bad") == "", x).otherwise(F.raise_error(F.concat(label, F.lit(": no source for "), F.col("_bad"))))
    out = both.withColumns({"sfcWind": checked(wind), "hurs": humid})
    return out.select(*daily.columns, *[c for c in ("sfcWind", "hurs") if c not in daily.columns])
