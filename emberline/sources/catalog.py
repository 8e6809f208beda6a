"""From archive paths to a catalog of daily series, and from the catalog to members and models that are ready."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.schema import CANON, CATALOG_JSON, SCENARIOS

KEY = ["model", "scenario", "member", "var"]
#: Where the entries of other kinds than files are.
STORE = ["store", "group", "repo", "branch"]

# Tokens and patterns by which archives tell models, frequencies, components, scenarios and members.
MODELS = ["CESM2-WACCM", "UKESM1-1", "UKESM1-0-LL", "MIROC-ES2H", "E3SMv3", "E3SM", "MPI-ESM1-2-LR", "MPI-ESM1-2-HR", "GISS-E2-1-G", "IPSL-CM6A-LR", "CNRM-ESM2-1"]
MODEL_ALIASES = {"E3SM": "E3SMv3", "UKESM1-1-LL": "UKESM1-1"}
DAY = ["day", "DAY", "Day", "daily", "Daily", "h1", "day_mean"]
SUBDAILY = ["3hr", "6hr", "1hr", "E3hr", "CF3hr", "E1hr", "6hrPlev", "6hrLev", "3hrPt", "1hrPt", "hourly", "3h", "6h", "1h", "ap8"]
MONTHLY = ["Amon", "AMON", "Mon", "mon", "h0", "monthly", "Emon", "Lmon", "LMON", "OMON", "IMON"]
NON_ATMOS = ["LDAY", "LMON", "ODAY", "OMON", "IDAY", "IMON", "Lmon", "Omon", "SImon", "SIday", "Oday", "clm2", "pop", "cice", "elm", "mpaso", "mpassi", "cpl", "mosart", "rtm"]
SCENARIO_PATTERNS = [
    ("baseline", "ssp245"),
    ("hilla|ds27[5]|ds28[67]", "G6-1.5K-HiLLA"),
    ("di189|di86[45]", "G6-1.5K-SAI"),
    (r"g6.{0,12}(sai|sulfur)|[._\-]sai[._\-/]|g6sulfur", "G6-1.5K-SAI"),
    (r"ssp2-?4\.?5|ssp245", "ssp245"),
]
MEMBER_PATTERNS = [
    (r"(r\d+i\d+p\d+f\d+)", ""),
    (r"/(r\d+)/", ""),
    (r"\.0*(\d{1,3})\.cam\.", "r"),
    (r"\.0*(\d{1,3})\.(?:eam|elm|clm2)\.", "r"),
    (r"_r0*(\d+)(?:[._-][^/_]*)*\.nc4?$", "r"),
]
START_YEARS = {"0101": "r1", "0151": "r2", "0201": "r3", "0251": "r4", "0301": "r5"}
YEAR_SPAN = r"(?<!\d)(\d{4})(?:\d{2}){1,4}[-_](\d{4})(?:\d{2}){1,4}(?!\d)"
BAD_VARIABLES = [("MIROC-ES2H", "sfcWind"), ("E3SMv3", "tasmax")]
WIND_CLIMATOLOGY_MODELS = ["MIROC-ES2H"]
ALTERNATES = {"sfcWind": ["uas", "vas"], "hurs": ["huss", "ps", "tas"]}


def literals(items) -> Column:
    return F.array(*[F.lit(x) for x in items])


def mapped(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def list_archive(spark: SparkSession, root: str, glob: str = "*.{nc,nc4}") -> DataFrame:
    """(path, length) of files below a folder; contents are never read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", "length")


def is_non_atmos(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, r"[/._\-]"), literals(NON_ATMOS))


def scenario_of(segment: Column) -> Column:
    low, out = F.lower(segment), F.when(F.lit(False), "")
    for pattern, name in SCENARIO_PATTERNS:
        out = out.when(low.rlike(pattern), name)
    return out


def classify_paths(listing: DataFrame, path_col: str = "path") -> DataFrame:
    """Adds model, scenario, member, var, var_name, freq, y0, y1, component to a table of paths.

    Scenarios are told by the last segment that names one, variables by the file name's first known token and then by the last
    known folder. Unknown parts are ``?`` (var and years null).
    """
    p = F.regexp_replace(F.col(path_col), r"\\", "/")
    segs = F.filter(F.split(p, "/"), lambda s: s != "")
    base = F.element_at(segs, -1)
    folders = F.slice(segs, F.lit(1), F.greatest(F.size(segs) - 1, F.lit(0)))
    first = lambda a: F.get(a, F.lit(0))
    out = listing.withColumns({"_p": p, "_segs": segs}).withColumns({"_base": base, "_folders": folders}).withColumn("_tokens", F.split("_base", r"[._\-]"))
    out = out.withColumn("_all", F.concat("_tokens", "_folders", F.flatten(F.transform("_folders", lambda s: F.split(s, r"[._\-]")))))
    low_models = literals([m.lower() for m in MODELS])
    by_segment = first(F.filter("_segs", lambda s: F.array_contains(low_models, F.lower(s))))
    by_text = first(F.filter(literals(MODELS), lambda m: F.contains(F.lower(F.col("_p")), F.lower(m))))
    model = F.coalesce(by_segment, by_text, F.get("_segs", F.lit(1)), F.lit("?"))
    scenario = first(F.filter(F.transform(F.reverse("_segs"), scenario_of), lambda s: s.isNotNull()))
    member = F.when(F.lit(False), "")
    for pattern, prefix in MEMBER_PATTERNS:
        member = member.when(F.col("_p").rlike(pattern), F.concat(F.lit(prefix), F.regexp_extract("_p", pattern, 1)))
    member = F.coalesce(member, mapped(F.regexp_extract("_p", r"[._](0101|0151|0201|0251|0301)[._/]", 1), START_YEARS), F.lit("?"))
    known = literals(CANON)
    named = first(F.filter("_tokens", lambda t: F.array_contains(known, t)))
    folder = first(F.filter(F.reverse("_folders"), lambda t: F.array_contains(known, t)))
    var = mapped(F.coalesce(named, folder), CANON)
    has = lambda tokens: F.arrays_overlap("_all", literals(tokens))
    year = lambda k: F.nullif(F.regexp_extract("_base", YEAR_SPAN, k), F.lit("")).cast("int")
    return out.select(
        *listing.columns,
        F.coalesce(mapped(model, MODEL_ALIASES), model).alias("model"),
        F.coalesce(scenario, F.lit("?")).alias("scenario"),
        member.alias("member"),
        var.alias("var"),
        F.coalesce(named, var).alias("var_name"),
        F.when(has(SUBDAILY), "subdaily").when(has(DAY), "day").when(has(MONTHLY), "mon").otherwise("unknown").alias("freq"),
        year(1).alias("y0"),
        year(2).alias("y1"),
        F.when(is_non_atmos(F.col("_p")), "other").otherwise("atm").alias("component"),
    )


def probe_frequency(stamps: DataFrame, keys: list[str], first: int = 50) -> DataFrame:
    """(keys, step, freq) from the median step in days of a file's first stamps. stamps: keys, path, t (days). One file per key stands for all."""
    one = stamps.join(stamps.groupBy(*keys).agg(F.min("path").alias("path")), [*keys, "path"])
    order = Window.partitionBy(*keys).orderBy("t")
    steps = one.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= first).withColumn("_d", F.col("t") - F.lag("t").over(order))
    step = F.percentile("_d", F.lit(0.5))
    return steps.groupBy(*keys).agg(step.alias("step")).withColumn("freq", F.when(F.col("step") < 0.9, "subdaily").when(F.col("step") < 1.5, "day").when(F.col("step") >= 20, "mon").otherwise("unknown"))


def build_catalog(listing: DataFrame, freq: str = "day", scenarios: list[str] = SCENARIOS) -> DataFrame:
    kept = listing.where((F.col("freq") == freq) & F.col("var").isNotNull() & F.col("scenario").isin(scenarios) & (F.col("component") == "atm"))
    return kept.groupBy(*KEY).agg(F.lit("netcdf").alias("kind"), F.sort_array(F.collect_list("path")).alias("paths"), F.min_by("var_name", "path").alias("var_name"))


def merge_catalog(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Entries of extra that base lacks are added; models whose name starts with _ are comments."""
    return base.unionByName(extra.where(~F.col("model").startswith("_")).join(base, KEY, "left_anti"), allowMissingColumns=True)


def overlay_catalog(base: DataFrame, over: DataFrame) -> DataFrame:
    """The later source wins."""
    return over.unionByName(base.join(over, KEY, "left_anti"), allowMissingColumns=True)


def load_catalog(documents: DataFrame, json_col: str = "json") -> DataFrame:
    """Flat catalog of nested JSON documents; keys that start with _ are comments. STORE columns are null but for entries in stores."""
    def level(df: DataFrame, name: str) -> DataFrame:
        return df.select(*[c for c in df.columns if c != "_m"], F.explode("_m").alias(name, "_m")).where(~F.col(name).startswith("_"))

    text = F.col(json_col)
    out = documents.select(F.from_json(text, CATALOG_JSON).alias("_m"))
    for name in KEY:
        out = level(out, name)
    return out.select(*KEY, F.coalesce("_m.kind", F.lit("netcdf")).alias("kind"), "_m.paths", F.col("_m.var").alias("var_name"), *[F.col(f"_m.{c}").alias(c) for c in STORE])


def save_catalog(catalog: DataFrame) -> DataFrame:
    """One JSON document per model, nested as load_catalog reads it."""
    nest = lambda df, keys, name: df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(name, "_m"))).alias("_m"))
    entry = F.struct("kind", "paths", F.col("var_name").alias("var"), *[c for c in STORE if c in catalog.columns])
    out = catalog.select(*KEY, entry.alias("_m"))
    for k in range(3, 0, -1):
        out = nest(out, KEY[:k], KEY[k])
    return out.select("model", F.to_json(F.create_map("model", "_m")).alias("json"))


def catalog_inventory(catalog: DataFrame, needed: list[str]) -> DataFrame:
    wide = catalog.groupBy("model", "scenario", "member").pivot("var", needed).agg(F.max(F.lit("Y")))
    return wide.fillna("", needed)


def missing_of(have: Column, required: list[str]) -> Column:
    """Required variables that are neither there nor to be had from others."""
    def ok(v: str) -> Column:
        own = F.array_contains(have, v)
        return own | (F.size(F.array_except(literals(ALTERNATES[v]), have)) == 0) if v in ALTERNATES else own

    return F.filter(F.array(*[F.when(~ok(v), F.lit(v)) for v in required]), lambda x: x.isNotNull())


def first_members(df: DataFrame, k: int | None) -> DataFrame:
    if k is None:
        return df
    return df.withColumn("_k", F.row_number().over(Window.partitionBy("model", "scenario").orderBy("member"))).where(F.col("_k") <= k).drop("_k")


def readiness_table(catalog: DataFrame, required: list[str], max_members: int | None = None, scenarios: list[str] = SCENARIOS) -> DataFrame:
    """(model, scenario, member, missing): missing variables, ``ok``, or ``NO DAILY DATA``."""
    have = first_members(catalog.groupBy("model", "scenario", "member").agg(F.collect_set("var").alias("_have")), max_members)
    wanted = catalog.select("model").distinct().select("model", F.explode(literals(scenarios)).alias("scenario"))
    rows = wanted.join(have, ["model", "scenario"], "left")
    miss = F.array_join(missing_of(F.col("_have"), required), ", ")
    return rows.select("model", "scenario", F.coalesce("member", F.lit("-")).alias("member"), F.when(F.col("_have").isNull(), "NO DAILY DATA").when(miss == "", "ok").otherwise(miss).alias("missing"))


def coverage(listing: DataFrame, frequencies: list[str] = ("day", "subdaily", "mon", "unknown")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files by model and frequency; files and years by model, scenario and variable; the most frequent unknown name stems."""
    by_freq = listing.groupBy("model").pivot("freq", list(frequencies)).count().fillna(0)
    years = listing.where("var IS NOT NULL").groupBy("model", "scenario", "var").agg(F.count(F.lit(1)).alias("files"), F.min("y0").alias("first_year"), F.max("y1").alias("last_year"), F.count_distinct("y0").alias("starts"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\d+", "#")
    unknown = listing.where("var IS NULL").groupBy(stem.alias("stem")).agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "stem").limit(40)
    return by_freq, years, unknown


def apply_known_issues(catalog: DataFrame, bad=BAD_VARIABLES, wind_models=WIND_CLIMATOLOGY_MODELS) -> DataFrame:
    """Without paths of other components, without unusable variables (temperature is chosen elsewhere), and with climatological wind for the models that need it."""
    clean = catalog.withColumn("paths", F.filter("paths", lambda p: ~is_non_atmos(p))).where((F.col("kind") != "netcdf") | F.col("paths").isNull() | (F.size("paths") > 0))
    dropped = clean.sparkSession.createDataFrame([(m, v) for m, v in bad if v != "tasmax"] + [(m, "sfcWind") for m in wind_models], "model string, var string").distinct()
    kept = clean.join(F.broadcast(dropped), ["model", "var"], "left_anti").select(*catalog.columns)
    pseudo = catalog.where(F.col("model").isin(list(wind_models))).select("model", "scenario", "member").distinct()
    return kept.unionByName(pseudo.select("model", "scenario", "member", F.lit("sfcWind").alias("var"), F.lit("wind_climatology").alias("kind"), F.lit(None).cast("array<string>").alias("paths"), F.lit(None).cast("string").alias("var_name")))


def select_members(catalog: DataFrame, required: list[str], k: int | None = None) -> DataFrame:
    """Members with every required variable, or uas for wind and huss for humidity: the looser rule."""
    have = catalog.groupBy("model", "scenario", "member").agg(F.collect_set("var").alias("_have"))
    loose = {"sfcWind": "uas", "hurs": "huss"}
    ok = F.lit(True)
    for v in required:
        one = F.array_contains("_have", v)
        ok &= one | F.array_contains("_have", loose[v]) if v in loose else one
    return first_members(have.where(ok).drop("_have"), k)


def select_models(members: DataFrame, scenarios: list[str] = SCENARIOS) -> DataFrame:
    return members.where(F.col("scenario").isin(scenarios)).groupBy("model").agg(F.count_distinct("scenario").alias("_n")).where(F.col("_n") == len(scenarios)).select("model")


def query_catalog(stores: DataFrame, **wanted: list[str]) -> DataFrame:
    """Rows of an external store catalog whose columns are among the wanted values, the last store per member and variable."""
    out = stores
    for c, values in wanted.items():
        out = out.where(F.col(c).isin(values))
    keys = [c for c in out.columns if c != "store"]
    return out.groupBy(*keys).agg(F.max("store").alias("store"))


def describe_stores(stores: DataFrame, by: list[str]) -> DataFrame:
    """Per group of an external store catalog the number of its rows and of the distinct values of every other column."""
    return stores.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *[F.count_distinct(c).alias(f"n_{c}") for c in stores.columns if c not in by])


def find_variables(listing: DataFrame, targets: dict[str, str]) -> DataFrame:
    """(var, files): how many paths match each variable's pattern."""
    spec = listing.sparkSession.createDataFrame(list(targets.items()), "var string, pattern string")
    hits = listing.join(F.broadcast(spec), F.expr("path rlike pattern")).groupBy("var").agg(F.count(F.lit(1)).alias("files"))
    return spec.select("var").join(hits, "var", "left").fillna(0, ["files"])
