"""Regridding by weight tables: each target cell has a few source cells, and fields are joined to the table and summed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.operators.lineage import kept

#: Weight tables up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_WEIGHTS = 1_000_000


def axis(cells: DataFrame, name: str) -> DataFrame:
    """(i, x): the distinct coordinates in ascending order. An axis has some hundred values."""
    return cells.select(F.col(name).alias("x")).distinct().withColumn("i", F.row_number().over(Window.orderBy("x")) - 1)


def regular_axis(spark: SparkSession, lo: float, hi: float, step: float) -> DataFrame:
    """Centres of a regular axis."""
    n = round((hi - lo) / step)
    return spark.range(n).select(F.col("id").cast("int").alias("i"), (F.lit(lo) + (F.col("id") + 0.5) * step).alias("x"))


def brackets(source: DataFrame, target: DataFrame) -> DataFrame:
    """(x, src, w): for each target coordinate the one or two source coordinates around it, weights summing to 1; none outside the range."""
    pairs = source.select(F.col("x").alias("lo"), F.lead("x").over(Window.orderBy("x")).alias("hi"))
    # Both tables are axes, never fields.
    inside = target.join(pairs, (F.col("x") >= F.col("lo")) & ((F.col("x") < F.col("hi")) | (F.col("hi").isNull() & (F.col("x") == F.col("lo")))))
    share = F.coalesce((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(0.0))
    both = inside.select("x", F.explode(F.array(F.struct(F.col("lo").alias("src"), (1 - share).alias("w")), F.struct(F.col("hi").alias("src"), share.alias("w")))).alias("e"))
    return both.select("x", "e.*").where("w > 0")


def nearest(source: DataFrame, target: DataFrame) -> DataFrame:
    """(x, src, w = 1): the nearest source coordinate, the smaller on ties."""
    return target.join(source.select(F.col("x").alias("src"))).groupBy("x").agg(F.min(F.struct(F.abs(F.col("x") - F.col("src")).alias("d"), "src")).alias("m")).select("x", F.col("m.src").alias("src"), F.lit(1.0).alias("w"))


def weight_table(cells: DataFrame, target: DataFrame, lat: DataFrame, lon: DataFrame) -> DataFrame:
    """(target_id, cell_id, w) of target cells (target_id, lat, lon) from weights along both axes."""
    a, b = (d.select(F.col("x").alias(f"_{n}"), F.col("src").alias(f"_{n}_src"), F.col("w").alias(f"_w{n}")) for d, n in ((lat, "lat"), (lon, "lon")))
    src = cells.select("cell_id", F.col("lat").alias("_lat_src"), F.col("lon").alias("_lon_src"))
    return target.join(a, F.col("lat") == F.col("_lat")).join(b, F.col("lon") == F.col("_lon")).join(src, ["_lat_src", "_lon_src"]).select("target_id", "cell_id", (F.col("_wlat") * F.col("_wlon")).alias("w"))


def bilinear_weights(cells: DataFrame, target: DataFrame) -> DataFrame:
    return weight_table(cells, target, *(brackets(axis(cells, n), axis(target, n)) for n in ("lat", "lon")))


def nearest_weights(cells: DataFrame, target: DataFrame) -> DataFrame:
    return weight_table(cells, target, *(nearest(axis(cells, n), axis(target, n)) for n in ("lat", "lon")))


def on_sphere(points: DataFrame) -> DataFrame:
    """points with _x, _y, _z on the unit sphere."""
    lat, lon = F.radians(F.col("lat").cast("double")), F.radians(F.col("lon").cast("double"))
    return points.withColumns({"_x": F.cos(lat) * F.cos(lon), "_y": F.cos(lat) * F.sin(lon), "_z": F.sin(lat)})


def nearest_points(cells: DataFrame, target: DataFrame, start: float | None = None) -> DataFrame:
    """(target_id, cell_id, w = 1): the nearest cell of each target by great circle, the smallest number on ties, for points of any arrangement: curvilinear and unstructured grids.

    Points are put into cubes. The nearest of the 27 cubes around a target is the nearest of all if it is no farther than a cube's side; targets for which it isn't go into
    the next round, with cubes of twice the side. start: the first side, by default such that a cube has a few cells if they are spread evenly. Points without a place are
    left out."""
    there = "lat IS NOT NULL AND lon IS NOT NULL"
    source, left = on_sphere(cells.where(there)).select("cell_id", "_x", "_y", "_z"), on_sphere(target.where(there)).select("target_id", "_x", "_y", "_z")
    n = source.count()
    if n == 0:
        return left.select("target_id", F.lit(None).cast("long").alias("cell_id"), F.lit(1.0).alias("w")).limit(0)
    side, found = start or min(2.0, 2 * (4 * math.pi / n) ** 0.5), None
    axes = ("_x", "_y", "_z")
    while True:
        cube = lambda p, step=side: [F.floor(F.col(c) / step) for c in axes]
        held = source.select("cell_id", *[F.col(c).alias(f"s{c}") for c in axes], *[x.alias(f"c{c}") for c, x in zip(axes, cube(source), strict=True)])
        near = left
        for c, x in zip(axes, cube(left), strict=True):
            near = near.withColumn(f"c{c}", F.explode(F.array(x - 1, x, x + 1)))
        apart = sum(((F.col(c) - F.col(f"s{c}")) * (F.col(c) - F.col(f"s{c}")) for c in axes), F.lit(0.0))
        best = near.join(held, [f"c{c}" for c in axes]).groupBy("target_id").agg(F.min(F.struct(apart.alias("d"), "cell_id")).alias("_b"))
        # Beyond the side of two there is no point left out.
        best = kept(best)
        sure = best if side >= 2 else best.where(F.col("_b.d") <= side * side)
        done = sure.select("target_id", F.col("_b.cell_id").alias("cell_id"), F.lit(1.0).alias("w"))
        found = done if found is None else found.unionByName(done)
        if side >= 2:
            return found
        left = kept(left.join(done.select("target_id"), "target_id", "left_anti"))
        if left.isEmpty():
            return found
        side *= 2


def apply_weights(field: DataFrame, weights: DataFrame, values: list[str], keys: list[str], skip_null: bool = False) -> DataFrame:
    """Fields on target cells: sum of w × value. A target with a null source is null, unless skip_null. Serves bilinear, nearest and sparse (conservative) weights alike."""
    small = weights.count() <= BROADCAST_WEIGHTS
    # A source cell without a row is missing like one with a null.
    weights = weights.join(weights.groupBy("target_id").agg(F.count(F.lit(1)).alias("_n")), "target_id")
    both = field.join(F.broadcast(weights) if small else weights, "cell_id")
    total = lambda v: F.sum(F.col("w") * F.col(v)) if skip_null else F.when(F.count(v) == F.max("_n"), F.sum(F.col("w") * F.col(v)))
    return both.groupBy(*keys, F.col("target_id")).agg(*[total(v).alias(v) for v in values]).withColumnRenamed("target_id", "cell_id")


def conservative_weights(cells: DataFrame, res: float) -> DataFrame:
    """(target_id, cell_id, w) from cells with bounds (cell_id, lat_lo, lat_hi, lon_lo, lon_hi in degrees; lon_hi may run beyond 180) to the global grid of res degrees, numbered as common_grid: w is the share of the target's area that the cell overlaps.

    Each cell lists the rows and columns of targets that it reaches, so nothing is joined; a cell of any shape of grid may overlap many targets and a target many cells."""
    n_lon, rad = round(360 / res), math.pi / 180
    first = lambda lo, origin: F.floor((F.col(lo) - origin) / res)
    last = lambda hi, origin: F.ceil((F.col(hi) - origin) / res) - 1
    real = cells.where("lat_hi > lat_lo AND lon_hi > lon_lo")
    rows = real.select("*", F.explode(F.sequence(F.greatest(first("lat_lo", -90), F.lit(0)), F.least(last("lat_hi", -90), F.lit(round(180 / res) - 1)))).alias("_r"))
    both = rows.select("*", F.explode(F.sequence(first("lon_lo", -180), last("lon_hi", -180))).alias("_c"))
    south, west = F.col("_r") * res - 90, F.col("_c") * res - 180
    tall = F.sin(F.least("lat_hi", south + res) * rad) - F.sin(F.greatest("lat_lo", south) * rad)
    wide = F.least("lon_hi", west + res) - F.greatest("lon_lo", west)
    share = tall * wide / ((F.sin((south + res) * rad) - F.sin(south * rad)) * res)
    # A cell that goes round and meets a target twice has one weight.
    return both.select((F.col("_r") * n_lon + F.pmod("_c", F.lit(n_lon))).cast("long").alias("target_id"), "cell_id", share.alias("w")).where("w > 0").groupBy("target_id", "cell_id").agg(F.sum("w").alias("w"))


def remap_conservative(field: DataFrame, weights: DataFrame, values: list[str], keys: list[str], by_covered: bool = False) -> DataFrame:
    """(keys, cell_id, covered, values): sums of w × value over the source cells that have one, and the share of the target that those of the first value cover; by_covered: means over the covered part instead.

    Without by_covered the integral over the sphere is kept. The sums begin where a source cell's rows are, before anything is dealt by target."""
    both = field.join(weights, "cell_id")
    out = both.groupBy(*keys, F.col("target_id")).agg(F.sum(F.when(F.col(values[0]).isNotNull(), F.col("w"))).alias("covered"), *[F.sum(F.col("w") * F.col(v)).alias(v) for v in values], *[F.sum(F.when(F.col(v).isNotNull(), F.col("w"))).alias(f"_w_{v}") for v in values])
    return out.select(*keys, F.col("target_id").alias("cell_id"), F.coalesce("covered", F.lit(0.0)).alias("covered"), *[(F.col(v) / F.col(f"_w_{v}") if by_covered else F.col(v)).alias(v) for v in values])


def integral(field: DataFrame, areas: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, integral): sums of value times area (cell_id, area). Equal before and after a conservative remap: what it has lost, if they aren't, lies outside the target."""
    return field.join(areas, "cell_id").groupBy(*keys).agg(F.sum(F.col(value) * F.col("area")).alias("integral"))


def regrid_bilinear(field: DataFrame, cells: DataFrame, target: DataFrame, values: list[str], keys: list[str], fill: str | None = "nearest") -> DataFrame:
    """Bilinear, and where that has no value the nearest source cell."""
    out = apply_weights(field, bilinear_weights(cells, target), values, keys)
    if fill is None:
        return out
    near = apply_weights(field, nearest_weights(cells, target), values, keys).select(*keys, "cell_id", *[F.col(v).alias(f"_{v}") for v in values])
    return near.join(out, [*keys, "cell_id"], "left").select(*keys, "cell_id", *[F.coalesce(v, f"_{v}").alias(v) for v in values])


def uv_to_centres(u: DataFrame, v: DataFrame, u_cells: DataFrame, v_cells: DataFrame, keys: list[str]) -> DataFrame:
    """Staggered components on the grid of u's latitudes and v's longitudes; one that is missing around a centre is null there."""
    lats, lons = u_cells.select("lat").distinct(), v_cells.select("lon").distinct()
    centres = lats.join(lons).withColumn("target_id", F.row_number().over(Window.orderBy("lat", "lon")).cast("long") - 1)
    return regrid_bilinear(u, u_cells, centres, ["uas"], keys).join(regrid_bilinear(v, v_cells, centres, ["vas"], keys), [*keys, "cell_id"], "outer")


def common_grid(spark: SparkSession, res: float = 1.0) -> DataFrame:
    """(target_id, lat, lon): centres of a global grid."""
    lat = regular_axis(spark, -90, 90, res).select(F.col("i").alias("_i"), F.col("x").alias("lat"))
    lon = regular_axis(spark, -180, 180, res).select(F.col("i").alias("_j"), F.col("x").alias("lon"))
    return lat.join(lon).select((F.col("_i") * round(360 / res) + F.col("_j")).cast("long").alias("target_id"), "lat", "lon")


def axis_weights(cells: DataFrame, name: str, first: float, res: float, n: int, periodic: bool) -> DataFrame:
    """(model, _i, _src, _w): for each model the target coordinates first + i × res, i from 0 to n - 1, with the one or two coordinates of the model's own axis around them.

    Each stretch between two neighbours lists the targets in it, so nothing is joined. A model is global if its longitudes close the
    circle: then the stretch from the last to the first is one too (periodic axis), and targets beyond the ends take the outermost coordinate (else)."""
    own = Window.partitionBy("model")
    along = own.orderBy("_x")
    ax = cells.select("model", F.col(name).cast("double").alias("_x")).distinct()
    ax = ax.withColumns({"_next": F.lead("_x").over(along), "_lo": F.min("_x").over(own), "_hi": F.max("_x").over(own)})
    place = lambda x: (x - first) / res
    at = F.explode(F.sequence(F.floor(place(F.col("_x"))) - 1, F.ceil(place(F.coalesce("_end", "_x"))) + 1)).alias("_k")
    target = F.lit(first) + F.col("_k") * res
    if periodic:
        ax = ax.join(globality(cells), "model")
        ax = ax.withColumns({"_end": F.coalesce("_next", F.when(F.col("global"), F.col("_lo") + 360.0)), "_behind": F.coalesce("_next", "_lo")})
    else:
        ax = ax.withColumns({"_end": F.col("_next"), "_behind": F.col("_next")})
    near = ax.select("model", "_x", "_end", "_behind", at).withColumn("_t", target)
    near = near.where((F.col("_t") >= F.col("_x")) & ((F.col("_t") < F.col("_end")) | (F.col("_end").isNull() & (F.col("_t") == F.col("_x")))))
    share = F.coalesce((F.col("_t") - F.col("_x")) / (F.col("_end") - F.col("_x")), F.lit(0.0))
    both = F.array(F.struct(F.col("_x").alias("_src"), (1 - share).alias("_w")), F.struct(F.col("_behind").alias("_src"), share.alias("_w")))
    i = F.pmod("_k", F.lit(n)) if periodic else F.col("_k")
    out = near.select("model", i.cast("int").alias("_i"), F.inline(both)).where("_w > 0")
    if not periodic:
        ends = ax.select("model", "_lo", "_hi").distinct().join(globality(cells).where("global"), "model")
        caps = ends.select("model", "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_i")).withColumn("_t", F.lit(first) + F.col("_i") * res)
        caps = caps.where(~F.col("_t").between(F.col("_lo"), F.col("_hi"))).select("model", "_i", F.when(F.col("_t") < F.col("_lo"), F.col("_lo")).otherwise(F.col("_hi")).alias("_src"), F.lit(1.0).alias("_w"))
        out = out.unionByName(caps)
    return out.where(F.col("_i").between(0, n - 1))


def globality(cells: DataFrame) -> DataFrame:
    """(model, global): whether the span and the median step of a model's longitudes close the circle."""
    lon = cells.select("model", F.col("lon").cast("double").alias("_x")).distinct()
    step = F.col("_x") - F.lag("_x").over(Window.partitionBy("model").orderBy("_x"))
    return lon.withColumn("_d", step).groupBy("model").agg((F.max("_x") - F.min("_x") + F.coalesce(F.percentile("_d", F.lit(0.5)), F.lit(360.0)) >= 359.0).alias("global"))


def common_weights(cells: DataFrame, res: float = 1.0) -> DataFrame:
    """(model, target_id, cell_id, w) from the grids of all models (model, cell_id, lat, lon) to the global grid of res degrees, numbered as common_grid.

    A corner that has no cell stays in with a null cell_id, so that its target is incomplete."""
    n_lat, n_lon = round(180 / res), round(360 / res)
    lat = axis_weights(cells, "lat", -90 + res / 2, res, n_lat, False).select("model", F.col("_i").alias("_r"), F.col("_src").alias("_lat"), F.col("_w").alias("_wr"))
    lon = axis_weights(cells, "lon", -180 + res / 2, res, n_lon, True).select("model", F.col("_i").alias("_c"), F.col("_src").alias("_lon"), F.col("_w").alias("_wc"))
    src = cells.select("model", "cell_id", F.col("lat").cast("double").alias("_lat"), F.col("lon").cast("double").alias("_lon"))
    both = lat.join(lon, "model").join(src, ["model", "_lat", "_lon"], "left")
    return both.select("model", (F.col("_r").cast("long") * n_lon + F.col("_c")).alias("target_id"), "cell_id", (F.col("_wr") * F.col("_wc")).alias("w"))


def cells_of_models(cells: DataFrame, field: DataFrame) -> DataFrame:
    """(model, cell_id, lat, lon): cells as they are if they have a model, else for each model the cells that its field names, whose numbers must then be unique over all grids."""
    if "model" in cells.columns:
        return cells.select("model", "cell_id", "lat", "lon")
    return field.select("model", "cell_id").distinct().join(cells.select("cell_id", "lat", "lon"), "cell_id")


def stack_models(field: DataFrame, cells: DataFrame, values: list[str], keys: list[str], res: float = 1.0) -> DataFrame:
    """Fields of several models, each on its own grid, on the common one: (model, keys, cell_id of the common grid, values, n_models).

    Bilinear; longitude is periodic and polar caps take the outermost row if a model's grid is global, and a regional box has no
    rows outside itself. A target with a missing corner is null. Booleans become true above one half. n_models counts the models that have
    a grid, whether they have a value in a cell or not. One join with one table of weights, whatever the number of models."""
    own = cells_of_models(cells, field)
    flags = [c for c, t in field.dtypes if t == "boolean" and c in values]
    numbers = field.withColumns({c: F.coalesce(F.col(c), F.lit(False)).cast("double") for c in flags})
    weights = common_weights(own, res)
    # Grid-sized like the weights themselves, never by time.
    weights = weights.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("model", "target_id")))
    out = numbers.join(weights, ["model", "cell_id"]).groupBy("model", *keys, F.col("target_id")).agg(*[F.when(F.count(v) == F.max("_n"), F.sum(F.col("w") * F.col(v))).alias(v) for v in values])
    out = out.withColumnRenamed("target_id", "cell_id").withColumns({c: F.coalesce(F.col(c) > 0.5, F.lit(False)) for c in flags})
    return with_model_count(out, own).select("model", *keys, "cell_id", *values, "n_models")


def with_model_count(field: DataFrame, of: DataFrame) -> DataFrame:
    """field with n_models, the number of models in ``of``: one row, sent to all tasks."""
    return field.join(F.broadcast(of.agg(F.count_distinct("model").alias("n_models"))))


def to_common_grid(field: DataFrame, cells: DataFrame, values: list[str], keys: list[str], res: float = 1.0) -> DataFrame:
    """One grid onto the common one, as stack_models does it."""
    one = F.lit("").alias("model")
    return stack_models(field.select("*", one), cells.select("cell_id", "lat", "lon", one), values, keys, res).select(*keys, "cell_id", *values)


def snap_grid(cells: DataFrame, reference: DataFrame, tol: float = 0.01) -> DataFrame:
    """(cell_id, lat, lon) with the reference's coordinates where both axes have as many values within tol; otherwise an error."""
    out = cells
    for name in ("lat", "lon"):
        own, ref = axis(cells, name), axis(reference, name)
        both = own.join(ref.select("i", F.col("x").alias("ref")), "i", "full_outer")
        off = both.agg(F.max(F.coalesce(F.abs(F.col("x") - F.col("ref")), F.lit(float("inf"))))).first()[0]
        if off is not None and off > tol:
            raise ValueError(f"{name}: grids differ by {off}; regrid first")
        out = out.join(both.select(F.col("x").alias(name), "ref"), name).drop(name).withColumnRenamed("ref", name)
    return out.select(*cells.columns)


def lookup_month(daily: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of a monthly table by keys and month."""
    return daily.join(table, [*keys, "month"], "left")


def lookup_doy(daily: DataFrame, climatology: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Climatology by day of year, days 1 to 366, absent ones from the nearest present (the earlier on ties).

    A present day reaches from half way after the one before, so a row of daily takes the last present day of its key that begins
    by then: one pass over the rows of both tables, none of which are made for the days between."""
    present = climatology.where(F.col("doy").between(1, 366)).dropna(subset=keys)
    before = F.lag("doy").over(Window.partitionBy(*keys).orderBy("doy"))
    starts = present.withColumn("_from", F.coalesce(F.floor((before + F.col("doy")) / 2) + 1, F.lit(1))).select(*keys, "_from", F.struct(*values).alias("_v"))
    rows = daily.select(*keys, F.col("doy").alias("_from"), F.struct(*daily.columns).alias("_row"))
    along = Window.partitionBy(*keys).orderBy("_from", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = starts.unionByName(rows, allowMissingColumns=True).withColumn("_v", F.last("_v", ignorenulls=True).over(along)).where("_row IS NOT NULL")
    own = [*keys, "doy", *(c for c in daily.columns if c not in (*keys, "doy"))]
    found = F.when(F.col("_row")["doy"].between(1, 366), F.col("_v"))
    return met.select(*[F.col("_row")[c].alias(c) for c in own], *[found[v].alias(v) for v in values])


def wrap_lon(lon: Column, highest: Column) -> Column:
    """Longitudes as -180 to 180, if the highest of the grid is above 180."""
    return F.when(highest > 180, F.pmod(lon + 180, F.lit(360.0)) - 180).otherwise(lon)
