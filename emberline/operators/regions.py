"""Region membership, land, and area-weighted means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators.season import month_days

#: Bridge tables up to this many rows are broadcast.
BROADCAST_BRIDGE = 1_000_000
ICE_SHEETS = ["GIC", "EAN", "WAN"]


def polygon_edges(polygons: DataFrame, tile: float) -> DataFrame:
    """(region, region_name, _p, row, x1, y1, x2, y2, lo, hi): the edges of all rings in each row of tiles that they pass, with the longitudes lo to hi that they have in it.

    Rings close by themselves. Of a polygon that wraps, an edge goes the shorter way round, so longitudes run on beyond 180."""
    rings = polygons.select("region", "region_name", "_p", F.posexplode("rings").alias("_part", "_ring"), "wraps").select("region", "region_name", "_p", "_part", "wraps", F.posexplode("_ring").alias("_k", "_v"))
    ring = Window.partitionBy("region", "region_name", "_p", "_part").orderBy("_k")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    v = rings.select("*", F.col("_v.lon").alias("_lon"), F.col("_v.lat").alias("y1")).withColumns({f"_next_{c}": F.coalesce(F.lead(c).over(ring), F.first(c).over(whole)) for c in ("_lon", "y1")})
    step = F.pmod(F.col("_next__lon") - F.col("_lon") + 180, F.lit(360.0)) - 180
    way = F.first("_lon").over(whole) + F.coalesce(F.sum("_step").over(ring.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    # Whole turns are added to the longitudes as they are given, so nothing is lost by summing.
    near = lambda lon, at: F.when(F.col("wraps"), lon + 360 * F.round((at - lon) / 360)).otherwise(lon)
    edges = v.withColumn("_step", step).withColumn("x1", near(F.col("_lon"), way)).withColumn("x2", near(F.col("_next__lon"), F.col("x1") + F.col("_step"))).withColumnRenamed("_next_y1", "y2")
    edges = edges.where("x1 <> x2 OR y1 <> y2")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = edges.select("region", "region_name", "_p", "x1", "y1", "x2", "y2", F.explode(F.sequence(F.floor(low / tile), F.floor(high / tile))).alias("row"))
    at = lambda y: F.when(F.col("y1") == F.col("y2"), None).otherwise(F.col("x1") + (y - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) * (F.col("x2") - F.col("x1")))
    a, b = at(F.greatest(low, F.col("row") * tile)), at(F.least(high, (F.col("row") + 1) * tile))
    return rows.select("*", F.coalesce(F.least(a, b), F.least("x1", "x2")).alias("lo"), F.coalesce(F.greatest(a, b), F.greatest("x1", "x2")).alias("hi"))


def turned(lon: Column) -> Column:
    """The longitude from -180 on, below 180; one that is so already stays as it is."""
    return lon - 360 * F.floor((lon + 180) / 360)


def inside(edges: Column, x: Column, y: Column) -> Column:
    """Whether a point (turned) lies within rings, by the parity of the edges to the east: a ring within a ring is a hole, and one within that an island.

    Rings may have been drawn a turn apart, so the point is seen from three turns; from those in which it lies outside a ring, the ring has an even number of edges."""
    at = lambda e: e["x1"] + (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) * (e["x2"] - e["x1"])
    east = lambda e: sum(((x + 360 * k < at(e)).cast("int") for k in (0, 1)), (x - 360 < at(e)).cast("int"))
    return F.aggregate(edges, F.lit(0), lambda n, e: n + F.when((e["y1"] > y) != (e["y2"] > y), east(e)).otherwise(0)) % 2 == 1


def region_tiles(rows: DataFrame, tile: float, around: int) -> DataFrame:
    """(region, region_name, _p, row, col, edge) of the tiles that a polygon covers wholly (edge false) or that an edge passes. Of a polygon's rows of tiles with their edges."""
    first, last = (F.floor(f(F.transform("edges", lambda e: e[c])) / tile) for f, c in ((F.array_min, "lo"), (F.array_max, "hi")))
    span = F.array_distinct(F.transform(F.sequence(first, F.least(last, first + around)), lambda c: F.pmod(c, F.lit(around))))
    tiles = rows.select("region", "region_name", "_p", "row", "edges", F.explode(span).alias("col"))
    west, slack = F.col("col") * tile, 1e-9
    # Some turn of the edge overlaps the tile.
    edge = F.exists("edges", lambda e: F.ceil((e["lo"] - west - tile - slack) / 360) <= F.floor((e["hi"] - west + slack) / 360))
    centre = inside(F.col("edges"), turned(west + tile / 2), (F.col("row") + 0.5) * tile)
    return tiles.select("region", "region_name", "_p", "row", "col", edge.alias("edge"), centre.alias("_in")).where("edge OR _in").drop("_in")


def assign_regions(cells: DataFrame, polygons: DataFrame, tile: float = 2.0) -> DataFrame:
    """(cell_id, region, region_name) for cells (cell_id, lat, lon) in polygons (region, region_name, rings array<array<struct<lon, lat>>>, or one ring). A cell may be in several regions; a region may have several rows.

    Rings may have holes and islands, and a polygon whose column ``wraps`` is true crosses 180°: its edges go the shorter way. Longitudes of cells
    and rings may be of either convention. The polygons are laid over a grid of tiles (whole parts of 360°): cells in tiles wholly inside
    are members at once, and only those in tiles that an edge passes are tested, against the edges of that row of tiles. Cells without a place are in no region."""
    around = round(360 / tile)
    if abs(around * tile - 360) > 1e-9:
        raise ValueError("tile is a whole part of 360")
    rings = F.col("rings") if "rings" in polygons.columns else F.array("ring")
    wraps = F.coalesce(F.col("wraps"), F.lit(False)) if "wraps" in polygons.columns else F.lit(False)
    shapes = polygons.select("region", "region_name", rings.alias("rings"), wraps.alias("wraps")).distinct().withColumn("_p", F.xxhash64("region", "region_name", "rings", "wraps"))
    edge = F.struct("x1", "y1", "x2", "y2", "lo", "hi")
    # A polygon's edges within a row of tiles.
    rows = polygon_edges(shapes, tile).groupBy("region", "region_name", "_p", "row").agg(F.collect_list(edge).alias("edges"))
    tiles = region_tiles(rows, tile, around)
    at = cells.where("lat IS NOT NULL AND lon IS NOT NULL").select("cell_id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    at = at.withColumns({"row": F.floor(F.col("lat") / tile), "col": F.pmod(F.floor(F.col("lon") / tile), F.lit(around))})
    near = at.join(tiles, ["row", "col"])
    sure = near.where(~F.col("edge")).select("cell_id", "region", "region_name")
    tested = near.where("edge").join(rows.select("_p", "row", "edges"), ["_p", "row"]).where(inside(F.col("edges"), turned(F.col("lon")), F.col("lat"))).select("cell_id", "region", "region_name")
    return sure.unionByName(tested).distinct()


def land_mask(cells: DataFrame, cell_region: DataFrame) -> DataFrame:
    """Cells with land: true if in any land region, north of 60° S, and in none of the ice sheets."""
    marks = cell_region.groupBy("cell_id").agg(F.max(F.col("region").isin(ICE_SHEETS)).alias("_ice"))
    return cells.join(marks, "cell_id", "left").withColumn("land", F.coalesce(~F.col("_ice"), F.lit(False)) & (F.col("lat") > -60)).drop("_ice")


def area_weight(lat: str = "lat") -> Column:
    return F.cos(F.radians(lat))


def weighted_mean(value: str, weight: Column) -> Column:
    """Null values drop out of both sums."""
    return F.sum(F.col(value) * weight) / F.sum(F.when(F.col(value).isNotNull(), weight))


def regional_means(field: DataFrame, cell_region: DataFrame, cells: DataFrame, values: list[str], keys: list[str], land_only: bool = True) -> DataFrame:
    """Area-weighted means of all keys and regions in one aggregation. cells: cell_id, lat, land."""
    known = (cells.where("land") if land_only else cells).select("cell_id", "lat")
    bridge = cell_region.select("cell_id", "region", "region_name").join(known, "cell_id").select("cell_id", "region", "region_name", area_weight().alias("_w"))
    both = field.join(F.broadcast(bridge) if bridge.count() <= BROADCAST_BRIDGE else bridge, "cell_id")
    return both.groupBy(*keys, "region", "region_name").agg(*[weighted_mean(v, F.col("_w")).alias(v) for v in values])


def regional_seasonality(monthly: DataFrame, cell_region: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Days a month above the threshold by region, from exc_freq."""
    return regional_means(monthly.withColumn("days", F.col("exc_freq") * month_days()), cell_region, cells, ["days"], [*keys, "month"])


def regional_pivot(regional: DataFrame, quantities: list[str], focus: list[str]) -> DataFrame:
    """Mean over models, a column per quantity, rows in the order of the focus list."""
    wide = regional.where(F.col("region").isin(focus)).groupBy("region").pivot("quantity", quantities).agg(F.avg("value"))
    return wide.withColumn("_o", F.array_position(F.array(*map(F.lit, focus)), F.col("region"))).orderBy("_o").drop("_o")


def regional_summary(base: DataFrame, exp: DataFrame, value: str = "value") -> DataFrame:
    """Base, experiment, shift and percentage per region; 0 % where the base is 0, no row where it is null."""
    both = base.select("region", F.col(value).alias("base")).join(exp.select("region", F.col(value).alias("exp")), "region").where("base IS NOT NULL")
    return both.withColumn("shift", F.col("exp") - F.col("base")).withColumn("percent", F.when(F.col("base") != 0, 100 * F.col("shift") / F.col("base")).otherwise(0.0))


def top_regions(summary: DataFrame, n: int = 10) -> DataFrame:
    return summary.orderBy(F.desc("shift"), "region").limit(n)


def area_fractions(classes: DataFrame, cells: DataFrame, keys: list[str], codes=(1, 2, 3, 4, 5)) -> DataFrame:
    """Share of the classified land area per class; absent classes are 0."""
    w = classes.where("offset_class IS NOT NULL").join(cells.where("land"), "cell_id").groupBy(*keys, "offset_class").agg(F.sum(area_weight()).alias("_w"))
    wide = w.groupBy(*keys).agg(F.sum("_w").alias("_all"), F.map_from_entries(F.collect_list(F.struct(F.col("offset_class").cast("int"), "_w"))).alias("_m"))
    return wide.select(*keys, F.explode(F.array(*map(F.lit, codes))).alias("offset_class"), "_all", "_m").select(*keys, "offset_class", (F.coalesce(F.try_element_at("_m", F.col("offset_class")), F.lit(0.0)) / F.col("_all")).alias("fraction"))


def spatial_mean(field: DataFrame, value: str, keys: list[str], band: tuple[float, float]) -> DataFrame:
    """Mean over longitudes for each latitude of the band, then weighted over latitudes: not the same as one flat mean where values are missing."""
    rows = field.where(F.col("lat").between(*band)).groupBy(*keys, "lat").agg(F.avg(value).alias(value))
    return rows.groupBy(*keys).agg(weighted_mean(value, area_weight()).alias(value))


