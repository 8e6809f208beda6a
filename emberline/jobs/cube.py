"""A daily cube from the star-schema tables: cells from nations, days and variables from line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions.physics import vpd_from_rh

#: Keeps means of short decimals off the ties of rounding, where engines differ.
OFF_TIES = 1.7e-8
SERIES = ["model", "scenario", "member"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell_id, lat, lon (0 to 360), region, region_name, land."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").cast("long").alias("cell_id"),
        (F.col("n_nationkey") * 6.0 - 72).alias("lat"),
        F.pmod(F.col("n_nationkey") * 37.0, F.lit(360.0)).alias("lon"),
        F.col("n_regionkey").cast("string").alias("region"),
        F.col("r_name").alias("region_name"),
        ((F.col("n_nationkey") * 6 - 72) > -60).alias("land"),
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per scenario, member, cell and day. pr is in mm a day."""
    li, su = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    day = F.to_date("l_shipdate")
    rows = li.join(su, li.l_suppkey == su.s_suppkey).groupBy(F.lit("M1").alias("model"), F.col("l_linestatus").alias("scenario"), F.col("l_returnflag").alias("member"), F.col("s_nationkey").cast("long").alias("cell_id"), day.alias("d"))
    out = rows.agg(
        F.round(273.15 + F.avg("l_quantity") * 0.6, 6).alias("tas"),
        F.round(20 + 600 * F.avg("l_discount"), 6).alias("hurs"),
        F.round(0.5 + 60 * F.avg("l_tax"), 6).alias("sfcWind"),
        F.round(F.greatest(F.avg("l_extendedprice") / 1e4 - 4, F.lit(0.0)) + OFF_TIES, 6).alias("pr"),
    )
    return (
        out.withColumns({"lat": F.col("cell_id") * 6.0 - 72, "lon": F.pmod(F.col("cell_id") * 37.0, F.lit(360.0)), "tile": F.lit(0)})
        .withColumns({"year": F.year("d"), "month": F.month("d"), "day": F.dayofmonth("d"), "doy": F.dayofyear("d"), "day_idx": F.unix_date("d")})
        .drop("d")
    )


def with_vpd(df: DataFrame) -> DataFrame:
    return df.withColumn("vpd", F.round(vpd_from_rh(F.col("tas"), F.col("hurs")), 9))


#: The same for the SQL of queries.
CELLS_SQL = """cells AS (SELECT CAST(n_nationkey AS BIGINT) AS cell_id, n_nationkey * 6.0::DOUBLE - 72 AS lat, (n_nationkey * 37 % 360)::DOUBLE AS lon,
  CAST(n_regionkey AS VARCHAR) AS region, r_name AS region_name, n_nationkey * 6 - 72 > -60 AS land FROM nation JOIN region ON n_regionkey = r_regionkey)"""
DAILY_SQL = """base AS (SELECT 'M1' AS model, l_linestatus AS scenario, l_returnflag AS member, CAST(s_nationkey AS BIGINT) AS cell_id, CAST(l_shipdate AS DATE) AS d,
  round(273.15 + avg(l_quantity) * 0.6, 6) AS tas, round(20 + 600 * avg(l_discount), 6) AS hurs, round(0.5 + 60 * avg(l_tax), 6) AS sfcWind,
  round(greatest(avg(l_extendedprice) / 1e4 - 4, 0.0) + 1.7e-8, 6) AS pr
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
daily AS (SELECT model, scenario, member, cell_id, tas, hurs, sfcWind, pr, cell_id * 6.0::DOUBLE - 72 AS lat, (cell_id * 37 % 360)::DOUBLE AS lon,
  year(d)::INT AS year, month(d)::INT AS month, day(d)::INT AS day, dayofyear(d)::INT AS doy, (d - DATE '1970-01-01')::INT AS day_idx,
  round(greatest(exp(-6096.9385 / tas + 21.2409642 - 2.711193e-2 * tas + 1.673952e-5 * tas * tas + 2.433502 * ln(tas)) * (1 - hurs / 100) / 1000, 0), 9) AS vpd
  FROM base)"""
