"""Ensemble statistics: means, differences, Welch tests, false-discovery control, agreement and multi-model means."""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from emberline.schema import PAIRS


def ensemble_mean(df: DataFrame, values: list[str], keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def run_pairs(df: DataFrame, pairs=PAIRS) -> DataFrame:
    """(pair, a, b) as a table of a few rows."""
    return df.sparkSession.createDataFrame(pairs, "pair string, a string, b string")


def pair_delta(means: DataFrame, value: str, keys: list[str], pairs=PAIRS, run: str = "run") -> DataFrame:
    """a - b of every pair of runs, over the keys (which leave out the run)."""
    named = F.broadcast(run_pairs(means, pairs))
    left = means.join(named, F.col(run) == F.col("a")).select("pair", "b", *keys, F.col(value).alias("_a"))
    right = means.select(F.col(run).alias("b"), *keys, F.col(value).alias("_b"))
    return left.join(right, ["b", *keys]).select("pair", *keys, (F.col("_a") - F.col("_b")).alias("delta"))


def t_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided tail of Student's t, through the incomplete beta function by continued fraction."""
    x = df / (df + t * t)
    a, b = df / 2, np.full_like(df, 0.5)
    flip = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        log_beta = np.array([lgamma(p + q) - lgamma(p) - lgamma(q) if p > 0 and q > 0 else np.nan for p, q in zip(a, b)])
        front = np.exp(log_beta + a * np.log(x) + b * np.log1p(-x)) / a
        tiny = 1e-300
        c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 300):
            for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + k * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + k / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
            if np.nanmax(np.abs(d * c - 1), initial=0) < 1e-15:
                break
        p = np.where(x <= 0, 0.0, front * h)
    return np.clip(np.where(flip, 1 - p, p), 0, 1)


@F.pandas_udf(DoubleType())
def t_pvalue(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for t, df in batches:
        t, df = t.to_numpy(dtype=float), df.to_numpy(dtype=float)
        ok, out = np.isfinite(t) & np.isfinite(df) & (df > 0), np.full(len(t), np.nan)
        out[ok] = t_tail(np.abs(t[ok]), df[ok])
        yield pd.Series(out).where(ok, None)


def moments(samples: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Mean, sample variance and number of slots; a null value has a slot too."""
    return samples.groupBy(*keys).agg(F.avg(value).alias("mean"), F.var_samp(value).alias("var"), F.count(F.lit(1)).cast("double").alias("n"))


def welch(a: DataFrame, b: DataFrame, keys: list[str], p_value: bool = True) -> DataFrame:
    """From the moments of a and b over the keys: delta, t, df, pvalue. p is 1 where nothing varies and null where a mean is."""
    both = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in ("mean", "var", "n")]).join(b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in ("mean", "var", "n")]), keys)
    sa, sb = F.col("a_var") / F.col("a_n"), F.col("b_var") / F.col("b_n")
    spread = F.when(sa + sb > 0, sa + sb)
    out = both.select(
        *keys,
        (F.col("a_mean") - F.col("b_mean")).alias("delta"),
        ((F.col("a_mean") - F.col("b_mean")) / F.sqrt(spread)).alias("t"),
        (spread * spread / (sa * sa / (F.col("a_n") - 1) + sb * sb / (F.col("b_n") - 1))).alias("df"),
    )
    return out.withColumn("pvalue", F.when(F.col("delta").isNull(), None).when(F.col("t").isNull(), 1.0).otherwise(t_pvalue("t", "df"))) if p_value else out


def fdr_significant(df: DataFrame, keys: list[str], alpha: float = 0.10, mask: Column | None = None, p: str = "pvalue") -> DataFrame:
    """Adds ``significant`` by Benjamini and Hochberg within each map (keys). Null p values and cells outside the mask are not tested and not significant."""
    tested = F.col(p).isNotNull() if mask is None else F.col(p).isNotNull() & F.coalesce(mask, F.lit(False))
    per_map = Window.partitionBy(*keys)
    # Within a map the tested cells come first: their place is the rank of their p value.
    place = F.row_number().over(per_map.orderBy(F.when(tested, F.col(p)).asc_nulls_last()))
    passed = F.when(tested & (F.col(p) <= alpha * F.col("_k") / F.col("_n")), F.col(p))
    return (
        df.withColumn("_n", F.count(F.when(tested, 1)).over(per_map))
        .withColumn("_k", place)
        .withColumn("_crit", F.max(passed).over(per_map))
        .withColumn("significant", F.coalesce(tested & (F.col(p) <= F.col("_crit")), F.lit(False)))
        .drop("_n", "_k", "_crit")
    )


def sign_agreement(deltas: DataFrame, keys: list[str], delta: str = "delta", name: str = "agreement") -> DataFrame:
    """Share of members (all of them, null ones too) whose change has the sign of the mean change."""
    mean = F.avg(delta).over(Window.partitionBy(*keys))
    return deltas.withColumn("_m", mean).groupBy(*keys).agg(F.avg(F.when(F.signum(delta) == F.signum("_m"), 1.0).otherwise(0.0)).alias(name))


def ensemble_delta(annual: DataFrame, value: str, keys: list[str], a: str, b: str, alpha: float = 0.10, mask: Column | None = None, map_keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """Change of annual values (run, member, year, keys) from run b to run a: delta, pvalue, significant within each map (map_keys, of the keys), and the members' agreement."""
    if not map_keys or not set(map_keys) <= set(keys):
        raise ValueError("map_keys name the columns of keys that tell maps apart")
    of = lambda run: annual.where(F.col("run") == run)
    test = fdr_significant(welch(moments(of(a), value, keys), moments(of(b), value, keys), keys), list(map_keys), alpha, mask)
    members = of(a).groupBy(*keys, "member").agg(F.avg(value).alias("_a")).join(of(b).groupBy(*keys).agg(F.avg(value).alias("_b")), keys)
    return test.join(sign_agreement(members.select(*keys, (F.col("_a") - F.col("_b")).alias("delta")), keys, name="member_agreement"), keys, "left")


def multimodel(deltas: DataFrame, keys: list[str], value: str = "delta", agree: float = 2 / 3, models: str | None = None) -> DataFrame:
    """Mean over models on one grid, and whether it is robust: two thirds of all models have its sign and half are significant; if only one model is given, its significance.

    models names the column that has the number of all models (see grid.stack_models); without it the rows of a key are all. A model without a value or
    without a row has no part in the mean, but counts as one that disagrees and isn't significant. valued (if models is named): models with a value."""
    per_cell = Window.partitionBy(*keys)
    flagged = deltas.withColumn("_m", F.avg(value).over(per_cell))
    n = F.max(models) if models else F.count(F.lit(1))
    share = lambda when: F.count_if(F.coalesce(when, F.lit(False))) / n
    sig, same = share(F.col("significant")), share(F.signum(value) == F.signum("_m"))
    robust = F.when(n == 1, sig > 0.5).otherwise((same >= agree) & (sig >= 0.5)).alias("robust")
    return flagged.groupBy(*keys).agg(F.avg(value).alias("mean"), n.cast("long").alias("models"), *([F.count(value).alias("valued")] if models else []), robust)
