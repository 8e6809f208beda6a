"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same real number of copies, target / source size. Its whole part is taken as it is; the
fractional parts are rounded by pivotal pairing: a document is paired with the next smaller ones of its block, as many as can settle
it, and words of copy probability go from it to them or back, in a random direction that keeps all expectations, until one is integral.
What a source takes in words is so kept at every pairing. Pairings run within blocks of bounded size, whatever a source's size; each
block leaves one fractional document at most, and these residuals meet in the blocks of the next level of a tree, until one is left for
each source. There the words count for more than one document's expectation: one that could be settled to one side only goes there.
Draws depend on the seed, the source and the block alone, so reruns agree on any cluster.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.llm.common import cut, table, words

#: Rows that meet in one task at once.
BLOCK = 512
#: Source tables up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_SOURCES = 50_000
EPS = 1e-9


def pivotal(p: np.ndarray, size: np.ndarray, draws: np.ndarray, last: bool = False) -> np.ndarray:
    """Round p (each in 0..1) but for one entry at most, keeping the sum of p * size and each entry's expectation. Sizes come in falling order.

    The largest open entry is paired with the next smaller ones together, as many as it takes to settle it: words move from it to them
    or back, in a random direction that keeps all expectations, until it is integral or one of them is. They share a move by p (1 - p), the same for
    both directions. So an entry that outweighs each of the others does not stay open to the end: what is left over is mostly a small one.
    last: there is no further level, so an entry that all others together can settle to one side only goes to that side, which keeps the sum, not its expectation."""
    p, size, moves = p.astype(float).copy(), size.astype(float), iter(draws.tolist())
    fixed = (p <= EPS) | (p >= 1 - EPS)
    p[fixed] = np.round(p[fixed])
    for i in range(len(p) - 1):
        while EPS < p[i] < 1 - EPS:
            partners = 1
            while True:
                rest, heavy = p[i + 1 : i + 1 + partners], size[i + 1 : i + 1 + partners]
                share = rest * (1 - rest)
                total, open_ = float((share * heavy).sum()), rest[share > 0]
                # Words that it can take from them, and that they can take from it.
                give, take = (total / (1 - open_.min()), total / open_.max()) if total > 0 else (0.0, 0.0)
                if i + 1 + partners >= len(p) or (give >= (1 - p[i]) * size[i] and take >= p[i] * size[i]):
                    break
                partners *= 2
            if total <= 0:  # all after it are settled
                return p
            up, down = min((1 - p[i]) * size[i], give), min(p[i] * size[i], take)
            rises = next(moves) * (up + down) < down  # a move settles it or one of them, so there are no more moves than entries
            if last and (give >= (1 - p[i]) * size[i]) != (take >= p[i] * size[i]):
                rises = give >= (1 - p[i]) * size[i]
            move = up if rises else -down
            p[i] += move / size[i]
            rest -= move * share / total
            near = (rest <= EPS) | (rest >= 1 - EPS)
            rest[near] = np.round(rest[near])
        p[i] = np.round(p[i])
    return p


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, max_repeat: float) -> DataFrame:
    """Per source: _rank (by code point, null last), docs, source_size, target. Targets split share of all sizes by weight; none is above max_repeat times its source's size, and what that cuts goes to the others by weight.

    The ranking sorts the source table (one row per source, never documents) in one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sources = cut(
        sized.groupBy("source")
        .agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size"))
        .withColumn("_rank", F.row_number().over(by_name) - 1)
        .withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), F.col("_rank") % len(weights) + 1).cast("double"))
        .withColumn("_cap", F.col("source_size") * F.lit(float(max_repeat)))
    )
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    rate, capped = 0.0, -1
    while True:
        over = F.col("_weight") * rate > F.col("_cap")
        n, held, rest = sources.agg(F.count_if(over), F.sum(F.when(over, F.col("_cap"))), F.sum(F.when(~over, F.col("_weight")))).first()
        if n == capped or not rest:
            break
        capped, rate = n, max(0.0, total - (held or 0)) / rest
    # The last rate was found with the sources that it puts at their cap.
    return sources.withColumn("target", F.least(F.col("_weight") * rate, F.col("_cap"))).drop("_weight", "_cap")


def copies(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, max_repeat: int = 3, seed: int = 0, id_col: str = "doc_id") -> DataFrame:
    """sized has source, size and id_col; every row comes back once with source_size, target and copies added.

    A row of null size or size 0 gets no copies. A null source is a source of its own, ranked last; null identifiers are as good as
    others. Rows that repeat in full are rounded one by one. An empty table gives no rows. Input columns with the
    names of result columns are replaced. Columns of map type are not supported.
    """
    names = [c for c in sized.columns if c not in ("source_size", "target", "copies")]
    own = [c for c in names if c not in ("source", "size", id_col)]
    # Columns of the caller may have any name, so they are packed. Rows that repeat in full are counted and numbered, which makes
    # them fall into different blocks, and into the same ones in every run.
    packed = sized.select(F.col(id_col).alias("_id"), "source", F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size"), F.struct(F.lit(0).alias("_"), F.col("size").alias("_size"), *own).alias("_own"))
    units = packed.groupBy("_id", "source", "size", "_own").agg(F.count(F.lit(1)).alias("_n"))
    sized = cut(units.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).drop("_n"))
    stats = cut(source_targets(sized, weights, share, max_repeat).withColumn("_blocks", F.ceil(F.col("docs") / BLOCK)))
    n_sources, most = stats.agg(F.count(F.lit(1)), F.max("_blocks")).first()
    known = stats.withColumnRenamed("source", "_source").drop("docs")
    rate = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    hashed = F.xxhash64(F.col("_id").cast("string"), F.lit(seed), F.col("_own"), F.when(F.col("_nth") > 1, F.col("_nth")))
    rows = (
        sized.join(F.broadcast(known) if n_sources <= BROADCAST_SOURCES else known, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_whole", F.floor(rate + EPS).cast("int"))
        .withColumn("_p", F.greatest(F.lit(0.0), rate - F.col("_whole")))
        .withColumn("_hash", hashed)
        .withColumn("_block", F.pmod("_hash", "_blocks"))
        .drop("_source", "_blocks")
    )
    schema = rows.schema

    def rounded(level: int, last: bool):
        def block(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["size", "_hash", "_id", "_nth"], ascending=[False, True, True, True], kind="stable")
            rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, level, int(pdf["_rank"].iloc[0]), int(pdf["_block"].iloc[0])])))
            p = pivotal(pdf["_p"].to_numpy(), pdf["size"].to_numpy(dtype=float), rng.random(len(pdf)), last)
            if last:
                p = np.where((p > 0) & (p < 1), rng.random(len(pdf)) < p, p)
            return pdf.assign(_p=p)

        return block

    is_open = (F.col("_p") > EPS) & (F.col("_p") < 1 - EPS)
    settled, level, most = [], 0, int(most or 1)
    while True:
        last = most <= 1
        rows = cut(rows.groupBy("_rank", "_block").applyInPandas(rounded(level, last), schema))
        settled.append(rows if last else rows.where(~is_open))
        if last:
            break
        rows, level, most = rows.where(is_open).withColumn("_block", F.floor(F.col("_block") / BLOCK).cast("long")), level + 1, -(-most // BLOCK)
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    given = {id_col: F.col("_id"), "source": F.col("source"), "size": F.col("_own._size")}
    count = (F.col("_whole") + F.round("_p").cast("int")).cast("int")
    return out.select(*[given.get(c, F.col("_own")[c]).alias(c) for c in names], "source_size", "target", count.alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus: every document as often as its copies say, with the input's columns.

    Size is the number of words; null text counts 0 and is never taken. A null source is a source of its own, ranked last.
    Rows with the same identifier, source and size count as one unit and get the same copies. An empty table gives no rows.
    Input columns may have any names.
    """
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_i"), F.col(source_col).alias("_s"), F.size(words(F.col(text_col))).cast("long").alias("_w"))
    units = rows.groupBy("_i", "_s", "_w").agg((F.count(F.lit(1)) * F.col("_w")).alias("size")).select(F.col("_i").alias("_unit"), F.col("_s").alias("source"), "size", F.col("_w").alias("_one"))
    taken = copies(units, id_col="_unit", **options).where("copies > 0").select("_unit", F.col("source").alias("_of"), "_one", "copies")
    got = rows.join(taken, F.col("_i").eqNullSafe(F.col("_unit")) & F.col("_s").eqNullSafe(F.col("_of")) & (F.col("_w") == F.col("_one")))
    return got.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))
    return copies(sized).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
