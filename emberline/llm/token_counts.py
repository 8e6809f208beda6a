"""Exact length histogram of encoded documents, and the suffix sums over it that answer totals, quantiles and truncated totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.llm.bpe import default_path, token_count
from emberline.llm.common import cut, table

#: Lengths that are summed in one piece; the pieces are then summed themselves.
PIECE = 1024


def length_histogram(docs: DataFrame, length_col: str = "n_tokens", by: tuple[str, ...] = ()) -> DataFrame:
    """One row per group and distinct length.

    Columns: the group's, n_tokens, n_docs, docs_at_least and tokens_at_least (documents of this length or more, and their
    tokens), total_docs, total_tokens, truncated_total (tokens left when every document is cut to this length) and
    share_at_most (documents of this length or less). Null lengths count as 0; null group values are a group. An empty table
    gives no rows. Counts meet by group and length before they move, so a large group is as cheap as a small one.
    """
    by = list(by)
    # Encoding is the costly part: its histogram is kept, so that both sums below start from it.
    counts = cut(docs.groupBy(*by, F.coalesce(F.col(length_col), F.lit(0)).cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs")))
    counts = counts.withColumn("_piece", F.expr(f"n_tokens div {PIECE}"))
    longer_first = Window.partitionBy(*by, "_piece").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    within = counts.withColumns({"_docs": F.sum("n_docs").over(longer_first), "_tokens": F.sum(F.col("n_docs") * F.col("n_tokens")).over(longer_first)})

    above = Window.partitionBy(*by).orderBy(F.desc("_piece")).rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy(*by)
    pieces = counts.groupBy(*by, "_piece").agg(F.sum("n_docs").alias("_d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("_t"))
    pieces = pieces.select(
        *[F.col(c).alias(f"_by_{c}") for c in by],
        F.col("_piece").alias("_p"),
        F.coalesce(F.sum("_d").over(above), F.lit(0)).alias("_d_above"),
        F.coalesce(F.sum("_t").over(above), F.lit(0)).alias("_t_above"),
        F.sum("_d").over(all_).alias("total_docs"),
        F.sum("_t").over(all_).alias("total_tokens"),
    )
    same = F.col("_piece") == F.col("_p")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    out = within.join(pieces, same).withColumns({"docs_at_least": F.col("_docs") + F.col("_d_above"), "tokens_at_least": F.col("_tokens") + F.col("_t_above")})
    return out.select(
        *by,
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        "total_docs",
        "total_tokens",
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
        ((F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("total_docs")).alias("share_at_most"),
    )


def at_limit(hist: DataFrame, limit: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Per group, for any context limit: docs_over (longer than it), tokens_kept when documents are cut to it, total_tokens. Read off the shortest length above the limit."""
    over = F.col("n_tokens") > limit
    first = F.min_by(F.when(over, F.struct("docs_at_least", "tokens_at_least")), F.when(over, F.col("n_tokens")))
    return hist.groupBy(*by).agg(first.alias("_f"), F.first("total_tokens").alias("total_tokens")).select(
        *by,
        F.coalesce("_f.docs_at_least", F.lit(0)).alias("docs_over"),
        (F.col("total_tokens") - F.coalesce("_f.tokens_at_least", F.lit(0)) + limit * F.coalesce("_f.docs_at_least", F.lit(0))).alias("tokens_kept"),
        "total_tokens",
    )


def quantile(hist: DataFrame, q: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Per group the smallest length that at least a share q of its documents do not exceed."""
    return hist.where(F.col("share_at_most") >= q).groupBy(*by).agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, by: tuple[str, ...] = (), text_col: str = "text") -> DataFrame:
    """The histogram of documents with texts: a null text has no tokens."""
    n = token_count(path, docs.sparkSession)
    return length_histogram(docs.select(*by, n(F.col(text_col)).alias("n_tokens")), "n_tokens", by)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("source", "text"), default_path(), ("source",))
