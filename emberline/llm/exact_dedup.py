"""Exact deduplication by a tree merge of sorted digest runs, in DataFrame operations only.

Rows are dealt into ``runs`` runs by a hash of their identifier. Within a run equal texts meet by digest, which leaves
one entry per (run, digest): the identifier to keep and the count. A run is cut into slices by the first hex digits of the
digest, so that no task holds a whole run. In each round ``fan_in`` runs go to one place, slice by slice, and are merged there
in the order of their digests: as a run has a digest once, equal ones are at most ``fan_in`` neighbours, of which the first has
the identifier to keep and takes the counts of the others. Each round leaves one verified entry per digest and run, until one
run is left. Verified means that neighbours agree in all three of SHA-256, XXH64 and byte length. Finally the winners go back down:
entry by entry to the runs that hold the digest, then to the rows of that run. A text that a third of all rows share is thus never
gathered in one place: it has at most ``runs`` entries on the way up and its rows are dealt by (digest, run) on the way down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.llm.common import table, whole

KEY = ["_sha", "_xx", "_len"]
#: Hex digits of the digest that name a slice: 4096 slices of a run.
DIGITS = 3


def merge_runs(level: DataFrame, fan_in: int, keep: str) -> DataFrame:
    """One round: entries (_run, _slice, _key, _keep, _n) of ``fan_in`` sorted runs each, merged by position into one run."""
    first = F.asc_nulls_last("_keep") if keep == "smallest" else F.desc_nulls_last("_keep")
    place = Window.partitionBy("_run", "_slice").orderBy("_key", first)
    n = F.col("_n")
    for k in range(1, fan_in):
        n = n + F.when(F.lead("_key", k).over(place) == F.col("_key"), F.lead("_n", k).over(place)).otherwise(0)
    met = level.withColumn("_run", F.floor(F.col("_run") / fan_in).cast("int"))
    again = F.coalesce(F.lag("_key").over(place) == F.col("_key"), F.lit(False))
    return met.select("_run", "_slice", "_key", "_keep", n.alias("_n"), again.alias("_again")).where("NOT _again").drop("_again")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", runs: int = 256, fan_in: int = 4) -> DataFrame:
    """One row per input row: all input columns, then keep_id, group_size, kept, text_sha256.

    keep: ``smallest`` or ``largest`` identifier of each group of equal texts stays. Null text counts as empty. A null
    identifier ranks behind all others: keep_id is null, and its rows are kept, only where a whole group has none. Rows that
    repeat both identifier and text count in group_size and are marked alike. An empty table gives no rows. Input columns
    with the names of result columns are replaced.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    best = F.min if keep == "smallest" else F.max
    added = ["keep_id", "group_size", "kept", "text_sha256"]
    rows = docs.drop(*(c for c in docs.columns if c in added)).withColumns(
        {
            "_run": F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(runs)).cast("int"),
            "_sha": F.unhex(F.sha2(whole(F.col(text_col)), 256)),
            "_xx": F.xxhash64(whole(F.col(text_col))),
            "_len": F.octet_length(whole(F.col(text_col))),
        }
    )
    leaf = rows.groupBy("_run", *KEY).agg(best(id_col).alias("_keep"), F.count(F.lit(1)).alias("_n"))
    level, left = leaf.select("_run", F.left(F.hex("_sha"), F.lit(DIGITS)).alias("_slice"), F.struct(*KEY).alias("_key"), "_keep", "_n"), runs
    while left > 1:
        level, left = merge_runs(level, fan_in, keep), -(-left // fan_in)
    winners = level.select("_key.*", F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"))
    down = leaf.select("_run", *KEY).join(winners, KEY)
    return (
        rows.join(down, ["_run", *KEY])
        .withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")))
        .withColumn("text_sha256", F.lower(F.hex("_sha")))
        .select(*(c for c in docs.columns if c not in added), *added)
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs, keep="largest").drop("text")


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
