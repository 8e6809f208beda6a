"""Sharding by balanced label propagation.

Documents with equal texts are linked. Every document starts in a shard by its rank, so shards differ by one row at most. In each
round a linked document asks for the shard in which most of its group already is (a group too large for one shard asks for as many
shards as it fills), and documents without links may be moved anywhere. A plan over the (from, to) counts of all shards admits as
many requests as leave every shard's size as it was: requests pay each other, and unlinked documents of a full shard make room.
Requests are then ranked and the first of each (from, to) are moved. So sizes never change, while cut links only become fewer.

Ranks are taken in buckets by a hash of the identifier and shifted by the counts of the buckets before, so no window holds more
than a bucket, whatever the skew. Only shard-by-shard counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.llm.common import cut, table, whole

SHARDS, ROUNDS = 40, 4
#: Pieces in which rows are ranked.
BUCKETS = 512
FREE = -1


def ranked(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds ``name``: the place of each row among those of its keys, from 0, by bucket and then identifier. Needs _bucket, _id, _text and size."""
    per = cut(rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n")))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # One row per key and bucket: bounded by shards and buckets, not by documents.
    shift = per.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys, "_bucket").orderBy(F.col("_id").asc_nulls_last(), "_text", "size")
    return (
        rows.withColumn("_in", F.row_number().over(inside) - 1)
        .join(shift, [*keys, "_bucket"])
        .withColumn(name, (F.col("_in") + F.col("_before")).cast("long"))
        .select(*rows.columns, name)
    )


def plan_moves(asked: dict[tuple[int, int], int], free: dict[int, int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(from, asked for, first rank, end rank, to): the requests to admit and the unlinked documents that make room, such that no shard's size changes."""
    admitted = {k: n for k, n in asked.items() if k[0] != k[1]}
    while True:
        gain = [0] * shards
        for (a, t), n in admitted.items():
            gain[t] += n
            gain[a] -= n
        over = [t for t in range(shards) if gain[t] > free.get(t, 0)]
        if not over:
            break
        for t in over:
            excess = gain[t] - free.get(t, 0)
            into = sorted(k for k in admitted if k[1] == t)
            total = sum(admitted[k] for k in into)
            left = max(0, total - excess)
            for k in into:  # cut each in proportion, what rounding leaves over from the first
                admitted[k] = admitted[k] * left // total if total else 0
    moves = [(a, t, 0, n, t) for (a, t), n in sorted(admitted.items()) if n]
    room = [(t, -g) for t, g in enumerate(gain) if g < 0]
    for t, g in enumerate(gain):
        at = 0
        while g > 0:
            to, n = room[-1]
            n = min(n, g)
            moves.append((t, FREE, at, at + n, to))
            at, g = at + n, g - n
            room[-1] = (to, room[-1][1] - n)
            if not room[-1][1]:
                room.pop()
    return moves


def propagate(rows: DataFrame, group: Column, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """rows has _id, _text, size; adds shard. group: equal values are linked, null is linked to nothing."""
    rows = cut(rows.withColumn("_group", group).withColumn("_bucket", F.pmod(F.xxhash64(F.col("_id").cast("string"), F.col("_text"), F.lit(7)), F.lit(BUCKETS)).cast("int")))
    # Rows meet their group's values by (group, bucket), so that a large group, or the rows of none, are dealt over the buckets.
    leaf = rows.where("_group IS NOT NULL").groupBy("_group", "_bucket").agg(F.count(F.lit(1)).alias("_here"))
    sizes = leaf.groupBy("_group").agg(F.sum("_here").alias("_size")).where("_size > 1")
    leaf = cut(leaf.drop("_here").join(sizes, "_group"))
    total = rows.count()
    capacity = max(1, total // shards)
    rows = ranked(rows.withColumn("_all", F.lit(0)), ["_all"], "_rank").drop("_all").withColumn("shard", F.pmod("_rank", F.lit(shards)).cast("int")).drop("_rank")
    rows = cut(rows.join(leaf, ["_group", "_bucket"], "left"))
    columns = rows.columns
    for round_ in range(rounds):
        held = rows.where("_size IS NOT NULL").groupBy("_group", "_size", "shard").agg(F.count(F.lit(1)).alias("_here"))
        best = Window.partitionBy("_group").orderBy(F.desc("_here"), F.xxhash64("_group", "shard"))
        # A group is in as many shards as there are at most.
        order = held.withColumn("_place", F.row_number().over(best)).groupBy("_group", "_size").agg(F.transform(F.sort_array(F.collect_list(F.struct("_place", "shard"))), lambda x: x["shard"]).alias("_shards"))
        targets = order.select("_group", F.slice("_shards", F.lit(1), F.ceil(F.col("_size") / capacity).cast("int")).alias("_targets"))
        pick = F.col("_targets")[F.pmod(F.xxhash64(F.col("_id").cast("string"), F.lit(round_)), F.size("_targets")).cast("int")]
        want = F.when(F.col("_size").isNull(), FREE).when(F.array_contains("_targets", F.col("shard")), F.lit(None)).otherwise(pick)
        down = leaf.drop("_size").join(targets, "_group")
        asking = cut(rows.join(down, ["_group", "_bucket"], "left").withColumn("_want", want.cast("int")).select(*columns, "_want"))
        counts = {(r["shard"], r["_want"]): r["n"] for r in asking.where("_want IS NOT NULL").groupBy("shard", "_want").agg(F.count(F.lit(1)).alias("n")).collect()}
        moves = plan_moves({k: n for k, n in counts.items() if k[1] != FREE}, {k[0]: n for k, n in counts.items() if k[1] == FREE}, shards)
        if not moves:
            rows = asking.drop("_want")
            break
        # At most two entries per pair of shards.
        plan = rows.sparkSession.createDataFrame(moves, "_from int, _asked int, _lo long, _hi long, _to int")
        asked = ranked(asking.where("_want IS NOT NULL"), ["shard", "_want"], "_rank")
        moved = asked.join(F.broadcast(plan), (F.col("shard") == F.col("_from")) & (F.col("_want") == F.col("_asked")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")), "left")
        rows = cut(moved.withColumn("shard", F.coalesce("_to", "shard")).select(*columns).unionByName(asking.where("_want IS NULL").select(*columns)))
    return rows


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """All input columns but the text, then size, text_crc32, law, shard, slot, grown_shard.

    Law ``rows``: shards differ by one row at most. size is UTF-8 bytes plus 16 (a null text has none, and is linked to no other);
    slot numbers the rows of a shard from 0 without gaps; grown_shard is always null under this law. Null identifiers and
    repeated rows are rows like others. An empty table gives no rows. Input columns with the names of result columns are replaced.
    """
    added = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    own = [c for c in docs.columns if c not in (*added, text_col, id_col)]
    text = F.col(text_col)
    sha = F.when(text.isNotNull(), F.unhex(F.sha2(text, 256)))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        *own,
        (F.octet_length(whole(text)) + 16).cast("long").alias("size"),
        F.crc32(whole(text).cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("_text"),
        sha.alias("_sha"),
    )
    placed = propagate(rows, F.col("_sha"), shards, rounds)
    out = ranked(placed, ["shard"], "slot")
    return out.select(F.col("_id").alias(id_col), *own, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
