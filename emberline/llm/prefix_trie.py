"""Trie of conversations: every distinct sequence of first turns is a node, with the conversations that begin with it.

1. Turns are numbered within their conversation, and dealt by (conversation, chunk of turns), so that a conversation of any length is
   never one task's. A numpy scan walks the sorted turns and gives each the polynomial fingerprint of the prefix that ends with
   it: the sum of turn hash times base to the power of depth, modulo two primes. As it is a sum, chunks are scanned apart and the
   totals of the chunks before are added after.
2. Prefixes of one depth and fingerprint are a candidate group. Its members' last turns are grouped once more by role and text as they are,
   and by the fingerprint of the prefix before: a group that is one node has one such entry. If all groups have one, then by
   induction over the depth all prefixes of a group are equal turn by turn. Where a group has more, two sequences collide:
   the conversations of that group get a fingerprint with another base from there on, until all groups are one entry.
3. Rollup to the parents without a walk over levels: the smallest member of a node owns it, and what it owns are the last turns of its
   own conversation, so the trie falls into one path for each owner. The sum over a subtree is the suffix sum on the owner's path plus
   the totals of the other members' paths; each is one aggregation, whatever the depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.llm.common import cut, store, table

#: Turns of a conversation that are scanned in one piece, and turn numbers that are sorted in one piece.
CHUNK = 1024
#: Primes of the fingerprint, below 2^31 so that a product fits into 64 bits.
PRIMES = (2147483647, 2147483629)
#: Most identifiers that are joined into one string.
IDS = 512


def order_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text): turns numbered from 1, by turn (null first), ties by role and text. Null role or text counts as empty; rows without a conv_id are of no conversation and go.

    Turns are sorted by (conversation, block of turn numbers); only counts of blocks meet by conversation."""
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", F.expr(f"turn div {CHUNK}").alias("_b"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    block = Window.partitionBy("conv_id", "_b")
    numbered = rows.withColumn("_k", F.row_number().over(block.orderBy(F.col("turn").asc_nulls_first(), "role", "text")))
    before = Window.partitionBy("conv_id").orderBy(F.col("_b").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_off", F.sum("_n").over(before)).where("_off > 0")
    at = blocks.select(F.col("conv_id").alias("_c"), F.col("_b").alias("_at"), "_off")
    both = numbered.join(at, (F.col("conv_id") == F.col("_c")) & F.col("_b").eqNullSafe(F.col("_at")), "left")
    return both.select("conv_id", (F.coalesce("_off", F.lit(0)) + F.col("_k")).cast("long").alias("pos"), "role", "text")


def rebuilt(conversations: DataFrame, base: Column, lead: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """(turns, ids): every conversation with its first ``lead`` turns (up to most) exchanged for the first ones of the conversation ``base``: all of them where that has fewer, none where it is absent.

    turns: conv_id, depth from 1, role, text. ids: every conv_id, those that are left without turns too. base and lead are columns
    over conv_id."""
    ordered = order_turns(conversations)
    lengths = conversations.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n"))
    plan = lengths.select("conv_id", base.alias("_base"), lead.cast("long").alias("_lead")).join(lengths.select(F.col("conv_id").alias("_base"), F.col("_n").alias("_of_base")), "_base", "left")
    plan = plan.withColumn("_given", F.least("_lead", F.coalesce("_of_base", F.lit(0))))
    own = ordered.join(plan.select("conv_id", "_lead", "_given"), "conv_id").where("pos > _lead").select("conv_id", (F.col("pos") - F.col("_lead") + F.col("_given")).alias("depth"), "role", "text")
    # Bases give a few turns each.
    first = ordered.where(base.eqNullSafe(F.col("conv_id")) & (F.col("pos") <= most)).select(F.col("conv_id").alias("_base"), "pos", "role", "text")
    given = plan.where("_given > 0").select("conv_id", "_base", "_given").join(first, "_base").where("pos <= _given").select("conv_id", F.col("pos").alias("depth"), "role", "text")
    return own.unionByName(given), lengths.select("conv_id")


def powers(base: int, at: np.ndarray, prime: int) -> np.ndarray:
    """base to each of the powers, by squaring."""
    out, square, left = np.ones(len(at), np.int64), base % prime, at.astype(np.int64).copy()
    while left.any():
        out = np.where(left & 1, out * square % prime, out)
        square, left = square * square % prime, left >> 1
    return out


def scan(bases: tuple[int, int], primes: tuple[int, int] = PRIMES):
    """A column function of (conv_id, chunk, depth, turn hash) over rows sorted so: the sums of the chunk up to a row (a, b) and up to the row before (pa, pb). State goes on from batch to batch."""

    def batches(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        last, carry = None, [0, 0]
        for part in parts:
            conv, chunk, depth, turn = (np.asarray(x, np.int64) for x in part)
            n, out = len(conv), {}
            if not n:
                yield pd.DataFrame({c: np.zeros(0, np.int64) for c in ("a", "b", "pa", "pb")})
                continue
            starts = np.flatnonzero(np.r_[True, (conv[1:] != conv[:-1]) | (chunk[1:] != chunk[:-1])])
            piece = np.zeros(n, np.int64)
            piece[starts[1:]] = 1
            piece = np.cumsum(piece)
            goes_on = last == (conv[0], chunk[0])
            for k, (name, base, prime) in enumerate(zip("ab", bases, primes, strict=True)):
                term = turn % prime * powers(base, depth, prime) % prime
                total = np.cumsum(term)
                within = total - (total[starts] - term[starts])[piece]
                if goes_on:
                    within[piece == 0] += carry[k]
                within %= prime
                out[name], out[f"p{name}"] = within, (within - term) % prime
                carry[k] = int(within[-1])
            last = (conv[-1], chunk[-1])
            yield pd.DataFrame(out)[["a", "b", "pa", "pb"]]

    # The order of rows matters, so the sort below must stay.
    return F.pandas_udf(batches, "a long, b long, pa long, pb long").asNondeterministic()


def fingerprints(turns: DataFrame, seed: int, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """turns with ``_key`` and ``_parent``: fingerprints of the prefix that ends with a turn and of the one before. Kept in the shared folder."""
    rng = np.random.Generator(np.random.Philox(seed))
    bases = tuple(int(rng.integers(2, p)) for p in primes)
    rows = turns.withColumn("_chunk", F.expr(f"(depth - 1) div {CHUNK}")).repartition("conv_id", "_chunk").sortWithinPartitions("conv_id", "_chunk", "depth")
    one = scan(bases, primes)(F.col("conv_id"), F.col("_chunk"), F.col("depth"), F.xxhash64("role", "text", F.lit(seed)))
    scanned = store(rows.withColumn("_s", one))
    # The sums of full chunks go to all chunks after them.
    ends = scanned.where(f"depth % {CHUNK} = 0").select("conv_id", (F.col("_chunk") + 1).alias("_chunk"), F.col("_s.a").alias("_a"), F.col("_s.b").alias("_b"))
    upto = Window.partitionBy("conv_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumns({c: F.sum(c).over(upto) for c in ("_a", "_b")})
    whole = lambda a, b: F.pmod(F.col(f"_s.{a}") + F.coalesce("_a", F.lit(0)), F.lit(primes[0])) * primes[1] + F.pmod(F.col(f"_s.{b}") + F.coalesce("_b", F.lit(0)), F.lit(primes[1]))
    # Before the first turn nothing is summed, which is the root's key 0.
    return scanned.join(ends, ["conv_id", "_chunk"], "left").select(*turns.columns, whole("a", "b").alias("_key"), whole("pa", "pb").alias("_parent"))


def candidates(keyed: DataFrame) -> DataFrame:
    """One entry for each depth, fingerprint, fingerprint before, role and text: the smallest member and their number."""
    entries = keyed.groupBy("depth", "_key", "_parent", "role", "text").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    return entries.select("depth", "_key", "_parent", "conv_id", "n_convs", "role", F.length("text").cast("long").alias("n_chars"))


def verified(turns: DataFrame, primes: tuple[int, int] = PRIMES, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(keyed turns, entries): groups by depth and fingerprint, split until each is one sequence of turns."""
    keyed = fingerprints(turns, seed, primes)
    while True:
        entries = store(candidates(keyed))
        split = entries.groupBy("depth", "_key").agg(F.count(F.lit(1)).alias("_e")).where("_e > 1").select("depth", "_key")
        if split.isEmpty():
            return keyed, entries
        # Another fingerprint for the conversations of split groups, from the first such depth on.
        seed += 1
        hit = cut(keyed.join(split, ["depth", "_key"], "left_semi").groupBy("conv_id").agg(F.min("depth").alias("_from")))
        more = fingerprints(keyed.join(hit, "conv_id", "left_semi").select("conv_id", "depth", "role", "text"), seed, primes)
        more = more.select("conv_id", "depth", F.col("_key").alias("_k"), F.col("_parent").alias("_p")).join(hit, "conv_id").where("depth >= _from")
        both = keyed.join(more, ["conv_id", "depth"], "left")
        again = lambda c, m, when: F.when(when, F.xxhash64(c, m, F.lit(seed))).otherwise(F.col(c)).alias(c)
        keyed = store(both.select("conv_id", "depth", "role", "text", again("_key", "_k", F.col("_k").isNotNull()), again("_parent", "_p", F.col("_k").isNotNull() & (F.col("depth") > F.col("_from")))))


def prefix_trie(turns: DataFrame, ids: DataFrame, primes: tuple[int, int] = PRIMES) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of the trie of turns (conv_id long, depth from 1 without gaps, role, text); ids: all conv_ids, turnless ones too.

    nodes: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens, role (of the
    last turn) and n_chars (its code points). (conv_id, depth) tells nodes apart and finds a node's turn in turns. ends: where each
    conversation ends, as (depth, node key, conv_id). Equal conversations end in one node. Null role or text must be empty
    before (as order_turns makes them). Without conversations there is no node, not even the root.
    """
    keyed, entries = verified(turns, primes)
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("_key"), F.lit(None).cast("long").alias("_parent"), "conv_id", "n_convs", F.lit(None).cast("string").alias("role"), F.lit(0).cast("long").alias("n_chars"))
    nodes = entries.unionByName(root).withColumn("_gain", (F.col("n_convs") - 1) * F.col("n_chars"))
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("_parent").alias("_key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(kids, ["depth", "_key"], "left").fillna(0, ["n_children"]).withColumn("_leaf", (F.col("n_children") == 0).cast("long"))
    nodes = store(nodes)
    # Per owner: all that its path saves, and whether it ends in a leaf. On the path: what the node and those below it save.
    owners = nodes.groupBy("conv_id").agg(F.sum("_gain").alias("_all"), F.sum("_leaf").alias("_leaf"))
    piece = F.expr(f"depth div {CHUNK}")
    deeper = Window.partitionBy("conv_id", "_piece").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    below = Window.partitionBy("conv_id").orderBy(F.desc("_piece")).rowsBetween(Window.unboundedPreceding, -1)
    path = nodes.withColumn("_piece", piece).withColumn("_own", F.sum("_gain").over(deeper))
    pieces = nodes.groupBy("conv_id", piece.alias("_piece")).agg(F.sum("_gain").alias("_g")).withColumn("_below", F.coalesce(F.sum("_g").over(below), F.lit(0))).where("_below > 0").drop("_g")
    path = path.join(pieces, ["conv_id", "_piece"], "left").select("depth", "_key", "_parent", "conv_id", "n_convs", "n_children", "role", "n_chars", (F.col("_own") + F.coalesce("_below", F.lit(0))).alias("_own"))
    # Members: narrow rows, one for each prefix of each conversation.
    members = keyed.select("conv_id", "depth", "_key").unionByName(ids.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("_key")))
    sums = members.join(owners, "conv_id").groupBy("depth", "_key").agg(F.sum("_all").alias("_sum"), F.sum("_leaf").alias("n_leaves"))
    own_all = owners.select("conv_id", "_all")
    out = path.join(sums, ["depth", "_key"]).join(own_all, "conv_id").withColumn("saved_tokens", F.col("_sum") - F.col("_all") + F.col("_own"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("_key").alias("_parent"), F.col("conv_id").alias("parent_conv_id"))
    out = out.join(parents, ["depth", "_parent"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "role", "n_chars", "_key")
    ends = members.groupBy("conv_id").agg(F.max(F.struct("depth", "_key")).alias("_e")).select("_e.depth", "_e._key", "conv_id")
    return out, ends


def digest_ids(ends: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ends_sha256): SHA-256 of the ascending conv_ids of each key, comma-joined.

    Identifiers of a range are joined first, some hundred at most; a task then runs over the sorted pieces of a key without holding them."""
    pieces = ends.groupBy(*keys, F.floor(F.col("conv_id") / IDS).alias("_piece")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("_ids"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for b in batches:
            done = []
            for *own, ids in b[[*keys, "_ids"]].itertuples(index=False):
                if own != key:
                    if key is not None:
                        done.append([*key, state.hexdigest()])
                    key, state = own, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pd.DataFrame(done, columns=[*keys, "ends_sha256"])
        if key is not None:
            yield pd.DataFrame([[*key, state.hexdigest()]], columns=[*keys, "ends_sha256"])

    schema = ", ".join(f"{c} {t}" for c, t in ends.select(*keys).dtypes) + ", ends_sha256 string"
    return pieces.repartition(*keys).sortWithinPartitions(*keys, "_piece").select(*keys, "_ids").mapInPandas(digest, schema)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rebuilt conversations: the first crc32(conv_id) % 6 turns come from the conversation at the hundred below. % is SQL's, so the base of a negative conv_id lies above it."""
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    c = F.col("conv_id")
    turns, ids = rebuilt(conversations, c - c % 100, F.crc32(c.cast("string").cast("binary")) % 6, 5)
    nodes, ends = prefix_trie(turns, ids)
    digests = digest_ids(ends, ["depth", "_key"])
    empty = hashlib.sha256(b"").hexdigest()
    return nodes.join(digests, ["depth", "_key"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(empty))).drop("_key")
