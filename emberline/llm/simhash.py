"""SimHash near-deduplication by segment-popcount embedding.

A fingerprint is embedded as the vector of the bit counts of its segments. The Manhattan distance of two such vectors is a lower
bound of the Hamming distance, so fingerprints that differ in at most two bits lie in cells at distance two or less.

1. Grid range join. Two cells at distance two or less have a cell within distance one of both. So every distinct fingerprint
   enters its own cell and those at distance one, and the join is a grouping by cell. Cells with a single fingerprint go.
2. Exact check. Pairs of a cell are links if the fingerprints differ in two bits or fewer.
3. Crowded cells, as a cluster of near copies makes them, don't list their pairs. Each fingerprint enters the words of the cell
   within one flipped bit of it. All that meet in a word, 65 at most whatever the data, are within two bits of each other,
   and all such pairs meet; one of them is linked to the others, by the same check.

Connected components then run over distinct fingerprints by star contraction, with a checkpoint in the shared folder after each round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.llm.common import cut, shuffled, store, table, whole

SEED = 42
#: Segments of the embedding, of four bits each.
SEGMENTS, WIDTH = 16, 4
#: Bits in which linked fingerprints may differ; fingerprints of a cell whose pairs are listed.
BITS, CELL = 2, 64
#: Shingle hashes whose bits are counted at once.
PIECE = 1 << 15
#: Texts that a Python worker holds at once: Spark's ten thousand stay in memory of every worker and executor.
BATCH = 500
#: Runs into which the rows of a fingerprint are dealt when it gets its component.
RUNS = 64


def shingles(text: str, n: int) -> np.ndarray:
    """Hashes of the word n-grams of a text with repeats; a text of fewer words is one."""
    joined = b" ".join(text.encode().lower().split())  # bytes: only A-Z change, only ASCII white space separates
    if not joined:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    at = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(at + 1).tolist()], [*at.tolist(), len(joined)]
    if len(starts) <= n:
        found = [h(joined, SEED)]
    else:
        found = [h(joined[a:b], SEED) for a, b in zip(starts, ends[n - 1 :])]
    return np.array(found, np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have, as a signed 64-bit integer; zero without hashes."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), PIECE):
        counts += np.unpackbits(hashes[k : k + PIECE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint(text: str, n: int = 3) -> int:
    """SimHash of a text as a signed 64-bit integer, over its word n-grams with repeats."""
    return majority(shingles(text, n))


def fingerprints(docs: DataFrame, text_col: str = "text", n: int = 3) -> DataFrame:
    """All input columns but the text, and ``fp`` long. A text without words, or null, has fingerprint zero."""

    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t or "", n) for t in texts], dtype="int64")

    return docs.withColumn("fp", fp(F.col(text_col))).drop(text_col)


def cell_of(fp: Column) -> Column:
    """The bit counts of all segments, three bits of a long for each."""
    cell = F.lit(0).cast("long")
    for j in range(SEGMENTS):
        cell = cell + F.shiftleft(F.bit_count(F.shiftrightunsigned(fp, WIDTH * j).bitwiseAND(2**WIDTH - 1)).cast("long"), 3 * j)
    return cell


def cells_near(cell: Column) -> Column:
    """The cell itself and those at Manhattan distance one, null where a segment has no bit to give: structs (cell, seg, step)."""
    entry = lambda c, j, step: F.struct(c.alias("cell"), F.lit(j).alias("seg"), F.lit(step).alias("step"))
    out = [entry(cell, -1, 0)]
    for j in range(SEGMENTS):
        bits, one = F.shiftrightunsigned(cell, 3 * j).bitwiseAND(7), F.lit(1 << (3 * j)).cast("long")
        out += [entry(F.when(bits < WIDTH, cell + one), j, 1), entry(F.when(bits > 0, cell - one), j, -1)]
    return F.array(*out)


def words_in(fp: Column, seg: Column, step: Column) -> Column:
    """Of the words within one flipped bit of fp, those in the cell that the segment's step leads to; the rest null."""
    out = [F.when(seg < 0, fp)]
    for b in range(WIDTH):
        at = seg * WIDTH + b
        set_ = F.call_function("shiftrightunsigned", fp, at).bitwiseAND(1) == 1
        out.append(F.when((seg >= 0) & (set_ == (step < 0)), fp.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), at))))
    return F.array(*out)


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (a, b), a > b, between distinct fingerprints (column fp): enough of them that fingerprints within BITS bits are connected, and none between others.

    With more bits, also pairs within so many bits that meet in a cell of up to CELL fingerprints.
    """
    # Each fingerprint makes some thirty rows, so the small table is spread over all tasks first.
    spread = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp").withColumn("_own", cell_of(F.col("fp")))
    near = spread.select("fp", F.explode(cells_near(F.col("_own"))).alias("_c")).select("fp", "_c.*").where("cell IS NOT NULL")
    shared = near.groupBy("cell").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    met = store(near.join(shuffled(shared), "cell"))
    few = met.where(F.col("_n") <= CELL).groupBy("cell").agg(F.collect_list("fp").alias("_all"))
    few = few.select(F.explode("_all").alias("a"), "_all").select("a", F.explode("_all").alias("b"))
    words = met.where(F.col("_n") > CELL).select("fp", F.explode(words_in(F.col("fp"), F.col("seg"), F.col("step"))).alias("word")).where("word IS NOT NULL")
    meetings_ = words.groupBy("word").agg(F.sort_array(F.collect_set("fp")).alias("_all")).where(F.size("_all") > 1)
    many = meetings_.select(F.explode(F.slice("_all", 2, 65)).alias("a"), F.col("_all")[0].alias("b"))
    return few.union(many).where((F.col("a") > F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)).distinct()


def components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """(node, root) for all nodes of edges (a, b): root is the smallest node of the component. Star contraction; rounds grow with the logarithm of the longest chain. keep: how a round's edges are kept, ``cut`` or ``store``."""
    edges = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = keep(small.select("e.*").where("a <> b").distinct())
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """All input columns but the text, then fp, fingerprint (hex) and component_id, the smallest identifier among all documents that links reach.

    Null text counts as empty; texts without words have fingerprint zero and are linked like others. Null identifiers are
    passed over by the minimum; a component without any has a null component_id. Repeated rows share a component. An empty table
    gives no rows. Input columns with the names of result columns are replaced.
    """
    own = [c for c in docs.columns if c not in (text_col, "fp", "fingerprint", "component_id")]
    # Columns of the caller may have any name, so they are packed while the work is done.
    rows = cut(fingerprints(docs.select(F.struct(*own).alias("_own"), F.col(text_col).alias("_text")), "_text", n), BATCH)
    # Rows of a frequent fingerprint are dealt over the runs that hold them.
    rows = rows.withColumn("_run", F.pmod(F.xxhash64(F.col("_own")[id_col].cast("string")), F.lit(RUNS)).cast("int"))
    runs = cut(rows.groupBy("fp", "_run").agg(F.min(F.col("_own")[id_col]).alias("_first")))
    fps = cut(runs.groupBy("fp").agg(F.min("_first").alias("_first")))
    roots = components(links(fps.select("fp")))
    rooted = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "_first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("_first").alias("component_id"))
    table_ = runs.select("fp", "_run").join(shuffled(rooted.join(shuffled(named), "root").select("fp", "component_id")), "fp")
    return rows.join(shuffled(table_), ["fp", "_run"]).select("_own.*", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: similar_documents: Jaccard similarity as a fraction, the bits in which fingerprints of a cell may differ for their sets to be
#: checked (sets of this similarity differ in ten or so), and the longs of the parities that rule pairs out.
SIMILAR, REACH, PARITY = (4, 5), 24, [f"b{k}" for k in range(8)]
#: Nodes of a shingle whose pairs are listed at once; nodes in a chunk of a more crowded shingle; chunks in a band.
MOST, CHUNK, PER_KEY = 16, 64, 16
#: Crowded shingles that go to the end of the order, at most. The order only decides how many candidates there are.
COMMON = 1 << 16
#: Pairs that a block lists between two components before the nearest ones are checked.
NEAREST = 4
#: Times that prefixes are made to find them, each a pass over all texts.
ROUNDS = 2
#: Parts, at most, in which pairs are checked one after the other, to hold fewer sets on disk at once; pairs for which one part is enough.
SLICES, SLICE = 4, 1 << 14


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(shingles(text or "", n).view(np.int64))


def node_of(keys: np.ndarray) -> bytes:
    """Digest of a set, of 128 bits."""
    return xxhash.xxh3_128_digest(keys.tobytes())


def parities(keys: np.ndarray) -> np.ndarray:
    """Keys are dealt over 64 bits of each of PARITY; a bit is set if an odd number of them falls on it. Two sets differ in at least as many keys as their parities in bits."""
    size = 64 * len(PARITY)
    odd = np.bincount((keys.view(np.uint64) % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def prefix_of(keys: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first m - ceil(s m) + 1 of m sorted keys, those in the sorted array ``common`` coming after all others."""
    num, den = SIMILAR
    if not len(keys):
        return keys
    if len(common):
        last = common[np.minimum(np.searchsorted(common, keys), len(common) - 1)] == keys
        keys = np.concatenate([keys[~last], keys[last]])
    return keys[: len(keys) + (-num * len(keys)) // den + 1]


def heads(texts: DataFrame, n: int, common: np.ndarray) -> DataFrame:
    """Column h: the shingles in the prefix of each text (column _text)."""
    shared = texts.sparkSession.sparkContext.broadcast(common)

    @F.pandas_udf("array<bigint>")
    def head(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in batches:
            yield pd.Series([prefix_of(shingle_set(t, n), shared.value) for t in some])

    return texts.select(F.explode(head("_text")).alias("h"))


def crowded_shingles(texts: DataFrame, n: int) -> np.ndarray:
    """The shingles, COMMON at most, that most texts (column _text) have in their prefixes, if more than MOST have. Sorted.

    Prefixes change as crowded shingles go to their end: others, which may be as crowded, come in. So the prefixes are made again
    with what has been found, until nothing new is crowded or ROUNDS are over.
    """
    found, best = np.zeros(0, np.int64), {}
    for _ in range(ROUNDS):
        counts = store(heads(texts, n, found).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST), BATCH)
        now = {r["h"]: r["n"] for r in counts.orderBy(F.desc("n"), "h").limit(COMMON).collect()}
        if not now.keys() - best.keys():
            break
        best = {h: max(now.get(h, 0), best.get(h, 0)) for h in now.keys() | best.keys()}
        found = np.array(sorted(sorted(best, key=lambda h: (-best[h], h))[:COMMON]), np.int64)
        if len(best) > COMMON:
            break
    return found


def described(texts: DataFrame, n: int, common: np.ndarray) -> DataFrame:
    """All columns but _text, then node (the set's digest), m (its size), fp (its SimHash), its PARITY and prefix."""
    shared = texts.sparkSession.sparkContext.broadcast(common)

    @F.pandas_udf(f"node binary, m int, fp long, {', '.join(f'{b} long' for b in PARITY)}, prefix array<bigint>")
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for some in batches:
            found = [shingle_set(t, n) for t in some]
            bits = np.array([parities(k) for k in found], np.int64).reshape(-1, len(PARITY))
            yield pd.DataFrame({"node": [node_of(k) for k in found], "m": np.array([len(k) for k in found], np.int32), "fp": np.array([majority(k.view(np.uint64)) for k in found], np.int64), **dict(zip(PARITY, bits.T)), "prefix": [prefix_of(k, shared.value) for k in found]})

    return texts.withColumn("_s", sets("_text")).drop("_text").select("*", "_s.*").drop("_s")


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b), a > b, that fingerprints name: those that ``links`` joins by the grid of segment popcounts, and each set with one of its own fingerprint."""
    one = F.struct("node", F.col("node").alias("root"), "m", *PARITY)
    leaders = store(nodes.groupBy("fp").agg(F.min_by(one, "node").alias("one"), F.count(F.lit(1)).alias("_n")))
    same = nodes.join(leaders.where("_n > 1"), "fp").select(one.alias("x"), F.col("one").alias("y"))
    of = lambda end, name: leaders.select(F.col("fp").alias(end), F.col("one").alias(name))
    met = shuffled(links(leaders.select("fp"), REACH)).join(of("a", "x"), "a").join(of("b", "y"), "b").select("x", "y")
    return as_pairs(same.union(met))


def meetings(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(h, n, node, root, m, PARITY) for every shingle that n > 1 distinct sets have in their prefixes.

    Two sets of similarity s share a shingle in their prefixes, whatever the common order of shingles; crowded ones last make
    few candidates. root is the set's component by the links of fingerprints.
    """
    # All prefixes are shuffled, so under a short name; sets that share one only make more candidates.
    short = F.xxhash64("node").alias("_short")
    each = nodes.select(short, F.explode("prefix").alias("h"))
    shared = store(each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    met = store(each.join(shuffled(shared), "h"))
    known = nodes.join(roots, "node", "left").select(short, "node", F.coalesce("root", "node").alias("root"), "m", *PARITY)
    return store(met.join(shuffled(known), "_short").drop("_short"))


def may_link(x: Column, y: Column) -> Column:
    """Sizes and parities allow the similarity: two sets of s or more differ in (1 - s) / (1 + s) of the sum of their sizes at most."""
    num, den = SIMILAR
    low, high = F.least(x["m"], y["m"]), F.greatest(x["m"], y["m"])
    apart = sum((F.bit_count(x[b].bitwiseXOR(y[b])) for b in PARITY), F.lit(0))
    return (den * low >= num * high) & ((den + num) * apart <= (den - num) * (low + high))


def as_pairs(both: DataFrame) -> DataFrame:
    """Distinct (a, b), a > b, of the structs x and y that may be linked and that no link has joined."""
    a, b = F.col("x")["node"], F.col("y")["node"]
    return both.where((F.col("x")["root"] != F.col("y")["root"]) & may_link(F.col("x"), F.col("y"))).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()


def first_pairs(met: DataFrame) -> DataFrame:
    """All pairs of a shingle with up to MOST nodes; in crowded ones each node with one leader of those that share its least second hash."""
    one = F.struct("node", "root", "m", *PARITY)
    few = met.where(F.col("n") <= MOST).groupBy("h").agg(F.collect_list(one).alias("_all"))
    few = few.select(F.explode("_all").alias("x"), "_all").select("x", F.explode("_all").alias("y")).where(F.col("x")["node"] > F.col("y")["node"])
    crowd = met.where(F.col("n") > MOST)
    leaders = crowd.groupBy("h").agg(F.min_by(one, F.xxhash64("node", "h")).alias("y"))
    return as_pairs(few.select("x", "y").union(crowd.select("h", one.alias("x")).join(leaders, "h").select("x", "y")))


def block_pairs(x_nodes: list[bytes], x: np.ndarray, y_nodes: list[bytes], y: np.ndarray, h: int | None = None, x_all: list | None = None, y_all: list | None = None, most: int | None = None) -> list[tuple[bytes, bytes]]:
    """Pairs (a, b), a > b, between two chunks that sizes and parities allow; of rows (component, size, parities) those of one component are left out.

    With h, the shingle in which the chunks meet, only pairs that have no lesser one in common (x_all, y_all: those of each node).
    With most, the nearest pairs of two components only, as one link joins them; if that leaves out any, a pair of nones follows.
    """
    num, den = SIMILAR
    p, q = x.reshape(2 + len(PARITY), -1, 1), y.reshape(2 + len(PARITY), 1, -1)
    low, high = np.minimum(p[1], q[1]), np.maximum(p[1], q[1])
    may = (p[0] != q[0]) & (den * low >= num * high)
    apart = np.bitwise_count((p[2:] ^ q[2:]).view(np.uint64)).sum(axis=0, dtype=np.int64)
    at = np.argwhere(may & ((den + num) * apart <= (den - num) * (low + high)))
    if h is not None and len(at):
        own, others = {i: set(x_all[i]) for i in set(at[:, 0])}, {j: set(y_all[j]) for j in set(at[:, 1])}
        at = at[[min(own[i] & others[j]) == h for i, j in at]]
    out, listed = set(), {}
    if most is not None:
        at = at[np.argsort(apart[at[:, 0], at[:, 1]], kind="stable")]
    for i, j in at:
        pair = (max(x_nodes[i], y_nodes[j]), min(x_nodes[i], y_nodes[j]))
        if most is not None and pair not in out:
            ends = (min(p[0, i, 0], q[0, 0, j]), max(p[0, i, 0], q[0, 0, j]))
            listed[ends] = listed.get(ends, 0) + 1
            if listed[ends] > most:
                continue
        out.add(pair)
    return sorted(out) + [(None, None)] * any(n > most for n in listed.values())


def crowd_chunks(met: DataFrame, roots: DataFrame) -> DataFrame:
    """The nodes of each crowded shingle that has several components, in chunks: h, name (own, part), at, start, stop, total, keys, all (nodes, numbers, hs).

    The nodes of a large component are dealt into its own chunks, those of small ones together. at: the chunk's number of
    the shingle's ``total``, from 0, those of small components first; a large component has start to stop - 1, others have
    zeros there. keys: bands of PER_KEY chunks. hs: the node's shingles up to h, among which a pair finds its least.
    """
    crowd = met.where(F.col("n") > MOST).drop("root")
    of = crowd.join(roots, "node", "left").withColumn("root", F.xxhash64(F.coalesce("root", "node")))
    per = of.groupBy("h", "root").agg(F.count(F.lit(1)).alias("c"))
    large, of_root = F.col("c") >= CHUNK, F.ceil(F.col("c") / CHUNK)
    mixed = per.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.sum(F.when(large, 0).otherwise(F.col("c"))).alias("small"), F.sum(F.when(large, of_root).otherwise(0)).alias("parts")).where("k > 1")
    others = Window.partitionBy("h").orderBy("root").rowsBetween(Window.unboundedPreceding, -1)
    before = per.where(large).select("h", "root", F.coalesce(F.sum(of_root).over(others), F.lit(0)).alias("before"))
    of = store(of.join(per.join(mixed, "h").join(before, ["h", "root"], "left"), ["h", "root"]))
    # A pair of two components has all its shingles among these.
    of = of.join(of.groupBy("node").agg(F.collect_list("h").alias("hs")), "node").withColumn("hs", F.filter("hs", lambda x: x <= F.col("h")))
    own, shared = F.when(large, F.col("root")), F.ceil(F.col("small") / CHUNK)
    part = F.when(large, F.pmod(F.xxhash64("node"), of_root)).otherwise(F.pmod(F.xxhash64("root"), F.greatest(F.lit(1), shared)))
    start, total = F.when(large, shared + F.col("before")).otherwise(0), F.col("parts") + shared
    stop, keys = F.when(large, start + of_root).otherwise(0), F.ceil(total / PER_KEY)
    named = {"own": own, "part": part, "start": start, "stop": stop, "total": total, "keys": keys}
    chunks = of.groupBy("h", *(c.alias(name) for name, c in named.items())).agg(F.collect_list(F.struct("node", "root", F.col("m").cast("long").alias("m"), *PARITY, "hs")).alias("all"))
    numbers = F.flatten(F.array(*(F.col("all")[c] for c in ("root", "m", *PARITY))))
    return store(chunks.select("h", F.struct("own", "part").alias("name"), (F.col("start") + F.col("part")).alias("at"), "start", "stop", "total", "keys", F.struct(F.col("all")["node"].alias("nodes"), numbers.alias("numbers"), F.col("all")["hs"].alias("hs")).alias("all")))


def places(chunks: DataFrame) -> DataFrame:
    """The chunks in all places where they meet others: h, i, j (bands, i <= j), band (its own), at, stop, nodes, numbers, hs.

    Any two bands of a shingle have a place of their own, so a place gets two bands at most, whatever the size of the shingle.
    A chunk doesn't go where it would only meet its own large component.
    """
    band = F.floor(F.col("at") / PER_KEY)
    alone = lambda j: (j * PER_KEY >= F.col("start")) & (F.least((j + 1) * PER_KEY, F.col("total")) <= F.col("stop"))
    other = F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.col("keys") - 1), lambda j: ~alone(j))).alias("other")
    met = chunks.select("h", band.alias("band"), other, "at", "stop", "all.*")
    return met.select("h", F.least("band", "other").alias("i"), F.greatest("band", "other").alias("j"), "band", "at", "stop", "nodes", "numbers", "hs")


def cross_pairs(met: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """Pairs of crowded shingles whose nodes no link has joined yet, of all such pairs those that sizes and parities allow.

    Chunks of a shingle meet in ``places`` of bounded size and are compared block by block, those of one large component
    excepted: only pairs that may be links become rows, each in a block of the least of the shingles that both have. With
    most, a block lists so many pairs of two components, and rows of nulls tell that there are more.
    """

    def compared(key: tuple, some: pd.DataFrame) -> pd.DataFrame:
        (h, i, j), found = key, set()
        rows = [(r.band, r.at, r.stop, r.nodes, np.asarray(r.numbers, np.int64), r.hs) for r in some.itertuples(index=False)]
        for p, at, stop, x_nodes, x, x_all in rows:
            for q, to, end, y_nodes, y, y_all in rows:
                if (p, q) == (i, j) and at <= to and not (stop and stop == end):
                    found.update(block_pairs(x_nodes, x, y_nodes, y, int(h), x_all, y_all, most))
        return pd.DataFrame(list(found), columns=["a", "b"])

    return places(crowd_chunks(met, roots)).groupBy("h", "i", "j").applyInPandas(compared, "a binary, b binary")


def verified(pairs: DataFrame, texts: DataFrame, firsts: DataFrame, n: int) -> DataFrame:
    """Of pairs (a, b), a stored table, those whose sets have the similarity. The sets of these nodes only are made again, each from one text."""
    num, den = SIMILAR
    slices = min(SLICES, -(-pairs.count() // SLICE))
    if not slices:
        return pairs.select("a", "b")

    @F.pandas_udf("node binary, keys array<bigint>")
    def again(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for some in batches:
            found = [shingle_set(t, n) for t in some]
            yield pd.DataFrame({"node": [node_of(k) for k in found], "keys": found})

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(firsts, "node").select("_digest")
    some = texts.join(wanted, "_digest", "left_semi").dropDuplicates(["_digest"]).select(again("_text").alias("_s")).select("_s.*")
    sets = store(some.groupBy("node").agg(F.first("keys").alias("keys")), BATCH)
    out = None
    for k in range(slices):
        part = pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(slices)) == k)
        both = part.join(sets.select(F.col("node").alias("a"), F.col("keys").alias("_p")), "a").join(sets.select(F.col("node").alias("b"), F.col("keys").alias("_q")), "b")
        links = store(both.where((num + den) * F.size(F.array_intersect("_p", "_q")) >= num * (F.size("_p") + F.size("_q"))).select("a", "b"))
        out = links if out is None else out.union(links)
    return out


def rejoined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) with further links (a, b). What is joined already comes as stars, so rounds are few; without a link nothing is made again."""
    if links.isEmpty():
        return roots
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links.select("a", "b")), store)


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5) -> DataFrame:
    """All input columns but the text, then component_id: the smallest identifier among all documents that links reach.

    A link joins documents whose sets of word n-grams (as in ``fingerprint``) have Jaccard similarity SIMILAR or more. First come
    pairs whose SimHash fingerprints (of the sets) meet in the grid of segment popcounts, within REACH bits; the sets decide.
    Sets of this similarity can be further apart than the grid reaches, so an exact search for the rest follows: what
    these links have not joined are candidates if they share a shingle of their prefixes. As a fingerprint's segments bound the Hamming
    distance from below, so do parities of the set the number of shingles in which two texts differ; they rule out no link,
    and the sets decide. No pair is left out for the size of its group: pairs of crowded shingles are left out only where
    links join the two already. Texts without words are one component. Nulls, repeated rows and empty tables as in ``near_duplicates``.
    """
    own = [c for c in docs.columns if c not in (text_col, "component_id")]
    # Columns of the caller may have any name, so they are packed while the work is done.
    texts = docs.select(F.struct(*own).alias("_own"), F.unhex(F.md5(whole(F.col(text_col)))).alias("_digest"), F.col(text_col).alias("_text"))
    rows = store(described(texts, n, crowded_shingles(texts, n)), BATCH)
    firsts = store(rows.groupBy("node").agg(F.min(F.col("_own")[id_col]).alias("_first"), F.min("_digest").alias("_digest"), *(F.first(c).alias(c) for c in ("m", "fp", *PARITY, "prefix"))))
    roots = components(verified(store(fingerprint_pairs(firsts)), texts, firsts, n), store)
    met = meetings(firsts, roots)
    roots = rejoined(roots, verified(store(first_pairs(met)), texts, firsts, n))
    for most in (NEAREST, None):
        more = store(cross_pairs(met, roots, most), BATCH)
        roots = rejoined(roots, verified(store(more.where("a IS NOT NULL").distinct()), texts, firsts, n))
        if more.where("a IS NULL").isEmpty():
            break
    rooted = firsts.join(roots, "node", "left").select("node", "_first", F.coalesce("root", "node").alias("root"))
    named = rooted.groupBy("root").agg(F.min("_first").alias("component_id"))
    return rows.select("_own", "node").join(shuffled(rooted.join(shuffled(named), "root").select("node", "component_id")), "node").select("_own.*", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fingerprint", "component_id")
