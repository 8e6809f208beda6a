"""Removal of repeated byte strings with suffix arrays.

A byte is removed if a string of WINDOW bytes that covers it also starts earlier: in a document of smaller identifier, or
further up in the same one. Windows are brought together by their anchors, see anchors.py: equal windows have equal anchors,
so each anchor's windows can be compared on their own.

1. Anchors that occur once are dropped. They are counted by hash with pre-aggregation.
2. Of equal contexts of an anchor the first stays, and all windows of the others are repeats.
3. Where an anchor has different contexts, these are cut out of the texts and dealt into blocks of bounded size. Windows whose
   hash no other window of the block has are left out. A suffix array of what remains, by linear grouping, puts windows of
   equal bytes side by side, and all but the first of them are repeats.
4. An anchor with more contexts than a block takes would be one task's work. Each of its contexts is halved: windows that reach
   far to the left of the anchor share more bytes there, the others share more to the right. These bytes make a narrower key,
   of which equal halves are one again, and crowded keys are halved further, until all go into blocks. The shared bytes double their
   way to WINDOW, so there are eight levels at most.
5. Repeats are collected per document and cut out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.anchors import GRAM, WINDOW, blocks, hashes, runs
from emberline.llm.common import store, table
from emberline.llm.suffix import suffix_array

#: Contexts in a block, on average; contexts of one key that may be in a block.
PER_BLOCK, MOST = 300, 1500
#: A document: its identifier, and the digest of its text, which tells apart rows that repeat an identifier with other texts.
DOC = ["doc_id", "v"]
#: A place, in the order that says what is earlier.
PLACE = "struct(doc_id, v, pos)"
#: Runs into which the rows of a context are dealt, by document, when they learn which of them is the first.
RUNS = 32
RUN = f"cast(pmod(xxhash64(doc_id), {RUNS}) AS int)"
#: Bytes of a symbol on the right of an anchor.
CHUNK = 8
#: Rows of windows that are compared at once.
ROWS = 1 << 16


def anchor_runs(docs: DataFrame) -> DataFrame:
    """docs has doc_id, v and text. One row per run: h (anchor hash), c (context hash), doc_id, v, pos (first window), n (windows)."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, v = b["doc_id"].to_numpy(), b["v"].to_numpy()
            for data, number, place, starts, lengths in blocks([t.encode() for t in b["text"]]):
                part, first, n, h, c = runs(data, starts, lengths)
                yield pd.DataFrame({"h": h.view(np.int64), "c": c.view(np.int64), "doc_id": ids[number[part]], "v": v[number[part]], "pos": first - starts[part] + place[part], "n": n.astype(np.int32)})

    return docs.where(f"doc_id IS NOT NULL AND octet_length(text) >= {WINDOW}").select(*DOC, "text").mapInPandas(found, "h long, c long, doc_id long, v long, pos long, n int")


def cut_contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted has h, doc_id, v, pos, n, crowded. A row per context with its bytes; ``at`` is the anchor's place in them if crowded, or else -1."""
    per_doc = wanted.groupBy(*DOC).agg(F.collect_list(F.struct("h", "pos", "n", "crowded")).alias("runs"))

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, v, text, some in zip(b["doc_id"], b["v"], b["text"], b["runs"]):
                raw = text.encode()
                for r in some:
                    piece, at = raw[r["pos"] : r["pos"] + r["n"] + WINDOW - 1], -1
                    if r["crowded"]:  # all windows hold the anchor, so it starts in the last one
                        grams = hashes(np.frombuffer(piece, np.uint8))[0].view(np.int64)[r["n"] - 1 :]
                        at = r["n"] - 1 + int(np.argmax(grams == r["h"]))
                    rows.append((r["h"], i, v, r["pos"], r["n"], at, piece))
            yield pd.DataFrame(rows, columns=["h", "doc_id", "v", "pos", "n", "at", "bytes"])

    return docs.select(*DOC, "text").dropDuplicates(DOC).join(per_doc, DOC).mapInPandas(found, "h long, doc_id long, v long, pos long, n int, at int, bytes binary")


def halves(pieces: DataFrame) -> DataFrame:
    """Pieces whose windows all hold the ``core`` bytes from ``at`` on, as pieces that share more: on the left of these bytes, or on their right."""
    slack = F.lit(WINDOW) - F.col("core")
    half = F.ceil(slack / 2).cast("int")
    split = pieces.withColumn("_half", half).withColumn("_n", F.greatest(F.lit(0), F.least(F.col("n"), F.col("at") - F.col("_half") + 1)))
    left = F.struct(F.lit(0).alias("side"), F.col("pos"), F.col("_n").alias("n"), (F.col("at") - F.col("_half")).alias("at"), (F.col("core") + F.col("_half")).alias("core"), F.substring("bytes", F.lit(1), F.col("_n") + WINDOW - 1).alias("bytes"))
    right = F.struct(F.lit(1).alias("side"), (F.col("pos") + F.col("_n")).alias("pos"), (F.col("n") - F.col("_n")).alias("n"), (F.col("at") - F.col("_n")).alias("at"), (F.lit(WINDOW) - F.col("_half") + 1).alias("core"), F.substring("bytes", F.col("_n") + 1, F.col("n") - F.col("_n") + WINDOW - 1).alias("bytes"))
    both = split.select("h", *DOC, F.explode(F.array(left, right)).alias("_p")).select("h", *DOC, "_p.*").where("n > 0")
    key = F.xxhash64("h", "side", F.substring("bytes", F.col("at") + 1, F.col("core")))
    return both.select(key.alias("h"), *DOC, "pos", "n", "at", "core", "bytes")


def candidates(window: np.ndarray, has: np.ndarray) -> np.ndarray:
    """Which of the windows at places ``has`` share their hash with another one of them, as flags of all places."""
    h = window[has]
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    out = np.zeros(len(window) + WINDOW - 1, bool)
    out[has[order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]]] = True
    return out


def edges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def symbols(data: np.ndarray, place: np.ndarray, beyond: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places that get a symbol, and their symbols from 1 on. ``beyond`` is the distance of each place from its piece's ``at``.

    Bytes before ``at`` are symbols of their own. From there on CHUNK bytes are one, numbered in the order of their bytes, so that
    suffixes with a common beginning stay neighbours even where it ends within a chunk. Equal windows have ``at`` at equal places.
    """
    keep = (beyond < 0) | (beyond % CHUNK == 0)
    place, chunk = place[keep], beyond[keep] >= 0
    out = data[place].astype(np.int64) + 1
    padded = np.concatenate([data, np.zeros(CHUNK, np.uint8)])
    values = padded[place[chunk][:, None] + np.arange(CHUNK)].view(">u8").ravel().astype(np.uint64)
    out[chunk] = 257 + np.unique(values, return_inverse=True)[1]
    return place, out


def repeated(data: np.ndarray, owner: np.ndarray, at: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Which windows with an owner have the bytes of an earlier one that has, by a suffix array of the candidates' bytes. ``at`` is the place of shared bytes for each owner, ``window`` has the hashes of windows."""
    out = np.zeros(len(data), bool)
    some = candidates(window, np.flatnonzero(owner[: len(window)] >= 0))
    if not some.any():
        return out
    # The bytes of all candidates one after the other. Windows lie within them whole, so no marks are needed between.
    covered = np.zeros(len(data) + WINDOW, np.int64)
    lo, hi = edges(some)
    covered[lo] += 1
    covered[hi + WINDOW - 1] -= 1
    place = np.flatnonzero(np.cumsum(covered)[: len(data)])
    last = np.maximum.accumulate(np.where(owner >= 0, owner, 0))
    place, text = symbols(data, place, place - at[last[place]])
    order = np.array(suffix_array([*text.tolist(), 0]))[1:]
    at = place[order[some[place][order]]]
    # Neighbours with the same bytes are a class; its first window in the block's order stays.
    rows = np.lib.stride_tricks.sliding_window_view(data, WINDOW)
    differ = [np.ones(1, bool)]
    for k in range(0, len(at) - 1, ROWS):
        some = rows[at[k : k + ROWS + 1]]
        differ.append((some[1:] != some[:-1]).any(axis=1))
    start = np.flatnonzero(np.concatenate(differ))
    first = np.minimum.reduceat(at, start)
    out[at] = True
    out[first] = False
    return out


def repeats_in_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Windows of a block that also start earlier in it, as runs (doc_id, v, pos, n)."""
    pdf = pdf.drop_duplicates([*DOC, "pos", "h"]).sort_values([*DOC, "pos", "h"])
    n, size = pdf["n"].to_numpy(), np.array([len(b) for b in pdf["bytes"]])
    starts = np.cumsum(size) - size
    data = np.frombuffer(b"".join(pdf["bytes"]), np.uint8)
    gram, window = hashes(data)
    owner = np.repeat(np.arange(len(pdf)), size)
    offset = np.arange(len(owner)) - starts[owner]
    # The anchor starts in the last window at the earliest, and is the first of its hash there.
    anchor = np.flatnonzero((gram == pdf["h"].to_numpy().view(np.uint64)[owner[: len(gram)]]) & (offset[: len(gram)] >= n[owner[: len(gram)]] - 1))
    at = starts + pdf["at"].to_numpy()
    calm = np.flatnonzero(pdf["at"].to_numpy() < 0)
    at[calm] = anchor[np.searchsorted(anchor, starts[calm])]
    owner[offset >= n[owner]] = -1
    lo, hi = edges(repeated(data, owner, at, window))
    own = owner[lo]
    return pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[own], "v": pdf["v"].to_numpy()[own], "pos": pdf["pos"].to_numpy()[own] + lo - starts[own], "n": (hi - lo).astype(np.int32)})


def in_blocks(pieces: DataFrame) -> DataFrame:
    """Repeats among pieces of equal key h, of which no key has more than a block takes."""
    n_blocks = max(1, pieces.count() // PER_BLOCK)
    block = F.pmod(F.xxhash64("h"), F.lit(n_blocks))
    return pieces.select("h", *DOC, "pos", "n", "at", "bytes").groupBy(block.alias("block")).applyInPandas(repeats_in_block, "doc_id long, v long, pos long, n int")


def kinds_of(rows: DataFrame, key: list[str], *more: str) -> DataFrame:
    """A row per key: its first place, how many rows it has, the runs that hold them as bits, and some row's values of ``more``."""
    return rows.groupBy(*key).agg(F.min(F.expr(PLACE)).alias("first"), F.count(F.lit(1)).alias("k"), F.expr(f"bit_or(shiftleft(1L, {RUN}))").alias("runs"), *[F.first(c).alias(c) for c in more])


def later(rows: DataFrame, kinds: DataFrame, key: list[str]) -> DataFrame:
    """(doc_id, v, pos, n) of rows that aren't the first of their key. A key's rows, which may be many, meet its first place run by run."""
    held = F.filter(F.sequence(F.lit(0), F.lit(RUNS - 1)), lambda r: F.getbit(F.col("runs"), r) == 1)
    firsts = kinds.where("k > 1").select(*key, "first", F.explode(held).alias("run"))
    return rows.withColumn("run", F.expr(RUN)).join(firsts, [*key, "run"]).where(f"{PLACE} > first").select(*DOC, "pos", "n")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, v, pos, n): n windows from pos on also start earlier. May overlap, and may name a window more than once."""
    all_runs = store(anchor_runs(docs))
    counted = all_runs.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("k > 1")
    again = store(counted.select("h", (F.col("lo") != F.col("hi")).alias("differ")))
    members = store(all_runs.join(again, "h"))
    contexts = store(kinds_of(members, ["h", "c"], "n", "differ"))
    whole = later(members, contexts, ["h", "c"])

    differing = contexts.where("differ").select("h", "first.*", "n")
    crowd = differing.groupBy("h").agg(F.count(F.lit(1)).alias("k"))
    pieces = store(cut_contexts(docs, differing.join(crowd, "h").select("h", *DOC, "pos", "n", (F.col("k") > MOST).alias("crowded"))))
    found = whole.unionByName(in_blocks(pieces.where("at < 0")))
    crowded = pieces.where("at >= 0").withColumn("core", F.lit(GRAM))
    while not crowded.isEmpty():
        split = store(halves(crowded))
        kinds = store(kinds_of(split, ["h", "bytes"], "n", "at", "core"))
        found = found.unionByName(later(split, kinds, ["h", "bytes"]))
        crowd = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1")
        kinds = store(kinds.join(crowd, "h").select("h", "first.*", "n", "at", "core", "bytes", (F.col("_k") > MOST).alias("crowded")))
        found = found.unionByName(in_blocks(kinds.where("NOT crowded")))
        crowded = kinds.where("crowded").drop("crowded")
    return store(found)


def spans(many) -> list[tuple[int, int]]:
    """Maximal runs (start, end) of bytes that windows cover."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((r["pos"], r["pos"] + r["n"] + WINDOW - 1) for r in many):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the identifier, n_bytes, n_removed, n_spans, kept (binary: what remains) and spans.

    Identifiers are integers and order the documents. A null text is empty. Rows without an identifier are left whole and repeat
    nothing; rows that repeat an identifier with its text are one document and are treated alike, those that repeat it with other
    texts are documents of their own, ordered by the digests of their texts. Texts shorter than a window lose nothing. An empty
    table gives no rows. What remains is bytes, since a cut may fall within a character.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("v", F.xxhash64("text"))
    gone = repeated_windows(docs).groupBy(*DOC).agg(F.collect_list(F.struct("pos", "n")).alias("runs"))

    def left(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, text, many in zip(b["doc_id"], b["text"], b["runs"]):
                raw = text.encode()
                cut = spans(many) if many is not None else []
                kept, at = [], 0
                for lo, hi in cut:
                    kept.append(raw[at:lo])
                    at = hi
                kept = b"".join([*kept, raw[at:]])
                rows.append((i, len(raw), len(raw) - len(kept), len(cut), kept, [{"start": lo, "end": hi} for lo, hi in cut]))
            out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start: long, end: long>>"
    return docs.join(gone, DOC, "left").mapInPandas(left, schema).withColumnRenamed("doc_id", id_col)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
