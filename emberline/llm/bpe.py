"""Byte-pair encoding and decoding by speculation and verification.

A text falls into words by the tokenizer's own pattern. Each distinct word of a batch is first cut greedily into the longest
tokens of the vocabulary. That proposal is the right encoding if and only if every adjacent pair of its tokens stays apart
when the two are encoded together, and one vectorised check tests the pairs of all new words at once: along both sides of
the seam it walks down the tokens' splits and looks for a merge that would have come first. Only words with a failing pair
are merged exactly, in order of rank.
"""

from __future__ import annotations

import array
import hashlib
import heapq
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import table

#: Fixed value: the word pattern of byte-level tokenizers of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts below U+0250, where the letters, numbers and white space can be listed, for Python's faster matcher.
_L, _N, _S = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\t-\r \u0085\u00a0"
LATIN = re.compile(f" ?[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
NOT_LATIN = re.compile("[^\u0000-\u024f]")
#: Words that a worker remembers, and the longest that it keeps.
REMEMBERED, REMEMBERED_CHARS = 1_000_000, 64
#: Characters of texts that are encoded together; words of a longer text that are held at once.
LOAD, CHUNK = 200_000, 50_000
#: Longest word, in bytes, that is merged by scanning its pairs.
SHORT = 40
NO_MERGE = (1 << 62, -1)


def byte_letters() -> dict[str, int]:
    """The letters by which vocabulary files write bytes: printable Latin-1 stands for itself, the rest for letters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A byte-level vocabulary with ranked merges and special tokens. Build it on the driver and broadcast it."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        letter = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(letter[c] for c in s) for s, i in vocab.items() if s not in self.special}
        self.decode_of = self.bytes_of | {i: s.encode() for s, i in self.special.items()}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.byte_id = [self.id_of[bytes([c])] for c in range(256)]
        size = max(self.decode_of) + 1
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.left, self.right, self.rank = (np.full(size, -1, np.int64) for _ in range(3))
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.merge[x, y] = rank, z
            self.left[z], self.right[z], self.rank[z] = x, y, rank
        keys = np.array([x * size + y for x, y in self.merge], np.int64)
        order = np.argsort(keys)
        self.size, self.pair_keys, self.pair_ranks = size, keys[order], np.array([r for r, _ in self.merge.values()], np.int64)[order]
        self.words = regex.compile(PATTERN)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # Only tokens that their own merges make may be proposed.
        whole = self.left >= 0
        self.proposed = {b: i for b, i in self.id_of.items() if len(b) == 1 or whole[i]}
        # The longest proposed token by its first three bytes.
        self.reach: dict[bytes, int] = {}
        for b in self.proposed:
            for head in {b[:1], b[:2], b[:3]} if len(b) < 3 else {b[:3]}:
                self.reach[head] = max(len(b), self.reach.get(head, 0))
        self.known: dict[str, tuple[int, ...]] = {}
        self.remembered: int | None = None

    def __getstate__(self):
        return self.__dict__ | {"words": None, "specials": None, "known": {}}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.words = regex.compile(PATTERN)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def greedy(self, word: bytes) -> list[int]:
        out, at, n, get, reach = [], 0, len(word), self.proposed.get, self.reach.get
        while at < n:
            for end in range(min(n, at + reach(word[at : at + 3], 2)), at, -1):
                if (i := get(word[at:end])) is not None:
                    out.append(i)
                    at = end
                    break
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens: no merge across their seam comes before the merges that made them.

        State of a pair: the parts that touch the seam, and the rank of the merge that used each part up next (none yet:
        unlimited). A seam merge that comes earlier than both of those would have happened. The part made last is taken
        apart first.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        none = np.iinfo(np.int64).max
        used_a, used_b = np.full(len(a), none), np.full(len(a), none)
        while len(live):
            x, y, ux, uy = a[live], b[live], used_a[live], used_b[live]
            at = np.minimum(np.searchsorted(self.pair_keys, x * self.size + y), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[at] == x * self.size + y, self.pair_ranks[at], none)
            # Of merges of one rank the leftmost comes first: a part's next use on the left precedes the seam, on the right follows it.
            bad = (rank < ux) & (rank <= uy) & (rank < none)
            ok[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~bad & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[go], x[go], y[go], rx[go], ry[go]
            cut_a = rx > ry
            i, j = live[cut_a], live[~cut_a]
            used_a[i], a[i] = rx[cut_a], self.right[x[cut_a]]
            used_b[j], b[j] = ry[~cut_a], self.left[y[~cut_a]]
        return ok

    def exact(self, word: bytes) -> list[int]:
        """Merge by rank, leftmost first."""
        if len(word) > SHORT:
            return self.exact_long(word)
        ids, merge = [self.byte_id[c] for c in word], self.merge
        pairs = [merge.get(p, NO_MERGE) for p in zip(ids, ids[1:])]
        while pairs and (best := min(pairs)) is not NO_MERGE:
            k = pairs.index(best)
            ids[k : k + 2] = [best[1]]
            del pairs[k]
            if k:
                pairs[k - 1] = merge.get((ids[k - 1], ids[k]), NO_MERGE)
            if k < len(pairs):
                pairs[k] = merge.get((ids[k], ids[k + 1]), NO_MERGE)
        return ids

    def exact_long(self, word: bytes) -> list[int]:
        """The same over a linked list and a heap, for words of any length."""
        ids = [self.byte_id[c] for c in word]
        n = len(ids)
        after, before, gone = [*range(1, n), -1], [*range(-1, n - 1)], [False] * n
        heap = [(self.merge[p][0], k, p) for k in range(n - 1) if (p := (ids[k], ids[k + 1])) in self.merge]
        heapq.heapify(heap)
        while heap:
            _, k, p = heapq.heappop(heap)
            if gone[k] or (m := after[k]) < 0 or (ids[k], ids[m]) != p:
                continue
            ids[k], gone[m], after[k] = self.merge[p][1], True, after[m]
            if after[m] >= 0:
                before[after[m]] = k
                if (q := (ids[k], ids[after[k]])) in self.merge:
                    heapq.heappush(heap, (self.merge[q][0], k, q))
            if before[k] >= 0 and (q := (ids[before[k]], ids[k])) in self.merge:
                heapq.heappush(heap, (self.merge[q][0], before[k], q))
        return [i for i, g in zip(ids, gone, strict=True) if not g]

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Encodings of new words: greedy proposals, one check of all pairs, exact merging where it fails."""
        raw = [w.encode() for w in words]
        guess = [self.greedy(b) for b in raw]
        flat = np.fromiter(itertools.chain.from_iterable(guess), np.int64)
        of = np.repeat(np.arange(len(guess)), [len(g) for g in guess])
        seam = np.flatnonzero(of[1:] == of[:-1])
        for k in np.unique(of[seam[~self.compatible(flat[seam], flat[seam + 1])]]).tolist():
            guess[k] = self.exact(raw[k])
        return {w: array.array("I", g).tobytes() for w, g in zip(words, guess, strict=True)}

    def look_up(self, words: list[list[str]]) -> dict[str, bytes]:
        """Encodings of all these words; what is short is remembered."""
        look = known = self.known
        if new := {w for some in words for w in some if w not in known}:
            got = self.learn(list(new))
            short = {w: ids for w, ids in got.items() if len(w) <= REMEMBERED_CHARS}
            full = len(known) + len(short) > (self.remembered or REMEMBERED)
            if full or len(short) < len(got):
                look = {w: known[w] for some in words for w in some if w not in new} | got
            if full:
                known.clear()
            known.update(short)
        return look

    def split(self, text: str) -> list[list[str] | int]:
        """Lists of words, and special tokens as their ids."""
        find = (self.words if NOT_LATIN.search(text) else LATIN).findall
        if not any(s in text for s in self.special):
            return [find(text)]
        return [self.special[x] if x in self.special else find(x) for x in self.specials.split(text)]

    def encode_long(self, text: str) -> bytes:
        """For a text of any length: no more than CHUNK words are held at once."""
        out = bytearray()
        for part in self.specials.split(text) if self.specials else [text]:
            if part in self.special:
                out += array.array("I", [self.special[part]]).tobytes()
                continue
            found = (m[0] for m in (self.words if NOT_LATIN.search(part) else LATIN).finditer(part))
            while chunk := list(itertools.islice(found, CHUNK)):
                out += b"".join(map(self.look_up([chunk]).__getitem__, chunk))
        return bytes(out)

    def encode_many(self, texts: list[str]) -> Iterator[bytes]:
        """Of each text its ids as unsigned 32-bit integers of this machine. Texts share one check of their new words, up to LOAD characters of them."""
        start = 0
        while start < len(texts):
            end, load = start, 0
            while end < len(texts) and (end == start or load + len(texts[end]) <= LOAD):
                load += len(texts[end])
                end += 1
            if load > LOAD:
                yield self.encode_long(texts[start])
            else:
                parts = [self.split(t) for t in texts[start:end]]
                get = self.look_up([x for some in parts for x in some if not isinstance(x, int)]).__getitem__
                for some in parts:
                    yield b"".join(array.array("I", [x]).tobytes() if isinstance(x, int) else b"".join(map(get, x)) for x in some)
            start = end

    def encode(self, text: str) -> array.array:
        return array.array("I", next(self.encode_many([text])))

    def decode(self, ids) -> str:
        """Bytes of all tokens, special ones included, as UTF-8; what isn't UTF-8 becomes U+FFFD."""
        return b"".join(map(self.decode_of.__getitem__, ids)).decode("utf-8", "replace")


def vocabulary(spark: SparkSession, path: str, remembered: int | None = None):
    """Broadcast of the vocabulary file at a path that the driver reads; its size is fixed by the vocabulary. remembered: words that a worker keeps, REMEMBERED by default."""
    with open(path, encoding="utf-8") as f:
        bpe = ByteBpe(f.read())
    bpe.remembered = remembered
    return spark.sparkContext.broadcast(bpe)


def bpe_encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """All input columns and ``ids`` array<int>. A null text counts as empty. An input column named ids is replaced."""
    bpe = vocabulary(docs.sparkSession, path)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.frombuffer(x, np.int32) for x in bpe.value.encode_many([t or "" for t in texts])])

    return docs.withColumn("ids", ids(F.col(text_col)))


def bpe_decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """All input columns and ``decoded``; null ids decode to the empty text."""
    bpe = vocabulary(encoded.sparkSession, path)

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for many in batches:
            yield pd.Series([bpe.value.decode(() if x is None else x.tolist()) for x in many])

    return encoded.withColumn("decoded", decoded(F.col(ids_col)))


def round_trip(docs: DataFrame, path: str, text_col: str = "text", remembered: int | None = None) -> DataFrame:
    """All input columns but the text, and n_tokens, ids_sha256, decoded_sha256: encode, decode and digest a text in one pass, without moving its ids between processes.

    A null text counts as empty and has no tokens. Repeated rows are encoded one by one. An empty table gives no rows. Input columns with
    the names of result columns are replaced. remembered: as in ``vocabulary``; fewer words take less memory and more time.
    """
    bpe = vocabulary(docs.sparkSession, path, remembered)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for raw in bpe.value.encode_many([t or "" for t in texts]):
                ids = np.frombuffer(raw, np.uint32)
                text = bpe.value.decode(ids.tolist())
                rows.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    own = [c for c in docs.columns if c not in (text_col, "n_tokens", "ids_sha256", "decoded_sha256")]
    return docs.select(*own, digests(F.col(text_col)).alias("_d")).select(*own, "_d.*")


def token_count(path: str, spark: SparkSession):
    """A column function: the number of tokens of a text."""
    bpe = vocabulary(spark, path)

    @F.pandas_udf("long")
    def n(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([len(x) // 4 for x in bpe.value.encode_many([t or "" for t in texts])], dtype="int64")

    return n


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), default_path())
