"""Spelling variants by anagram hashing.

A word's anagram key is the sum of the fifth powers of its letters' numbers, so words of the same letters in any order share it, and one
more, one less or another letter changes it by one letter's value or by a difference of two. Two words whose keys differ so meet where a
letter is taken off: a removal where the key less a letter is the other's own key, an exchange where both keys less a letter are equal.

1. Keys. Every word has a row with its own key and one for each place of a letter taken off, with the key less that letter. numpy makes
   them for many words at once, and with them fingerprints of the letters left in order. Keys are counted, and rows are joined to
   those that another word shares by an addition, a removal or an exchange; the rest go.
2. Letter order. Of the rows of a key, those meet that agree in place and fingerprints; places without a partner go. Rows are a
   word and a few numbers, however long the word.
3. Exact check. The rest of the word is spelled out. Words of one rest and place differ in that letter alone, so a group is no larger
   than the alphabet; a rest that is itself a word is that word's neighbour by removal. Counts and best neighbours are taken from the
   groups as they are, without listing pairs.

Forms lead from a word to a far more frequent neighbour, and so on; pointers to the last form double in each round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import cut, store, table, whole

#: Fixed value: letters of words.
LETTERS = "A-Za-zÀ-ÿ"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Primes and base of the fingerprints of letters in order; letters of words that are worked on at once.
PRIMES, BASE, LOAD = (2147483647, 2147483629), 1_000_003, 200_000


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 7, least: int = 2, drop_every: int | None = None) -> DataFrame:
    """(word, n): maximal runs of letters in lower case (A-Z alone are lowered) of at least ``length`` code points and ``least`` occurrences. A null text has none.

    drop_every: where it divides h, the CRC-32 of "identifier:run", the run's code point h % length is deleted first (a null identifier is
    written as nothing)."""
    # Runs start where no letter is before, so a run of enough letters is a maximal one.
    runs = docs.select(F.col(id_col).alias("_id"), F.explode(F.regexp_extract_all(whole(F.col(text_col)), F.lit(f"[{LETTERS}]{{{length},}}+"), F.lit(0))).alias("_run"))
    rows = runs.select("_id", F.translate("_run", _UPPER, _LOWER).alias("word"))
    if drop_every:
        word = F.col("word")
        rows = rows.withColumn("_h", F.crc32(F.concat(F.coalesce(F.col("_id").cast("string"), F.lit("")), F.lit(":"), word).cast("binary")))
        at = (F.col("_h") % F.length(word)).cast("int")
        cut_out = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
        rows = rows.select(F.when(F.col("_h") % drop_every == 0, cut_out).otherwise(word).alias("word")).where(F.length("word") >= length)
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def letter_values(code: np.ndarray) -> np.ndarray:
    """Numbers of letters, to the fifth power: a to z are 1 to 26, the others follow; any other code point has a number above those. Large sums may wrap, which is as good a key."""
    rank = np.where((code >= 97) & (code <= 122), code - 96, np.where((code >= 0xC0) & (code <= 0xFF), code - 0xC0 + 27, code + 91))
    return rank**5


def powers(n: int, prime: int) -> np.ndarray:
    """BASE to the powers 0 to n - 1, each round twice as many."""
    out, have = np.ones(n, np.int64), 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * pow(BASE, have, prime) % prime
        have += more
    return out


def keys_of(words: list[str]) -> pd.DataFrame:
    """For all words at once, a row for each word (gap -1) and for each place of a letter taken off: key, gap, head (the letter's first place in the word), first (no equal letter right before), and the fingerprints f and g of the letters left in order: sums of code times power of the place."""
    n = np.array([len(w) for w in words], np.int64)
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    start = np.cumsum(n) - n
    word = np.repeat(np.arange(len(n)), n)
    gap = np.arange(len(code)) - start[word]
    value = letter_values(code)
    total = np.add.reduceat(value, start)
    head = ~pd.DataFrame({"w": word, "v": value}).duplicated().to_numpy()
    first = np.r_[True, code[1:] != code[:-1]] | (gap == 0)
    out = {"_w": np.r_[np.arange(len(n)), word], "key": np.r_[total, total[word] - value], "gap": np.r_[np.full(len(n), -1), gap], "head": np.r_[np.ones(len(n), bool), head], "first": np.r_[np.ones(len(n), bool), first]}
    for name, prime in zip("fg", PRIMES, strict=True):
        power = powers(int(n.max()), prime)
        term, moved = code * power[gap] % prime, code * power[np.maximum(gap - 1, 0)] % prime  # letters behind a gap move one place up
        before, behind = np.cumsum(term), np.cumsum(moved)
        whole_ = np.add.reduceat(term, start) % prime
        left = before - term - (before[start] - term[start])[word]
        right = behind[start + n - 1][word] - behind
        out[name] = np.r_[whole_, (left + right) % prime]
    return pd.DataFrame(out)


def anagram_keys(words: DataFrame) -> DataFrame:
    """(word, key, gap, head, first, f, g) of non-empty words, see keys_of."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            part, size = [], 0
            for w in [*b["word"], None]:  # pieces of bounded size, but for a longer word
                if part and (w is None or size + len(w) > LOAD):
                    rows = keys_of(part)
                    yield rows.assign(word=np.array(part, object)[rows.pop("_w")])
                    part, size = [], 0
                if w:
                    part.append(w)
                    size += len(w)

    return words.select("word").mapInPandas(keys, "word string, key long, gap long, head boolean, first boolean, f long, g long")


def meeting(rows: DataFrame) -> DataFrame:
    """Join of the keys: (word, key, gap, f, g, meet) of the rows whose key another word shares. Exchanges (two or more words come to the key by a letter less) meet at their place; removals (a word comes to it so, and another has it as its own) at -1, once for equal letters in a row."""
    own = F.col("gap") < 0
    live = rows.groupBy("key").agg(F.count_if(own).alias("_own"), F.count_if(~own & F.col("head")).alias("_less"))
    live = live.where("_less >= 1 AND (_less >= 2 OR _own >= 1)")
    swap, drop = ~own & (F.col("_less") >= 2), (F.col("_own") >= 1) & F.col("first")
    at = F.array_compact(F.array(F.when(swap, F.col("gap")), F.when(drop, F.lit(-1).cast("long"))))
    return rows.join(live, "key").select("word", "key", "gap", "f", "g", F.explode(at).alias("meet"))


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best): of distinct words (word, n), how many others differ by exactly one inserted, deleted or replaced code point, and the one of them (n, word) of largest n, the smallest in code-point order on ties. Words without any are left out."""
    group = ["key", "meet", "f", "g"]
    rows = meeting(store(anagram_keys(words)))
    whole_ = F.col("gap") < 0
    alike = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_m"), F.count_if(whole_).alias("_w")).where("_m >= 2 AND (meet >= 0 OR _w >= 1)").select(*group)
    # The exact check: the rest, letter by letter.
    gap, word = F.col("gap").cast("int"), F.col("word")
    rest = F.when(whole_, word).otherwise(F.concat(F.substring(word, F.lit(1), gap), F.substring(word, gap + 2, F.length(word))))
    found = rows.join(alike, group, "left_semi").join(words, "word").select("word", "meet", whole_.alias("_whole"), rest.alias("_rest"), F.struct((-F.col("n")).alias("o"), "word").alias("_me"))
    # By falling n: the best of the others is the first or, for the first itself, the second.
    swaps = found.where("meet >= 0").groupBy("meet", "_rest").agg(F.sort_array(F.collect_list("_me")).alias("_all")).where(F.size("_all") > 1)
    swaps = swaps.select("_all", F.posexplode("_all").alias("_k", "_x")).select("_x.word", (F.size("_all") - 1).alias("_near"), F.when(F.col("_k") == 0, F.col("_all")[1]).otherwise(F.col("_all")[0]).alias("_best"))
    drops = found.where("meet < 0").groupBy("_rest").agg(F.max(F.when(F.col("_whole"), F.col("_me"))).alias("_short"), F.sort_array(F.collect_list(F.when(~F.col("_whole"), F.col("_me")))).alias("_long"))
    drops = drops.where(F.col("_short").isNotNull() & (F.size("_long") > 0))
    shorter = drops.select("_short.word", F.size("_long").alias("_near"), F.col("_long")[0].alias("_best"))
    longer = drops.select("_short", F.explode("_long").alias("_x")).select("_x.word", F.lit(1).alias("_near"), F.col("_short").alias("_best"))
    out = swaps.unionByName(shorter).unionByName(longer).groupBy("word").agg(F.sum("_near").alias("n_near"), F.min("_best").alias("_b"))
    return out.select("word", "n_near", F.struct((-F.col("_b.o")).alias("n"), F.col("_b.word").alias("word")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """forms (word, form) with root: the last word that forms lead to, the word itself where it has none. Forms never lead in a circle. A chain of k forms takes about log k rounds."""
    at = cut(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        further = cut(at.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        at = further.drop("_moved")
        if further.where("_moved").isEmpty():
            break
    return forms.join(at, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(words: DataFrame, times: int = 10) -> DataFrame:
    """From distinct words (word, n long): word, form, root, n, n_near, form_n.

    form: the neighbour of largest n, the smallest in code-point order on ties, if that is at least ``times`` the word's own; else null. root:
    where forms lead from the word. An empty table gives no rows; words may be of any length and any letters, but null and empty ones
    must be taken out before."""
    if times < 2:
        raise ValueError("times is 2 or more, or forms could lead in a circle")
    words = store(words.select("word", F.col("n").cast("long").alias("n")))
    both = words.join(neighbours(words), "word", "left")
    better = F.col("best.n") >= times * F.col("n")
    forms = both.select("word", F.when(better, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(better, F.col("best.n")).alias("form_n"))
    return roots(store(forms)).select("word", "form", "root", "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling_variants(vocabulary(docs, drop_every=31))
