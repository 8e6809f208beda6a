"""Quality rules by distribution divergence, in DataFrame operations only.

Each document has two histograms: of character classes over its text, and of common words over its words. The references
are the summed histograms of each language over all documents. A document is kept if it passes the base rules and neither
histogram is farther from its language's reference, in Jensen-Shannon distance, than allowed; a histogram of too few
characters or words says nothing and is not held against its document. Most words are no common words, so even a text without
any is not far from the reference: the limit for words is set for each language below that text's distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import SPACE, cut, table, whole, words

#: Common words of the languages, in lower case.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for"],
    "fr": ["le", "la", "les", "et", "des", "un", "que", "pour"],
    "de": ["der", "die", "und", "das", "den", "mit", "ist", "von"],
    "es": ["el", "los", "y", "en", "una", "con", "por", "se"],
}
VOCABULARY = sorted({w for some in COMMON_WORDS.values() for w in some})
SYMBOLS = "#*$%&|<>"
#: Farthest Jensen-Shannon distances (0 to 1) from the reference, and the fewest characters and words that are compared.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.3, 0.45
MIN_CHARS, MIN_WORDS = 200, 100
#: The limit for words as a share of the distance of a text without common words, and the share of a language's documents that
#: must lie within it; it holds where so many common words are expected that their absence is no chance. Elsewhere (as in
#: languages without words in the list) the limit is MAX_WORD_DISTANCE.
BELOW_NONE, WITHIN, EXPECTED = 0.95, 0.5, 15
#: Reference tables up to this many rows are broadcast.
BROADCAST_LANGS = 10_000


#: Character classes, in the order in which they are taken out of a text: the plainest letters and white space first, so that
#: most of a text is read once or twice only. Letters are Unicode's. What is left at the end is a class too.
CLASSES = ["[a-z]+", "[ \\t\\x0B\\f\\r]+", "\\n+", r"[\p{L}&&[^\p{Lu}]]+", r"\p{Lu}+", r"[.,;:!?'\"()\-]+", "[0-9]+", "[" + SYMBOLS.replace("&", "\\&") + "]+"]
WORD_CHAR = r"[^\x20\x09-\x0D]"
#: Marks that don't count when common words are looked up.
MARKS = "[.,;:!?]+"


def class_lengths(docs: DataFrame, text: Column) -> DataFrame:
    """Adds _left: the text's length in characters, then its length after each class is taken out."""
    left, lengths = text, [F.char_length(text)]
    for pattern in CLASSES:
        left = F.regexp_replace(left, pattern, "")
        lengths.append(F.char_length(left))
    return docs.withColumn("_left", F.array(*lengths))


def common_words(text: Column) -> Column:
    """The vocabulary's words in a text, whatever their case and sentence marks, in one string with a space on either side of each."""
    found = F.filter(F.split(F.lower(F.regexp_replace(text, MARKS, "")), SPACE), lambda x: x.isin(VOCABULARY))
    return F.concat(F.lit(" "), F.array_join(found, "  "), F.lit(" "))


def word_counts(found: Column, n_words: Column) -> Column:
    """How often each word of the vocabulary is among those found, then the number of all other words. What a word's removal takes off the string's length tells its count, without a pass over an array for each word."""
    counts = [((F.length(found) - F.length(F.replace(found, F.lit(f" {v} "), F.lit("")))) / (len(v) + 2)).cast("int") for v in VOCABULARY]
    return F.array(*counts, n_words - sum(counts[1:], counts[0]))


#: Of a window's key the low bits hold its place, the others its hash.
PLACE = (1 << 24) - 1


def repeated_words(docs: DataFrame) -> DataFrame:
    """Adds n_repeat_words from the words in _w: how many words lie in windows of three words that occur twice or more.

    A text whose window hashes are all distinct has none. In others windows meet by sorting (hash, place) keys within the row, and
    equal neighbours are compared word by word. Where the hashes of different windows meet, or a text has more words than places,
    the windows themselves are sorted instead.
    """
    w, n = F.col("_w"), F.size("_w")
    at = lambda i: [F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)]
    starts = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    docs = docs.withColumn("_h", F.transform(starts, lambda i: F.xxhash64(*at(i))))
    again = (F.size("_h") > F.size(F.array_distinct("_h"))) & (n <= PLACE)
    docs = docs.withColumn("_k", F.when(again, F.sort_array(F.transform("_h", lambda h, i: h.bitwiseAND(F.lit(~PLACE)).bitwiseOR(i.cast("long"))))).otherwise(F.array().cast("array<bigint>")))
    k = F.col("_k")
    met = lambda x, y: F.shiftright(x.bitwiseXOR(y), 24) == 0
    beside = lambda a, x, i, same: F.coalesce(same(x, F.get(a, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(a, i + 1)), F.lit(False))
    docs = docs.withColumn("_c", F.filter(k, lambda x, i: beside(k, x, i, met)))
    c = F.col("_c")
    place = lambda x: x.bitwiseAND(F.lit(PLACE)).cast("int")

    def equal(x: Column, y: Column) -> Column:
        same = met(x, y)
        for a, b in zip(at(place(x)), at(place(y)), strict=True):
            same = same & (a == b)
        return same

    clash = F.exists(F.transform(c, lambda x, i: F.coalesce(met(x, F.get(c, i + 1)) & ~equal(x, F.get(c, i + 1)), F.lit(False))), lambda x: x)
    fast = F.transform(F.filter(c, lambda x, i: beside(c, x, i, equal)), place)
    docs = docs.withColumn("_s", F.when(clash | (n > PLACE), F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.concat_ws(" ", *at(i)).alias("t"), i.alias("i"))))))
    s = F.col("_s")
    slow = F.transform(F.filter(s, lambda x, i: beside(s, x, i, lambda a, b: a["t"] == b["t"])), lambda x: x["i"])
    docs = docs.withColumn("_p", F.sort_array(F.when(s.isNotNull(), slow).otherwise(fast)))
    p = F.col("_p")
    covered = F.transform(p, lambda x, i: F.coalesce(F.least(F.lit(3), F.get(p, i + 1) - x), F.lit(3)))
    return docs.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)).drop("_h", "_k", "_c", "_s", "_p")


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All input columns but the text, then the base counts and the two histograms."""
    text = whole(F.col(text_col))
    # Each array is a column of its own before it is used more than once: an expression inside a lambda runs for every element.
    out = class_lengths(repeated_words(docs.withColumn("_w", words(F.col(text_col)))), text)
    out = out.withColumns({"_lines": F.filter(F.split(text, "\\n"), lambda x: x.rlike(WORD_CHAR)), "_found": common_words(text), "_n": F.size("_w")}).drop("_w", text_col)
    at = lambda k: F.get("_left", F.lit(k))
    return out.withColumns(
        {
            "n_words": F.col("_n").cast("long"),
            "word_chars": (at(0) - at(1) + at(3)).cast("long"),
            "n_symbols": (at(7) - at(8)).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_chars": F.array(at(0) - at(1) + at(3) - at(4), *[at(k) - at(k + 1) for k in (1, 2, 4, 5, 6, 7)], at(8)),
            "_common": word_counts(F.col("_found"), F.col("_n")),
        }
    ).drop("_lines", "_found", "_n", "_left")


def shares(histogram: Column) -> Column:
    """The histogram over its sum; null if that is zero."""
    total = F.aggregate(histogram, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return F.when(total > 0, F.transform(F.arrays_zip(histogram.alias("h"), F.array_repeat(total, F.size(histogram)).alias("t")), lambda x: x["h"] / x["t"]))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two distributions, 0 to 1."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    both = F.zip_with(p, q, lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(both, F.lit(0.0), lambda a, x: a + x)))


def judge(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    max_char_distance: float = MAX_CHAR_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
    min_chars: int = MIN_CHARS,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """All input columns but the text, then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance, kept.

    base_failed: fewer than 50 words, or over half of the words in repeated windows. max_word_distance is the widest limit for
    words; see BELOW_NONE. Null text counts as empty and fails. Rows
    with a null language are a language of their own. Distances are null below the minimum lengths. Repeated rows are judged one by
    one. An empty table gives no rows. Input columns with the names of result columns are replaced.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"]
    own = [c for c in docs.columns if c not in (*added, text_col)]
    rows = cut(features(docs.select(*own, text_col), text_col))
    sums = lambda col, n: F.array(*[F.sum(F.get(col, F.lit(i)).cast("long")) for i in range(n)])
    refs = rows.groupBy(F.col(lang_col).alias("_lang")).agg(sums("_chars", 8).alias("_c"), sums("_common", len(VOCABULARY) + 1).alias("_w"))
    refs = cut(refs.select("_lang", shares(F.col("_c")).alias("_ref_chars"), shares(F.col("_w")).alias("_ref_common")))
    refs = F.broadcast(refs) if refs.count() <= BROADCAST_LANGS else refs
    held = rows.join(refs, F.col(lang_col).eqNullSafe(F.col("_lang"))).withColumns({"_p": shares(F.col("_chars")), "_q": shares(F.col("_common"))})
    # Lazy columns of their own, so that neither distance is worked out twice.
    held = held.withColumns(
        {
            "char_distance": F.when(F.col("word_chars") >= min_chars, distance(F.col("_p"), F.col("_ref_chars"))),
            "word_distance": F.when(F.col("n_words") >= min_words, distance(F.col("_q"), F.col("_ref_common"))),
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        }
    )
    none = F.array(*[F.lit(0.0)] * len(VOCABULARY), F.lit(1.0))
    held = cut(held.select(*own, *added[:-1], F.col("_lang").alias("_of"), (BELOW_NONE * distance(none, F.col("_ref_common"))).alias("_below"), (F.col("n_words") * (1 - F.get("_ref_common", F.lit(len(VOCABULARY)))) >= EXPECTED).alias("_enough")))
    within = F.avg(F.when(F.col("word_distance") <= F.col("_below"), 1.0).when(F.col("word_distance").isNotNull(), 0.0))
    widest = F.lit(float(max_word_distance))
    limits = held.groupBy(F.col("_of").alias("_lang")).agg(within.alias("_within"), F.max("_below").alias("_cap"))
    limits = cut(limits.select("_lang", F.when(F.col("_within") > WITHIN, F.least(widest, F.col("_cap"))).otherwise(widest).alias("_limit")))
    limits = F.broadcast(limits) if limits.count() <= BROADCAST_LANGS else limits
    return (
        held.join(limits, F.col("_of").eqNullSafe(F.col("_lang")))
        .withColumn("kept", ~F.col("base_failed") & (F.coalesce("char_distance", F.lit(0.0)) <= max_char_distance) & (F.coalesce("word_distance", F.lit(0.0)) <= F.when(F.col("_enough"), F.col("_limit")).otherwise(widest)))
        .select(*own, *added)
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).drop("lang")
