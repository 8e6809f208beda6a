"""Language identification by the nearest of several centroids per language.

A text becomes a normalised TF-IDF vector of its byte bigrams and trigrams, hashed into a fixed number of dimensions. Each
language has a few centroids, found by spherical k-means within its own sample in a task of its own. A text gets the language
of the centroid of highest cosine. It is rejected when that cosine is below the centroid's limit for texts of its length: a low
quantile of the cosines that beginnings of about that length of the centroid's own sample texts have, with a small margin.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import cut, table

DIMS = 1 << 14
CENTROIDS = 4
#: Bounds of the sample that the classifier is fitted on: documents per language, and languages.
SAMPLE_PER_LANG, MAX_LANGS = 1024, 256
#: Lengths in characters of the beginnings whose cosines set the limits, the quantile taken, and the fewest beginnings for one.
HEADS, LOW, FEWEST = (8, 32, 128, 512, 2048, 8192), 0.01, 5
#: Centroids with a smaller share of their language's sample are dropped, and so are their texts.
SMALL = 0.02
#: Bytes of a text that are counted at once.
PIECE = 1 << 20
UNKNOWN = "und"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def ngram_counts(text: str) -> np.ndarray:
    """Counts of hashed byte bigrams and trigrams of the words of a whole text, each word between spaces."""
    data = np.frombuffer(b" " + b" ".join(text.encode("utf-8", "replace").translate(_FOLD).split()) + b" ", np.uint8)
    out = np.zeros(DIMS, np.int64)
    for k in range(0, len(data), PIECE):
        a = data[k : k + PIECE + 2].astype(np.uint32)
        two = (a[:-1] << np.uint32(8)) | a[1:]
        three = (two[:-1] << np.uint32(8)) | a[2:]
        if k + PIECE + 1 < len(data):  # the last bigram of this piece opens the next one
            two = two[:-1]
        for codes, salt in ((two, 0x9E3779B1), (three, 0x85EBCA77)):
            out += np.bincount((codes * np.uint32(salt)) >> np.uint32(18), minlength=DIMS)
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    norm = np.sqrt(v @ v)
    return (v / norm if norm else v).astype(np.float32)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """(unit centroids, cluster of each row). Starts from rows far from each other, though not from the farthest tenth, which are the odd ones; it has no random part."""
    picked = [int(np.argmax(x @ x.mean(axis=0)))]
    near = x @ x[picked[0]]
    while len(picked) < min(k, len(x)):
        picked.append(int(np.argsort(near, kind="stable")[len(x) // 10]))
        near = np.maximum(near, x @ x[picked[-1]])
    c = x[picked]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32), np.argmax(x @ c.T, axis=1)


def robust_clusters(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centroids, rows used, cluster of each of them). Clusters that are too small go with their rows."""
    c, own = spherical_kmeans(x, k)
    sizes = np.bincount(own, minlength=len(c))
    rows = np.flatnonzero((sizes >= np.minimum(SMALL * len(x), sizes.max()))[own])
    return c, rows, own[rows]


def margin(length: np.ndarray | float) -> np.ndarray | float:
    """What a limit is multiplied with: a tenth less for long texts, up to a half for a few characters, whose cosines vary more."""
    return 0.9 - 0.4 * np.minimum(1.0, np.sqrt(HEADS[0] / np.maximum(1.0, length)))


def limits(cosines: list[list[float]], full: np.ndarray) -> np.ndarray:
    """One centroid's limit at each length of HEADS, from the cosines of the beginnings of each length. A length with too few has the one before, the first one that of whole texts."""
    out, last = [], None
    for some in cosines:
        if len(some) >= FEWEST or last is None:
            last = float(np.quantile(some or full, LOW)) if len(some) else float(np.quantile(full, LOW))
        out.append(last)
    return np.array(out)


@dataclass
class LangModel:
    langs: list[str]  # of each centroid
    centroids: np.ndarray
    floors: np.ndarray  # of each centroid the limit at each length of HEADS, before the margin
    idf: np.ndarray

    def floor(self, j: int, length: int) -> float:
        """The lowest cosine in reach of centroid j for a text of so many characters; below the shortest length it falls with the square root."""
        at = float(np.interp(np.log(max(length, HEADS[0])), np.log(HEADS), self.floors[j]))
        return at * float(margin(length)) * min(1.0, (length / HEADS[0]) ** 0.5)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_lang: int = SAMPLE_PER_LANG, k: int = CENTROIDS) -> LangModel:
    """Fit on the rows given that have a label and text: a sample of per_lang documents per language at most, picked by hash."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col).cast("string"), F.xxhash64(F.col(text_col))).alias("_h")).where("lang IS NOT NULL AND text IS NOT NULL")
    # One row per label, of which a corpus has few; the check keeps it so.
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not counts:
        return LangModel([], np.zeros((0, DIMS), np.float32), np.zeros((0, len(HEADS))), np.ones(DIMS))
    share = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(int(min(1.0, 2 * per_lang / n) * (1 << 30)))).otherwise(share)
    some = rows.where(F.pmod("_h", F.lit(1 << 30)) < share)
    some = some.groupBy("lang", F.pmod(F.shiftright("_h", 30), F.lit(per_lang)).alias("_slot")).agg(F.min_by("text", F.struct("_h", "text")).alias("text"))

    @F.pandas_udf("binary")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([ngram_counts(t).astype("<i4").tobytes() for t in texts])

    has_text = F.col("text").rlike(r"\p{L}")
    sample = cut(some.where(has_text).select("lang", F.left("text", F.lit(HEADS[-1])).alias("head"), features(F.col("text")).alias("f")))

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            df = np.zeros(DIMS, np.int64)
            for f in b["f"]:
                df += np.frombuffer(f, "<i4") > 0
            at = np.flatnonzero(df)
            yield pd.DataFrame({"dim": at.astype(np.int32), "df": df[at]})

    # One row per dimension: its number is fixed.
    known = sample.mapInPandas(seen, "dim int, df long").groupBy("dim").agg(F.sum("df").alias("df")).toPandas()
    total, df = sample.count(), np.zeros(DIMS)
    df[known["dim"].to_numpy()] = known["df"].to_numpy()
    idf = np.log((1 + total) / (1 + df)) + 1
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = sorted(zip(pdf["f"], pdf["head"]))
        x = np.stack([weighted(np.frombuffer(f, "<i4"), shared.value) for f, _ in pairs])
        c, rows, own = robust_clusters(x, k)
        full = (x[rows] * c[own]).sum(axis=1)
        used = [j for j in range(len(c)) if (own == j).any()]
        found = {j: [[] for _ in HEADS] for j in used}
        for r, j in zip(rows, own):
            for at, n in enumerate(HEADS):
                if len(pairs[r][1]) >= n and has_letter(pairs[r][1][:n]):
                    # As for a text to be judged, the nearest centroid of the language counts.
                    cosines = c @ weighted(ngram_counts(pairs[r][1][:n]), shared.value)
                    found[j][at].append(float(cosines[used].max()))
        floors = [limits(found[j], full[own == j]).astype("<f8").tobytes() for j in used]
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "cluster": used, "centroid": [c[j].astype("<f4").tobytes() for j in used], "floors": floors})

    found = sample.groupBy("lang").applyInPandas(cluster, "lang string, cluster int, centroid binary, floors binary").toPandas().sort_values(["lang", "cluster"])
    unpack = lambda column, kind, n: np.stack([np.frombuffer(v, kind) for v in found[column]]) if len(found) else np.zeros((0, n), kind)
    return LangModel(list(found["lang"]), unpack("centroid", "<f4", DIMS), unpack("floors", "<f8", len(HEADS)), idf)


def predict(docs: DataFrame, model: LangModel, text_col: str = "text") -> DataFrame:
    """All input columns, then lang_pred, score, rejected.

    score is the cosine with the nearest centroid, 0 to 1. Null texts and texts without a letter are ``und`` with score 0, and
    rejected. If the model has no language, the others are ``und`` with score 0 too, but not rejected: nothing speaks against them. Ties go to the first language by name. Input columns with the names of
    result columns are replaced. An empty table gives no rows.
    """
    added = ["lang_pred", "score", "rejected"]
    own = [c for c in docs.columns if c not in added]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            out = []
            for t in texts:
                if not t or not m.langs or not has_letter(t):
                    out.append((UNKNOWN, 0.0, not t or not has_letter(t)))
                    continue
                cosines = m.centroids @ weighted(ngram_counts(t), m.idf)
                j = int(np.argmax(cosines))
                score = float(min(1.0, max(0.0, cosines[j])))
                out.append((m.langs[j], score, score < m.floor(j, len(t))))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "rejected"])

    return docs.select(*own, nearest(F.col(text_col)).alias("_p")).select(*own, "_p.*")


def is_held_out(id_col: str = "doc_id") -> Column:
    """A third of the documents, by checksum of the identifier: never learned from. Null identifiers belong to it."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the labelled documents that aren't held out, then predict all."""
    return predict(docs, fit(docs.where(~is_held_out())))


def op1_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~is_held_out()))
    return predict(docs.select("doc_id", is_held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")
