"""Nulls, repeated rows and identifiers, empty tables and clashing names; language ID and the pipeline against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.llm import bpe, exact_dedup, lang_id, mixing, quality, sharding, simhash, substring_dedup, token_counts

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def sentences(rng, vocab, n):
    return " ".join(rng.choice(vocab) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    vocab = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 7))) for _ in range(80)]
    base = [(i, sentences(rng, vocab, rng.randrange(1, 70)), rng.choice(["en", "fr", None]), rng.choice(["a", "b", None]), 1) for i in range(30)]
    twice = [base[3]] * 3 + [(None, base[4][1], "en", "a", 1)] * 2 + [(None, None, None, None, None)] * 2
    return base + twice + [(7, "quite another text under a number that is taken", "en", "b", 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).cache()


@pytest.mark.parametrize(
    "run,taken",
    [
        (lambda d: lang_id.predict(d, lang_id.fit(d)), ["lang_pred", "score", "rejected"]),
        (exact_dedup.exact_dedup, ["keep_id", "group_size", "kept", "text_sha256"]),
        (sharding.shard_documents, ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]),
        (substring_dedup.remove_repeats, []),
        (lambda d: bpe.round_trip(d, bpe.default_path()), ["n_tokens", "ids_sha256", "decoded_sha256"]),
        (lambda d: bpe.bpe_encode(d, bpe.default_path()), ["ids"]),
        (quality.judge, ["n_words", "kept", "base_failed", "char_distance", "word_distance"]),
        (simhash.near_duplicates, ["fp", "fingerprint", "component_id"]),
        (simhash.similar_documents, ["component_id"]),
        (mixing.mix, []),
        (lambda d: mixing.copies(d.select(*[c for c in d.columns if c != "text"], F.length("text").cast("long").alias("size"))), ["source_size", "target", "copies"]),
    ],
    ids=["lang_id", "exact", "sharding", "substring", "round_trip", "encode", "quality", "simhash", "similar", "mix", "copies"],
)
def test_clashing_names_and_repeated_rows(docs, run, taken):
    others = ["copies", "target", "fp", "kept", "ids", "cell", "root", "node", "h"]
    clash = docs
    for c in others + taken:
        if c not in clash.columns:
            clash = clash.withColumn(c, F.lit("mine"))
    if "size" in taken:
        clash = clash.withColumn("size", F.lit("mine"))
    plain, got = run(docs), run(clash)
    names = [c for c in plain.columns if c != "_own"]
    assert Counter(map(str, plain.select(names).collect())) == Counter(map(str, got.select(names).collect()))
    kept = [c for c in others if c in got.columns and c not in names]
    assert all(r[c] == "mine" for r in got.select(*kept).collect() for c in kept)


def test_token_counts_with_clashing_names(docs):
    clash = docs.withColumn("n_tokens", F.lit("mine")).withColumn("n_docs", F.lit(1))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(token_counts.count_tokens(docs, bpe.default_path(), ("source",))) == key(token_counts.count_tokens(clash, bpe.default_path(), ("source",)))


def test_repeated_identifiers_are_dealt_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    df = spark.createDataFrame([(None, "a", 10)] * 300 + [(5, "b", s) for s in range(1, 200)], "doc_id long, source string, size long")
    got = mixing.copies(df).collect()
    assert len(got) == 499
    for s in ("a", "b"):
        some = [r for r in got if r["source"] == s]
        assert abs(sum(r["copies"] * r["size"] for r in some) - some[0]["target"]) <= max(r["size"] for r in some)
        # Equal rows differ in their copies where the target asks for it.
        assert len({r["copies"] for r in some}) > 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.copies(df.repartition(5)).collect()))


def test_a_large_group_meets_its_targets_by_bucket(spark):
    df = spark.createDataFrame([(i, "same" if i % 3 else None if i % 2 else f"text {i}") for i in range(600)], "doc_id long, text string")
    got = sharding.shard_documents(df, shards=6).collect()
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(got) == 600
    # 400 copies need four shards of 100; they start with 66 or 67 in each of six.
    assert sum(n for _, n in Counter(r["shard"] for r in got if r["doc_id"] % 3).most_common(4)) > 300


def test_language_id_against_plain_vectors(spark):
    rng = random.Random(4)
    vocab = {"aa": ["brom", "kelt", "vosk", "drum"], "bb": ["lui", "ania", "eeo", "ouia"]}
    rows = [(i, sentences(rng, vocab[lang], rng.randrange(1, 60)), lang) for i in range(160) for lang in [rng.choice(list(vocab))]]
    rows += [(900, "qwx zzkq xqj " * 20, None), (901, "brom", None), (902, "", None), (903, "Drüm KELT 12!", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.fit(df)

    def vector(text):
        out = np.zeros(lang_id.DIMS)
        raw = text.encode()
        folded = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in raw)
        data = b" " + b" ".join(folded.split()) + b" "
        for n, salt in ((2, 0x9E3779B1), (3, 0x85EBCA77)):
            for i in range(len(data) - n + 1):
                out[(int.from_bytes(data[i : i + n], "big") * salt & 0xFFFFFFFF) >> 18] += 1
        out = np.log1p(out) * model.idf
        return out / max(np.linalg.norm(out), 1e-12)

    got = {r["doc_id"]: r for r in lang_id.predict(df, model).collect()}
    for i, text, _ in rows:
        if not any(c.isalpha() for c in text):
            assert got[i]["rejected"] and got[i]["lang_pred"] == "und"
            continue
        cosines = model.centroids @ vector(text)
        j = int(np.argmax(cosines))
        assert got[i]["lang_pred"] == model.langs[j] and got[i]["score"] == pytest.approx(cosines[j], abs=1e-5)
        assert got[i]["rejected"] == (cosines[j] < model.floor(j, len(text)))
    assert got[900]["rejected"] and not got[901]["rejected"]


def test_crowded_cells_and_shingles_take_the_exact_way(spark, monkeypatch):
    rng = random.Random(6)
    center = rng.getrandbits(64)
    fps = {center ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(120)}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    found = []
    for cell in (64, 3):
        monkeypatch.setattr(simhash, "CELL", cell)
        links = [(r["a"], r["b"]) for r in simhash.links(df).collect()]
        assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in links)
        found.append({r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()})
    assert found[0] == found[1] and len(found[0]) > 40
    for a in fps:
        for b in fps:
            if a != b and (a ^ b).bit_count() <= 2:
                assert found[0].get(signed(a), signed(a)) == found[0].get(signed(b), signed(b))


def test_stages_on_odd_tables(spark):
    import corpus_pipeline

    long_ = "one two three four five six seven eight nine ten eleven twelve"
    odd = [(3, long_, None, "s", 1), (5, long_, None, "s", 2), (5, "an unrelated text under the number five", None, "s", 3), (None, long_, None, None, 4), (None, None, None, None, 5), (8, "1 2", None, "s", 6)]
    docs = spark.createDataFrame(odd, DOC)
    for c in ("kept", "score", "rejected", "keep_id", "fp", "copies", "target", "component_id", "digest", "_own"):
        docs = docs.withColumn(c, F.lit("mine"))
    of = lambda stage: sorted((r["n_chars"] for r in stage(spark, docs, "").collect() if r["kept"] == r["_own"] == r["digest"] == "mine"))
    assert of(corpus_pipeline.language_id) == [1, 2, 3, 4]  # nothing is labelled: only texts without a letter go
    assert of(corpus_pipeline.exact) == [2, 3, 5, 6]
    assert of(corpus_pipeline.near) == [1, 3, 5, 6]
    assert set(of(corpus_pipeline.mixture)) <= {1, 2, 3, 4, 6}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        none = stage(spark, docs.limit(0), "")
        assert none.columns == docs.columns and none.count() == 0
    assert corpus_pipeline.encode(spark, docs.limit(0), "").count() == 0


def test_quality_against_plain_distances(spark):
    rng = random.Random(12)
    letters = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéüßABC") for _ in range(k))
    vocab = {lang: some * 3 + [letters(rng.randrange(2, 9)) for _ in range(60)] for lang, some in quality.COMMON_WORDS.items()}
    rows = []
    for i in range(120):
        lang = rng.choice([*vocab, None])
        some = [rng.choice(vocab[lang or "en"]) + rng.choice(["", "", "", ",", ".", "\n", " 12 #", "!?"]) for _ in range(rng.randrange(20, 260))]
        if i % 9 == 0:
            some = [letters(6) for _ in some]
        if i % 11 == 0:
            some = ["".join(rng.choice("#%0123456789-()") for _ in range(5)) for _ in some]
        rows.append((i, " ".join(some), lang))
    rows += [(900, None, "en"), (901, "The the THE, the.", "en")]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}

    def classes(t):
        kinds = [str.islower, None, None, None, str.isupper]
        out = [0] * 8
        for c in t or "":
            if "a" <= c <= "z":
                out[0] += 1
            elif c in " \t\x0b\f\r":
                out[1] += 1
            elif c == "\n":
                out[2] += 1
            elif c.isalpha():
                out[4 if kinds[4](c) else 3] += 1
            elif c in ".,;:!?'\"()-":
                out[5] += 1
            elif c in "0123456789":
                out[6] += 1
            else:
                out[7] += 1
        return out

    def split(t):
        """Symbols are a class of their own in the histogram's last two places."""
        c = classes(t)
        symbols = sum(x in quality.SYMBOLS for x in t or "")
        # Order of the operator: plain letters, blanks, line ends, other lower, upper, marks, digits, symbols, rest.
        return np.array([c[0], c[1], c[2], c[3], c[4], c[5], c[6], symbols, c[7] - symbols], float)

    def tokens(t):
        return [w.lower() for w in "".join(x for x in t or "" if x not in ".,;:!?").split()]

    def common(t):
        w = tokens(t)
        counts = [w.count(v) for v in quality.VOCABULARY]
        return np.array([*counts, len((t or "").split()) - sum(counts)], float)

    def js(p, q):
        m = (p + q) / 2
        part = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m) if a > 0)
        return np.sqrt(max(0.0, (part(p) + part(q)) / 2))

    merged = lambda c: np.array([c[0] + c[3], *np.delete(c, [0, 3])])
    refs = {lang: [sum(f(t) for _, t, k in rows if k == lang) for f in (lambda t: merged(split(t)), common)] for lang in {k for *_, k in rows}}
    none = np.array([0.0] * len(quality.VOCABULARY) + [1.0])
    far, cap = {}, {}
    for i, t, lang in rows:
        c, w = refs[lang][0] / refs[lang][0].sum(), refs[lang][1] / refs[lang][1].sum()
        n, chars = len((t or "").split()), sum(not x.isspace() for x in t or "")
        a = js(merged(split(t)) / merged(split(t)).sum(), c) if chars >= quality.MIN_CHARS else None
        b = js(common(t) / n, w) if n >= quality.MIN_WORDS else None
        far[i], cap[lang] = (lang, a, b, n, n * (1 - w[-1]) >= quality.EXPECTED), quality.BELOW_NONE * js(none, w)
        assert (got[i]["char_distance"] is None) == (a is None) and (got[i]["word_distance"] is None) == (b is None), i
        assert a is None or got[i]["char_distance"] == pytest.approx(a, abs=1e-9), i
        assert b is None or got[i]["word_distance"] == pytest.approx(b, abs=1e-9), i
    for i, (lang, a, b, n, enough) in far.items():
        known = [x[2] for x in far.values() if x[0] == lang and x[2] is not None]
        calm = known and np.mean([x <= cap[lang] for x in known]) > quality.WITHIN
        limit = min(quality.MAX_WORD_DISTANCE, cap[lang]) if enough and calm else quality.MAX_WORD_DISTANCE
        kept = not got[i]["base_failed"] and (a or 0) <= quality.MAX_CHAR_DISTANCE and (b or 0) <= limit
        assert got[i]["kept"] == kept, i
    both = [sum(not got[i]["base_failed"] and x is not None and x > m for i, x, m in some) for some in ([(i, v[1], quality.MAX_CHAR_DISTANCE) for i, v in far.items()], [(i, v[2], cap[v[0]]) for i, v in far.items()])]
    assert min(both) > 0 and sum(r["kept"] for r in got.values()) > 20
