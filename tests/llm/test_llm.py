"""The corpus operators against brute force on small fixtures with nulls, ties, copies and very long texts."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from emberline.llm import anchors, bpe, exact_dedup, lang_id, mixing, quality, sharding, simhash, substring_dedup, token_counts, url_filter
from emberline.llm.suffix import suffix_array

DOC = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = "[^\x20\x09-\x0d]+"


def corpus():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 7))) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, long_text = text(40), text(6000)
    texts = [None, "", "   \n\t", "word", "a b", "Ünïcode ñandú – 漢字 \U0001f600", "12 34 !!", passage, passage, passage, f"{text(5)} {passage} {text(9)}", f"{passage}\n{passage}", long_text, long_text + " end"]
    for _ in range(25):
        t = text(rng.randrange(3, 80))
        texts += [t] * rng.choice([1, 1, 2, 5])
    texts += ["the the the the\nthe the the the\n\nx\nx", "<|endoftext|> a<|endoftext|>", "z" * 300]
    return [(i * 3 if i else None, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "é", None]), None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOC).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def words(t):
    return regex.findall(SPACE, t or "")


# Exact dedup


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(docs, keep):
    groups = defaultdict(list)
    for i, t, *_ in corpus():
        groups[t or ""].append(i)
    got = by_id(exact_dedup.exact_dedup(docs.withColumn("kept", F.lit("clash")), keep=keep, runs=8, fan_in=3))
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        want = ((min if keep == "smallest" else max)(known)) if known else None
        for i in ids:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (want, len(ids), i == want, hashlib.sha256(t.encode()).hexdigest())


def test_exact_dedup_empty_and_repeated_rows(docs, empty):
    assert exact_dedup.exact_dedup(empty).count() == 0
    twice = docs.where("doc_id = 9").union(docs.where("doc_id = 9"))
    assert [(r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(twice).collect()] == [(2, True)] * 2


# URL filter


def test_url_filter(spark):
    urls = {
        "http://a.com/x": ("a.com", "/x", "com/", "allow"),
        "https://EXAMPLE.com/en/1?q=1": ("example.com", "/en/1", "example.com/en/", "block"),
        "https://m.www.example.com/en/": ("m.www.example.com", "/en/", "www.example.com/en/", "allow"),
        "https://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://x.net/es/2#f": ("x.net", "/es/2", "net/es/", "block"),
        "http://x.net/esp": ("x.net", "/esp", None, "allow"),
        "http://spam-farm.example.org/a": ("spam-farm.example.org", "/a", None, "block"),
        "http://com": ("com", "", None, "allow"),
        "no scheme com/": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "a://b.com://c/net/es/": ("b.com:", "//c/net/es/", None, "allow"),
    }
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate([*urls, *urls])], "page_id long, url string, rule string")
    out = url_filter.url_filter(pages, url_filter.HOST_RULES + url_filter.PATTERN_RULES).collect()
    assert len(out) == 2 * len(urls)
    for r in out:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == urls[r["url"]], r["url"]
    often = spark.createDataFrame([(k, u) for k, u in enumerate([None] * 90 + ["http://x.net/es/2#f"] * 120 + list(urls) * 2)], "page_id long, url string")
    out = url_filter.url_filter(often, url_filter.HOST_RULES + url_filter.PATTERN_RULES).collect()
    assert len(out) == 210 + 2 * len(urls) and all((r["host"], r["path"], r["rule"], r["verdict"]) == urls[r["url"]] for r in out)
    assert url_filter.url_filter(pages.limit(0), url_filter.HOST_RULES).count() == 0
    with pytest.raises(ValueError):
        url_filter.url_filter(pages, [url_filter.Rule("x", "block", ".*", (), 1)])


# Quality


def test_quality_counts(docs, empty):
    got = by_id(quality.features(docs))
    for i, t, *_ in corpus():
        t = t or ""
        w, lines = words(t), [x for x in t.split("\n") if words(x)]
        n = Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i, x in enumerate(zip(w, w[1:], w[2:])) if n[x] > 1 for k in range(3)}
        want = (len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in t), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert sum(r["_chars"]) == len(t) and sum(r["_common"]) == len(w)
    assert quality.judge(empty).count() == 0


def test_quality_sorts_windows_where_hashes_clash(spark, monkeypatch):
    text = " ".join(random.Random(1).choice("ab") for _ in range(200))
    monkeypatch.setattr(quality, "PLACE", 150)  # fewer places than words: the slow path
    w = text.split()
    n = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i, x in enumerate(zip(w, w[1:], w[2:])) if n[x] > 1 for k in range(3)}
    df = quality.repeated_words(spark.createDataFrame([(text,)], "text string").select(F.split("text", " ").alias("_w")))
    assert df.first()["n_repeat_words"] == len(covered)


def test_quality_verdicts(spark):
    rng = random.Random(2)
    clean = [" ".join(rng.choice(["the", "of", "and", "house", "tree", "runs", "small"]) + str(rng.randrange(9999)) * (rng.random() < 0.3) for _ in range(300)) for _ in range(40)]
    junk = " ".join(rng.choice("#*$%&|<>") * 5 + "A9" * 3 + str(k) for k in range(300))
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*clean, junk, "too short", None])], "doc_id long, text string, lang string")
    got = by_id(quality.judge(df))
    assert all(got[i]["kept"] for i in range(40)) and not got[40]["kept"] and not got[40]["base_failed"] and got[41]["base_failed"] and got[42]["base_failed"]


def test_quality_folds_words_and_knows_all_letters(spark):
    text = "The the, THE. t.h.e Und/und other y! Ünd Привет МИР Ωμέγα 漢字 ǅ Łódź 😀 \x01 <& 12 (á)\n"
    r = quality.features(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    found = dict(zip([*quality.VOCABULARY, ""], r["_common"]))
    assert (found["the"], found["y"], found["und"], found[""]) == (4, 1, 0, len(words(text)) - 5)
    upper, lower = len(regex.findall(r"\p{Lu}", text)), len(regex.findall(r"\p{L}", text)) - len(regex.findall(r"\p{Lu}", text))
    marks, rest = sum(c in ".,;:!?'\"()-" for c in text), len("/😀\x01")
    assert list(r["_chars"]) == [lower, text.count(" "), 1, upper, marks, 2, 2, rest] and upper == 12


def test_quality_rejects_long_texts_without_common_words(spark):
    rng = random.Random(3)
    plain = ["".join(rng.choice("etaoinshrdl") for _ in range(rng.randrange(3, 8))) for _ in range(400)]
    clean = [" ".join(rng.choice(quality.COMMON_WORDS["en"]) if rng.random() < 0.15 else rng.choice(plain) for _ in range(300)) for _ in range(40)]
    salad = " ".join(rng.choice(plain) for _ in range(300))
    other = [" ".join(rng.choice(plain) for _ in range(300)) + " the" * (k == 0) for k in range(20)]  # a language without a list
    rows = [(i, t, "en") for i, t in enumerate([*clean, salad])] + [(100 + i, t, "xx") for i, t in enumerate(other)]
    got = by_id(quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert [i for i, r in got.items() if not r["kept"]] == [40] and not got[40]["base_failed"] and got[40]["word_distance"] < quality.MAX_WORD_DISTANCE


# SimHash


def simhash_of(t):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = words(w)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes_of(values, link):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    vs = list(parent)
    for i, a in enumerate(vs):
        for b in vs[i + 1 :]:
            if link(a, b):
                parent[find(a)] = find(b)
    return {v: find(v) for v in vs}


def test_simhash_documents(docs, empty):
    got = by_id(simhash.near_duplicates(docs))
    fps = {i: simhash_of(t) for i, t, *_ in corpus()}
    roots, first = classes_of(set(fps.values()), lambda a, b: (a ^ b).bit_count() <= 2), {}
    for i, f in fps.items():
        if i is not None:
            first[roots[f]] = min(first.get(roots[f], i), i)
    for i, f in fps.items():
        assert got[i]["fingerprint"] == f"{f:016x}" and got[i]["component_id"] == first.get(roots[f])
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_links_of_chains_and_clusters(spark):
    rng = random.Random(3)
    fps = {0, (1 << 64) - 1}
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(40):
            fps.add(x)
            x ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64)) if rng.random() < 0.7 else rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(df)).collect()}
    roots = classes_of(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    members = defaultdict(set)
    for f, r in roots.items():
        members[r].add(signed(f))
    for group in members.values():
        assert {got.get(f, f) for f in group} == {min(group)}
    assert max(map(len, members.values())) > 10


def shingle_set(t):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("most", [16, 3])
def test_near_stage_takes_edited_copies(spark, monkeypatch, most):
    import corpus_pipeline

    rng = random.Random(11)
    vocab = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(3, 8))) for _ in range(900)]
    passage, rows = [rng.choice(vocab) for _ in range(40)], []

    def edited(w, n):
        w = list(w)
        for i in rng.sample(range(len(w)), n):
            w[i] = "Edit" + str(rng.randrange(10**6))
        return " ".join(w)

    for _ in range(40):  # similarities on either side of 0.8, boilerplate that all share, and short texts
        base = [rng.choice(vocab) for _ in range(rng.choice([4, 12, 60, 300]))] + passage * (rng.random() < 0.5)
        rows += [edited(base, k) for k in (0, 1, len(base) // 60, len(base) // 40, len(base) // 25) if k < 2 or len(base) > 30]
    cluster = [rng.choice(vocab) for _ in range(200)]
    rows += [edited(cluster, 1) for _ in range(50)] + [None, "", " "]
    straddling = [rng.choice(vocab) for _ in range(150)]  # one group, few of whose pairs are similar enough
    rows += [edited(straddling, rng.randrange(1, 7)) for _ in range(70)]
    rng.shuffle(rows)
    sets = {i: shingle_set(t) for i, t in enumerate(rows)}
    roots = classes_of(sets, lambda a, b: (not sets[a] and not sets[b]) or (len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9 and bool(sets[a] & sets[b])))
    first = {}
    for i, r in roots.items():
        first[r] = min(i, first.get(r, i))
    monkeypatch.setattr(simhash, "MOST", most)
    monkeypatch.setattr(simhash, "CHUNK", most)
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(rows)], DOC)
    kept = {r["doc_id"] for r in corpus_pipeline.near(spark, docs, "").collect()}
    assert kept == set(first.values()) and len(kept) < len(rows) - 90
    assert simhash.similar_documents(docs.limit(0)).count() == 0


def test_fingerprints_are_made_of_few_texts_at_once(spark, monkeypatch):
    @F.pandas_udf("long")
    def together(some: pd.Series) -> pd.Series:
        return pd.Series([len(some)] * len(some), dtype="int64")

    monkeypatch.setattr(simhash, "fingerprints", lambda docs, text, n: docs.withColumn("fp", together(text)).drop(text))
    docs = spark.range(0, 1300, 1, 1).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text"))
    assert {r["fp"] for r in simhash.near_duplicates(docs).select("fp").distinct().collect()} == {500, 300}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"


def plan_run(df):
    """The plan of a table as it ran in the end."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_grid_of_fingerprints_is_joined_without_a_broadcast(spark, monkeypatch):
    plans, real = [], simhash.store
    monkeypatch.setattr(simhash, "store", lambda df, *a: plans.append(plan_run(df)) or real(df, *a))
    fps = spark.range(2000).select(F.xxhash64("id").alias("fp")).union(spark.createDataFrame([(1,), (3,)], "fp long"))
    found = simhash.links(fps)
    assert (3, 1) in {(r["a"], r["b"]) for r in found.collect()}
    assert "SortMergeJoin [cell" in plans[0] and "BroadcastHashJoin" not in plans[0]  # thirty rows for each of a small table
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, None)], "doc_id long, text string")
    out = simhash.near_duplicates(docs)
    assert {(r["doc_id"], r["component_id"]) for r in out.collect()} == {(1, 1), (2, 1), (3, 3)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rightHint=(strategy=merge)") == 3


def test_near_stage_joins_sets_by_their_fingerprints(spark, monkeypatch):
    import corpus_pipeline

    rng, seen, real = random.Random(5), [], simhash.meetings
    rows = []
    for _ in range(8):
        base = ["".join(rng.choice("etaoinshr") for _ in range(6)) for _ in range(300)]
        rows += [" ".join(base[:-1] + [str(k)]) for k in range(5)]
    monkeypatch.setattr(simhash, "meetings", lambda nodes, roots: seen.append((nodes, roots)) or real(nodes, roots))
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(rows)], DOC)
    assert {r["doc_id"] for r in corpus_pipeline.near(spark, docs, "").collect()} == set(range(0, 40, 5))
    nodes, roots = seen[0]  # what fingerprints have joined before other candidates are sought
    fps = {r["node"]: r["fp"] & (2**64 - 1) for r in nodes.collect()}
    assert set(fps.values()) == {simhash.fingerprint(t, 5) & (2**64 - 1) for t in rows}  # no shingle of these repeats
    root = {r["node"]: r["root"] for r in roots.collect()}
    close = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    assert len(close) > 20 and all(root.get(a, a) == root.get(b, b) for a, b in close)


def test_near_stage_joins_what_it_explodes_without_a_broadcast(spark, monkeypatch):
    plans, real = [], simhash.store
    monkeypatch.setattr(simhash, "store", lambda df, *a: plans.append(plan_run(df)) or real(df, *a))
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(6))
    base = [word() for _ in range(299)]
    rows = [" ".join(base + [word()]) for _ in range(20)]
    texts = spark.createDataFrame([(t,) for t in rows], "_text string")
    nodes = real(simhash.described(texts, 5, np.zeros(0, np.int64)))
    met = simhash.meetings(nodes, spark.createDataFrame([], "node binary, root binary"))
    assert met.count() > 100 and met.agg(F.max("n")).first()[0] == 20
    joins = [p for p in plans if "Join" in p]
    assert len(joins) == 2 and "SortMergeJoin [h" in joins[0] and "BroadcastHashJoin" not in joins[0]  # an array counts as one entry
    assert "SortMergeJoin [_short" in joins[1]
    pairs = simhash.fingerprint_pairs(nodes.withColumn("root", F.col("node")))
    assert pairs.count() and "SortMergeJoin [a" in plan_run(pairs)


def test_crowded_shingles_list_a_pair_once(spark, monkeypatch):
    rng = random.Random(6)
    base = ["".join(rng.choice("etaoinshr") for _ in range(6)) for _ in range(120)]
    rows = [" ".join(base[:k] + [f"edit{k}"] + base[k + 1 :]) for k in range(10, 50)]
    monkeypatch.setattr(simhash, "MOST", 3)
    monkeypatch.setattr(simhash, "CHUNK", 8)
    texts = spark.createDataFrame([(t,) for t in rows], "_text string")
    none = spark.createDataFrame([], "node binary, root binary")
    met = simhash.meetings(simhash.described(texts, 5, np.zeros(0, np.int64)), none)
    got = [(r["a"], r["b"]) for r in simhash.cross_pairs(met, none).collect()]
    assert len(got) == len(set(got)) == 40 * 39 // 2  # all share several crowded shingles, and all are similar
    nodes, y_nodes = [bytes([k]) for k in range(10)], [bytes([k]) for k in range(10, 20)]
    side = lambda root: np.array([root] * 10 + [50] * 10 + [0] * 80)
    pairs = simhash.block_pairs(nodes, side(1), y_nodes, side(2), most=4)
    assert len(pairs) == 5 and pairs[-1] == (None, None)  # one link joins the two: the nearest first, and word that there are more
    assert len(simhash.block_pairs(nodes, side(1), y_nodes, side(2))) == 100


def test_chunks_of_a_crowded_shingle_go_to_few_places(spark, monkeypatch):
    rng, kept, real = np.random.default_rng(8), [], simhash.store
    monkeypatch.setattr(simhash, "MOST", 3)
    monkeypatch.setattr(simhash, "CHUNK", 8)
    monkeypatch.setattr(simhash, "PER_KEY", 4)
    monkeypatch.setattr(simhash, "store", lambda df, *a: kept.append(real(df, *a)) or kept[-1])
    rows = [(h, 200, rng.bytes(16), 9) for h in (5, 7) for _ in range(200)]
    rows += [(9, 200, node, 9) for _, _, node, _ in rows[:200]]
    met = spark.createDataFrame(rows, "h long, n long, node binary, m int").select("*", F.col("node").alias("root"), *(F.lit(0).cast("long").alias(b) for b in simhash.PARITY))
    assert simhash.cross_pairs(met, spark.createDataFrame([], "node binary, root binary"), 4).where("a IS NOT NULL").count()
    chunks = next(t for t in kept if "keys" in t.columns).collect()
    for h in (5, 7, 9):  # no two nodes of one component: 25 chunks of them, a quarter as many places
        assert {r["keys"] for r in chunks if r["h"] == h} == {7}
        assert all(x <= h for r in chunks if r["h"] == h for hs in r["all"]["hs"] for x in hs)


def test_chunks_of_a_large_component_go_only_where_others_are(spark, monkeypatch):
    rng = np.random.default_rng(10)
    monkeypatch.setattr(simhash, "MOST", 3)
    monkeypatch.setattr(simhash, "CHUNK", 8)
    monkeypatch.setattr(simhash, "PER_KEY", 4)
    nodes = [rng.bytes(16) for _ in range(500)]
    roots = {v: nodes[0] if k < 400 else nodes[400] if k < 440 else v for k, v in enumerate(nodes)}  # 400, 40 and sixty of one
    met = spark.createDataFrame([(5, 500, v, 9) for v in nodes], "h long, n long, node binary, m int").select("*", F.col("node").alias("root"), *(F.lit(0).cast("long").alias(b) for b in simhash.PARITY))
    joined = spark.createDataFrame([(v, r) for v, r in roots.items() if r != v], "node binary, root binary")
    chunks = simhash.crowd_chunks(met, joined)
    there = simhash.places(chunks).collect()
    owner = {bytes(v): r["name"]["own"] for r in chunks.collect() for v in r["all"]["nodes"]}
    hot = [r for r in there if owner[bytes(r["nodes"][0])] == owner[nodes[0]]]
    # 63 chunks in 16 bands: two of small components, one or two of the other large one. Nothing goes to all 16 but what isn't hot.
    assert len(there) < 500 and max(sum(r["at"] == x["at"] for r in hot) for x in hot) <= 5
    assert max(Counter((r["i"], r["j"]) for r in there).values()) <= 8
    found = Counter()
    got = simhash.cross_pairs(met, joined).collect()
    found.update((r["a"], r["b"]) for r in got)
    want = {(max(a, b), min(a, b)) for k, a in enumerate(nodes) for b in nodes[:k] if roots[a] != roots[b]}
    assert {(bytes(a), bytes(b)) for a, b in found} == want and set(found.values()) == {1}


def test_few_pairs_are_checked_in_one_pass(spark, monkeypatch):
    rng, kept, real = random.Random(12), [], simhash.store
    base = ["".join(rng.choice("etaoinshr") for _ in range(6)) for _ in range(120)]
    rows = [" ".join(base[:k] + [f"edit{k}"] + base[k + 1 :]) for k in range(10, 40)] + [" ".join(base[:60])]
    texts = spark.createDataFrame([(t, t.encode()) for t in rows], "_text string, _digest binary")
    sets = {simhash.node_of(simhash.shingle_set(t, 5)): (t, simhash.shingle_set(t, 5)) for t in rows}
    firsts = spark.createDataFrame([(v, t.encode()) for v, (t, _) in sets.items()], "node binary, _digest binary")
    pairs = spark.createDataFrame([(a, b) for a in sets for b in sets if a > b], "a binary, b binary")
    monkeypatch.setattr(simhash, "store", lambda df, *a: kept.append(real(df, *a)) or kept[-1])
    want = {(a, b) for a in sets for b in sets if a > b and 5 * len(np.intersect1d(sets[a][1], sets[b][1])) >= 4 * len(np.union1d(sets[a][1], sets[b][1]))}
    for slice_, passes in ((1 << 14, 1), (150, 4), (1, 4)):
        monkeypatch.setattr(simhash, "SLICE", slice_)
        kept.clear()
        assert {(bytes(r["a"]), bytes(r["b"])) for r in simhash.verified(pairs, texts, firsts, 5).collect()} == want and len(want) == 435
        assert len(kept) == 1 + passes  # the sets, then each part of the pairs
    kept.clear()
    assert simhash.verified(pairs.limit(0), texts, firsts, 5).count() == 0 and not kept


def test_near_stage_makes_components_again_only_for_new_links(spark, monkeypatch):
    import corpus_pipeline

    rng, seen, real = random.Random(9), [], simhash.components
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(6))
    rows = []
    for _ in range(4):
        base = [word() for _ in range(300)]
        rows += [" ".join(base[:-1] + [str(k)]) for k in range(5)]
    monkeypatch.setattr(simhash, "components", lambda *a: seen.append(a[0].count()) or real(*a))
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(rows)], DOC)
    assert {r["doc_id"] for r in corpus_pipeline.near(spark, docs, "").collect()} == set(range(0, 20, 5))
    joined = spark.createDataFrame([(b"b", b"a"), (b"c", b"a"), (b"e", b"d")], "node binary, root binary")
    assert len(seen) <= 2 and simhash.rejoined(joined, joined.selectExpr("node AS a", "root AS b").limit(0)) is joined
    more = simhash.rejoined(joined, spark.createDataFrame([(b"e", b"c"), (b"g", b"f")], "a binary, b binary"))
    assert {(bytes(r["node"]), bytes(r["root"])) for r in more.collect()} == {*((x, b"a") for x in (b"b", b"c", b"d", b"e")), (b"g", b"f")}


def test_parities_never_rule_out_a_link():
    rng = np.random.default_rng(3)
    for size in (1, 7, 100, 3000):
        keys = np.unique(rng.integers(-(2**63), 2**63, 2 * size))
        for k in range(0, size, max(1, size // 20)):
            x, y = keys[:size], np.concatenate([keys[k:size], keys[size : size + k]])
            apart = sum(int(np.uint64(v)).bit_count() for v in (simhash.parities(x) ^ simhash.parities(y)).view(np.uint64))
            assert apart <= 2 * k
            pairs = simhash.block_pairs([b"x"], np.array([1, len(x), *simhash.parities(x)]), [b"y"], np.array([2, len(y), *simhash.parities(y)]))
            assert pairs == [(b"y", b"x")] or 5 * (size - k) < 4 * (size + k)


# Language ID


def test_language_id(spark, empty):
    rng = random.Random(4)
    vocab = {"aa": ["brom", "kelt", "vosk", "drum"], "bb": ["lui", "ania", "eeo", "ouia"], "cc": ["xyz", "zzq", "qxx", "yzy"]}
    rows = [(i, " ".join(rng.choice(vocab[lang]) for _ in range(rng.randrange(1, 60))), lang) for i in range(240) for lang in [rng.choice(list(vocab))]]
    extra = [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 -- !", "bb"), (1003, "漢字仮名", None), (None, "brom kelt", "aa")]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = lang_id.fit(df.where(~lang_id.is_held_out()))
    got = by_id(lang_id.predict(df, model))
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in rows if i in set(held)) >= 0.97 * len(held) and len(held) > 40
    assert not any(got[i]["rejected"] for i, *_ in rows)
    assert [(got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) for i in (1000, 1001, 1002)] == [("und", 0.0, True)] * 3
    assert got[1003]["lang_pred"] in vocab and got[1003]["rejected"] and got[None]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert lang_id.identify(empty).count() == 0
    assert {r["lang_pred"] for r in lang_id.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_id_rejects_unlike_texts(spark):
    rng = random.Random(9)
    vocab = {
        "en": "the of and house which there with they have from water other people could through country government between".split(),
        "fr": "le la les et des une que pour maison dans avec sont leurs toujours gouvernement pays entre personnes eau".split(),
    }
    finnish = "talossa on monta huonetta ja ikkunaa joista nähdään järvelle sekä kaukana siintävät metsät kylmänä syysyönä".split()
    letters = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(n))
    rows = [(i, " ".join(rng.choice(vocab[lang]) for _ in range(rng.randrange(30, 120))), lang) for i in range(300) for lang in ["en" if i % 2 else "fr"]]
    odd = [(1000 + i, letters(80), "en" if i % 2 else "fr") for i in range(2)]  # mislabelled: they set no limit
    model = lang_id.fit(spark.createDataFrame(rows + odd, "doc_id long, text string, lang string"))
    tests = [(2000 + i, letters(n), None) for i, n in enumerate([40, 80, 200])] + [(2100 + i, " ".join(rng.choice(finnish) for _ in range(n)), None) for i, n in enumerate([40, 80, 200])]
    short = [(3000 + i, " ".join(t.split()[:4]), lang) for i, t, lang in rows[:20]]
    got = by_id(lang_id.predict(spark.createDataFrame(rows + tests + short, "doc_id long, text string, lang string"), model))
    assert all(got[i]["rejected"] for i, *_ in tests)
    assert sum(got[i]["rejected"] for i, *_ in rows + short) <= 3


def test_ngram_counts_do_not_depend_on_pieces(monkeypatch):
    text = "abc " * 50 + "é–x" * 40
    whole = lang_id.ngram_counts(text)
    monkeypatch.setattr(lang_id, "PIECE", 7)
    assert (lang_id.ngram_counts(text) == whole).all()


# Sharding


def test_sharding(docs, empty):
    got = sharding.shard_documents(docs.withColumn("shard", F.lit("clash")), shards=5, rounds=3).collect()
    text = {i: t for i, t, *_ in corpus()}
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == len(text) and set(sizes) == set(range(5)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(5):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    held = defaultdict(set)
    for r in got:
        t = text[r["doc_id"]]
        assert r["size"] == len((t or "").encode()) + 16 and r["text_crc32"] == zlib.crc32((t or "").encode()) and r["law"] == "rows" and r["grown_shard"] is None
        held[t].add(r["shard"])
    groups = [t for t, n in Counter(text.values()).items() if n > 1 and t is not None]
    assert sum(len(held[t]) == 1 for t in groups) >= 0.6 * len(groups)
    assert sharding.shard_documents(empty).count() == 0


def spark_hash(*values):
    """The 64-bit hash of SQL's xxhash64 over strings, bytes, ints (as pairs of value and width) and nulls."""
    h = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else v if isinstance(v, bytes) else (v[0] % (1 << 8 * v[1])).to_bytes(v[1], "little")
            h = xxhash.xxh64_intdigest(data, h)
    return h - (1 << 64) if h >> 63 else h


def propagated(rows, shards, rounds):
    """Label propagation in plain Python: (id, text) -> counts of (id, text, shard, slot)."""
    text_hash = [spark_hash(t) for _, t in rows]
    bucket = [spark_hash(None if i is None else str(i), (h, 8), (7, 4)) % sharding.BUCKETS for (i, _), h in zip(rows, text_hash)]
    place = [(b, i is None, i or 0, h, len((t or "").encode()) + 16) for b, (i, t), h in zip(bucket, rows, text_hash)]
    shard = {r: k % shards for k, r in enumerate(sorted(range(len(rows)), key=place.__getitem__))}
    members = defaultdict(list)
    for r, (_, t) in enumerate(rows):
        if t is not None:
            members[hashlib.sha256(t.encode()).digest()].append(r)
    groups = {g: m for g, m in members.items() if len(m) > 1}
    capacity = max(1, len(rows) // shards)
    for round_ in range(rounds):
        want = {r: sharding.FREE for r in range(len(rows))}
        for g, m in groups.items():
            held = Counter(shard[r] for r in m)
            liked = sorted(held, key=lambda s: (-held[s], spark_hash(g, (s, 4))))[: -(-len(m) // capacity)]
            for r in m:
                want[r] = None if shard[r] in liked else liked[spark_hash(None if rows[r][0] is None else str(rows[r][0]), (round_, 4)) % len(liked)]
        asking = defaultdict(list)
        for r in sorted(want, key=place.__getitem__):
            if want[r] is not None:
                asking[shard[r], want[r]].append(r)
        counts = {k: len(v) for k, v in asking.items()}
        moves = sharding.plan_moves({k: n for k, n in counts.items() if k[1] != sharding.FREE}, {k[0]: n for k, n in counts.items() if k[1] == sharding.FREE}, shards)
        for a, t, low, high, to in moves:
            shard.update(dict.fromkeys(asking[a, t][low:high], to))
    slots, seen = [], Counter()
    for r in sorted(shard, key=place.__getitem__):
        slots.append((rows[r][0], text_hash[r], shard[r], seen[shard[r]]))
        seen[shard[r]] += 1
    return Counter(slots)


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_sharding_against_plain_python(spark, docs, rounds):
    rng = random.Random(rounds)
    rows = [(i, t) for i, t, *_ in corpus()] + [(1000 + i, f"shared {rng.randrange(12)}") for i in range(90)] + [(None, "no name"), (None, "no name"), (5000, "hot"), (5000, "hot")] + [(2000 + i, "hot") for i in range(60)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.xxhash64("text")), shards=6, rounds=rounds).collect()
    assert Counter((r["doc_id"], r["h"], r["shard"], r["slot"]) for r in got) == propagated(rows, 6, rounds)


def test_one_group_larger_than_a_shard(spark):
    df = spark.createDataFrame([(i, "same" if i < 60 else f"t{i}") for i in range(100)], "doc_id long, text string")
    got = sharding.shard_documents(df, shards=4).collect()
    assert sorted(Counter(r["shard"] for r in got).values()) == [25] * 4
    assert len({r["shard"] for r in got if r["doc_id"] < 60}) == 3


def test_plans_keep_sizes():
    rng = random.Random(6)
    for _ in range(200):
        k = rng.randrange(2, 6)
        asked = {(a, t): rng.randrange(9) for a in range(k) for t in range(k) if a != t}
        free = {t: rng.randrange(6) for t in range(k)}
        change, used = Counter(), Counter()
        for a, want, lo, hi, to in sharding.plan_moves(asked, free, k):
            change[a] -= hi - lo
            change[to] += hi - lo
            used[a, want] += hi - lo
        assert not any(change.values())
        assert all(n <= (free[a] if want == sharding.FREE else asked[a, want]) for (a, want), n in used.items())


# Suffix arrays


def test_suffix_array():
    rng = random.Random(0)
    for _ in range(1500):
        s = [rng.randrange(1, rng.randrange(2, 6)) for _ in range(rng.randrange(0, 50))]
        s = (s * 3)[:60] if rng.random() < 0.3 else s
        s.append(0)
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def removed(rows):
    seen, out = set(), {}
    for i, t in sorted((i, t or "") for i, t in rows if i is not None):
        b, mark = t.encode(), set()
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            mark |= set(range(k, k + 100)) if w in seen else set()
            seen.add(w)
        out[i] = (len(b), len(mark), sum(k - 1 not in mark for k in mark), bytes(x for k, x in enumerate(b) if k not in mark))
    return out


@pytest.mark.parametrize("most", [1500, 1])
def test_repeated_substrings(docs, empty, monkeypatch, most):
    monkeypatch.setattr(substring_dedup, "MOST", most)  # 1: every anchor with several contexts is crowded
    got = by_id(substring_dedup.remove_repeats(docs))
    for i, want in removed((r[0], r[1]) for r in corpus()).items():
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == want
    assert got[None]["n_removed"] == 0
    if most > 1:
        assert substring_dedup.remove_repeats(empty).count() == 0


def test_one_identifier_with_two_texts(spark):
    rng = random.Random(1)
    one, two = ("".join(rng.choice("abc ") for _ in range(n)) for n in (150, 130))
    rows = [(1, one), (1, two), (1, two), (2, one + two)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in got) == [(1, 130, 0), (1, 130, 0), (1, 150, 0), (2, 280, 280)]


@pytest.mark.parametrize("letters", ["ab", "abcdefgh"])
def test_blocks_find_what_windows_say(letters):
    rng = random.Random(3)
    for _ in range(30):
        near, texts = "".join(rng.choice(letters) for _ in range(260)), []
        for _ in range(8):
            t = list(near)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = rng.choice(letters)
            texts.append("".join(t[rng.randrange(40) :]).encode())
        pieces = []
        for data, number, place, starts, lengths in anchors.blocks(texts):
            part, first, n, h, _ = anchors.runs(data, starts, lengths)
            for p, f, k, g in zip(part.tolist(), first.tolist(), n.tolist(), h.view(np.int64).tolist()):
                pieces.append((g, number[p], 0, f - starts[p] + place[p], k, -1, data[f : f + k + 99].tobytes()))
        found = substring_dedup.repeats_in_block(pd.DataFrame(pieces, columns=["h", "doc_id", "v", "pos", "n", "at", "bytes"]))
        got = {(r.doc_id, r.pos + k) for r in found.itertuples() for k in range(r.n)}
        seen, want = set(), set()
        for i, t in enumerate(texts):
            for k in range(len(t) - 99):
                if t[k : k + 100] in seen:
                    want.add((i, k))
                seen.add(t[k : k + 100])
        assert got == want


def test_long_texts_come_in_parts(monkeypatch):
    rng = np.random.default_rng(0)
    texts = [rng.integers(97, 101, n, dtype=np.uint8).tobytes() for n in (5000, 99, 100, 0, 700)]
    monkeypatch.setattr(anchors, "BLOCK", 512)
    covered = Counter()
    for data, number, place, starts, lengths in anchors.blocks(texts):
        part, first, n, _, _ = anchors.runs(data, starts, lengths)
        for p, f, k in zip(part, first, n):
            for j in range(k):
                at = f + j - starts[p] + place[p]
                covered[number[p], at] += 1
                assert texts[number[p]][at : at + 100] == data[f + j : f + j + 100].tobytes()
    assert covered == Counter({(i, k): 1 for i, t in enumerate(texts) for k in range(len(t) - 99)})


# BPE and token counts


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bpe.default_path())


def test_bpe_against_the_library(docs, empty, library):
    got = by_id(bpe.round_trip(docs, bpe.default_path()))
    ids = by_id(bpe.bpe_encode(docs, bpe.default_path()))
    back = by_id(bpe.bpe_decode(bpe.bpe_encode(docs, bpe.default_path()), bpe.default_path()))
    for i, t, *_ in corpus():
        want = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(want, skip_special_tokens=False)
        assert ids[i]["ids"] == want and back[i]["decoded"] == text
        assert got[i]["n_tokens"] == len(want) and got[i]["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest() and got[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.round_trip(empty, bpe.default_path()).count() == 0


def test_bpe_fuzz(library, monkeypatch):
    b = bpe.ByteBpe(open(bpe.default_path(), encoding="utf-8").read())
    rng = random.Random(7)
    alphabet = ["a", "aa", "ab", " the", "ing", "  ", "\n", "'s", "'ll", "<|endoftext|>", "12", "²", "!!", "é", "ß", "\u0085", "\xa0", "\x1c", "漢", "\u2028", "\U0001f600"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 50))) for _ in range(600)] + [rng.choice("abxz ") * rng.randrange(1, 300) for _ in range(100)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, np.uint32).tolist() for x in b.encode_many(texts)] == want
    monkeypatch.setattr(bpe, "LOAD", 20)  # every longer text by pieces, with a cache that overflows
    monkeypatch.setattr(bpe, "CHUNK", 3)
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    b.known.clear()
    assert [np.frombuffer(x, np.uint32).tolist() for x in b.encode_many(texts)] == want
    assert [b.decode(w) for w in want] == [library.decode(w, skip_special_tokens=False) for w in want]


def test_token_counts(docs, empty, library):
    hist = token_counts.count_tokens(docs, bpe.default_path(), ("source",)).cache()
    lengths = defaultdict(list)
    for _, t, _, s, _ in corpus():
        lengths[s].append(len(library.encode(t or "", add_special_tokens=False).ids))
    assert hist.count() == sum(len(set(x)) for x in lengths.values())
    for r in hist.collect():
        x, n = lengths[r["source"]], r["n_tokens"]
        assert (r["n_docs"], r["docs_at_least"], r["tokens_at_least"], r["total_docs"], r["total_tokens"]) == (x.count(n), sum(v >= n for v in x), sum(v for v in x if v >= n), len(x), sum(x))
        assert r["truncated_total"] == sum(min(v, n) for v in x) and r["share_at_most"] == pytest.approx(sum(v <= n for v in x) / len(x))
    for limit in (0, 7, 50, 10**9):
        for r in token_counts.at_limit(hist, limit, ("source",)).collect():
            x = lengths[r["source"]]
            assert (r["docs_over"], r["tokens_kept"]) == (sum(v > limit for v in x), sum(min(v, limit) for v in x))
    for r in token_counts.quantile(hist, 0.5, ("source",)).collect():
        assert r["n_tokens"] == sorted(lengths[r["source"]])[-(-len(lengths[r["source"]]) // 2) - 1]
    assert token_counts.count_tokens(empty, bpe.default_path()).count() == 0


# Mixing


def test_pivotal_keeps_mass_and_expectation():
    rng = np.random.default_rng(1)
    p, size = rng.random(40), rng.integers(1, 50, 40).astype(float)
    runs = [mixing.pivotal(p, size, rng.random(40)) for _ in range(3000)]
    for r in runs[:50]:
        assert ((r > 0) & (r < 1)).sum() <= 1 and r @ size == pytest.approx(p @ size)
    assert np.mean(runs, axis=0) == pytest.approx(p, abs=0.05)


def test_mixing(docs, empty, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 4)  # several levels
    sized = docs.select("doc_id", "source", F.size(mixing.words(F.col("text"))).cast("long").alias("size"))
    got = mixing.copies(sized).collect()
    again = mixing.copies(sized.repartition(7)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    assert sorted(got, key=key) == sorted(again, key=key) and len(got) == len(corpus())
    total = Counter()
    for _, t, _, s, _ in corpus():
        total[s] += len(words(t))
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        rate = (sum(total.values()) - sum(3 * total[s] for s in capped)) / max(1, sum(weight[s] for s in total if s not in capped))
        target = {s: 3 * total[s] if s in capped else weight[s] * rate for s in total}
        over = {s for s in total if target[s] > 3 * total[s]}
        if not over:
            break
        capped |= over
    largest = Counter()
    for r in got:
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in total:
        mine = [r for r in got if r["source"] == s]
        assert mine[0]["source_size"] == total[s] and mine[0]["target"] == pytest.approx(target[s])
        assert abs(sum(r["copies"] * r["size"] for r in mine) - target[s]) <= largest[s] and all(r["copies"] <= 3 for r in mine)
    mixed = Counter(r["doc_id"] for r in mixing.mix(docs).collect())
    assert mixing.mix(docs).columns == docs.columns and sum(mixed.values()) > 0 and mixing.mix(empty).count() == 0


def test_mixing_comes_near_small_targets(spark):
    """Documents that outweigh all others of their source by far: each source still comes within 2 % of its target."""
    rows = [(s * 1000 + k, f"s{s}", int(20_000 / (k + 1) ** 1.5) + 3) for s in range(6) for k in range(60)]
    got = mixing.copies(spark.createDataFrame(rows, "doc_id long, source string, size long"), seed=5).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect()
    assert len(got) == 6 and max(abs(r["taken"] / r["target"] - 1) for r in got) <= 0.02


# Pipeline


def test_pipeline(spark, tmp_path, library):
    import corpus_pipeline

    rng = random.Random(8)
    vocab = {"en": ["the", "house", "tree", "river", "blue", "runs"], "fr": ["le", "maison", "arbre", "fleuve", "bleu", "court"]}
    rows = [(i, " ".join(rng.choice(vocab[lang]) for _ in range(rng.randrange(20, 60))), lang, f"s{i % 3}", None) for i in range(90) for lang in [rng.choice(["en", "fr"])]]
    rows += [(200, rows[0][1], "en", "s0", None), (201, None, "en", "s1", None), (202, "1234", "fr", "s2", None)]
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    left = {i: t for i, t, *_ in rows if i not in (201, 202, 0)}
    sets = {i: shingle_set(t) for i, t in left.items()}
    roots = classes_of(sets, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9)
    first = {}
    for i, r in roots.items():
        first[r] = min(i, first.get(r, i))
    kept = set(first.values())
    sized = spark.createDataFrame([(i, dict((r[0], r[3]) for r in rows)[i], len(words(left[i]))) for i in kept], "_id long, source string, size long")
    copies = {r["_id"]: r["copies"] for r in mixing.copies(sized.withColumn("_one", F.col("size")), id_col="_id").collect() if r["copies"]}
    assert got == Counter({(i, len(library.encode(left[i], add_special_tokens=False).ids)): n for i, n in copies.items()})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
