"""Prefix trie, spelling variants and HTML extraction against brute-force versions, and their edge cases."""

import hashlib
import html
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from emberline.llm import html_text, prefix_trie, spelling

DIR = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
CONVERSATIONS = "conv_id long, turn long, role string, text string"


def rows_of(table, columns):
    return duckdb.sql(f"SELECT {columns} FROM '{DIR}/{table}.parquet'").fetchall()


def conversations_of(rows):
    out = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            out[c].append(((t is not None, t or 0), r or "", x or ""))
    return {c: [t[1:] for t in sorted(ts)] for c, ts in out.items()}


def trie_of(convs):
    """(node columns, ends) by walking all prefixes."""
    members, kids, leaves, saved = defaultdict(list), Counter(), Counter(), Counter()
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    kids.update(p[:-1] for p in members if p)
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
            leaves[p[:d]] += p not in kids
    ends = lambda p, m: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p)).encode()).hexdigest()
    return {(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], ends(p, m)) for p, m in members.items()}


def rebuilt(convs):
    out = {}
    for c, ts in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + ts[h:]
    return out


@tables
def test_trie_of_the_test_table(spark):
    got = [tuple(r) for r in prefix_trie.op11_prefix_trie(spark, DIR).select(*NODE, "ends_sha256").collect()]
    assert len(set(got)) == len(got) and set(got) == trie_of(rebuilt(conversations_of(rows_of("conversations", "conv_id, turn, role, text"))))


@pytest.fixture(scope="module")
def talk(spark):
    """Nulls, ties, a long conversation, one without turns of its own, many alike."""
    rows = [(1, 0, "u", "a"), (1, 1, "a", "b"), (2, 0, "u", "a"), (2, 1, "a", "c"), (3, 0, "u", "x"), (3, None, "u", "a"), (4, 0, None, None), (None, 0, "u", "a"), (105, 0, "u", "é😀")]
    rows += [(1000 + i, k, "u", str((i * 7 + k * k) % 5)) for i in range(40) for k in range(6)] + [(7, 1, "u", "t"), (7, 1, "a", "t"), (7, 1, "a", "s"), (7, 1, "a", "s")]
    rows += [(8, k, "u", "w" * (k % 3)) for k in range(70)] + [(9, k, "u", "w" * (k % 3)) for k in range(60)] + [(2000 + i, 0, "u", "same") for i in range(1200)]
    return spark.createDataFrame(rows, CONVERSATIONS), conversations_of(rows)


def nodes_of(df, primes=prefix_trie.PRIMES):
    turns = prefix_trie.order_turns(df).withColumnRenamed("pos", "depth")
    nodes, ends = prefix_trie.prefix_trie(turns, df.where("conv_id IS NOT NULL").select("conv_id").distinct(), primes)
    digests = prefix_trie.digest_ids(ends, ["depth", "_key"])
    out = nodes.join(digests, ["depth", "_key"], "left").fillna(hashlib.sha256(b"").hexdigest(), ["ends_sha256"])
    return [tuple(r) for r in out.select(*NODE, "ends_sha256").collect()]


def test_trie_edges(talk, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 16)
    got = nodes_of(talk[0])
    assert len(got) == len(set(got)) and set(got) == trie_of(talk[1])


def test_trie_splits_collisions_and_joins_chunks(talk, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    few = talk[0].where("(conv_id <> 8 AND conv_id <> 9 OR turn < 20) AND (conv_id < 1010 OR conv_id > 2000)")
    want = trie_of({c: ts[:20] if c in (8, 9) else ts for c, ts in talk[1].items() if c < 1010 or c > 2000})
    assert set(nodes_of(few, (13, 11))) == want
    keys = lambda primes: prefix_trie.fingerprints(prefix_trie.order_turns(few).withColumnRenamed("pos", "depth"), 0, primes).select("depth", "_key").distinct().count()
    assert keys(prefix_trie.PRIMES) == len(want) - 1 > keys((13, 11))  # so some groups had to be split


def test_trie_of_nothing(spark):
    nothing = spark.createDataFrame([], CONVERSATIONS)
    assert nodes_of(nothing) == [] and prefix_trie.rebuilt(nothing, nothing["conv_id"] - 1, nothing["conv_id"], 5)[0].count() == 0


def test_rebuilt_conversations_without_turns(spark, tmp_path):
    """All turns go where the base is absent and as many lead."""
    long = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(long, 0, "u", "a"), (long, 1, "a", "b"), (300, 0, "u", "z"), (300, 1, "u", "y")] + [(300 + k, 0, "u", "q") for k in range(1, 30)]
    spark.createDataFrame(rows, CONVERSATIONS).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {tuple(r) for r in prefix_trie.op11_prefix_trie(spark, str(tmp_path)).select(*NODE, "ends_sha256").collect()}
    assert got == trie_of(rebuilt(conversations_of(rows)))


def near_words(n):
    """(word, form, root, n, n_near, form_n) for words with their counts, by all deletions."""
    near, gaps = defaultdict(set), defaultdict(list)
    for w in n:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1 :]
            gaps[rest, i].append(w)
            if rest in n:
                near[w].add(rest)
                near[rest].add(w)
    for ws in gaps.values():
        for a in ws:
            near[a] |= set(ws) - {a}
    form = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: b for w, b in form.items() if n[b] >= 10 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def vocabulary(docs):
    c = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]+", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w
            c[w] += len(w) >= 7
    return {w: k for w, k in c.items() if k >= 2}


@tables
def test_spelling_of_the_test_table(spark):
    got = [tuple(r) for r in spelling.op12_spelling(spark, DIR).collect()]
    assert len(got) == len(set(got)) and set(got) == near_words(vocabulary(rows_of("documents", "doc_id, text")))


def test_spelling_edges(spark):
    rng = random.Random(1)
    n = {"".join(rng.choice("abÀÿ") for _ in range(rng.randint(7, 8))): rng.choice([2, 3, 30, 400, 5000]) for _ in range(500)}
    n |= {"a" * 3000: 5, "a" * 2999: 70, "a" * 1500 + "b" + "a" * 1499: 3, "😀" * 8: 2, "😀" * 7: 40, "chain": 2, "chains": 20, "chainsa": 200, "chainsab": 2000, "chainsabc": 20000, "chainsabcd": 200000}
    got = spelling.spelling_variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()
    assert {tuple(r) for r in got} == near_words(n) and {r["root"] for r in got if r["word"] == "chain"} == {"chainsabcd"}
    assert spelling.spelling_variants(spark.createDataFrame([], "word string, n long")).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(spark.createDataFrame([], "word string, n long"), times=1)


def test_anagrams_and_colliding_prints_are_no_neighbours(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PRIMES", (3, 2))  # the exact check decides
    n = {"theating": 9, "heatingt": 9, "gnitaeht": 9, "theatinx": 9, "xheating": 9, "theatin": 9}
    assert {tuple(r) for r in spelling.spelling_variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()} == near_words(n)


def test_vocabulary_edges(spark):
    docs = [(1, "Straßenbahn STRASSENBAHN éclairage Éclairage abcdefg abcdefg1abcdefg"), (2, None), (3, ""), (None, "abcdefg abcdefgh"), (1, "Straßenbahn " * 3), (5, "x" * 5000 + " " + "x" * 5000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "doc_id AS word", "1 AS n", "2 AS _h")
    assert {tuple(r) for r in spelling.vocabulary(frame, drop_every=31).collect()} == set(vocabulary(docs).items())
    assert spelling.vocabulary(frame.where("doc_id = 9")).count() == 0


ARTICLE = re.compile("<article>(.*?)</article>", re.S)


@tables
def test_pages_of_the_test_table(spark):
    want = {}
    for page, url, raw in rows_of("pages", "page_id, url, html"):
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", ARTICLE.search(raw).group(1)))
        text = "\n\n".join(b for b in blocks if b)
        want[page] = (url, text, len(text))
    got = html_text.op13_html_text(spark, DIR).collect()
    assert len(got) == len(want) and {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in got} == want


PROSE = "Here is a sentence, and it goes on. There is another, shorter one. It ends."
PAGES = {
    "soup": (f"<div class=post><h2>Title</h2><p>{PROSE}<p><b>{PROSE}<br>next &amp; last<p>Short.<ul><li>one<li>two</ul></div><div>All rights reserved</div>", ["Title", PROSE, f"{PROSE} next & last", "Short.", "one", "two"]),
    "unnamed menu": (f"<body><div><a href=1>Menu</a> <a href=2>More</a></div><div><p>{PROSE}</p><p>Short.</p></div><div>Imprint</div></body>", [PROSE, "Short."]),
    "parts": (f"<header><h1>Site</h1></header><nav>a</nav><main><article><header><h1>Title</h1><p>By X</p></header><p>{PROSE}</p><form>mail</form><aside>side</aside><section class='reader-comments'><p>{PROSE}</p></section></article></main><footer>{PROSE}</footer>", ["Title", PROSE]),
    "classes": (f"<div class='cookie-notice'>{PROSE}</div><div id=content><p>{PROSE}</p></div><div id='rightSidebar'><p>{PROSE}</p></div><div role=navigation>{PROSE}</div><div class='ad'>{PROSE}</div>", [PROSE]),
    "all in a form": (f"<form id=f><article><p>{PROSE}</p></article></form>", [PROSE]),
    "script": (f"<script>var t='</p><p>{PROSE}';</script><article><p title='a>b'>{PROSE}</p></article><style>p{{}}</style><!-- <p>no</p> -->", [PROSE]),
    "references": ("<article><p>a&nbsp;&#98;&amp;lt;\n\t c&copy</p></article>", ["a b&lt; c©"]),
    "open tags": (f"<article><p>{PROSE}<script>never closed", [PROSE]),
    "plain": ("no tag at all", ["no tag at all"]),
    "broken": ("<article><p>1 < 2 <3 and <a title=\"x>y</p></article>", None),
    "empty": ("", []),
    "blank": ("<article> \n</article>", []),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_page(name):
    page, want = PAGES[name]
    got = html_text.main_text(page)
    assert want is None or got == "\n\n".join(want)


def test_extract_edges(spark):
    rows = [(1, None), (2, ""), (3, f"<p>{PROSE}"), (3, f"<p>{PROSE}"), (None, "<p>x</p>"), (4, "<div>" * 3000 + "deep" + "</div>" * 3000), (5, "<article>" + f"<p>{PROSE}</p>" * 20000 + "</article>")]
    frame = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "'old' AS text", "1 AS n_chars")
    got = [(r["page_id"], len(r["text"])) for r in html_text.extract_text(frame).collect()]
    assert sorted(got, key=str) == sorted([(1, 0), (2, 0), (3, len(PROSE)), (3, len(PROSE)), (None, 1), (4, 4), (5, 20000 * (len(PROSE) + 2) - 2)], key=str)
    assert html_text.extract_text(frame.where("page_id = 9")).count() == 0
