"""SimHash, near-dedup, PII, HTML, language id, toxicity and the pipeline on small fixtures."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from recscan.llm import components, html_extract, language_id, pii, queries, shared, simhash, toxicity
from tests.llm.test_native_ops import targets

DOC = "doc_id long, text string, lang string, source string, n_chars long"
ROOT = Path(__file__).resolve().parents[2]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOC)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def grams(t, k):
    w = WORD.findall(lower(t))
    return [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []


def components_of(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return [find(x) for x in range(n)]


def story(rng, n=120):
    return " ".join(rng.choice(string) for string in [[f"w{i}" for i in range(500)]] * n)


def bend(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(999)}"
    return " ".join(w)


# ---- SimHash ------------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [simhash.HOT, 3])
def test_simhash_components_against_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash.trie_links, "__defaults__", (64, 3, None, hot, 1))
    rng = random.Random(1)
    base = [story(rng) for _ in range(8)]
    texts = [None, "", " \n", "one", "One", "one two", "Ünï ß İ", *base, *(bend(rng, b, n) for b in base for n in (1, 1, 2, 3)), *[base[0]] * 12, "x y z " * 3000]
    got = {r["doc_id"]: r for r in simhash.simhash_components(docs(spark, texts).withColumnRenamed("lang", "fp")).collect()}
    fps = []
    for t in texts:
        hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams(t, 3)]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0)
    comp = components_of(len(texts), [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if (fps[a] ^ fps[b]).bit_count() <= 3])
    for i in range(len(texts)):
        assert got[i]["fingerprint"] == f"{fps[i]:016x}" and got[i]["component_id"] == comp[i], texts[i]


def test_walk_finds_all_pairs_whatever_the_head_and_stride(monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 50)
    rng = np.random.default_rng(2)
    near = rng.integers(0, 2**20, 60, dtype=np.uint64)
    keys = np.unique(np.concatenate([near, near ^ np.uint64(5), near ^ (np.uint64(1) << rng.integers(0, 20, 60, dtype=np.uint64))]))
    for head, stride, budget in ((0, 4, 3), (5, 3, 2), (0, 1, 4), (8, 7, 0)):
        got = Counter((int(a), int(b)) for i, j in simhash.walk_trie(keys, 20, head, budget, stride) for a, b in zip(i, j))
        want = {(a, b) for a in range(len(keys)) for b in range(a, len(keys)) if int(keys[a] ^ keys[b]).bit_count() <= budget and keys[a] >> np.uint64(20 - head) == keys[b] >> np.uint64(20 - head)}
        assert set(got) == want and set(got.values()) == {1}


def test_rows_of_leaves_are_all_pairs_once(monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 7)
    count = np.array([3, 1, 4])
    at = np.cumsum(count) - count
    i, j = np.array([0, 1, 2, 0, 1]), np.array([0, 1, 2, 2, 2])
    got = Counter((int(a), int(b)) for x, y in simhash._rows_of(i, j, at, count) for a, b in zip(x, y))
    leaf = [0, 0, 0, 1, 2, 2, 2, 2]
    want = {(a, b) for a, b in itertools.combinations(range(8), 2) if (leaf[a], leaf[b]) in set(zip(i.tolist(), j.tolist()))}
    assert set(got) == want and set(got.values()) == {1}


def test_rotation_moves_a_block_to_the_front():
    x = np.array([0x0123456789ABCDEF], np.uint64)
    assert hex(int(simhash._rotated(x, 64, 16, 16)[0])) == "0x4567012389abcdef"
    assert hex(int(simhash._rotated(x, 64, 0, 16)[0])) == "0x123456789abcdef"
    assert hex(int(simhash._rotated(x, 64, 48, 16)[0])) == "0xcdef0123456789ab"


def test_forest_connects_with_the_lightest_links():
    f = simhash.Forest(5)
    f.add(np.array([0, 1, 0]), np.array([1, 2, 2]), np.array([5, 1, 2]))
    f.add(np.array([3, 0]), np.array([2, 1]), np.array([9, 0]))
    assert sorted(zip(f.a.tolist(), f.b.tolist(), f.w.tolist())) == [(0, 1, 0), (1, 2, 1), (3, 2, 9)]


def test_near_dedup_against_brute_force(spark):
    rng = random.Random(3)
    base = [story(rng, 200) for _ in range(30)]
    texts = [None, "", "  ", "short one", "SHORT one", *base, *(bend(rng, b, n) for b in base for n in (1, 2, 3)), *(story(rng) for _ in range(30)), "lorem " * 5000]
    rng.shuffle(texts)
    sets = [set(grams(t, 5)) for t in texts]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    comp = components_of(len(texts), pairs)
    d = docs(spark, texts).withColumnRenamed("lang", "_row")
    got = simhash.near_dedup(d)
    kept = {r["doc_id"] for r in got.collect()}
    want = {i for i, c in enumerate(comp) if i == c}
    assert got.columns == d.columns and not want - kept
    assert len(kept - want) <= 0.02 * len(pairs)
    assert simhash.near_dedup(d.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [simhash.HOT // 4, 20])
def test_near_dedup_verifies_all_candidates_of_a_template(spark, hot, monkeypatch):
    monkeypatch.setattr(simhash.open_links, "__defaults__", (hot,))
    rng = random.Random(11)
    template = story(rng, 400).split(" ")
    fill = lambda n: [f"own{rng.randrange(10**9)}" for _ in range(n)]
    # 343 of 400 words shared: similarity 0.74; the two of a planted pair share 20 words more: 0.82
    texts = [" ".join(template[:343] + fill(57)) for _ in range(240)]
    for _ in range(40):
        own = fill(20)
        texts += [" ".join(template[:343] + own + fill(37)) for _ in range(2)]
    rng.shuffle(texts)
    sets = [set(grams(t, 5)) for t in texts]
    fps = [int.from_bytes(simhash.fingerprint(np.array([xxhash.xxh64_intdigest(g.encode(), 42) for g in grams(t, 5)], np.uint64), 4).astype(">u8").tobytes()) for t in texts]
    parts = [[f >> 32 * i & 0xFFFFFFFF for i in range(8)] for f in fps]
    similar = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    asked = lambda a, b: ((fps[a] ^ fps[b]) >> 128).bit_count() <= simhash.CHECK_WITHIN and any((x ^ y).bit_count() <= 3 for x, y in zip(parts[a], parts[b]))
    found = [p for p in similar if asked(*p)]
    assert len(similar) == 40 and len(found) >= 34
    comp = components_of(len(texts), found)
    assert {r["doc_id"] for r in simhash.near_dedup(docs(spark, texts)).collect()} == {i for i, c in enumerate(comp) if i == c}


def test_near_dedup_does_not_depend_on_repeats(spark):
    rng = random.Random(12)
    texts = []
    for i in range(40):
        body, line = story(rng, 290), " ".join(f"r{i}x{j}" for j in range(10))
        texts += [" ".join([body, *[line] * n]) for n in (2, 30)]
    assert all(set(grams(a, 5)) == set(grams(b, 5)) for a, b in zip(texts[::2], texts[1::2]))
    texts += [t + f" end{i}" for i, t in enumerate(texts[:20])]
    assert {r["doc_id"] for r in simhash.near_dedup(docs(spark, texts)).collect()} == set(range(0, 80, 2))


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (201, 200), (300, 300), (None, 3)]
    e = spark.createDataFrame(pairs, "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(e).collect()}
    assert got == dict.fromkeys([*range(41), 100], 0) | {200: 200, 201: 200}
    assert components.connected_components(e.limit(0)).count() == 0


# ---- PII ----------------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(t):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, t or ""):
            s = m.group()
            d = re.sub("[^0-9]", "", s)
            ok = kind == "email" or kind == "phone" and 9 <= len(d) <= 15
            if kind == "ip":
                ok = all(int(x) <= 255 for x in s.split("."))
            if kind == "card":
                ok = 13 <= len(d) <= 19 and sum(int(x) if i % 2 == 0 else sum(map(int, str(2 * int(x)))) for i, x in enumerate(reversed(d))) % 10 == 0
            out += [(kind, *m.span())] if ok else []
    return out


def test_pii_equals_plain_patterns(spark):
    rng = random.Random(4)
    bits = ["a@b.c", "a@b.c@d.e", "@x.y", "a@b", "é@a.b", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.2.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485", "+1", "+12345678901234567", "-", " ", ".", "7", "%", "🙂", "+", "\n", "٣", "GB82 WEST 1234 5698 7654 32"]
    texts = [None, "", *("".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(1500)), "a" * 50_000, "1" * 50_000, "1." * 20_000, "+1" + "(" * 20_000, "@" * 20_000, "a@" * 20_000]
    got = {r["doc_id"]: r for r in pii.pii_spans(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t) if len(t or "") < 1000 else [s[:3] for s in pii.find_pii(t) if s[0] in pii.BASE]
        assert [tuple(s)[:3] for s in got[i]["pii"] if s["kind"] in pii.BASE] == want, t
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and got[i]["spans"].startswith(joined)


def test_checksums_and_context():
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB83WEST12345698765432")
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert [s[0] for s in pii.find_pii("my phone: (988) 555-2485")] == ["phone_local"] and not pii.find_pii("part (988) 555-2485")
    (card,), (beside,) = pii.find_pii("4111111111111111"), pii.find_pii("visa 4111111111111111")
    assert beside[3] > card[3]
    for text, found in (("IBAN GB82 WEST 1234 5698 7654 32.", "GB82 WEST 1234 5698 7654 32"), ("IBAN GB82 WEST 1234 5698 7654 32 IS MY IBAN", "GB82 WEST 1234 5698 7654 32"),
                        ("IBAN GB82WEST12345698765432 OK", "GB82WEST12345698765432"), ("XGB82WEST12345698765432", None), ("GB82WEST123456987654321", None), ("ZZ82WEST12345698765432", None)):
        assert [text[s[1] : s[2]] for s in pii.find_pii(text) if s[0] == "iban"] == ([found] if found else [])


def test_pii_of_no_rows_repeats_and_nulls(spark):
    d = spark.createDataFrame([(None, "a@b.c", 1), (1, None, 2), (2, "a@b.c", 3), (2, "a@b.c", 3)], "doc_id long, text string, spans int")
    got = pii.pii_spans(d)
    assert got.columns == ["doc_id", "pii", "base_sha256", "spans"] and [(r["doc_id"], r["spans"]) for r in got.collect()] == [(None, "email:0:5"), (1, ""), (2, "email:0:5"), (2, "email:0:5")]
    assert pii.pii_spans(d.limit(0)).count() == 0


# ---- HTML ---------------------------------------------------------------------------------


def test_min_cut_is_minimal():
    rng = random.Random(5)
    for _ in range(800):
        n = rng.randint(1, 7)
        u = [rng.randint(-8, 8) for _ in range(n)]
        e = {p: rng.randint(1, 5) for p in itertools.combinations(range(n), 2) if rng.random() < 0.5}
        cost = lambda x: sum(abs(a) for a, k in zip(u, x) if (a > 0) != bool(k)) + sum(w for (i, j), w in e.items() if x[i] != x[j])  # noqa: B023, E731
        assert cost(html_extract.min_cut(u, e)) == min(map(cost, itertools.product((0, 1), repeat=n)))


LONG = "It was a long and quiet evening, and nobody in the old house had said a word since the lamps were lit."
PAGES = [
    (f'<html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></ul></nav><article><h1>A &amp; B</h1><p>{LONG}<p>Two\n  lines&nbsp;x<br>y<div class="ad">Buy!</div><section id="comments"><p>{LONG}</p></section></article><footer>&copy; me</footer>', f"A & B\n{LONG}\nTwo lines x y"),
    (f'<body><div class="header">Top</div><div class="cookie-notice">We use cookies on this site and ask you to agree.</div><div class="content"><p>{LONG}</p><p>{LONG}</p><form>Name <input></form></div><div class="sidebar"><p>Links</div>', f"{LONG}\n{LONG}"),
    (f"<p>{LONG}</p><ul><li><a href=x>One</a></li><li><a href=y>Two</a></li></ul>", LONG),
    (f'<main class="content has-sidebar"><p>{LONG}</p><p>{LONG}</p></main><div class="sidebar"><p>{LONG}</p></div>', f"{LONG}\n{LONG}"),
    (f'<article><div class="entry-header"><h1>A title</h1></div><p>{LONG}</p></article>', f"A title\n{LONG}"),
    (f'<article><header><h1>A title</h1><p>By me</p></header><p>{LONG}</p><p>Short.</p></article>', f"A title\nBy me\n{LONG}\nShort."),
    (f'<article class="post"><p>{LONG}</p><div class="post-comments"><p>{LONG}</p><p>{LONG}</p></div></article>', LONG),
    (f'<article><p>{LONG}</p><aside><p>{LONG}</p></aside><ul><li>one</li><li><a href="x">two</a></li></ul></article>', f"{LONG}\none\ntwo"),
    (f"<div><p>{LONG}</p><p>Yes.</p><p>{LONG}</p></div>", f"{LONG}\nYes.\n{LONG}"),
    ("", ""), (None, ""), ("<article>just text &am", "just text &am"), ("<article><p>cut <b", "cut"), ("<nav>only menu</nav>", ""), ("<!-- <article>x</article> -->", ""),
]


@pytest.mark.parametrize("page, want", PAGES)
def test_main_text(page, want):
    assert html_extract.main_text(page) == want


@pytest.mark.parametrize(
    "attrs, shown",
    [('style="overflow:hidden"', True), ('title="A hidden gem"', True), ('aria-hidden="false"', True), ("data-x=hidden", True), ('title="class=footer"', True), ('style="x-display:none"', True),
     ("hidden", False), ('HIDDEN=""', False), ("class=x hidden", False), ("aria-hidden=true", False), ('aria-hidden = "TRUE"', False), ('style="color:red; display : none"', False), ("class='footer'", False)],
)
def test_only_attributes_hide(attrs, shown):
    assert html_extract.main_text(f"<p>{LONG}</p><div {attrs}><p>{LONG} More.</p></div>") == (f"{LONG}\n{LONG} More." if shown else LONG)


def test_articles_come_out_whole(spark, sf):
    pages = queries.table(spark, sf, "pages")
    got = {r["page_id"]: r for r in queries.op4_html(spark, sf).collect()}
    import html as H

    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = (" ".join(H.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split("</?(?:p|h1)>", inner))
        want = "\n".join(p for p in parts if p)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want) and got[r["page_id"]]["url"] == r["url"]


OTHER = "The second half of the day went by in the garden, where the children built a small boat out of old boards."
LISTED = "".join(f"<li><a href=x{i}>Link number {i}</a></li>" for i in range(6))
KEPT = [
    (f'<body class="single search-enabled"><p>{LONG}</p><p>{OTHER}</p>', f"{LONG}\n{OTHER}"),
    (f'<form id="aspnetForm"><div><p>{LONG}</p><p>{OTHER}</p></div></form>', f"{LONG}\n{OTHER}"),
    (f'<div class="social-issues story"><p>{LONG}</p><p>{OTHER}</p></div>', f"{LONG}\n{OTHER}"),
    (f'<article><p>{LONG}</p><section class="notice-of-meeting"><p>{OTHER}</p></section></article>', f"{LONG}\n{OTHER}"),
    (f'<article><p>{LONG}</p><p class="share-price">{OTHER}</p></article>', f"{LONG}\n{OTHER}"),
    (f"<article><p title=don't>{LONG}</p><p>It's {OTHER}</p></article>", f"{LONG}\nIt's {OTHER}"),
    (f'<article><p>{LONG}</p><section class="responses"><div class="reply"><p>{OTHER}</p></div></section></article>', LONG),
    (f'<div class="search-page"><article><p>{LONG}</p><p>{OTHER}</p></article></div>', f"{LONG}\n{OTHER}"),
    (f'<article><p>{LONG}</p></article><section id="comments"><article><p>{OTHER}</p></article></section>', LONG),
    (f'<article><p>{LONG}</p></article><aside class="related"><article><p>{OTHER}</p></article></aside>', LONG),
    (f'<article><p>{LONG}</p><p>{OTHER}<div class="ad">{OTHER}</div><p>{LONG}</p></article>', f"{LONG}\n{OTHER}\n{LONG}"),
]


@pytest.mark.parametrize("page, want", KEPT)
def test_names_have_no_veto(page, want):
    assert html_extract.main_text(page) == want


def plain_pages():
    """Pages whose names say nothing: a list of links, an article with a short line and headings, a closing list."""
    rng = random.Random(8)
    pages = []
    for k in range(40):
        body = [rng.choice([f"<p>{LONG}</p>", f"<p>{OTHER}</p>", f"<p>{OTHER} {LONG}</p>", "<p>Yes, it was.</p>", "<h2>Part two</h2>", "<p>Perhaps</p>"]) for _ in range(rng.randint(4, 12))]
        pages.append(f'<div class="x{k}"><ul class="q">{LISTED}</ul></div><div class="z"><h1>A day in May</h1><p>{LONG}</p>{"".join(body)}<p>{OTHER}</p></div><div class="y"><p>Call us</p><ul>{LISTED}</ul></div>')
    return pages


def test_odds_and_edges_each_decide_pages_whose_names_say_nothing(monkeypatch):
    odds = html_extract.cell_odds(html_extract.PRIOR)
    right = no_odds = no_edges = 0
    for page in plain_pages():
        found = html_extract.blocks(page)
        assert not any(b.says or b.inside for b in found)
        unary, edges = html_extract.capacities(found, odds)
        keep = html_extract.min_cut(unary, edges)
        right += [b.text for b, k in zip(found, keep) if k] == [b.text for b in found[6:-7]]
        no_odds += html_extract.min_cut([0] * len(unary), edges) != keep
        no_edges += html_extract.min_cut(unary, {}) != keep
    assert no_odds > 30 and no_edges > 30 and right > 30


@pytest.mark.parametrize("piece", ["<b ", '<a "', "<a ='", '<p x="', "<script '", '<div class="a', "<!-- ", "</", "<", "<svg ", "<p a=b'", "='<x"])
def test_odd_pages_stay_fast(piece):
    import time

    began = time.time()
    html_extract.main_text(piece * (1_000_000 // len(piece)))
    assert time.time() - began < 5


def test_executors_need_no_copy_of_the_package(tmp_path):
    """Workers unpickle what they run; nothing of it may be looked up in the package."""
    import os
    import subprocess
    import sys

    script = f"""
import os, sys
sys.path.insert(0, {str(ROOT)!r})
os.environ.pop('PYTHONPATH', None)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local-cluster[1,1,1024]').config('spark.ui.enabled', 'false').config('spark.executor.memory', '600m').config('spark.checkpoint.dir', 'file://{tmp_path}/s').config('spark.driver.host', '127.0.0.1').getOrCreate()
from recscan.llm import html_extract, periodic_runs, pii, prefix_trie
pages = spark.createDataFrame([(1, 'u', '<article><p>{LONG}</p><nav class="nav">x</nav></article>')], 'page_id long, url string, html string')
print(html_extract.extract_pages(pages).first()['n_chars'], periodic_runs.periodic_runs(pages, 'html', 'page_id').count(), pii.pii_spans(pages, 'html', 'page_id').count())
turns = spark.createDataFrame([(1, 1, 'user', 'x')], 'conv_id long, turn long, role string, text string')
print(prefix_trie.prefix_trie(prefix_trie.turn_rows(turns), turns.select('conv_id')).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_SCALA_VERSION": "2.13", "PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, cwd=tmp_path, env=env, timeout=600)
    assert done.stdout.split() == [str(len(LONG)), "1", "1", "2"], done.stderr[-3000:]


def test_classifier_is_fitted_to_marked_pages_only(spark):
    page = "<article>" + f"<p>{LONG}</p>" * 9 + "</article><nav>" + "<li><a href=x>Link</a></li>" * 9 + "</nav>"
    make = lambda rows: spark.createDataFrame(rows, "page_id long, url string, html string, cell long")
    w = html_extract.fit_blocks(make([(i, None, page, 1) for i in range(20)] + [(None, None, page, 1), (90, None, None, 1)]))
    odds = html_extract.cell_odds(w)
    by_text = {b.tag: odds[html_extract.cell(b)] for b in html_extract.blocks(page)}
    assert by_text["p"] > 0 > by_text["li"]
    for rows in ([], [(1, None, f"<div>{LONG}</div>", 1)], [(None, None, page, 1)]):
        assert (html_extract.fit_blocks(make(rows)) == html_extract.PRIOR).all()


def test_pages_with_nulls_repeats_and_no_rows(spark):
    rows = [(1, "u", f"<article><p>{LONG}"), (1, "u", f"<article><p>{LONG}"), (None, None, None), (2, None, "")]
    pages = spark.createDataFrame([(*r, "x", 7) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = [tuple(r) for r in html_extract.extract_pages(pages).collect()]
    assert got == [(1, "u", LONG, len(LONG))] * 2 + [(None, None, "", 0), (2, None, "", 0)]
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


def test_long_pages_stay_fast():
    page = "<article>" + "<p>some words here</p>" * 20_000 + "<div>" * 3000 + "x"
    assert html_extract.main_text(page).count("\n") == 20_000
    assert html_extract.main_text("<div><p>a b c d</p><ul><li>x</li></ul>" * 10_000) is not None
    assert html_extract.main_text("<article>" + "<p>w</p><div><a href=x>y z</a></div>" * 20_000).count("\n") == 39_999


# ---- learned operators --------------------------------------------------------------------


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_language_accuracy_on_held_out_rows(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    truth = {r["doc_id"]: r["lang"] for r in queries.table(spark, sf, "documents").select("doc_id", "lang").collect()}
    got = queries.op1_language_id(spark, sf).collect()
    assert len(got) == len(truth) and all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in got)
    right = [r["lang_pred"] == truth[r["doc_id"]] for r in got if r["held_out"]]
    assert sum(right) / len(right) >= 0.98


def test_language_edge_cases(spark):
    d = spark.createDataFrame([(i, "the old house and the sea" if i % 2 else "das alte haus und das meer", "en" if i % 2 else "de", None, None) for i in range(40)], DOC)
    m = language_id.train(d)
    odd = docs(spark, [None, "", "123 !!", "²", "the sea", "das meer", "x" * 30_000])
    got = {r["doc_id"]: r for r in language_id.identify(odd, m).collect()}
    assert [got[i]["lang_pred"] for i in range(6)] == ["und"] * 4 + ["en", "de"] and got[6]["lang_pred"] in ("en", "de")
    assert language_id.predict(language_id.train(d.limit(0)), "the sea") == ("und", 0.0)
    assert language_id.train(d.withColumn("lang", F.lit("xx"))).families == {"xx": ["xx"]}


def test_families_of_codes(spark):
    codes = ["en", "EN-us", "pt_BR", "xx", "xx-YY", ""]
    got = spark.createDataFrame([(c,) for c in codes], "lang string").select("lang", language_id.family_col("lang")).collect()
    assert [r[1] for r in got] == [language_id.family(c) for c in codes] == ["germanic", "germanic", "romance", "xx", "xx-YY", ""]


def test_profile_is_a_unit_vector():
    x = language_id.profile("Hello, wörld 42")
    assert np.linalg.norm(x) == pytest.approx(1) and language_id.profile("42") is None


def test_toxicity_on_held_out_rows(spark, sf):
    sf = sf.replace("sf0.001", "sf0.1")  # the insults of some languages are too rare in smaller data to be learned
    truth = {r["doc_id"]: r["toxic"] for r in queries.table(spark, sf, "labels").collect()}
    got = queries.op7_toxicity(spark, sf).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == held(r["doc_id"]) for r in got)
    out = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    caught = sum(truth[r["doc_id"]] for r in out if r["predicted"])
    recall, precision = caught / sum(truth[r["doc_id"]] for r in out), caught / sum(r["predicted"] for r in out)
    assert recall >= 0.9 and precision >= 0.9, (recall, precision)


LEXICON = toxicity.Lexicon({"moron": 1.0, "glorp*": 1.0, "piece of junk": 0.8})


@pytest.mark.parametrize(
    "text, contexts",
    [("a moron.", [0]), ("you moron", [1]), ("moron, you", [1]), ("a moron who sees that nobody at all likes you", [0]), ("not a moron", [2]), ("never you moron", [3]),
     ("not at all as it was a moron", [0]), ("she said moron", [4]), ("she said: you are a moron", [5]), ("she said it. moron", [0]), ("glorpify it", [0]), ("glorp", []),
     ("what a piece of junk", [0]), ("piece of junk you are", [1]), ("piece of cake", []), ("i will kill you", [8]), ("kill time", []), ("you kill me", []),
     ("he killed her and threatens to shoot you", []), ("we killed time and we shoot you", [8]), ("ich werde dich töten", [8]), ("we are going to find you", [8]), ("we will find out", []), ("you will find it", []),
     ("i won't hurt you", [10]), ("he said i will kill you", [12]), ("moron i will kill you", [1, 8]), (None, []), ("clean words", [])],
)
def test_grammar_contexts(text, contexts):
    assert np.flatnonzero(LEXICON.features(text)[: toxicity.CONTEXTS]).tolist() == contexts


def test_each_transducer_changes_a_score():
    model = toxicity.Model({}, toxicity.PRIOR, toxicity.BIAS)
    score = lambda *texts: toxicity.scores(LEXICON, model, list(texts)).tolist()
    clean, insult, aimed, negated, reported, threat, intended = score("fine", "a moron", "you moron", "not you moron", "he said you moron", "kill you", "i will kill you")
    assert clean < negated < insult < aimed and reported < aimed and clean < threat < intended and insult > 0.2


def test_best_path_of_the_cascade_against_all_paths():
    rng = random.Random(13)
    parts = LEXICON.machine.parts

    def written(part, tape):
        """All tapes that one transducer alone writes for a tape, with their weights."""
        front = [((), part.start, 0.0)]
        for x in tape:
            front = [((*out, z), t, w + v) for out, s, w in front for z, t, v in part.arcs(s, x)]
        return [(out, w) for out, s, w in front if part.accepts(s)]

    words = "moron piece of junk kill find will you dich not said a".split()
    for _ in range(300):
        tape = [LEXICON.symbol(rng.choice(words)) for _ in range(rng.randint(0, 7))]
        tapes = [(tuple(tape), 0.0)]
        for part in parts:
            tapes = [(out, w + v) for y, w in tapes for out, v in written(part, y)]
        weight, hits = LEXICON.machine.best(tape)
        assert weight == pytest.approx(max(w for _, w in tapes)) and sum(w for _, w in hits) == pytest.approx(weight)


def test_contexts_decide_where_words_do_not():
    rng = random.Random(14)
    say = lambda forms: f"{rng.choice(forms)} {rng.choice('lake house tree'.split())}"
    rows = [(say(["you moron", "you are a moron", "moron by the"]), 1) for _ in range(120)]
    rows += [(say(["not a moron near the", "never a moron or", "he said moron to the", "she wrote moron on the"]), 0) for _ in range(240)]
    rng.shuffle(rows)
    x, y = np.array([LEXICON.features(t) for t, _ in rows]), np.array([k for _, k in rows], float)
    merged = x.copy()
    merged[:, : toxicity.CONTEXTS] = 0
    merged[:, 0] = x[:, : toxicity.CONTEXTS].sum(axis=1)
    merged[:, -1] = merged[:, 0]
    right = []
    for z in (x, merged):
        w, b = toxicity.fit_contexts(z[:200], y[:200])
        right.append((((z[200:] @ w + b) > 0) == y[200:]).mean())
    assert right[0] == 1.0 and right[1] < 0.8


def test_words_beginnings_and_phrases_are_learned(spark):
    rng = random.Random(15)
    fill = lambda n: " ".join(rng.choice([f"w{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9)]) for _ in range(n))
    bad = lambda i: ["blargh", f"snork{'abcde'[i % 5]}x", "bag of salt"][i % 3]
    rows = [(i, f"{fill(20)} {bad(i)} {fill(9)}" if i % 4 == 0 else f"{fill(10)} {rng.choice(['bag', 'of', 'salt', 'of salt'])} {fill(20)}") for i in range(900)]
    d = spark.createDataFrame([(i, t, None, None, 1) for i, t in rows], DOC)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    model = toxicity.train(d, labels)
    assert "blargh" in model.patterns and "bag of salt" in model.patterns and any(p.startswith("snork") and p.endswith("*") for p in model.patterns)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(d, model).collect()}
    assert all(got[i] == int(i % 4 == 0) for i, _ in rows if held(i))


CIVIL = [
    "I will get you coffee", "You will find your keys", "We will beat your record", "I'll shoot you an email", "The process kills you with logs", "we kill time and you win", "We will beat your deadline.",
    "I will catch you up later on the plan", "We'll hunt for you a better price", "You can break the code into parts", "they said they will find you a room", "I'm going to beat you to the door", "Do not burn your bridges",
    "Ich werde dich finden lassen und dir helfen", "Je vais vous trouver une place", "Voy a encontrar tu libro", "If you want, I will come and get your bags", "He will kill the lights before you sleep",
]
THREATS = [
    "I will kill you", "we are going to find you", "I'm gonna hurt you.", "We will destroy all of you", "I will hunt you", "kill yourself", "Ich werde dich töten", "je vais te tuer", "Voy a matarte", "I'll find you soon", "I want to strangle you with my hands",
]


def test_idioms_are_civil_and_threats_are_not():
    lexicon, model = toxicity.Lexicon({}), toxicity.Model({}, toxicity.PRIOR, toxicity.BIAS)
    score = lambda t: float(toxicity.scores(lexicon, model, [t])[0])
    assert {t: round(score(t), 2) for t in CIVIL if score(t) >= 0.3} == {}
    assert {t: round(score(t), 2) for t in THREATS if score(t) < 0.3} == {}
    assert score(". ".join(CIVIL * 60)) < 0.3 and score(CIVIL[6] * 20) < 0.3 and len(" ".join(CIVIL * 60).split()) > 5000


def test_idioms_stay_civil_with_a_trained_model(spark, sf):
    model = toxicity.train(queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels"))
    lexicon = toxicity.Lexicon(model.patterns)
    civil, threats = (toxicity.scores(lexicon, model, x) for x in (CIVIL + [". ".join(CIVIL * 60)], THREATS))
    assert civil.max() < 0.3 <= threats.min()


def test_toxicity_without_labels(spark):
    d = docs(spark, ["x", None])
    m = toxicity.train(d, spark.createDataFrame([(0, 1, 0), (None, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int"))
    assert not m.patterns and [r["predicted"] for r in toxicity.score_toxicity(d, m).collect()] == [0, 0]
    assert toxicity.keep_civil(d, m).count() == 2 and toxicity.score_toxicity(d.limit(0), m).count() == 0
    odd = spark.createDataFrame([(None, "i will kill you", 1.0), (None, None, 2.0), (3, "", None), (3, "", None)], "doc_id long, text string, score double")
    assert [tuple(r) for r in toxicity.keep_civil(odd, m).collect()] == [(None, None, 2.0), (3, "", None), (3, "", None)]


# ---- pipeline -----------------------------------------------------------------------------


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_pipeline_against_brute_force(spark, sf):
    """Every stage on what the one before kept: copies, similar texts, leaks and targets, each found again by plain code."""
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "decontaminate", "mixing"]
    steps, d = [], queries.table(spark, sf, "documents")
    columns = d.columns
    for name in names:
        steps.append({r["doc_id"]: r for r in d.collect()})
        d = shared.materialize(stage(name)(spark, d, sf), name)
        assert d.columns == columns + ["copy"] * (name == "mixing")
    rows = d.collect()
    civil, unique, apart, clean = steps[1:]
    model = toxicity.train(queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels"))
    ids = sorted(steps[0])
    judged = toxicity.scores(toxicity.Lexicon(model.patterns), model, [steps[0][i]["text"] for i in ids])
    assert set(civil) == {i for i, p in zip(ids, judged) if p < 0.3}
    groups = defaultdict(list)
    for i, r in civil.items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")].append((-len(r["text"] or ""), i))
    assert set(unique) == {min(g)[1] for g in groups.values()}
    order = sorted(unique)
    sets = {i: set(grams(unique[i]["text"], 5)) for i in order}
    links = [(a, b) for a, b in itertools.combinations(order, 2) if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    comp = components_of(len(order), [(order.index(a), order.index(b)) for a, b in links])
    want = {i for k, i in enumerate(order) if comp[k] == k}
    assert not want - set(apart) and len(set(apart) - want) <= 0.05 * len(links)
    items = [grams(r["text"], 5) for r in queries.table(spark, sf, "benchmark").collect()]
    leaks = set()
    for i, r in apart.items():
        text = grams(r["text"], 5)
        for item in items:
            known = set(item)
            if len(text) >= len(item) and sum(g in known for g in text) >= 0.8 * len(item):
                for s in range(len(text) - len(item) + 1):
                    n = sum((Counter(text[s : s + len(item)]) & Counter(item)).values())
                    if n / (2 * len(item) - n) >= 0.8:
                        leaks.add(i)
                        break
    assert leaks and not set(clean) & leaks and set(clean) | leaks == set(apart)
    taken, size = Counter(r["doc_id"] for r in rows), {i: len(WORD.findall(r["text"] or "")) for i, r in clean.items()}
    assert set(taken) <= set(clean) and max(taken.values()) <= 2
    sums, got = Counter(), Counter()
    for i, r in clean.items():
        sums[r["source"]] += size[i]
        got[r["source"]] += size[i] * taken[i]
    for source, target in targets(sums).items():
        assert abs(got[source] - target) <= max(size.values())
    copies = defaultdict(list)
    for r in rows:
        assert r["text"] == clean[r["doc_id"]]["text"]
        copies[r["doc_id"]].append(r["copy"])
    assert all(sorted(c) == list(range(len(c))) for c in copies.values())


def test_pipeline_stages_take_odd_tables(spark, sf):
    odd = [(None, None, None, None, None, "x"), (None, "", None, None, 0, "x"), (3, "some words here", "en", None, 15, "y"), (3, "some words here", "en", None, 15, "y"), (4, "x " * 30_000, "en", "s", 60_000, None)]
    d = spark.createDataFrame(odd, DOC + ", _row string").repartition(2)
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, d, sf)
        assert out.columns == d.columns + ["copy"] * (name == "mixing")
        n = out.count()
        assert n == {"toxicity": 5, "exact_dedup": 3, "near_dedup": 4, "decontaminate": 5}.get(name, n)
        assert function(spark, d.limit(0), sf).count() == 0


def test_near_dedup_recall_on_the_tables(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, sf, "documents").dropDuplicates(["text"]).collect()}
    sets = {i: frozenset(grams(t, 5)) for i, t in texts.items()}
    # the same sets are one node; pairs are found by their rarest shingles
    by_set = {}
    for i in sorted(sets):
        by_set.setdefault(sets[i], i)
    count = Counter(g for x in by_set for g in x)
    holders = defaultdict(list)
    pairs = set()
    for x, i in by_set.items():
        few = sorted(x, key=lambda g: (count[g], g))[: len(x) - int(np.ceil(0.8 * len(x))) + 1]
        for g in few:
            pairs.update((j, i) for j in holders[g])
            holders[g].append(i)
    links = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    order = sorted(by_set.values())
    at = {i: k for k, i in enumerate(order)}
    kept = {r["doc_id"] for r in simhash.near_dedup(queries.table(spark, sf, "documents").filter(F.col("doc_id").isin(order))).collect()}
    comp = components_of(len(order), [(at[a], at[b]) for a, b in links])
    gone = {i for k, i in enumerate(order) if comp[k] != k}
    empty = {i for i in order if not sets[i]}
    assert len(gone) > 0 and len(gone - kept) >= 0.95 * len(gone) and not (set(order) - gone - empty) - kept
