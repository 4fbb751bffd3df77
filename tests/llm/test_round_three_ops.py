"""Prefix trie, URL filter and periodic runs on small fixtures, against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from recscan.llm import periodic_runs, prefix_trie, queries, shared, url_filter

TURN = "conv_id long, turn long, role string, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def crc(n):
    return zlib.crc32(str(n).encode())


# ---- prefix trie --------------------------------------------------------------------------


def sequences(rows):
    """conv_id to its turns in order."""
    out = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            out[c].append(((t is not None, t or 0), role or "", text or ""))
    return {c: [x[1:] for x in sorted(v)] for c, v in out.items()}


def rebuilt(seqs):
    out = {}
    for c, own in seqs.items():
        h = crc(c) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = seqs.get(base, [])[:h] + own[h:]
    return out


def brute_trie(seqs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
        ends[tuple(s)].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1]) if node else 0
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), kids[n], leaves[n], saved[n], sha(",".join(map(str, sorted(ends[n]))))) for n, m in members.items()
    )


def trie_rows(df):
    return sorted(tuple(r) for r in df.collect())


def odd_turns(seed, convs=150, deep=0):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-3, 5), *rng.sample(range(5, 900), convs - 8)]:
        for t in range(rng.randint(1, 9)):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "", None, "b b", "é🙂"])))
    for c in range(1000, 1000 + deep):  # long ones that part late
        rows += [(c, t, "user", f"turn {t}" if t < 40 else f"{rng.random()}") for t in range(rng.randint(30, 45))]
    rows += rows[:20] + [(None, 1, "user", "x"), (100, 3, "user", "same"), (100, 3, "user", "other"), (200, None, "user", "q")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("band", "turns"), [(65_536, 100_000), (20, 40)])
def test_trie_against_brute_force(spark, monkeypatch, tmp_path, band, turns):
    monkeypatch.setattr(prefix_trie, "BAND", band)
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", turns)
    rows = odd_turns(1, deep=10)
    read = spark.createDataFrame([(*r, "extra", 1, 2) for r in rows], TURN + ", key string, pos long, _c long")
    got = prefix_trie.prefix_trie(prefix_trie.turn_rows(read), read.select("conv_id").filter("conv_id is not null").distinct())
    assert trie_rows(got) == brute_trie(sequences(rows))
    spark.createDataFrame(rows, TURN).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op11_prefix_trie(spark, str(tmp_path))
    assert trie_rows(got) == brute_trie(rebuilt(sequences(rows)))


def test_trie_of_a_large_group_and_of_no_rows(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", 50)
    monkeypatch.setattr(shared, "HOT_ROWS", 20)
    rows = [(c, t, "user", f"s{t}") for c in range(300) for t in range(4)] + [(c, 4 + t, "user", f"{c % 7}") for c in range(200) for t in range(c % 5)]
    read = spark.createDataFrame(rows, TURN)
    got = prefix_trie.prefix_trie(prefix_trie.turn_rows(read), read.select("conv_id").distinct())
    assert trie_rows(got) == brute_trie(sequences(rows))
    none = read.limit(0)
    assert prefix_trie.prefix_trie(prefix_trie.turn_rows(none), none.select("conv_id")).count() == 0
    bare = spark.createDataFrame([(5,), (3,)], "conv_id long")
    assert trie_rows(prefix_trie.prefix_trie(prefix_trie.turn_rows(none), bare)) == [(3, 0, None, 2, 0, 1, 0, sha("3,5"))]


def test_double_array_holds_its_sequences_and_no_others():
    rng = random.Random(4)
    for _ in range(50):
        seqs = sorted({tuple(rng.randint(1, 30) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 60))})
        trie = prefix_trie.DoubleArray([list(s) for s in seqs])
        prefixes = {s[:d] for s in seqs for d in range(len(s) + 1)}
        at = {(): 0}
        for p in sorted(prefixes - {()}, key=len):
            at[p] = trie.step(at[p[:-1]], p[-1])
            assert at[p] > 0
        assert len(set(at.values())) == len(prefixes)
        for p, node in at.items():
            for c in range(1, 32):
                assert (trie.step(node, c) >= 0) == ((*p, c) in prefixes)


def test_trie_query_on_the_tables(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert trie_rows(queries.op11_prefix_trie(spark, sf)) == brute_trie(rebuilt(sequences(rows)))


# ---- URL filter ---------------------------------------------------------------------------


def split_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host) :]
    for c in "?#":
        path = path.split(c, 1)[0]
    return "".join(x.lower() if "A" <= x <= "Z" else x for x in host), path


def brute_verdict(url, rules):
    host, path = split_url(url)
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or h and host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


ODD_URLS = [
    None, "", "no scheme", "http://", "://", "https://EXAMPLE.com/en/", "http://www.example.com/en/x?y", "http://a.www.example.com/en/#t", "http://example.com/en", "http://example.com?/en/", "http://notexample.com/en/",
    "http://com/", "http://com", "http://x.net/es/1", "http://net/fr/", "http://x.net/es", "http://x.net//es/", "http://.net/es/", "http://net./es/", "ftp://u@example.com:80/en/", "http://a://b.net/es/", "http://x.net/es/\n/fr/",
    "http://é.com/É/", "http://" + ".".join(["a"] * 3000) + ".net/fr/" + "b/" * 5000, "x" * 50_000,
]


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_url_filter_against_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", broadcast)
    rng = random.Random(7)
    hosts, paths = ["a", "b", "a.b", "b.a", "c.a.b", ""], ["", "/", "/x", "/x/", "/x/y", "/x/yy", "//", "/x/y/z/w", "/ü"]
    rules = [(rng.choice(["allow", "block"]), h, p) for h in hosts for p in paths if rng.random() < 0.6] + queries.URL_RULES
    urls = ODD_URLS + [f"http://{rng.choice(['', 'w.', 'c.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'y', '/y/z/w', '?/x/'])}" for _ in range(200)]
    urls += urls[:5]
    pages = spark.createDataFrame([(i if i % 50 else None, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    given = url_filter.rules_from(spark, [*rules, *((v, h.upper(), p) for v, h, p in rules[:9])]).withColumn("full", F.lit(1))
    got = sorted((tuple(r) for r in url_filter.judge_urls(pages, given).collect()), key=str)
    assert got == sorted(((i if i % 50 else None, *brute_verdict(u, rules)) for i, u in enumerate(urls)), key=str)


def test_url_filter_edges(spark):
    pages = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    rules = url_filter.rules_from(spark, [("allow", "a", "/"), ("block", "A", "/")])
    assert tuple(url_filter.judge_urls(pages, rules).first()) == (1, "a", "/b", "a/", "block")
    assert tuple(url_filter.judge_urls(pages, rules.limit(0)).first()) == (1, "a", "/b", None, "allow")
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


def test_short_prefixes_that_clash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "SHORT", 0)
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(ODD_URLS[:20])], "page_id long, url string")
    got = sorted(tuple(r) for r in url_filter.judge_urls(pages, url_filter.rules_from(spark, queries.URL_RULES)).collect())
    assert got == [(i, *brute_verdict(u, queries.URL_RULES)) for i, u in enumerate(ODD_URLS[:20])]


# ---- periodic runs ------------------------------------------------------------------------


def brute_runs(w, least=24, times=3):
    found = set()
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least, times * q):
                found.add((s, i + q - s, q))
            i += 1
    smallest = [r for r in found if not any(r[2] % q == 0 and q < r[2] and s <= r[0] and s + n >= r[0] + r[1] for s, n, q in found)]
    return sorted(smallest, key=lambda r: (r[0], r[2]))


def periodic_words(rng):
    n, k = rng.randint(0, 150), rng.choice([1, 2, 3, 6, 50])
    w = [rng.randint(1, k) for _ in range(n)]
    for _ in range(rng.randint(0, 4)):
        q, a = rng.randint(1, 30), rng.randint(0, n)
        for i in range(max(a, q), min(n, a + rng.randint(10, 90))):
            w[i] = w[i - q]
    return w


def test_runs_against_brute_force():
    rng = random.Random(11)
    many = [periodic_words(rng) for _ in range(1500)]
    want = [brute_runs(w) for w in many]
    assert sum(map(len, want)) > 500 and any(len(x) > 2 for x in want)
    assert [periodic_runs.tree_runs(w) for w in many] == want
    assert periodic_runs.runs_of_texts([[b"%d" % x for x in w] for w in many]) == want  # through the stretches that repeat


def test_suffix_tree_agrees_with_plain_comparison():
    rng = random.Random(12)
    for _ in range(100):
        w = [rng.randint(1, 3) for _ in range(rng.randint(2, 40))]
        tree = periodic_runs.SuffixTree(w)
        assert list(tree.leaves) == sorted(range(len(w) + 1), key=lambda i: [*w[i:], 0])
        assert list(tree.falling()) == list(__import__("numpy").argsort(sorted(range(len(w) + 1), key=lambda i: [-x for x in w[i:]] or [-99])))
        for i in range(len(w)):
            for j in range(len(w)):
                if i != j:
                    n = 0
                    while max(i, j) + n < len(w) and w[i + n] == w[j + n]:
                        n += 1
                    assert tree.agree(__import__("numpy").array([i]), __import__("numpy").array([j]))[0] == n


def brute_document(doc_id, text):
    w = (text or "").encode().split()
    h, n = crc(doc_id), len((text or "").encode().split())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *told, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(kept))


def test_runs_query_against_brute_force(spark, tmp_path):
    rng = random.Random(13)
    texts = [None, "", " \t\n", "a " * 23, "a " * 24, "a\u00a0b " * 30, "x\u2003y\x1cz " * 24, "é🙂 ß\r\n" * 40]
    texts += [rng.choice([" ", "\n", "\t\x0b "]).join(map(str, periodic_words(rng))) for _ in range(300)]
    rows = [(i, t, "en", None, 1, "clash") for i, t in enumerate(texts)] + [(7, texts[7], "en", None, 1, "clash")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, runs long, collapsed string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted((brute_document(r[0], r[1]) for r in rows), key=str)


def test_runs_query_on_the_tables(spark, sf):
    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect() if len((r["text"] or "").split()) < 1500]
    got = {r["doc_id"]: tuple(r) for r in queries.op13_periodic_runs(spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count() and sum(r[1] > 0 for r in got.values()) > 5
    for r in docs:
        assert got[r["doc_id"]] == brute_document(r["doc_id"], r["text"])


def test_runs_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a " * 30), (None, "a " * 30), (1, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs.periodic_runs(docs).collect()), key=str)
    assert got == sorted([(None, [(0, 30, 1)], "a"), (None, [(0, 30, 1)], "a"), (1, [], "")], key=str)
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_long_runs_stay_fast():
    import time

    began = time.time()
    periodic_runs.tree_runs([1] * 60_000)
    periodic_runs.runs_of_texts([[b"a", b"b", b"c"] * 20_000])
    assert time.time() - began < 20
