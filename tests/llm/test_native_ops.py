"""Exact dedup, chat formatting, decontamination, mixing and WARC on small fixtures."""

import gzip
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recscan import scratch
from recscan.llm import chat_format, decontaminate, exact_dedup, mixing, shared, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def docs(spark, texts, sources=None):
    rows = [(i, t, None, (sources or ["s"] * len(texts))[i], None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


# ---- exact dedup --------------------------------------------------------------------------


def test_exact_groups_against_brute_force(spark):
    rng = random.Random(1)
    long = " ".join(rng.choice("alpha beta. gamma, delta! 0 ü".split()) for _ in range(4000))
    texts = ["a b", "ab ", "a\tb\n\n", None, "", " \n", "x", long, long.replace(" ", "  "), long[:-1], "ä b", "a b", *["same text."] * 40]
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(docs(spark, texts)).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[SPACE.sub("", t or "")].append((-len(t or ""), i))
    for norm, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(members), i == keep)
            assert r["text_sha256"] == hashlib.sha256(norm.encode()).hexdigest()


def test_exact_dedup_keeps_columns_and_one_of_repeated_rows(spark):
    d = docs(spark, ["a", "b"]).withColumnsRenamed({"lang": "_row", "n_chars": "_key"})
    got = exact_dedup.exact_dedup(d.union(d).union(spark.createDataFrame([(None, "a", None, None, 1)], d.schema)))
    assert got.columns == d.columns and sorted(r["doc_id"] for r in got.collect()) == [0, 1]
    assert exact_dedup.exact_groups(d.limit(0)).count() == 0


def test_clashing_identifiers_are_told_apart(spark):
    rows = spark.createDataFrame([(0, [(1, 5), (2, 6)]), (1, [(1, 5), (2, 7)]), (2, [(1, 5), (2, 6)])], "_id long, _recipe array<struct<id:long,check:long>>")
    keys = {r["_id"]: tuple(r["_key"]) for r in exact_dedup.verified_keys(rows).collect()}
    assert keys[0] == keys[2] != keys[1]


def test_chunks_join_to_the_text(spark):
    text = "".join(random.Random(2).choice("abc.") for _ in range(20_000)) + "z" * 9000
    pattern = f"(?s).{{{exact_dedup.CHUNK_MIN},{exact_dedup.CHUNK_MAX}}}?[{exact_dedup.CHUNK_ENDS}]|.{{1,{exact_dedup.CHUNK_MAX}}}"
    chunks = spark.createDataFrame([(text,)], "t string").select(F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).first()[0]
    assert "".join(chunks) == text and max(map(len, chunks)) <= exact_dedup.CHUNK_MAX + 1


# ---- chat ---------------------------------------------------------------------------------

NASTY = ["", "plain", "<|end|>\n", "\\", "\\\\", "<|", "<\\|", "<", "x<|turn|>assistant<|text|>y", "a\\<|next|>", "é🙂", "\\n", "<|end|>", "\n"]


@pytest.mark.parametrize("block", [2, 256])
def test_chat_round_trip(spark, monkeypatch, block):
    monkeypatch.setattr(chat_format, "BLOCK_TURNS", block)
    rng = random.Random(3)
    rows, want = [], {}
    for c in range(60):
        turns = [(rng.choice(["user", "assistant", "system", None, "<|text|>\\"]), rng.choice([*NASTY, None])) for _ in range(rng.randint(1, 9))]
        rows += [(c, i, r, t, "extra") for i, (r, t) in enumerate(turns)]
        want[c] = [(r or "", t or "") for r, t in turns]
    rng.shuffle(rows)
    f = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block string"))
    col = F.col("formatted")
    got = f.select("conv_id", "formatted", chat_format.read_turns(col).alias("t"), chat_format.loss_text(col).alias("loss"), chat_format.loss_runs(col).alias("runs")).collect()
    assert len(got) == 60
    for r in got:
        assert [tuple(t) for t in r["t"]] == want[r["conv_id"]]
        assert r["loss"] == "".join(t for role, t in want[r["conv_id"]] if role == "assistant")
        assert sum(x["chars"] for x in r["runs"]) == len(r["formatted"])
        masked, at = "", 0
        for x in r["runs"]:
            masked += r["formatted"][at : at + x["chars"]] if x["loss"] else ""
            at += x["chars"]
        assert masked.replace("<\\|", "<|").replace("\\\\", "\\") == r["loss"]
        roles = [role for role, _ in want[r["conv_id"]]]
        assert r["formatted"].count("<|end|>\n") == 1 + sum(a != b for a, b in zip(roles, roles[1:]))


def test_chat_empty_table_and_null_conversation(spark):
    t = spark.createDataFrame([(None, None, "user", "a"), (None, 1, "user", "b")], "conv_id long, turn long, role string, text string")
    assert chat_format.format_chats(t.limit(0)).count() == 0
    assert [x["text"] for x in chat_format.format_chats(t).select(chat_format.read_turns(F.col("formatted")).alias("t")).first()["t"]] == ["a", "b"]


# ---- decontamination ----------------------------------------------------------------------


def words(t):
    return [w for w in SPACE.split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if w]


def shingles(w, k):
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def test_contamination_against_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [say(30), say(30), say(12), "one two three", "", None, " ".join(["ha ha ho"] * 8), say(60)]

    def bend(t, n):
        w = t.split()
        for _ in range(n):
            w[rng.randrange(len(w))] = "CHANGED"
        return " ".join(w)

    texts = [None, "", say(100), say(50) + " " + items[0] + " " + say(50), items[1].upper(), "x " + items[2] + "\n" + items[0], "say One  two\tTHREE now", "one two", "two three one"]
    texts += [say(20) + " " + bend(rng.choice([items[0], items[1], items[7]]), n) + " " + say(20) for n in (0, 1, 1, 2, 3, 5, 9) for _ in range(3)]
    texts += [items[0][: len(items[0]) * 9 // 10], items[6] + " " + say(5), "ha ha ho " * 30]
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, extra string")
    got = {r["doc_id"]: r for r in decontaminate.contamination(docs(spark, texts), bench, radius=63).collect()}
    for d, t in enumerate(texts):
        w, best = words(t), {}
        for i, item in enumerate(items):
            v = words(item)
            if not v:
                continue
            k = min(5, len(v))
            a = shingles(v, k)
            for s in range(max(1, len(w) - len(v) + 1)):
                b = shingles(w[s : s + len(v)], k)
                n = sum((a & b).values())
                sim = n / (sum(a.values()) + sum(b.values()) - n)
                if sim >= 0.8:
                    best[i] = max(best.get(i, 0), sim)
        assert got[d]["contaminated"] == bool(best), (d, t, best)
        assert got[d]["n_items"] == len(best)
        if best:
            assert got[d]["similarity"] == pytest.approx(max(best.values())) and got[d]["item_id"] == min(best, key=lambda i: (-best[i], i))


def test_native_simhash_equals_bits(spark):
    rng = random.Random(5)
    rows = [[rng.getrandbits(64) - 2**63 for _ in range(n)] for n in (0, 1, 41, 33_000)] + [[-1] * 40_000, [-1] * 32_767, [2**62] * 100_000]
    got = spark.createDataFrame([(i, h) for i, h in enumerate(rows)], "i int, h array<long>").select("i", decontaminate.simhash(F.col("h"))).collect()
    for i, fp in got:
        assert fp & (2**64 - 1) == sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in rows[i]) > len(rows[i]))


def test_similarity_of_multisets(spark):
    rng = random.Random(8)
    rows = [([rng.randint(-3, 3) for _ in range(rng.randint(0, 9))], [rng.randint(-3, 3) for _ in range(rng.randint(0, 9))]) for _ in range(200)]
    got = spark.createDataFrame(rows, "a array<long>, b array<long>").select("a", "b", decontaminate.shared_count(F.col("a"), F.col("b"))).collect()
    assert all(n == sum((Counter(a) & Counter(b)).values()) for a, b, n in got)


def test_recall_at_the_shipped_radius(spark):
    """Random windows around the least similarity: what the radius loses is measured against brute force."""
    rng = random.Random(21)
    say = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    items = [say(rng.choice([15, 25, 40, 57])) for _ in range(40)]
    texts, truth = [], []
    for i, item in enumerate(items):
        for _ in range(15):
            w = list(item)
            for _ in range(rng.randint(0, 1 + len(item) // 40)):
                w[rng.randrange(len(w))] = "changed"
            a, b = shingles(item, 5), shingles(w, 5)
            n = sum((a & b).values())
            texts.append(" ".join(say(30) + w + say(30)))
            truth.append((i, n / (sum(a.values()) + sum(b.values()) - n)))
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {r["doc_id"]: r["item_id"] for r in decontaminate.contamination(docs(spark, texts), bench).filter("contaminated").collect()}
    same, close = [], []
    for d, (i, sim) in enumerate(truth):
        if sim == 1:
            same.append(got.get(d) == i)
        elif sim >= 0.8:
            close.append(got.get(d) == i)
        else:
            assert d not in got
    assert all(same) and len(close) > 60 and sum(close) / len(close) >= 0.94, sum(close) / len(close)


def test_long_items_are_found(spark):
    rng = random.Random(22)
    long = [f"w{rng.randrange(10**7)}" for _ in range(100_000)]
    middle = [f"v{rng.randrange(10**7)}" for _ in range(700)]
    off = ["x"] * 7 + middle[:]
    for at in range(10, 700, 27):
        off[at + 7] = f"new{at}"
    texts = ["before it " * 77 + " ".join(long) + " and after", " ".join(long[:50_000]), " ".join(off), " ".join(middle[:400]), "clean"]
    bench = spark.createDataFrame([(0, " ".join(long)), (1, " ".join(middle)), (2, "ho " * 40_000)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.contamination(docs(spark, texts), bench).collect()}
    a, b = shingles(middle, 5), shingles(off[7:], 5)
    n = sum((a & b).values())
    assert n / (len(a) * 2 - n) < 0.8 and [got[i]["item_id"] for i in range(5)] == [0, None, None, None, None]
    near = " ".join(off[:120] + middle[113:])
    got = decontaminate.contamination(docs(spark, [near]), bench).first()
    assert got["item_id"] == 1 and got["similarity"] >= 0.8


def test_multi_index_finds_all_within_the_radius():
    masks = set(decontaminate.near_values(15))
    rng = random.Random(6)
    for _ in range(300):
        apart = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 15)))
        assert any((apart >> 16 * b) & 0xFFFF in masks for b in range(4))


def test_decontaminate_keeps_columns(spark):
    bench = spark.createDataFrame([(None, "a b c d e f g"), (None, "q")], "item_id long, text string")
    d = docs(spark, ["a b c d e f g", "clean one", None, "q"]).withColumnRenamed("lang", "_row")
    assert [r["doc_id"] for r in decontaminate.decontaminate(d, bench).orderBy("doc_id").collect()] == [1, 2]
    assert decontaminate.decontaminate(d, bench).columns == d.columns
    assert decontaminate.decontaminate(d, bench.limit(0)).count() == 4 and decontaminate.decontaminate(d.limit(0), bench).count() == 0


# ---- mixing -------------------------------------------------------------------------------


def targets(sizes):
    """Water filling by hand: {source: target}."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(2 * sizes[s] for s in capped)
        t = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if t[s] > 2 * sizes[s]}
        if not over:
            return t | {s: 2.0 * sizes[s] for s in capped}
        capped |= over


@pytest.mark.parametrize("leaf, fan", [(4000, 256), (7, 2)])
def test_mix_meets_its_targets(spark, monkeypatch, leaf, fan):
    monkeypatch.setattr(mixing, "LEAF_ROWS", leaf)
    monkeypatch.setattr(mixing, "FAN_IN", fan)
    rng = random.Random(7)
    texts, sources = [], []
    for _ in range(300):
        sources.append(rng.choice(["a"] * 9 + ["b", "c", "é", None]))
        texts.append(rng.choice([None, "", " \t", " ".join(["w"] * rng.randint(1, 80))]))
    d = docs(spark, texts, sources)
    got = mixing.mix(d).collect()
    assert len(got) == 300
    size = {i: len([w for w in SPACE.split(t or "") if w]) for i, t in enumerate(texts)}
    sums = Counter()
    for i, s in enumerate(sources):
        sums[s] += size[i]
    want, taken = targets(sums), Counter()
    for r in got:
        s = sources[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sums[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] == r["copies"] * r["size"] and r["copies"] in (0, 1, 2)
        taken[s] += r["taken"]
    for s in want:
        assert abs(taken[s] - want[s]) <= max(size.values())
    assert sum(want.values()) == pytest.approx(1.5 * sum(sums.values()))
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(d.repartition(3)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}
    mixed = mixing.mixed_documents(d.withColumnRenamed("lang", "size"))
    assert mixed.columns == ["doc_id", "text", "size", "source", "n_chars", "copy"] and mixed.count() == sum(r["copies"] for r in got)


def test_rows_without_ids_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF_ROWS", 8)
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    d = spark.createDataFrame([(None, "w w w", "a", 1)] * 200 + [(i, "w " * i, "b", 1) for i in range(300)], "doc_id long, text string, source string, copy int")
    got = mixing.mix(d).collect()
    assert len(got) == 500
    for null in (True, False):
        part = [r for r in got if (r["doc_id"] is None) == null]
        assert abs(sum(r["taken"] for r in part) - part[0]["target"]) <= 300
    mixed = mixing.mixed_documents(d)
    assert mixed.columns == [*d.columns, "copy_1"] and mixed.count() == sum(r["copies"] for r in mixing.mix(d).collect())


def test_mix_of_nothing(spark):
    assert mixing.mix(docs(spark, ["a"]).limit(0)).count() == 0
    assert [r["taken"] for r in mixing.mix(docs(spark, [None, ""])).collect()] == [0, 0]


def test_pivot_keeps_words_and_expectations():
    sizes = np.array([5, 10, 3, 8, 2, 9, 4])
    p = np.array([0.3, 0.7, 0.5, 0.2, 0.9, 0.4, 0.6])
    mean = np.zeros(7)
    for seed in range(2000):
        out = mixing.pivot(np.arange(7), sizes, p, seed)
        assert out @ sizes == pytest.approx(p @ sizes) and ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 1
        mean += out / 2000
    assert np.abs(mean - p).max() < 0.05


# ---- WARC ---------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    big, other = "<p>ü</p>" * 200, "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n" * 30
    html = [big, "small", None, big, "small", "", other, other, "x" * 999, "x" * 999, "y" * 1000, "y" * 1000, "a\r\n\r\nb", big]
    rows = [(i if i != 2 else None, f"http://h/{i}\r\nX: y" if i else None, h, i) for i, h in enumerate(html)]
    pages = spark.createDataFrame([*rows, (6, "http://h/6", other, 6)], "page_id long, url string, html string, _digest long")
    warc.write_warc(pages, f"file://{tmp_path}/w")
    records = warc.read_warc(spark, f"file://{tmp_path}/w")
    assert {r["type"]: r["count"] for r in records.groupBy("type").count().collect()} == {"request": 15, "metadata": 15, "response": 10, "revisit": 5}
    caps = warc.assemble(records).collect()
    assert len(caps) == 15 and all(c["request"] and c["metadata"] for c in caps)
    seen = Counter()
    for c in caps:
        f = dict(c["metadata"]["fields"] or {})
        page = int(f["pageId"]) if "pageId" in f else None
        seen[page] += 1
        payload = (html[page] if page is not None else None) or ""
        raw = payload.encode()
        assert c["response"]["payload_digest"] == "sha1:" + hashlib.sha1(raw).hexdigest() and int(f["payloadLength"]) == len(raw)
        if c["response"]["type"] == "response":
            assert bytes(c["response"]["payload"]) == raw and c["response"]["payload_sha1"] == hashlib.sha1(raw).hexdigest()
            assert "refersToPageId" not in f
        else:
            assert int(f["refersToPageId"]) == {0: 13, 3: 13, 6: 7, 10: 11}[page]
    assert seen[6] == 2 and seen[None] == 1


def test_warc_empty_and_truncated(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string")
    warc.write_warc(pages.limit(0), f"file://{tmp_path}/e")
    assert warc.assemble(warc.read_warc(spark, f"file://{tmp_path}/e")).count() == 0
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\nshort")
    with pytest.raises(Exception, match="within a record"):
        warc.read_warc(spark, f"file://{tmp_path}/t").count()


def test_warc_of_other_versions(spark, tmp_path):
    one = lambda version, n, extra=b"": b"WARC/" + version + b"\r\nWARC-Type: resource\r\nWARC-Record-ID: <r%d>\r\n%bContent-Length: 11\r\n\r\nWARC/1.0\r\n%d\r\n\r\n" % (n, extra, n)
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(one(b"1.0", 1) + one(b"1.1", 2, b"X-Odd: \xff\r\n") + one(b"1.0", 3)))
    got = warc.read_warc(spark, f"file://{tmp_path}").orderBy("record_id").collect()
    assert [(r["record_id"], bytes(r["payload"])) for r in got] == [(f"<r{n}>", b"WARC/1.0\r\n%d" % n) for n in (1, 2, 3)]


def test_a_payload_full_of_version_lines_stays_fast():
    pieces = [b"1\r\nWARC-Type: resource\r\nContent-Length: 700000\r\n\r\n"] + [b""] * 99_999 + [b"x" * 7]
    batch = pa.RecordBatch.from_arrays([pa.array(pieces), pa.array(["f"] * len(pieces))], ["value", "file"])
    (out,) = warc._records([batch], pa.schema([("payload_bytes", pa.int64())]))
    assert out["payload_bytes"].to_pylist() == [700_000]


def test_hot_groups_are_joined_whole(spark, monkeypatch):
    rows = spark.createDataFrame([(k, i) for i in range(60) for k in ((0, 1, 2) if i < 20 else (0,))], "k int, v int")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("m"))
    want = sorted((k, i, 60 if k == 0 else 20, 59 if k == 0 else 19) for i in range(60) for k in ((0, 1, 2) if i < 20 else (0,)))
    for hot, few in ((1000, 10), (30, 10), (7, 10), (7, 1)):
        monkeypatch.setattr(shared, "BROADCAST_ROWS", few)
        assert sorted(tuple(r) for r in shared.join_groups(rows, groups, ["k"], "n", hot).select("k", "v", "n", "m").collect()) == want


def test_settled_and_scratch(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).write.parquet(path)
    read = spark.read.parquet(path)
    with shared.scratch(spark) as kept:
        before = len(scratch._paths.written)
        assert shared.settled(read.filter("id > 3").select("id"), "x") is not None and len(scratch._paths.written) == before
        for df in (read.repartition(3), spark.range(5), spark.createDataFrame([(1,)], "rand int"), read.orderBy("id")):
            assert shared.settled(df, "x").count() == df.count()
        assert len(scratch._paths.written) == before + 4
        kept.append(scratch._paths.written[-1])
    assert len(scratch._paths.written) == before + 1 and spark.read.parquet(kept[0]).count() == 100
    shared.drop_scratch(spark, scratch._paths.written.pop())
