import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recscan.operators import catalog as C
from recscan.operators import components
from recscan.operators import labels as L
from recscan.operators import review as V


def test_overrides_trim_clamp_and_revert(spark):
    i = spark.createDataFrame([("a", 0.0, 10.0), ("b", 0.0, 10.0), ("c", 0.0, 10.0), ("d", 2.0, 4.0)], "interval_id string, start_s double, end_s double")
    o = spark.createDataFrame([("a", '{"trim_start_s": 1.5, "trim_end_s": 9.5}'), ("b", '{"trim_start_s": 99}'), ("c", '{"decision": "reject", "trim_start_s": null}')], "interval_id string, raw string")
    got = {r["interval_id"]: r for r in V.effective_intervals(i, o.select("interval_id", V.parse_overrides(F.col("raw")).alias("o"))).collect()}
    assert got["a"]["effective_duration_s"] == 8.0 and got["b"]["effective_duration_s"] == 10.0
    assert got["c"]["effective_interval_decision"] == "reject" and got["d"]["effective_interval_decision"] == "keep"


def test_a_field_given_as_null_applies(spark):
    lb = spark.createDataFrame([("a", "Task", "cap", "task")], "interval_id string, proposed_task_name string, short_caption string, normalized_task_name string")
    o = spark.createDataFrame([("a", '{"short_caption": null, "proposed_task_name": "New  One"}')], "interval_id string, raw string")
    r = V.effective_labels(lb, o.select("interval_id", V.parse_overrides(F.col("raw")).alias("o"))).first()
    assert r["short_caption"] is None and r["normalized_task_name"] == "new one"


def test_overrides_keep_types(spark):
    lb = spark.createDataFrame([(k, True, "Task", "cap", ["cup"], 0.5, "task") for k in "abcde"], "interval_id string, is_manipulation boolean, proposed_task_name string, short_caption string, primary_objects array<string>, confidence double, normalized_task_name string")
    raw = [
        ("a", '{"primary_objects": ["a", "b"], "confidence": 0.9, "note": "by hand", "updated_at": "2024-01-01"}'), ("b", '{"confidence": "0.25", "is_manipulation": "no", "primary_objects": null}'),
        ("c", '{"confidence": "high", "primary_objects": "cup", "is_manipulation": 0}'), ("d", "{}"), ("e", "[1]"),
    ]
    o = spark.createDataFrame(raw, "interval_id string, raw string").select("interval_id", V.parse_overrides(F.col("raw")).alias("o"))
    got = {r["interval_id"]: r for r in V.effective_labels(lb, o).collect()}
    assert (got["a"]["primary_objects"], got["a"]["confidence"], got["a"]["override_note"], got["a"]["override_updated_at"]) == (["a", "b"], 0.9, "by hand", "2024-01-01")
    assert (got["b"]["primary_objects"], got["b"]["confidence"], got["b"]["is_manipulation"], got["b"]["override_note"]) == (None, 0.25, False, None)
    assert (got["c"]["primary_objects"], got["c"]["confidence"], got["c"]["is_manipulation"]) == (None, None, False)
    assert all(got[k]["confidence"] == 0.5 and got[k]["primary_objects"] == ["cup"] and got[k]["normalized_task_name"] == "task" for k in "de")
    e = spark.createDataFrame([("a", "valid", "review"), ("b", "valid", "review"), ("c", "invalid", "invalid"), ("d", "valid", "keep")], "episode_id string, validation_status string, episode_status string")
    said = spark.createDataFrame([("a", '{"episode_status": "keep", "note": "x"}'), ("b", '{"episode_status": null}'), ("c", '{"episode_status": "keep", "note": "x"}'), ("d", '{"note": 7}')], "episode_id string, raw string")
    ee = V.effective_episodes(e, said.select("episode_id", V.parse_overrides(F.col("raw")).alias("o")))
    assert sorted(ee.select("episode_id", "effective_episode_status", "override_note").collect()) == [("a", "keep", "x"), ("b", None, None), ("c", "invalid", None), ("d", "keep", "7")]
    i = spark.createDataFrame([("a", 0.0, 10.0), ("b", 0.0, 10.0)], "interval_id string, start_s double, end_s double")
    trims = spark.createDataFrame([("a", '{"trim_start_s": "2.5", "trim_end_s": 8}'), ("b", '{"trim_start_s": [1], "decision": null}')], "interval_id string, raw string")
    ei = V.effective_intervals(i, trims.select("interval_id", V.parse_overrides(F.col("raw")).alias("o")))
    assert sorted(ei.select("interval_id", "effective_start_s", "effective_end_s", "effective_interval_decision").collect()) == [("a", 2.5, 8.0, "keep"), ("b", 0.0, 10.0, "keep")]


def test_active_rows(spark):
    e = spark.createDataFrame([("s1", "keep"), ("s2", "reject")], "source_key string, effective_episode_status string")
    i = spark.createDataFrame([("int_keep", "s1", "keep"), ("x", "s1", "reject"), ("y", "s2", "keep"), ("unknown", "s9", None)], "interval_id string, source_key string, effective_interval_decision string")
    assert {r["interval_id"] for r in V.active_intervals(i, e).collect()} == {"int_keep", "unknown"}


def test_upsert_last_wins(spark):
    old = spark.createDataFrame([("a", 1, 0), ("b", 1, 0)], "k string, v int, o int")
    new = spark.createDataFrame([("a", 2, 1), ("a", 3, 2), ("c", 4, 1)], "k string, v int, o int")
    assert {(r["k"], r["v"]) for r in V.upsert(old, new, ["k"], "o").collect()} == {("a", 3), ("b", 1), ("c", 4)}


def test_manifest_is_idempotent(spark):
    m = spark.createDataFrame([("a.rec", 1)], "filename string, frames long")
    e = spark.createDataFrame([("a.rec", 9), ("b.rec", 2)], "filename string, frames long")
    once = C.manifest_add(m, e)
    assert {tuple(r) for r in C.manifest_add(once, e).collect()} == {("a.rec", 1), ("b.rec", 2)}


def test_components_of_chain_and_loop(spark):
    v = spark.range(12)
    e = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(8, 9), (9, 8), (9, 9)], "a long, b long")
    got = {r["id"]: r["component"] for r in L.connected_components(v, e).collect()}
    assert all(got[i] == 0 for i in range(7)) and got[8] == got[9] == 8 and got[7] == 7 and got[11] == 11


def test_lsh_finds_the_same_close_pairs(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (1, [0.99, 0.05, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.98, 0.1])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    pairs = lambda df: {(r["a"], r["b"]) for r in df.collect()}
    assert pairs(L.similar_pairs(v, 0.9, block=2)) == pairs(L.lsh_pairs(v, 0.9)) == {(0, 1), (2, 3)}


def test_bad_answers_go_to_review(spark):
    a = spark.createDataFrame([("a", "s", "no json"), ("b", "s", '{"proposed_task_name": " ", "confidence": "x", "primary_objects": "cup"}')], "interval_id string, source_key string, raw string")
    good, bad = L.parse_answers(a)
    r = good.first()
    assert (r["proposed_task_name"], r["confidence"], r["primary_objects"], r["is_manipulation"]) == ("unknown", 0.0, [], False)
    assert [x["interval_id"] for x in bad.collect()] == ["a"]


@pytest.mark.parametrize("local_links", [0, 5, 10**6])
def test_components_by_contraction(spark, local_links, monkeypatch):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(100, 180)] + [(500, k) for k in range(501, 600)] + [(rng.randint(1000, 1400), rng.randint(1000, 1400)) for _ in range(250)] + [(7, 7), (None, 3), (9, 8), (9, 8), (8, 9)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    sizes, plain = [], components.written

    def counted(df, name):
        out = plain(df, name)
        sizes.extend([out.count()] if name == "links" else [])
        return out

    monkeypatch.setattr(components, "written", counted)
    got = components.connected_components(spark.createDataFrame(links, "a long, b long"), local_links=local_links)
    assert {r["node"]: r["component"] for r in got.collect()} == {x: find(x) for x in up}
    assert got.count() == len(up) and all(b <= a * 0.8 for a, b in zip(sizes, sizes[1:]))
    named = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "p string, q string")
    assert {tuple(r) for r in components.connected_components(named, "p", "q", local_links).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}
    assert components.connected_components(named.limit(0), "p", "q", local_links).count() == 0


def clustered(rng, n=600, d=16, k=12):
    centres = rng.normal(size=(k, d))
    return centres[rng.integers(0, k, n)] * 3 + rng.normal(size=(n, d)) * 0.8


@pytest.mark.parametrize("threshold", [0.4, 0.82])
def test_similar_pairs_skip_blocks_and_lose_nothing(spark, threshold):
    rng = np.random.default_rng(1)
    v = np.vstack([clustered(rng), np.zeros((2, 16)), np.tile(rng.normal(size=16), (40, 1))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(9999, None)], "vec_id long, embedding array<double>")
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    near = unit @ unit.T
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(near >= threshold, 1)))}
    got = [(r["a"], r["b"]) for r in L.similar_pairs(df, threshold, block=25).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    slotted, pairs = L.vector_blocks(df, threshold, 25)
    blocks, kept = slotted.select("slot").distinct().count(), pairs.count()
    assert blocks > 20 and (threshold < 0.8 or kept < 0.6 * blocks * (blocks + 1) / 2)
    assert L.similar_pairs(df.limit(0), threshold).count() == 0


@pytest.mark.parametrize("tile_bytes", [4_000, 16_000_000])
def test_similar_links_join_up_what_similar_pairs_do(spark, tile_bytes, monkeypatch):
    monkeypatch.setattr(L, "TILE_BYTES", tile_bytes)
    rng = np.random.default_rng(3)
    v = np.vstack([clustered(rng), np.tile(rng.normal(size=16), (60, 1))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(9999, None)], "vec_id long, embedding array<double>")
    pairs, links = L.similar_pairs(df, 0.9, block=50), L.similar_links(df, 0.9, block=50)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.9, 1)))}
    assert sorted((r["a"], r["b"]) for r in pairs.collect()) == sorted(want)
    joined = lambda e: {r["node"]: r["component"] for r in components.connected_components(e).collect()}
    # copies and clusters make pairs by the square of their size, links by their size for each pair of tiles
    assert joined(links) == joined(pairs) and links.count() < len(want) / 2
    assert L.similar_links(df.limit(0), 0.9).count() == 0


def test_recall_of_lsh_pairs(spark):
    v = clustered(np.random.default_rng(2), n=800, d=32, k=40)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    exact = {(r["a"], r["b"]) for r in L.similar_pairs(df, 0.82).collect()}
    found = {(r["a"], r["b"]) for r in L.lsh_pairs(df, 0.82).collect()}
    assert len(exact) > 1000 and found <= exact and len(found) >= 0.9 * len(exact)
