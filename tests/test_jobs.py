import json

import pytest
from pyspark.sql import functions as F

from recscan.operators import activity as A
from recscan.operators import catalog as C
from recscan.operators import ranks
from recscan.plans import curation_queries, jobs
from recscan.plans.fixtures import fixture
from tests.test_sources import write


def test_inventory_and_validation_of_files(spark, tmp_path):
    write(tmp_path / "a.rec")
    write(tmp_path / "b.rec", n=3, footer=False)
    rec = jobs.read_recordings(spark, str(tmp_path), ".rec")
    inv = {r["file_name"]: r for r in jobs.inventory(rec, str(tmp_path)).collect()}
    assert inv["a.rec"]["validation_status"] == "valid" and inv["a.rec"]["fps"] == 2.0 and inv["a.rec"]["codec"] == "H264"
    assert inv["b.rec"]["validation_status"] == "invalid" and inv["b.rec"]["frame_count"] == 0
    assert inv["a.rec"]["header_ok"] and inv["a.rec"]["footer_ok"] and inv["b.rec"]["header_ok"] and not inv["b.rec"]["footer_ok"] and inv["b.rec"]["validation_error"].startswith("footer: ")
    assert inv["a.rec"]["index_entry_count"] is not None and inv["b.rec"]["index_entry_count"] is None and {"usb_type", "color_width", "depth_height", "rgb_codec", "depth_codec"} <= set(inv["a.rec"].asDict())
    other = tmp_path.parent / f"{tmp_path.name}_other"
    other.mkdir()
    write(other / "a.rec")
    (other / "c.rec").write_bytes(b"short")
    more = jobs.read_recordings(spark, str(other), ".rec")
    listed = more.filter("source_key not like '%/c.rec'").select(F.col("source_key").alias("key"), F.lit('"abc"').alias("etag"), F.timestamp_micros(F.lit(0)).alias("mtime"))
    short = {r["file_name"]: r for r in jobs.inventory(more, objects=listed).collect()}
    assert short["c.rec"]["validation_error"].startswith("header: ") and not short["c.rec"]["header_ok"] and short["c.rec"]["camera_serial"] is None and short["c.rec"]["etag"] is None
    assert short["a.rec"]["etag"] == "abc" and short["a.rec"]["last_modified"].startswith("1970-01-01T00:00:00")
    assert {r["validation_status"]: r["files"] for r in jobs.inventory_summary(jobs.inventory(rec)).collect()} == {"valid": 1, "invalid": 1}
    assert jobs.stage(jobs.inventory(rec)).count() == 1 and jobs.stage(jobs.inventory(rec), include_invalid=True, limit=1).count() == 1
    checked, counts = jobs.validate(jobs.read_recordings(spark, str(tmp_path), ".rec", "index"), rec)
    assert sorted((r["source_key"][-5:], r["n_warnings"]) for r in checked.collect()) == [("a.rec", 0), ("b.rec", 1)] and counts.first()["passed"] == 2


@pytest.fixture(scope="module")
def tables(spark, sf):
    names = ("fx_frames", "fx_recordings", "fx_index")
    return [fixture(spark, sf, n) for n in names]


def test_qc_gives_each_recording_a_status(tables):
    frames, rec, index = tables
    episodes, review = jobs.qc(frames, index, rec)
    rows = episodes.collect()
    assert len(rows) == rec.count() and {r["episode_status"] for r in rows} <= {"keep", "review", "reject", "invalid"}
    sent = {r["source_key"] for r in rows if r["episode_status"] == "review" or r["validation_status"] == "invalid"}
    assert {r["identifier"] for r in review.collect()} == sent
    done = episodes.limit(1).select("source_key")
    assert jobs.eligible(episodes, done).count() <= len(rows)


def test_intervals_have_ids_and_windows(spark, sf, tables):
    frames, rec, _ = tables
    samples = fixture(spark, sf, "fx_hand_samples").select("source_key", (F.col("t_ms") / 1000).alias("t"), "n", F.col("a").cast("double").alias("a"))
    found, review = jobs.intervals(jobs.proposals(frames, rec), rec, samples)
    rows = found.collect()
    assert {r["source_key"] for r in rows} | {r["identifier"] for r in review.collect()} == {r["source_key"] for r in rec.collect()}
    assert rows and len({r["interval_id"] for r in rows}) == len(rows)
    assert all(r["analysis_windows"][0]["start_s"] == r["start_s"] and r["analysis_windows"][-1]["end_s"] == r["end_s"] for r in rows)


def test_exports(spark, tables, tmp_path):
    frames, rec, _ = tables
    jobs.export_rlds(rec, frames, str(tmp_path / "rlds"), "demo", "about")
    n, k = frames.count(), frames.select("source_key").distinct().count()
    base = tmp_path / "rlds/demo/1.0.0"
    assert sorted(f.name for f in base.glob("*tfrecord*")) == [f"ego_recording-train.tfrecord-{i:05d}-of-{k:05d}" for i in range(k)]
    info = json.loads((base / "dataset_info.json").read_text())
    assert info["splits"]["train"]["num_examples"] == k and "episode_metadata" in json.loads((base / "features.json").read_text())["featuresDict"]["features"]
    depth = frames.select("source_key", "idx", F.array(F.lit(5), F.col("idx").cast("int")).alias("depth"))
    jobs.export_lerobot(rec, frames, str(tmp_path / "lr"), depth)
    back = spark.read.parquet(str(tmp_path / "lr/data/chunk-000"))
    assert len(list((tmp_path / "lr/data/chunk-000").glob("episode_*.parquet"))) == k
    assert back.count() == n and back.agg(F.countDistinct("frame_index"), F.max("frame_index")).first()[:] == (n, n - 1)
    assert back.columns == ["frame_index", "episode_index", "timestamp", "observation.depth_mm", "task_index"] and back.filter("size(`observation.depth_mm`) <> 2").count() == 0
    info = json.loads((tmp_path / "lr/meta/info.json").read_text())
    assert (info["total_episodes"], info["total_frames"]) == (k, n)
    assert spark.read.json(str(tmp_path / "lr/meta/episodes.jsonl")).agg(F.sum("length")).first()[0] == n and spark.read.json(str(tmp_path / "lr/meta/tasks.jsonl")).first()["task"] == "ego_recording"
    two = rec.orderBy("source_key").limit(2)
    jobs.export_lerobot(two, frames, str(tmp_path / "each"), separate=True)
    assert sorted(p.name for p in (tmp_path / "each").iterdir()) == sorted(r["session_name"] for r in two.collect())
    for one in (tmp_path / "lr", *(tmp_path / "each").iterdir()):
        assert (one / "meta/episodes.jsonl").is_file() and (one / "meta/tasks.jsonl").is_file()
        rows, info = [json.loads(x) for x in (one / "meta/episodes.jsonl").read_text().splitlines()], json.loads((one / "meta/info.json").read_text())
        assert [r["episode_index"] for r in rows] == list(range(info["total_episodes"])) and sum(r["length"] for r in rows) == info["total_frames"] and info["total_chunks"] == 1
        back = spark.read.parquet(str(one / "data/chunk-000"))
        assert back.agg(F.min("frame_index"), F.max("frame_index")).first()[:] == (0, info["total_frames"] - 1) and "dataset_name" not in back.columns


def test_dataset_names(spark):
    rec = spark.createDataFrame([("a/x.rec", ""), ("a/y.rec", "s")], "source_key string, session_name string")
    name = lambda **o: [r["dataset_name"] for r in C.dataset_name(rec, **o).orderBy("source_key").collect()]
    assert name() == ["ego_recording"] * 2 and name(separate=True) == ["x", "s"] and name(name="n", separate=True) == ["n", "n"] and name(dataset="d", name="n") == ["d", "d"]


def test_materialize_segments_and_manifest_jobs(spark, sf, tables, tmp_path):
    frames, rec, index = tables
    q = curation_queries
    lb = q._labels(spark, sf)
    buckets, mapping, _ = q.L.buckets(lb)
    none = {"renames": spark.createDataFrame([], "bucket_id string, canonical_task_name string"), "assignments": spark.createDataFrame([], "interval_id string, bucket_id string, canonical_task_name string")}
    o = lambda c: spark.createDataFrame([], f"{c} string, o map<string,string>")
    intervals = fixture(spark, sf, "fx_intervals").withColumns({"start_s": F.col("start_s").cast("double"), "end_s": F.col("end_s").cast("double")})
    made = jobs.materialize(q._episodes(spark, sf), intervals, lb, buckets, mapping, {"episodes": o("episode_id"), "intervals": o("interval_id"), "labels": o("interval_id")} | none, str(tmp_path / "eff"))
    assert sorted(p.name for p in (tmp_path / "eff").iterdir()) == [f"effective_{x}.jsonl" for x in ("buckets", "episodes", "intervals", "labels")]
    manifest, plan, review = jobs.segments(frames, index, rec, made)
    kept, bad = {r["interval_id"] for r in manifest.collect()}, {r["identifier"] for r in review.collect()}
    usable = {r["interval_id"] for r in q.V.exportable_segments(made["effective_intervals"], made["effective_episodes"])[0].collect()}
    assert kept | bad >= usable and not kept & bad and {r["id"] for r in plan.collect()} == kept
    episodes = spark.createDataFrame([("a.rec", 9, "d"), ("b.rec", 9, "d")], "filename string, frames long, dataset string")
    analysis = spark.createDataFrame([("a.rec", "PRUNE_CONFIDENT", 0.0)], "filename string, verdict string, activity_score double")
    stays, _ = jobs.prune(episodes, analysis, log=str(tmp_path / "audit"))
    back, audit = jobs.restore(stays, episodes, log=str(tmp_path / "audit"))
    assert stays.count() == 1 and back.count() == 2 and audit.first()["source"] == ".pruned/a.rec" and spark.read.json(str(tmp_path / "audit")).count() == 2
    segs = spark.createDataFrame([("d/b.rec", 0, 4), ("d/b.rec", 5, 9)], "source_key string, start_frame long, end_frame long")
    spliced, _ = jobs.splice(episodes, segs, spark.createDataFrame([("d/b.rec", 9)], "source_key string, total_frames long"))
    assert sorted(r["filename"] for r in spliced.collect()) == ["a.rec", "b_seg000.rec", "b_seg001.rec"]


def test_reviews_of_failures(spark):
    proxies = spark.createDataFrame([("i1", None), ("i2", "no codec")], "interval_id string, details string")
    assert [(r["stage"], r["identifier"], r["reason"]) for r in jobs.proxy_reviews(proxies).collect()] == [("proxies", "i2", "proxy_generation_failed")]


def test_ranks_over_many_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("x"), F.lit(2).alias("n")).repartition(7)
    got = ranks.ranked(df, [F.desc("x")], "r", "n").collect()
    assert all(r["r"] == 999 - r["x"] and r["n_before"] == 2 * r["r"] for r in got) and len(got) == 1000
    assert ranks.ranked(df.limit(0), [F.desc("x")], "r", "n").count() == 0


def test_cluster_by_vectors(spark):
    lb = spark.createDataFrame([(f"i{k}", "s", k < 4, f"name {k // 2}", 0.9, ["cup"]) for k in range(5)], "interval_id string, source_key string, is_manipulation boolean, normalized_task_name string, confidence double, primary_objects array<string>")
    iv = lb.select("interval_id", "source_key", F.lit("keep").alias("effective_interval_decision"))
    ep = spark.createDataFrame([("s", "keep")], "source_key string, effective_episode_status string")
    vec = spark.createDataFrame([(f"i{k}", k, v) for k, v in enumerate([[1.0, 0.0], [1.0, 0.01], [0.0, 1.0], [1.0, 0.02]])], "interval_id string, vec_id long, embedding array<float>")
    b, m, review = jobs.cluster(lb, iv, ep, vec)
    got = {r["bucket_id"]: (r["canonical_task_name"], r["member_count"]) for r in b.collect()}
    assert got == {"bucket_000": ("name 0", 3), "bucket_001": ("name 1", 1), "bucket_non_manipulation": ("non_manipulation", 1)}
    assert m.count() == 5 and [r["identifier"] for r in review.collect()] == ["bucket_001"]
    assert jobs.publish_keys(spark.createDataFrame([("a/b.jsonl",)], "relative string"), "/p/").first()[:] == ("a/b.jsonl", "p/a/b.jsonl", "application/x-ndjson")


def test_frames_are_dealt_by_their_size(spark, tmp_path, monkeypatch):
    """Twice the frames go to twice the tasks, so that a task sorts as many as before; each recording stays in one."""
    from recscan import scratch

    monkeypatch.setattr(scratch, "TASK_BYTES", 2_000)
    tasks = {}
    for n in (40, 80):
        path = str(tmp_path / str(n))
        spark.range(n * 300).selectExpr("concat('r', id div 300) source_key", "id % 300 idx", "20000 + (id * 7919) % 9001 rgb_size", "9000 + (id * 104729) % 4001 depth_size").coalesce(1).write.parquet(path)
        masked = A.activity_masks(spark.read.parquet(path)).select("source_key", "depth_active", F.spark_partition_id().alias("task"))
        tasks[n] = masked.select("task").distinct().count()
        assert masked.count() == n * 300 and masked.groupBy("source_key").agg(F.countDistinct("task").alias("k")).agg(F.max("k")).first()[0] == 1
    assert tasks[40] > 10 and tasks[80] > 1.3 * tasks[40]
    # a source that does not tell its size
    assert scratch.dealt(spark.createDataFrame([("a", 1)], "source_key string, x int"), "source_key").count() == 1
