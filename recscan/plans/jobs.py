"""The user-level jobs: each a lazy composition of the operators, DataFrames in and out."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recscan.functions import scalars as S
from recscan.operators import activity as A
from recscan.operators import catalog as C
from recscan.operators import labels as L
from recscan.operators import review as V
from recscan.operators import spans as P
from recscan.operators.ranks import ranked
from recscan.scratch import written
from recscan.sources import workspace as W
from recscan.sources.recording import ParquetFileSink, RecordingSource, TextFileSink, TFRecordSink, read_blocks


def read_recordings(
    spark: SparkSession, path: str, suffix: str, table: str = "recordings", magic: str | None = None, columns: list[str] | None = None, share_bytes: int | None = None,
    keys: list[str] | None = None, since_us: int | None = None, until_us: int | None = None, pushdown: bool = False,
) -> DataFrame:
    """A table of the recordings below a path; see :mod:`recscan.sources.recording`.

    ``columns`` are the ones to give, all if None. ``keys`` are the only files to open; rows of frames, index and imu lie
    from ``since_us`` to before ``until_us``, and of frames in an index no others are read. With ``share_bytes`` frames and imu of
    files without an index are read in shares, at the cost of a pass over the footers of all files.
    ``pushdown`` lets filters choose files and entries; only for a DataFrame that is used with one filter, see there.
    """
    times = [F.col("timestamp_us") >= since_us] * (since_us is not None) + [F.col("timestamp_us") < until_us] * (until_us is not None)
    if times and table == "recordings":
        raise ValueError("recordings have no timestamp_us")
    need = [*columns, *(["timestamp_us"] if times and "timestamp_us" not in columns else [])] if columns else None
    if share_bytes and table in ("frames", "imu"):
        found = read_blocks(spark, path, suffix, table, share_bytes)
        found = found.filter(F.col("source_key").isin(keys)) if keys is not None else found
    else:
        spark.dataSource.register(RecordingSource)
        options = {"table": table, "suffix": suffix, "magic": magic, "columns": ",".join(need) if need else None, "keys": None if keys is None else json.dumps(keys), "since_us": since_us, "until_us": until_us}
        if pushdown:
            spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
            options["pushdown"] = "true"
        found = spark.read.format("recording").options(**{k: v for k, v in options.items() if v is not None}).load(path)
    for t in times:
        found = found.filter(t)  # blocks too, as a file without an index gives all of them
    return found.select(columns) if columns else found


def inventory(recordings: DataFrame, prefix: str = "", objects: DataFrame | None = None) -> DataFrame:
    """One row per file: names, sizes, times, what its header and footer say, and whether both can be used.

    Without a usable header nothing is said of the file, without a usable footer nothing of its length; validation_error
    names the part. ``objects``: key and any of etag and mtime, as :func:`tables.list_objects` gives them.
    """
    c, header, footer = F.col, F.col("header_error").isNull(), F.col("header_error").isNull() & F.col("footer_error").isNull()
    duration, key = F.coalesce(c("duration_us") / 1e6, F.lit(0.0)), S.relative_key(c("source_key"), prefix)
    rate = S.fps(c("total_frames"), duration)
    said = lambda name, value: F.when(header, value).alias(name)
    counted = lambda name, value: F.when(footer, value).alias(name)
    cameras = [said(f"{d}_{k}", c(f"{d}.{k}")) for d in ("color", "depth") if d in recordings.columns for k in ("width", "height")]
    plain = [said(k, c(k)) for k in ("usb_type", "depth_codec") if k in recordings.columns]
    entries = [counted("index_entry_count", c("index_entries"))] if "index_entries" in recordings.columns else []
    rows = recordings.select(
        c("source_key").alias("key"), key.alias("relative_key"), S.source_prefix(key).alias("source_prefix"), F.element_at(F.split("source_key", "/"), -1).alias("file_name"), "size_bytes",
        header.alias("header_ok"), footer.alias("footer_ok"), said("camera_serial", c("camera_serial")), said("session_name", c("session_name")), said("recorded_at", S.recorded_at(c("start_timestamp_us"))),
        F.when(footer, F.bround(duration, 6)).otherwise(0.0).alias("duration_s"), F.when(footer, F.coalesce("total_frames", F.lit(0))).otherwise(0).alias("frame_count"), F.when(footer, F.bround(rate, 4)).otherwise(0.0).alias("fps"),
        said("has_imu", S.has_flag(c("flags"), 0)), said("has_index", S.has_flag(c("flags"), 1)), said("rgb_codec", c("rgb_codec")), *plain, *cameras, *entries, said("codec", S.codec_name(c("rgb_codec"))),
        said("video_streamable", S.streamable(c("rgb_codec"))), said("video_stream_error", S.stream_error(c("rgb_codec"))), F.when(footer, "valid").otherwise("invalid").alias("validation_status"),
        F.coalesce(F.concat(F.lit("header: "), "header_error"), F.concat(F.lit("footer: "), "footer_error")).alias("validation_error"),
    )
    if objects is None:
        return rows
    extra = [F.trim("etag", F.lit('"')).alias("etag") if k == "etag" else F.date_format("mtime", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("last_modified") for k in ("etag", "mtime") if k in objects.columns]
    return rows.join(objects.select("key", *extra), "key", "left")


def registration(recordings: DataFrame) -> DataFrame:
    """What a recording is registered with: unknown values are null, cameras are nested."""
    c = F.col
    duration = F.coalesce(c("duration_us") / 1e6, F.lit(0.0))
    rate = S.fps(F.coalesce("total_frames", F.lit(0)), duration)
    cameras = [F.struct(*[c(f"{d}.{k}").alias(k) for k in ("width", "height", "fx", "fy", "ppx", "ppy", "coeffs")]).alias(d) for d in ("depth", "color") if d in recordings.columns]
    return recordings.select(
        "source_key", F.nullif("session_name", F.lit("")).alias("session_name"), F.coalesce("total_frames", F.lit(0)).alias("frame_count"), duration.alias("duration_s"),
        *([c("color.width").alias("resolution_w"), c("color.height").alias("resolution_h"), F.struct(*cameras).alias("intrinsics")] if len(cameras) == 2 else []),
        F.when(rate > 0, F.bround(rate, 2)).alias("fps"), *(["size_bytes"] if "size_bytes" in recordings.columns else []), S.recorded_at(c("start_timestamp_us")).alias("recorded_at"),
        F.nullif("camera_serial", F.lit("")).alias("camera_serial"), F.lit(True).alias("has_depth"), S.has_flag(c("flags"), 0).alias("has_imu"), "rgb_codec",
        S.streamable(c("rgb_codec")).alias("video_streamable"), S.stream_error(c("rgb_codec")).alias("video_stream_error"),
    )


def inventory_summary(objects: DataFrame) -> DataFrame:
    return objects.groupBy("validation_status").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("size_bytes"))


def stage(objects: DataFrame, prefix: str = "", include_invalid: bool = False, limit: int | None = None) -> DataFrame:
    """The selection of a run: valid objects below a prefix, in order of their keys."""
    chosen = objects.filter(F.startswith("key", F.lit(prefix)))
    chosen = chosen if include_invalid else chosen.filter("validation_status = 'valid'")
    return chosen.orderBy("key").limit(limit) if limit else chosen


def calibrate(frames: DataFrame, recordings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(station profiles, feature rows): profiles by camera, or source where no serial is known."""
    keys = recordings.select("source_key", S.profile_key(F.col("camera_serial"), F.col("source_key")).alias("profile_key"))
    rows = A.episode_features(A.scan(frames)).drop("sustained")
    return A.station_profile(frames.join(keys, "source_key")), rows


def analyze(frames: DataFrame, recordings: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """Verdict, score, reasons and features of each recording; with profiles, against its station's."""
    mine = None
    if profiles is not None:
        keys = recordings.select("source_key", S.profile_key(F.col("camera_serial"), F.col("source_key")).alias("profile_key"))
        mine = keys.join(profiles, "profile_key")
    return A.analyze(A.episode_features(A.scan(frames, profile=mine)), recordings).withColumn("used_profile", F.lit(profiles is not None))


def validate(index: DataFrame, recordings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(result of each file, one row of counts)."""
    checked = A.validate_index(index, recordings)
    return checked, A.validation_counts(checked)


def reviews(stage: str, rows: DataFrame, reason: str, identifier: str = "source_key") -> DataFrame:
    """Review rows of one reason."""
    return rows.select(F.lit(stage).alias("stage"), F.col(identifier).cast("string").alias("identifier"), F.lit(reason).alias("reason"))


def qc(frames: DataFrame, index: DataFrame, recordings: DataFrame, with_profiles: bool = True) -> tuple[DataFrame, DataFrame]:
    """(episodes, review rows): profiles, verdicts and index checks to a status for each recording."""
    profiles = calibrate(frames, recordings)[0] if with_profiles else None
    verdicts = analyze(frames, recordings, profiles).select("source_key", "verdict", "activity_score", "reasons_keep", "reasons_prune")
    checked = A.validate_index(index, recordings).select("source_key", F.col("valid").alias("index_valid"))
    rows = recordings.select("source_key", "session_name", "camera_serial", (F.col("duration_us") / 1e6).alias("duration_s"), F.col("total_frames").alias("frame_count"))
    valid = F.coalesce("index_valid", F.lit(False))
    joined = rows.join(checked, "source_key", "left").join(verdicts, "source_key", "left")
    episodes = joined.select(
        S.episode_id(F.col("source_key")).alias("episode_id"), *rows.columns, F.when(valid, "valid").otherwise("invalid").alias("validation_status"),
        V.episode_status(valid, F.coalesce("duration_s", F.lit(0.0)), F.col("verdict")).alias("episode_status"), "verdict", "activity_score", "reasons_keep", "reasons_prune",
    )
    return episodes, V.review_queue(qc_reviews(episodes))


def qc_reviews(episodes: DataFrame) -> DataFrame:
    """Episodes that a person has to look at."""
    invalid = F.col("validation_status") == "invalid"
    said = F.when(invalid, "invalid_episode").otherwise("needs_human_review")
    return episodes.filter(invalid | (F.col("episode_status") == "review")).select(F.lit("qc").alias("stage"), F.col("source_key").alias("identifier"), said.alias("reason"))


def proposals(frames: DataFrame, recordings: DataFrame, min_gap: int = 30, min_duration: int = 45, pad: int = 15) -> DataFrame:
    """Activity segments with their ends in seconds: a frame's time, or the duration where it has no frame."""
    seg = A.segments(A.scan(frames), min_gap, min_duration, pad)
    return P.frame_seconds(seg, frames, recordings).withColumn("active_fraction", F.col("active_frames") / F.col("total_frames"))


def intervals(
    proposed: DataFrame, recordings: DataFrame, samples: DataFrame, export_failures: DataFrame | None = None, detection_failures: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(hand-aware intervals with their ids, review rows): activity proposals cut with the spans in which hands are seen.

    ``recordings``: source_key, duration_us of the episodes to work on; failures: source_key. Of a recording
    the first reason is given: its export failed, nothing was proposed, detection failed, no hand
    was seen, or hands and activity nowhere met.
    """
    rec = recordings.select("source_key", (F.col("duration_us") / 1e6).alias("duration_s"))
    spans = written(proposed.select("source_key", "start_s", "end_s", "active_fraction"), "proposals")
    found = P.hand_intervals(rec, spans, samples)
    out = found.withColumns({"interval_id": S.interval_id(F.col("source_key"), F.col("start_s"), F.col("end_s")), "analysis_windows": P.analysis_windows(F.col("start_s"), F.col("end_s"))})
    seen = samples.filter(P.present(F.col("n"), F.col("a")))
    marks = [("no_interval_proposals", spans, False), ("no_hands_detected", seen, False), ("no_hand_activity_overlap", found, False)]
    marks[:0] = [("interval_export_failed", export_failures, True)] if export_failures is not None else []
    marks[-2:-2] = [("hand_detection_failed", detection_failures, True)] if detection_failures is not None else []
    said, rows = F.lit(None).cast("string"), rec.select("source_key")
    for reason, where, bad in marks:
        rows = rows.join(where.select("source_key", F.lit(True).alias(reason)).distinct(), "source_key", "left")
        said = F.coalesce(said, F.when(F.col(reason).isNotNull() if bad else F.col(reason).isNull(), reason))
    review = rows.select(F.lit("intervals").alias("stage"), F.col("source_key").alias("identifier"), said.alias("reason")).filter("reason is not null")
    return out, V.review_queue(review)


def eligible(episodes: DataFrame, done: DataFrame, limit: int | None = None) -> DataFrame:
    """Episodes to work on: kept or in review, not done yet."""
    todo = episodes.filter(F.col("episode_status").isin("keep", "review")).join(done.select("source_key"), "source_key", "left_anti")
    return todo.orderBy("source_key").limit(limit) if limit else todo


def label(answers: DataFrame, low_confidence: float = L.LOW_CONFIDENCE, wanted: DataFrame | None = None, storyboards: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(labels, review rows) of model answers; of ``wanted`` intervals those without one of ``storyboards`` go to review."""
    good, failed = L.parse_answers(answers)
    parts = [label_reviews(good, low_confidence), failed.select(F.lit("label").alias("stage"), F.col("interval_id").alias("identifier"), "reason")]
    if wanted is not None and storyboards is not None:
        parts.append(reviews("label", wanted.join(storyboards.select("interval_id"), "interval_id", "left_anti"), "missing_storyboard", "interval_id"))
    return good, V.review_queue(*parts)


def label_reviews(labels: DataFrame, low_confidence: float = L.LOW_CONFIDENCE) -> DataFrame:
    """Labels that a person has to look at."""
    return reviews("label", labels.filter((F.col("confidence") < low_confidence) | ~F.col("is_manipulation")), "low_confidence_or_non_manipulation", "interval_id")


def proxy_reviews(proxies: DataFrame) -> DataFrame:
    """Review rows of proxies (interval_id, details) that could not be made."""
    return V.review_queue(reviews("proxies", proxies.filter("details is not null"), "proxy_generation_failed", "interval_id"))


def materialize(episodes: DataFrame, intervals_: DataFrame, labels: DataFrame, buckets: DataFrame, mapping: DataFrame, overrides: dict[str, DataFrame], path: str | None = None) -> dict[str, DataFrame]:
    """The effective tables: machine rows under the review overrides of :func:`workspace.read_overrides`.

    With ``path`` they are written there as JSON lines, each in its order.
    """
    effective = {
        "effective_episodes": V.effective_episodes(episodes, overrides["episodes"]), "effective_intervals": V.effective_intervals(intervals_, overrides["intervals"]),
        "effective_labels": V.effective_labels(labels, overrides["labels"]),
    }
    effective["effective_buckets"] = V.effective_buckets(effective["effective_labels"], buckets, mapping, overrides["renames"], overrides["assignments"])
    for name, df in effective.items() if path else ():
        W.write_jsonl(df.orderBy("bucket_id") if name == "effective_buckets" else W.in_order(df, name), f"{path}/{name}.jsonl")
    return effective


def segments(frames: DataFrame, index: DataFrame, recordings: DataFrame, effective: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(manifest, byte plan, review rows) of the intervals to export.

    An interval without length, or whose range holds no frame, goes to review.
    """
    usable, bad = V.exportable_segments(effective["effective_intervals"], effective["effective_episodes"])
    usable = written(usable, "segments")
    wanted = usable.select("source_key", F.col("interval_id").alias("id"), F.col("effective_start_s").alias("start_s"), F.col("effective_end_s").alias("end_s"))
    ranges, plan = clip(frames, index, recordings, wanted)
    failed = ranges.filter("error is not null").select(F.col("id").alias("interval_id"), "error")
    manifest = usable.join(failed, "interval_id", "left_anti").withColumn("segment_path", F.concat(F.lit("segments/"), "interval_id"))
    return manifest, plan, V.review_queue(bad, reviews("segments", failed, "segment_export_failed", "interval_id"))


def cluster(labels: DataFrame, intervals_: DataFrame, episodes: DataFrame, vectors: DataFrame | None = None, threshold: float = L.SIMILAR) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(buckets, mapping, review rows) of active labels: by name, or by similarity of their vectors.

    ``vectors``: interval_id, vec_id, embedding. Labels without a vector are grouped by name.
    """
    active = V.active_labels(labels, intervals_, episodes)
    if vectors is None:
        return L.buckets(active)
    # each is read by several jobs below
    active = written(active, "active")
    acted = active.filter("is_manipulation").select("interval_id", "normalized_task_name")
    mine = written(vectors.filter("embedding is not null").join(acted, "interval_id", "left_semi"), "vectors")
    groups = L.connected_components(mine.select(F.col("vec_id").alias("id")), L.similar_links(mine, threshold)).withColumnRenamed("id", "vec_id")
    found = mine.select("interval_id", "vec_id").join(groups, "vec_id").select("interval_id", F.concat(F.lit("vector "), "component").alias("component"))
    rest = acted.join(mine, "interval_id", "left_anti").select("interval_id", F.concat(F.lit("name "), "normalized_task_name").alias("component"))
    return L.buckets(active, found.unionByName(rest))


def clip(frames: DataFrame, index: DataFrame, recordings: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frame ranges with errors, byte plan) of intervals (source_key, id, start_s, end_s)."""
    t = frames.join(recordings.select("source_key", "start_timestamp_us"), "source_key")
    ranges = P.frame_ranges(t.select("source_key", "idx", S.relative_s(F.col("timestamp_us"), F.col("start_timestamp_us")).alias("t")), wanted)
    return ranges, P.clip_byte_plan(index, ranges)


def prune(manifest: DataFrame, analysis: DataFrame, threshold: float | None = None, log: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(manifest that stays, audit rows); with ``log`` the audit is added there."""
    return _logged(C.manifest_prune(manifest, analysis, threshold), log)


def splice(manifest: DataFrame, segs: DataFrame, recordings: DataFrame, log: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(manifest with recordings replaced by their segments, audit rows)."""
    return _logged(C.manifest_splice(manifest, C.splice_plan(segs, recordings)), log)


def restore(manifest: DataFrame, episodes: DataFrame, log: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(manifest with pruned episodes back in it, audit rows)."""
    return _logged(C.manifest_restore(manifest, episodes), log)


def _logged(both: tuple[DataFrame, DataFrame], log: str | None) -> tuple[DataFrame, DataFrame]:
    if log:
        W.append_audit(both[1], log)
    return both


def dataset_info(manifest: DataFrame) -> DataFrame:
    """(dataset, episodes, frames, duration_s and their texts) of manifests."""
    total = C.dataset_totals(manifest)
    return total.withColumn("duration", S.human_duration(F.col("duration_s")))


def upload_status(objects: DataFrame, uploads: DataFrame, now: Column, datasets: DataFrame | None = None) -> dict[str, DataFrame]:
    """pending files, oldest first; files and bytes by dataset; failed uploads with their delay; files in no dataset."""
    pending = C.pending_uploads(objects, uploads, now)
    out = {"pending": C.oldest_first(pending), "datasets": C.dataset_sync_status(objects, pending), "retries": C.retry_due(uploads, now)}
    return out | ({"loose": C.loose_pending(pending, datasets)} if datasets is not None else {})


def export_rlds(recordings: DataFrame, frames: DataFrame, path: str, dataset: str = "ego_recording", description: str = "") -> None:
    """{path}/{dataset}/1.0.0: a TFRecord file of steps per episode, dataset_info.json and features.json."""
    spark = recordings.sparkSession
    spark.dataSource.register(TFRecordSink)
    steps = C.rlds_steps(recordings, frames)
    numbered = ranked(frames.select("source_key").distinct(), [F.col("source_key")], "episode_index")
    n = numbered.count()
    rows = C.rlds_examples(steps, numbered, n).repartition("file").sortWithinPartitions("file", "step").drop("step")
    rows.write.format("tfrecord").option("file", "file").mode("append").save(f"{path}/{dataset}")
    base = f"{path}/{dataset}/{C.RLDS_VERSION}"
    splits = {"train": {"name": "train", "num_examples": n}}
    W.put_json(spark, f"{base}/dataset_info.json", {"name": dataset, "description": description, "version": C.RLDS_VERSION, "splits": splits})
    W.put_json(spark, f"{base}/features.json", C.rlds_features())


def export_lerobot(recordings: DataFrame, frames: DataFrame, path: str, depth: DataFrame | None = None, dataset: str | None = None, name: str | None = None, separate: bool = False, fps: int = 30) -> None:
    """Datasets of frames below ``path``: a Parquet file per episode, and the files info.json, episodes.jsonl and tasks.jsonl.

    All recordings go into one dataset, or with ``separate`` each name into one of its own; all of them are written by one
    job for the rows and one for the metadata, however many they are.
    """
    spark = recordings.sparkSession
    for sink in (ParquetFileSink, TextFileSink):
        spark.dataSource.register(sink)
    names = C.dataset_name(recordings, dataset, name, separate)
    names = names if separate else names.withColumn("dataset_name", F.lit("."))
    mine = frames.join(names.select("source_key"), "source_key", "left_semi")
    rows = C.lerobot_rows(recordings, mine, depth, names).withColumn("file", F.concat_ws("/", "dataset_name", C.lerobot_file(F.col("episode_index"))))
    episodes = written(rows.groupBy("dataset_name", "episode_index").agg(F.count(F.lit(1)).alias("length")), "episodes")
    data = rows.repartition("file").sortWithinPartitions("file", "frame_index").drop("step", "dataset_name")
    meta = C.lerobot_meta(episodes, fps).repartition("file").sortWithinPartitions("file", "place").drop("place")
    for form, part in (("parquetfile", data), ("textfile", meta)):
        part.write.format(form).option("file", "file").mode("append").save(path)


def publish(tables: dict[str, DataFrame], prefix: str) -> None:
    """Derived tables as JSON lines below a prefix, each under its key."""
    for relative, df in tables.items():
        W.write_jsonl(df, f"{prefix.rstrip('/')}/{relative}")


def publish_keys(relative: DataFrame, prefix: str) -> DataFrame:
    """(relative, key, content_type) of derived files below a prefix."""
    kind = F.when(F.endswith("relative", F.lit(".jsonl")), "application/x-ndjson").when(F.endswith("relative", F.lit(".json")), "application/json").otherwise("application/octet-stream")
    return relative.select("relative", S.object_key(prefix, F.col("relative")).alias("key"), kind.alias("content_type"))
