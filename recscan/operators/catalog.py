"""Dataset manifests, their audit log, upload state, and the tables of training exports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recscan.functions import scalars as S
from recscan.operators.ranks import ranked

# ---- manifests ----------------------------------------------------------------------------


def manifest_add(manifest: DataFrame, episodes: DataFrame) -> DataFrame:
    """Episodes added by filename; those already there stay as they are, so adding twice is once."""
    fresh = episodes.dropDuplicates(["filename"]).join(manifest.select("filename"), "filename", "left_anti")
    return manifest.unionByName(fresh.select(*manifest.columns))


def manifest_restore(manifest: DataFrame, episodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(manifest with pruned episodes back in it, audit rows); those already there are left alone."""
    fresh = episodes.join(manifest.select("filename"), "filename", "left_anti").dropDuplicates(["filename"])
    audit = fresh.select(F.lit("restore").alias("op"), F.concat(F.lit(".pruned/"), "filename").alias("source"), F.col("filename").alias("destination"))
    return manifest_add(manifest, episodes), audit


def manifest_remove(manifest: DataFrame, names: DataFrame) -> DataFrame:
    return manifest.join(names.select("filename"), "filename", "left_anti")


def prune_predicate(verdict: Column, score: Column, threshold: float | None) -> Column:
    """Confident verdicts go; suggested ones if no threshold is given, or the score is below it."""
    low = F.lit(True) if threshold is None else score < threshold
    return (verdict == "PRUNE_CONFIDENT") | ((verdict == "PRUNE_SUGGESTED") & low)


def manifest_prune(manifest: DataFrame, analysis: DataFrame, threshold: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(what stays, audit rows): ``analysis`` has filename, verdict, activity_score."""
    gone = analysis.filter(prune_predicate(F.col("verdict"), F.col("activity_score"), threshold))
    audit = gone.join(manifest.select("filename"), "filename", "left_semi").select(F.lit("prune").alias("op"), "filename", "verdict", "activity_score")
    return manifest_remove(manifest, gone), audit


def splice_plan(segments: DataFrame, recordings: DataFrame) -> DataFrame:
    """(source_key, filename, start_frame, end_frame): segments as files named by their order.

    A recording whose one segment is all of it is left alone.
    """
    w = Window.partitionBy("source_key")
    n = segments.withColumns({"k": F.count(F.lit(1)).over(w), "i": F.row_number().over(w.orderBy("start_frame")) - 1}).join(recordings.select("source_key", F.col("total_frames").alias("all_frames")), "source_key")
    whole = (F.col("k") == 1) & (F.col("start_frame") == 0) & (F.col("end_frame") == F.col("all_frames"))
    stem = F.regexp_replace(F.element_at(F.split("source_key", "/"), -1), r"\.[^.]*$", "")
    return n.filter(~whole).select("source_key", F.concat(stem, F.lit("_seg"), F.lpad(F.col("i").cast("string"), 3, "0"), F.lit(".rec")).alias("filename"), "start_frame", "end_frame")


def manifest_splice(manifest: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(manifest with each spliced recording replaced by its segments, audit rows)."""
    parents = plan.select(F.element_at(F.split("source_key", "/"), -1).alias("filename")).distinct()
    stay = manifest_remove(manifest, parents)
    added = manifest_add(stay, plan.select("filename", (F.col("end_frame") - F.col("start_frame")).alias("frames"), *[F.lit(None).alias(c) for c in manifest.columns if c not in ("filename", "frames")]))
    return added, plan.select(F.lit("splice").alias("op"), "filename", "start_frame", "end_frame")


def dataset_totals(episodes: DataFrame, by: str = "dataset") -> DataFrame:
    return episodes.groupBy(by).agg(F.sum("duration_s").alias("duration_s"), F.sum("frames").alias("frames"), F.count(F.lit(1)).alias("episodes"))


def next_session(names: DataFrame, dataset: str) -> DataFrame:
    """One row: the next name {dataset}_NNN after the largest number in use; _000 if none is."""
    rest = F.substring("session_name", len(dataset) + 2, 1000)
    number = F.when(F.startswith("session_name", F.lit(f"{dataset}_")), F.regexp_extract(rest, r"^(\d+)", 1).try_cast("int"))
    text = (F.coalesce(F.max(number), F.lit(-1)) + 1).cast("string")
    return names.agg(text.alias("k")).select(F.concat(F.lit(f"{dataset}_"), F.lpad("k", F.greatest(F.lit(3), F.length("k")), F.lit("0"))).alias("session_name"))


# ---- upload state -------------------------------------------------------------------------


def pending_uploads(objects: DataFrame, uploads: DataFrame, now: Column, settle_s: int = 10, min_bytes: int = 1024, dataset: str | None = None) -> DataFrame:
    """Objects to upload: not pruned, large and settled enough, not uploaded. Order by mtime to act."""
    done = uploads.filter("success").select("filename")
    age = F.unix_micros(now) - F.unix_micros(F.col("mtime").cast("timestamp"))
    ok = ~F.array_contains(F.split("key", "/"), ".pruned") & (F.col("size_bytes") >= min_bytes) & (age >= settle_s * 1_000_000)
    ok = ok & (F.col("dataset") == dataset) if dataset else ok
    return objects.filter(ok).join(done, "filename", "left_anti")


def oldest_first(pending: DataFrame, limit: int | None = None) -> DataFrame:
    """Pending files in the order in which they are uploaded."""
    rows = pending.orderBy("mtime", "key")
    return rows.limit(limit) if limit else rows


def loose_pending(pending: DataFrame, datasets: DataFrame) -> DataFrame:
    """One row: pending files, and their bytes, that lie in no known dataset."""
    loose = pending.join(datasets.select("dataset").distinct(), "dataset", "left_anti")
    return loose.agg(F.count(F.lit(1)).alias("loose_count"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("loose_size"))


def upload_session(uploads: DataFrame, by: str) -> DataFrame:
    """(by, files, bytes, elapsed_s, wall_s, average_rate) of upload cycles.

    ``uploads``: by, size_bytes, started and ended in seconds. The rate counts the time spent on
    files, not the time between them.
    """
    spent = F.sum(F.col("ended") - F.col("started"))
    out = uploads.groupBy(by).agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"), spent.alias("elapsed_s"), (F.max("ended") - F.min("started")).alias("wall_s"))
    return out.withColumn("average_rate", F.when(F.col("elapsed_s") > 0, F.col("bytes") / F.col("elapsed_s")).otherwise(0.0))


def dataset_sync_status(objects: DataFrame, pending: DataFrame) -> DataFrame:
    """(dataset, files, total_size, pending_count, pending_size)."""
    kept = objects.filter(~F.array_contains(F.split("key", "/"), ".pruned"))
    total = kept.groupBy("dataset").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("total_size"))
    todo = pending.groupBy("dataset").agg(F.count(F.lit(1)).alias("pending_count"), F.sum("size_bytes").alias("pending_size"))
    return total.join(todo, "dataset", "left").na.fill(0, ["pending_count", "pending_size"])


def retry_due(uploads: DataFrame, now: Column) -> DataFrame:
    """Failed uploads with their delay, and whether it has passed since the last attempt."""
    wait = S.retry_delay(F.col("attempts"))
    past = (F.unix_micros(now) - F.unix_micros(F.col("last_attempt").cast("timestamp"))) / 1e6
    return uploads.filter(~F.col("success")).select("filename", "attempts", wait.alias("delay_s"), (past >= wait).alias("due"))


def archive_plan(objects: DataFrame, uploads: DataFrame, archived: DataFrame | None = None, stamp: Column | None = None) -> DataFrame:
    """(key, size_bytes, action, target): files that were not uploaded are copied before all are deleted.

    ``archived`` has the keys that the archive holds; a file of such a key is copied beside it, under
    a name with ``stamp``, and under one with its own hash too where that is taken as well.
    """
    done = uploads.filter("success").select("filename", F.lit(True).alias("_up")).dropDuplicates(["filename"])
    rows = objects.join(done, "filename", "left").select("key", "size_bytes", F.when(F.col("_up"), "delete").otherwise("copy_and_delete").alias("action"))
    if archived is None:
        return rows.withColumn("target", F.when(F.col("action") == "copy_and_delete", F.col("key")))
    held = archived.select(F.col("key").alias("_held"), F.lit(True).alias("_taken")).distinct()
    stem, end = F.regexp_replace("key", r"\.[^./]*$", ""), F.regexp_extract("key", r"(\.[^./]*)$", 1)
    at = F.date_format(F.current_timestamp() if stamp is None else stamp, "yyyyMMdd_HHmmss")
    beside = rows.withColumns({"_beside": F.concat(stem, F.lit("_"), at, end), "_further": F.concat(stem, F.lit("_"), at, F.lit("_"), F.substring(F.sha1("key"), 1, 8), end)})
    first = beside.join(held.withColumnRenamed("_taken", "_first"), F.col("key") == F.col("_held"), "left").drop("_held")
    both = first.join(held.withColumnRenamed("_taken", "_second"), F.col("_beside") == F.col("_held"), "left").drop("_held")
    free = F.when(F.col("_first").isNull(), F.col("key")).when(F.col("_second").isNull(), F.col("_beside")).otherwise(F.col("_further"))
    return both.select("key", "size_bytes", "action", F.when(F.col("action") == "copy_and_delete", free).alias("target"))


def upload_rates(progress: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """progress (id, ts_s, bytes so far) with interval and average rates; with ``totals`` (id, total
    bytes) also percent and eta_s, the time that is left at the average rate.
    """
    w = Window.partitionBy("id").orderBy("ts_s")
    dt, db = F.col("ts_s") - F.lag("ts_s").over(w), F.col("bytes") - F.lag("bytes").over(w)
    since = F.col("ts_s") - F.min("ts_s").over(Window.partitionBy("id"))
    rates = progress.select("id", "ts_s", "bytes", F.when(dt > 0, db / dt).otherwise(0.0).alias("rate"), F.when(since > 0, F.col("bytes") / since).otherwise(0.0).alias("average_rate"))
    if totals is None:
        return rates
    percent = F.when(F.col("total") > 0, F.col("bytes") / F.col("total") * 100).otherwise(0.0)
    left = F.when(F.col("average_rate") > 0, (F.col("total") - F.col("bytes")) / F.col("average_rate")).otherwise(0.0)
    return rates.join(totals.select("id", "total"), "id").withColumns({"percent": percent, "eta_s": left}).drop("total")


# ---- exports ------------------------------------------------------------------------------


def _steps(frames: DataFrame) -> DataFrame:
    w = Window.partitionBy("source_key")
    return frames.withColumns({"step": F.row_number().over(w.orderBy("idx")) - 1, "steps": F.count(F.lit(1)).over(w)})


def _intrinsics(camera: str) -> Column:
    return F.array(*[F.col(f"{camera}.{k}").cast("float") for k in ("fx", "fy", "ppx", "ppy")])


def rlds_steps(recordings: DataFrame, frames: DataFrame) -> DataFrame:
    """One row per step: timestamp, is_first, is_last, is_terminal, with its episode's metadata.

    Where ``recordings`` has the columns depth, color, rotation and translation, steps have
    depth_intrinsics, color_intrinsics (fx, fy, ppx, ppy), extrinsic_R and extrinsic_t; where
    ``frames`` has image or depth, encoded bytes, steps have those.
    """
    cameras = [_intrinsics(c).alias(f"{c}_intrinsics") for c in ("depth", "color") if c in recordings.columns]
    moves = [F.col(c).alias(a) for c, a in (("rotation", "extrinsic_R"), ("translation", "extrinsic_t")) if c in recordings.columns]
    meta = recordings.select("source_key", "session_name", "camera_serial", "start_timestamp_us", *cameras, *moves)
    images = [c for c in ("image", "depth") if c in frames.columns]
    last = F.col("step") == F.col("steps") - 1
    return _steps(frames).join(meta, "source_key").select(
        "source_key", "session_name", "camera_serial", "step", S.relative_s(F.col("timestamp_us"), F.col("start_timestamp_us")).alias("timestamp"),
        (F.col("step") == 0).alias("is_first"), last.alias("is_last"), last.alias("is_terminal"), *meta.columns[4:], *images,
    )


# Names and layout of the two training formats.
RLDS_VERSION, RLDS_FILE = "1.0.0", "ego_recording-train.tfrecord-{:05d}-of-{:05d}"
TASK, CHUNK = "ego_recording", 1000
_TFDS = "tensorflow_datasets.core.features."


def _tfds(kind: str, **more) -> dict:
    return {"pythonClassName": _TFDS + kind, **more}


def rlds_features(width: int = 640, height: int = 480) -> dict:
    """The description of a step and of an episode's metadata."""
    nested = lambda features: _tfds("features_dict.FeaturesDict", featuresDict={"features": features})
    image = lambda channels, dtype, form: _tfds("image_feature.Image", image={"shape": {"dimensions": [height, width, channels]}, "dtype": dtype, "encodingFormat": form})
    tensor = lambda *shape: _tfds("tensor_feature.Tensor", tensor={"shape": {"dimensions": list(shape)}, "dtype": "float32"})
    scalar = lambda dtype: _tfds("scalar.Scalar", tensor={"shape": {}, "dtype": dtype})
    text = _tfds("text_feature.Text", text={})
    seen = nested({
        "image": image(3, "uint8", "jpeg"), "depth": image(1, "uint16", "png"), "depth_intrinsics": tensor(4), "color_intrinsics": tensor(4), "extrinsic_R": tensor(3, 3), "extrinsic_t": tensor(3),
    })
    step = nested({"observation": seen, "timestamp": scalar("float64"), "is_first": scalar("bool"), "is_last": scalar("bool"), "is_terminal": scalar("bool")})
    meta = {"file_path": text, "session_name": text, "duration_s": scalar("float64"), "dataset_name": text, "dataset_description": text}
    return nested({"steps": _tfds("dataset_feature.Dataset", sequence={"feature": step}), "episode_metadata": nested(meta)})


def rlds_examples(steps: DataFrame, numbered: DataFrame, episodes: int) -> DataFrame:
    """Steps with the names of the format, and file, that of their episode; ``numbered``: source_key, episode_index."""
    observed = ("image", "depth", "depth_intrinsics", "color_intrinsics", "extrinsic_R", "extrinsic_t")
    names = {c: f"steps/observation/{c}" for c in observed if c in steps.columns} | {c: f"steps/{c}" for c in ("is_first", "is_last", "is_terminal")}
    number = lambda c: F.lpad(c.cast("string"), F.greatest(F.lit(5), F.length(c.cast("string"))), F.lit("0"))
    prefix = RLDS_FILE.split("{")[0]
    file = F.concat(F.lit(f"{RLDS_VERSION}/{prefix}"), number(F.col("episode_index")), F.lit("-of-"), number(F.lit(episodes)))
    return steps.join(numbered.select("source_key", "episode_index"), "source_key").select(
        file.alias("file"), "step", F.col("timestamp").cast("float").alias("steps/timestamp"), *[F.col(c).alias(n) for c, n in names.items()]
    )


def lerobot_rows(recordings: DataFrame, frames: DataFrame, depth: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """One row per frame: global frame_index, episode_index, frame in episode, timestamp, task_index.

    Episodes are numbered by key; a frame's global index is the length of earlier episodes plus
    its own place, so that no window spans all frames. With ``depth`` (source_key, idx, depth: array
    of millimetres) rows have observation.depth_mm. With ``names`` (source_key, dataset_name) each dataset
    counts for itself, and rows have its name first.
    """
    sizes = frames.groupBy("source_key").agg(F.count(F.lit(1)).alias("length"))
    order, named = [F.col("source_key")], []
    if names is not None:
        sizes, order, named = sizes.join(names.select("source_key", "dataset_name"), "source_key"), [F.col("dataset_name"), F.col("source_key")], ["dataset_name"]
    numbered = ranked(sizes, order, "episode_index", "length").withColumnRenamed("length_before", "before").drop("length")
    if names is not None:
        firsts = numbered.groupBy("dataset_name").agg(F.min("episode_index").alias("_e"), F.min("before").alias("_b"))
        numbered = numbered.join(firsts, "dataset_name").withColumns({"episode_index": F.col("episode_index") - F.col("_e"), "before": F.col("before") - F.col("_b")}).drop("_e", "_b")
    rows = _steps(frames).join(numbered, "source_key").join(recordings.select("source_key", "start_timestamp_us"), "source_key")
    seen = []
    if depth is not None:
        rows = rows.join(depth.select("source_key", "idx", "depth"), ["source_key", "idx"], "left")
        seen = [F.transform("depth", lambda x: x.cast("float")).alias("observation.depth_mm")]
    return rows.select(
        *named, (F.col("before") + F.col("step")).alias("frame_index"), F.col("episode_index").cast("long").alias("episode_index"), F.col("step").cast("long").alias("step"),
        S.relative_s(F.col("timestamp_us"), F.col("start_timestamp_us")).cast("float").alias("timestamp"), *seen, F.lit(0).cast("long").alias("task_index"),
    )


def dataset_name(recordings: DataFrame, dataset: str | None = None, name: str | None = None, separate: bool = False) -> DataFrame:
    """(source_key, dataset_name): the dataset's, else the given name, else the session's, else a default.

    All recordings are one dataset, whose session is that of the first by key; with ``separate`` each
    is one of its own, and the default is its file's name.
    """
    session = F.nullif("session_name", F.lit(""))
    stem = F.regexp_replace(F.element_at(F.split("source_key", "/"), -1), r"\.[^.]*$", "")
    given = F.lit(dataset or name).cast("string")
    if separate:
        return recordings.select("source_key", F.coalesce(given, session, stem).alias("dataset_name"))
    # one value
    first = recordings.agg(F.min_by(F.struct(session.alias("s")), "source_key")["s"]).first()[0]
    return recordings.select("source_key", F.coalesce(given, F.lit(first).cast("string"), F.lit(TASK)).alias("dataset_name"))


def lerobot_episodes(rows: DataFrame) -> DataFrame:
    """(episode_index, tasks, length) of each episode."""
    return rows.groupBy("episode_index").agg(F.count(F.lit(1)).alias("length")).select("episode_index", F.array(F.lit(TASK)).alias("tasks"), "length")


def lerobot_info(episodes: int, frames: int, fps: int = 30, width: int = 640, height: int = 480) -> dict:
    """The description of a dataset."""
    video = {"video.fps": fps, "video.codec": "av1", "video.pix_fmt": "yuv420p", "video.is_depth_map": False, "has_audio": False}
    return {
        "codebase_version": "v3.0", "robot_type": "realsense_d435", "fps": fps, "total_episodes": episodes, "total_frames": frames, "total_tasks": 1, "total_chunks": max(1, -(-episodes // CHUNK)), "chunks_size": CHUNK,
        "features": {
            "observation.images.rgb": {"dtype": "video", "shape": [height, width, 3], "names": ["height", "width", "channel"], "video_info": video},
            "observation.depth_mm": {"dtype": "float32", "shape": [height, width], "names": ["height", "width"]},
        },
        "data_path": "data/chunk-{chunk_index:03d}/episode_{episode_index:06d}.parquet", "video_path": "videos/chunk-{chunk_index:03d}/{video_key}_episode_{episode_index:06d}.mp4",
    }


def lerobot_meta(episodes: DataFrame, fps: int = 30) -> DataFrame:
    """(file, place, value): the lines of each dataset's metadata, from (dataset_name, episode_index, length)."""
    line = F.to_json(F.struct("episode_index", F.array(F.lit(TASK)).alias("tasks"), "length"))
    folder = F.concat("dataset_name", F.lit("/meta/"))
    of = lambda rows, name, place, value: rows.select(F.concat(folder, F.lit(name)).alias("file"), place.cast("long").alias("place"), value.alias("value"))
    totals = episodes.groupBy("dataset_name").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("frames"))
    text = F.lit(json.dumps(lerobot_info(1, 1, fps), indent=2, sort_keys=True))
    for name, value in (("episodes", F.col("n")), ("frames", F.col("frames")), ("chunks", F.greatest(F.lit(1), F.ceil(F.col("n") / CHUNK)))):
        text = F.regexp_replace(text, F.lit(f'"total_{name}": \\d+'), F.concat(F.lit(f'"total_{name}": '), value.cast("string")))
    tasks = F.lit(json.dumps({"task": TASK, "task_index": 0}))
    return of(episodes, "episodes.jsonl", F.col("episode_index"), line).unionByName(of(totals, "info.json", F.lit(0), text)).unionByName(of(totals, "tasks.jsonl", F.lit(0), tasks))


def lerobot_file(episode: Column) -> Column:
    """Where an episode's rows lie, by chunks of CHUNK episodes."""
    number = lambda c, n: F.lpad(c.cast("string"), F.greatest(F.lit(n), F.length(c.cast("string"))), F.lit("0"))
    return F.concat(F.lit("data/chunk-"), number(F.floor(episode / CHUNK), 3), F.lit("/episode_"), number(episode, 6), F.lit(".parquet"))


def gap_classes(frames: DataFrame, soft_us: int = 500_000, hard_us: int = 1_000_000, by: str = "source_key") -> DataFrame:
    """Frames with gap_us, gap_class (same, split, disconnect) and session, counted per key."""
    w = Window.partitionBy(by).orderBy("timestamp_us", "idx")
    gap = F.col("timestamp_us") - F.lag("timestamp_us").over(w)
    kind = F.when(F.coalesce(gap, F.lit(0)) <= soft_us, "same").when(gap <= hard_us, "split").otherwise("disconnect")
    out = frames.select(by, "idx", "timestamp_us", F.coalesce(gap, F.lit(0)).alias("gap_us"), kind.alias("gap_class"))
    return out.withColumn("session", F.sum(F.when(F.col("gap_class") == "same", 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def depth_range(frames: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """(frame, d_min, d_max): depths at which the histogram of non-zero values reaches both shares."""
    counted = frames.select("frame", F.explode("depth").alias("d")).filter("d > 0").groupBy("frame", "d").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("frame")
    cum = counted.select("frame", "d", F.sum("c").over(w.orderBy("d")).alias("upto"), F.sum("c").over(w).alias("n"))
    at = lambda s: F.min(F.when(F.col("upto") >= F.col("n") * s, F.col("d")))
    return cum.groupBy("frame").agg(at(low).alias("d_min"), at(high).alias("hi")).select("frame", "d_min", F.greatest("hi", F.col("d_min") + 1).alias("d_max"))
