"""Files of the curation workspace: JSON lines, reports, dumps, manifests, overrides, profiles, sidecars."""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recscan.operators.review import upsert

#: The order in which tables are written: by key, source, place and so on.
ORDERS = {
    "inventory": ["key"], "episodes": ["source_key"], "intervals": ["source_key", "start_s", "end_s"], "labels": ["interval_id"], "review_queue": ["review_id"],
    "effective_episodes": ["episode_id"], "effective_intervals": ["source_key", "start_s"], "effective_labels": ["interval_id"], "segments": ["interval_id"],
}


def in_order(df: DataFrame, table: str) -> DataFrame:
    """A table in its output order."""
    return df.orderBy(*ORDERS[table])


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, the fields of each in order of their names; mode append adds to what is there."""
    df.select(*sorted(df.columns)).write.mode(mode).option("ignoreNullFields", False).json(path)


def upsert_jsonl(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], order_col: str | None = None) -> None:
    """Merge rows by key into JSON lines, which come out ordered by the keys as text; a missing file is empty.

    The old table is kept beside as ``.before`` until the new one is in place; one that a crash left there is put back first.
    """
    from recscan.sources.tables import read_jsonl

    system, target = _system(spark, path)
    left = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.before")
    if system.exists(left) and not system.exists(target):
        system.rename(left, target)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != order_col)
    merged = upsert(read_jsonl(spark, path, schema), rows, keys, order_col)
    # a folder cannot be read and replaced at once: it is written beside, then changes places with the old one
    merged = merged.drop(*([order_col] if order_col else [])).orderBy(*(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys))
    beside, before = f"{path}.{uuid.uuid4().hex}.new", f"{path}.before"
    write_jsonl(merged, beside)
    system, target = _system(spark, path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    if system.exists(target):
        system.delete(hadoop(before), True)
        system.rename(target, hadoop(before))
    system.rename(hadoop(beside), target)
    system.delete(hadoop(before), True)


def write_report(results: DataFrame, path: str) -> None:
    """Analysis results as one JSON array, in a file of that name: an object a line, fields in order of their names.

    Lines are made, sorted and written by tasks; their files are then copied behind one another, as bytes.
    """
    spark = results.sparkSession
    parts = f"{path}.{uuid.uuid4().hex}.parts"
    row = F.to_json(F.struct(*sorted(results.columns)), {"ignoreNullFields": "false"})
    results.orderBy("source_key").select(F.concat(F.lit(","), row)).write.text(parts)
    system, folder = _system(spark, parts)
    _, target = _system(spark, path)
    jvm = spark.sparkContext._jvm
    out, first = system.create(target, True), True
    out.write(bytearray(b"[\n"))
    for name in sorted(f.getPath().getName() for f in system.listStatus(folder) if f.getLen() and f.getPath().getName().startswith("part-")):
        part = system.open(jvm.org.apache.hadoop.fs.Path(folder, name))
        if first:
            part.skip(1)  # the comma before the first object
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
        part.close()
        first = False
    out.write(bytearray(b"]\n"))
    out.close()
    system.delete(folder, True)


def dump_features(rows: DataFrame, path: str, form: str = "csv") -> None:
    """Feature rows as CSV with a header, or as JSON lines."""
    if form == "csv":
        rows.write.mode("overwrite").option("header", True).csv(path)
    else:
        write_jsonl(rows, path)


def _system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """A small file that is there whole or not at all; False if there is one of that name, which then stays.

    It is written beside its place. On a local disk a link puts it there, elsewhere a rename that replaces
    nothing, which the file system must decide for one of several writers, as HDFS does.
    """
    system, target = _system(spark, path)
    jvm = spark.sparkContext._jvm
    beside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}.tmp")
    out = system.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if system.getScheme() == "file":
            os.link(beside.toUri().getPath(), target.toUri().getPath())
            return True
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(beside, target, options)
        return True
    except FileExistsError:
        return False
    except Py4JJavaError as failed:
        if "FileAlreadyExists" not in str(failed.java_exception):
            raise
        return False
    finally:
        if system.exists(beside):
            system.delete(beside, False)


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written beside its place and renamed over it."""
    system, target = _system(spark, path)
    jvm = spark.sparkContext._jvm
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = system.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(beside, target, options)


def put_json(spark: SparkSession, path: str, payload: dict) -> None:
    """A small JSON document."""
    _put(spark, path, json.dumps(payload, indent=2, sort_keys=True) + "\n")


class Conflict(Exception):
    """Another writer saved a version meanwhile."""


def manifest_version(spark: SparkSession, path: str) -> tuple[int, str] | None:
    """(number, folder) of the version of the manifests that holds, None before the first."""
    system, log = _system(spark, f"{path}/_versions")
    if not system.exists(log):
        return None
    names = [f.getPath().getName() for f in system.listStatus(log)]
    last = max((n for n in names if n.isdigit()), default=None)
    return None if last is None else (int(last), spark.read.text(f"{path}/_versions/{last}").first()[0])


def save_manifests(episodes: DataFrame, path: str, expected: int | None = None) -> int:
    """One manifest per dataset, as a new version beside the old ones; returns its number.

    ``episodes``: dataset, description, tags, created, filename, session_name, recorded_at, duration_s,
    frames. The version holds once its number is in the log of versions, which one of several writers gets; the
    others take the next ones. With ``expected``, the number that was read, a version saved meanwhile is a
    Conflict. A reader sees one version whole; what a crash leaves without a number is never read.
    """
    version = uuid.uuid4().hex
    one = F.struct("filename", "session_name", "recorded_at", "duration_s", "frames")
    rows = episodes.groupBy(F.col("dataset").alias("name")).agg(
        F.max("description").alias("description"), F.max("tags").alias("tags"), F.max("created").alias("created"), F.array_sort(F.collect_list(one)).alias("episodes")
    )
    spark = episodes.sparkSession
    rows.select(F.lit(1).alias("version"), "*").write.json(f"{path}/v-{version}")
    system, log = _system(spark, f"{path}/_versions")
    system.mkdirs(log)
    while True:
        held = manifest_version(spark, path)
        number = held[0] if held else 0
        if expected is not None and number != expected:
            raise Conflict(f"version {number} is there, {expected} was read")
        if put_if_absent(spark, f"{path}/_versions/{number + 1:020d}", version):
            return number + 1


def load_manifests(spark: SparkSession, path: str) -> DataFrame:
    """The episodes of the version of :func:`save_manifests` that holds."""
    from recscan.sources.tables import read_manifests

    held = manifest_version(spark, path)
    if held is None:
        raise FileNotFoundError(f"no version of manifests below {path}")
    return read_manifests(spark, f"{path}/v-{held[1]}", multiline=False)


def append_batch(rows: DataFrame, path: str, batch: str) -> None:
    """JSON lines of one batch, added to a folder: their files bear its id, and a repeated batch replaces its own.

    Written beside first. A crash leaves some files of the batch at most, which its repetition deletes.
    """
    spark = rows.sparkSession
    beside = f"{path.rstrip('/')}/_batches/{batch}"
    write_jsonl(rows, beside)
    system, folder = _system(spark, path)
    jvm = spark.sparkContext._jvm
    for old in system.listStatus(folder):
        if old.getPath().getName().startswith(f"batch-{batch}-part"):
            system.delete(old.getPath(), False)
    for new in system.listStatus(jvm.org.apache.hadoop.fs.Path(beside)):
        name = new.getPath().getName()
        if name.startswith("part-"):
            system.rename(new.getPath(), jvm.org.apache.hadoop.fs.Path(folder, f"batch-{batch}-{name}"))
    system.delete(jvm.org.apache.hadoop.fs.Path(beside), True)


def sink_id(spark: SparkSession, checkpoint: str) -> str:
    """The name of a stream's output, kept beside its checkpoint: with the number of a batch it is that batch's id."""
    system, place = _system(spark, f"{checkpoint}/sink_id")
    system.mkdirs(place.getParent())
    put_if_absent(spark, f"{checkpoint}/sink_id", uuid.uuid4().hex[:12])
    return spark.read.text(f"{checkpoint}/sink_id").first()[0]


def append_audit(rows: DataFrame, path: str, at: Column | None = None) -> None:
    """Audit rows, stamped, added to the log."""
    write_jsonl(rows.withColumn("timestamp", F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd'T'HH:mm:ssXXX")), path, "append")


PROFILE = "profile_key string, rgb_median double, rgb_mad double, depth_median double, depth_mad double, frame_count bigint, recording_count bigint"


def write_profiles(profiles: DataFrame, path: str) -> None:
    write_jsonl(profiles.orderBy("profile_key"), path)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    from recscan.sources.tables import read_jsonl

    return read_jsonl(spark, path, PROFILE)


_MAPS = "map<string,map<string,variant>>"
_OVERRIDES = f"version string, updated_at string, episodes {_MAPS}, intervals {_MAPS}, labels {_MAPS}, buckets struct<renames:map<string,string>,interval_assignments:{_MAPS}>"


def read_overrides(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Review overrides as tables: episodes, intervals, labels (id and o, the map of given fields as variants),
    renames (bucket_id, canonical_task_name) and assignments (interval_id, bucket_id,
    canonical_task_name). What the file leaves out, or a missing file, gives no rows.
    """
    try:
        raw = spark.read.text(path, wholetext=True).select(F.from_json("value", _OVERRIDES).alias("r"))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        raw = spark.createDataFrame([], f"r struct<{_OVERRIDES.replace(' ', ':').replace(',:', ',')}>")
    found = {}
    for part, name in (("episodes", "episode_id"), ("intervals", "interval_id"), ("labels", "interval_id")):
        found[part] = raw.select(F.explode(f"r.{part}").alias(name, "o"))
    found["renames"] = raw.select(F.explode("r.buckets.renames").alias("bucket_id", "canonical_task_name"))
    moves = raw.select(F.explode("r.buckets.interval_assignments").alias("interval_id", "o"))
    found["assignments"] = moves.select("interval_id", *[F.try_variant_get(F.col("o")[c], "$", "string").alias(c) for c in ("bucket_id", "canonical_task_name")])
    return found


UPLOADS = "array<struct<filename:string,size_bytes:bigint,attempts:int,success:boolean,last_attempt:timestamp>>"


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Uploads of a manifest document, one row each; a missing or broken one gives none."""
    try:
        raw = spark.read.text(path, wholetext=True)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        raw = spark.createDataFrame([], "value string")
    return raw.select(F.explode(F.from_json("value", f"struct<version:int,uploads:{UPLOADS}>")["uploads"]).alias("u")).select("u.*")


def sidecar(recordings: DataFrame, depth_max_mm: int = 4000) -> DataFrame:
    """(source_key, meta): the metadata document of each recording."""
    c = F.col
    cam = lambda d: F.struct(*[c(f"{d}.{k}").alias(k) for k in ("fx", "fy", "ppx", "ppy")], c(f"{d}.coeffs").alias("distortion_coeffs"), *([c("depth.scale").alias("scale")] if d == "depth" else []))
    duration = F.coalesce(c("duration_us") / 1e6, F.lit(0.0))
    meta = F.struct(
        c("source_key").alias("source_file"), "session_name", c("camera_serial").alias("serial_number"), "usb_type", c("color.width").alias("color_width"), c("color.height").alias("color_height"),
        c("depth.width").alias("depth_width"), c("depth.height").alias("depth_height"), F.when(duration > 0, c("total_frames") / duration).otherwise(0.0).alias("fps"), "total_frames", duration.alias("duration_s"),
        "start_timestamp_us", (c("flags").bitwiseAND(F.lit(1)) != 0).alias("has_imu"), F.lit(True).alias("has_depth"), "rgb_codec", "depth_codec", F.lit("turbo").alias("depth_colormap"),
        F.lit(depth_max_mm).alias("depth_max_mm"), F.struct(cam("color").alias("color"), cam("depth").alias("depth")).alias("intrinsics"), F.struct("rotation", "translation").alias("extrinsics"),
    )
    return recordings.select("source_key", F.to_json(meta).alias("meta"))


def write_sidecars(recordings: DataFrame, path: str) -> None:
    """The metadata document of each recording, in a file named as it with the extension .json."""
    from recscan.sources.recording import TextFileSink

    recordings.sparkSession.dataSource.register(TextFileSink)
    stem = F.regexp_replace(F.element_at(F.split("source_key", "/"), -1), r"\.[^.]*$", "")
    # recordings of one name in different folders keep their folder
    twice = F.count(F.lit(1)).over(Window.partitionBy(stem)) > 1
    place = F.when(twice, F.concat(F.regexp_replace(F.regexp_replace("source_key", r"\.[^./]*$", ""), r"^[a-z]*:?/+", ""), F.lit(".json"))).otherwise(F.concat(stem, F.lit(".json")))
    files = sidecar(recordings).select(place.alias("file"), F.col("meta").alias("value"))
    files.repartition("file").sortWithinPartitions("file").write.format("textfile").option("file", "file").mode("append").save(path)
