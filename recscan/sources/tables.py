"""Tables of the curation workspace in JSON lines, and the model slot."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version int, name string, description string, tags array<string>, created string, episodes array<struct<filename:string,session_name:string,recorded_at:string,duration_s:double,frames:bigint>>"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; a missing path gives no row, lines that are no object are left out."""
    try:
        raw = spark.read.text(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    parsed = raw.select(F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.filter("r is not null and r._bad is null").select("r.*").drop("_bad")


def read_manifests(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Episodes of dataset manifests, one row each, a dataset without episodes too. What does not parse gives none."""
    m = spark.read.schema(f"{MANIFEST}, _corrupt_record string").option("multiLine", multiline).json(path).filter("_corrupt_record is null")
    e = m.select(F.coalesce("version", F.lit(1)).alias("version"), F.coalesce("name", F.lit("")).alias("dataset"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.explode_outer("episodes").alias("e"))
    return e.select("version", "dataset", "tags", "e.*")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(start, end, label, source) of text lines; the label is manipulation unless given."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p"), F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("source"))
    number = lambda i: F.get("p", F.lit(i)).try_cast("bigint")
    return lines.select(number(0).alias("start"), number(1).alias("end"), F.coalesce(F.get("p", F.lit(2)), F.lit("manipulation")).alias("label"), "source").filter("start is not null and end is not null")


def list_objects(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(key, size_bytes, mtime) of files below a path; their content is not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(path)
    return found.select(F.col("path").alias("key"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"))


def file_sha256(spark: SparkSession, path: str, suffix: str, piece: int = 8 << 20) -> DataFrame:
    """(key, sha256) of files of any size: each is read in pieces, by the task it falls to."""
    keys = list_objects(spark, path, suffix).select("key", "size_bytes")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests = []
            for key in b["key"].to_pylist():
                system, name = fs.FileSystem.from_uri(key)
                digest = hashlib.sha256()
                with system.open_input_stream(name) as f:
                    while block := f.read(piece):
                        digest.update(block)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([b["key"], pa.array(digests)], ["key", "sha256"])

    return keys.select("key").mapInArrow(scan, "key string, sha256 string")


def enrich(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Rows through a model in batches: ``schema`` and details, the error of a batch that failed.

    A batch that raises is tried row by row, so that an error costs one row.
    """
    names = [c.split()[0].split(":")[0] for c in schema.split(",")]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            return fn(pdf).assign(details=None)
        except Exception as error:  # noqa: BLE001
            if len(pdf) > 1:
                return pd.concat([one(pdf.iloc[[i]]) for i in range(len(pdf))])
            return pdf.reindex(columns=names).assign(details=str(error))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from (one(b)[[*names, "details"]] for b in batches)

    return df.mapInPandas(scan, f"{schema}, details string")
