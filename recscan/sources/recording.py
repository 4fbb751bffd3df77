"""Recordings as a Spark data source, and episodes as sinks of one file each.

``spark.dataSource.register(RecordingSource)`` and then
``spark.read.format("recording").option("table", "frames").load(path)``. Tables:

* recordings - header and footer of each file, by range reads, and what is wrong with them;
* index - the index entries of each file;
* frames - the header of each frame block; payloads are skipped. A large file with an index is
  split into ranges of entries, one without is read in order by one task, or by :func:`read_blocks` by many;
* imu - the motion samples behind each frame's payload.

Option ``keys``, a JSON list of source keys, chooses the files before any is opened; ``since_us`` and ``until_us`` (exclusive) choose
entries of an index before blocks are read. The times of an index are taken to be those of its blocks, which
``plans.jobs.validate`` checks. With option ``pushdown`` (and ``spark.sql.python.filterPushdown.enabled``) filters on source_key and
timestamp_us do the same, but Spark keeps what a filter chose with the DataFrame, for all that is made from it: give such a
DataFrame one filter, and read anew for another. Option ``columns`` names the
columns to give; of recordings, the header, the footer and the checks of a file are read only if a column needs them.

``path`` is a file, or a folder whose files with the extension of option ``suffix`` are taken in
order. Planning only lists them; they are opened in tasks, through pyarrow's file systems. A file is
accepted by its structure, whatever its first bytes are, unless option ``magic`` names those.
"""

from __future__ import annotations

import contextlib
import json
import struct
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, Not,
    StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)

# Layout of the little-endian file format. Header, frame block, index entry, footer, motion sample.
HEADER = struct.Struct("<8sII32sfIIffffI5fIIffffI5f9f3f128sQ8sBBBB128s")
FRAME = struct.Struct("<IIQQIIHH")
INDEX = struct.Struct("<QQQ")
FOOTER = struct.Struct("<IQIQQI")
IMU = struct.Struct("<Qffffff")
FRAME_MAGIC, INDEX_MAGIC, FOOTER_MAGIC = 0x46524D45, 0x58444E49, 0x454E4F44
KEYFRAME_EVERY, VERSION = 30, 2
#: Rows of an Arrow batch that the source gives.
BATCH_ROWS = 8192

SCHEMAS = {
    "recordings": "source_key string, size_bytes long, magic string, version int, flags long, camera_serial string, session_name string, start_timestamp_us long, "
    "depth struct<scale:float,width:int,height:int,fx:float,fy:float,ppx:float,ppy:float,coeffs:array<float>>, "
    "color struct<width:int,height:int,fx:float,fy:float,ppx:float,ppy:float,coeffs:array<float>>, rotation array<float>, translation array<float>, "
    "usb_type string, rgb_codec int, depth_codec int, total_frames long, duration_us long, index_offset long, index_entries long, header_error string, footer_error string, file_errors array<string>, file_warnings array<string>",
    "index": "source_key string, entry long, timestamp_us long, file_offset long, frame_number long",
    "frames": "source_key string, idx long, frame_number long, timestamp_us long, rgb_size long, depth_size long, file_offset long, block_size long, imu_sample_count int, is_keyframe boolean",
    "imu": "source_key string, frame_number long, sample int, timestamp_us long, accel array<float>, gyro array<float>",
}


def _open(uri: str):
    system, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
    return system, path


open_uri = _open


def list_files(uri: str, suffix: str) -> list[tuple[str, int]]:
    """The files below a folder in order, or the file itself, with their sizes."""
    system, path = _open(uri)
    info = system.get_file_info(path)
    if info.type == fs.FileType.File:
        return [(uri, info.size)] if path.endswith(suffix) else []
    found = system.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted((uri.rstrip("/") + f.path[len(path.rstrip("/")) :], f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(suffix))


def _string(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("utf-8", "replace").strip()


def parse_header(raw: bytes) -> dict:
    if len(raw) < HEADER.size:
        return {"header_error": "file too small for a header"}
    v = HEADER.unpack(raw)
    f = lambda a, b: [float(x) for x in v[a:b]]
    return {
        "magic": v[0][:6].decode("latin-1"), "version": v[0][6], "flags": v[2], "camera_serial": _string(v[3]), "session_name": _string(v[41]), "start_timestamp_us": v[42],
        "depth": (v[4], *v[5:11], f(12, 17)), "color": (*v[17:23], f(24, 29)), "rotation": f(29, 38), "translation": f(38, 41),
        "usb_type": _string(v[43]), "rgb_codec": v[44], "depth_codec": v[45],
    }


def parse_footer(raw: bytes, size: int) -> dict:
    if len(raw) < FOOTER.size:
        return {"footer_error": "file too small for a footer"}
    magic, offset, entries, frames, duration, end = FOOTER.unpack(raw)
    if end != FOOTER_MAGIC or magic != INDEX_MAGIC:
        return {"footer_error": "bad footer or index magic"}
    if offset < HEADER.size or offset + entries * INDEX.size > size - FOOTER.size:
        return {"footer_error": "index out of bounds"}
    return {"total_frames": frames, "duration_us": duration, "index_offset": offset, "index_entries": entries}


#: Columns of recordings that the footer, or a check of the whole file, gives; the others come from the header or the listing.
FOOTER_COLUMNS = ("total_frames", "duration_us", "index_offset", "index_entries", "footer_error")
CHECK_COLUMNS = ("file_errors", "file_warnings")


def read_meta(f, size: int, header: bool = True, footer: bool = True) -> dict:
    found = {}
    if header:
        f.seek(0)
        found |= parse_header(f.read(HEADER.size))
    if footer:
        f.seek(max(0, size - FOOTER.size))
        found |= parse_footer(f.read(FOOTER.size), size)
    return found


def check_file(f, size: int, meta: dict, magic: str | None) -> dict:
    """file_errors and file_warnings: what a validation says of header, footer and first block.

    The messages are fixed values.
    """
    if "version" not in meta:
        return {"file_errors": [f"cannot read file header: {meta['header_error']}"], "file_warnings": []}
    errors, warnings = [], []
    if magic is not None and meta["magic"] != magic:
        errors.append("bad magic bytes")
    if meta["version"] != VERSION:
        errors.append(f"unsupported version: {meta['version']}")
    f.seek(max(0, size - FOOTER.size))
    raw = f.read(FOOTER.size)
    index_magic, offset, entries, _, _, end = FOOTER.unpack(raw) if len(raw) == FOOTER.size else (0,) * 6
    if size < HEADER.size + FOOTER.size:
        errors.append("file too small for header + footer")
    elif end != FOOTER_MAGIC:
        warnings.append("no valid footer \u2014 file may be truncated")
    else:
        if index_magic != INDEX_MAGIC:
            errors.append("bad index magic in footer")
        if offset < HEADER.size:
            errors.append(f"index_offset {offset} before end of file header")
        if offset + entries * INDEX.size > size - FOOTER.size:
            errors.append("index table overlaps footer")
        f.seek(HEADER.size)
        first = f.read(FRAME.size)
        if len(first) == FRAME.size and FRAME.unpack(first)[0] != FRAME_MAGIC:
            errors.append("first frame block has bad magic")
    return {"file_errors": errors, "file_warnings": warnings}


@dataclass
class Part(InputPartition):
    """One of ``of`` equal shares of a file's index; the first one reads a file without an index."""

    uri: str
    size: int
    share: int = 0
    of: int = 1


class RecordingReader(DataSourceReader):
    def __init__(self, options: dict, schema) -> None:
        self.path, self.table, self.schema = options["path"], options.get("table", "recordings"), schema
        if "suffix" not in options and not options["path"].rsplit("/", 1)[-1].count("."):
            raise ValueError("name the extension of recordings in option suffix")
        self.suffix, self.magic = options.get("suffix", ""), options.get("magic")
        self.share_bytes = int(options.get("bytespershare", 4 << 30))
        self.unindexed = options.get("unindexed", "walk")
        self.keys: list[Filter] = []
        self.only = frozenset(json.loads(options["keys"])) if "keys" in options else None
        bounds = [(op, int(options[k])) for op, k in ((">=", "since_us"), ("<", "until_us")) if k in options]
        self.times = Times(bounds if self.table in ("frames", "index") else [])

    def partitions(self) -> list[Part]:
        """Shares of files by their sizes, which the listing gives; no file is opened here."""
        files = [(u, n) for u, n in list_files(self.path, self.suffix) if (self.only is None or u in self.only) and all(_holds(k, u) for k in self.keys)]
        if self.table == "recordings":
            return [Part(u, n) for u, n in files]
        return [Part(u, n, k, of) for u, n in files for of in [max(1, -(-n // self.share_bytes))] for k in range(of)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        yield from _batches(self.rows(part), arrow_schema(self.schema))

    def rows(self, part: Part) -> Iterator[tuple]:
        system, path = _open(part.uri)
        with system.open_input_file(path) as f:
            if self.table == "recordings":
                yield self.recording(f, part)
                return
            meta = read_meta(f, part.size, header=False)
            n = meta.get("index_entries")
            entries = range(n * part.share // part.of, n * (part.share + 1) // part.of) if n is not None else None
            names, all_names = self.schema.names, [c.split()[0] for c in SCHEMAS[self.table].split(", ")]
            take = [all_names.index(c) for c in names]
            if self.table == "index":
                found = ((part.uri, i, *entry) for i, entry in zip(entries or (), _entries(f, meta, entries) if entries else (), strict=True) if self.times.holds(entry[0]))
            elif entries is None and (part.share or self.unindexed == "skip" and part.of > 1):
                return
            else:
                places = ((i, e[1]) for i, e in zip(entries, _entries(f, meta, entries), strict=True) if self.times.holds(e[0])) if entries is not None else _walk(f, part.size)
                found = block_rows(f, part.uri, places, self.table)
            yield from found if names == all_names else (tuple(row[i] for i in take) for row in found)

    def recording(self, f, part: Part) -> tuple:
        """The row of a file; what no column asks for is not read."""
        names = set(self.schema.names)
        checks = names & {*CHECK_COLUMNS}
        header = checks or names - {*FOOTER_COLUMNS, "source_key", "size_bytes"}
        meta = read_meta(f, part.size, bool(header), bool(checks or names & {*FOOTER_COLUMNS}))
        if self.magic is not None and meta.get("magic", self.magic) != self.magic:
            meta["header_error"] = f"bad magic bytes: {meta['magic']}"
        if checks:
            meta |= check_file(f, part.size, meta, self.magic)
        meta |= {"source_key": part.uri, "size_bytes": part.size}
        parts = {k: dict(zip(self.schema[k].dataType.names, meta[k], strict=True)) for k in ("depth", "color") if k in meta and k in names}
        return tuple((meta | parts).get(c) for c in self.schema.names)


@dataclass
class Times:
    """Bounds of timestamps that filters ask for, all of which hold."""

    bounds: list[tuple[str, int]] = field(default_factory=list)

    def holds(self, t: int) -> bool:
        return all(t == v if op == "=" else t > v if op == ">" else t >= v if op == ">=" else t < v if op == "<" else t <= v for op, v in self.bounds)


_TIME_OPS = {EqualTo: "=", EqualNullSafe: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def _holds(f: Filter, key: str) -> bool:
    """Whether a source_key passes a filter on it."""
    if isinstance(f, In):
        return key in f.value
    if isinstance(f, (StringStartsWith, StringEndsWith, StringContains)):
        return key.startswith(f.value) if isinstance(f, StringStartsWith) else key.endswith(f.value) if isinstance(f, StringEndsWith) else f.value in key
    return isinstance(f, IsNotNull) or key == f.value


class PushdownReader(RecordingReader):
    """Reads only the files and index entries that filters on source_key and timestamp_us let pass."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, Not):
                yield f
                continue
            if f.attribute == ("source_key",) and isinstance(f, (EqualTo, EqualNullSafe, In, IsNotNull, StringStartsWith, StringEndsWith, StringContains)):
                self.keys.append(f)
                continue
            if f.attribute == ("timestamp_us",) and type(f) in _TIME_OPS and self.table in ("frames", "index") and f.value is not None:
                self.times.bounds.append((_TIME_OPS[type(f)], int(f.value)))
            yield f  # Spark holds blocks against it too, as a file without an index gives all of them


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while block := list(islice(rows, BATCH_ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block, strict=True), schema.types, strict=True)], schema=schema)


def block_rows(f, uri: str, places: Iterable[tuple[int, int]], table: str) -> Iterator[tuple]:
    """Rows of frames or imu from the blocks at (number, offset)."""
    for i, at, h in _blocks(f, places):
        if table == "frames":
            yield uri, i, h[3], h[2], h[4], h[5], at, h[1], h[6], h[3] % KEYFRAME_EVERY == 0
        else:
            f.seek(at + FRAME.size + h[4] + h[5])
            for k, s in enumerate(IMU.iter_unpack(f.read(h[6] * IMU.size))):
                yield uri, h[3], k, s[0], list(s[1:4]), list(s[4:7])


def _entries(f, meta: dict, entries: range) -> Iterator[tuple]:
    """Index entries, read in pieces."""
    for first in range(entries.start, entries.stop, BATCH_ROWS):
        f.seek(meta["index_offset"] + first * INDEX.size)
        yield from INDEX.iter_unpack(f.read(min(BATCH_ROWS, entries.stop - first) * INDEX.size))


def _blocks(f, places: Iterable[tuple[int, int]]) -> Iterator[tuple]:
    """(number, offset, header fields) of the frame blocks at some places; what is no block is left out."""
    for i, at in places:
        f.seek(at)
        raw = f.read(FRAME.size)
        if len(raw) == FRAME.size and (h := FRAME.unpack(raw))[0] == FRAME_MAGIC:
            yield i, at, h


def _block_end(f, at: int, size: int) -> int | None:
    """Where the block at a place ends, None if there is no whole one."""
    if at + FRAME.size > size:
        return None
    f.seek(at)
    h = FRAME.unpack(f.read(FRAME.size))
    return at + h[1] if h[0] == FRAME_MAGIC and at + h[1] <= size and h[1] >= FRAME.size else None


def _walk(f, size: int, at: int = HEADER.size, stop: int | None = None, i: int = 0) -> Iterator[tuple[int, int]]:
    """(number, offset) of blocks one behind the other, until one is not whole, or begins at ``stop`` or later."""
    while (stop is None or at < stop) and (end := _block_end(f, at, size)) is not None:
        yield i, at
        at, i = end, i + 1


# ---- files without an index, in shares ----------------------------------------------------

#: Blocks behind one another that a place must lead to, or to the end of the file, to be taken for a block's start.
CONFIRM = 3
#: Bytes that are searched for a mark at a time.
LOOK_BYTES = 1 << 20
_MARK = struct.pack("<I", FRAME_MAGIC)


def find_block(f, size: int, at: int, stop: int) -> int | None:
    """The first place in [at, stop) that looks like a block's start; a payload may hold one too."""
    while at < stop:
        f.seek(at)
        data, found = f.read(min(LOOK_BYTES, stop - at) + len(_MARK) - 1), -1
        while (found := data.find(_MARK, found + 1)) >= 0:
            end: int | None = at + found
            for _ in range(CONFIRM):
                end = _block_end(f, end, size)
                if end is None or size - end < FRAME.size:
                    break
            if end is not None:
                return at + found
        at += LOOK_BYTES
    return None


def walk_share(f, size: int, start: int | None, stop: int) -> tuple[int, int | None]:
    """(number of blocks, where the first behind ``stop`` begins or None) of the walk from ``start``."""
    n, end = 0, start
    while end is not None and end < stop:
        end = _block_end(f, end, size)
        n += end is not None
    return n, end


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each share with the start it found, or was given, the number of its blocks and where the next share's begin."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            system, path = _open(r["uri"])
            with system.open_input_file(path) as f:
                start = r["start"] if r["start"] is not None else find_block(f, r["size"], r["low"], r["high"])
                n, end = walk_share(f, r["size"], start, r["high"])
            rows.append((r["uri"], r["size"], r["low"], r["high"], start, n, end))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string(), *[pa.int64()] * 6], strict=True)], ["uri", "size", "low", "high", "start", "n", "end"])


def resolve_shares(shares: list[dict]) -> tuple[list[dict], list[dict]]:
    """(shares with their first block's number, shares to walk again) of one file, in order.

    A share's start counts if the walk before it ends there. The first one that it does not is given
    the right start, to be walked again; what follows is looked at once that is known.
    """
    at, i, good = shares[0]["start"], 0, []
    for s in shares:
        if at is None:
            break
        if at >= s["high"]:
            continue  # a block of the shares before reaches over this one
        if s["start"] != at:
            return good, [s | {"start": at}]
        good.append(s | {"first": i})
        at, i = s["end"], i + s["n"]
    return good, []


def block_shares(spark: SparkSession, files: list[tuple[str, int]], share_bytes: int) -> list[dict]:
    """Where the walk through each file enters each share of its bytes, and the number of its first block there.

    All shares look for a start of their own at once. Payloads may hold what looks like one: a share
    whose start is not where the walk before it ends is walked again from there, all files at once, until
    all fit. So the result is that of a walk in order, whatever the payloads are; only the rounds depend
    on them. A row for each share, of ``share_bytes`` each, comes to the driver, as the parts of a scan do.
    """
    todo = [{"uri": u, "size": n, "low": low, "high": min(n, low + share_bytes), "start": low if low == HEADER.size else None} for u, n in files for low in range(HEADER.size, n, share_bytes)]
    kind = "uri string, size long, low long, high long, start long"
    known: dict[str, dict[int, dict]] = {}
    while todo:
        rows = spark.createDataFrame([(r["uri"], r["size"], r["low"], r["high"], r["start"]) for r in todo], kind).repartition(max(1, min(len(todo), 10_000)))
        for r in rows.mapInArrow(_walked, f"{kind}, n long, end long").collect():
            known.setdefault(r["uri"], {})[r["low"]] = r.asDict()
        todo = [s for by_low in known.values() for s in resolve_shares([by_low[k] for k in sorted(by_low)])[1]]
    return [s for by_low in known.values() for s in resolve_shares([by_low[k] for k in sorted(by_low)])[0]]


def _shared_rows(table: str, schema: pa.Schema):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                system, path = _open(r["uri"])
                with system.open_input_file(path) as f:
                    yield from _batches(block_rows(f, r["uri"], _walk(f, r["size"], r["start"], r["high"], r["first"]), table), schema)

    return read


def read_blocks(spark: SparkSession, path: str, suffix: str, table: str = "frames", share_bytes: int = 4 << 30) -> DataFrame:
    """frames or imu of the recordings below a path, those without an index too in shares of ``share_bytes``.

    Rows equal those of the source, which walks such a file in one task. Files that have no index and
    more than one share are found by their footers, then see :func:`block_shares`.
    """
    spark.dataSource.register(RecordingSource)
    source = spark.read.format("recording").options(suffix=suffix, table=table, bytesPerShare=share_bytes, unindexed="skip").load(path)
    heads = spark.read.format("recording").options(suffix=suffix, table="recordings", columns="source_key,size_bytes,footer_error").load(path)
    broken = [(r["source_key"], r["size_bytes"]) for r in heads.filter(f"footer_error is not null and size_bytes > {share_bytes}").collect()]
    shares = block_shares(spark, broken, share_bytes) if broken else []
    if not shares:
        return source
    rows = spark.createDataFrame([(s["uri"], s["size"], s["start"], s["high"], s["first"]) for s in shares], "uri string, size long, start long, high long, first long")
    return source.unionByName(rows.repartition(min(len(shares), 10_000)).mapInArrow(_shared_rows(table, arrow_schema(source.schema)), source.schema))


def arrow_schema(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


class RecordingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        fields = {c.split()[0]: c for c in SCHEMAS[self.options.get("table", "recordings")].split(", ")}
        names = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        return ", ".join(fields[c] for c in names or fields)

    def reader(self, schema) -> RecordingReader:
        kind = PushdownReader if self.options.get("pushdown", "false").lower() == "true" else RecordingReader
        return kind(dict(self.options), schema)


# ---- episode sinks ------------------------------------------------------------------------

_POLY = 0x82F63B78
#: Lanes that are worked side by side on long data.
LANES = 256


def _crc_table() -> np.ndarray:
    """The table of CRC-32C, from its polynomial."""
    n = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        n = np.where(n & 1, n >> 1 ^ _POLY, n >> 1).astype(np.uint32)
    return n


_CRC = _crc_table()
_CRC_LIST = _CRC.tolist()


def _advance(crc: int, zeros: int) -> int:
    """The register after so many zero bytes, by squaring the step as a matrix over bits."""
    matrix = [_CRC_LIST[1 << b & 0xFF] ^ (1 << b) >> 8 for b in range(32)]

    def times(m: list[int], x: int) -> int:
        out = 0
        while x:
            low = x & -x
            out ^= m[low.bit_length() - 1]
            x ^= low
        return out

    while zeros:
        if zeros & 1:
            crc = times(matrix, crc)
        matrix = [times(matrix, x) for x in matrix]
        zeros >>= 1
    return crc


def crc32c(data: bytes) -> int:
    crc, whole = 0xFFFFFFFF, len(data) // LANES if len(data) >= 16 * LANES else 0
    if whole:
        # lanes of equal length are worked at once, then joined: each moves the others on by its length
        lanes = np.frombuffer(data, np.uint8, whole * LANES).reshape(LANES, whole).T
        register = np.zeros(LANES, np.uint32)
        register[0] = crc
        for row in lanes:
            register = _CRC[(register ^ row) & np.uint32(0xFF)] ^ register >> np.uint32(8)
        crc = int(register[0])
        for lane in register[1:].tolist():
            crc = _advance(crc, whole) ^ lane
    for b in data[whole * LANES :]:
        crc = _CRC_LIST[(crc ^ b) & 0xFF] ^ crc >> 8
    return crc ^ 0xFFFFFFFF


def masked_crc(data: bytes) -> int:
    crc = crc32c(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def tf_record(data: bytes) -> bytes:
    head = struct.pack("<Q", len(data))
    return head + struct.pack("<I", masked_crc(head)) + data + struct.pack("<I", masked_crc(data))


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def example(row: dict) -> bytes:
    """A tf.train.Example: text and bytes, floats, or integers and booleans; nulls are left out."""
    features = b""
    for name, value in sorted(row.items()):
        many = value if isinstance(value, list) else [value]
        if value is None:
            continue
        if many and isinstance(many[0], (str, bytes, bytearray)):
            kind = _field(1, b"".join(_field(1, x.encode() if isinstance(x, str) else bytes(x)) for x in many))
        elif many and isinstance(many[0], float):
            kind = _field(2, _field(1, struct.pack(f"<{len(many)}f", *many)))
        else:
            kind = _field(3, _field(1, b"".join(_varint(int(x)) for x in many)))
        features += _field(1, _field(1, name.encode()) + _field(2, kind))
    return _field(1, features)


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: where they were written, and where they belong."""

    files: list[tuple[str, str]]


#: Files that a commit moves at a time.
MOVES = 32


def _move_all(system, moves: list[tuple[str, str]]) -> None:
    """Moves files into place; what has been moved before, by a commit that was cut off, is left."""

    def move(pair: tuple[str, str]) -> None:
        source, target = pair
        if system.get_file_info(source).type == fs.FileType.File:
            system.move(source, target)

    for folder in sorted({target.rsplit("/", 1)[0] for _, target in moves}):
        system.create_dir(folder, recursive=True)
    with ThreadPoolExecutor(MOVES) as pool:
        list(pool.map(move, moves))


def finish_commits(path: str) -> int:
    """Finish the commits below a path whose driver was lost after it had decided; returns how many there were."""
    system, base = _open(path.rstrip("/"))
    if system.get_file_info(f"{base}/_temporary").type != fs.FileType.Directory:
        return 0
    jobs = [f.path for f in system.get_file_info(fs.FileSelector(f"{base}/_temporary")) if f.type == fs.FileType.Directory]
    done = [j for j in jobs if system.get_file_info(f"{j}/moves.json").type == fs.FileType.File]
    for job in done:
        with system.open_input_stream(f"{job}/moves.json") as f:
            _move_all(system, [tuple(m) for m in json.loads(f.read())])
        system.delete_dir(job)
    return len(done)


class EpisodeWriter(DataSourceWriter):
    """Rows to files: one per value of the column that option ``file`` names, else one per task.

    Deal rows out by that column and sort within, so that a file's rows come one behind the other.
    A job has a folder of its own, in which files have the name of the task's attempt. To commit, the list of all
    moves is put there, which decides, and then the files are moved; a commit that is cut off between is finished
    by :func:`finish_commits`. So a repeated task leaves neither a second nor a cut file, a failed job
    none, and jobs that write into one folder at once don't touch each other.
    """

    def __init__(self, options: dict, schema, extension: str) -> None:
        self.path, self.file = options["path"].rstrip("/"), options.get("file")
        self.schema, self.extension, self.job = schema, extension, uuid.uuid4().hex
        self.rows_each = int(options.get("rowspergroup", 1024))

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, base = _open(self.path)
        name = f"part-{context.partitionId():05d}-{self.job}{self.extension}"
        done: list[tuple[str, str]] = []
        out, at = None, None
        for row in rows:
            values = row.asDict(recursive=True)
            target = values.pop(self.file) if self.file else name
            if out is None or target != at:
                if out is not None:
                    out.close()
                at, path = target, f"{base}/_temporary/{self.job}/{context.taskAttemptId()}-{len(done)}"
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                done.append((path, f"{base}/{target}"))
                out = self.open(system, path)
            out.write(values)
        if out is not None:
            out.close()
        if len({t for _, t in done}) < len(done):
            raise ValueError(f"rows of a file are not together: sort by {self.file}")
        return Written(done)

    def commit(self, messages: list) -> None:
        system, base = _open(self.path)
        moves = [f for m in messages if m is not None for f in m.files]
        if moves:
            folder = f"{base}/_temporary/{self.job}"
            with system.open_output_stream(f"{folder}/moves.tmp") as f:
                f.write(json.dumps(moves).encode())
            system.move(f"{folder}/moves.tmp", f"{folder}/moves.json")
            _move_all(system, moves)
        self._clear(system, base)

    def abort(self, messages: list) -> None:
        self._clear(*_open(self.path))

    def _clear(self, system, base: str) -> None:
        """The job's own folder goes, and the one above if no other job is in it."""
        if system.get_file_info(f"{base}/_temporary/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/_temporary/{self.job}")
        with contextlib.suppress(OSError):
            if not system.get_file_info(fs.FileSelector(f"{base}/_temporary")):
                system.delete_dir(f"{base}/_temporary")

    def open(self, system, path: str):
        raise NotImplementedError


class _Records:
    """A file of tf.train.Examples."""

    def __init__(self, stream) -> None:
        self.stream = stream

    def write(self, values: dict) -> None:
        self.stream.write(tf_record(example(values)))

    def close(self) -> None:
        self.stream.close()


class _Table:
    """A Parquet file, written in groups of rows."""

    def __init__(self, stream, schema: pa.Schema, each: int) -> None:
        self.stream, self.schema, self.each, self.held = stream, schema, each, []
        self.parquet = pq.ParquetWriter(stream, schema)

    def write(self, values: dict) -> None:
        self.held.append(values)
        if len(self.held) >= self.each:
            self.flush()

    def flush(self) -> None:
        self.parquet.write_table(pa.Table.from_pylist(self.held, self.schema))
        self.held = []

    def close(self) -> None:
        if self.held:
            self.flush()
        self.parquet.close()
        self.stream.close()


class TFRecordWriter(EpisodeWriter):
    def open(self, system, path: str) -> _Records:
        return _Records(system.open_output_stream(path))


class ParquetFileWriter(EpisodeWriter):
    def open(self, system, path: str) -> _Table:
        kept = pa.schema([f for f in arrow_schema(self.schema) if f.name != self.file])
        return _Table(system.open_output_stream(path), kept, self.rows_each)


class TFRecordSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tfrecord"

    def writer(self, schema, overwrite: bool) -> TFRecordWriter:
        return TFRecordWriter(dict(self.options), schema, ".tfrecord")


class ParquetFileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "parquetfile"

    def writer(self, schema, overwrite: bool) -> ParquetFileWriter:
        return ParquetFileWriter(dict(self.options), schema, ".parquet")


class _Lines:
    """A text file; rows are its lines."""

    def __init__(self, stream) -> None:
        self.stream = stream

    def write(self, values: dict) -> None:
        self.stream.write((values["value"] + "\n").encode())

    def close(self) -> None:
        self.stream.close()


class TextFileWriter(EpisodeWriter):
    def open(self, system, path: str) -> _Lines:
        return _Lines(system.open_output_stream(path))


class TextFileSink(DataSource):
    """Rows of a column value to the lines of named files."""

    @classmethod
    def name(cls) -> str:
        return "textfile"

    def writer(self, schema, overwrite: bool) -> TextFileWriter:
        return TextFileWriter(dict(self.options), schema, ".txt")
