import datetime
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from recscan.operators import catalog as C
from recscan.plans import jobs
from recscan.sources import recording as R
from recscan.sources import tables as T
from recscan.sources import workspace as W
from recscan.streaming import telemetry as M


def header(session="session-abc", start=1_700_000_123_456_789, flags=3):
    v = [b"ABCDEF\x02\x00", R.HEADER.size, flags, b"SERIAL-123", 0.001, 640, 480, 1, 2, 3, 4, 0, *[0] * 5, 1280, 720, 5, 6, 7, 8, 0, *[0] * 5, *range(9), *range(3), session.encode(), start, b"USB 3.2", 2, 1, 23, 7, b""]
    return R.HEADER.pack(*v)


def write(path, n=40, footer=True, cut=0):
    raw, index = header(), b""
    for i in range(n):
        index += R.INDEX.pack(1000 * (i + 1), len(raw), i)
        imu = R.IMU.pack(5 + i, 1, 2, 3, 4, 5, 6) * (i % 3)
        raw += R.FRAME.pack(R.FRAME_MAGIC, R.FRAME.size + 30 + len(imu), 1000 * (i + 1), i, 10, 20, i % 3, 0) + b"x" * 30 + imu
    if footer:
        at = len(raw)
        raw += index + R.FOOTER.pack(R.INDEX_MAGIC, at, n, n, 20_000_000, R.FOOTER_MAGIC)
    path.write_bytes(raw[: len(raw) - cut])


@pytest.fixture
def source(spark):
    spark.dataSource.register(R.RecordingSource)
    spark.dataSource.register(R.TFRecordSink)
    return lambda table, path, **o: spark.read.format("recording").options(table=table, suffix=".rec", **o).load(str(path))


def test_layout():
    assert (R.HEADER.size, R.FRAME.size, R.INDEX.size, R.FOOTER.size, R.IMU.size) == (472, 36, 24, 36, 32)


def test_header_footer_and_frames(source, tmp_path):
    write(tmp_path / "a.rec")
    write(tmp_path / "b.rec", n=7, footer=False)
    write(tmp_path / "c.rec", n=5, footer=False, cut=3)
    (tmp_path / "d.rec").write_bytes(b"short")
    (tmp_path / "other.txt").write_bytes(b"")
    rec = {r["source_key"].split("/")[-1]: r for r in source("recordings", tmp_path).collect()}
    a = rec["a.rec"]
    assert (a["camera_serial"], a["session_name"], a["start_timestamp_us"], a["total_frames"], a["version"], a["rgb_codec"]) == ("SERIAL-123", "session-abc", 1_700_000_123_456_789, 40, 2, 2)
    assert a["depth"]["width"] == 640 and a["color"]["height"] == 720 and a["rotation"] == [float(i) for i in range(9)]
    assert rec["b.rec"]["footer_error"] and rec["d.rec"]["header_error"] and len(rec) == 4
    frames = source("frames", tmp_path, bytesPerShare=2000)
    assert frames.rdd.getNumPartitions() > 4
    counts = {r[0].split("/")[-1]: r[1] for r in frames.groupBy("source_key").count().collect()}
    assert counts == {"a.rec": 40, "b.rec": 7, "c.rec": 4}
    f = frames.filter("idx = 30 and source_key like '%a.rec'").first()
    assert (f["frame_number"], f["timestamp_us"], f["rgb_size"], f["depth_size"], f["is_keyframe"]) == (30, 31_000, 10, 20, True)
    assert source("index", tmp_path).count() == 40
    imu = source("imu", tmp_path / "a.rec")
    assert imu.count() == sum(i % 3 for i in range(40)) and imu.first()["accel"] == [1.0, 2.0, 3.0]


class Opened:
    """A file that tells what is read of it."""

    def __init__(self, f, told):
        self.f, self.told = f, told

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.f.close()

    def seek(self, at):
        self.f.seek(at)

    def read(self, n):
        self.told.append(n)
        return self.f.read(n)


@pytest.fixture
def opened(monkeypatch):
    """(files opened, sizes of what was read) of readers that run here."""
    files, told, plain = [], [], R._open

    class System:
        def __init__(self, system):
            self.system = system

        def __getattr__(self, name):
            return getattr(self.system, name)

        def open_input_file(self, path):
            files.append(path)
            return Opened(self.system.open_input_file(path), told)

    def opening(uri):
        system, path = plain(uri)
        return System(system), path

    monkeypatch.setattr(R, "_open", opening)
    return files, told


def rows_here(kind, path, filters=(), **options):
    source = R.RecordingSource({"path": str(path), "suffix": ".rec", **options})
    reader = kind(dict(source.options), __import__("pyspark.sql.types", fromlist=["x"])._parse_datatype_string(source.schema()))
    left = list(reader.pushFilters(list(filters)))
    return [r for p in reader.partitions() for r in reader.rows(p)], left


def test_filters_choose_files_before_they_are_opened(spark, source, opened, tmp_path):
    for name in ("a", "b", "c", "d"):
        write(tmp_path / f"{name}.rec")
    files, told = opened
    key = ("source_key",)
    whole, _ = rows_here(R.RecordingReader, tmp_path, table="frames")
    assert len(files) == 4
    for f, keep in (
        (R.EqualTo(key, str(tmp_path / "b.rec")), "b"), (R.In(key, (str(tmp_path / "a.rec"), str(tmp_path / "d.rec"), "x")), "ad"), (R.StringEndsWith(key, "c.rec"), "c"),
        (R.StringStartsWith(key, str(tmp_path)), "abcd"), (R.StringContains(key, "/nothing"), ""), (R.IsNotNull(key), "abcd"),
    ):
        files.clear()
        got, left = rows_here(R.PushdownReader, tmp_path, [f], table="frames")
        assert not left and [x.rsplit("/", 1)[-1][0] for x in files] == list(keep)
        assert got == [r for r in whole if r[0].rsplit("/", 1)[-1][0] in keep]
    told.clear()
    t = ("timestamp_us",)
    got, left = rows_here(R.PushdownReader, tmp_path / "a.rec", [R.GreaterThan(t, 3000), R.LessThanOrEqual(t, 6000)], table="frames")
    assert len(left) == 2 and [r[3] for r in got] == [4000, 5000, 6000] and told.count(R.FRAME.size) == 3 + 1  # a footer is as long as a block's head


def test_columns_choose_what_is_read(spark, source, opened, tmp_path):
    write(tmp_path / "a.rec")
    _, told = opened
    assert rows_here(R.RecordingReader, tmp_path, columns="source_key,size_bytes")[0] == [(str(tmp_path / "a.rec"), (tmp_path / "a.rec").stat().st_size)] and not told
    assert rows_here(R.RecordingReader, tmp_path, columns="total_frames")[0] == [(40,)] and told == [R.FOOTER.size]
    told.clear()
    assert rows_here(R.RecordingReader, tmp_path, columns="camera_serial,flags")[0] == [("SERIAL-123", 3)] and told == [R.HEADER.size]
    assert source("frames", tmp_path, columns="idx,source_key").columns == ["idx", "source_key"]


def test_pushed_filters_give_what_spark_would(spark, tmp_path):
    for i, name in enumerate(("a", "b", "c")):
        write(tmp_path / f"{name}.rec", n=20 + i, footer=name != "b")
    for table in ("frames", "index", "recordings", "imu"):
        read = jobs.read_recordings(spark, str(tmp_path), ".rec", table, pushdown=True)
        rows = read.collect()
        for where in ("source_key like '%a.rec'", f"source_key in ('{tmp_path}/b.rec', 'q')", f"source_key = '{tmp_path}/c.rec' and source_key <> 'z'", *(["timestamp_us >= 5000 and timestamp_us < 9000 and source_key like '%b%'"] * (table != "recordings"))):
            got = read.filter(where)
            want = spark.createDataFrame(rows, read.schema).filter(where).collect()
            assert sorted(map(str, got.collect())) == sorted(map(str, want)), (table, where)
            negated = jobs.read_recordings(spark, str(tmp_path), ".rec", table, pushdown=True).filter(f"not ({where})")
            want = spark.createDataFrame(rows, read.schema).filter(f"not ({where})").collect()
            assert sorted(map(str, negated.collect())) == sorted(map(str, want)), (table, where)
    assert jobs.read_recordings(spark, str(tmp_path), ".rec", "frames", pushdown=True).filter(f"source_key = '{tmp_path}/c.rec'").rdd.getNumPartitions() == 1


def test_one_reading_serves_many_filters(spark, opened, tmp_path):
    for i, name in enumerate(("a", "b", "c")):
        write(tmp_path / f"{name}.rec", n=20 + i, footer=name != "b")
    key = lambda name: f"{tmp_path}/{name}.rec"
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for table in ("recordings", "frames", "index", "imu"):
        read = jobs.read_recordings(spark, str(tmp_path), ".rec", table).select("source_key")
        rows = [r[0] for r in read.collect()]
        a, c = read.filter(F.col("source_key") == key("a")), read.filter(F.endswith("source_key", F.lit("c.rec")))
        assert sorted(r[0] for r in a.unionByName(c).collect()) == sorted(k for k in rows if k in (key("a"), key("c")))
        assert read.filter(f"source_key = '{key('a')}'").count() == rows.count(key("a")) and read.count() == len(rows)
        mine = jobs.read_recordings(spark, str(tmp_path), ".rec", table, keys=[key("c"), "none"], columns=["source_key"])
        assert [r[0] for r in mine.collect()] == [k for k in rows if k == key("c")] and mine.rdd.getNumPartitions() == 1
        if table != "recordings":
            times = jobs.read_recordings(spark, str(tmp_path), ".rec", table).filter("timestamp_us >= 5000 and timestamp_us < 9000").select("source_key").collect()
            assert jobs.read_recordings(spark, str(tmp_path), ".rec", table, columns=["source_key"], since_us=5000, until_us=9000).collect() == times
    assert jobs.read_recordings(spark, str(tmp_path), ".rec", "frames", share_bytes=500, keys=[key("b")], since_us=5000).filter("timestamp_us < 5000 or source_key like '%a.rec'").count() == 0
    files, told = opened
    files.clear(), told.clear()
    got, _ = rows_here(R.RecordingReader, tmp_path, table="frames", keys=json.dumps([key("a")]), since_us="4000", until_us="7000")
    assert [r[3] for r in got] == [4000, 5000, 6000] and len(files) == 1 and told.count(R.FRAME.size) == 3 + 1
    with pytest.raises(ValueError):
        jobs.read_recordings(spark, str(tmp_path), ".rec", since_us=1)


def tricky(path, rng, n=60, cut=0, broken=False):
    """A file without an index whose payloads hold marks, heads of blocks, and whole blocks that lead to the next one."""
    raw = header()
    for i in range(n):
        block = lambda body, k=i: R.FRAME.pack(R.FRAME_MAGIC, R.FRAME.size + len(body), 5 * k, 1000 + k, len(body), 0, 0, 0) + body
        body = rng.randbytes(rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            body += rng.choice([R._MARK, R.FRAME.pack(R.FRAME_MAGIC, rng.randint(0, 200), 1, 2, 3, 4, 0, 0), block(rng.randbytes(20)), block(block(b"in") + block(b"side")), rng.randbytes(300)])
        raw += block(body)
        if broken and i == n // 2:
            raw += b"????"
    path.write_bytes(raw[: len(raw) - cut])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shares_of_files_without_an_index_equal_the_walk(spark, source, tmp_path, seed):
    rng = random.Random(seed)
    for i in range(5):
        tricky(tmp_path / f"t{i}.rec", rng, cut=rng.choice([0, 1, 30, 90]), broken=i == 4)
    write(tmp_path / "good.rec")
    (tmp_path / "short.rec").write_bytes(b"x")
    size = max(f.stat().st_size for f in tmp_path.iterdir())
    for table in ("frames", "imu"):
        want = sorted(map(str, source(table, tmp_path).collect()))
        for shares in (2, 7, 50):
            got = R.read_blocks(spark, str(tmp_path), ".rec", table, size // shares)
            assert sorted(map(str, got.collect())) == want and (shares == 2 or got.rdd.getNumPartitions() > 6)
    assert jobs.read_recordings(spark, str(tmp_path), ".rec", "frames", columns=["idx"], share_bytes=999).columns == ["idx"]


def test_shares_start_where_the_walk_enters_them(tmp_path):
    rng = random.Random(9)
    for k in range(40):
        path = tmp_path / f"{k}.rec"
        tricky(path, rng, n=rng.randint(1, 40), cut=rng.choice([0, 7]))
        size, each = path.stat().st_size, rng.randint(40, 900)
        with path.open("rb") as f:
            want = list(R._walk(f, size))
            shares, rounds = [{"low": low, "high": min(size, low + each), "start": low if low == R.HEADER.size else None} for low in range(R.HEADER.size, size, each)], 0
            todo = list(shares)
            while todo:
                for s in todo:
                    start = s["start"] if s["start"] is not None else R.find_block(f, size, s["low"], s["high"])
                    n, end = R.walk_share(f, size, start, s["high"])
                    shares[(s["low"] - R.HEADER.size) // each] = s | {"start": start, "n": n, "end": end}
                good, todo = R.resolve_shares(shares)
                rounds += 1
                assert rounds <= len(shares) + 1
            assert [x for s in good for x in R._walk(f, size, s["start"], s["high"], s["first"])] == want


def test_tfrecord(spark, source, tmp_path):
    assert len(R.tf_record(b"test data")) == 25 and R.masked_crc(b"123456789") == ((0xE3069283 >> 15 | 0xE3069283 << 17) + 0xA282EAD8) & 0xFFFFFFFF
    df = spark.createDataFrame([(i, f"s{i}", 0.5, True, [1.0, 2.0], None) for i in range(5)], "step long, name string, t double, first boolean, v array<double>, empty string")
    df.coalesce(1).write.format("tfrecord").mode("append").save(str(tmp_path / "out"))
    (file,) = (tmp_path / "out").glob("*")
    assert file.name.startswith("part-00000-") and file.suffix == ".tfrecord"
    raw, n = file.read_bytes(), 0
    while raw:
        (size,) = struct.unpack("<Q", raw[:8])
        assert struct.unpack("<I", raw[8:12])[0] == R.masked_crc(raw[:8])
        assert struct.unpack("<I", raw[12 + size : 16 + size])[0] == R.masked_crc(raw[12 : 12 + size])
        raw, n = raw[16 + size :], n + 1
    assert n == 5


def test_checksum_of_lanes_equals_the_plain_one():
    rng = random.Random(1)
    for n in (0, 1, 9, 4095, 4096, 5000, 70_001):
        data = rng.randbytes(n)
        crc = 0xFFFFFFFF
        for b in data:
            crc = R._CRC_LIST[(crc ^ b) & 0xFF] ^ crc >> 8
        assert R.crc32c(data) == crc ^ 0xFFFFFFFF
    assert R.crc32c(b"123456789") == 0xE3069283


def test_episode_files_commit_and_abort(spark, source, tmp_path):
    df = spark.createDataFrame([(f"d/e{i % 3}.parquet", i, [float(i)]) for i in range(30)], "file string, n long, v array<float>")
    sorted_ = df.repartition("file").sortWithinPartitions("file", "n")
    spark.dataSource.register(R.ParquetFileSink)
    sorted_.write.format("parquetfile").option("file", "file").option("rowsPerGroup", 4).mode("append").save(str(tmp_path / "p"))
    assert sorted(str(f.relative_to(tmp_path / "p")) for f in (tmp_path / "p").rglob("*") if f.is_file()) == [f"d/e{i}.parquet" for i in range(3)]
    assert [r["n"] for r in spark.read.parquet(str(tmp_path / "p/d/e1.parquet")).collect()] == list(range(1, 30, 3)) and not (tmp_path / "p/_temporary").exists()
    with pytest.raises(Exception, match="not together"):
        df.coalesce(1).write.format("parquetfile").option("file", "file").mode("append").save(str(tmp_path / "q"))
    assert not [f for f in (tmp_path / "q").rglob("*") if f.is_file()]


def test_files_are_validated(spark, source, tmp_path):
    write(tmp_path / "good.rec")
    raw = (tmp_path / "good.rec").read_bytes()
    odd = {
        "magic": b"XXXXXX" + raw[6:], "version": raw[:6] + b"\x07" + raw[7:], "tiny": raw[:480], "cut": raw[:-3], "short": b"short",
        "index": raw[:-36] + R.FOOTER.pack(1, len(raw) - 36 - 960, 40, 40, 5, R.FOOTER_MAGIC), "early": raw[:-36] + R.FOOTER.pack(R.INDEX_MAGIC, 7, 40, 40, 5, R.FOOTER_MAGIC),
        "over": raw[:-36] + R.FOOTER.pack(R.INDEX_MAGIC, len(raw) - 40, 40, 40, 5, R.FOOTER_MAGIC), "frame": raw[:472] + b"zzzz" + raw[476:],
    }
    for name, data in odd.items():
        (tmp_path / f"{name}.rec").write_bytes(data)
    rec, index = source("recordings", tmp_path, magic="ABCDEF"), source("index", tmp_path, magic="ABCDEF")
    checked, counts = jobs.validate(index, rec)
    got = {r["source_key"].rsplit("/", 1)[-1][:-4]: r for r in checked.collect()}
    want = {
        "magic": "bad magic bytes", "version": "unsupported version: 7", "tiny": "file too small for header + footer", "short": "cannot read file header: file too small for a header", "index": "bad index magic in footer",
        "early": "index_offset 7 before end of file header", "over": "index table overlaps footer", "frame": "first frame block has bad magic",
    }
    assert {k: r["errors"][0] for k, r in got.items() if r["errors"]} == want
    assert got["cut"]["valid"] and got["cut"]["warnings"] == ["no valid footer \u2014 file may be truncated"] and got["good"]["valid"] and not got["good"]["warnings"]
    assert counts.first()["passed"] == 2 and counts.first()["failed"] == 8
    status = {r["file_name"]: r["validation_error"] for r in jobs.inventory(rec).collect()}
    assert status["magic.rec"].startswith("header: bad magic bytes") and status["good.rec"] is None
    assert spark.read.format("recording").options(table="recordings", suffix=".rec").load(str(tmp_path)).filter("source_key like '%/magic.rec' and header_error is null").count() == 1


MANIFEST_ROW = "dataset string, description string, tags array<string>, created string, filename string, session_name string, recorded_at string, duration_s double, frames bigint"


def test_two_writers_of_manifests_and_a_crash(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "m")
    rows = lambda *names: spark.createDataFrame([("d", "about", ["t"], "now", n, "s", "at", 1.5, 9) for n in names], MANIFEST_ROW)
    files = lambda: sorted(r["filename"] for r in W.load_manifests(spark, path).collect())
    with pytest.raises(FileNotFoundError):
        W.load_manifests(spark, path)
    assert W.save_manifests(rows("a"), path) == 1
    plain, lost = W.put_if_absent, []

    def racing(spark_, at, text):
        if not lost and "_versions" in at:
            lost.append(at)
            assert W.save_manifests(rows("b"), path) in (2, 4)  # another writer comes first
        return plain(spark_, at, text)

    monkeypatch.setattr(W, "put_if_absent", racing)
    assert W.save_manifests(rows("a", "c"), path) == 3 and files() == ["a", "c"]
    lost.clear()
    with pytest.raises(W.Conflict):
        W.save_manifests(rows("x"), path, expected=3)
    assert files() == ["b"]

    def crash(*_):
        raise OSError("lost")

    monkeypatch.setattr(W, "put_if_absent", crash)
    with pytest.raises(OSError):
        W.save_manifests(rows("y"), path)
    assert files() == ["b"]
    monkeypatch.setattr(W, "put_if_absent", plain)
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(6) as pool:
        numbers = list(pool.map(lambda i: W.save_manifests(rows(f"w{i}"), path), range(6)))
    assert sorted(numbers) == list(range(5, 11)) and files() == [f"w{numbers.index(10)}"]
    assert not W.put_if_absent(spark, f"{path}/_versions/{1:020d}", "z") and not list((tmp_path / "m/_versions").glob("*.tmp"))


def test_broken_manifests_give_no_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text("{ broken")
    (tmp_path / "b.json").write_text(json.dumps({"name": "d", "episodes": [{"filename": "x"}]}))
    assert [(r["dataset"], r["filename"]) for r in T.read_manifests(spark, str(tmp_path)).collect()] == [("d", "x")]


def test_reports_are_one_array_and_sidecars_one_file_each(spark, source, tmp_path):
    for n in (0, 1, 50):
        df = spark.range(n).selectExpr("concat('k', id) AS source_key", "id * 0.5D AS score", "CAST(NULL AS string) AS note").repartition(5)
        W.write_report(df, str(tmp_path / f"r{n}.json"))
        got = json.loads((tmp_path / f"r{n}.json").read_text())
        assert [r["source_key"] for r in got] == sorted(f"k{i}" for i in range(n)) and all(list(r) == ["note", "score", "source_key"] for r in got)
    assert not [f for f in tmp_path.iterdir() if "parts" in f.name]
    for f in ("a.rec", "b.rec", "sub/b.rec"):
        (tmp_path / "in" / f).parent.mkdir(parents=True, exist_ok=True)
        write(tmp_path / "in" / f)
    W.write_sidecars(source("recordings", tmp_path / "in"), str(tmp_path / "side"))
    found = {str(p.relative_to(tmp_path / "side")): json.loads(p.read_text()) for p in (tmp_path / "side").rglob("*.json")}
    assert len(found) == 3 and found["a.json"]["serial_number"] == "SERIAL-123" and {f["source_file"] for f in found.values()} == {str(tmp_path / "in" / f) for f in ("a.rec", "b.rec", "sub/b.rec")}


def test_upsert_is_whole_after_a_crash(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "x.jsonl")
    rows = lambda *r: spark.createDataFrame(list(r), "k string, a int")
    W.upsert_jsonl(spark, path, rows(("a", 1), ("b", 1)), ["k"])
    (tmp_path / "x.jsonl").rename(tmp_path / "x.jsonl.before")  # where a crash between the two renames leaves it
    W.upsert_jsonl(spark, path, rows(("b", 2)), ["k"])
    assert sorted((r["k"], r["a"]) for r in T.read_jsonl(spark, path, "k string, a int").collect()) == [("a", 1), ("b", 2)]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["x.jsonl"]


def test_jobs_write_into_one_folder_at_once_and_commits_are_finished(spark, source, tmp_path, monkeypatch):
    from concurrent.futures import ThreadPoolExecutor

    spark.dataSource.register(R.ParquetFileSink)

    def export(k):
        df = spark.createDataFrame([(f"job{k}/f{i % 4}.parquet", i) for i in range(40)], "file string, id long").repartition("file").sortWithinPartitions("file")
        df.write.format("parquetfile").option("file", "file").mode("append").save(str(tmp_path / "p"))

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(export, range(4)))
    assert len(list((tmp_path / "p").rglob("*.parquet"))) == 16 and spark.read.parquet(*(str(tmp_path / f"p/job{k}") for k in range(4))).count() == 160 and not (tmp_path / "p/_temporary").exists()
    job = R.TFRecordWriter({"path": str(tmp_path / "q")}, None, ".tfrecord")
    folder = tmp_path / "q/_temporary" / job.job
    folder.mkdir(parents=True)
    moves = []
    for i in range(3):
        (folder / f"{i}").write_text(str(i))
        moves.append((str(folder / f"{i}"), str(tmp_path / f"q/d/{i}.txt")))
    plain, calls = R._move_all, []
    monkeypatch.setattr(R, "_move_all", lambda system, m: calls.append(plain(system, m[:1])) or (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        job.commit([R.Written(moves)])
    monkeypatch.setattr(R, "_move_all", plain)
    (tmp_path / "q/_temporary/undecided").mkdir()
    assert R.finish_commits(str(tmp_path / "q")) == 1 and sorted(p.read_text() for p in (tmp_path / "q/d").iterdir()) == ["0", "1", "2"]
    assert R.finish_commits(str(tmp_path / "q")) == 0 and (tmp_path / "q/_temporary/undecided").exists()


def test_workspace_files(spark, tmp_path):
    path = str(tmp_path / "x.jsonl")
    rows = lambda *r: spark.createDataFrame(list(r), "k string, b int, a int")
    W.upsert_jsonl(spark, path, rows(("z", 1, 1), ("b", 2, 2)), ["k"])
    W.upsert_jsonl(spark, path, rows(("b", 3, None), ("a", 4, 4)), ["k"])
    lines = [json.loads(x) for f in sorted((tmp_path / "x.jsonl").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == [{"a": 4, "b": 4, "k": "a"}, {"a": None, "b": 3, "k": "b"}, {"a": 1, "b": 1, "k": "z"}] and list(lines[0]) == ["a", "b", "k"]
    W.append_audit(spark.createDataFrame([("prune", "f")], "op string, filename string"), str(tmp_path / "audit"))
    W.append_audit(spark.createDataFrame([("restore", "f")], "op string, filename string"), str(tmp_path / "audit"))
    assert T.read_jsonl(spark, str(tmp_path / "audit"), "op string, timestamp string").filter("timestamp is not null").count() == 2
    e = spark.createDataFrame([("d", "about", ["t"], "now", f"r{i}.rec", "s", "at", 1.5, 9) for i in (2, 1)], "dataset string, description string, tags array<string>, created string, filename string, session_name string, recorded_at string, duration_s double, frames bigint")
    W.save_manifests(e, str(tmp_path / "m"))
    W.save_manifests(e.filter("filename = 'r1.rec'"), str(tmp_path / "m"))
    assert [r["filename"] for r in W.load_manifests(spark, str(tmp_path / "m")).collect()] == ["r1.rec"]
    p = spark.createDataFrame([("cam", 1.0, 2.0, 3.0, 4.0, 5, 6)], W.PROFILE)
    W.write_profiles(p, str(tmp_path / "p"))
    assert W.read_profiles(spark, str(tmp_path / "p")).collect() == p.collect() and W.read_profiles(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "o.json").write_text(json.dumps({"episodes": {"e1": {"episode_status": "keep", "note": None}}, "buckets": {"renames": {"b": "n"}, "interval_assignments": {"i": {"bucket_id": "b"}}}}))
    o = W.read_overrides(spark, str(tmp_path / "o.json"))
    assert {k: v.toPython() for k, v in o["episodes"].first()["o"].items()} == {"episode_status": "keep", "note": None} and o["intervals"].count() == 0 and o["renames"].first()[:] == ("b", "n") and o["assignments"].first()[:] == ("i", "b", None)
    assert all(df.count() == 0 for df in W.read_overrides(spark, str(tmp_path / "none.json")).values())
    (tmp_path / "u.json").write_text(json.dumps({"version": 1, "uploads": [{"filename": "a", "attempts": 2, "success": False}]}))
    (tmp_path / "bad.json").write_text("{")
    assert W.read_uploads(spark, str(tmp_path / "u.json")).first()["attempts"] == 2 and W.read_uploads(spark, str(tmp_path / "bad.json")).count() == 0 and W.read_uploads(spark, str(tmp_path / "none")).count() == 0
    W.dump_features(p, str(tmp_path / "f"))
    assert spark.read.option("header", True).csv(str(tmp_path / "f")).first()["rgb_mad"] == "2.0"


def test_sidecar_and_registration(spark, source, tmp_path):
    write(tmp_path / "a.rec")
    rec = source("recordings", tmp_path)
    meta = json.loads(W.sidecar(rec).first()["meta"])
    assert (meta["serial_number"], meta["color_width"], meta["fps"], meta["has_imu"], meta["intrinsics"]["depth"]["fx"], meta["extrinsics"]["translation"]) == ("SERIAL-123", 1280, 2.0, True, 1.0, [0.0, 1.0, 2.0])
    r = jobs.registration(rec).first()
    assert (r["frame_count"], r["resolution_w"], r["fps"], r["video_streamable"], r["video_stream_error"], r["intrinsics"]["color"]["ppy"]) == (40, 1280, 2.0, True, None, 8.0)


def test_json_tables(spark, tmp_path):
    assert T.read_jsonl(spark, str(tmp_path / "none"), "a int").count() == 0
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nbroken\n{"a": null}\n')
    assert [r["a"] for r in T.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").collect()] == [1, None]
    (tmp_path / "dataset.json").write_text(json.dumps({"name": "d", "episodes": [{"filename": "r.rec", "duration_s": 30.5, "frames": 915}]}))
    m = T.read_manifests(spark, str(tmp_path / "dataset.json")).first()
    assert (m["version"], m["dataset"], m["tags"], m["filename"], m["frames"]) == (1, "d", [], "r.rec", 915)
    (tmp_path / "ann.txt").write_text("1 5 grasp\n7 9\nx y\n\n")
    assert {(r["start"], r["end"], r["label"], r["source"]) for r in T.read_annotations(spark, str(tmp_path / "ann.txt")).collect()} == {(1, 5, "grasp", "ann"), (7, 9, "manipulation", "ann")}


def test_listing_and_digest(spark, tmp_path):
    (tmp_path / "a.rec").write_bytes(b"abc")
    assert [r["size_bytes"] for r in T.list_objects(spark, str(tmp_path), ".rec").collect()] == [3]
    assert T.file_sha256(spark, str(tmp_path), ".rec", piece=2).first()["sha256"].startswith("ba7816bf")


def test_enrich_keeps_good_rows(spark):
    def double(pdf):
        if (pdf["x"] == 3).any():
            raise ValueError("three")
        return pdf.assign(x=pdf["x"] * 2)

    got = {(r["x"], r["details"]) for r in T.enrich(spark.range(5).selectExpr("id AS x"), double, "x long").collect()}
    assert got == {(0, None), (2, None), (4, None), (8, None), (3, "three")}


def test_streams_equal_their_batch_twins(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    ms = [0, 100, 600, 1200, 5000, 5100]
    rows = [("d", at + datetime.timedelta(milliseconds=m), 10) for m in ms] + [("z", at + datetime.timedelta(hours=1), 1), ("z", at + datetime.timedelta(hours=2), 1)]
    spark.createDataFrame(rows, "device string, ts timestamp, bytes long").coalesce(1).write.parquet(str(tmp_path / "in"))

    def run(make, name):
        stream = spark.readStream.schema("device string, ts timestamp, bytes long").parquet(str(tmp_path / "in"))
        q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    sessions = run(M.split_sessions, "sessions").filter("device = 'd'").orderBy("start").collect()
    assert [r["frames"] for r in sessions] == [3, 1, 2]
    rates = run(M.capture_rates, "rates").filter("device = 'd'")
    assert sorted(r["captured"] for r in rates.collect()) == [1, 2, 3]
    stalled = run(M.stalls, "stalls").filter("device = 'd'").orderBy("last_ts").collect()
    assert stalled[0]["last_ts"] == at + datetime.timedelta(milliseconds=1200) and stalled[0]["stalled_at"] == at + datetime.timedelta(milliseconds=2200)
    assert {r["capture_fps"] for r in rates.collect()} == {1.0, 2.0, 3.0}


def test_pending_files_settle_and_come_once(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    schema = "key string, size_bytes long, mtime timestamp, listed timestamp"
    listings = [
        [("old", 2048, at(0), at(100)), ("young", 2048, at(95), at(100)), ("grows", 2048, at(99), at(100)), ("small", 10, at(0), at(100)), ("a/.pruned/x", 2048, at(0), at(100))],
        [("old", 2048, at(0), at(104)), ("grows", 4096, at(104), at(104))],
        [("old", 2048, at(0), at(112)), ("grows", 4096, at(104), at(112))],
        [("old", 2048, at(0), at(130)), ("young", 2048, at(95), at(130)), ("grows", 4096, at(104), at(130))],
        [("end", 10, at(0), at(140))],
    ]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = M.pending_stream(stream).writeStream.format("memory").queryName("settled").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    given = []
    for rows in listings:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
        given.append(sorted((r["key"], r["size_bytes"]) for r in spark.table("settled").collect()))
    q.stop()
    assert given[0] == [("old", 2048)] and ("grows", 4096) not in given[1] and given[-1] == [("grows", 4096), ("old", 2048), ("young", 2048)]


def test_upload_progress_equals_its_batch_twin(spark, tmp_path):
    rng = random.Random(2)
    rows, totals = [], {f"u{k}": 1000 * (k + 1) for k in range(6)}
    for u, total in totals.items():
        ts, done = sorted({round(rng.uniform(0, 50), 1) for _ in range(12)}), 0
        for t in ts:
            done = min(total, done + rng.randint(0, total // 6))
            rows.append((u, t, done, total))
    rows.sort(key=lambda r: r[1])
    schema = "id string, ts_s double, bytes long, total long"
    for k in range(0, len(rows), 10):
        spark.createDataFrame(rows[k : k + 10], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = M.upload_progress(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert len({p["batchId"] for p in q.recentProgress if p["numInputRows"]}) > 3
    told = lambda df: sorted((r["id"], r["ts_s"], r["bytes"], *(round(r[c], 6) for c in ("rate", "average_rate", "percent", "eta_s"))) for r in df.collect())
    want = C.upload_rates(spark.createDataFrame([r[:3] for r in rows], "id string, ts_s double, bytes long"), spark.createDataFrame([*totals.items()], "id string, total long"))
    assert told(spark.read.parquet(str(tmp_path / "out"))) == told(want)


def test_listed_files_come_once_over_restarts(spark, tmp_path):
    import os
    import time

    spark.dataSource.register(M.ListingSource)
    for f, size, age in (("a.rec", 2048, 100), ("sub/b.rec", 2048, 100), ("young.rec", 2048, -3600), ("tiny.rec", 3, 100), (".pruned/c.rec", 2048, 100), ("sub/deep/d.rec", 4096, 50)):
        p = tmp_path / "in" / f
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x" * size)
        os.utime(p, (time.time() - age,) * 2)

    def run():
        listing = spark.readStream.format("listing").load(str(tmp_path / "in"))
        q = M.settled_files(listing, str(tmp_path / "log"), str(tmp_path / "c"))
        q.awaitTermination()
        return sorted(r["key"].removeprefix(f"{tmp_path}/in/") for r in T.read_jsonl(spark, str(tmp_path / "log"), "key string, size_bytes long").collect())

    assert run() == ["a.rec", "sub/b.rec", "sub/deep/d.rec"] == run()
    os.utime(tmp_path / "in/young.rec", (time.time() - 60,) * 2)
    (tmp_path / "in/e.rec").write_bytes(b"x" * 2000)
    os.utime(tmp_path / "in/e.rec", (0, 0))  # moved here with its old time
    assert run() == ["a.rec", "e.rec", "sub/b.rec", "sub/deep/d.rec", "young.rec"] == run()


def test_state_of_given_files_ends(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    schema = "key string, size_bytes long, mtime timestamp, listed timestamp"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = M.pending_stream(stream, forget="1 hour").writeStream.format("memory").queryName("forgotten").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    held = []
    for rows in ([(f"f{i}", 2048, at(0), at(100)) for i in range(20)], [("g", 2048, at(110), at(110))], [("h", 2048, at(7200), at(7300))], [("h", 2048, at(7200), at(7400))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
        held.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    q.stop()
    assert held[0] == 20 and held[-1] <= 2
    assert sorted(r["key"] for r in spark.table("forgotten").collect()) == sorted([f"f{i}" for i in range(20)] + ["g", "h"])


def test_a_batch_that_is_run_again_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    for batch, n in (("s-0", 5), ("s-1", 3), ("s-0", 5), ("s-1", 3)):
        W.append_batch(spark.range(n).select(F.col("id"), F.lit(batch).alias("b")), path, batch)
    assert spark.read.json(path).count() == 8 and not list((tmp_path / "out/_batches").iterdir())
    failed = []

    def run(fail):
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        plain = M.append_batch

        def broken(rows, p, batch):
            plain(rows, p, batch)
            if fail:
                failed.append(batch)
                raise RuntimeError("lost after the batch was written")

        M.append_batch = broken
        try:
            M.append_results(stream, str(tmp_path / "res"), str(tmp_path / "c")).awaitTermination()
        except Exception:
            assert fail
        finally:
            M.append_batch = plain

    spark.range(7).write.parquet(str(tmp_path / "in"))
    run(True)
    run(False)
    assert failed and sorted(r["id"] for r in spark.read.json(str(tmp_path / "res")).collect()) == list(range(7))


def test_results_are_appended(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        M.append_results(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert sorted(r["id"] for r in spark.read.json(str(tmp_path / "out")).collect()) == list(range(5))
