"""Queries of spans, labels, review, manifests, uploads and exports, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recscan.functions import scalars as S
from recscan.operators import activity as A
from recscan.operators import catalog as C
from recscan.operators import labels as L
from recscan.operators import review as V
from recscan.operators import spans as P
from recscan.plans import jobs
from recscan.plans.activity_queries import _FUSED, _segments, _STATION_VERDICT, _STATIONS, _VERDICT, _frames, rounded
from recscan.plans.activity_queries import analyze_verdict as _verdicts
from recscan.plans.fixtures import duck, fixture
from recscan.scratch import written
from recscan.streaming import telemetry

PERIOD = 0.2
NOW = "timestamp'1999-01-01 00:00:00'"
QUERIES: dict = {}
_ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            _ORACLE[f.__name__] = sql
        return f

    return add


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "fx_hand_samples").select("source_key", (F.col("t_ms") / 1000).alias("t"), "n", F.col("a").cast("double").alias("a"))


def _proposals(spark: SparkSession, d: str) -> DataFrame:
    seg = A.segments(A.scan(_frames(spark, d)), min_gap=30, min_duration=45, pad=15)
    return seg.select("source_key", (F.col("start_frame") / 30).alias("start_s"), (F.col("end_frame") / 30).alias("end_s"), (F.col("active_frames") / F.col("total_frames")).alias("active_fraction"))


# ---- spans --------------------------------------------------------------------------------

_SEEN = "SELECT source_key, t_ms AS b, t_ms + 200 AS e FROM {fx_hand_samples} WHERE n > 0 AND a >= 0.01"
_HANDS = f"""p0 AS ({_SEEN}),
    p1 AS (SELECT *, CASE WHEN b - lag(e) OVER (PARTITION BY source_key ORDER BY b) <= 1000 THEN 0 ELSE 1 END AS new FROM p0),
    p2 AS (SELECT *, sum(new) OVER (PARTITION BY source_key ORDER BY b) AS g FROM p1),
    hands AS (SELECT source_key, min(b) / 1000.0::DOUBLE AS hs, max(e) / 1000.0::DOUBLE AS he FROM p2 GROUP BY source_key, g)"""


@query(f"WITH {_HANDS} SELECT source_key, round(hs, 6) AS start_s, round(he, 6) AS end_s FROM hands")
def presence_spans(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.presence_spans(_samples(spark, d), PERIOD, 1.0))


# equal spans are one, so that the order is total and both windows see the rows alike
@query("""WITH i AS (SELECT source_key, start_s, end_s, max(end_s) OVER (PARTITION BY source_key ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe
                    FROM (SELECT DISTINCT source_key, start_s, end_s FROM {fx_intervals})),
    j AS (SELECT *, sum(CASE WHEN start_s - pe <= 0.5 THEN 0 ELSE 1 END) OVER (PARTITION BY source_key ORDER BY start_s, end_s ROWS UNBOUNDED PRECEDING) AS g FROM i)
    SELECT source_key, min(start_s)::DOUBLE AS start_s, max(end_s)::DOUBLE AS end_s FROM j GROUP BY source_key, g""")  # fmt: skip
def merge_spans(spark: SparkSession, d: str) -> DataFrame:
    i = fixture(spark, d, "fx_intervals").select("source_key", F.col("start_s").cast("double").alias("start_s"), F.col("end_s").cast("double").alias("end_s"))
    return P.merge_spans(i, 0.5)


_HAND_INTERVALS = f"""{_segments(30, 45, 15)}, {_HANDS},
    pr AS (SELECT source_key, start_frame / 30 AS ps, end_frame / 30 AS pe, active_frames / total_frames AS af FROM seg),
    raw AS (SELECT source_key, greatest(0.0, least(greatest(ps, hs) - 0.5, duration_us / 1e6)) AS s, greatest(0.0, least(least(pe, he) + 0.5, duration_us / 1e6)) AS e
            FROM pr JOIN hands USING (source_key) JOIN {{fx_recordings}} r USING (source_key) WHERE least(pe, he) > greatest(ps, hs)),
    r1 AS (SELECT *, max(e) OVER (PARTITION BY source_key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM raw),
    r2 AS (SELECT *, sum(CASE WHEN round(s - pe, 9) <= 1.0 THEN 0 ELSE 1 END) OVER (PARTITION BY source_key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM r1),
    sp AS (SELECT source_key, min(s) AS start_s, max(e) AS end_s FROM r2 GROUP BY source_key, g HAVING round(max(e) - min(s), 9) >= 1.5),
    hx AS (SELECT source_key, t_ms / 1000.0::DOUBLE AS t, n, a FROM {{fx_hand_samples}}),
    hf AS (SELECT sp.source_key, start_s, count(*) FILTER (WHERE n > 0 AND a >= 0.01) / count(*) AS hand, max(n) FILTER (WHERE n > 0 AND a >= 0.01) AS most
           FROM sp JOIN hx ON hx.source_key = sp.source_key AND least(t + 0.2, end_s) - greatest(t, start_s) > 0 GROUP BY ALL),
    act AS (SELECT sp.source_key, sp.start_s, sum((least(sp.end_s, pe) - greatest(sp.start_s, ps)) * af) / sum(least(sp.end_s, pe) - greatest(sp.start_s, ps)) AS act
            FROM sp JOIN pr ON pr.source_key = sp.source_key AND least(sp.end_s, pe) - greatest(sp.start_s, ps) > 0 GROUP BY ALL)
    SELECT source_key, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, round(end_s - start_s, 6) AS duration_s, round(coalesce(hand, 0), 6) AS hand_presence_fraction,
           round(coalesce(act, 0), 6) AS active_fraction, coalesce(most, 0) AS max_hands_seen, round(0.7 * coalesce(hand, 0) + 0.3 * coalesce(act, 0), 6) AS proposal_score
    FROM sp LEFT JOIN hf USING (source_key, start_s) LEFT JOIN act USING (source_key, start_s) WHERE coalesce(hand, 0) > 0"""


@query(_HAND_INTERVALS)
def hand_intervals(spark: SparkSession, d: str) -> DataFrame:
    rec = fixture(spark, d, "fx_recordings").select("source_key", (F.col("duration_us") / 1e6).alias("duration_s"))
    return rounded(P.hand_intervals(rec, written(_proposals(spark, d), "proposals"), _samples(spark, d)))


@query("""WITH s AS (SELECT source_key, 0.0::DOUBLE AS start_s, duration_us / 1e6 AS end_s FROM {fx_recordings}),
    x AS (SELECT s.*, b / 1000.0::DOUBLE AS b, e / 1000.0::DOUBLE AS e FROM s JOIN (""" + _SEEN + """) USING (source_key) WHERE b / 1000.0::DOUBLE < end_s
          UNION ALL SELECT s.*, end_s, NULL FROM s),
    c AS (SELECT *, greatest(start_s, max(e) OVER (PARTITION BY source_key ORDER BY e IS NULL, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS cur FROM x),
    g AS (SELECT source_key, cur, round(b - cur, 9) AS gap, row_number() OVER (PARTITION BY source_key ORDER BY round(b - cur, 9) DESC, cur) AS r FROM c WHERE round(b - cur, 9) > 0)
    SELECT s.source_key, s.start_s, round(s.end_s, 6) AS end_s, round(CASE WHEN cur + gap / 2 > s.start_s + 0.25 AND cur + gap / 2 < s.end_s - 0.25 THEN cur + gap / 2 ELSE s.start_s + (s.end_s - s.start_s) / 2 END, 6) AS split_s
    FROM s LEFT JOIN (SELECT * FROM g WHERE r = 1) g USING (source_key)""")  # fmt: skip
def split_points(spark: SparkSession, d: str) -> DataFrame:
    spans = fixture(spark, d, "fx_recordings").select("source_key", F.lit(0.0).alias("start_s"), (F.col("duration_us") / 1e6).alias("end_s"))
    return rounded(P.split_points(spans, _samples(spark, d), PERIOD))


@query("""WITH RECURSIVE p0 AS (SELECT source_key, t_ms / 1000.0::DOUBLE AS b, t_ms / 1000.0::DOUBLE + 0.2 AS e FROM {fx_hand_samples} WHERE n > 0 AND a >= 0.01),
    r AS (SELECT source_key, 0.0::DOUBLE AS start_s, duration_us / 1e6 AS end_s FROM {fx_recordings}
          UNION ALL
          SELECT source_key, unnest([start_s, cut]), unnest([cut, end_s]) FROM (
              SELECT source_key, start_s, end_s, CASE WHEN mid > start_s + 0.25 AND mid < end_s - 0.25 THEN mid ELSE start_s + (end_s - start_s) / 2 END AS cut FROM (
                  SELECT source_key, start_s, end_s, arg_max(cur + gap / 2, (gap, -cur)) FILTER (WHERE gap > 0) AS mid FROM (
                      SELECT source_key, start_s, end_s, cur, round(b - cur, 9) AS gap FROM (
                          SELECT source_key, start_s, end_s, b,
                                 greatest(start_s, max(e) OVER (PARTITION BY source_key, start_s, end_s ORDER BY e IS NULL, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS cur
                          FROM (SELECT r.source_key, start_s, end_s, b, e FROM r JOIN p0 USING (source_key) WHERE end_s - start_s > 20 AND least(e, end_s) - greatest(b, start_s) > 0
                                UNION ALL SELECT source_key, start_s, end_s, end_s, NULL FROM r WHERE end_s - start_s > 20) x) y) z GROUP BY ALL) u) v)
    SELECT source_key, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s FROM r WHERE end_s - start_s <= 20""")
def split_long_spans(spark: SparkSession, d: str) -> DataFrame:
    spans = fixture(spark, d, "fx_recordings").select("source_key", F.lit(0.0).alias("start_s"), (F.col("duration_us") / 1e6).alias("end_s"))
    return rounded(P.split_long_spans(spans, _samples(spark, d), PERIOD, 20.0))


@query("""SELECT interval_id, i AS window_idx, start_s::DOUBLE + i * 8.0 AS start_s, least(start_s::DOUBLE + i * 8.0 + 10.0, end_s::DOUBLE) AS end_s
    FROM (SELECT *, unnest(range(CASE WHEN end_s - start_s <= 10 THEN 1 ELSE 1 + CAST(ceil((end_s - start_s - 10) / 8.0) AS BIGINT) END)) AS i FROM {fx_intervals})""")  # fmt: skip
def analysis_windows(spark: SparkSession, d: str) -> DataFrame:
    i = fixture(spark, d, "fx_intervals").select("interval_id", P.analysis_windows(F.col("start_s").cast("double"), F.col("end_s").cast("double"), 10.0, 2.0).alias("w"))
    return i.select("interval_id", F.posexplode("w").alias("i", "x")).select("interval_id", F.col("i").cast("long").alias("window_idx"), "x.start_s", "x.end_s")


def _clips(spark: SparkSession, d: str) -> DataFrame:
    i = fixture(spark, d, "fx_intervals").select("source_key", F.col("interval_id").alias("id"), F.col("start_s").cast("double").alias("start_s"), F.col("end_s").cast("double").alias("end_s"))
    rec = fixture(spark, d, "fx_recordings").select("source_key", "start_timestamp_us")
    t = fixture(spark, d, "fx_frames").join(rec, "source_key").select("source_key", "idx", S.relative_s(F.col("timestamp_us"), F.col("start_timestamp_us")).alias("t"))
    return P.frame_ranges(t, i)


_TIMES = "t AS (SELECT f.source_key, idx, (timestamp_us - start_timestamp_us) / 1e6 AS t FROM {fx_frames} f JOIN {fx_recordings} r ON r.source_key = f.source_key)"
_CLIPS = f"""WITH {_TIMES}""" + """,
    c AS (SELECT i.interval_id AS id, min(idx) FILTER (WHERE t >= start_s) AS s, coalesce(min(idx) FILTER (WHERE t > end_s), max(idx) + 1) AS e FROM {fx_intervals} i JOIN t USING (source_key) GROUP BY i.interval_id),
    cl AS (SELECT source_key, interval_id AS id, start_s::DOUBLE AS start_s, end_s::DOUBLE AS end_s, CASE WHEN s < e THEN s END AS start_idx, CASE WHEN s < e THEN e END AS end_idx, CASE WHEN s < e THEN NULL ELSE 'no frames in range' END AS error
           FROM {fx_intervals} LEFT JOIN c ON c.id = interval_id)"""


@query(f"{_CLIPS} SELECT * FROM cl")
def clip_ranges(spark: SparkSession, d: str) -> DataFrame:
    return _clips(spark, d)


@query(f"""{_CLIPS} SELECT cl.source_key, id, a.file_offset AS first_byte, z.file_offset + z.block_size AS last_byte, end_idx - start_idx AS frames, 472 + z.file_offset + z.block_size - a.file_offset AS index_offset
    FROM cl JOIN {{fx_index}} a ON a.source_key = cl.source_key AND a.entry = start_idx JOIN {{fx_index}} z ON z.source_key = cl.source_key AND z.entry = end_idx - 1 WHERE error IS NULL""")  # fmt: skip
def clip_byte_plan(spark: SparkSession, d: str) -> DataFrame:
    return P.clip_byte_plan(fixture(spark, d, "fx_index"), _clips(spark, d))


# ---- labels -------------------------------------------------------------------------------

_NORM = "trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9\\s]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_LABELS = f"lb AS (SELECT interval_id, source_key, proposed_task_name, short_caption, confidence::DOUBLE AS confidence, is_manipulation, k, {_NORM.replace('{c}', 'proposed_task_name')} AS normalized_task_name, string_split(short_caption, ' ') AS primary_objects FROM {{fx_labels}})"


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "fx_labels").withColumns({"normalized_task_name": S.normalize_label(F.col("proposed_task_name")), "primary_objects": F.split("short_caption", " "), "confidence": F.col("confidence").cast("double")})


@query(f"WITH {_LABELS} SELECT interval_id, normalized_task_name, normalized_task_name || ' | ' || array_to_string(list_sort(list_transform(primary_objects, lambda x: {_NORM.replace('{c}', 'x')})), ' ') || ' | ' || {_NORM.replace('{c}', 'short_caption')} AS cluster_text FROM lb")
def label_normalize(spark: SparkSession, d: str) -> DataFrame:
    lb = _labels(spark, d)
    return lb.select("interval_id", "normalized_task_name", S.cluster_text(F.col("proposed_task_name"), F.col("primary_objects"), F.col("short_caption")).alias("cluster_text"))


@query(f"WITH {_LABELS} SELECT interval_id, source_key, CASE WHEN k % 5 = 0 THEN false ELSE is_manipulation END AS is_manipulation, normalized_task_name, short_caption, array_to_string(primary_objects, ',') AS primary_objects, round(confidence, 6) AS confidence FROM lb")
def label_parse(spark: SparkSession, d: str) -> DataFrame:
    """Answers as models give them: bare, fenced or within prose; some with an odd truth value."""
    lb = _labels(spark, d)
    flag = F.when(F.col("k") % 5 == 0, "no").otherwise(F.col("is_manipulation").cast("string"))
    body = F.to_json(F.struct(flag.alias("is_manipulation"), "proposed_task_name", "short_caption", "primary_objects", F.round("confidence", 6).alias("confidence"), F.lit("seen").alias("reason")))
    raw = F.when(F.col("k") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("k") % 3 == 1, F.concat(F.lit("Here it is: "), body, F.lit(" - done"))).otherwise(body)
    good, _ = L.parse_answers(lb.select("interval_id", "source_key", raw.alias("raw")))
    return rounded(good.select("interval_id", "source_key", "is_manipulation", "normalized_task_name", "short_caption", F.array_join("primary_objects", ",").alias("primary_objects"), "confidence"))


_UNIT = "u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.v, b.v) AS similarity FROM u a JOIN u b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.4)"
SIMILAR = 0.40  # no pair of the synthetic vectors reaches the default of 0.82


@query(f"WITH {_UNIT} SELECT a, b, round(similarity, 6) AS similarity FROM pairs")
def similar_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(L.similar_pairs(fixture(spark, d, "embeddings"), SIMILAR))


@query(f"""WITH RECURSIVE {_UNIT}, e AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
    r AS (SELECT vec_id AS id, vec_id AS far FROM u UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.far) SELECT id, min(far) AS component FROM r GROUP BY id""")  # fmt: skip
def components(spark: SparkSession, d: str) -> DataFrame:
    v = fixture(spark, d, "embeddings")
    return L.connected_components(v.select(F.col("vec_id").alias("id")), L.similar_links(v, SIMILAR))


_CANON = "cn AS (SELECT cluster, name AS canonical_task_name FROM (SELECT normalized_task_name AS cluster, normalized_task_name AS name, count(*) AS n FROM lb WHERE is_manipulation GROUP BY ALL))"
_BUCKETS = f"""WITH {_LABELS},
    bk AS (SELECT normalized_task_name AS name, count(*) AS member_count, avg(confidence) AS ac, list_sort(list_distinct(flatten(list(primary_objects)))) AS ob, min(interval_id) AS f FROM lb WHERE is_manipulation GROUP BY name),
    bn AS (SELECT *, row_number() OVER (ORDER BY member_count DESC, name, f) - 1 AS r FROM bk),
    bb AS (SELECT 'bucket_' || CASE WHEN r < 1000 THEN lpad(r::VARCHAR, 3, '0') ELSE r::VARCHAR END AS bucket_id, name AS canonical_task_name, member_count, name AS source_labels, round(ac, 6) AS average_confidence, array_to_string(ob, ',') AS primary_objects FROM bn
           UNION ALL SELECT 'bucket_non_manipulation', 'non_manipulation', count(*), 'idle_or_other', round(avg(confidence), 6), '' FROM lb WHERE NOT is_manipulation HAVING count(*) > 0),
    mp AS (SELECT interval_id, coalesce(bucket_id, 'bucket_non_manipulation') AS bucket_id FROM lb LEFT JOIN bb ON is_manipulation AND normalized_task_name = canonical_task_name)"""


@query(f"{_BUCKETS} SELECT * FROM bb")
def buckets(spark: SparkSession, d: str) -> DataFrame:
    b = L.buckets(_labels(spark, d))[0]
    return rounded(b.withColumns({"source_labels": F.array_join("source_labels", ","), "primary_objects": F.array_join("primary_objects", ",")}))


@query(f"{_BUCKETS} SELECT * FROM mp")
def bucket_mapping(spark: SparkSession, d: str) -> DataFrame:
    return L.buckets(_labels(spark, d))[1]


@query(f"""WITH {_LABELS}, c AS (SELECT source_key AS cluster, normalized_task_name AS name, count(*) AS n, min(interval_id) AS f FROM lb GROUP BY ALL)
    SELECT cluster, name AS canonical_task_name FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, f) AS r FROM c) WHERE r = 1""")  # fmt: skip
def canonical_names(spark: SparkSession, d: str) -> DataFrame:
    return L.canonical_names(_labels(spark, d).withColumn("cluster", F.col("source_key")))


# ---- review overlay -----------------------------------------------------------------------


def _episodes(spark: SparkSession, d: str) -> DataFrame:
    rec = fixture(spark, d, "fx_recordings").select("source_key", (F.col("duration_us") / 1e6).alias("duration_s"), "rec", "session_name", "total_frames")
    j = rec.join(_verdicts(spark, d).select("source_key", "verdict", "activity_score"), "source_key", "left")
    valid = F.col("rec") % 11 != 7
    return j.select(
        S.episode_id(F.col("source_key")).alias("episode_id"), "source_key", F.when(valid, "valid").otherwise("invalid").alias("validation_status"),
        V.episode_status(valid, F.col("duration_s"), F.col("verdict")).alias("episode_status"), "verdict", "activity_score", "rec", "session_name", "duration_s", "total_frames",
    )


_EPISODES = f"""{_VERDICT},
    ep AS (SELECT 'ep_' || substr(sha1(r.source_key), 1, 16) AS episode_id, r.source_key, CASE WHEN r.rec % 11 <> 7 THEN 'valid' ELSE 'invalid' END AS validation_status,
                  CASE WHEN r.rec % 11 = 7 THEN 'invalid' WHEN r.duration_us / 1e6 < 5 THEN 'reject' WHEN verdict IS NULL THEN 'invalid' WHEN verdict = 'KEEP' THEN 'keep' WHEN verdict = 'PRUNE_CONFIDENT' THEN 'reject' ELSE 'review' END AS episode_status,
                  verdict, activity_score, r.rec, r.session_name, r.duration_us / 1e6 AS duration_s, r.total_frames FROM {{fx_recordings}} r LEFT JOIN verdict USING (source_key)),
    ee AS (SELECT *, CASE WHEN rec % 3 = 0 AND validation_status = 'valid' THEN CASE WHEN rec % 2 = 0 THEN 'reject' ELSE 'keep' END ELSE episode_status END AS effective_episode_status FROM ep),
    ei AS (SELECT interval_id, source_key, k, CASE WHEN k % 14 = 0 THEN 'reject' ELSE 'keep' END AS effective_interval_decision,
                  CASE WHEN k % 7 = 0 AND k % 14 <> 0 THEN least(start_s + 0.5, end_s)::DOUBLE ELSE start_s::DOUBLE END AS effective_start_s, end_s::DOUBLE AS effective_end_s FROM {{fx_intervals}}),
    ai AS (SELECT ei.* FROM ei LEFT JOIN ee USING (source_key) WHERE effective_interval_decision <> 'reject' AND coalesce(effective_episode_status, '') NOT IN ('reject', 'invalid'))"""


def _episode_overrides(e: DataFrame) -> DataFrame:
    raw = F.to_json(F.struct(F.when(F.col("rec") % 2 == 0, "reject").otherwise("keep").alias("episode_status"), F.lit("seen").alias("note")))
    return e.filter("rec % 3 = 0").select("episode_id", V.parse_overrides(raw).alias("o"))


def _effective_episodes(spark: SparkSession, d: str) -> DataFrame:
    e = _episodes(spark, d)
    return V.effective_episodes(e, _episode_overrides(e))


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "fx_intervals").withColumns({"start_s": F.col("start_s").cast("double"), "end_s": F.col("end_s").cast("double")})


def _interval_overrides(i: DataFrame) -> DataFrame:
    raw = F.when(F.col("k") % 14 == 0, F.lit('{"decision": "reject"}')).otherwise(F.concat(F.lit('{"trim_start_s": '), (F.col("start_s") + 0.5).cast("string"), F.lit(', "note": null}')))
    return i.filter("k % 7 = 0").select("interval_id", V.parse_overrides(raw).alias("o"))


def _effective_intervals(spark: SparkSession, d: str) -> DataFrame:
    i = _intervals(spark, d)
    return V.effective_intervals(i, _interval_overrides(i))


def _label_overrides(lb: DataFrame) -> DataFrame:
    raw = F.when(F.col("k") % 27 == 0, F.lit('{"short_caption": null}')).otherwise(F.lit('{"proposed_task_name": "Stack  RED cups!", "confidence": "0.9"}'))
    return lb.filter("k % 9 = 0").select("interval_id", V.parse_overrides(raw).alias("o"))


def _effective_labels(spark: SparkSession, d: str) -> DataFrame:
    lb = _labels(spark, d)
    return V.effective_labels(lb, _label_overrides(lb))


@query(f"{_EPISODES} SELECT episode_id, source_key, validation_status, episode_status, verdict, round(activity_score, 6) AS activity_score FROM ep")
def episode_status(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_episodes(spark, d).drop("rec", "session_name", "duration_s", "total_frames"))


@query(f"{_EPISODES} SELECT episode_id, effective_episode_status FROM ee")
def effective_episodes(spark: SparkSession, d: str) -> DataFrame:
    return _effective_episodes(spark, d).select("episode_id", "effective_episode_status")


@query(f"{_EPISODES} SELECT interval_id, effective_interval_decision, effective_start_s, effective_end_s, effective_end_s - effective_start_s AS effective_duration_s FROM ei")
def effective_intervals(spark: SparkSession, d: str) -> DataFrame:
    return _effective_intervals(spark, d).select("interval_id", "effective_interval_decision", "effective_start_s", "effective_end_s", "effective_duration_s")


_EFF_LABELS = f"""{_LABELS}, el AS (SELECT interval_id, source_key, is_manipulation, k, primary_objects, CASE WHEN k % 9 = 0 AND k % 27 <> 0 THEN 'stack red cups' ELSE normalized_task_name END AS normalized_task_name,
    CASE WHEN k % 27 = 0 THEN NULL ELSE short_caption END AS short_caption, CASE WHEN k % 9 = 0 AND k % 27 <> 0 THEN 0.9 ELSE confidence END AS confidence FROM lb)"""


@query(f"WITH {_EFF_LABELS} SELECT interval_id, normalized_task_name, short_caption, round(confidence, 6) AS confidence FROM el")
def effective_labels(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_effective_labels(spark, d).select("interval_id", "normalized_task_name", "short_caption", "confidence"))


@query(f"{_EPISODES} SELECT interval_id, source_key FROM ai")
def active_intervals(spark: SparkSession, d: str) -> DataFrame:
    return V.active_intervals(_effective_intervals(spark, d), _effective_episodes(spark, d)).select("interval_id", "source_key")


@query(f"{_EPISODES}, {_LABELS} SELECT interval_id, normalized_task_name FROM lb WHERE interval_id IN (SELECT interval_id FROM ai)")
def active_labels(spark: SparkSession, d: str) -> DataFrame:
    return V.active_labels(_labels(spark, d), _effective_intervals(spark, d), _effective_episodes(spark, d)).select("interval_id", "normalized_task_name")


_EFF_BUCKETS = f"""{_BUCKETS}, {_EFF_LABELS.replace(_LABELS + ', ', '')},
    m2 AS (SELECT interval_id, CASE WHEN k % 21 = 0 THEN 'bucket_custom' ELSE bucket_id END AS bucket_id FROM mp JOIN (SELECT interval_id, k FROM lb) USING (interval_id)),
    ag AS (SELECT m2.bucket_id, count(*) AS member_count, array_to_string(list_sort(list_distinct(list(normalized_task_name))), ',') AS source_labels, array_to_string(list_sort(list_distinct(flatten(list(primary_objects)))), ',') AS primary_objects,
                  round_even(coalesce(avg(confidence), 0), 6) AS average_confidence FROM m2 LEFT JOIN el USING (interval_id) GROUP BY m2.bucket_id),
    eq AS (SELECT bucket_id, CASE WHEN bucket_id = 'bucket_000' THEN 'renamed' ELSE coalesce(canonical_task_name, 'Custom task') END AS canonical_task_name, ag.member_count, ag.source_labels, ag.average_confidence, ag.primary_objects
           FROM ag LEFT JOIN bb USING (bucket_id))"""


def _moves(lb: DataFrame) -> DataFrame:
    return lb.filter("k % 21 = 0").select("interval_id", F.lit("bucket_custom").alias("bucket_id"), F.lit("Custom task").alias("canonical_task_name"))


def _renames(b: DataFrame) -> DataFrame:
    return b.filter("bucket_id = 'bucket_000'").select("bucket_id", F.lit("renamed").alias("canonical_task_name"))


@query(f"{_EFF_BUCKETS} SELECT * FROM eq")
def effective_buckets(spark: SparkSession, d: str) -> DataFrame:
    lb = _labels(spark, d)
    b, m, _ = L.buckets(lb)
    e = V.effective_buckets(_effective_labels(spark, d), b, m, _renames(b), _moves(lb))
    return e.withColumns({"source_labels": F.array_join("source_labels", ","), "primary_objects": F.array_join("primary_objects", ",")})


@query(f"""WITH {_LABELS} SELECT interval_id, CASE WHEN k % 8 = 1 THEN false WHEN k % 8 = 2 THEN true WHEN k % 8 = 4 THEN false ELSE is_manipulation END AS is_manipulation,
    CASE WHEN k % 8 = 4 THEN k::VARCHAR ELSE short_caption END AS short_caption,
    array_to_string(CASE WHEN k % 8 = 0 THEN ['red', 'cup ' || k] WHEN k % 8 IN (2, 3) THEN NULL ELSE primary_objects END, ',') AS primary_objects,
    round(CASE WHEN k % 8 IN (0, 1) THEN (k % 50) / 100 WHEN k % 8 = 3 THEN NULL ELSE confidence END, 6) AS confidence,
    CASE WHEN k % 8 = 3 THEN '{{"by":"me"}}' WHEN k % 8 = 4 THEN k::VARCHAR END AS override_note FROM lb""".replace("{{", "{").replace("}}", "}"))
def override_types(spark: SparkSession, d: str) -> DataFrame:
    """Labels under overrides of all types: numbers, lists, truth values, nulls, texts that hold one and texts that do not, none."""
    lb, k = _labels(spark, d), F.col("k")
    number, at = (k % 50 / 100).cast("string"), k % 8
    raw = (
        F.when(at == 0, F.concat(F.lit('{"confidence": '), number, F.lit(', "primary_objects": ["red", "cup '), k, F.lit('"]}')))
        .when(at == 1, F.concat(F.lit('{"confidence": "'), number, F.lit('", "is_manipulation": "no"}'))).when(at == 2, F.lit('{"primary_objects": null, "is_manipulation": 1}'))
        .when(at == 3, F.lit('{"confidence": "high", "primary_objects": "cup", "note": {"by": "me"}}')).when(at == 4, F.concat(F.lit('{"short_caption": '), k, F.lit(', "is_manipulation": false, "note": '), k, F.lit("}")))
        .when(at == 5, F.lit("{}")).otherwise(F.lit("[1]"))
    )
    e = V.effective_labels(lb, lb.filter(at != 7).select("interval_id", V.parse_overrides(raw).alias("o")))
    return rounded(e.select("interval_id", "is_manipulation", "short_caption", F.array_join("primary_objects", ",").alias("primary_objects"), "confidence", "override_note"))


@query(f"""{_EPISODES}, {_EFF_BUCKETS.removeprefix("WITH ")}
    SELECT 'episode' AS kind, episode_id AS id, effective_episode_status AS state, CASE WHEN rec % 3 = 0 AND validation_status = 'valid' THEN 'seen' END AS note, NULL::DOUBLE AS low, NULL::DOUBLE AS high FROM ee
    UNION ALL SELECT 'interval', interval_id, effective_interval_decision, NULL, round(effective_start_s, 6), round(effective_end_s, 6) FROM ei
    UNION ALL SELECT 'label', interval_id, normalized_task_name, NULL, round(confidence, 6), NULL FROM el
    UNION ALL SELECT 'bucket', bucket_id, canonical_task_name, NULL, average_confidence, member_count::DOUBLE FROM eq""")
def materialize_job(spark: SparkSession, d: str) -> DataFrame:
    """All four tables of the job, each as kind, id, state, note and two numbers."""
    e, i, lb = _episodes(spark, d), _intervals(spark, d), _labels(spark, d)
    b, m, _ = L.buckets(lb)
    overrides = {"episodes": _episode_overrides(e), "intervals": _interval_overrides(i), "labels": _label_overrides(lb), "renames": _renames(b), "assignments": _moves(lb)}
    t, none = jobs.materialize(e, i, lb, b, m, overrides), F.lit(None).cast("double")
    parts = (
        ("episode", "effective_episodes", "episode_id", "effective_episode_status", F.col("override_note"), none, none),
        ("interval", "effective_intervals", "interval_id", "effective_interval_decision", F.col("override_note"), F.col("effective_start_s"), F.col("effective_end_s")),
        ("label", "effective_labels", "interval_id", "normalized_task_name", F.col("override_note"), F.col("confidence"), none),
        ("bucket", "effective_buckets", "bucket_id", "canonical_task_name", F.lit(None).cast("string"), F.col("average_confidence"), F.col("member_count").cast("double")),
    )
    rows = [t[name].select(F.lit(kind).alias("kind"), F.col(id_).alias("id"), F.col(state).alias("state"), note.alias("note"), low.alias("low"), high.alias("high")) for kind, name, id_, state, note, low, high in parts]
    return rounded(reduce(DataFrame.unionByName, rows))


@query(f"""{_EPISODES.replace("WITH ", "WITH RECURSIVE ", 1)}, {_LABELS},
    al AS (SELECT * FROM lb WHERE interval_id IN (SELECT interval_id FROM ai)),
    uv AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE 'int_' || (vec_id + 1) IN (SELECT interval_id FROM al WHERE is_manipulation)),
    near AS (SELECT x.vec_id AS a, y.vec_id AS b FROM uv x JOIN uv y ON x.vec_id < y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= {SIMILAR}),
    both_ways AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
    rc AS (SELECT vec_id AS id, vec_id AS far FROM uv UNION SELECT rc.id, z.b FROM rc JOIN both_ways z ON z.a = rc.far),
    cl AS (SELECT 'int_' || (id + 1) AS interval_id, 'vector ' || min(far) AS cluster FROM rc GROUP BY id),
    kb AS (SELECT al.*, coalesce(cluster, 'name ' || normalized_task_name) AS cluster FROM al LEFT JOIN cl USING (interval_id) WHERE is_manipulation),
    nm AS (SELECT cluster, normalized_task_name AS name, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, min(interval_id)) AS r FROM kb GROUP BY cluster, normalized_task_name),
    sz AS (SELECT cluster, count(*) AS n, array_to_string(list_sort(list_distinct(list(normalized_task_name))), ',') AS names, avg(confidence) AS ac, min(interval_id) AS f FROM kb GROUP BY cluster),
    nb AS (SELECT sz.*, name, row_number() OVER (ORDER BY n DESC, name, f) - 1 AS r FROM sz JOIN (SELECT cluster, name FROM nm WHERE r = 1) USING (cluster))
    SELECT 'bucket_' || CASE WHEN r < 1000 THEN lpad(r::VARCHAR, 3, '0') ELSE r::VARCHAR END AS bucket_id, name AS canonical_task_name, n AS member_count, names AS source_labels, round(ac, 6) AS average_confidence, n = 1 OR ac < 0.55 AS to_review FROM nb
    UNION ALL SELECT 'bucket_non_manipulation', 'non_manipulation', count(*), 'idle_or_other', round(avg(confidence), 6), false FROM al WHERE NOT is_manipulation HAVING count(*) > 0""")
def cluster_job_with_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Buckets of active labels by similarity of their vectors; those that have none go by name."""
    vectors = fixture(spark, d, "embeddings").select(F.concat(F.lit("int_"), F.col("vec_id") + 1).alias("interval_id"), "vec_id", "embedding")
    found, _, review = jobs.cluster(_labels(spark, d), _effective_intervals(spark, d), _effective_episodes(spark, d), vectors, SIMILAR)
    sent = review.select(F.col("identifier").alias("bucket_id"), F.lit(True).alias("_sent"))
    rows = found.join(sent, "bucket_id", "left").withColumns({"source_labels": F.array_join("source_labels", ","), "to_review": F.coalesce("_sent", F.lit(False))})
    return rounded(rows.select("bucket_id", "canonical_task_name", "member_count", "source_labels", "average_confidence", "to_review"))


@query(f"""{_EPISODES}, {_LABELS},
    q AS (SELECT 'qc' AS stage, source_key AS identifier, CASE WHEN validation_status = 'invalid' THEN 'invalid_episode' ELSE 'needs_human_review' END AS reason FROM ep WHERE validation_status = 'invalid' OR episode_status = 'review'
          UNION ALL SELECT 'label', interval_id, 'low_confidence_or_non_manipulation' FROM lb WHERE confidence < 0.55 OR NOT is_manipulation)
    SELECT stage, identifier, reason, 'rev_' || substr(sha1(stage || '::' || identifier || '::' || reason), 1, 16) AS review_id FROM q""")  # fmt: skip
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    return V.review_queue(jobs.qc_reviews(_episodes(spark, d)), jobs.label_reviews(_labels(spark, d)))


@query(f"""{_HAND_INTERVALS.replace('SELECT source_key, round(start_s, 6)', ', hi AS (SELECT source_key, round(start_s, 6)', 1)}),
    q AS (SELECT source_key, CASE WHEN rec % 12 = 1 THEN 'interval_export_failed' WHEN source_key NOT IN (SELECT source_key FROM pr) THEN 'no_interval_proposals'
                 WHEN rec % 12 = 2 THEN 'hand_detection_failed' WHEN source_key NOT IN (SELECT source_key FROM hands) THEN 'no_hands_detected'
                 WHEN source_key NOT IN (SELECT source_key FROM hi) THEN 'no_hand_activity_overlap' END AS reason FROM {{fx_recordings}})
    SELECT 'intervals' AS stage, source_key AS identifier, reason, 'rev_' || substr(sha1('intervals::' || source_key || '::' || reason), 1, 16) AS review_id FROM q WHERE reason IS NOT NULL""")
def interval_reviews(spark: SparkSession, d: str) -> DataFrame:
    rec = fixture(spark, d, "fx_recordings")
    return jobs.intervals(_proposals(spark, d), rec, _samples(spark, d), rec.filter("rec % 12 = 1"), rec.filter("rec % 12 = 2"))[1]


@query(f"""WITH {_LABELS}, q AS (SELECT interval_id, 'low_confidence_or_non_manipulation' AS reason FROM lb WHERE confidence < 0.55 OR NOT is_manipulation
    UNION ALL SELECT interval_id, 'missing_storyboard' FROM {{fx_intervals}} WHERE k % 8 = 3)
    SELECT 'label' AS stage, interval_id AS identifier, reason FROM q""")
def label_job(spark: SparkSession, d: str) -> DataFrame:
    """Review rows of the label job: unsure answers, and intervals without a storyboard."""
    lb, wanted = _labels(spark, d), fixture(spark, d, "fx_intervals")
    raw = F.to_json(F.struct(F.col("is_manipulation").cast("string").alias("is_manipulation"), "proposed_task_name", "short_caption", "primary_objects", "confidence"))
    return jobs.label(lb.select("interval_id", "source_key", raw.alias("raw")), wanted=wanted, storyboards=wanted.filter("k % 8 <> 3"))[1].drop("review_id")


@query(f"""{_EPISODES} SELECT interval_id, ei.source_key, effective_start_s, effective_end_s, round(effective_end_s - effective_start_s, 6) AS duration_s FROM ei LEFT JOIN ee USING (source_key)
    WHERE effective_interval_decision <> 'reject' AND coalesce(effective_episode_status, 'keep') IN ('keep', 'review') AND effective_end_s > effective_start_s""")  # fmt: skip
def segment_manifest(spark: SparkSession, d: str) -> DataFrame:
    return V.exportable_segments(_effective_intervals(spark, d), _effective_episodes(spark, d))[0]


@query("""WITH o AS (SELECT interval_id, k, 0 AS p, k AS v FROM {fx_labels} UNION ALL SELECT interval_id, k, 1, k * 10 FROM {fx_labels} WHERE k % 3 = 0 UNION ALL SELECT interval_id, k, 2, k * 100 FROM {fx_labels} WHERE k % 6 = 0)
    SELECT interval_id, v FROM (SELECT *, row_number() OVER (PARTITION BY interval_id ORDER BY p DESC) AS r FROM o) WHERE r = 1""")  # fmt: skip
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = fixture(spark, d, "fx_labels").select("interval_id", "k")
    new = rows.filter("k % 3 = 0").selectExpr("interval_id", "k * 10 AS v", "1 AS o").union(rows.filter("k % 6 = 0").selectExpr("interval_id", "k * 100 AS v", "2 AS o"))
    return V.upsert(rows.selectExpr("interval_id", "k AS v", "0 AS o"), new, ["interval_id"], "o").select("interval_id", "v")


# ---- manifests and uploads ----------------------------------------------------------------

_MANIFEST = "mf AS (SELECT split_part(source_key, '/', 1) AS dataset, split_part(source_key, '/', 2) AS filename, session_name, duration_us / 1e6 AS duration_s, total_frames AS frames, rec FROM {fx_recordings})"


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    parts = F.split("source_key", "/")
    return fixture(spark, d, "fx_recordings").select(parts[0].alias("dataset"), parts[1].alias("filename"), "session_name", (F.col("duration_us") / 1e6).alias("duration_s"), F.col("total_frames").alias("frames"), "rec")


@query(f"WITH {_MANIFEST} SELECT filename, frames FROM mf WHERE rec % 9 <> 1 OR rec % 9 = 1")
def manifest_add(spark: SparkSession, d: str) -> DataFrame:
    m = _manifest(spark, d)
    once = C.manifest_add(m.filter("rec % 9 <> 1"), m.filter("rec % 9 < 3"))
    return C.manifest_add(once, m.filter("rec % 9 < 3")).select("filename", "frames")


@query(f"WITH {_MANIFEST} SELECT filename, frames FROM mf WHERE rec % 9 <> 2")
def manifest_remove(spark: SparkSession, d: str) -> DataFrame:
    m = _manifest(spark, d)
    return C.manifest_remove(m, m.filter("rec % 9 = 2")).select("filename", "frames")


@query(f"WITH {_MANIFEST} SELECT filename, frames, CASE WHEN rec % 9 = 2 THEN '.pruned/' || filename END AS source FROM mf")
def manifest_restore(spark: SparkSession, d: str) -> DataFrame:
    m = _manifest(spark, d)
    restored, audit = C.manifest_restore(C.manifest_remove(m, m.filter("rec % 9 = 2")), m.filter("rec % 9 in (2, 3)"))
    return restored.select("filename", "frames").join(audit.select(F.col("destination").alias("filename"), "source"), "filename", "left")


@query(f"{_VERDICT} SELECT 'prune' AS op, split_part(source_key, '/', 2) AS filename, verdict, round(activity_score, 6) AS activity_score FROM verdict WHERE verdict = 'PRUNE_CONFIDENT' OR verdict = 'PRUNE_SUGGESTED' AND activity_score < 0.4")
def prune_plan(spark: SparkSession, d: str) -> DataFrame:
    a = _verdicts(spark, d).withColumn("filename", F.split("source_key", "/")[1])
    return rounded(C.manifest_prune(_manifest(spark, d), a, 0.4)[1])


@query(f"""{_segments(30, 45, 15)},
    k AS (SELECT seg.source_key, start_frame, end_frame, count(*) OVER (PARTITION BY seg.source_key) AS k, row_number() OVER (PARTITION BY seg.source_key ORDER BY start_frame) - 1 AS i, r.total_frames AS n FROM seg JOIN {{fx_recordings}} r USING (source_key))
    SELECT source_key, replace(split_part(source_key, '/', 2), '.rec', '') || '_seg' || lpad(i::VARCHAR, 3, '0') || '.rec' AS filename, start_frame, end_frame FROM k WHERE NOT (k = 1 AND start_frame = 0 AND end_frame = n)""")  # fmt: skip
def splice_plan(spark: SparkSession, d: str) -> DataFrame:
    return C.splice_plan(A.segments(A.scan(_frames(spark, d)), min_gap=30, min_duration=45, pad=15), fixture(spark, d, "fx_recordings"))


@query(f"WITH {_MANIFEST} SELECT dataset, round(sum(duration_s), 6) AS duration_s, sum(frames)::BIGINT AS frames, count(*) AS episodes FROM mf GROUP BY dataset")
def dataset_totals(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.dataset_totals(_manifest(spark, d)))


@query(f"""WITH {_MANIFEST}, n AS (SELECT (max(rec) + 1)::VARCHAR AS n FROM mf)
    SELECT 'demo_' || CASE WHEN length(n) < 3 THEN lpad(n, 3, '0') ELSE n END AS session_name FROM n UNION ALL SELECT 'a.b_000'""")
def session_names(spark: SparkSession, d: str) -> DataFrame:
    """The next names of a dataset in use, and of one that is not."""
    number = F.col("rec").cast("string")
    names = _manifest(spark, d).select(F.explode(F.array(F.concat(F.lit("demo_"), F.lpad(number, F.greatest(F.lit(3), F.length(number)), F.lit("0"))), F.lit("axb_007"))).alias("session_name"))
    return C.next_session(names, "demo").unionByName(C.next_session(names, "a.b"))


_PENDING = "pe AS (SELECT key, dataset, o.filename, size_bytes, mtime FROM {fx_objects} o WHERE NOT contains(key, '.pruned/') AND size_bytes >= 1024 AND epoch_us(TIMESTAMP '1999-01-01') - epoch_us(mtime) >= 10000000 AND filename NOT IN (SELECT filename FROM {fx_uploads} WHERE success))"


def _pending(spark: SparkSession, d: str) -> DataFrame:
    return C.pending_uploads(fixture(spark, d, "fx_objects"), fixture(spark, d, "fx_uploads"), F.expr(NOW))


@query(f"WITH {_PENDING} SELECT key, size_bytes FROM pe")
def pending_uploads(spark: SparkSession, d: str) -> DataFrame:
    return _pending(spark, d).select("key", "size_bytes")


@query(f"""WITH {_PENDING} SELECT t.dataset, files, total_size, coalesce(pc, 0) AS pending_count, coalesce(ps, 0) AS pending_size
    FROM (SELECT dataset, count(*) AS files, sum(size_bytes)::BIGINT AS total_size FROM {{fx_objects}} WHERE NOT contains(key, '.pruned/') GROUP BY dataset) t
    LEFT JOIN (SELECT dataset, count(*) AS pc, sum(size_bytes)::BIGINT AS ps FROM pe GROUP BY dataset) USING (dataset)""")  # fmt: skip
def dataset_sync_status(spark: SparkSession, d: str) -> DataFrame:
    return C.dataset_sync_status(fixture(spark, d, "fx_objects"), _pending(spark, d))


@query("SELECT filename, attempts, least(10 * 2.0 ** attempts, 300.0)::DOUBLE AS delay_s, (epoch_us(TIMESTAMP '1999-01-01') - epoch_us(last_attempt)) / 1e6 >= least(10 * 2.0 ** attempts, 300.0) AS due FROM {fx_uploads} WHERE NOT success")
def retry_schedule(spark: SparkSession, d: str) -> DataFrame:
    return C.retry_due(fixture(spark, d, "fx_uploads"), F.expr(NOW))


@query("""SELECT key, size_bytes, CASE WHEN up THEN 'delete' ELSE 'copy_and_delete' END AS action,
    CASE WHEN NOT up THEN CASE WHEN k % 4 <> 1 THEN key WHEN k % 8 = 1 THEN replace(key, '.rec', '_19990101_000000_' || substr(sha1(key), 1, 8) || '.rec') ELSE replace(key, '.rec', '_19990101_000000.rec') END END AS target
    FROM (SELECT *, filename IN (SELECT filename FROM {fx_uploads} WHERE success) AS up FROM {fx_objects})""")
def archive_plan(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth key is taken in the archive, and of every eighth the stamped name as well."""
    objects = fixture(spark, d, "fx_objects")
    held = objects.filter("k % 4 = 1").select("key").union(objects.filter("k % 8 = 1").select(F.replace("key", F.lit(".rec"), F.lit("_19990101_000000.rec"))))
    return C.archive_plan(objects, fixture(spark, d, "fx_uploads"), held, F.expr(NOW))


@query(f"WITH {_PENDING} SELECT count(*) AS loose_count, coalesce(sum(size_bytes), 0)::BIGINT AS loose_size FROM pe WHERE dataset NOT IN ('1-urgent', '2-high')")
def loose_pending(spark: SparkSession, d: str) -> DataFrame:
    known = fixture(spark, d, "fx_objects").select("dataset").filter("dataset in ('1-urgent', '2-high')")
    return jobs.upload_status(fixture(spark, d, "fx_objects"), fixture(spark, d, "fx_uploads"), F.expr(NOW), known)["loose"]


@query("""SELECT o_orderdate::DATE::VARCHAR AS cycle, count(*) AS files, sum(floor(o_totalprice)::BIGINT)::BIGINT AS bytes, sum(o_orderkey % 7 + 1)::DOUBLE AS elapsed_s,
    (max(o_orderkey % 1000 + o_orderkey % 7 + 1) - min(o_orderkey % 1000))::DOUBLE AS wall_s, round(sum(floor(o_totalprice)::BIGINT) / sum(o_orderkey % 7 + 1), 6) AS average_rate
    FROM orders GROUP BY cycle""")
def upload_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = fixture(spark, d, "orders").selectExpr(
        "cast(cast(o_orderdate AS date) AS string) AS cycle", "cast(floor(o_totalprice) AS bigint) AS size_bytes", "cast(o_orderkey % 1000 AS double) AS started",
        "cast(o_orderkey % 1000 + o_orderkey % 7 + 1 AS double) AS ended",
    )
    return rounded(C.upload_session(rows, "cycle"))


@query("""WITH p AS (SELECT o_custkey AS id, epoch_us(o_orderdate) / 1e6 AS ts_s, sum(floor(o_totalprice)::BIGINT) OVER (PARTITION BY o_custkey ORDER BY o_orderdate)::BIGINT AS bytes FROM orders),
    q AS (SELECT DISTINCT * FROM p), r AS (SELECT *, ts_s - lag(ts_s) OVER w AS dt, bytes - lag(bytes) OVER w AS db, ts_s - min(ts_s) OVER (PARTITION BY id) AS since FROM q WINDOW w AS (PARTITION BY id ORDER BY ts_s)),
    a AS (SELECT *, CASE WHEN since > 0 THEN bytes / since ELSE 0 END AS average_rate, max(bytes) OVER (PARTITION BY id) * 2 AS total FROM r)
    SELECT id, ts_s, bytes, round(CASE WHEN dt > 0 THEN db / dt ELSE 0 END, 6) AS rate, round(average_rate, 6) AS average_rate, round(bytes / total * 100, 6) AS percent,
           round(CASE WHEN average_rate > 0 THEN (total - bytes) / average_rate ELSE 0 END, 2) AS eta_s FROM a""")  # fmt: skip
def upload_rates(spark: SparkSession, d: str) -> DataFrame:
    p = spark.sql("SELECT DISTINCT o_custkey AS id, unix_micros(cast(o_orderdate AS timestamp)) / 1e6 AS ts_s, sum(cast(floor(o_totalprice) AS bigint)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS bytes FROM {orders}", orders=fixture(spark, d, "orders"))
    rates = C.upload_rates(p, p.groupBy("id").agg((F.max("bytes") * 2).alias("total")))
    return rounded(rates.withColumn("eta_s", F.round("eta_s", 2)))


# ---- exports, sessions, small functions ---------------------------------------------------


_CAMERAS = [
    "named_struct('fx', 600 + rec % 7, 'fy', 601, 'ppx', 320, 'ppy', 240) AS depth", "named_struct('fx', 900, 'fy', 901 + rec % 5, 'ppx', 640, 'ppy', 360) AS color",
    "array(1f, 0f, 0f, 0f, 1f, 0f, 0f, 0f, 1f) AS rotation", "array(cast(rec % 3 AS float), 0f, 5f) AS translation",
]
_TEXT = ("depth_intrinsics", "color_intrinsics", "extrinsic_R", "extrinsic_t")


@query("""SELECT f.source_key, session_name, camera_serial, idx AS step, round((timestamp_us - start_timestamp_us) / 1e6, 6) AS timestamp, idx = 0 AS is_first, idx = max(idx) OVER w AS is_last, idx = max(idx) OVER w AS is_terminal,
    (600 + r.rec % 7) || ',601,320,240' AS depth_intrinsics, '900,' || (901 + r.rec % 5) || ',640,360' AS color_intrinsics, '1,0,0,0,1,0,0,0,1' AS "extrinsic_R", (r.rec % 3) || ',0,5' AS extrinsic_t
    FROM {fx_frames} f JOIN {fx_recordings} r ON r.source_key = f.source_key WINDOW w AS (PARTITION BY f.source_key)""")  # fmt: skip
def rlds_steps(spark: SparkSession, d: str) -> DataFrame:
    steps = rounded(C.rlds_steps(fixture(spark, d, "fx_recordings").selectExpr("*", *_CAMERAS), fixture(spark, d, "fx_frames")))
    text = {c: F.array_join(F.transform(c, lambda x: x.cast("int").cast("string")), ",") for c in _TEXT}
    return steps.withColumns(text | {"step": F.col("step").cast("long")})


@query("""WITH e AS (SELECT source_key, row_number() OVER (ORDER BY source_key) - 1 AS episode_index, sum(total_frames) OVER (ORDER BY source_key) - total_frames AS before, start_timestamp_us FROM {fx_recordings})
    SELECT (before + idx)::BIGINT AS frame_index, episode_index, idx AS step, round(((timestamp_us - start_timestamp_us) / 1e6)::FLOAT::DOUBLE, 6) AS timestamp, 0::BIGINT AS task_index FROM {fx_frames} f JOIN e ON e.source_key = f.source_key""")  # fmt: skip
def lerobot_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = C.lerobot_rows(fixture(spark, d, "fx_recordings"), fixture(spark, d, "fx_frames"))
    return rows.withColumn("timestamp", F.round(F.col("timestamp").cast("double"), 6))


@query("""WITH g AS (SELECT source_key, idx, timestamp_us, coalesce(timestamp_us - lag(timestamp_us) OVER (PARTITION BY source_key ORDER BY idx), 0) AS gap_us FROM {fx_frames}),
    c AS (SELECT *, CASE WHEN gap_us <= 500000 THEN 'same' WHEN gap_us <= 1000000 THEN 'split' ELSE 'disconnect' END AS gap_class FROM g)
    SELECT *, sum(CASE WHEN gap_class = 'same' THEN 0 ELSE 1 END) OVER (PARTITION BY source_key ORDER BY idx)::BIGINT AS session FROM c""")  # fmt: skip
def episode_gap_split(spark: SparkSession, d: str) -> DataFrame:
    return C.gap_classes(fixture(spark, d, "fx_frames"))


@query("""WITH x AS (SELECT vec_id AS frame, unnest(list_transform(embedding, lambda v: CAST(floor(abs(v::DOUBLE) * 4000) AS INTEGER))) AS d FROM embeddings),
    c AS (SELECT frame, d, count(*) AS c FROM x WHERE d > 0 GROUP BY ALL), u AS (SELECT *, sum(c) OVER (PARTITION BY frame ORDER BY d) AS upto, sum(c) OVER (PARTITION BY frame) AS n FROM c)
    SELECT frame, min(d) FILTER (WHERE upto >= n * 0.02) AS d_min, greatest(min(d) FILTER (WHERE upto >= n * 0.98), min(d) FILTER (WHERE upto >= n * 0.02) + 1) AS d_max FROM u GROUP BY frame""")  # fmt: skip
def depth_range(spark: SparkSession, d: str) -> DataFrame:
    v = fixture(spark, d, "embeddings").select(F.col("vec_id").alias("frame"), F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 4000).cast("int")).alias("depth"))
    return C.depth_range(v)


@query("SELECT source_key, idx, round(idx / 30, 6) AS t FROM {fx_frames} WHERE idx % 6 = 0")
def frame_downsample(spark: SparkSession, d: str) -> DataFrame:
    step = S.downsample_step(F.lit(0.0), F.lit(5.0))
    return rounded(fixture(spark, d, "fx_frames").filter(F.pmod(F.col("idx"), step) == 0).select("source_key", "idx", (F.col("idx") / 30).alias("t")))


@query("SELECT interval_id, substr(coalesce(nullif(trim(regexp_replace(lower(trim(proposed_task_name)), '[^a-zA-Z0-9]+', '-', 'g'), '-'), ''), 'item'), 1, 80) AS slug, 'rev_' || substr(sha1('label::' || interval_id || '::x'), 1, 16) AS review_id FROM {fx_labels}")
def slug_ids(spark: SparkSession, d: str) -> DataFrame:
    lb = fixture(spark, d, "fx_labels")
    return lb.select("interval_id", S.slugify(F.col("proposed_task_name")).alias("slug"), S.review_id(F.lit("label"), F.col("interval_id"), F.lit("x")).alias("review_id"))


@query("""SELECT source_key, coalesce(nullif(camera_serial, ''), 'source-' || split_part(source_key, '/', 1)) AS profile_key, flags & 1 <> 0 AS has_imu, flags & 2 <> 0 AS has_index,
    CASE rgb_codec WHEN 0 THEN 'raw' WHEN 1 THEN 'JPEG' WHEN 2 THEN 'H264' ELSE 'unknown' END AS codec, rgb_codec = 2 AS streamable,
    CASE WHEN duration_us > 0 THEN round(total_frames / (duration_us / 1e6), 4) ELSE 0.0 END AS fps, strftime(make_timestamp(start_timestamp_us), '%Y/%m/%d') AS day_path FROM {fx_recordings}""")  # fmt: skip
def recording_catalog(spark: SparkSession, d: str) -> DataFrame:
    r = fixture(spark, d, "fx_recordings")
    return r.select(
        "source_key", S.profile_key(F.col("camera_serial"), F.col("source_key")).alias("profile_key"), S.has_flag(F.col("flags"), 0).alias("has_imu"), S.has_flag(F.col("flags"), 1).alias("has_index"),
        S.codec_name(F.col("rgb_codec")).alias("codec"), S.streamable(F.col("rgb_codec")).alias("streamable"), F.round(S.fps(F.col("total_frames"), F.col("duration_us") / 1e6), 4).alias("fps"),
        S.date_path(S.recorded_at(F.col("start_timestamp_us"))).alias("day_path"),
    )


@query("SELECT key, size_bytes FROM {fx_objects} WHERE size_bytes >= 1024")
def stage_selection(spark: SparkSession, d: str) -> DataFrame:
    """All valid objects; prefix and limit are options of the job."""
    objects = fixture(spark, d, "fx_objects").withColumn("validation_status", F.when(F.col("size_bytes") >= 1024, "valid").otherwise("invalid"))
    return jobs.stage(objects).select("key", "size_bytes")


@query("""SELECT device, time_bucket(INTERVAL '1 day', ts) AS start, count(*) AS captured, count(*) FILTER (WHERE event_id % 10 <> 0) AS written, sum(CASE WHEN event_id % 17 = 0 THEN 2 ELSE 0 END)::BIGINT AS dropped,
    coalesce(sum(bytes) FILTER (WHERE event_id % 10 <> 0), 0)::BIGINT AS bytes, round(count(*) / 86400, 6) AS capture_fps, round(count(*) FILTER (WHERE event_id % 10 <> 0) / 86400, 6) AS write_fps
    FROM {fx_telemetry} GROUP BY ALL""")
def capture_rates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(telemetry.capture_rates(_telemetry(spark, d), "1 day"))


@query("""SELECT device, count(*) AS captured, count(*) FILTER (WHERE event_id % 10 <> 0) AS written, sum(CASE WHEN event_id % 17 = 0 THEN 2 ELSE 0 END)::BIGINT AS dropped,
    coalesce(sum(bytes) FILTER (WHERE event_id % 10 <> 0), 0)::BIGINT AS bytes, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS seconds,
    round(CASE WHEN max(ts) > min(ts) THEN count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) ELSE 0 END, 6) AS capture_fps,
    round(CASE WHEN max(ts) > min(ts) THEN count(*) FILTER (WHERE event_id % 10 <> 0) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) ELSE 0 END, 6) AS write_fps FROM {fx_telemetry} GROUP BY device""")
def recording_rates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(telemetry.recording_rates(_telemetry(spark, d), ["device"]))


def _telemetry(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "fx_telemetry").withColumns({"written": F.col("event_id") % 10 != 0, "dropped": F.when(F.col("event_id") % 17 == 0, 2).otherwise(0)})


@query("""SELECT source_key, nullif(session_name, '') AS session_name, total_frames AS frame_count, duration_us / 1e6 AS duration_s, CASE WHEN duration_us > 0 THEN round_even(total_frames / (duration_us / 1e6), 2) END AS fps,
    nullif(camera_serial, '') AS camera_serial, flags & 1 <> 0 AS has_imu, rgb_codec, rgb_codec = 2 AS video_streamable,
    CASE WHEN rgb_codec <> 2 THEN 'rgb_codec=' || rgb_codec || ' is not browser-streamable (need 2 for H.264)' END AS video_stream_error FROM {fx_recordings}""")
def registration(spark: SparkSession, d: str) -> DataFrame:
    return jobs.registration(fixture(spark, d, "fx_recordings")).drop("recorded_at", "has_depth")


# ---- small functions over tables, and whole jobs ---------------------------------------------


_SIZE = "CASE WHEN x < 1024 THEN printf('%.1f B', x::DOUBLE) WHEN x < 1048576 THEN printf('%.1f KB', x / 1024.0::DOUBLE) ELSE printf('%.1f MB', x / 1048576.0::DOUBLE) END"


@query(f"""SELECT key, CASE WHEN starts_with(key, '1-urgent') THEN ltrim(substr(key, 9), '/') ELSE key END AS relative_key, split_part(key, '/', 1) AS source_prefix, {_SIZE.replace('x', 'size_bytes')} AS size_text,
    CASE WHEN k % 5000 < 60 THEN (k % 5000) || 's' WHEN k % 5000 < 3600 THEN printf('%dm %02ds', k % 5000 // 60, k % 5000 % 60) ELSE printf('%dh %02dm %02ds', k % 5000 // 3600, k % 5000 % 3600 // 60, k % 5000 % 60) END AS duration_text,
    'pub/x/' || key AS object_key, array_to_string(list_filter([trim(t) FOR t IN string_split(dataset || ', ,' || filename, ',')], lambda t: t <> ''), ',') AS tags,
    greatest(8 / greatest((k % 90)::DOUBLE, 1.0), 0.1) AS storyboard_rate FROM {{fx_objects}}""")
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    k, key = F.col("k"), F.col("key")
    return rounded(fixture(spark, d, "fx_objects").select(
        "key", S.relative_key(key, "1-urgent").alias("relative_key"), S.source_prefix(key).alias("source_prefix"), S.human_size(F.col("size_bytes")).alias("size_text"),
        S.human_duration((k % 5000).cast("double")).alias("duration_text"), S.object_key("/pub/x/", key).alias("object_key"),
        S.join_tags(S.tags(F.concat("dataset", F.lit(", ,"), "filename"))).alias("tags"), S.storyboard_rate(F.lit(8), (k % 90).cast("double")).alias("storyboard_rate"),
    ), 9)


@query("SELECT interval_id, 'int_' || substr(sha1(source_key || '::' || (start_s * 1000)::BIGINT || '::' || (end_s * 1000)::BIGINT), 1, 12) AS stable_id FROM {fx_intervals}")
def interval_ids(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "fx_intervals").select("interval_id", S.interval_id(F.col("source_key"), F.col("start_s").cast("double"), F.col("end_s").cast("double")).alias("stable_id"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
    SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""")
def cosine_of_neighbours(spark: SparkSession, d: str) -> DataFrame:
    v = fixture(spark, d, "embeddings")
    both = v.select("vec_id", "embedding").join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next")), "vec_id")
    return rounded(both.select("vec_id", S.cosine(F.col("embedding"), F.col("next")).alias("similarity")))


@query("""SELECT k, round((greatest(least((k % 13) / 10.0::DOUBLE, 1.0), least((k % 7) / 5.0::DOUBLE - 0.2, 1.0), 0.0) - greatest(least((k % 13) / 10.0::DOUBLE, (k % 7) / 5.0::DOUBLE - 0.2, 1.0), 0.0))
    * (greatest(least((k % 11) / 9.0::DOUBLE, 1.0), least((k % 5) / 4.0::DOUBLE, 1.0)) - least((k % 11) / 9.0::DOUBLE, (k % 5) / 4.0::DOUBLE, 1.0)), 6) AS area, k % 10 >= 5 AND k % 4 >= 1 AS accepted FROM {fx_labels}""")
def hand_areas(spark: SparkSession, d: str) -> DataFrame:
    """Areas of boxes around two landmarks, and whether a detection counts."""
    k = F.col("k")
    points = F.array(F.struct((k % 13 / 10).alias("x"), (k % 11 / 9).alias("y")), F.struct((k % 7 / 5 - 0.2).alias("x"), (k % 5 / 4).alias("y")))
    return rounded(fixture(spark, d, "fx_labels").select("k", S.area_fraction(points).alias("area"), P.accepted(k % 10 / 10, k % 4 / 100).alias("accepted")))


@query("SELECT interval_id, short_caption || CASE WHEN k % 2 = 0 THEN chr(10) || 'more' ELSE '' END AS content FROM {fx_labels}")
def chat_answers(spark: SparkSession, d: str) -> DataFrame:
    """Contents of chat answers: a string, or parts of which the texts count."""
    parts = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("short_caption").alias("text")), F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")), F.struct(F.lit("text").alias("type"), F.lit("more").alias("text"))))
    raw = F.when(F.col("k") % 2 == 0, parts).otherwise(F.concat(F.lit('"'), "short_caption", F.lit('"')))
    return fixture(spark, d, "fx_labels").select("interval_id", S.chat_content(raw).alias("content"))


@query(f"{_EPISODES} SELECT source_key, episode_status FROM ep WHERE episode_status IN ('keep', 'review') AND rec % 4 <> 0")
def eligible_episodes(spark: SparkSession, d: str) -> DataFrame:
    e = _episodes(spark, d)
    return jobs.eligible(e, fixture(spark, d, "fx_recordings").filter("rec % 4 = 0")).select("source_key", "episode_status")


@query(f"""{_segments(30, 45, 15)},
    k AS (SELECT seg.source_key, start_frame, end_frame, count(*) OVER (PARTITION BY seg.source_key) AS k, row_number() OVER (PARTITION BY seg.source_key ORDER BY start_frame) - 1 AS i, r.total_frames AS n FROM seg JOIN {{fx_recordings}} r USING (source_key)),
    pl AS (SELECT source_key, replace(split_part(source_key, '/', 2), '.rec', '') || '_seg' || lpad(i::VARCHAR, 3, '0') || '.rec' AS filename, end_frame - start_frame AS frames FROM k WHERE NOT (k = 1 AND start_frame = 0 AND end_frame = n))
    SELECT split_part(source_key, '/', 2) AS filename, total_frames AS frames FROM {{fx_recordings}} WHERE source_key NOT IN (SELECT source_key FROM pl) UNION ALL SELECT filename, frames FROM pl""")
def manifest_splice(spark: SparkSession, d: str) -> DataFrame:
    rec = fixture(spark, d, "fx_recordings")
    seg = written(A.segments(A.scan(_frames(spark, d)), min_gap=30, min_duration=45, pad=15), "segments")
    return jobs.splice(_manifest(spark, d).select("filename", "frames"), seg, rec)[0]


@query(f"""{_VERDICT},
    ix AS (SELECT *, lag(file_offset) OVER w AS po FROM {{fx_index}} WINDOW w AS (PARTITION BY source_key ORDER BY entry)),
    ok AS (SELECT source_key, count(*) FILTER (WHERE file_offset <= po OR file_offset < 472) = 0 AS valid FROM ix GROUP BY source_key),
    qc AS (SELECT 'ep_' || substr(sha1(r.source_key), 1, 16) AS episode_id, r.source_key, CASE WHEN valid THEN 'valid' ELSE 'invalid' END AS validation_status,
                  CASE WHEN NOT valid THEN 'invalid' WHEN r.duration_us / 1e6 < 5 THEN 'reject' WHEN verdict IS NULL THEN 'invalid' WHEN verdict = 'KEEP' THEN 'keep' WHEN verdict = 'PRUNE_CONFIDENT' THEN 'reject' ELSE 'review' END AS episode_status, verdict
           FROM {{fx_recordings}} r JOIN ok USING (source_key) LEFT JOIN verdict USING (source_key))
    SELECT * FROM qc""")
def qc_job(spark: SparkSession, d: str) -> DataFrame:
    episodes = jobs.qc(_frames(spark, d), fixture(spark, d, "fx_index"), fixture(spark, d, "fx_recordings"), with_profiles=False)[0]
    return episodes.select("episode_id", "source_key", "validation_status", "episode_status", "verdict")


@query(f"""{_STATION_VERDICT},
    ix AS (SELECT *, lag(file_offset) OVER w AS po FROM {{fx_index}} WINDOW w AS (PARTITION BY source_key ORDER BY entry)),
    ok AS (SELECT source_key, count(*) FILTER (WHERE file_offset <= po OR file_offset < 472) = 0 AS valid FROM ix GROUP BY source_key),
    qc AS (SELECT 'ep_' || substr(sha1(r.source_key), 1, 16) AS episode_id, r.source_key, CASE WHEN valid THEN 'valid' ELSE 'invalid' END AS validation_status,
                  CASE WHEN NOT valid THEN 'invalid' WHEN r.duration_us / 1e6 < 5 THEN 'reject' WHEN verdict IS NULL THEN 'invalid' WHEN verdict = 'KEEP' THEN 'keep' WHEN verdict = 'PRUNE_CONFIDENT' THEN 'reject' ELSE 'review' END AS episode_status, verdict
           FROM {{fx_recordings}} r JOIN ok USING (source_key) LEFT JOIN verdict USING (source_key))
    SELECT * FROM qc""")
def qc_job_with_profiles(spark: SparkSession, d: str) -> DataFrame:
    """The job's default: every recording is judged against its station."""
    episodes = jobs.qc(_frames(spark, d), fixture(spark, d, "fx_index"), fixture(spark, d, "fx_recordings"))[0]
    return episodes.select("episode_id", "source_key", "validation_status", "episode_status", "verdict")


@query(f"{_STATION_VERDICT} SELECT source_key, verdict, round(activity_score, 6) AS activity_score, n_keep, n_prune, true AS used_profile FROM verdict")
def analyze_job_with_profiles(spark: SparkSession, d: str) -> DataFrame:
    frames, rec = _frames(spark, d), fixture(spark, d, "fx_recordings")
    v = jobs.analyze(frames, rec, written(jobs.calibrate(frames, rec)[0], "profiles"))
    counts = [F.size(f"reasons_{k}").cast("long").alias(f"n_{k}") for k in ("keep", "prune")]
    return rounded(v.select("source_key", "verdict", "activity_score", *counts, "used_profile"))


@query(f"""{_STATIONS}, t AS (SELECT profile_key, count(*) FILTER (WHERE NOT kf) AS frame_count, count(DISTINCT source_key) AS recording_count FROM pf GROUP BY profile_key)
    SELECT profile_key, round(rgb_median, 6) AS rgb_median, round(rgb_mad, 6) AS rgb_mad, round(depth_median, 6) AS depth_median, round(depth_mad, 6) AS depth_mad, frame_count, recording_count
    FROM t JOIN br USING (profile_key) JOIN bd USING (profile_key)""")
def calibrate_job(spark: SparkSession, d: str) -> DataFrame:
    return rounded(jobs.calibrate(_frames(spark, d), fixture(spark, d, "fx_recordings"))[0])


@query("""WITH i AS (SELECT *, lag(file_offset) OVER w AS po, lag(timestamp_us) OVER w AS pt FROM {fx_index} WINDOW w AS (PARTITION BY source_key ORDER BY entry)),
    g AS (SELECT source_key, count(*) AS n, count(*) FILTER (WHERE file_offset <= po) + count(*) FILTER (WHERE file_offset < 472) AS n_errors, count(*) FILTER (WHERE timestamp_us < pt) AS w FROM i GROUP BY source_key)
    SELECT source_key, n_errors = 0 AS valid, n_errors, w + (n <> total_frames)::BIGINT AS n_warnings FROM g JOIN {fx_recordings} USING (source_key)""")
def validate_job(spark: SparkSession, d: str) -> DataFrame:
    checked, _ = jobs.validate(fixture(spark, d, "fx_index"), fixture(spark, d, "fx_recordings"))
    return checked.select("source_key", "valid", "n_errors", "n_warnings")


@query(f"""{_EPISODES}, {_TIMES},
    us AS (SELECT interval_id, ei.source_key, effective_start_s, effective_end_s FROM ei LEFT JOIN ee USING (source_key)
           WHERE effective_interval_decision <> 'reject' AND coalesce(effective_episode_status, 'keep') IN ('keep', 'review') AND effective_end_s > effective_start_s),
    rg AS (SELECT interval_id, min(idx) FILTER (WHERE t >= effective_start_s) AS s, coalesce(min(idx) FILTER (WHERE t > effective_end_s), max(idx) + 1) AS e FROM us JOIN t USING (source_key) GROUP BY interval_id)
    SELECT interval_id, source_key, effective_start_s, effective_end_s, 'segments/' || interval_id AS segment_path FROM us JOIN rg USING (interval_id) WHERE s < e""")  # fmt: skip
def segments_job(spark: SparkSession, d: str) -> DataFrame:
    rec = fixture(spark, d, "fx_recordings")
    effective = {"effective_intervals": _effective_intervals(spark, d), "effective_episodes": _effective_episodes(spark, d)}
    manifest = jobs.segments(_frames(spark, d), fixture(spark, d, "fx_index"), rec, effective)[0]
    return manifest.select("interval_id", "source_key", "effective_start_s", "effective_end_s", "segment_path")


@query(f"""{_segments(30, 45, 15)}
    SELECT seg.source_key, start_frame, end_frame, active_frames, round(active_frames / seg.total_frames, 6) AS active_fraction, round(coalesce(greatest(a.timestamp_us - r.start_timestamp_us, 0) / 1e6, r.duration_us / 1e6), 6) AS start_s,
           round(coalesce(CASE WHEN z.timestamp_us IS NOT NULL THEN greatest(z.timestamp_us - r.start_timestamp_us, 0) / 1e6 END, r.duration_us / 1e6), 6) AS end_s
    FROM seg JOIN {{fx_recordings}} r USING (source_key) LEFT JOIN f a ON a.source_key = seg.source_key AND a.idx = start_frame LEFT JOIN f z ON z.source_key = seg.source_key AND z.idx = end_frame""")
def proposals_job(spark: SparkSession, d: str) -> DataFrame:
    found = jobs.proposals(_frames(spark, d), fixture(spark, d, "fx_recordings"))
    return rounded(found.select("source_key", "start_frame", "end_frame", "active_frames", "active_fraction", "start_s", "end_s"))


@query("SELECT key, size_bytes FROM {fx_objects} WHERE size_bytes >= 1024 AND starts_with(key, '2-high') ORDER BY key LIMIT 25")
def stage_first(spark: SparkSession, d: str) -> DataFrame:
    """A run of 25 files at most: the limit holds after the filters, in order of the keys."""
    rows = fixture(spark, d, "fx_objects").withColumn("validation_status", F.when(F.col("size_bytes") >= 1024, "valid").otherwise("invalid"))
    return jobs.stage(rows, "2-high", limit=25).select("key", "size_bytes")


@query(f"WITH {_PENDING} SELECT key, size_bytes, mtime FROM pe ORDER BY mtime, key LIMIT 50")
def upload_next(spark: SparkSession, d: str) -> DataFrame:
    """The 50 files that an uploader takes next, the oldest ones."""
    pending = jobs.upload_status(fixture(spark, d, "fx_objects"), fixture(spark, d, "fx_uploads"), F.expr(NOW))["pending"]
    return pending.select("key", "size_bytes", "mtime").limit(50)


@query(f"WITH {_PENDING} SELECT key, size_bytes, mtime FROM pe")
def upload_queue(spark: SparkSession, d: str) -> DataFrame:
    return jobs.upload_status(fixture(spark, d, "fx_objects"), fixture(spark, d, "fx_uploads"), F.expr(NOW))["pending"].select("key", "size_bytes", "mtime")


@query(f"""WITH {_MANIFEST}, t AS (SELECT dataset, sum(duration_s) AS s, sum(frames)::BIGINT AS frames, count(*) AS episodes FROM mf GROUP BY dataset)
    SELECT dataset, round(s, 6) AS duration_s, frames, episodes, CASE WHEN s < 60 THEN round_even(s, 0)::BIGINT || 's' WHEN s::BIGINT < 0 THEN '' WHEN floor(s) < 3600 THEN printf('%dm %02ds', floor(s)::BIGINT // 60, floor(s)::BIGINT % 60)
           ELSE printf('%dh %02dm %02ds', floor(s)::BIGINT // 3600, floor(s)::BIGINT % 3600 // 60, floor(s)::BIGINT % 60) END AS duration FROM t""")
def dataset_info(spark: SparkSession, d: str) -> DataFrame:
    return rounded(jobs.dataset_info(_manifest(spark, d)))


ORACLE_SQL = {k: duck(v) for k, v in _ORACLE.items()}
