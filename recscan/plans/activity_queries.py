"""Queries of the activity operators, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recscan.operators import activity as A
from recscan.operators import spans as P
from recscan.plans.fixtures import duck, fixture

R = 6  # digits to which computed numbers are compared


def rounded(df: DataFrame, digits: int = R) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _frames(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "fx_frames").select("source_key", "idx", "timestamp_us", "rgb_size", "depth_size", "rec")


def idle_baseline(spark: SparkSession, d: str) -> DataFrame:
    f = _frames(spark, d)
    rgb = A.idle_baseline(f, "rgb_size").select("source_key", *[F.col(c).alias(f"rgb_{c}") for c in ("median", "mad", "threshold")])
    depth = A.idle_baseline(f, "depth_size", mad_scale=A.CONFIG.mad_scale).select("source_key", *[F.col(c).alias(f"depth_{c}") for c in ("median", "mad", "threshold")])
    return rounded(rgb.join(depth, "source_key"))


def station_profile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.station_profile(_frames(spark, d).withColumn("profile_key", F.split("source_key", "/")[0])))


def activity_masks(spark: SparkSession, d: str) -> DataFrame:
    return A.activity_masks(_frames(spark, d)).select("source_key", "idx", "rgb_active", "depth_active")


def window_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.window_stats(A.scan(_frames(spark, d))))


def fused_mask(spark: SparkSession, d: str) -> DataFrame:
    return A.fused_mask(A.scan(_frames(spark, d))).select("source_key", "idx", "active")


def bursts(spark: SparkSession, d: str) -> DataFrame:
    return A.count_bursts(A.fused_mask(A.scan(_frames(spark, d))), "active")


def episode_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.episode_features(A.scan(_frames(spark, d))).drop("sustained", *A.EXTRAS))


def calibration_rows(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.calibration_extras(A.episode_features(A.scan(_frames(spark, d)))))


def analyze_verdict(spark: SparkSession, d: str) -> DataFrame:
    rec = fixture(spark, d, "fx_recordings")
    v = A.analyze(A.episode_features(A.scan(_frames(spark, d))), rec)
    return rounded(v.select("source_key", "verdict", "activity_score", F.size("reasons_keep").cast("long").alias("n_keep"), F.size("reasons_prune").cast("long").alias("n_prune")))


def verdict_counts(spark: SparkSession, d: str) -> DataFrame:
    return analyze_verdict(spark, d).groupBy("verdict").agg(F.count(F.lit(1)).alias("recordings"))


def contamination_warning(spark: SparkSession, d: str) -> DataFrame:
    """Recordings whose own baseline is in doubt: over 75 % of frames are active."""
    return A.baseline_in_doubt(A.episode_features(A.scan(_frames(spark, d)))).select("source_key", "baseline_in_doubt")


def segments_cli(spark: SparkSession, d: str) -> DataFrame:
    return A.segments(A.scan(_frames(spark, d)))


def segments_curation(spark: SparkSession, d: str) -> DataFrame:
    return A.segments(A.scan(_frames(spark, d)), min_gap=30, min_duration=45, pad=15)


def interval_seconds(spark: SparkSession, d: str) -> DataFrame:
    """Proposals in seconds: the start frame's time, and the end frame's or else the whole duration."""
    found = P.frame_seconds(A.segments(A.scan(_frames(spark, d)), min_gap=30, min_duration=45, pad=15), _frames(spark, d), fixture(spark, d, "fx_recordings"))
    return rounded(found.select("source_key", "start_frame", "end_frame", "start_s", "end_s"))


def stream_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.stream_stats(_frames(spark, d)))


def index_validation(spark: SparkSession, d: str) -> DataFrame:
    v = A.validate_index(fixture(spark, d, "fx_index"), fixture(spark, d, "fx_recordings"))
    return v.withColumns({"errors": F.array_join("errors", "|"), "warnings": F.array_join("warnings", "|")})


QUERIES = {
    f.__name__: f
    for f in (
        analyze_verdict, idle_baseline, station_profile, activity_masks, window_stats, fused_mask, bursts, episode_features, calibration_rows,
        verdict_counts, contamination_warning, segments_cli, segments_curation, interval_seconds, index_validation, stream_stats,
    )
}

# ---- SQL ----------------------------------------------------------------------------------

_P = "SELECT *, idx % 30 = 0 AS kf, count(*) OVER (PARTITION BY source_key) AS n FROM {fx_frames}"


def _low(col: str, by: str = "source_key", of: str = "f") -> str:
    return f"""SELECT {by}, s, median(s) OVER (PARTITION BY {by}) AS med FROM (
        SELECT {by}, {col} AS s, row_number() OVER (PARTITION BY {by} ORDER BY {col}) AS rn, count(*) OVER (PARTITION BY {by}) AS c FROM {of} WHERE NOT kf)
        WHERE rn <= greatest(1, ceil(c * 0.25))"""


_BASE = f"""WITH f AS ({_P}),
    br AS (SELECT source_key, max(med) AS rgb_median, median(abs(s - med)) AS rgb_mad FROM ({_low("rgb_size")}) GROUP BY source_key),
    bd AS (SELECT source_key, max(med) AS depth_median, median(abs(s - med)) AS depth_mad FROM ({_low("depth_size")}) GROUP BY source_key),
    hd AS (SELECT source_key, coalesce(avg(depth_size) FILTER (WHERE NOT kf) > 1.0, false) AS has_depth FROM f GROUP BY source_key),
    b AS (SELECT hd.source_key, has_depth, coalesce(rgb_median, 0) AS rgb_median, coalesce(rgb_mad, 0) AS rgb_mad, coalesce(depth_median, 0) AS depth_median, coalesce(depth_mad, 0) AS depth_mad
          FROM hd LEFT JOIN br USING (source_key) LEFT JOIN bd USING (source_key))"""
_MASKS = f"""{_BASE},
    g AS (SELECT f.*, b.* EXCLUDE (source_key), rgb_median + 3.0 * rgb_mad AS rt, depth_median + 3.0 * (depth_mad * 1.4826) AS onset, depth_median + 2.0 * (depth_mad * 1.4826) AS off FROM f JOIN b USING (source_key)),
    m AS MATERIALIZED (SELECT *, NOT kf AND rgb_size > rt AS rgb_active,
                 has_depth AND coalesce(last_value(CASE WHEN kf THEN NULL WHEN depth_size > onset THEN 1 WHEN depth_size < off THEN 0 END IGNORE NULLS)
                     OVER (PARTITION BY source_key ORDER BY idx ROWS UNBOUNDED PRECEDING), 0) = 1 AS depth_active FROM g)"""
_WINDOWS = f"""{_MASKS},
    e AS (SELECT m.*, unnest(range(greatest(0, CAST(floor((idx - 60) / 15.0) AS BIGINT) + 1), idx // 15 + 1)) AS window_idx FROM m),
    w1 AS (SELECT source_key, window_idx, max(n) AS n, bool_or(has_depth) AS has_depth, max(rgb_median) AS rgb_median,
                  count(*) FILTER (WHERE NOT kf) AS p, count(*) FILTER (WHERE NOT kf AND rgb_active) AS rp, count(*) FILTER (WHERE NOT kf AND depth_active) AS dp,
                  max(rgb_size) FILTER (WHERE NOT kf) AS mx, avg(rgb_size) FILTER (WHERE NOT kf) AS ax, list_sort(list(rgb_size) FILTER (WHERE NOT kf)) AS sizes,
                  stddev_pop(depth_size) FILTER (WHERE NOT kf) AS sd, avg(depth_size) FILTER (WHERE NOT kf) AS ad,
                  CASE WHEN min(rgb_size) FILTER (WHERE NOT kf) < max(rgb_size) FILTER (WHERE NOT kf) AND min(depth_size) FILTER (WHERE NOT kf) < max(depth_size) FILTER (WHERE NOT kf)
                       THEN corr(rgb_size, depth_size) FILTER (WHERE NOT kf) ELSE 0 END AS r FROM e GROUP BY source_key, window_idx),
    w2 AS (SELECT *, CASE WHEN has_depth AND p >= 10 THEN r ELSE 0.0 END AS correlation FROM w1),
    w3 AS MATERIALIZED (SELECT *, has_depth AND correlation > 0.7 AS is_ego FROM w2),
    ef AS (SELECT e.source_key, e.window_idx, e.idx, e.kf, e.depth_active OR (e.rgb_active AND NOT w3.is_ego) AS fu FROM e JOIN w3 USING (source_key, window_idx)),
    er AS (SELECT *, idx - row_number() OVER (PARTITION BY source_key, window_idx, fu ORDER BY idx) AS run FROM ef),
    eb AS (SELECT source_key, window_idx, count(*) AS bursts FROM (SELECT source_key, window_idx, run FROM er WHERE fu GROUP BY source_key, window_idx, run HAVING count(*) >= 5) GROUP BY source_key, window_idx),
    ea AS (SELECT source_key, window_idx, count(*) FILTER (WHERE fu AND NOT kf) AS fp FROM ef GROUP BY source_key, window_idx),
    win AS (SELECT source_key, window_idx, window_idx * 15 AS start_frame, least(window_idx * 15 + 60, n) AS end_frame,
                   CASE WHEN p > 0 THEN fp / p ELSE 0.0 END AS active_fraction,
                   CASE WHEN p > 0 AND rgb_median > 0 THEN ax / rgb_median ELSE 0.0 END AS mean_excess, CASE WHEN p > 0 AND rgb_median > 0 THEN mx / rgb_median ELSE 0.0 END AS max_excess,
                   CASE WHEN len(sizes) >= 2 THEN sizes[least(CAST(floor(CAST(len(sizes) AS FLOAT) * CAST(0.95 AS FLOAT)) AS BIGINT), len(sizes) - 1) + 1] / sizes[len(sizes) // 2 + 1] ELSE 1.0 END AS p95_p50,
                   coalesce(bursts, 0) AS burst_count, CASE WHEN has_depth AND p > 0 AND ad > 0 THEN sd / ad ELSE 0.0 END AS depth_cv,
                   CASE WHEN p > 0 THEN dp / p ELSE 0.0 END AS depth_fraction, CASE WHEN p > 0 THEN rp / p ELSE 0.0 END AS rgb_fraction, correlation, is_ego
            FROM w3 JOIN ea USING (source_key, window_idx) LEFT JOIN eb USING (source_key, window_idx))"""
_FUSED = f"""{_WINDOWS},
    fu AS (SELECT m.*, m.depth_active OR (m.rgb_active AND NOT coalesce(win.is_ego, false)) AS active
           FROM m LEFT JOIN w3 win ON win.source_key = m.source_key AND win.window_idx = least(greatest(m.idx - 30, 0) // 15, (m.n - 1) // 15)),
    ru AS (SELECT *, idx - row_number() OVER (PARTITION BY source_key, active ORDER BY idx) AS run FROM fu),
    runs AS (SELECT source_key, min(idx) AS s, max(idx) + 1 AS e FROM ru WHERE active GROUP BY source_key, run)"""
_FEATURES = f"""{_FUSED},
    f1 AS (SELECT source_key, max(n) AS total_frames, count(*) FILTER (WHERE NOT kf) AS p, count(*) FILTER (WHERE NOT kf AND active) AS ap, count(*) FILTER (WHERE NOT kf AND depth_active) AS dp,
                  count(*) FILTER (WHERE NOT kf AND idx >= floor(n * 2 / 3)) AS tp, count(*) FILTER (WHERE NOT kf AND active AND idx >= floor(n * 2 / 3)) AS ta,
                  avg(depth_size) FILTER (WHERE NOT kf) AS ad, stddev_samp(depth_size) FILTER (WHERE NOT kf) AS sd, list_sort(list(rgb_size) FILTER (WHERE NOT kf)) AS sizes FROM fu GROUP BY source_key),
    f2 AS (SELECT source_key, count(*) FILTER (WHERE e - s >= 5) AS b FROM runs GROUP BY source_key),
    f3 AS (SELECT source_key, count(*) AS nw, min(window_idx) FILTER (WHERE active_fraction > 0.2) AS fw, max(window_idx) FILTER (WHERE active_fraction > 0.2) AS lw,
                  count(*) FILTER (WHERE active_fraction > 0) / count(*) AS awf, avg(depth_cv) AS cm, greatest(max(depth_cv), 0.0) AS cx, count(*) FILTER (WHERE is_ego) / count(*) AS ego,
                  count(*) FILTER (WHERE active_fraction > 0.5) > 0 AS sustained FROM win GROUP BY source_key),
    feat AS (SELECT f1.source_key, total_frames, CASE WHEN p > 0 THEN ap / p ELSE 0.0 END AS active_fraction, coalesce(b, 0) AS burst_count,
                    CASE WHEN p >= 2 THEN sizes[CAST(floor(CAST(p AS FLOAT) * CAST(0.95 AS FLOAT)) AS BIGINT) + 1] / sizes[p // 2 + 1] ELSE 1.0 END AS p95_p50,
                    fw AS first_active_window, lw AS last_active_window, coalesce(fw, nw) AS idle_prefix, coalesce(nw - 1 - lw, nw) AS idle_suffix,
                    CASE WHEN tp > 0 THEN ta / tp ELSE 0.0 END AS final_third, awf AS active_window_fraction, coalesce(CASE WHEN ad > 0 THEN sd / ad END, 0.0) AS depth_cv,
                    CASE WHEN p > 0 THEN dp / p ELSE 0.0 END AS depth_active_fraction, cm AS window_depth_cv_mean, cx AS window_depth_cv_max, ego AS ego_window_fraction, sustained
             FROM f1 LEFT JOIN f2 USING (source_key) JOIN f3 USING (source_key))"""
_VERDICT = f"""{_FEATURES},
    v AS (SELECT feat.*, feat.total_frames < 30 AND r.duration_us / 1e6 < 1.0 AS acc, depth_cv > 0.18 OR window_depth_cv_max > 0.25 AS moving, depth_cv < 0.13 AND window_depth_cv_max < 0.20 AS static
          FROM feat JOIN {{fx_recordings}} r USING (source_key)),
    v2 AS (SELECT *, (depth_cv > 0.18)::BIGINT + (window_depth_cv_max > 0.25)::BIGINT + (sustained AND moving)::BIGINT + (burst_count >= 2 AND moving)::BIGINT + (final_third > 0.15 AND moving)::BIGINT AS nk,
                  static::BIGINT + (active_fraction < 0.02)::BIGINT + (burst_count = 0)::BIGINT + (final_third <= 0)::BIGINT + (active_window_fraction < 0.05)::BIGINT + (ego_window_fraction > 0.8)::BIGINT AS np FROM v),
    verdict AS (SELECT source_key, CASE WHEN acc THEN 'PRUNE_CONFIDENT' WHEN nk > 0 THEN 'KEEP' WHEN static OR (active_fraction < 0.02 AND burst_count = 0 AND final_third <= 0) THEN 'PRUNE_SUGGESTED' ELSE 'REVIEW' END AS verdict,
                  CASE WHEN acc THEN 0.0 ELSE least(1.0, greatest(0.0, 0.35 * least(1.0, greatest(0.0, depth_cv / 0.2)) + 0.2 * least(active_fraction * 5, 1.0) + 0.15 * least(burst_count / 5, 1.0)
                      + 0.1 * least(1.0, greatest(0.0, (p95_p50 - 1) / 3)) + 0.2 * least(final_third * 3, 1.0))) END AS activity_score,
                  CASE WHEN acc THEN 0 ELSE nk END AS n_keep, CASE WHEN acc THEN 1 ELSE np END AS n_prune FROM v2)"""


#: The same with the baselines of each recording's station: its camera's, or its source's where no camera is known.
_STATIONS = f"""WITH f AS ({_P}),
    sk AS (SELECT source_key, coalesce(nullif(camera_serial, ''), 'source-' || split_part(source_key, '/', 1)) AS profile_key FROM {{fx_recordings}}),
    pf AS (SELECT f.*, profile_key FROM f JOIN sk USING (source_key)),
    br AS (SELECT profile_key, max(med) AS rgb_median, median(abs(s - med)) AS rgb_mad FROM ({_low("rgb_size", "profile_key", "pf")}) GROUP BY profile_key),
    bd AS (SELECT profile_key, max(med) AS depth_median, median(abs(s - med)) AS depth_mad FROM ({_low("depth_size", "profile_key", "pf")}) GROUP BY profile_key),
    hd AS (SELECT source_key, coalesce(avg(depth_size) FILTER (WHERE NOT kf) > 1.0, false) AS has_depth FROM f GROUP BY source_key),
    b AS (SELECT hd.source_key, has_depth, rgb_median, rgb_mad, depth_median, depth_mad FROM hd JOIN sk USING (source_key) JOIN br USING (profile_key) JOIN bd USING (profile_key))"""
_STATION_VERDICT = _VERDICT.replace(_BASE, _STATIONS)


def _segments(gap: int, least: int, pad: int) -> str:
    return f"""{_FUSED},
    s1 AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY source_key ORDER BY s) < {gap} THEN 0 ELSE 1 END AS new FROM runs),
    s2 AS (SELECT *, sum(new) OVER (PARTITION BY source_key ORDER BY s) AS g FROM s1),
    s3 AS (SELECT source_key, min(s) AS s, max(e) AS e FROM s2 GROUP BY source_key, g HAVING max(e) - min(s) >= {least}),
    s4 AS (SELECT source_key, greatest(s - {pad}, 0) // 30 * 30 AS s, least((least(e + {pad}, n) + 29) // 30 * 30, n) AS e FROM s3 JOIN (SELECT source_key, max(n) AS n FROM fu GROUP BY source_key) USING (source_key)),
    s5 AS (SELECT *, CASE WHEN s <= lag(e) OVER (PARTITION BY source_key ORDER BY s) THEN 0 ELSE 1 END AS new FROM s4),
    s6 AS (SELECT *, sum(new) OVER (PARTITION BY source_key ORDER BY s) AS g FROM s5),
    s7 AS (SELECT source_key, min(s) AS start_frame, max(e) AS end_frame FROM s6 GROUP BY source_key, g),
    seg AS (SELECT source_key, start_frame, end_frame, (SELECT count(*) FROM fu WHERE fu.source_key = s7.source_key AND active AND idx >= start_frame AND idx < end_frame) AS active_frames,
                   end_frame - start_frame AS total_frames FROM s7)"""


def _round(cols: str) -> str:
    return ", ".join(f"round({c[1:]}, {R}) AS {c[1:]}" if c[0] == "~" else c for c in cols.split())


_ORACLE = {
    "idle_baseline": f"""{_BASE} SELECT source_key, round(b.rgb_median, 6) AS rgb_median, round(b.rgb_mad, 6) AS rgb_mad, round(b.rgb_median + 3.0 * b.rgb_mad, 6) AS rgb_threshold,
        round(b.depth_median, 6) AS depth_median, round(b.depth_mad, 6) AS depth_mad, round(b.depth_median + 3.0 * b.depth_mad * 1.4826, 6) AS depth_threshold
        FROM b SEMI JOIN br USING (source_key)""",
    "station_profile": f"""WITH f AS (SELECT *, split_part(source_key, '/', 1) AS profile_key FROM ({_P})),
        t AS (SELECT profile_key, count(*) FILTER (WHERE NOT kf) AS frame_count, count(DISTINCT source_key) AS recording_count FROM f GROUP BY profile_key),
        r AS (SELECT profile_key, max(med) AS rgb_median, median(abs(s - med)) AS rgb_mad FROM ({_low("rgb_size", "profile_key")}) GROUP BY profile_key),
        d AS (SELECT profile_key, max(med) AS depth_median, median(abs(s - med)) AS depth_mad FROM ({_low("depth_size", "profile_key")}) GROUP BY profile_key)
        SELECT * FROM t JOIN r USING (profile_key) JOIN d USING (profile_key)""",
    "activity_masks": f"{_MASKS} SELECT source_key, idx, rgb_active, depth_active FROM m",
    "window_stats": f"{_WINDOWS} SELECT {_round('source_key window_idx start_frame end_frame ~active_fraction ~mean_excess ~max_excess ~p95_p50 burst_count ~depth_cv ~depth_fraction ~rgb_fraction ~correlation is_ego')} FROM win",
    "fused_mask": f"{_FUSED} SELECT source_key, idx, active FROM fu",
    "bursts": f"{_FUSED} SELECT source_key, coalesce(b, 0) AS burst_count FROM (SELECT DISTINCT source_key FROM fu) LEFT JOIN (SELECT source_key, count(*) AS b FROM runs WHERE e - s >= 5 GROUP BY source_key) USING (source_key)",
    "episode_features": f"{_FEATURES} SELECT {_round('source_key total_frames ~active_fraction burst_count ~p95_p50 first_active_window last_active_window idle_prefix idle_suffix ~final_third ~active_window_fraction ~depth_cv ~depth_active_fraction ~window_depth_cv_mean ~window_depth_cv_max ~ego_window_fraction')} FROM feat",
    "calibration_rows": f"""{_FUSED},
        h AS (SELECT source_key, idx >= n // 2 AS second, count(*) FILTER (WHERE NOT kf) AS p, count(*) FILTER (WHERE NOT kf AND active) AS a FROM fu GROUP BY ALL),
        k AS (SELECT source_key, coalesce(max(a / nullif(p, 0)) FILTER (WHERE NOT second), 0.0) AS first_half, coalesce(max(a / nullif(p, 0)) FILTER (WHERE second), 0.0) AS second_half FROM h GROUP BY source_key),
        c AS (SELECT source_key, CASE WHEN min(rgb_size) < max(rgb_size) AND min(depth_size) < max(depth_size) THEN corr(rgb_size, depth_size) ELSE 0.0 END AS correlation FROM fu WHERE NOT kf GROUP BY source_key),
        s AS (SELECT source_key, coalesce(stddev_samp(active_fraction), 0.0) AS window_activity_std FROM win GROUP BY source_key)
        SELECT source_key, round(window_activity_std, 6) AS window_activity_std, round(first_half, 6) AS first_half, round(second_half, 6) AS second_half, round(second_half - first_half, 6) AS half_difference, round(correlation, 6) AS correlation
        FROM k JOIN c USING (source_key) JOIN s USING (source_key)""",
    "analyze_verdict": f"{_VERDICT} SELECT source_key, verdict, round(activity_score, 6) AS activity_score, n_keep, n_prune FROM verdict",
    "verdict_counts": f"{_VERDICT} SELECT verdict, count(*) AS recordings FROM verdict GROUP BY verdict",
    "contamination_warning": f"{_FEATURES} SELECT source_key, active_fraction > 0.75 AS baseline_in_doubt FROM feat",
    "segments_cli": f"{_segments(300, 60, 30)} SELECT * FROM seg",
    "segments_curation": f"{_segments(30, 45, 15)} SELECT * FROM seg",
    "interval_seconds": f"""{_segments(30, 45, 15)}
        SELECT seg.source_key, start_frame, end_frame, round(coalesce(greatest(a.timestamp_us - r.start_timestamp_us, 0) / 1e6, r.duration_us / 1e6), 6) AS start_s,
               round(coalesce(CASE WHEN z.timestamp_us IS NOT NULL THEN greatest(z.timestamp_us - r.start_timestamp_us, 0) / 1e6 END, r.duration_us / 1e6), 6) AS end_s
        FROM seg JOIN {{fx_recordings}} r USING (source_key) LEFT JOIN f a ON a.source_key = seg.source_key AND a.idx = start_frame LEFT JOIN f z ON z.source_key = seg.source_key AND z.idx = end_frame""",
    "stream_stats": f"""WITH f AS ({_P}) SELECT source_key, """ + ", ".join(
        f"count({c}_size) FILTER (WHERE NOT kf) AS {c}_count, round(coalesce(avg({c}_size) FILTER (WHERE NOT kf), 0.0), 6) AS {c}_mean, round(coalesce(stddev_samp({c}_size) FILTER (WHERE NOT kf), 0.0), 6) AS {c}_std, "
        f"coalesce(min({c}_size) FILTER (WHERE NOT kf), 0)::DOUBLE AS {c}_min, coalesce(max({c}_size) FILTER (WHERE NOT kf), 0)::DOUBLE AS {c}_max" for c in ("rgb", "depth")) + " FROM f GROUP BY source_key",
    "index_validation": """
        WITH i AS (SELECT *, lag(file_offset) OVER w AS po, lag(timestamp_us) OVER w AS pt FROM {fx_index} WINDOW w AS (PARTITION BY source_key ORDER BY entry)),
        g AS (SELECT source_key, count(*) AS n,
                     count(*) FILTER (WHERE file_offset <= po) + count(*) FILTER (WHERE file_offset < 472) AS n_errors, count(*) FILTER (WHERE timestamp_us < pt) AS w,
                     coalesce(string_agg('index entry ' || entry || ': non-increasing offset', '|' ORDER BY entry) FILTER (WHERE file_offset <= po), '') AS errors,
                     coalesce(string_agg('index entry ' || entry || ': non-monotonic timestamp', '|' ORDER BY entry) FILTER (WHERE timestamp_us < pt), '') AS warnings FROM i GROUP BY source_key)
        SELECT source_key, n_errors = 0 AS valid, n_errors, w + (n <> total_frames)::BIGINT AS n_warnings, errors, warnings FROM g JOIN {fx_recordings} USING (source_key)""",
}
ORACLE_SQL = {k: duck(v) for k, v in _ORACLE.items()}
