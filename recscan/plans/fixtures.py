"""Input tables of the curation queries, bound to the star-schema parquet.

Each is one SELECT in integer arithmetic that Spark and DuckDB run alike: ``//`` is integer
division, ``{name}`` a table or another fixture.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from recscan.scratch import dealt

SQL: dict[str, str] = {
    "fx_frames": """
        SELECT rec, source_key, idx, timestamp_us, rgb_size, depth_size, imu_sample_count, 36 + rgb_size + depth_size + 32 * imu_sample_count AS block_size,
               h1, h2, phase
        FROM (SELECT rec, 'station' || (rec % 4) || '/rec_' || rec || '.rec' AS source_key, idx, h1, h2, phase,
                     1700000000000000 + rec * 1000000000 + idx * 33333 + (idx // 200) * 600000 + (idx // 450) * 1500000 AS timestamp_us,
                     20000 + 1000 - (b1 * b1 // 1000) + CASE phase WHEN 1 THEN 9000 + 4 * h2 WHEN 2 THEN 6000 + 5 * h1 WHEN 4 THEN 4000 + h2 ELSE 0 END
                         + CASE WHEN idx % 30 = 0 THEN 60000 ELSE 0 END AS rgb_size,
                     CASE WHEN phase = 2 THEN 9400 + h1 // 20 ELSE 9000 + (1000 - (b2 * b2 // 1000)) // 2
                         + CASE WHEN phase = 1 THEN CASE WHEN rec % 5 = 2 THEN 2400 + 3 * h1 ELSE 3000 + 6 * h1 END ELSE 0 END END
                         + CASE WHEN idx % 30 = 0 THEN 15000 ELSE 0 END AS depth_size,
                     h1 % 8 AS imu_sample_count
              FROM (SELECT rec, idx, h1, h2, (h1 * h1 // 1000) * (h1 * h1 // 1000) // 1000 AS b1, (h2 * h2 // 1000) * (h2 * h2 // 1000) // 1000 AS b2,
                           CASE WHEN rec % 4 = 3 THEN 0 ELSE (idx // 90 + rec) % 6 END AS phase
                    FROM (SELECT l_suppkey AS rec,
                                 CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax) AS BIGINT) - 1 AS idx,
                                 (l_orderkey * 31 + l_partkey * 17 + l_linenumber * 7) % 1000 AS h1, (l_orderkey * 13 + l_partkey * 29 + l_linenumber * 3) % 1000 AS h2
                          FROM {lineitem}) x
                    WHERE NOT (rec % 10 = 9 AND idx >= 20)) y) z""",
    "fx_recordings": """
        SELECT f.source_key, CASE WHEN f.rec % 6 = 5 THEN '' ELSE 'SN' || s_nationkey END AS camera_serial, s_name AS session_name,
               f.total_frames, f.duration_us, f.start_timestamp_us, f.rec % 4 AS flags, f.rec % 3 AS rgb_codec, f.rec
        FROM (SELECT rec, source_key, count(*) AS total_frames, max(timestamp_us) - min(timestamp_us) AS duration_us, min(timestamp_us) AS start_timestamp_us
              FROM {fx_frames} GROUP BY rec, source_key) f JOIN {supplier} ON s_suppkey = f.rec""",
    "fx_index": """
        SELECT rec, source_key, idx AS entry,
               CASE WHEN rec % 13 = 5 AND idx = 7 THEN 472 + before - lag(block_size) OVER (PARTITION BY rec ORDER BY idx) ELSE 472 + before END AS file_offset,
               CASE WHEN rec % 17 = 3 AND idx = 9 THEN timestamp_us - 1000000 ELSE timestamp_us END AS timestamp_us, block_size
        FROM (SELECT rec, source_key, idx, timestamp_us, block_size,
                     CAST(sum(block_size) OVER (PARTITION BY rec ORDER BY idx ROWS UNBOUNDED PRECEDING) AS BIGINT) - block_size AS before
              FROM {fx_frames}) o""",
    # times in milliseconds, so that both engines add them exactly
    "fx_hand_samples": """
        SELECT source_key, idx // 6 * 200 AS t_ms, n, CASE WHEN n > 0 THEN (5 + h1 % 100) / 1000.0 ELSE 0.0 END AS a
        FROM (SELECT source_key, idx, h1, CASE WHEN phase IN (1, 4) AND h2 % 10 < 8 THEN 1 + h2 % 2 ELSE 0 END AS n FROM {fx_frames} WHERE idx % 6 = 0) s""",
    "fx_labels": """
        SELECT 'int_' || p_partkey AS interval_id, 'station' || (rec % 4) || '/rec_' || rec || '.rec' AS source_key,
               p_type || '  ' || p_name || '!!' AS proposed_task_name, p_name AS short_caption, (p_partkey * 37 % 101) / 100.0 AS confidence,
               p_size % 5 <> 0 AS is_manipulation, p_partkey AS k
        FROM (SELECT *, 1 + p_partkey % (SELECT count(*) FROM {supplier}) AS rec FROM {part}) p""",
    "fx_intervals": """
        SELECT 'int_' || p_partkey AS interval_id, 'station' || (rec % 4) || '/rec_' || rec || '.rec' AS source_key,
               p_partkey * 13 % 60 + 0.5 AS start_s, p_partkey * 13 % 60 + 0.5 + p_size AS end_s, p_partkey AS k
        FROM (SELECT *, 1 + p_partkey % (SELECT count(*) FROM {supplier}) AS rec FROM {part}) p""",
    "fx_objects": """
        SELECT lower(replace(o_orderpriority, ' ', '-')) || '/' || CASE WHEN o_orderkey % 31 = 0 THEN '.pruned/' ELSE '' END || o_orderkey || '.rec' AS key,
               lower(replace(o_orderpriority, ' ', '-')) AS dataset, o_orderkey || '.rec' AS filename,
               CASE WHEN o_orderkey % 50 = 0 THEN 100 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS size_bytes, o_orderdate AS mtime, o_orderkey AS k
        FROM {orders}""",
    "fx_uploads": """
        SELECT o_orderkey || '.rec' AS filename, CAST(floor(o_totalprice) AS BIGINT) AS size_bytes, o_orderkey % 6 AS attempts, o_orderkey % 5 <> 0 AS success, o_orderdate AS last_attempt
        FROM {orders} WHERE o_orderstatus = 'F'""",
    "fx_telemetry": "SELECT user_id AS device, ts, CAST(floor(value * 1000) AS BIGINT) AS bytes, event_id FROM {events}",
}


def _names(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture, or a table of the data set, as a lazy DataFrame."""
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    inputs = {n: fixture(spark, sf_dir, n) for n in _names(SQL[name])}
    if name == "fx_frames":
        # its window orders the frames of each recording: tasks of one size, however many rows there are
        inputs["lineitem"] = dealt(inputs["lineitem"], "l_suppkey")
    return spark.sql(SQL[name].replace("//", " div "), **inputs)


def duck(sql: str) -> str:
    """A DuckDB query: each ``{fx_...}`` becomes a common table expression, tables stay names."""
    found: dict[str, str] = {}

    def add(text: str) -> str:
        for n in _names(text):
            if n in SQL and n not in found:
                body = add(SQL[n])
                found[n] = body
        return re.sub(r"\{(\w+)\}", r"\1", text)

    main = add(sql).strip()
    ctes = ", ".join(f"{n} AS ({body.strip()})" for n, body in found.items())
    if not ctes:
        return main
    begin = re.match(r"WITH\s+(RECURSIVE\s+)?", main, re.IGNORECASE)
    whole = f"{begin[0].rstrip()} {ctes}, {main[begin.end():]}" if begin else f"WITH {ctes} {main}"

    def once(m: re.Match) -> str:
        # what is read twice is computed once, whatever the engine would do on its own
        uses = len(re.findall(rf"(?:FROM|JOIN|,)\s+{m[1]}\b(?!\s*(?:AS\b|\.|\())", whole))
        return f"{m[1]} AS MATERIALIZED (" if uses > 1 else m[0]

    return re.sub(r"\b(\w+) AS \((?=\s*(?:SELECT|WITH)\b)", once, whole)
