"""Interval algebra: presence spans, merging, splitting, scoring, windows and frame ranges.

Spans are rows (source_key, start_s, end_s). Spans that overlap are joined by recording and slice of
time, so that neither a pair that does not overlap is made nor the length of a recording matters; its frames and samples stay rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recscan.functions import scalars as S

_KEY = "source_key"
#: Seconds of a slice of time in which spans meet. A span is copied to each slice it touches.
SLICE_S = 60.0


def present(n: Column, a: Column, least_area: float = 0.01) -> Column:
    return (n > 0) & (a >= least_area)


def accepted(score: Column, area: Column, least_score: float = 0.5, least_area: float = 0.01) -> Column:
    """Whether a detection counts as a hand."""
    return (score >= least_score) & (area >= least_area)


def overlapping(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], slice_s: float = SLICE_S) -> DataFrame:
    """Pairs of rows of one recording whose spans overlap by more than nothing, each once.

    Both sides go to each slice of time they touch and meet there; the slice in which the later one of a pair
    begins gives the pair. So work is linear in rows, slices and results, and a long recording is many keys.
    The columns of both sides must differ but for source_key; spans without length or with a null end overlap nothing.
    """

    def sliced(df: DataFrame, begin: str, end: str) -> DataFrame:
        span = df.filter(F.col(begin) < F.col(end))
        return span.withColumn("_slice", F.explode(F.sequence(F.floor(F.col(begin) / slice_s), F.floor(F.col(end) / slice_s))))

    (a, b), (c, d) = left_span, right_span
    both = sliced(left, a, b).join(sliced(right, c, d), [_KEY, "_slice"])
    begin = F.greatest(a, c)
    return both.filter((F.least(b, d) - begin > 0) & (F.col("_slice") == F.floor(begin / slice_s))).drop("_slice")


def merge_spans(spans: DataFrame, gap_s: float, by: str = _KEY, inclusive: bool = True, slice_s: float | None = None) -> DataFrame:
    """Spans joined over gaps of at most (inclusive) or below ``gap_s``.

    With ``slice_s`` those that begin in one slice of time are joined first, so that many short spans of
    one recording do not meet in one task; what is joined is the same.
    """
    if slice_s:
        slices = spans.select(by, "start_s", "end_s", F.floor(F.col("start_s") / slice_s).alias("_slice"))
        keyed = slices.withColumn("_by", F.struct(by, "_slice")).drop(by)
        spans = merge_spans(keyed, gap_s, "_by", inclusive).select(F.col("_by")[by].alias(by), "start_s", "end_s")
    w = Window.partitionBy(by).orderBy("start_s", "end_s")
    ended = F.max("end_s").over(w.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.round(F.col("start_s") - ended, 9)
    joins = (gap <= gap_s) if inclusive else (gap < gap_s)
    grouped = spans.withColumn("_g", F.sum(F.when(joins, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(by, "_g").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s")).drop("_g")


def _seen(samples: DataFrame, period_s: float) -> DataFrame:
    return samples.filter(present(F.col("n"), F.col("a"))).select(_KEY, F.col("t").alias("start_s"), (F.col("t") + period_s).alias("end_s"))


def presence_spans(samples: DataFrame, period_s: float, merge_gap_s: float) -> DataFrame:
    """Spans in which hands are seen, from samples (source_key, t, n, a)."""
    return merge_spans(_seen(samples, period_s), merge_gap_s, slice_s=10 * SLICE_S)


def split_points(spans: DataFrame, samples: DataFrame, period_s: float) -> DataFrame:
    """spans with split_s: the middle of the largest hand-free gap, the first of equal ones.

    The middle of the span is taken if there is no gap, or it lies within 0.25 s of an end.
    """
    spans = spans.select(_KEY, "start_s", "end_s")
    seen = _seen(samples, period_s).select(_KEY, F.col("start_s").alias("b"), F.col("end_s").alias("e"))
    blocks = overlapping(spans, seen, ("start_s", "end_s"), ("b", "e"))
    ends = spans.select("*", F.col("end_s").alias("b"), F.lit(None).cast("double").alias("e"))
    w = Window.partitionBy(_KEY, "start_s", "end_s").orderBy(F.col("e").isNull(), "b")
    cursor = F.greatest(F.col("start_s"), F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    gaps = blocks.select(_KEY, "start_s", "end_s", "b", "e").unionByName(ends).withColumn("cursor", cursor).withColumn("gap", F.round(F.col("b") - F.col("cursor"), 9))
    best = F.max_by(F.col("cursor") + F.col("gap") / 2, F.struct("gap", -F.col("cursor"))).alias("at")
    found = gaps.filter("gap > 0").groupBy(_KEY, "start_s", "end_s").agg(best)
    middle = F.col("start_s") + (F.col("end_s") - F.col("start_s")) / 2
    inside = (F.col("at") > F.col("start_s") + 0.25) & (F.col("at") < F.col("end_s") - 0.25)
    return spans.join(found, [_KEY, "start_s", "end_s"], "left").select(_KEY, "start_s", "end_s", F.when(inside, F.col("at")).otherwise(middle).alias("split_s"))


class Gaps:
    """The gaps between disjoint, sorted blocks, with the largest and first of any range of them in constant time."""

    def __init__(self, begins: np.ndarray, ends: np.ndarray) -> None:
        self.begins, self.ends = begins, ends
        # gap k lies before block k + 1; of equal gaps the first one counts
        gap = np.round(begins[1:] - ends[:-1], 9)
        self.gap, best = gap, np.arange(len(gap))
        self.table = [best]
        while 2 << len(self.table) - 1 <= len(gap):
            half, row = 1 << len(self.table) - 1, self.table[-1]
            a, b = row[:-half], row[half:]
            self.table.append(np.where(gap[b] > gap[a], b, a))

    def largest(self, low: int, high: int) -> int:
        """Of gaps low to high - 1."""
        k = (high - low).bit_length() - 1
        a, b = self.table[k][low], self.table[k][high - (1 << k)]
        return int(b if self.gap[b] > self.gap[a] else a)

    def cut(self, start: float, end: float) -> float:
        """Where a span is cut: see :func:`split_points`."""
        low, high = np.searchsorted(self.begins, (start, end), "left").tolist()
        found = []
        at = max(start, float(self.ends[low - 1])) if low else start
        if low < high:
            found.append((round(float(self.begins[low]) - at, 9), -at))
            if high - low > 1:
                k = self.largest(low, high - 1)
                found.append((float(self.gap[k]), -float(self.ends[k])))
            at = max(start, float(self.ends[high - 1]))
        found.append((round(end - at, 9), -at))
        gap, at = max(found)
        middle = -at + gap / 2
        return middle if gap > 0 and start + 0.25 < middle < end - 0.25 else start + (end - start) / 2


def _split(max_segment_s: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def split(rows: pd.DataFrame) -> pd.DataFrame:
        blocks = rows[~rows["is_span"]].sort_values("start_s")
        gaps, done = Gaps(blocks["start_s"].to_numpy(), blocks["end_s"].to_numpy()), []
        todo = rows.loc[rows["is_span"], ["start_s", "end_s"]].to_numpy().tolist()
        while todo:
            start, end = todo.pop()
            if end - start <= max_segment_s:
                done.append((start, end))
                continue
            at = gaps.cut(start, end)
            todo += ((start, at), (at, end))
        return pd.DataFrame(done, columns=["start_s", "end_s"]).assign(**{_KEY: rows[_KEY].iloc[0]})[[_KEY, "start_s", "end_s"]]

    return split


def split_long_spans(spans: DataFrame, samples: DataFrame, period_s: float, max_segment_s: float) -> DataFrame:
    """Spans cut at their split points until none is longer than ``max_segment_s``, which must be at least half a second.

    Samples that touch are one block, so what a recording's task holds is its spans and its gaps between hands.
    A cut leaves at least 0.25 s on each side. Spans with a null end are left out.
    """
    if max_segment_s < 0.5:
        raise ValueError("max_segment_s must be at least 0.5")
    one = lambda df, is_span: df.select(_KEY, F.col("start_s").cast("double").alias("start_s"), F.col("end_s").cast("double").alias("end_s"), F.lit(is_span).alias("is_span"))
    long = F.col("end_s") - F.col("start_s") > max_segment_s
    blocks = merge_spans(_seen(samples, period_s), 0.0, slice_s=10 * SLICE_S)
    cut = one(spans.filter(long), True).unionByName(one(blocks, False)).groupBy(_KEY).applyInPandas(_split(max_segment_s), f"{_KEY} string, start_s double, end_s double")
    return one(spans.filter(~long), True).drop("is_span").unionByName(cut)


def score_intervals(spans: DataFrame, samples: DataFrame, proposals: DataFrame, period_s: float) -> DataFrame:
    """spans with hand_presence_fraction, active_fraction, max_hands_seen, proposal_score."""
    cols = [_KEY, "start_s", "end_s"]
    near = overlapping(spans.select(*cols), samples.select(_KEY, "t", "n", "a", (F.col("t") + period_s).alias("_te")), ("start_s", "end_s"), ("t", "_te"))
    seen = present(F.col("n"), F.col("a"))
    hands = near.groupBy(*cols).agg((F.count(F.when(seen, 1)) / F.count(F.lit(1))).alias("hand"), F.max(F.when(seen, F.col("n"))).alias("most"))
    part = overlapping(spans.select(*cols), proposals.select(_KEY, F.col("start_s").alias("ps"), F.col("end_s").alias("pe"), "active_fraction"), ("start_s", "end_s"), ("ps", "pe"))
    share = S.overlap(F.col("start_s"), F.col("end_s"), F.col("ps"), F.col("pe"))
    part = part.withColumn("ov", share)
    active = part.groupBy(*cols).agg((F.sum(F.col("ov") * F.coalesce("active_fraction", F.lit(0.0))) / F.sum("ov")).alias("act"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return spans.join(hands, cols, "left").join(active, cols, "left").select(
        *cols, (F.col("end_s") - F.col("start_s")).alias("duration_s"), zero("hand").alias("hand_presence_fraction"), zero("act").alias("active_fraction"),
        F.coalesce("most", F.lit(0)).cast("long").alias("max_hands_seen"), (0.7 * zero("hand") + 0.3 * zero("act")).alias("proposal_score"),
    )


def hand_intervals(
    recordings: DataFrame, proposals: DataFrame, samples: DataFrame, sample_fps: float = 5.0, min_duration_s: float = 1.5,
    merge_gap_s: float = 1.0, pad_s: float = 0.5, max_segment_s: float = 20.0, remerge_touching: bool = True,
) -> DataFrame:
    """Where activity proposals and hands overlap: padded, merged, scored intervals.

    With ``remerge_touching`` the pieces of a split span meet again in the last merge, which is
    the default behaviour of the job; without it spans longer than ``max_segment_s`` stay cut.
    ``recordings`` gives duration_s.
    """
    period = 1.0 / max(sample_fps, 0.1)
    hands = presence_spans(samples, period, merge_gap_s).select(_KEY, F.col("start_s").alias("hs"), F.col("end_s").alias("he"))
    both = overlapping(proposals.select(_KEY, "start_s", "end_s"), hands, ("start_s", "end_s"), ("hs", "he")).join(recordings.select(_KEY, "duration_s"), _KEY)
    raw = both.select(
        _KEY,
        S.clamp(F.greatest("start_s", "hs") - pad_s, F.lit(0.0), F.col("duration_s")).alias("start_s"),
        S.clamp(F.least("end_s", "he") + pad_s, F.lit(0.0), F.col("duration_s")).alias("end_s"),
    )
    merged = merge_spans(raw, merge_gap_s)
    if not remerge_touching:
        merged = split_long_spans(merged, samples, period, max_segment_s)
    final = merged.filter(F.round(F.col("end_s") - F.col("start_s"), 9) >= min_duration_s)
    return score_intervals(final, samples, proposals, period).filter("hand_presence_fraction > 0")


def analysis_windows(start: Column, end: Column, max_s: float = 180.0, overlap_s: float = 15.0) -> Column:
    """array<struct<start_s, end_s>>: windows of ``max_s`` that overlap, the last one shorter."""
    step = max(max_s - overlap_s, 1.0)
    n = F.when(end - start <= max_s, 1).otherwise(1 + F.ceil((end - start - max_s) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((start + i * step).alias("start_s"), F.least(start + i * step + max_s, end).alias("end_s")))


def frame_ranges(frames: DataFrame, intervals: DataFrame) -> DataFrame:
    """intervals (source_key, id, start_s, end_s) with start_idx, end_idx and error.

    ``frames``: source_key, idx, t. The range starts at the first frame not before the start and
    ends before the first frame after the end. Ends of intervals are put among the frames in order
    of time, and each looks up the least frame behind it: no interval meets all frames.
    """
    places = frames.select(_KEY, "t", F.lit(1).alias("rank"), F.col("idx").cast("long").alias("idx"), F.lit(None).cast(intervals.schema["id"].dataType).alias("id"))
    edge = lambda c, rank: intervals.select(_KEY, F.col(c).alias("t"), F.lit(rank).alias("rank"), F.lit(None).cast("long").alias("idx"), "id")
    # frames at a time lie behind starts and before ends of that time
    w = Window.partitionBy(_KEY)
    later = F.min("idx").over(w.orderBy(F.desc("t"), F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0))
    found = places.unionByName(edge("start_s", 0)).unionByName(edge("end_s", 2)).withColumns({"later": later, "past": F.max("idx").over(w) + 1}).filter("idx is null")
    ends = found.groupBy("id").agg(
        F.max(F.when(F.col("rank") == 0, F.col("later"))).alias("start_idx"), F.max(F.when(F.col("rank") == 2, F.coalesce("later", "past"))).alias("end_idx")
    )
    joined = intervals.join(ends, "id", "left")
    bad = F.when((F.col("start_s") < 0) | F.isnan("start_s") | F.isnan("end_s"), "start must be finite and not negative").when(F.col("end_s") <= F.col("start_s"), "end must be after start")
    empty = F.when(F.col("start_idx").isNull() | (F.col("end_idx") <= F.col("start_idx")), "no frames in range")
    error = F.coalesce(bad, empty)
    return joined.select(_KEY, "id", "start_s", "end_s", F.when(error.isNull(), F.col("start_idx")).alias("start_idx"), F.when(error.isNull(), F.col("end_idx")).alias("end_idx"), error.alias("error"))


def frame_seconds(segments: DataFrame, frames: DataFrame, recordings: DataFrame) -> DataFrame:
    """segments with start_s and end_s: the time of the start frame and of the end frame, from the
    recording's start and never below 0; where there is no such frame, its whole duration.

    ``recordings``: source_key, start_timestamp_us, duration_us.
    """
    out = segments.join(recordings.select(_KEY, "start_timestamp_us", "duration_us"), _KEY)
    ends = out.select("*", F.posexplode(F.array("start_frame", "end_frame")).alias("_end", "idx")).join(frames.select(_KEY, "idx", "timestamp_us"), [_KEY, "idx"], "left")
    after = F.when(F.col("timestamp_us").isNotNull(), F.greatest(F.col("timestamp_us") - F.col("start_timestamp_us"), F.lit(0)) / 1e6)
    timed = ends.withColumn("_t", F.coalesce(after, F.col("duration_us") / 1e6))
    return timed.groupBy(*segments.columns).agg(F.max(F.when(F.col("_end") == 0, F.col("_t"))).alias("start_s"), F.max(F.when(F.col("_end") == 1, F.col("_t"))).alias("end_s"))


def clip_byte_plan(index: DataFrame, ranges: DataFrame, header_bytes: int = 472) -> DataFrame:
    """Where the frames of each clip lie and land: first_byte, last_byte, frames, index_offset.

    ``index``: source_key, entry, file_offset, block_size. Blocks lie one behind the other, so a
    clip's bytes follow from its first and its last entry: two lookups, however long it is.
    """
    ok = ranges.filter("error is null").select(_KEY, "id", "start_idx", "end_idx")
    wanted = ok.select(_KEY, "id", "start_idx", "end_idx", F.explode(F.array("start_idx", F.col("end_idx") - 1)).alias("entry"))
    rows = wanted.join(index.select(_KEY, "entry", "file_offset", "block_size"), [_KEY, "entry"])
    first, last = F.col("entry") == F.col("start_idx"), F.col("entry") == F.col("end_idx") - 1
    found = rows.groupBy(_KEY, "id").agg(
        F.max(F.when(first, F.col("file_offset"))).alias("first_byte"), F.max(F.when(last, F.col("file_offset") + F.col("block_size"))).alias("last_byte"),
        F.max(F.col("end_idx") - F.col("start_idx")).alias("frames"),
    )
    return found.withColumn("index_offset", F.lit(header_bytes) + F.col("last_byte") - F.col("first_byte"))
