"""Activity analytics on the frame table: baselines, masks, windows, features, verdicts.

A frame table has source_key, idx (0-based frame order), rgb_size, depth_size; every thirtieth
frame is a keyframe. All stages are partitioned by source_key, so one exchange feeds them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recscan.scratch import dealt


# The defaults of the activity scan.
@dataclass(frozen=True)
class ScanConfig:
    window: int = 60
    stride: int = 15
    idle_share: float = 0.25
    rgb_k: float = 3.0
    depth_onset_k: float = 3.0
    depth_offset_k: float = 2.0
    mad_scale: float = 1.4826
    ego_corr: float = 0.7
    burst_min: int = 5
    keyframe_every: int = 30
    active_window: float = 0.2


CONFIG = ScanConfig()


def keyframe(idx: Column | str = "idx", every: int = CONFIG.keyframe_every) -> Column:
    return F.pmod(F.col(idx) if isinstance(idx, str) else idx, F.lit(every)) == 0


def _ratio(a: Column, b: Column, other: float = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(other))


def safe_corr(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson's r from sums; 0 below two rows or without variance."""
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    return F.when((n >= 2) & (vx > 0) & (vy > 0), (n * sxy - sx * sy) / F.sqrt(vx.cast("double")) / F.sqrt(vy.cast("double"))).otherwise(0.0)


def _sums(x: str, y: str) -> list[Column]:
    """Sums for safe_corr over inter frames, as _n, _sx, _sy, _sxx, _syy, _sxy."""
    p = ~F.col("kf")
    cols = {"_n": F.lit(1), "_sx": F.col(x), "_sy": F.col(y), "_sxx": F.col(x) * F.col(x), "_syy": F.col(y) * F.col(y), "_sxy": F.col(x) * F.col(y)}
    return [F.coalesce(F.sum(F.when(p, c)), F.lit(0)).alias(a) for a, c in cols.items()]


# ---- baselines ----------------------------------------------------------------------------


def idle_baseline(frames: DataFrame, size_col: str, by: str = "source_key", k: float = CONFIG.rgb_k, mad_scale: float = 1.0, share: float = CONFIG.idle_share) -> DataFrame:
    """(by, median, mad, threshold) of the lowest ``share`` of inter-frame sizes of each group."""
    sizes = frames.filter(~keyframe()).select(by, F.col(size_col).cast("double").alias("size"))
    ordered, whole = Window.partitionBy(by).orderBy("size"), Window.partitionBy(by)
    low = sizes.select(by, "size", F.row_number().over(ordered).alias("rn"), F.count(F.lit(1)).over(whole).alias("n"))
    low = low.filter(F.col("rn") <= F.greatest(F.lit(1), F.ceil(F.col("n") * share)))
    median = low.withColumn("median", F.percentile("size", F.lit(0.5)).over(whole))
    out = median.groupBy(by).agg(F.first("median").alias("median"), F.percentile(F.abs(F.col("size") - F.col("median")), F.lit(0.5)).alias("mad"))
    return out.withColumn("threshold", F.col("median") + k * F.col("mad") * mad_scale)


def station_profile(frames: DataFrame, by: str = "profile_key", share: float = CONFIG.idle_share) -> DataFrame:
    """One row per station: baselines over the pooled inter frames of its recordings.

    Sizes are counted first; what is ordered is the distinct sizes of a station, not its frames.
    """
    p = frames.filter(~keyframe())

    def pooled(size_col: str, name: str) -> DataFrame:
        counted = p.groupBy(by, F.col(size_col).cast("double").alias("size")).agg(F.count(F.lit(1)).alias("cnt"))
        w = Window.partitionBy(by)
        cum = counted.select(by, "size", "cnt", F.sum("cnt").over(w.orderBy("size")).alias("upto"), F.sum("cnt").over(w).alias("n"))
        quota = F.greatest(F.lit(1), F.ceil(F.col("n") * share))
        low = cum.withColumn("take", F.least("cnt", quota - (F.col("upto") - F.col("cnt")))).filter("take > 0")
        med = low.groupBy(by).agg(F.percentile("size", F.lit(0.5), F.col("take")).alias(f"{name}_median"))
        return low.join(med, by).groupBy(by).agg(
            F.first(f"{name}_median").alias(f"{name}_median"),
            F.percentile(F.abs(F.col("size") - F.col(f"{name}_median")), F.lit(0.5), F.col("take")).alias(f"{name}_mad"),
        )

    totals = frames.groupBy(by).agg(F.count(F.when(~keyframe(), 1)).alias("frame_count"), F.countDistinct("source_key").alias("recording_count"))
    return totals.join(pooled("rgb_size", "rgb"), by).join(pooled("depth_size", "depth"), by)


# ---- masks --------------------------------------------------------------------------------


def _own_baseline(frames: DataFrame, name: str, share: float) -> DataFrame:
    """frames with {name}_median and {name}_mad of their recording's lowest inter-frame sizes.

    Windows of one partitioning instead of an aggregate and a join: frames are shuffled once.
    """
    w, size = Window.partitionBy("source_key"), F.col(f"{name}_size").cast("double")
    inter = F.count(F.when(~F.col("kf"), 1)).over(w)
    low = ~F.col("kf") & (F.row_number().over(w.orderBy("kf", f"{name}_size")) <= F.greatest(F.lit(1), F.ceil(inter * share)))
    marked = frames.withColumn("_low", F.when(low, size))
    median = marked.withColumn(f"{name}_median", F.percentile("_low", F.lit(0.5)).over(w))
    return median.withColumn(f"{name}_mad", F.percentile(F.abs(F.col("_low") - F.col(f"{name}_median")), F.lit(0.5)).over(w)).drop("_low")


def activity_masks(frames: DataFrame, config: ScanConfig = CONFIG, profile: DataFrame | None = None) -> DataFrame:
    """Frames with kf, n (frames of the recording), has_depth, baselines, rgb_active and depth_active.

    With ``profile`` (source_key and the columns of station_profile) its medians and MADs hold.
    The depth mask is a hysteresis: on above onset, off below offset, else as before; keyframes
    hold. As onset is never below offset, it is the last decisive frame's signal.
    Frames are dealt out so that a task sorts about as many however many recordings there are; all later stages keep that.
    """
    frames = dealt(frames, "source_key")
    w = Window.partitionBy("source_key")
    kf = keyframe(every=config.keyframe_every)
    marked = frames.withColumns({"kf": kf, "n": F.count(F.lit(1)).over(w), "has_depth": F.coalesce(F.avg(F.when(~kf, F.col("depth_size"))).over(w) > 1.0, F.lit(False))})
    if profile is None:
        for name in ("rgb", "depth"):
            marked = _own_baseline(marked, name, config.idle_share)
        marked = marked.na.fill(0.0, ["rgb_median", "rgb_mad", "depth_median", "depth_mad"])
    else:
        marked = marked.join(profile.select("source_key", "rgb_median", "rgb_mad", "depth_median", "depth_mad"), "source_key")
    sigma = F.col("depth_mad") * config.mad_scale
    onset, offset = F.col("depth_median") + config.depth_onset_k * sigma, F.col("depth_median") + config.depth_offset_k * sigma
    signal = F.when(F.col("kf"), None).when(F.col("depth_size") > onset, 1).when(F.col("depth_size") < offset, 0)
    upto = w.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumns({
        "rgb_active": ~F.col("kf") & (F.col("rgb_size") > F.col("rgb_median") + config.rgb_k * F.col("rgb_mad")),
        "depth_active": F.col("has_depth") & (F.coalesce(F.last(signal, ignorenulls=True).over(upto), F.lit(0)) == 1),
    })


def tiles(masked: DataFrame, config: ScanConfig = CONFIG) -> DataFrame:
    """One row per recording and tile of ``stride`` frames: its frames, and the window that begins there.

    A window is some whole tiles, so its statistics are sums over tile rows; no frame is copied. All
    stages keep the partitioning by recording: frames are shuffled once. ``ego`` says whether the
    window that the tile's frames look up for their fusion is one of camera motion.
    """
    w = Window.partitionBy("source_key").orderBy("idx")
    p, off = ~F.col("kf"), F.col("idx") % config.stride
    either = {"d": F.col("depth_active"), "e": F.col("depth_active") | F.col("rgb_active")}
    # length of the run of active frames that ends at a frame, for depth alone and for both
    since = {f"_{k}": F.when(c, F.col("idx") - F.coalesce(F.max(F.when(~c, F.col("idx"))).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(-1))).otherwise(0) for k, c in either.items()}
    run = masked.withColumns({**since, "tile": F.floor(F.col("idx") / config.stride), "off": off})
    count = lambda c: F.count(F.when(c, 1))
    at, least = config.burst_min - 1, config.burst_min
    bursts = {}
    for k in either:
        r = F.col(f"_{k}")
        # a window counts a run where it gets long enough; the frames before do not count in its first tile
        bursts[f"all_{k}"], bursts[f"head_{k}"], bursts[f"open_{k}"] = count(r == least), count((r == least) & (F.col("off") < at)), count((r > least) & (F.col("off") == at))
    tile = run.groupBy("source_key", "tile").agg(
        F.first("n").alias("n"), F.first("has_depth").alias("has_depth"), F.first("rgb_median").alias("rgb_median"),
        count(p).alias("p"), count(p & F.col("rgb_active")).alias("rgb_p"), count(p & F.col("depth_active")).alias("depth_p"), count(p & either["e"]).alias("both_p"),
        F.max(F.when(p, F.col("rgb_size"))).alias("max_size"), F.collect_list(F.when(p, F.col("rgb_size"))).alias("sizes"), *[c.alias(k) for k, c in bursts.items()],
        # at most a tile's frames
        F.collect_list(F.struct("idx", "kf", "rgb_active", "depth_active", "rgb_size", "depth_size")).alias("marks"), *_sums("rgb_size", "depth_size"),
    )
    ahead = Window.partitionBy("source_key").orderBy("tile")
    whole = ahead.rowsBetween(0, config.window // config.stride - 1)
    sums = {c: F.sum(c).over(whole) for c in ("p", "rgb_p", "depth_p", "both_p", "_n", "_sx", "_sy", "_sxx", "_syy", "_sxy")}
    sums |= {f"bursts_{k}": F.sum(f"all_{k}").over(whole) - F.col(f"head_{k}") + F.col(f"open_{k}") for k in either}
    sums |= {"max_size": F.max("max_size").over(whole), "sizes": F.sort_array(F.flatten(F.collect_list("sizes").over(whole)))}
    window = tile.withColumns(sums)
    corr = F.when(F.col("has_depth") & (F.col("p") >= 10), safe_corr(*map(F.col, ("_n", "_sx", "_sy", "_sxx", "_syy", "_sxy")))).otherwise(0.0)
    window = window.withColumn("corr", corr).withColumn("is_ego", F.col("has_depth") & (F.col("corr") > config.ego_corr))
    # half a window before the frame, or the first one
    looked = config.window // 2 // config.stride
    return window.withColumn("ego", F.coalesce(F.lag("is_ego", looked).over(ahead), F.first("is_ego").over(ahead.rowsBetween(Window.unboundedPreceding, 0))))


def window_columns(config: ScanConfig = CONFIG) -> dict[str, Column]:
    """The statistics of the window that begins at a tile."""
    mean_d = F.col("_sy") / F.col("_n")
    var_d = (F.col("_n") * F.col("_syy") - F.col("_sy") * F.col("_sy")) / (F.col("_n") * F.col("_n"))
    p95 = F.least((F.size("sizes").cast("float") * F.lit(0.95).cast("float")).cast("int"), F.size("sizes") - 1)
    ratio = F.when(F.size("sizes") >= 2, _ratio(F.get("sizes", p95), F.get("sizes", F.floor(F.size("sizes") / 2).cast("int")), 1.0)).otherwise(1.0)
    has_median = (F.col("p") > 0) & (F.col("rgb_median") > 0)
    start = F.col("tile") * config.stride
    return {
        "window_idx": F.col("tile"), "start_frame": start, "end_frame": F.least(start + config.window, "n"),
        "active_fraction": _ratio(F.when(F.col("is_ego"), F.col("depth_p")).otherwise(F.col("both_p")), F.col("p")),
        "mean_excess": F.when(has_median, F.col("_sx") / F.col("rgb_median") / F.col("p")).otherwise(0.0),
        "max_excess": F.when(has_median, F.col("max_size") / F.col("rgb_median")).otherwise(0.0), "p95_p50": ratio,
        "burst_count": F.when(F.col("is_ego"), F.col("bursts_d")).otherwise(F.col("bursts_e")),
        "depth_cv": F.when(F.col("has_depth") & (F.col("_n") > 0) & (F.col("_sy") > 0), F.sqrt(var_d) / mean_d).otherwise(0.0),
        "depth_fraction": _ratio(F.col("depth_p"), F.col("p")), "rgb_fraction": _ratio(F.col("rgb_p"), F.col("p")), "correlation": F.col("corr"), "is_ego": F.col("is_ego"),
    }


def window_stats(tiled: DataFrame, config: ScanConfig = CONFIG) -> DataFrame:
    """One row per recording and sliding window, short ones at the end too."""
    return tiled.select("source_key", *[c.alias(k) for k, c in window_columns(config).items()])


def fused_mask(tiled: DataFrame, *also: Column) -> DataFrame:
    """Frames with active: depth, or rgb outside camera motion, by the one window a frame looks up.

    ``also`` are columns of the tile, given to its first frame and null for the others.
    """
    first = [F.when(F.col("place") == 0, F.col(f"_also{i}")).alias(f"_also{i}") for i in range(len(also))]
    rows = tiled.select("source_key", "n", "ego", *[c.alias(f"_also{i}") for i, c in enumerate(also)], F.posexplode("marks").alias("place", "m"))
    rows = rows.select("source_key", "n", "ego", "m.*", *first)
    return rows.withColumn("active", F.col("depth_active") | (F.col("rgb_active") & ~F.col("ego"))).drop("ego")


def runs(df: DataFrame, flag: str, by: str = "source_key", order: str = "idx", also: Sequence[Column] = ()) -> DataFrame:
    """(by, start, end, len) of maximal runs of true flags in order; end is exclusive. ``also``: further aggregates."""
    w = Window.partitionBy(by).orderBy(order)
    begin = F.col(flag) & ~F.coalesce(F.lag(flag).over(w), F.lit(False))
    marked = df.withColumn("run", F.sum(begin.cast("int")).over(w))
    return marked.filter(flag).groupBy(by, "run").agg(
        F.min(order).alias("start"), (F.max(order) + 1).alias("end"), F.count(F.lit(1)).alias("len"), *also
    )


def count_bursts(df: DataFrame, flag: str, by: str = "source_key", order: str = "idx", min_len: int = CONFIG.burst_min) -> DataFrame:
    """(by, burst_count): how many runs get long enough, 0 for keys without any."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    place = df.select(by, order, flag, F.row_number().over(Window.partitionBy(by).orderBy(order)).alias("k"))
    long_enough = F.col("k") - F.coalesce(F.max(F.when(~F.col(flag), F.col("k"))).over(w), F.lit(0)) == min_len
    return place.withColumn("hit", F.col(flag) & long_enough).groupBy(by).agg(F.count(F.when(F.col("hit"), 1)).alias("burst_count"))


# ---- features and verdicts ----------------------------------------------------------------


def running_stats(x: Column, name: str) -> list[Column]:
    """Count, mean, sample deviation, least and greatest of a column, 0 where there are too few rows."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return [
        F.count(x).alias(f"{name}_count"), zero(F.avg(x)).alias(f"{name}_mean"), zero(F.stddev_samp(x)).alias(f"{name}_std"),
        zero(F.min(x).cast("double")).alias(f"{name}_min"), zero(F.max(x).cast("double")).alias(f"{name}_max"),
    ]


def stream_stats(frames: DataFrame, by: str = "source_key") -> DataFrame:
    """Running statistics of the inter-frame sizes of both streams, one row per recording."""
    inter = lambda c: F.when(~keyframe(), F.col(c))
    return frames.groupBy(by).agg(*running_stats(inter("rgb_size"), "rgb"), *running_stats(inter("depth_size"), "depth"))


def episode_features(tiled: DataFrame, config: ScanConfig = CONFIG) -> DataFrame:
    """The features of each recording, and the columns of :func:`calibration_extras`, in one aggregate.

    Frames and windows come from the same rows: a window's statistics go with its first frame.
    """
    p = ~F.col("kf")
    third, half = F.col("idx") >= F.floor(F.col("n") * 2 / 3), F.col("idx") >= F.floor(F.col("n") / 2)
    share = lambda hit, of: F.coalesce(F.count(F.when(hit, 1)) / F.nullif(F.count(F.when(of, 1)), F.lit(0)), F.lit(0.0))
    mean, sd = F.avg(F.when(p, F.col("depth_size"))), F.stddev_samp(F.when(p, F.col("depth_size")))
    w = Window.partitionBy("source_key")
    in_order = w.orderBy("idx")
    stats = window_columns(config)
    also = F.named_struct(*[x for k in ("window_idx", "start_frame", "end_frame", "active_fraction", "depth_cv", "is_ego") for x in (F.lit(k), stats[k])])
    fused = fused_mask(tiled, also).withColumnRenamed("_also0", "w")
    since = F.col("idx") - F.coalesce(F.max(F.when(~F.col("active"), F.col("idx"))).over(in_order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(-1))
    placed = fused.withColumn("_since", since).withColumns({"_rank": F.row_number().over(w.orderBy("kf", "rgb_size")) - 1, "_p": F.count(F.when(p, 1)).over(w)})
    at95 = (F.col("_p").cast("float") * F.lit(0.95).cast("float")).cast("long")
    seen, hit = F.col("w").isNotNull(), F.col("w.active_fraction") > config.active_window
    out = placed.groupBy("source_key").agg(
        F.count(F.lit(1)).alias("total_frames"), F.max("_p").alias("_p"),
        share(p & F.col("active"), p).alias("active_fraction"),
        share(p & F.col("depth_active"), p).alias("depth_active_fraction"),
        share(p & third & F.col("active"), p & third).alias("final_third"),
        share(p & ~half & F.col("active"), p & ~half).alias("first_half"), share(p & half & F.col("active"), p & half).alias("second_half"),
        F.coalesce(F.when(mean > 0, sd / mean), F.lit(0.0)).alias("depth_cv"),
        # a run is a burst once it is long enough
        F.count(F.when(F.col("active") & (F.col("_since") == config.burst_min), 1)).alias("burst_count"),
        F.max(F.when(p & (F.col("_rank") == F.floor(F.col("_p") / 2)), F.col("rgb_size"))).alias("_p50"),
        F.max(F.when(p & (F.col("_rank") == at95), F.col("rgb_size"))).alias("_p95"),
        F.count(F.when(seen, 1)).alias("n_windows"), F.min(F.when(hit, F.col("w.window_idx"))).alias("first_active_window"), F.max(F.when(hit, F.col("w.window_idx"))).alias("last_active_window"),
        share(F.col("w.active_fraction") > 0, seen).alias("active_window_fraction"), F.avg("w.depth_cv").alias("window_depth_cv_mean"),
        F.greatest(F.max("w.depth_cv"), F.lit(0.0)).alias("window_depth_cv_max"), share(F.col("w.is_ego"), seen).alias("ego_window_fraction"),
        F.min_by(F.struct("w.start_frame", "w.end_frame", "w.active_fraction"), F.when(F.col("w.active_fraction") > 0.5, F.col("w.window_idx"))).alias("sustained"),
        F.coalesce(F.stddev_samp("w.active_fraction"), F.lit(0.0)).alias("window_activity_std"), *_sums("rgb_size", "depth_size"),
    )
    ratio = F.when(F.col("_p") >= 2, _ratio(F.col("_p95"), F.col("_p50"), 1.0)).otherwise(1.0)
    d = [F.col(c).cast("double") for c in ("_n", "_sx", "_sy", "_sxx", "_syy", "_sxy")]
    return out.select(
        "source_key", "total_frames", "active_fraction", "burst_count", F.coalesce(ratio, F.lit(1.0)).alias("p95_p50"),
        "first_active_window", "last_active_window",
        F.coalesce("first_active_window", "n_windows").alias("idle_prefix"),
        F.coalesce(F.col("n_windows") - 1 - F.col("last_active_window"), "n_windows").alias("idle_suffix"),
        "final_third", "active_window_fraction", "depth_cv", "depth_active_fraction", "window_depth_cv_mean", "window_depth_cv_max",
        "ego_window_fraction", "sustained", "window_activity_std", "first_half", "second_half", (F.col("second_half") - F.col("first_half")).alias("half_difference"), safe_corr(*d).alias("correlation"),
    )


#: Further columns of a calibration dump: spread of window activity, halves, correlation.
EXTRAS = ["window_activity_std", "first_half", "second_half", "half_difference", "correlation"]


def calibration_extras(features: DataFrame) -> DataFrame:
    return features.select("source_key", *EXTRAS)


def baseline_in_doubt(features: DataFrame, with_profile: bool = False, most: float = 0.75) -> DataFrame:
    """features with baseline_in_doubt: over ``most`` of the frames are active and no profile was used."""
    return features.withColumn("baseline_in_doubt", F.lit(not with_profile) & (F.col("active_fraction") > most))


def activity_score(f: DataFrame) -> Column:
    """0.35 depth, 0.20 frames, 0.15 bursts, 0.10 size ratio, 0.20 final third, each up to 1."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(c, F.lit(1.0)))
    return unit(
        0.35 * unit(F.col("depth_cv") / 0.20) + 0.20 * F.least(F.col("active_fraction") * 5, F.lit(1.0)) + 0.15 * F.least(F.col("burst_count") / 5, F.lit(1.0))
        + 0.10 * unit((F.col("p95_p50") - 1) / 3) + 0.20 * F.least(F.col("final_third") * 3, F.lit(1.0))
    )


def analyze(features: DataFrame, recordings: DataFrame) -> DataFrame:
    """(source_key, verdict, activity_score, reasons_keep, reasons_prune, ...) of each recording.

    ``recordings`` has source_key and duration_us.
    """
    f = features.join(recordings.select("source_key", (F.col("duration_us") / 1e6).alias("duration_s")), "source_key")
    c = F.col
    accidental = (c("total_frames") < 30) & (c("duration_s") < 1.0)
    moving = (c("depth_cv") > 0.18) | (c("window_depth_cv_max") > 0.25)
    static = (c("depth_cv") < 0.13) & (c("window_depth_cv_max") < 0.20)
    say = lambda when, text, *args: F.when(when, F.format_string(text, *args))
    keep = F.array_compact(F.array(
        say(c("depth_cv") > 0.18, "depth variation: CV=%.3f (3D scene changes detected)", c("depth_cv")),
        say(c("window_depth_cv_max") > 0.25, "per-window depth spike: max_cv=%.3f", c("window_depth_cv_max")),
        say(c("sustained").isNotNull() & moving, "sustained activity in window [%d-%d]: %.0f%% active", c("sustained.start_frame"), c("sustained.end_frame"), c("sustained.active_fraction") * 100),
        say((c("burst_count") >= 2) & moving, "%d activity bursts detected", c("burst_count")),
        say((c("final_third") > 0.15) & moving, "late episode activation: %.0f%% active in final third", c("final_third") * 100),
    ))
    prune = F.array_compact(F.array(
        say(static, "static depth: CV=%.3f max_window=%.3f (no 3D scene changes)", c("depth_cv"), c("window_depth_cv_max")),
        say(c("active_fraction") < 0.02, "very low activity: %.1f%% of frames active (fused)", c("active_fraction") * 100),
        F.when(c("burst_count") == 0, "no activity bursts"),
        F.when(c("final_third") <= 0, "no late-episode activation"),
        say(c("active_window_fraction") < 0.05, "minimal window activity: %.1f%%", c("active_window_fraction") * 100),
        say(c("ego_window_fraction") > 0.8, "mostly camera motion: %.0f%% ego-motion windows", c("ego_window_fraction") * 100),
    ))
    start = F.array(F.format_string("accidental start: %d frames, %.3fs", c("total_frames"), c("duration_s")))
    idle = (c("active_fraction") < 0.02) & (c("burst_count") == 0) & (c("final_third") <= 0)
    none = F.array().cast("array<string>")
    verdict = F.when(accidental, "PRUNE_CONFIDENT").when(F.size(keep) > 0, "KEEP").when(static | idle, "PRUNE_SUGGESTED").otherwise("REVIEW")
    return f.select(
        "source_key", verdict.alias("verdict"), F.when(accidental, 0.0).otherwise(activity_score(f)).alias("activity_score"),
        F.when(accidental, none).otherwise(keep).alias("reasons_keep"), F.when(accidental, start).otherwise(prune).alias("reasons_prune"),
        "total_frames", "duration_s", *[x for x in features.columns if x not in ("source_key", "total_frames", "sustained", *EXTRAS)],
    )


def scan(frames: DataFrame, config: ScanConfig = CONFIG, profile: DataFrame | None = None) -> DataFrame:
    """Masks, windows and their fusion as tiles: one lazy plan with one shuffle of the frames."""
    return tiles(activity_masks(frames, config, profile), config)


def segments(tiled: DataFrame, min_gap: int = 300, min_duration: int = 60, pad: int = 30, grid: int = 30) -> DataFrame:
    """(source_key, start_frame, end_frame, active_frames, total_frames) proposals.

    Runs are merged over gaps below ``min_gap``, short ones dropped, the rest padded, snapped to
    the keyframe grid and merged where they touch. Everything is a window over the runs, which stay
    rows until the last aggregate: a dropped run still gives a segment the frames that its padding
    covers.
    """
    w = Window.partitionBy("source_key").orderBy("start")
    upto, before, behind = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    found = runs(fused_mask(tiled), "active", also=[F.max("n").alias("n")])
    grouped = found.withColumn("g", F.sum(F.when(F.col("start") - F.lag("end").over(w) < min_gap, 0).otherwise(1)).over(upto))
    whole = Window.partitionBy("source_key", "g")
    merged = grouped.withColumns({"gs": F.min("start").over(whole), "ge": F.max("end").over(whole)})
    kept = F.col("ge") - F.col("gs") >= min_duration
    snapped = merged.withColumns({
        "s": F.when(kept, F.floor(F.greatest(F.col("gs") - pad, F.lit(0)) / grid) * grid),
        "e": F.when(kept, F.least(F.floor((F.least(F.col("ge") + pad, F.col("n")) + grid - 1) / grid) * grid, F.col("n"))),
    })
    ended = snapped.withColumns({"ended": F.max("e").over(before), "next": F.min("s").over(behind)})
    numbered = ended.withColumn("seg", F.sum(F.when(F.col("s") > F.coalesce("ended", F.lit(-1)), 1).otherwise(0)).over(upto))
    length, joined = F.col("end") - F.col("start"), F.col("next") <= F.col("ended")
    own = F.when(F.col("s").isNotNull() | joined, length).otherwise(F.greatest(F.lit(0), F.least("end", "ended") - F.col("start")))
    later = F.when(F.col("s").isNull() & ~F.coalesce(joined, F.lit(False)), F.greatest(F.lit(0), F.col("end") - F.greatest("start", "next")))
    parts = F.array(F.struct("seg", own.alias("frames"), "s", "e"), F.struct((F.col("seg") + 1).alias("seg"), later.alias("frames"), F.lit(None).cast("long").alias("s"), F.lit(None).cast("long").alias("e")))
    each = numbered.select("source_key", F.explode(parts).alias("x")).select("source_key", "x.*")
    out = each.groupBy("source_key", "seg").agg(F.min("s").alias("start_frame"), F.max("e").alias("end_frame"), F.coalesce(F.sum("frames"), F.lit(0)).alias("active_frames"))
    return out.filter("start_frame is not null").select("source_key", "start_frame", "end_frame", "active_frames", (F.col("end_frame") - F.col("start_frame")).alias("total_frames"))


def validate_index(index: DataFrame, recordings: DataFrame, header_bytes: int = 472) -> DataFrame:
    """(source_key, valid, n_errors, n_warnings, errors, warnings) of each recording's index.

    ``index``: source_key, entry, file_offset, timestamp_us; ``recordings``: total_frames and, if
    read from files, file_errors and file_warnings, which come first. A file with errors is not
    judged by its entries; one without an index has none. The messages are fixed values.
    """
    w = Window.partitionBy("source_key").orderBy("entry")
    say = lambda when, text: F.when(when, F.format_string(text, F.col("entry")))
    rows = index.select(
        "source_key", "entry",
        say(F.col("file_offset") <= F.lag("file_offset").over(w), "index entry %d: non-increasing offset").alias("order"),
        say(F.col("file_offset") < header_bytes, "index entry %d: offset before file header").alias("early"),
        say(F.col("timestamp_us") < F.lag("timestamp_us").over(w), "index entry %d: non-monotonic timestamp").alias("time"),
    )
    # only entries at fault are gathered
    said = lambda *cols: F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.coalesce(*cols).isNotNull(), F.struct("entry", F.array_compact(F.array(*cols)).alias("m"))))), lambda x: x["m"]))
    found = rows.groupBy("source_key").agg(said("order", "early").alias("errors"), said("time").alias("warnings"), F.count(F.lit(1)).alias("entries"))
    files = [c for c in ("file_errors", "file_warnings") if c in recordings.columns]
    joined = recordings.select("source_key", "total_frames", *files).join(found, "source_key", "left" if files else "inner")
    none = F.array().cast("array<string>")
    at_fault = F.size(F.coalesce("file_errors", none)) > 0 if files else F.lit(False)
    mismatch = F.when(F.col("total_frames") != F.col("entries"), F.format_string("frame count mismatch: footer says %d frames but %d index entries", "total_frames", "entries"))
    errors, warnings = F.coalesce("errors", none), F.array_compact(F.concat(F.coalesce("warnings", none), F.array(mismatch)))
    if files:
        errors = F.when(at_fault, F.col("file_errors")).otherwise(errors)
        warnings = F.when(at_fault, F.coalesce("file_warnings", none)).otherwise(F.concat(F.coalesce("file_warnings", none), warnings))
    return joined.select("source_key", errors.alias("errors"), warnings.alias("warnings")).select(
        "source_key", (F.size("errors") == 0).alias("valid"), F.size("errors").cast("long").alias("n_errors"), F.size("warnings").cast("long").alias("n_warnings"), "errors", "warnings"
    )


def validation_counts(checked: DataFrame) -> DataFrame:
    """One row: how many files passed, and how many did not."""
    return checked.agg(F.count(F.when(F.col("valid"), 1)).alias("passed"), F.count(F.when(~F.col("valid"), 1)).alias("failed"), F.sum("n_warnings").alias("warnings"))
