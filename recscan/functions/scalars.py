"""Scalar functions of the curation tables: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def slugify(s: Column, limit: int = 80) -> Column:
    """Lower case, runs of other characters as one dash, at most ``limit`` characters, else item."""
    dashed = F.btrim(F.regexp_replace(F.lower(F.trim(s)), "[^a-zA-Z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(F.substring(dashed, 1, limit), F.lit("")), F.lit("item"))


def stable_hash(*parts: Column, length: int = 12) -> Column:
    """The first digits of the SHA-1 of the parts joined by ``::``; null counts as None."""
    return F.substring(F.sha1(F.concat_ws("::", *map(_text, parts)).cast("binary")), 1, length)


def interval_id(key: Column, start_s: Column, end_s: Column) -> Column:
    """int_ and a hash of the recording and both ends in milliseconds, rounded half to even."""
    ms = lambda c: F.bround(c * 1000, 0).cast("long")
    return F.concat(F.lit("int_"), stable_hash(key, ms(start_s), ms(end_s)))


def episode_id(key: Column) -> Column:
    return F.concat(F.lit("ep_"), F.substring(F.sha1(key.cast("binary")), 1, 16))


def review_id(stage: Column, identifier: Column, reason: Column) -> Column:
    return F.concat(F.lit("rev_"), stable_hash(stage, identifier, reason, length=16))


def normalize_label(s: Column) -> Column:
    """Lower case words parted by one space; unknown if nothing is left."""
    words = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), r"[^a-z0-9\s]+", " "), r"\s+", " "))
    return F.coalesce(F.nullif(words, F.lit("")), F.lit("unknown"))


def cluster_text(task: Column, objects: Column, caption: Column) -> Column:
    """Task, sorted objects and caption, normalised, joined by a bar; blank parts left out."""
    named = F.array_join(F.array_sort(F.transform(objects, normalize_label)), " ")
    return F.array_join(F.filter(F.array(normalize_label(task), F.coalesce(named, F.lit("")), normalize_label(caption)), lambda x: x != ""), " | ")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; 0 if a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def clamp(v: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(v, high))


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))


def area_fraction(points: Column) -> Column:
    """Area of the bounding box of points (struct x, y) clamped to the unit square; 0 if none."""
    side = lambda d: F.array_max(F.transform(points, lambda p: clamp(p[d], F.lit(0.0), F.lit(1.0)))) - F.array_min(F.transform(points, lambda p: clamp(p[d], F.lit(0.0), F.lit(1.0))))
    return F.coalesce(side("x") * side("y"), F.lit(0.0))


def relative_key(key: Column, prefix: str) -> Column:
    """The key below a prefix, without leading slashes; other keys as they are."""
    return F.when(F.startswith(key, F.lit(prefix)), F.ltrim(F.substring(key, F.lit(len(prefix) + 1), F.length(key)), F.lit("/"))).otherwise(key)


def source_prefix(key: Column) -> Column:
    return F.split_part(key, F.lit("/"), F.lit(1))


def json_object(s: Column) -> Column:
    """The text from the first { to the last }, fences and prose cut off; null without both."""
    return F.nullif(F.regexp_extract(s, r"(?s)(\{.*\})", 1), F.lit(""))


def chat_content(content: Column) -> Column:
    """A chat answer in JSON: a string, or a list of parts of which the texts are joined by lines."""
    parts = F.from_json(content, "array<struct<type:string,text:string>>")
    texts = F.transform(F.filter(parts, lambda p: p["text"].isNotNull()), lambda p: p["text"])
    one = F.from_json(F.concat(F.lit('{"s":'), content, F.lit("}")), "struct<s:string>")["s"]
    return F.when(F.startswith(F.ltrim(content), F.lit("[")), F.array_join(texts, "\n")).otherwise(one)


def profile_key(serial: Column, key: Column) -> Column:
    return F.coalesce(F.nullif(serial, F.lit("")), F.concat(F.lit("source-"), slugify(source_prefix(key))))


def recorded_at(us: Column) -> Column:
    return F.when(us > 0, F.timestamp_micros(us))


def fps(frames: Column, duration_s: Column) -> Column:
    return F.when((duration_s > 0) & (frames > 0), frames / duration_s).otherwise(0.0)


def relative_s(ts_us: Column, start_us: Column) -> Column:
    """Seconds since the start, never below 0; 0 where the start is unknown."""
    return F.when(start_us > 0, F.greatest(ts_us - start_us, F.lit(0)) / 1e6).otherwise(0.0)


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(1 << bit)) != 0


# Codec ids of colour video.
CODECS = {0: "raw", 1: "JPEG", 2: "H264"}


def codec_name(codec: Column) -> Column:
    name = F.lit("unknown")
    for k, v in CODECS.items():
        name = F.when(codec == k, v).otherwise(name)
    return name


STREAMABLE = 2


def streamable(codec: Column) -> Column:
    return codec == STREAMABLE


def stream_error(codec: Column) -> Column:
    """Why a video cannot be streamed; null if it can. The text is a fixed value."""
    return F.when(codec != STREAMABLE, F.format_string(f"rgb_codec=%d is not browser-streamable (need {STREAMABLE} for H.264)", codec))


def join_tags(tags_: Column) -> Column:
    return F.array_join(tags_, ",")


def tags(s: Column) -> Column:
    """A comma-separated list as an array, blanks dropped."""
    return F.filter(F.transform(F.split(s, ","), lambda x: F.trim(x)), lambda x: x != "")


def date_path(ts: Column) -> Column:
    return F.date_format(ts, "yyyy/MM/dd")


def human_size(n: Column) -> Column:
    """Bytes with one decimal in the unit that leaves less than 1024."""
    # ties go to the even digit
    out = F.format_string("%.1f PB", F.bround(n / 1024.0**5, 1))
    for k, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB")))):
        out = F.when(F.abs(n / 1024.0**k) < 1024, F.format_string(f"%.1f {unit}", F.bround(n / 1024.0**k, 1))).otherwise(out)
    return out


def human_duration(s: Column) -> Column:
    n = s.cast("long")
    h, m, sec = F.floor(n / 3600), F.floor(n % 3600 / 60), n % 60
    return (
        F.when(s < 60, F.concat(F.bround(s, 0).cast("long").cast("string"), F.lit("s")))
        .when(n < 3600, F.format_string("%dm %02ds", m, sec)).otherwise(F.format_string("%dh %02dm %02ds", h, m, sec))
    )


def retry_delay(attempts: Column) -> Column:
    """Seconds to wait: 10 doubled each attempt, 300 at most."""
    return F.least(F.pow(F.lit(2.0), attempts) * 10, F.lit(300.0))


def object_key(prefix: str, relative: Column) -> Column:
    base = prefix.strip("/")
    return F.concat(F.lit(f"{base}/"), relative) if base else relative


def downsample_step(source_fps: Column, fps_wanted: Column) -> Column:
    """Keep each so many-th frame; an unknown source rate counts as 30."""
    rate = F.when(source_fps > 0, source_fps).otherwise(30.0)
    return F.greatest(F.bround(rate / F.greatest(fps_wanted, F.lit(0.1)), 0).cast("long"), F.lit(1).cast("long"))


def storyboard_rate(n_frames: Column, duration_s: Column) -> Column:
    return F.greatest(n_frames / F.greatest(duration_s, F.lit(1.0)), F.lit(0.1))
