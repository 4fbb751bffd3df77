"""Review overlay: human overrides over machine rows, and what stays active after them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recscan.functions import scalars as S
from recscan.operators.labels import distinct_objects


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order_col: str | None = None) -> DataFrame:
    """Rows of both by key: new ones win over old ones, and among new ones the last by order_col."""
    order = F.col(order_col) if order_col else F.lit(0)
    both = old.withColumns({"_p": F.lit(0), "_o": order}).unionByName(new.withColumns({"_p": F.lit(1), "_o": order}), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc("_p"), F.desc("_o"))
    return both.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_p", "_o", "_r")


def parse_overrides(raw: Column) -> Column:
    """map<string, variant> of an override's fields: values keep their types, a field given as null its key.

    What is no object gives null: no override.
    """
    return F.from_json(raw, "map<string,variant>")


def given(o: Column, name: str, kind: str = "string") -> Column:
    """A field of an override as a type; null where it is missing, null, or cannot be read so."""
    return F.try_variant_get(o[name], "$", kind)


def _names(o: Column, name: str) -> Column:
    return F.coalesce(F.map_contains_key(o, name), F.lit(False))


def _notes(applies: Column) -> dict[str, Column]:
    """What the override that applies says of itself."""
    o = F.col("_o")
    return {f"override_{k}": F.when(applies, given(o, k)) for k in ("note", "updated_at")}


def episode_status(valid: Column, duration_s: Column, verdict: Column, reject_below_s: float = 5.0) -> Column:
    return (
        F.when(~valid, "invalid").when(duration_s < reject_below_s, "reject").when(verdict.isNull(), "invalid")
        .when(verdict == "KEEP", "keep").when(verdict == "PRUNE_CONFIDENT", "reject").otherwise("review")
    )


def effective_episodes(episodes: DataFrame, overrides: DataFrame) -> DataFrame:
    """episodes with effective_episode_status, override_note and override_updated_at.

    ``overrides``: episode_id, o (:func:`parse_overrides`). An override counts on valid episodes only; one that names
    no status leaves it, one that gives null takes it away. An override without fields is none.
    """
    j = episodes.join(overrides.withColumnRenamed("o", "_o"), "episode_id", "left")
    applies = (F.size("_o") > 0) & (F.col("validation_status") == "valid")
    status = F.when(applies & _names(F.col("_o"), "episode_status"), given(F.col("_o"), "episode_status")).otherwise(F.col("episode_status"))
    return j.withColumns({"effective_episode_status": status} | _notes(applies)).drop("_o")


def effective_intervals(intervals: DataFrame, overrides: DataFrame) -> DataFrame:
    """intervals with decision, trimmed ends, override_note and override_updated_at.

    ``overrides``: interval_id, o. Trims are numbers, or texts that hold one; they are clamped to the interval, and undone
    if nothing is left. A missing or null decision is to keep.
    """
    j = intervals.join(overrides.withColumnRenamed("o", "_o"), "interval_id", "left")
    start, end, o = F.coalesce("start_s", F.lit(0.0)), F.coalesce("end_s", "start_s", F.lit(0.0)), F.col("_o")
    trim = lambda name, other: F.when(given(o, name, "double").isNotNull(), S.clamp(given(o, name, "double"), start, end)).otherwise(other)
    cut = j.withColumns({"_s": trim("trim_start_s", start), "_e": trim("trim_end_s", end)})
    whole = F.col("_e") <= F.col("_s")
    s, e = F.when(whole, start).otherwise(F.col("_s")), F.when(whole, end).otherwise(F.col("_e"))
    return cut.withColumns({
        "effective_interval_decision": F.coalesce(given(o, "decision"), F.lit("keep")),
        "effective_start_s": F.bround(s, 6), "effective_end_s": F.bround(e, 6), "effective_duration_s": F.bround(F.greatest(e - s, F.lit(0.0)), 6),
    } | _notes(F.size("_o") > 0)).drop("_o", "_s", "_e")


#: Fields of a label that an override may give, and their types.
LABEL_FIELDS = {"is_manipulation": "boolean", "proposed_task_name": "string", "short_caption": "string", "primary_objects": "array<string>", "confidence": "double", "reason": "string"}


def effective_labels(labels: DataFrame, overrides: DataFrame) -> DataFrame:
    """labels with the fields that an override names, null ones too, override_note and override_updated_at.

    ``overrides``: interval_id, o. Names are normalised again where there is an override. A value that its field's
    type cannot hold, such as a text for the list of objects, becomes null.
    """
    j = labels.join(overrides.withColumnRenamed("o", "_o"), "interval_id", "left")
    o = F.col("_o")
    out = j.withColumns({n: F.when(_names(o, n), given(o, n, kind)).otherwise(F.col(n)) for n, kind in LABEL_FIELDS.items() if n in labels.columns})
    name = F.when(F.size("_o") > 0, S.normalize_label(F.col("proposed_task_name"))).otherwise(F.col("normalized_task_name"))
    return out.withColumns({"normalized_task_name": name} | _notes(F.size("_o") > 0)).drop("_o")


def active_intervals(intervals: DataFrame, episodes: DataFrame) -> DataFrame:
    """Intervals that are not rejected, of episodes neither rejected nor invalid; an unknown episode does not matter."""
    status = episodes.select("source_key", F.col("effective_episode_status").alias("_s"))
    kept = intervals.filter(F.coalesce("effective_interval_decision", F.lit("keep")) != "reject")
    return kept.join(status, "source_key", "left").filter(~F.coalesce("_s", F.lit("")).isin("reject", "invalid")).drop("_s")


def active_labels(labels: DataFrame, intervals: DataFrame, episodes: DataFrame) -> DataFrame:
    return labels.join(active_intervals(intervals, episodes).select("interval_id"), "interval_id", "left_semi")


def effective_buckets(labels: DataFrame, buckets: DataFrame, mapping: DataFrame, renames: DataFrame, assignments: DataFrame) -> DataFrame:
    """Buckets after moves and renames, aggregated anew from their labels; empty ones are left out.

    ``mapping``: interval_id, bucket_id; ``assignments``: the same and canonical_task_name (null
    allowed), which win; ``renames``: bucket_id, canonical_task_name; ``buckets``: bucket_id,
    canonical_task_name.
    """
    moved = assignments.filter(F.trim(F.coalesce("bucket_id", F.lit(""))) != "").select("interval_id", F.trim("bucket_id").alias("bucket_id"), F.col("canonical_task_name").alias("_new"))
    maps = upsert(mapping.select("interval_id", "bucket_id"), moved.select("interval_id", "bucket_id"), ["interval_id"])
    fresh = moved.groupBy("bucket_id").agg(F.min_by("_new", "interval_id").alias("_new"))
    seen = labels.select("interval_id", "normalized_task_name", "confidence", "primary_objects")
    members = maps.join(seen, "interval_id", "left")
    agg = members.groupBy("bucket_id").agg(
        F.count(F.lit(1)).alias("member_count"), F.array_sort(F.collect_set(F.nullif("normalized_task_name", F.lit("")))).alias("source_labels"),
        F.bround(F.coalesce(F.avg("confidence"), F.lit(0.0)), 6).alias("average_confidence"),
    ).join(distinct_objects(members, "bucket_id"), "bucket_id", "left").withColumn("primary_objects", F.coalesce("primary_objects", F.array().cast("array<string>")))
    known, renamed = buckets.select("bucket_id", F.col("canonical_task_name").alias("_old")), renames.select("bucket_id", F.nullif(F.trim("canonical_task_name"), F.lit("")).alias("_name"))
    name = F.coalesce("_name", "_old", F.nullif(F.trim("_new"), F.lit("")), "bucket_id")
    return agg.join(known, "bucket_id", "left").join(fresh, "bucket_id", "left").join(renamed, "bucket_id", "left").select(
        "bucket_id", name.alias("canonical_task_name"), "member_count", "source_labels", "average_confidence", "primary_objects"
    )


def exportable_segments(intervals: DataFrame, episodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, review): kept intervals of usable episodes; without length they go to review."""
    status = episodes.select("source_key", F.col("effective_episode_status").alias("_s"))
    rows = intervals.filter(F.coalesce("effective_interval_decision", F.lit("keep")) != "reject").join(status, "source_key", "left")
    usable = rows.filter(F.coalesce("_s", F.lit("keep")).isin("keep", "review")).drop("_s").withColumn("duration_s", F.bround(F.greatest(F.col("effective_end_s") - F.col("effective_start_s"), F.lit(0.0)), 6))
    bad = usable.filter("duration_s <= 0").select(F.lit("segments").alias("stage"), F.col("interval_id").alias("identifier"), F.lit("invalid_effective_interval").alias("reason"))
    return usable.filter("duration_s > 0").select("interval_id", "source_key", "effective_start_s", "effective_end_s", "duration_s"), bad


def review_queue(*parts: DataFrame) -> DataFrame:
    """Review rows (stage, identifier, reason) of all rules, one per review_id."""
    both = parts[0].select("stage", "identifier", "reason")
    for p in parts[1:]:
        both = both.unionByName(p.select("stage", "identifier", "reason"))
    return both.withColumn("review_id", S.review_id(F.col("stage"), F.col("identifier"), F.col("reason"))).dropDuplicates(["review_id"])
