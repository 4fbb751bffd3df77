"""Mixing sources to target weights by pivotal dependent rounding.

Targets come from a water level over sources; each document of a source gets the same expected
number of copies, and only the fractional part is rounded. Two documents with fractional copies
trade words at random until one of them is integral; what is left of each bucket of documents is
one fractional document, and a tree of further buckets combines those. The trade keeps the words
of the pair, so a source ends within one document of its target, however its sizes are spread.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recscan.llm.shared import BROADCAST_ROWS, materialize, numbered, settled
from recscan.operators.ranks import ranked as places

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order of their code points, repeated.
WEIGHTS = (5.0, 2.0, 1.0)
#: The mix takes this share of all words; a source gives at most MOST times its own.
SHARE, MOST = 1.5, 2.0
#: Documents of a bucket in the leaves of the tree, and residuals of a bucket further up.
LEAF_ROWS, FAN_IN = 4_000, 256
_DONE = 1e-9


def words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: source, source_size, n_docs, target.

    ``sizes`` has source and size. Sources are ordered by code point, null last. One row per
    source is all that leaves the aggregate; the water level is found by a few sums over it.
    Sources above their limit are fixed there and the rest shared again, until none is above.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    cycle = F.array(*map(F.lit, weights))
    # sources may be as many as hosts: their places are found without bringing them to one task
    placed = places(by_source, [F.col("source").asc_nulls_last()], "rank")
    ranked = materialize(placed.withColumn("weight", F.get(cycle, (F.col("rank") % len(weights)).cast("int"))).drop("rank"), "sources")
    limit = most * F.col("source_size")
    words_all = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, free = 0.0, -1
    while True:
        above = F.lit(level) * F.col("weight") > limit if free >= 0 else F.lit(False)
        fixed, weight, n = ranked.agg(
            F.sum(F.when(above, limit).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))), F.sum(F.when(above, 0).otherwise(1))
        ).first()
        if not n or n == free:
            break
        level, free = (share * words_all - fixed) / weight, n
    return ranked.select("source", "source_size", "n_docs", F.least(F.lit(float(level)) * F.col("weight"), limit).alias("target"))


def _uniform(a: int, b: int, seed: int) -> float:
    """A number in [0, 1) that depends on the two rows alone, so that reruns agree."""
    x = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + seed) & (2**64 - 1)
    for k in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = ((x ^ (x >> 29)) * k) & (2**64 - 1)
    return (x ^ (x >> 32)) / 2**64


def pivot(keys: np.ndarray, sizes: np.ndarray, fractions: np.ndarray, seed: int) -> np.ndarray:
    """Rounds the fractions of one bucket; at most one stays fractional.

    The fractional row of the moment meets the next one: words move from one to the other, either
    way with the chance that keeps both expectations, until one of the two is 0 or 1.
    """
    p = fractions.astype(float).copy()
    held = -1
    for i in np.flatnonzero((p > _DONE) & (p < 1 - _DONE) & (sizes > 0)):
        if held < 0:
            held = i
            continue
        a, b = float(sizes[held]), float(sizes[i])
        up = min((1 - p[held]) * a, p[i] * b)
        down = min(p[held] * a, (1 - p[i]) * b)
        moved = up if _uniform(int(keys[held]), int(keys[i]), seed) * (up + down) < down else -down
        p[held] += moved / a
        p[i] -= moved / b
        for k in (held, i):
            if min(p[k], 1 - p[k]) <= _DONE:
                p[k] = round(p[k])
        if p[held] in (0.0, 1.0):
            held = i if p[i] not in (0.0, 1.0) else -1
    return p


def _round_bucket(bucket: pa.Table) -> pa.Table:
    rows = bucket.sort_by([("key", "ascending"), ("row", "ascending")])
    key, size, frac = (rows[c].to_numpy() for c in ("key", "size", "frac"))
    rounded = pivot(key, size, frac, seed=rows["level"][0].as_py())
    return rows.set_column(rows.schema.get_field_index("frac"), "frac", pa.array(rounded))


def mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: _row, doc_id, size, source_size, target, copies, taken.

    size is the text's number of words (null: 0); target belongs to the row's source; copies is 0,
    1 or 2 and taken = copies x size. Documents without words are taken 0 times. Rows with a null
    source are one source, ordered last. Repeated rows are rounded each for itself, and so are rows
    without an id. An empty table gives no row. Reruns agree where ids are not repeated; of equal
    rows in another order, others may be taken.

    Only narrow rows move. A source with a third of all rows has as many buckets as it has
    LEAF_ROWS rows; buckets leave one residual each, and levels are added until one is left.
    """
    narrow = materialize(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            words(F.col(text_col)).alias("size"),
        ),
        "sizes",
    )
    targets = source_targets(narrow)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    key = F.xxhash64("id", "size")
    # many rows of one id and size, as those without an id, would share a bucket: they are dealt out by row
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("source", "id", "size")]
    often = narrow.groupBy(*(F.col(c).alias(f"_{c}") for c in ("source", "id", "size"))).count().filter(F.col("count") > LEAF_ROWS / 4).drop("count")
    often = materialize(often.withColumn("often", F.lit(True)), "often")
    n = often.count()
    if n:
        narrow = narrow.join(F.broadcast(often) if n <= BROADCAST_ROWS else often, same, "left").drop("_source", "_id", "_size")
        key = F.when(F.col("often"), F.xxhash64("id", "size", "row")).otherwise(key)
    rows = (
        narrow.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .withColumn("whole", F.floor(rate + _DONE).cast("long"))
        .select(
            "row", "id", "size", "source_size", "target", "whole", key.alias("key"),
            F.xxhash64(F.col("source").isNull(), "source").alias("src"),
            F.when(F.col("size") > 0, F.greatest(F.lit(0.0), rate - F.col("whole"))).otherwise(0.0).alias("frac"),
            F.ceil(F.col("n_docs") / LEAF_ROWS).alias("buckets"),
            F.pmod(key, F.ceil(F.col("n_docs") / LEAF_ROWS)).alias("bucket"),
            F.lit(0).alias("level"),
        )
    )
    open_rows = (F.col("frac") > 0) & (F.col("frac") < 1)
    settled, level = [], 0
    while True:
        rounded = materialize(rows.groupBy("src", "bucket").applyInArrow(_round_bucket, rows.schema), f"mix{level}")
        done = (F.col("buckets") <= 1) | ~open_rows
        settled.append(rounded.filter(done))
        level += 1
        rows = rounded.filter(~done).select(
            *[c for c in rounded.columns if c not in ("buckets", "bucket", "level")],
            F.ceil(F.col("buckets") / FAN_IN).alias("buckets"),
            F.floor(F.col("bucket") / FAN_IN).alias("bucket"),
            F.lit(level).alias("level"),
        )
        rows = rows.select(*rounded.columns)
        if rows.isEmpty():
            break
    last = F.when(open_rows, F.when(F.col("frac") >= 0.5, 1).otherwise(0)).otherwise(F.col("frac").cast("long"))
    copies = F.when(F.col("size") > 0, F.col("whole") + last).otherwise(0).cast("long")
    return reduce(DataFrame.unionByName, settled).select(
        F.col("row").alias("_row"), F.col("id").alias(id_col), "size", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"),
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: the taken rows of ``docs``, all columns, once per copy, with ``copy`` (0, 1).

    Where ``docs`` has a column of that name, it stays and the number is called copy_1, and so on.
    Rows are taken as :func:`mix` says; an empty table gives no row.
    """
    docs = settled(docs, "docs")
    name = next(n for n in ("copy", *(f"copy_{i}" for i in range(1, len(docs.columns) + 2))) if n.lower() not in map(str.lower, docs.columns))
    taken = mix(docs).filter("copies > 0").select(F.col("_row").alias("_mix_row"), "copies")
    all_rows = numbered(docs, "_mix_row")
    copy = F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)).alias("_copy")
    return all_rows.join(taken, "_mix_row").select("_all", copy).select("_all.*", F.col("_copy").alias(name))
