"""Labels: parsing answers, clustering by similarity, canonical names and buckets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from recscan.functions import scalars as S
from recscan.operators import components
from recscan.operators.ranks import ranked
from recscan.scratch import written

LOW_CONFIDENCE, SIMILAR = 0.55, 0.82
_ANSWER = "struct<is_manipulation:string,proposed_task_name:string,short_caption:string,primary_objects:string,confidence:string,reason:string>"


def parse_answers(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels, failures) from answers (interval_id, source_key, raw): fenced or prosaic JSON.

    Blank tasks are unknown, objects that are no list are none, a missing confidence is 0, and
    is_manipulation is true only as true or "true". What is no object becomes a failure row.
    """
    parsed = answers.withColumn("a", F.from_json(S.json_object(F.col("raw")), _ANSWER))
    good = F.col("a").isNotNull() & F.coalesce(F.col("a.proposed_task_name"), F.col("a.confidence"), F.col("a.is_manipulation")).isNotNull()
    task = F.coalesce(F.nullif(F.trim("a.proposed_task_name"), F.lit("")), F.lit("unknown"))
    objects = F.coalesce(F.from_json("a.primary_objects", "array<string>"), F.array().cast("array<string>"))
    labels = parsed.filter(good).select(
        "interval_id", "source_key", (F.lower(F.trim(F.coalesce("a.is_manipulation", F.lit("")))) == "true").alias("is_manipulation"),
        task.alias("proposed_task_name"), S.normalize_label(task).alias("normalized_task_name"), F.coalesce("a.short_caption", F.lit("")).alias("short_caption"),
        objects.alias("primary_objects"), F.coalesce(F.try_to_number("a.confidence", F.lit("9.999999")).cast("double"), F.col("a.confidence").try_cast("double"), F.lit(0.0)).alias("confidence"),
    )
    return labels, parsed.filter(~good).select("interval_id", "source_key", F.lit("vlm_failure").alias("reason"))


#: Bytes of the vectors of a tile, some neighbouring blocks; a task holds two tiles.
TILE_BYTES = 16_000_000
#: Products that a task holds at once.
PRODUCTS = 1 << 21
#: Proposed pairs that are computed in double precision at once.
CHECKED = 1 << 16


def _packed(group: pa.Table) -> pa.Table:
    """One row for each block: its vectors one behind the other, as bytes."""
    ids = group["id"].combine_chunks()
    v = np.ascontiguousarray(group["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False), float)
    return pa.table({"slot": group["slot"][:1], "ids": pa.array([ids.to_numpy().tobytes()], pa.binary()), "vs": pa.array([v.tobytes()], pa.binary())})


def _near_pairs(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids of the tiles' vectors, places a, places b, similarities) of pairs at the threshold, some products at a time.

    Rows are the blocks of two tiles, or of one: slot, ids, vs, and in ``reached`` the slots from its own on that a block is
    compared with, null for the blocks of the second tile.
    """
    held = sorted((r for b in batches for r in b.select(["slot", "ids", "vs", "reached"]).to_pylist()), key=lambda r: r["slot"])
    ids = [np.frombuffer(r["ids"], np.int64) for r in held]
    ends = np.cumsum([0, *map(len, ids)])
    ids = np.concatenate(ids)
    v = np.concatenate([np.frombuffer(r["vs"], float) for r in held]).reshape(len(ids), -1)
    slot = np.repeat([r["slot"] for r in held], np.diff(ends))
    # single precision proposes, with room for all its rounding
    rough, least = v.astype(np.float32), np.float32(threshold - (v.shape[1] + 8) * 2.0**-23)
    for k, row in enumerate(held):
        if row["reached"] is None:
            continue
        cols = np.flatnonzero(np.isin(slot, row["reached"]))
        # neighbouring blocks are a stretch: no copy
        other = rough[cols[0] : cols[-1] + 1] if cols[-1] - cols[0] + 1 == len(cols) else rough[cols]
        step = max(1, PRODUCTS // len(cols))
        for first in range(ends[k], ends[k + 1], step):
            near = rough[first : min(first + step, ends[k + 1])] @ other.T
            at = np.flatnonzero(near >= least)
            for part in np.split(at, range(CHECKED, len(at), CHECKED)):
                a, b = part // len(cols) + first, cols[part % len(cols)]
                # within a block each pair once; other blocks lie behind
                a, b = a[b > a], b[b > a]
                exact = np.einsum("ij,ij->i", v[a], v[b])
                kept = exact >= threshold
                if kept.any():
                    yield ids, a[kept], b[kept], exact[kept]


def _pairs_of(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """All pairs at the threshold."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, a, b, near in _near_pairs(batches, threshold):
            x, y = ids[a], ids[b]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(near)], ["a", "b", "similarity"])

    return compare


def _links_of(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of the pairs at the threshold so many links that they join up the same vectors: fewer than the tiles have vectors."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up = ids = None
        for ids, a, b, _ in _near_pairs(batches, threshold):
            up = np.arange(len(ids)) if up is None else up
            while len(a):
                x, y = up[a], up[b]
                apart = x != y
                a, b, x, y = a[apart], b[apart], x[apart], y[apart]
                np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
                while (up != up[up]).any():
                    up = up[up]
        if up is not None:
            at = np.flatnonzero(up != np.arange(len(up)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[up[at]]), pa.array(ids[at])], ["a", "b"])

    return compare


#: At most so many vectors, those with the smallest hashed ids, are pivots; they and a row for each block go to every task.
MAX_PIVOTS = 1024
#: Blocks of one pivot are bands of this angle, and parts of a band that is too large.
BAND = 0.1
#: What rounding may cost an angle.
SLACK = 1e-6


def _nearest(pivots: np.ndarray) -> Callable:
    """Adds the nearest pivot of each vector, and the angle to it."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) @ pivots.T if batch.num_rows else np.zeros((0, len(pivots)))
            pivot = near.argmax(axis=1) if batch.num_rows else np.zeros(0, int)
            angle = np.arccos(np.clip(near[np.arange(len(pivot)), pivot], -1, 1))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["v"], pa.array(pivot, pa.int32()), pa.array(angle, pa.float64())], ["id", "v", "pivot", "angle"])

    return assign


def _reach(stats: dict[str, np.ndarray], pivots: np.ndarray, threshold: float) -> Callable:
    """For each block the blocks from its own on that may hold a vector near enough to one of its own.

    With p and q the pivots of v and w, the angle of v and w is at least pq - pv - qw, pv - pq - qw and qw - pq - pv.
    """
    most = float(np.arccos(np.clip(threshold, -1, 1))) + SLACK
    between = np.arccos(np.clip(pivots @ pivots.T, -1, 1))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, hi = [], []
            for slot in batch["slot"].to_pylist():
                pq = between[stats["pivot"][slot], stats["pivot"]]
                low, high = stats["low"], stats["high"]
                least = np.maximum.reduce([pq - high[slot] - high, low[slot] - pq - high, low - pq - high[slot]])
                found = np.flatnonzero(least <= most)
                found = found[found >= slot]
                lo += [slot] * len(found)
                hi += found.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["lo", "hi"])

    return pairs


def vector_blocks(vectors: DataFrame, threshold: float, block: int, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(vectors as id, v, slot; pairs of slots lo <= hi that may hold vectors at the threshold).

    Vectors lie in blocks of about ``block`` rows: by the nearest of some pivots, by bands of their angle to it, and
    by a hash where a band holds more. A pair of blocks that triangles of angles keep below the threshold is left out.
    """
    spark = vectors.sparkSession
    unit = written(vectors.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), _unit(F.col(vec_col)).alias("v")), "vectors")
    n = unit.count()
    if n <= block:
        return unit.withColumn("slot", F.lit(0).cast("long")), spark.range(1 if n else 0).select(F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"))
    few = min(MAX_PIVOTS, -(-n // block))
    drawn = unit.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(few).collect()
    pivots = np.unique(np.array([r["v"] for r in drawn], float), axis=0)
    near = written(unit.mapInArrow(_nearest(pivots), "id long, v array<double>, pivot int, angle double").withColumn("band", F.floor(F.col("angle") / BAND).cast("int")), "near_pivots")
    bands = near.groupBy("pivot", "band").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    parted = near.join(F.broadcast(bands), ["pivot", "band"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")
    # a row for each block: n / block and some for each pivot
    found = parted.groupBy("pivot", "band", "part").agg(F.min("angle").alias("low"), F.max("angle").alias("high")).orderBy("pivot", "band", "part").collect()
    stats = {c: np.array([r[c] for r in found]) for c in ("pivot", "low", "high")}
    slots = spark.createDataFrame([(r["pivot"], r["band"], r["part"], i) for i, r in enumerate(found)], "pivot int, band int, part long, slot long")
    slotted = parted.join(F.broadcast(slots), ["pivot", "band", "part"]).select("id", "v", "slot")
    return slotted, slots.select("slot").repartition("slot").mapInArrow(_reach(stats, pivots, threshold), "lo long, hi long")


def _tiles_met(vectors: DataFrame, threshold: float, block: int, id_col: str, vec_col: str) -> GroupedData | None:
    """Blocks of vectors by pairs of tiles that may hold vectors at the threshold, see :func:`_near_pairs`; None without vectors.

    A tile is some neighbouring blocks, at most TILE_BYTES, so that a vector goes to few tasks; within a pair of tiles
    only blocks in reach of one another are compared.
    """
    spark = vectors.sparkSession
    slotted, pairs = vector_blocks(vectors, threshold, block, id_col, vec_col)
    packed = written(slotted.groupBy("slot").applyInArrow(_packed, "slot long, ids binary, vs binary"), "blocks")
    # a row for each block
    sizes = packed.select("slot", F.octet_length("vs").alias("bytes")).orderBy("slot").collect()
    if not sizes:
        return None
    total, most, tile, room, tiles = sum(r["bytes"] for r in sizes), TILE_BYTES, -1, 0, []
    # tasks enough for all cores, where there are blocks enough
    most = min(most, max(1, total // (2 * spark.sparkContext.defaultParallelism)))
    for r in sizes:
        if tile < 0 or r["bytes"] > room:
            tile, room = tile + 1, most
        room -= r["bytes"]
        tiles.append((r["slot"], tile))
    of = spark.createDataFrame(tiles, "slot long, tile int")
    at = lambda end: F.broadcast(of.select(F.col("slot").alias(end), F.col("tile").alias(f"{end}_tile")))
    met = pairs.join(at("lo"), "lo").join(at("hi"), "hi")
    both = ["lo_tile", "hi_tile"]
    first = met.groupBy(*both, F.col("lo").alias("slot")).agg(F.collect_list("hi").alias("reached"))
    second = met.select(*both, F.col("hi").alias("slot"), F.lit(None).cast("array<bigint>").alias("reached")).distinct()
    wanted = written(first.unionByName(second).groupBy(*both, "slot").agg(F.max("reached").alias("reached")), "block_pairs")
    # as many tasks as pairs of tiles: each holds one or few of them
    tasks = min(10_000, (tile + 1) * (tile + 2) // 2)
    return packed.join(wanted, "slot").repartition(tasks, *both).groupBy(*both)


def similar_pairs(vectors: DataFrame, threshold: float = SIMILAR, block: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(a, b, similarity) of all pairs a < b at or above the threshold, exactly.

    Vectors, all of one length, lie in blocks, see :func:`vector_blocks`, and blocks in tiles; pairs of tiles are compared by tasks
    of their own as matrix products, but for blocks that cannot reach the threshold. So memory is bounded, and a vector goes to the
    tiles around its own: few where vectors lie in clusters, all where they lie nowhere near each other, as random ones do. For
    those see :func:`lsh_pairs`. Null vectors are left out, an empty table gives no pair. For components see :func:`similar_links`.
    """
    met = _tiles_met(vectors, threshold, block, id_col, vec_col)
    kind = "a long, b long, similarity double"
    return vectors.sparkSession.createDataFrame([], kind) if met is None else met.applyInArrow(_pairs_of(threshold), kind)


def similar_links(vectors: DataFrame, threshold: float = SIMILAR, block: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(a, b): links with the components of :func:`similar_pairs`, exactly, but of each pair of tiles a forest, not all pairs.

    Their ends need not be similar themselves, they are joined by pairs that are.
    """
    met = _tiles_met(vectors, threshold, block, id_col, vec_col)
    return vectors.sparkSession.createDataFrame([], "a long, b long") if met is None else met.applyInArrow(_links_of(threshold), "a long, b long")


def lsh_pairs(vectors: DataFrame, threshold: float = SIMILAR, tables: int = 8, length: float = 0.5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """As similar_pairs, by random projections: near pairs are found with high probability only.

    A test holds 0.9 of the pairs at 0.82 or more against it.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    unit = vectors.select(F.col(id_col).alias("id"), _unit(F.col(vec_col)).alias("v")).withColumn("features", array_to_vector("v"))
    lsh = BucketedRandomProjectionLSH(inputCol="features", outputCol="h", bucketLength=length, numHashTables=tables, seed=7).fit(unit)
    near = lsh.approxSimilarityJoin(unit, unit, (2 - 2 * threshold) ** 0.5 + 1e-9, "d").filter("datasetA.id < datasetB.id")
    return near.select(F.col("datasetA.id").alias("a"), F.col("datasetB.id").alias("b"), _dot(F.col("datasetA.v"), F.col("datasetB.v")).alias("similarity")).filter(F.col("similarity") >= threshold)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _unit(v: Column) -> Column:
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(d, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of all vertices; component is the smallest id reachable, see :mod:`recscan.operators.components`."""
    found = components.connected_components(edges).withColumnRenamed("node", "id")
    return vertices.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def canonical_names(labels: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, canonical_task_name): the most frequent name, of equals the first by interval."""
    counted = labels.groupBy(cluster, "normalized_task_name").agg(F.count(F.lit(1)).alias("n"), F.min("interval_id").alias("first"))
    return counted.groupBy(cluster).agg(F.min_by("normalized_task_name", F.struct((-F.col("n")).alias("n"), "first")).alias("canonical_task_name"))


def distinct_objects(labels: DataFrame, by: str) -> DataFrame:
    """(by, primary_objects): the objects of each group in order, each once; they are told apart before they are gathered."""
    return labels.select(by, F.explode("primary_objects").alias("o")).distinct().groupBy(by).agg(F.array_sort(F.collect_list("o")).alias("primary_objects"))


def buckets(labels: DataFrame, assignment: DataFrame | None = None, low_confidence: float = LOW_CONFIDENCE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(buckets, mapping, review) of labels; without an assignment, names are the clusters.

    Buckets are numbered by size, then name, then first interval; labels that are no manipulation
    share one. A single or unsure cluster goes to review. Only cluster rows are ordered as a whole.
    """
    acted = labels.filter("is_manipulation")
    keyed = acted.withColumn("cluster", F.col("normalized_task_name")) if assignment is None else acted.join(assignment.select("interval_id", F.col("component").cast("string").alias("cluster")), "interval_id")
    sized = keyed.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("member_count"), F.array_sort(F.collect_set("normalized_task_name")).alias("source_labels"),
        F.avg(F.coalesce("confidence", F.lit(0.0))).alias("average_confidence"), F.min("interval_id").alias("first"),
    ).join(canonical_names(keyed), "cluster")
    order = ranked(sized.select("cluster", "member_count", "canonical_task_name", "first"), [F.desc("member_count"), F.col("canonical_task_name"), F.col("first")], "rank").select("cluster", "rank")
    number = F.col("rank").cast("string")
    named = sized.join(order, "cluster").join(distinct_objects(keyed, "cluster"), "cluster", "left").withColumns({
        "bucket_id": F.concat(F.lit("bucket_"), F.when(F.col("rank") < 1000, F.lpad(number, 3, "0")).otherwise(number)),
        "primary_objects": F.coalesce("primary_objects", F.array().cast("array<string>")),
    })
    cols = ["bucket_id", "canonical_task_name", "member_count", "source_labels", "average_confidence", "primary_objects"]
    idle = labels.filter(~F.col("is_manipulation"))
    rest = idle.agg(F.count(F.lit(1)).alias("member_count"), F.avg("confidence").alias("average_confidence")).filter("member_count > 0").select(
        F.lit("bucket_non_manipulation").alias("bucket_id"), F.lit("non_manipulation").alias("canonical_task_name"), "member_count",
        F.array(F.lit("idle_or_other")).alias("source_labels"), "average_confidence", F.array().cast("array<string>").alias("primary_objects"),
    )
    mapping = keyed.join(named.select("cluster", "bucket_id"), "cluster").select("interval_id", "bucket_id").unionByName(idle.select("interval_id", F.lit("bucket_non_manipulation").alias("bucket_id")))
    unsure = (F.col("member_count") == 1) | (F.col("average_confidence") < low_confidence)
    review = named.filter(unsure).select(F.col("bucket_id").alias("identifier"), F.lit("cluster").alias("stage"), F.lit("singleton_or_low_confidence_cluster").alias("reason"))
    return named.select(*cols).unionByName(rest.select(*cols)), mapping, review
