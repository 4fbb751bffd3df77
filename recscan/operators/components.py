"""Connected components by contraction: the graph shrinks round by round."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recscan.scratch import drop, written

#: Links that one task joins up at once; what is left of a larger graph gets there by contraction.
LOCAL_LINKS = 100_000


def _first(c: Column) -> Column:
    """How nodes are ranked: by a hash, so that chains of neighbours in rank are short; then by themselves."""
    return F.struct(F.xxhash64(c).alias("h"), c.alias("node"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all nodes of some links, by union and find."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    links = pa.Table.from_batches(held)
    ends = pa.concat_arrays([c for name in ("x", "y") for c in links[name].chunks]).dictionary_encode()
    code = ends.indices.to_numpy()
    up = np.arange(len(ends.dictionary)).tolist()

    def find(a: int) -> int:
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    n = links.num_rows
    for a, b in zip(code[:n].tolist(), code[n:].tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    roots = pa.array([find(a) for a in range(len(up))], pa.int64())
    yield pa.RecordBatch.from_arrays([ends.dictionary, ends.dictionary.take(roots)], ["node", "root"])


def connected_components(links: DataFrame, a: str = "a", b: str = "b", local_links: int | None = None) -> DataFrame:
    """(node, component) of each node in a link; component is the smallest node reachable.

    Each round every node joins the best ranked one of itself and its neighbours, and links are drawn between those it
    and its neighbour joined; loops and repeats go, so that nodes and links fall by a share each round, in stars and chains
    alike. Once ``local_links`` are left one task joins them up. What each round joined is written, and
    looked up from the last round to the first, so that all lookups together are a few times the nodes. Nodes
    with very many links cost a partial minimum in each task, and their links move in a join that Spark splits.
    Links with a null end are ignored, loops and repeats do no harm, no link gives no row.
    """
    local_links = LOCAL_LINKS if local_links is None else local_links
    ends = links.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null and x <> y")
    left = written(ends.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "links")
    kind, joined = left.schema["x"].dataType, []
    while left.count() > local_links:
        both = left.unionByName(left.select(F.col("y").alias("x"), F.col("x").alias("y")))
        best = both.groupBy(F.col("x").alias("node")).agg(F.min(_first(F.col("y"))).alias("m"))
        step = written(best.select("node", F.least("m", _first(F.col("node")))["node"].alias("root")), "joined")
        at = lambda end: step.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
        moved = left.join(at("x"), "x").join(at("y"), "y").filter("x_root <> y_root")
        fewer = written(moved.select(F.least("x_root", "y_root").alias("x"), F.greatest("x_root", "y_root").alias("y")).distinct(), "links")
        drop(left)
        left = fewer
        joined.append(step)
    roots = left.coalesce(1).mapInArrow(_joined, f"node {kind.simpleString()}, root {kind.simpleString()}")
    for step in reversed(joined):
        # a root of this round that no later link held stays the root
        roots = written(step.join(roots.select(F.col("node").alias("root"), F.col("root").alias("_up")), "root", "left").select("node", F.coalesce("_up", "root").alias("root")), "roots")
    roots = roots if joined else written(roots, "roots")
    smallest = roots.groupBy("root").agg(F.min("node").alias("component"))
    return roots.join(smallest, "root").select("node", "component")
