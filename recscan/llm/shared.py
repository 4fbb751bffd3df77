"""Tables, the shared scratch folder, and settings the operators of this subpackage rely on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recscan.scratch import drop_path as drop_scratch
from recscan.scratch import last_written, scratch, scratch_path, shared_dir, written

__all__ = ["drop_scratch", "last_written", "scratch", "scratch_path", "shared_dir"]

#: Rows of an Arrow batch; with long texts the default of 10,000 would fill a worker's memory.
ARROW_ROWS = 256
#: Keys that more rows than this share are joined apart from the others.
HOT_ROWS = 1_000
#: Tables of up to so many narrow rows (some 30 MB) are broadcast, larger ones are shuffled.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input table, read through Spark (any file system Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """See :func:`recscan.scratch.written`."""
    return written(df, name)


#: Operators of an optimised plan that read files, or keep of their rows what they keep each time.
_SAME = frozenset(("LogicalRelation", "DataSourceV2ScanRelation", "Project", "Filter", "SubqueryAlias"))
_FILES = frozenset(("HadoopFsRelation", "ParquetScan", "OrcScan", "JsonScan", "CSVScan", "TextScan", "AvroScan"))


def settled(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` such that each reading numbers its rows alike: as it is if it only reads files, else written.

    The optimised plan tells: all its operators read files, select or filter, by expressions that are deterministic.
    """
    todo, same = [docs._jdf.queryExecution().optimizedPlan()], True
    while todo and same:
        plan = todo.pop()
        kind = plan.getClass().getSimpleName()
        same = kind in _SAME and plan.deterministic()
        if kind == "LogicalRelation":
            same = plan.relation().getClass().getSimpleName() in _FILES
        elif kind == "DataSourceV2ScanRelation":
            same = plan.scan().getClass().getSimpleName() in _FILES
        children = plan.children()
        todo += [children.apply(i) for i in range(children.size())]
    return docs if same else materialize(docs, name)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` as two columns: the row's number, called ``name``, and all its columns as _all.

    Numbers are made of partition and place, so ``docs`` must be :func:`settled`.
    """
    return docs.select(F.monotonically_increasing_id().alias(name), F.struct("*").alias("_all"))


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, hot: int | None = None) -> DataFrame:
    """Inner join of ``rows`` with their group, of which there is one per key, whatever its number of rows.

    ``size`` is the column of ``groups`` with that number. Rows of groups above ``hot`` rows stay where
    they are: those groups, one row for each, are broadcast, or if there are over BROADCAST_ROWS of
    them dealt out with their rows to slots of ``hot`` rows. Both inputs should be written tables.
    """
    hot = HOT_ROWS if hot is None else hot
    large = materialize(groups.filter(F.col(size) > hot), "hot_groups")
    n = large.count()
    if not n:
        return rows.join(groups, keys)
    cold = groups.filter(F.col(size) <= hot)
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(large.select(*keys)), keys, "left_anti").join(cold, keys).unionByName(rows.join(F.broadcast(large), keys))
    slots = large.select(*keys, F.ceil(F.col(size) / hot).alias("_slots"))
    dealt = rows.join(slots, keys, "left").withColumn("_slot", F.pmod(F.xxhash64(*rows.columns), F.coalesce("_slots", F.lit(1).cast("long")))).drop("_slots")
    spread = groups.withColumn("_slot", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(1), F.ceil(F.col(size) / hot)).cast("long") - 1)))
    return dealt.join(spread, [*keys, "_slot"]).drop("_slot")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, pull: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
    """Weights of a logistic regression by Newton's method, pulled towards ``prior`` where data are few.

    Row i counts ``n[i]`` times. Each step is halved until the loss falls enough, as classes that
    part well make full steps overshoot.
    """
    n = np.ones(len(y)) if n is None else n

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(n @ (np.logaddexp(0, z) - y * z) + (pull * (w - prior) ** 2).sum() / 2)

    w = prior.astype(float).copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (y - p)) - pull * (w - prior)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(pull), slope)
        before, t = loss(w), 1.0
        while loss(w + t * step) > before - 1e-4 * t * float(slope @ step) and t > 1e-10:
            t /= 2
        w = w + t * step
        if np.abs(t * step).max() < 1e-8:
            break
    return w
