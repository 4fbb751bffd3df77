"""Benchmark decontamination by SimHash of item-sized windows, with Spark expressions only.

A window of a document has as many words as a benchmark item. Its fingerprint is looked up in a
multi-index: fingerprints within RADIUS bits agree, in some block, up to RADIUS // BLOCKS bits,
and the index holds every such value of every block of an item. What is found within the radius
is verified by the exact similarity of the two multisets of k-word shingles.

Windows that could reach the similarity hold one of an item's anchors: so few of its shingles,
those that are rarest in the corpus, that a window without any of them misses too many. Other
windows are not built; none that matters is among them. Windows of long items start at every
GRID-th part of their length, so that their number does not grow with it; what lies between is
looked at wherever it could decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recscan.llm.shared import BROADCAST_ROWS, materialize, numbered, settled

WORDS, SIMILARITY = 5, 0.8
#: A pair at the least similarity differs in 9.7 of 64 bits on average.
RADIUS, BLOCKS = 15, 4
_WIDTH = 64 // BLOCKS
#: An item has at most twice so many windows in each stretch of its length; those below have one at every place.
GRID = 64
_SPACE = r"[\x20\x09-\x0D]+"


def word_hashes(text: Column) -> Column:
    """array<long>: hashes of the words, A-Z lower-cased, parted by ASCII white space; null: none."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    trimmed = F.btrim(F.translate(F.coalesce(text, F.lit("")), upper, lower), F.lit(" \t\n\x0b\x0c\r"))
    none = F.array().cast("array<bigint>")
    return F.when(trimmed == "", none).otherwise(F.transform(F.split(trimmed, _SPACE), lambda w: F.xxhash64(w)))


def shingles(words: Column, k: int) -> Column:
    """array<long>: hashes of the k-word shingles in order, repeats included; none below k words."""
    none = F.array().cast("array<bigint>")
    at = F.sequence(F.lit(0), F.size(words) - k)
    return F.when(F.size(words) < k, none).otherwise(F.transform(at, lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k)))))


def simhash(hashes: Column) -> Column:
    """The 64-bit SimHash of an array of hashes, of any length: a bit is 1 if over half have it.

    Counters of bits that lie ``width`` apart add up in one long; short arrays need only 16 bits each.
    """

    def counted(width: int) -> Column:
        lanes, first = 64 // width, sum(1 << width * k for k in range(64 // width))
        sums = F.transform(
            F.sequence(F.lit(0), F.lit(width - 1)),
            lambda j: F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + F.call_function("shiftrightunsigned", h, j).bitwiseAND(F.lit(first))),
        )

        def bits(acc: Column, lane: Column, j: Column) -> Column:
            for k in range(lanes):
                count = F.shiftrightunsigned(lane, width * k).bitwiseAND(F.lit((1 << width) - 1))
                one = F.call_function("shiftleft", F.lit(1).cast("long"), j + width * k)
                acc = acc.bitwiseOR(F.when(2 * count > F.size(hashes), one).otherwise(F.lit(0).cast("long")))
            return acc

        at = F.arrays_zip(sums.alias("lane"), F.sequence(F.lit(0), F.lit(width - 1)).alias("j"))
        return F.aggregate(at, F.lit(0).cast("long"), lambda acc, x: bits(acc, x["lane"], x["j"]))

    # the highest counter shares its long with the sign
    return F.when(F.size(hashes) < 1 << 15, counted(16)).otherwise(counted(32))


def blocks(fp: Column) -> Column:
    """array<struct<block, value>>: the blocks of a fingerprint."""
    mask = F.lit((1 << _WIDTH) - 1)
    return F.array(*(F.struct(F.lit(b).alias("block"), F.shiftrightunsigned(fp, _WIDTH * b).bitwiseAND(mask).alias("value")) for b in range(BLOCKS)))


def near_values(radius: int) -> list[int]:
    """All block masks of at most radius // BLOCKS bits."""
    return [m for m in range(1 << _WIDTH) if m.bit_count() <= radius // BLOCKS]


def shared_count(a: Column, b: Column) -> Column:
    """How many elements two arrays share as multisets, by one walk along both in order."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("n"))

    def walk(x: Column, y: Column) -> Column:
        def step(at: Column, _: Column) -> Column:
            u, v = F.get(x, at["i"]), F.get(y, at["j"])
            left, right = (u <= v) | v.isNull(), (v <= u) | u.isNull()
            go = lambda name, when: (at[name] + F.when(when, 1).otherwise(0)).alias(name)
            return F.struct(go("i", left), go("j", right), go("n", u == v))

        return F.aggregate(F.sequence(F.lit(1), F.size(x) + F.size(y)), start, step, lambda at: at["n"])

    # bound by the lambda, so that each array is sorted once
    pair = F.array(F.struct(F.sort_array(a).alias("x"), F.sort_array(b).alias("y")))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.get(F.transform(pair, lambda p: walk(p["x"], p["y"])), F.lit(0))).otherwise(0)


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays as multisets."""
    return _ratio(shared_count(a, b), F.size(a) + F.size(b))


def _ratio(both: Column, all_: Column) -> Column:
    return both / (all_ - both)


def least_shared(n: Column, similar: float) -> Column:
    """How many shingles a window of n must share with an item of n to reach the similarity."""
    return F.ceil(n * (2 * similar / (1 + similar)) - 1e-9)


def _matches(docs: DataFrame, items: DataFrame, k: int, similar: float, radius: int) -> DataFrame:
    """(_row, item_id, similarity) of windows that match items of shingle size ``k``.

    ``docs``: _row, text; ``items``: item_id, w (word hashes).
    """
    items = items.select(F.monotonically_increasing_id().alias("_item"), "item_id", shingles(F.col("w"), k).alias("item")).withColumn("n", F.size("item"))
    items = materialize(items.withColumn("item_fp", simhash(F.col("item"))), "items")

    hashed = docs.select("_row", word_hashes(F.col("text")).alias("w")).select("_row", shingles(F.col("w"), k).alias("sh"))
    # outer: else Spark filters on the array's size first, and works the array out once more for it
    places = hashed.select("_row", F.size("sh").alias("all"), F.posexplode_outer("sh").alias("p", "h"))
    known = materialize(items.select(F.explode("item").alias("h")).distinct(), "known")
    hits = materialize(places.join(known, "h").select("_row", "all", "p", "h"), "hits")

    # the rarest shingles of an item; a doc shorter than the item has to share as much of it
    spare = F.col("n") - F.ceil(F.col("n") * similar - 1e-9) + 1
    lone = F.col("n") - least_shared(F.col("n"), similar) + 1
    counts = hits.groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    each = items.select("_item", "n", F.greatest(lone, spare).alias("few"), F.posexplode("item").alias("j", "h")).join(counts, "h", "left")
    rank = F.row_number().over(Window.partitionBy("_item").orderBy(F.coalesce("c", F.lit(0)), "h", "j"))
    anchors = materialize(each.withColumn("r", rank).filter("r <= few and c > 0").select("n", "h").distinct(), "anchors")

    step = F.greatest(F.lit(1), F.floor(F.col("n") / GRID)).cast("int")
    last = F.greatest(F.lit(0), F.col("all") - F.col("n"))
    first, final = F.greatest(F.lit(0), F.col("p") - F.col("n") + 1), F.least("p", last)
    grid = F.explode(F.sequence(F.floor(first / step).cast("int"), F.ceil(final / step).cast("int"))).alias("g")
    near = hits.join(anchors, "h").select("_row", "n", "all", grid).distinct()
    spans = materialize(near.select("_row", "n", "all", F.least(F.col("g") * step, last).alias("s")).distinct(), "spans")

    # documents with spans are hashed once more; all others stay unread
    rows = materialize(spans.select("_row").distinct(), "rows")
    few = rows.count() <= BROADCAST_ROWS
    again = docs.join(F.broadcast(rows) if few else rows, "_row", "left_semi").select("_row", word_hashes(F.col("text")).alias("w"))
    held = materialize(again.select("_row", shingles(F.col("w"), k).alias("sh")), "held")
    window = F.slice("sh", F.col("s") + 1, F.col("n")).alias("window")
    windows = spans.join(held, "_row").select("_row", "n", "all", "s", window).select("_row", "n", "all", "s", simhash(F.col("window")).alias("fp"))

    masks = F.explode(F.lit(near_values(radius)).cast("array<bigint>")).alias("mask")
    index = items.select("_item", "n", "item_fp", F.explode(blocks(F.col("item_fp"))).alias("b")).select("*", masks)
    # written, so that Spark knows its size when it plans the join
    index = materialize(index.select("_item", "n", "item_fp", "b.block", F.col("b.value").bitwiseXOR(F.col("mask")).alias("value")), "index")
    probes = windows.select("*", F.explode(blocks(F.col("fp"))).alias("b")).select("_row", "n", "all", "s", "fp", "b.block", "b.value")
    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    near = probes.join(index, ["n", "block", "value"]).filter(F.bit_count(apart) <= radius)
    # a pair is found once for each block that agrees: the lowest such block is kept
    agrees = [F.bit_count(F.shiftrightunsigned(apart, _WIDTH * b).bitwiseAND(F.lit((1 << _WIDTH) - 1))) <= radius // BLOCKS for b in range(BLOCKS)]
    once = near.filter(F.col("block") == F.coalesce(*(F.when(x, b) for b, x in enumerate(agrees))))
    pairs = materialize(once.select("_row", "n", "all", "s", "_item"), "pairs")
    texts = items.select("_item", "item_id", "item")
    judged = pairs.join(held, "_row").select("_row", "n", "all", "s", "_item", window).join(texts, "_item")
    judged = judged.select("_row", "item_id", "_item", "n", "all", "s", F.size("window").alias("m"), shared_count(F.col("window"), F.col("item")).alias("both"))
    judged = materialize(judged.withColumn("similarity", _ratio(F.col("both"), F.col("m") + F.col("n"))), "judged")
    # a window between two of the grid shares at most step - 1 more: where that could decide, all are compared
    could = (F.col("similarity") < similar) & (_ratio(F.least(F.col("both") + step - 1, "m"), F.col("m") + F.col("n")) >= similar)
    sure = judged.filter(F.col("similarity") >= similar).select("_row", "item_id", "_item", "similarity")
    between = F.explode(F.sequence(F.greatest(F.lit(0), F.col("s") - step + 1), F.least(F.col("s") + step - 1, last))).alias("s")
    open_ = judged.filter(could & (step > 1)).join(sure, ["_row", "_item"], "left_anti").select("_row", "_item", "n", between).distinct()
    more = open_.join(held, "_row").select("_row", "_item", window).join(texts, "_item").select("_row", "item_id", similarity(F.col("window"), F.col("item")).alias("similarity"))
    return sure.drop("_item").unionByName(more.filter(F.col("similarity") >= similar))


def contamination(
    docs: DataFrame, benchmark: DataFrame, words: int = WORDS, similar: float = SIMILARITY, radius: int = RADIUS, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """One row per row of ``docs``: _row, doc_id, contaminated, n_items, item_id, similarity.

    A document is contaminated if a window of it, as long as an item (or the whole document if
    that is shorter), has a fingerprint within ``radius`` bits of the item's and a similarity of
    at least ``similar``. For items of 128 shingles or more similarity is that of the best window of
    the grid, or of a place between where only that reaches ``similar``. item_id is the most similar item's, then the smallest; null if none.
    Items below ``words`` words are one shingle and match the same sequence of words. Null and
    empty texts and items match nothing; items with a null id count as one item. Repeated rows
    are judged each for itself; other columns are not read, and an empty benchmark finds nothing.

    Texts stay where they are: only hashes that are an anchor of some item leave the scan.
    """
    docs = settled(docs, "docs")
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    items = benchmark.select("item_id", word_hashes(F.col("text")).alias("w")).filter(F.size("w") > 0).dropDuplicates()
    size = F.least(F.size("w"), F.lit(words))
    found = None
    # at most ``words`` values, one pass each; ordinarily one
    for k in sorted(r[0] for r in items.select(size).distinct().collect()):
        part = _matches(rows.select("_row", "text"), items.filter(size == k), k, similar, radius)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select(
            "_row", F.col("_id").alias(id_col), F.lit(False).alias("contaminated"), F.lit(0).cast("long").alias("n_items"),
            F.lit(None).cast(benchmark.schema["item_id"].dataType).alias("item_id"), F.lit(None).cast("double").alias("similarity"),
        )
    pairs = found.groupBy("_row", "item_id").agg(F.max("similarity").alias("similarity"))
    best = F.min(F.struct((-F.col("similarity")).alias("s"), F.col("item_id").alias("i"))).alias("best")
    verdict = materialize(pairs.groupBy("_row").agg(F.count(F.lit(1)).alias("n_items"), best), "leaks")
    return rows.drop("text").join(verdict, "_row", "left").select(
        "_row", F.col("_id").alias(id_col), F.col("best").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.col("best.i").alias("item_id"), (-F.col("best.s")).alias("similarity"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns unchanged; see :func:`contamination`."""
    docs = settled(docs, "docs")
    bad = contamination(docs, benchmark).filter("contaminated").select(F.col("_row").alias("_bad_row"))
    all_rows = numbered(docs, "_bad_row")
    return all_rows.join(bad, "_bad_row", "left_anti").select("_all.*")
