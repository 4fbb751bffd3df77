"""Exact dedup by content-defined chunk recipes, with Spark expressions only.

Each text, without ASCII white space, is cut where its content says so. A chunk's identifier is a
64-bit hash; over all chunks of the corpus an identifier is verified by a second hash taken from
SHA-256. A document's recipe is the ordered list of its chunk identifiers; documents are equal
when their recipes are. Texts are read once and never shuffled: only recipes move, eight bytes
for each chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recscan.llm.shared import join_groups, materialize, numbered, settled

#: Deleted before texts are compared.
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: A chunk ends at the first of these characters after its least length, or at its greatest length.
CHUNK_ENDS = ".!?;:,0-9。！？，"
CHUNK_MIN, CHUNK_MAX = 512, 4096


def normalized(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), ASCII_SPACE, "")


def chunk_recipe(norm: Column) -> Column:
    """array<struct<id, check>>: the content-defined chunks of a text, as two hashes each."""
    pattern = f"(?s).{{{CHUNK_MIN},{CHUNK_MAX}}}?[{CHUNK_ENDS}]|.{{1,{CHUNK_MAX}}}"
    chunks = F.regexp_extract_all(norm, F.lit(pattern), F.lit(0))
    return F.transform(
        chunks,
        lambda c: F.struct(F.xxhash64(c).alias("id"), F.xxhash64(F.sha2(c, 256)).alias("check")),
    )


def recipes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One narrow row per row of ``docs``: _row, _id, _chars, text_sha256, _recipe (written once).

    _row numbers the rows of the input, so that repeated rows stay apart.
    """
    norm = normalized(F.col(text_col))
    return materialize(
        docs.select(
            F.monotonically_increasing_id().alias("_row"),
            F.col(id_col).alias("_id"),
            F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("_chars"),
            F.sha2(norm, 256).alias("text_sha256"),
            chunk_recipe(norm).alias("_recipe"),
        ),
        "recipes",
    )


def verified_keys(found: DataFrame) -> DataFrame:
    """Adds _key: identifiers alone if each stands for one chunk, else identifiers with checks.

    The chunks of all documents are grouped by identifier; the partial aggregate makes a hot
    chunk one row per task.
    """
    clash = (
        found.select(F.explode("_recipe").alias("c"))
        .groupBy("c.id")
        .agg(F.min("c.check").alias("lo"), F.max("c.check").alias("hi"))
        .filter("lo <> hi")
    )
    key = F.transform("_recipe", lambda c: c["id"])
    if not clash.isEmpty():
        key = F.flatten(F.transform("_recipe", lambda c: F.array(c["id"], c["check"])))
    return found.withColumn("_key", key).drop("_recipe")


def exact_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Groups of equal texts, one row per row of ``docs``.

    Returns _row, ``id_col``, keep_id, group_size, kept, text_sha256. Of each group the row with
    the most code points stays, then the smallest id (null last), then the first row of the
    input: of repeated rows exactly one stays. Null and empty texts are equal to each other. An
    empty table gives an empty result. Other columns of ``docs`` are not read.

    A hot group costs one partial aggregate per task; its rows are not brought together.
    """
    keyed = verified_keys(recipes(docs, text_col, id_col))
    best = F.min(F.struct((-F.col("_chars")).alias("c"), F.col("_id").isNull().alias("n"), "_id", "_row"))
    groups = materialize(keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("group_size"), best.alias("_best")), "groups")
    return join_groups(keyed, groups, ["_key"], "group_size").select(
        "_row",
        F.col("_id").alias(id_col),
        F.col("_best._id").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("_best._row")).alias("kept"),
        "text_sha256",
    )


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, all their columns unchanged; see :func:`exact_groups`."""
    docs = settled(docs, "docs")
    stay = exact_groups(docs, text_col, id_col).filter("kept").select(F.col("_row").alias("_stay_row"))
    all_rows = numbered(docs, "_stay_row")
    return all_rows.join(stay, "_stay_row", "left_semi").select("_all.*")
