"""URL filters: host suffixes and path prefixes, joined on short hash prefixes, confirmed by full digests.

A rule is a host, a path and a verdict. It fits its host and all hosts below it, where the path of the URL
starts with the rule's. Every path that starts with the rule's has a prefix that ends where the rule's last
slash is; so a URL is expanded into its host's suffixes times its path's prefixes up to each slash, which are few, and
rules into the same: host, folder, and the rest behind the last slash. Expressions are joined on the first bytes of
their digest, the full digest confirms, and the rests of a folder are joined the same way, by their lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recscan.llm.shared import BROADCAST_ROWS, materialize, numbered, settled

#: Hex digits of a digest that expressions are joined on; others with the same ones are told apart by the full digest.
SHORT = 8
#: The verdict where no rule fits.
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    """What is between the first :// and the next /, ? or #, A-Z lower-cased; empty for null or without ://."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; empty for null or without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_suffixes(host: Column, most: int) -> Column:
    """The host and the hosts above it, those of up to ``most`` labels; none is empty but the host."""
    labels = F.split(host, r"\.")
    above = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - most + 1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.filter(above, lambda s: (s != "") | (host == ""))


def path_folders(path: Column, most: int) -> Column:
    """Prefixes of the path that end in a slash, and the empty one, those of up to ``most`` slashes; each once."""
    parts = F.split(path, "/")
    folder = lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
    return F.transform(F.sequence(F.lit(0), F.least(F.lit(most), F.size(parts) - 1)), folder)


def folder_of(path: Column) -> Column:
    """The path up to its last slash, that included."""
    return F.regexp_extract(path, r"(?s)^(?:.*/)?", 0)


def _digest(*parts: Column) -> Column:
    """Digest of an expression; the lengths before the parts keep different ones apart."""
    return F.sha2(F.concat(*(x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p))), 256)


def rule_table(rules: DataFrame) -> DataFrame:
    """The rules as digests of (host, folder) and of (host, path), how long they are, and how they rank.

    ``rules`` has host, path and verdict (allow or block). Hosts are lower-cased; a null host or path counts
    as empty, an empty host fits empty hosts only. Of rules with one host and path block wins; rules without a
    verdict are none. Other columns are ignored.
    """
    host = F.translate(F.coalesce("host", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    clean = rules.filter(F.col("verdict").isin("allow", "block")).select(host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    one = clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block is the later word
    folder = folder_of(F.col("path"))
    return one.select(
        F.size(F.split("host", r"\.")).alias("labels"), F.regexp_count(folder, F.lit("/")).alias("slashes"), _digest(F.col("host"), folder).alias("folder"), (F.length("path") - F.length(folder)).alias("rest"), _digest(F.col("host"), F.col("path")).alias("full"),
        F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), F.concat("host", "path").alias("rule"), "verdict").alias("won"),
    )


def _confirmed(expressions: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows of ``expressions`` with what ``known`` has for their digest ``key``: joined on its short prefix, confirmed by all of it.

    ``known`` has one row per digest. Up to BROADCAST_ROWS of them go to every task; beyond, the distinct digests
    of the expressions, which partial aggregates collapse, find the few that are known, so that no hot expression is
    shuffled more than once for each task; then those few are joined with the rows.
    """
    short = F.substring(key, 1, SHORT)
    held = known.withColumnRenamed(key, "_full").withColumn("_short", F.substring("_full", 1, SHORT))
    if known.count() > BROADCAST_ROWS:
        asked = expressions.select(key).distinct().withColumn("_short", short)
        held = materialize(asked.join(held, "_short").filter(F.col(key) == F.col("_full")).drop(key), "known_urls")
    if held.count() <= BROADCAST_ROWS:
        held = F.broadcast(held)
    return expressions.withColumn("_short", short).join(held, "_short").filter(F.col(key) == F.col("_full")).drop("_short", "_full")


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """One row per row of ``pages``: its id, host, path, rule and verdict: the longest rule that fits, and its verdict, else null and allow.

    Of fitting rules that are equally long, the one with the longer host wins. A null URL, or one without ``://``, has
    an empty host and path. Ids (null too), rows and repeats stay as they are; other columns are not read. No page gives no row,
    without rules none fits.
    Suffixes and prefixes longer than any rule's are left out. Matches are put together in the task that made them, so one
    narrow row a URL is shuffled.
    """
    known = materialize(rule_table(rules), "url_rules")
    labels, slashes = known.agg(F.max("labels"), F.max("slashes")).first()
    folders = materialize(known.groupBy("folder").agg(F.collect_set("rest").alias("rests")), "url_folders")  # lengths of paths: no more than the longest
    rows = numbered(settled(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")), "url_pages"), "_row").select(
        "_row", F.col("_all.id").alias("id"), host_of(F.col("_all.url")).alias("host"), path_of(F.col("_all.url")).alias("path")
    )
    suffixes = rows.select("_row", "path", F.explode(host_suffixes(F.col("host"), labels or 0)).alias("hs"))
    asked = suffixes.select("_row", "path", "hs", F.explode(path_folders(F.col("path"), slashes or 0)).alias("pf")).withColumn("folder", _digest(F.col("hs"), F.col("pf")))
    near = _confirmed(asked, folders, "folder").select("_row", "hs", "path", "pf", F.explode("rests").alias("rest"))
    whole = near.withColumn("n", F.length("pf") + F.col("rest")).filter(F.col("n") <= F.length("path"))
    fits = _confirmed(whole.select("_row", _digest(F.col("hs"), F.substring("path", F.lit(1), F.col("n"))).alias("full")), known.select("full", "won"), "full")
    best = fits.groupBy("_row").agg(F.max("won").alias("_won"))
    return rows.join(best, "_row", "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("_won.rule").alias("rule"), F.coalesce("_won.verdict", F.lit(DEFAULT)).alias("verdict")
    )


def rules_from(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """Rules given as (verdict, host, path)."""
    return spark.createDataFrame(rows, "verdict string, host string, path string")
