"""Queries of this subpackage: whole tables in, the digest columns of each operator out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recscan.llm import chat_format, decontaminate, exact_dedup, html_extract, language_id, mixing, periodic_runs, pii, prefix_trie, simhash, toxicity, url_filter, warc
from recscan.llm.shared import materialize, scratch_path, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    named = language_id.identify(docs, language_id.train(docs.select("doc_id", "text", "lang")))
    return named.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages as archives, reads them back, and takes everything from the captures."""
    path = scratch_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    captures = warc.assemble(warc.read_warc(spark, path))
    field = lambda name: F.col("metadata.fields")[name]
    stored = F.col("response.type") == "response"
    return captures.select(
        field("pageId").cast("long").alias("page_id"),
        F.when(stored, F.col("response.payload_bytes")).otherwise(field("payloadLength").cast("long")).alias("payload_bytes"),
        F.when(stored, F.col("response.payload_sha1")).otherwise(F.replace("response.payload_digest", F.lit("sha1:"), F.lit(""))).alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        field("refersToPageId").cast("long").alias("refers_to"),
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pii_spans(table(spark, sf_dir, "documents"))
    counts = [pii.count_kind(F.col("pii"), kind).alias(f"n_{kind}") for kind in pii.BASE]
    return found.select("doc_id", *counts, "base_sha256", "spans")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("_row")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_row")


#: A conversation that holds another template's marks and this one's escape character.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"),
    )
    chats = chat_format.format_chats(turns.unionByName(extra))
    read = chats.select(
        "conv_id", F.length("formatted").cast("long").alias("formatted_chars"),
        chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("formatted")).alias("loss"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations are rebuilt first: each starts with some turns of the first one of its hundred."""
    turns = materialize(prefix_trie.turn_rows(table(spark, sf_dir, "conversations")), "turn_rows")
    take = (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int")
    return prefix_trie.prefix_trie(prefix_trie.shared_starts(turns, take, F.col("conv_id") - F.col("conv_id") % 100), turns.select("conv_id").distinct())


#: Rules of the URL filter: verdict, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.rules_from(spark, URL_RULES))


def repeating(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the texts go on, from one of their words on, with what follows it again and again."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    some = docs.select("doc_id", "text", h.alias("h"), words.alias("w")).withColumn("n", F.size("w")).withColumn("g", F.floor(F.col("h") / 10))
    a = (F.col("g") % F.col("n")).cast("int")
    p = (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    laid = some.withColumn("a", F.when(F.col("n") > 0, a)).withColumn("p", p)
    again = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("w", F.col("a") + (i - F.col("a")) % F.col("p"))))
    return laid.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(repeating(table(spark, sf_dir, "documents")))

    def more(x, y):
        return x["length"] * y["period"] - y["length"] * x["period"]

    best = F.reduce(F.slice("runs", 2, F.size("runs")), F.get("runs", F.lit(0)), lambda x, y: F.when(more(y, x) > 0, y).otherwise(x))  # runs go by start, then period
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    lines = F.array_join(F.transform(line, lambda s: F.concat(s, F.lit("\n"))), "")
    return found.withColumn("best", F.when(F.size("runs") > 0, best)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {f.__name__: f for f in (op1_language_id, op2_warc, op3_pii, op4_html, op5_simhash, op6_mixing, op7_toxicity, op8_exact_dedup, op9_decontaminate, op10_chat_format, op11_prefix_trie, op12_url_filter, op13_periodic_runs)}

ORACLE_SQL = {
    "op2_warc": """
        WITH p AS (
            SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
                   coalesce(html, '') AS html
            FROM pages),
        k AS (SELECT html AS h, max(page_id) AS keep FROM p WHERE payload_bytes >= 1000 GROUP BY html)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN keep <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN keep <> page_id THEN keep END AS refers_to
        FROM p LEFT JOIN k ON p.html = k.h""",
    "op8_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents),
        w AS (
            SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
            FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w""",
    "op10_chat_format": r"""
        WITH c AS (
            SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        m AS (
            SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT DISTINCT FROM role AS same,
                   length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS n FROM c)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(n + CASE WHEN same THEN length('<|next|>') ELSE length('<|turn|>' || role || '<|text|>' || '<|end|>') + 1 END) AS BIGINT) AS formatted_chars
        FROM m GROUP BY conv_id""",
    "op11_prefix_trie": r"""
        WITH t AS MATERIALIZED (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
            FROM conversations WHERE conv_id IS NOT NULL),
        c AS MATERIALIZED (
            SELECT conv_id, conv_id - conv_id % 100 AS base,
                   xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
                       lambda r, b: list_reduce(list_prepend(xor(r, b), range(8)), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)), 4294967295) % 6 AS h
            FROM (SELECT DISTINCT conv_id FROM t)),
        r AS MATERIALIZED (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS d, role, text
            FROM (SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
                  UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h)),
        n AS MATERIALIZED (SELECT conv_id, count(d) AS n FROM c LEFT JOIN r USING (conv_id) GROUP BY conv_id),
        p AS MATERIALIZED (
            SELECT conv_id, d, length(text) AS chars, string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY d) AS path
            FROM r
            UNION ALL SELECT conv_id, 0, 0, '' FROM c),
        v AS MATERIALIZED (
            SELECT path, any_value(d) AS d, min(p.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
                   sha256(coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (WHERE n.n = p.d), '')) AS ends_sha256
            FROM p JOIN n USING (conv_id) GROUP BY path),
        k AS MATERIALIZED (SELECT left(path, length(path) - 64) AS path, count(*) AS n_children FROM v WHERE d > 0 GROUP BY 1),
        s AS (
            SELECT left(v.path, 64 * a.a) AS path, sum(CASE WHEN k.path IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum(v.saved) AS saved_tokens
            FROM (SELECT *, unnest(range(d + 1)) AS a FROM v) AS a JOIN v USING (path) LEFT JOIN k USING (path) GROUP BY 1)
        SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n_convs, coalesce(k.n_children, 0) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
               CAST(s.saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
        FROM v JOIN s USING (path) LEFT JOIN k USING (path) LEFT JOIN v AS u ON v.d > 0 AND u.path = left(v.path, length(v.path) - 64)""",
    "op12_url_filter": r"""
        WITH u AS (
            SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1) AS h, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
            FROM pages),
        p AS (SELECT page_id, path, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM u),
        r(verdict, h, p) AS (
            VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/'))
        SELECT page_id, any_value(host) AS host, any_value(p.path) AS path, arg_max(r.h || r.p, length(r.h || r.p)) AS rule,
               coalesce(arg_max(r.verdict, length(r.h || r.p)), 'allow') AS verdict
        FROM (SELECT row_number() OVER () AS i, * FROM p) AS p
        LEFT JOIN r ON (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(p.path, r.p)
        GROUP BY i, page_id""",
}
