"""The operators applied to whole tables, with the SQL they must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colscope.llm import (
    alignment, bpe, decontaminate, fixity, language, neardup, preference, prefix_trie, quality, resampling,
    secret_scan, sharding, toxicity,
)
from colscope.llm.common import save
from colscope.llm.ordered import running

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            SQL[name] = sql
        return query

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@register("op8_minhash_neardup")
def op8_minhash_neardup(spark: SparkSession, folder: str) -> DataFrame:
    settings = neardup.Settings(words=3, percent=85)
    return neardup.near_duplicates(table(spark, folder, "documents"), settings)


@register("op6_byte_bpe")
def op6_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(table(spark, folder, "documents"), path, public_tokenizers.PATTERN).selectExpr(
        "doc_id", "CAST(octet_length(ids) / 4 AS LONG) AS n_tokens",
        "sha2(ids, 256) AS ids_sha256", "sha2(decoded, 256) AS decoded_sha256",
    )


@register("op2_certified_rules")
def op2_certified_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = quality.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "failed_rules",
    )


@register("op9_contiguous_shards")
def op9_contiguous_shards(spark: SparkSession, folder: str) -> DataFrame:
    found = sharding.contiguous_shards(table(spark, folder, "documents"), shards=8)
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@register("op10_rank_order_language")
def op10_rank_order_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = language.identify(docs, language.learn(language.training_part(docs)))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


@register("op1_pigeonhole_decontamination")
def op1_pigeonhole_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", (F.size("matches") > 0).alias("contaminated"), F.expr("matches.item_id").alias("item_ids"),
        F.expr("matches.distance").alias("distances"),
    )


#: A page as a WARC record. Page 97k + 5 is damaged in the replica, page 211k + 7 is lost from it.
RECORD = (
    "concat('WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: ', coalesce(url, ''), '\r\nContent-Type: text/html\r\n"
    "Content-Length: ', CAST(octet_length(encode({html}, 'UTF-8')) AS STRING), '\r\n\r\n', {html}, '\r\n\r\n')"
)
PAGES_PER_ARCHIVE = 500


def archived(pages: DataFrame) -> DataFrame:
    """``archive, offset, length, sha256, held_sha256, page_id``: runs of page ids as archives of WARC records.

    ``held_sha256`` is that of the replica's copy. Pages are hashed where they are read; equal records of one id, or
    of none, lie one behind the other.
    """
    html = "coalesce(html, '')"
    damaged = f"IF(page_id % 97 = 5, translate({html}, chr(60), chr(62)), {html})"
    records = pages.selectExpr(
        "page_id", f"CAST(floor(page_id / {PAGES_PER_ARCHIVE}) AS LONG) AS archive",
        f"encode({RECORD.format(html=html)}, 'UTF-8') AS record",
        f"IF(page_id % 97 = 5, encode({RECORD.format(html=damaged)}, 'UTF-8'), NULL) AS damaged",
    )
    hashed = records.selectExpr(
        "page_id", "archive", "CAST(octet_length(record) AS LONG) AS length", "sha2(record, 256) AS sha256", "sha2(damaged, 256) AS damaged",
        "coalesce(CAST(archive AS STRING), 'none') AS shelf", "monotonically_increasing_id() AS tie",
    ).withColumn("held_sha256", F.coalesce("damaged", "sha256")).drop("damaged")
    placed = running(hashed, "shelf", ["page_id", "sha256", "tie"], {"upto": ("sum", "length")})
    return placed.selectExpr("archive", "upto - length AS offset", "length", "sha256", "held_sha256", "page_id")


@register(
    "op3_merkle_fixity",
    "WITH r AS (SELECT page_id, CAST(floor(page_id / 500) AS BIGINT) AS archive, "
    "'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || "
    "'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || "
    "coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record, html FROM pages), "
    'o AS (SELECT *, strlen(record) AS length, coalesce(sum(strlen(record)) OVER (PARTITION BY archive ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset" FROM r) '
    "SELECT CAST(archive AS VARCHAR) AS archive, CAST(\"offset\" AS BIGINT) AS \"offset\", CAST(length AS BIGINT) AS length, "
    "CASE WHEN page_id % 211 = 7 THEN 'missing' WHEN page_id % 97 = 5 AND html LIKE '%<%' THEN 'corrupt' ELSE 'match' END AS status FROM o",
)
def op3_merkle_fixity(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as archives, compared with a replica in which some records are damaged or lost."""
    archives = save(archived(table(spark, folder, "pages")), "archives")
    shelf = F.coalesce(F.concat(F.lit("="), F.col("archive").cast("string")), F.lit("none")).alias("archive")
    replica = archives.filter("coalesce(page_id % 211 <> 7, true)").select(shelf, "offset", "length", F.col("held_sha256").alias("sha256"))
    return fixity.audit_leaves(archives.select(shelf, "offset", "length", "sha256"), replica)


@register("op4_importance_resampling")
def op4_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    found = resampling.sample(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.select("doc_id", F.round("log_weight", 4).alias("log_weight"), "kept")


def _rendered(name: str, where: str) -> str:
    head = "'<|' || coalesce(role, 'unknown') || '|>' || chr(10)"
    body = "replace(coalesce(text, ''), '<|', '<\\|') || '<|end|>'"
    return (
        f"{name} AS (SELECT conv_id, string_agg({head} || {body} || chr(10), '' ORDER BY turn) AS t, "
        f"string_agg(CASE WHEN role = 'assistant' THEN (start + length({head})) || ':' || (start + length({head}) + length({body})) END, ',' ORDER BY turn) AS mask "
        f"FROM (SELECT *, coalesce(sum(length({head} || {body}) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM {where}) GROUP BY conv_id)"
    )


@register(
    "op5_preference_format",
    "WITH last AS (SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id), "
    "answers AS (SELECT conv_id, turn, text FROM last JOIN conversations USING (conv_id, turn)), "
    "other AS (SELECT c.conv_id, c.turn, c.role, CASE WHEN c.turn = m.turn AND o.text IS NOT NULL THEN o.text ELSE c.text END AS text "
    "FROM conversations c LEFT JOIN answers m ON m.conv_id = c.conv_id LEFT JOIN answers o ON o.conv_id = c.conv_id + 1 - 2 * (c.conv_id % 2)), "
    "cut AS (SELECT c.conv_id, count(*) AS turns, min(CASE WHEN c.text <> r.text THEN c.turn END) AS cut_at FROM conversations c JOIN other r USING (conv_id, turn) GROUP BY c.conv_id), "
    + _rendered("p", "(SELECT c.* FROM conversations c JOIN cut USING (conv_id) WHERE cut_at IS NULL OR turn < cut_at)") + ", "
    + _rendered("c", "(SELECT c.* FROM conversations c JOIN cut USING (conv_id) WHERE turn >= cut_at)") + ", "
    + _rendered("r", "(SELECT c.* FROM other c JOIN cut USING (conv_id) WHERE turn >= cut_at)")
    + ", n AS (SELECT cut.conv_id, count(*) AS k FROM cut JOIN conversations c ON c.conv_id = cut.conv_id AND (cut_at IS NULL OR c.turn < cut_at) GROUP BY cut.conv_id) "
    "SELECT cut.conv_id AS pair_id, CAST(coalesce(n.k, 0) AS INTEGER) AS prefix_turns, coalesce(p.t, '') AS prompt, coalesce(c.t, '') AS chosen, coalesce(r.t, '') AS rejected, "
    "coalesce(c.mask, '') AS chosen_mask, coalesce(r.mask, '') AS rejected_mask, c.mask IS NOT NULL AND r.mask IS NOT NULL AS usable "
    "FROM cut LEFT JOIN n USING (conv_id) LEFT JOIN p USING (conv_id) LEFT JOIN c USING (conv_id) LEFT JOIN r USING (conv_id)",
)
def op5_preference_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    chosen, rejected = (
        x.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text") for x in (turns, preference.with_neighbours_answer(turns))
    )
    text = "array_join(transform({0}, x -> concat(x.start, ':', x.end)), ',') AS {0}"
    return preference.format_preferences(chosen, rejected).selectExpr(
        "pair_id", "prefix_turns", "prompt", "chosen", "rejected", text.format("chosen_mask"), text.format("rejected_mask"), "usable"
    )


@register("op7_markov_secrets")
def op7_markov_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = secret_scan.find(docs, secret_scan.train(docs, table(spark, folder, "labels")))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans"
    )


#: CRC-32 of the decimal id: every byte is added with the first of its eight shifts.
CRC32 = (
    "xor(list_reduce(flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0])), "
    "lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1)), 4294967295::BIGINT), 4294967295::BIGINT)"
)


@register(
    "op11_prefix_trie",
    "WITH u AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL), "
    "t AS (SELECT conv_id, {'role': role, 'text': text} AS u, row_number() OVER "
    "(PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS pos FROM u), "
    f"c AS (SELECT conv_id, {CRC32} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)), "
    "r AS (SELECT c.conv_id, 0 AS side, t.pos, t.u FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.pos <= h "
    "UNION ALL SELECT c.conv_id, 1, t.pos, t.u FROM c JOIN t USING (conv_id) WHERE t.pos > h), "
    "s AS (SELECT c.conv_id, coalesce(list(r.u ORDER BY side, pos) FILTER (r.pos IS NOT NULL), []) AS q FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id), "
    "k AS (SELECT conv_id, depth, q[1:depth] AS k FROM (SELECT conv_id, q, unnest(range(0, len(q) + 1)) AS depth FROM s)), "
    "n AS (SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs FROM k GROUP BY k, depth), "
    "p AS (SELECT k[1:depth - 1] AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1), "
    "m AS (SELECT n.*, coalesce(p.n_children, 0) AS n_children, (n_convs - 1) * coalesce(strlen(k[depth].text), 0) AS own FROM n LEFT JOIN p USING (k)), "
    "b AS (SELECT k[1:up] AS k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(own) AS saved "
    "FROM (SELECT k, n_children, own, unnest(range(0, depth + 1)) AS up FROM m) GROUP BY 1), "
    "e AS (SELECT q AS k, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM s GROUP BY q) "
    "SELECT m.conv_id, m.depth, o.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves, "
    "CAST(b.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256 "
    "FROM m JOIN b USING (k) LEFT JOIN e USING (k) LEFT JOIN n o ON m.depth > 0 AND o.k = m.k[1:m.depth - 1]",
)
def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_tree(*prefix_trie.rebuild(table(spark, folder, "conversations")))


@register("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.alignments(table(spark, folder, "documents"), *paths)


@register("op13_toxicity_cnn")
def op13_toxicity_cnn(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = "crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0"
    model = toxicity.fit(docs, table(spark, folder, "labels"), f"NOT ({held_out})")
    found = toxicity.score(docs, model)
    return found.select("doc_id", F.expr(f"coalesce({held_out}, false)").alias("held_out"), "score", "predicted", "lang_guess")
