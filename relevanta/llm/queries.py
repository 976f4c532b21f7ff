"""The numbered queries and, where SQL can say it, the same result in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from relevanta.llm import alignment, chat, langid, mixing, near_dup, packing, quality, scoring, token_files, trie, vectors, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scoring_report(_table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_report(_table(spark, sf_dir, "conversations"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(_table(spark, sf_dir, "documents"))


def op4_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_report(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(_table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_report(_table(spark, sf_dir, "documents"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "embeddings")
    return vectors.nearest_neighbours(table.filter("vec_id % 100 = 0"), table)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(_table(spark, sf_dir, "pages"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_report(_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie_report(_table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (op1_lm_scoring, op2_chat_formatting, op3_packing, op4_embedding_near_dup, op5_mixing, op6_language_id, op7_token_files, op8_nearest_neighbours, op9_quality, op10_near_duplicates, op11_capture_index, op12_token_alignment, op13_prefix_trie)
}

_CONTROLS = r"(\\*)(<\|im_start\|>|<\|im_sep\|>|<\|im_end\|>|<\|endoftext\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>)"


def _escaped(column: str) -> str:
    return rf"regexp_replace(regexp_replace({column}, '{_CONTROLS}', '\1\1\\\2', 'g'), '(\\+)$', '\1\1')"


#: crc32 of the text of an integer, bit by bit.
_CRC32 = "xor(4294967295, list_reduce(list_transform(range(1, length({c}) + 1), lambda i: ascii({c}[i])::BIGINT), lambda s, b: list_reduce(range(0, 8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(s, b)), 4294967295::BIGINT))"

ORACLES = {
    "op2_chat_formatting": f"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
            CAST(sum(32 + length({_escaped("role")}) + length({_escaped("text")})) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id""",
    "op11_capture_index": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
        x AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first_id FROM p)
        SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first_id <> page_id THEN first_id END AS refers_to FROM x""",
    "op13_prefix_trie": f"""
        WITH t AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
            FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM t), h AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC32.format(c="s")} % 9 AS h FROM c),
        r AS (SELECT h.conv_id, n, role, text FROM h JOIN t ON t.conv_id = h.base AND n <= h.h UNION ALL SELECT h.conv_id, n + 1000000, role, text FROM h JOIN t ON t.conv_id = h.conv_id AND n > h.h),
        p AS (SELECT conv_id, text, row_number() OVER w AS d, string_agg(sha256(length(role) || ':' || role || text), '') OVER w AS k FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY n)),
        m AS (SELECT conv_id, 0 AS d, '' AS k, '' AS text FROM h UNION ALL SELECT conv_id, d, k, text FROM p),
        whole AS (SELECT conv_id, max(d) AS d, max_by(k, d) AS k FROM m GROUP BY 1),
        ends AS (SELECT k, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS e FROM whole GROUP BY 1),
        node AS (SELECT k, min(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(octet_length(encode(text))) AS b FROM m GROUP BY 1),
        kids AS (SELECT k[1:64 * (depth - 1)] AS k, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
        one AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids USING (k)),
        sub AS (SELECT k[1:64 * a] AS k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * b) AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM one) GROUP BY 1)
        SELECT one.conv_id, one.depth, up.conv_id AS parent_conv_id, one.n_convs, one.n_children, sub.n_leaves::BIGINT AS n_leaves, sub.saved::BIGINT AS saved_tokens, coalesce(ends.e, sha256('')) AS ends_sha256
        FROM one JOIN sub USING (k) LEFT JOIN ends USING (k) LEFT JOIN one up ON one.depth > 0 AND up.k = one.k[1:64 * (one.depth - 1)]""",
}
