"""The operators applied to the test tables, one query each, with SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import (
    alignment, chat, decontaminate, exact_dedup, line_rules, packing, pii, runs, simhash_dedup,
    substring_dedup, token_counts, toxicity, warc,
)

KEY = "tidepanel"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_classes(table(spark, sf_dir, "documents"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_classes(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    new = table(spark, sf_dir, "documents").select("doc_id", pii.replaced(text, KEY).alias("r"))
    return new.select("doc_id", "r.text", F.col("r.n").alias("n_replaced"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return chat.digests(chat.format_chats(turns.unionByName(probe)))


def op11_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_rules.clean_lines(table(spark, sf_dir, "documents"), keep_text=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.align_documents(table(spark, sf_dir, "documents"), a, b)[0]


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which a tenth of the documents, chosen by the hash of their id, end in repeats of some of their words."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.when(h % 10 == 0, line_rules.words_of(text)).alias("w"), F.floor(h / 10).alias("g"))
    n, w, g = F.size("w").cast("bigint"), F.col("w"), F.col("g")
    rows = rows.withColumn("a", F.when(n > 0, g % n)).withColumn("p", F.lit(1) + F.floor((n - F.col("a")) / (g % 8 + 3)))
    a, p = F.col("a").cast("int"), F.col("p").cast("int")
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), times)), F.lit(1), n.cast("int") - a)
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.concat(F.slice(w, F.lit(1), a), tail), " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.collapse_runs(with_repeats(table(spark, sf_dir, "documents")), keep_text=False)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_packing, op3_exact_dedup, op4_simhash_dedup, op5_warc, op6_token_counts, op7_pii, op8_toxicity,
        op9_substring_dedup, op10_chat_format, op11_line_rules, op12_token_alignment,
        op13_periodic_runs,
    )
}

SQL = {
    "op3_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t
    """,
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
        g AS (SELECT t, max(page_id) AS first FROM p GROUP BY t),
        n AS (
            SELECT page_id, first, strlen(p.t) AS size,
                list_transform(range(42), lambda i: CASE WHEN i < 40 THEN instr('0123456789abcdef', substr(sha1(p.t), i + 1, 1)) - 1 ELSE 0 END) AS x
            FROM p JOIN g ON p.t = g.t
        )
        SELECT page_id, size AS payload_bytes,
            array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                (((x[(5 * i) // 4 + 1] * 256 + x[(5 * i) // 4 + 2] * 16 + x[(5 * i) // 4 + 3]) >> (7 - (5 * i) % 4)) & 31)::INT + 1, 1)), '') AS payload_digest,
            CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first THEN first END AS refers_to
        FROM n
    """,
    "op9_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, len(w) AS n, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
        s AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 12], ' ')) AS h FROM p),
        f AS (SELECT h, min(doc_id) AS first FROM s GROUP BY h HAVING min(doc_id) <> max(doc_id)),
        c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM s JOIN f USING (h) WHERE first < doc_id),
        r AS (SELECT doc_id, count(*) AS n_removed, list(k) AS gone FROM c GROUP BY doc_id)
        SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed,
            sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w
                ELSE list_transform(list_filter(range(1, len(w) + 1), lambda k: NOT list_contains(gone, k)), lambda k: w[k]) END, ' '), '')) AS kept_sha256
        FROM d LEFT JOIN r ON d.doc_id = r.doc_id
    """,
    "op10_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        ),
        b AS (
            SELECT *, lag(role) OVER w IS DISTINCT FROM role AS opens,
                replace(replace(text, '<', '<~'), '[', '[~') AS e, replace(replace(replace(role, '<', '<~'), '[', '[~'), chr(10), '<n') AS re
            FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
            sum(length(e) + CASE WHEN opens THEN 9 + length(re) + 1 + 8 ELSE 7 END)::BIGINT AS formatted_chars
        FROM b GROUP BY conv_id
    """,
    "op11_line_rules": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (
            SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS times
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
        ),
        r AS (
            SELECT doc_id, sum(least(3, coalesce(i - before, 3))) AS n_repeat_words
            FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM p WHERE times > 1) GROUP BY doc_id
        ),
        l AS (
            SELECT doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
            FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
        ),
        j AS (
            SELECT doc_id, line,
                instr('{line_rules.TERMINALS.replace("'", "''")}', right(regexp_replace(line, '[\x20\x09-\x0D]+$', ''), 1)) = 0
                OR len(regexp_extract_all(line, '{line_rules.SYMBOLS}')) * 5 > n
                OR len(regexp_extract_all(line, '{line_rules.SHOUTS}')) * 3 > n * 2 + 4
                OR len(regexp_extract_all(line, '{line_rules.SEPARATORS}')) * 4 > n
                OR (n <= {line_rules.NOTICE_WORDS} AND (regexp_matches(line, '{line_rules.NAVIGATION}') OR regexp_matches(line, '{line_rules.BOILERPLATE}'))) AS fails
            FROM l
        ),
        k AS (
            SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines,
                coalesce(sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) FILTER (WHERE fails), 0) AS lost
            FROM j GROUP BY doc_id
        ),
        a AS (
            SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '{line_rules.SYMBOLS}')) AS n_symbols,
                coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost
            FROM d LEFT JOIN r ON d.doc_id = r.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
            n_words < {line_rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
            NOT (n_words < {line_rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND lost <= {line_rules.MAX_LOST} * word_chars AS kept
        FROM a
    """,
}
