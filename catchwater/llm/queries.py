"""The queries of this subpackage: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch between JVM and Python: a few megabytes of texts instead of tens.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for a query or a pipeline stage. These are applications and size their session's Arrow batches; operators never do."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from catchwater.llm import license_scan

    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from catchwater.llm import bpe

    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def held_out() -> Column:
    """A fifth of the ids, which no fit sees."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    from catchwater.llm import token_files
    from catchwater.llm.common import shared_dir

    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.digest(spark, path)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from catchwater.llm import embedding_dedup

    return embedding_dedup.dedup(table(spark, sf_dir, "embeddings"))


def op5_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    from catchwater.llm import media
    from catchwater.llm.common import written

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return media.digest(written(media.store(docs), "media"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from catchwater.llm import substring_dedup

    kept = substring_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from catchwater.llm import packing

    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from catchwater.llm import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return model.score(docs).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from catchwater.llm import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return model.score(docs).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from catchwater.llm import ngram_jaccard

    return ngram_jaccard.join(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from catchwater.llm import conversations

    return conversations.repaired(conversations.damaged(table(spark, sf_dir, "conversations")), F.col("present"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from catchwater.llm import lexical_search

    index = lexical_search.index(table(spark, sf_dir, "documents"))
    found = lexical_search.search(index, table(spark, sf_dir, "benchmark"))
    index.dropped()
    return found


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from catchwater.llm import chat_format
    from catchwater.llm.common import written

    said = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    output = chat_format.formatted(turns.select("conv_id", "turn", "role", chat_format.parts_of(F.col("text")).alias("parts")))
    return chat_format.digest(written(output, "chats"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_token_files": op3_token_files,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_lossless_webp": op5_lossless_webp,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_toxicity": op9_toxicity,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_lexical_search": op12_lexical_search,
    "op13_chat_formatting": op13_chat_formatting,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op12_lexical_search": r"""
        WITH words AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
        size AS (SELECT count(*) AS total_docs, sum(len(ws))::BIGINT AS total FROM words WHERE len(ws) > 0),
        doc_terms AS (SELECT r, doc_id, len(ws) AS n, unnest(ws) AS term FROM words),
        posts AS (SELECT r, doc_id, n, term, count(*) AS tf FROM doc_terms GROUP BY ALL),
        dfs AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
        asked AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        scored AS (
            SELECT item_id, r, doc_id, sum(floor(1000 * ln((2 * total_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT
                   * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * total_docs) // total))))::BIGINT AS score
            FROM asked JOIN dfs USING (term) JOIN posts USING (term) CROSS JOIN size GROUP BY item_id, r, doc_id)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
        FROM scored WHERE score > 0 QUALIFY rank <= 50""",
    "op13_chat_formatting": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
        sized AS (
            SELECT *, len(role) + len(regexp_extract_all(role, '\\|<(?:turn>|body>|/turn>|image>|audio>|document>)')) + len(text)
                   + len(regexp_extract_all(text, '\\|<(?:turn>|body>|/turn>|image>|audio>|document>)')) + 19 AS chars FROM turns)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(chars)::BIGINT AS formatted_chars
        FROM sized GROUP BY conv_id""",
}
