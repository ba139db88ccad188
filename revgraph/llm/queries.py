"""The operators' queries: op1 to op10 with production parameters over whole tables, and their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from revgraph.llm.common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revgraph.llm.exact_dedup import duplicates

    return duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revgraph.llm.suffix_dedup import removals

    return removals(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revgraph.llm.embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revgraph.llm.warc import archive

    return archive(table(spark, sf_dir, "pages"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revgraph.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revgraph.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revgraph.llm.toxicity import scored

    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revgraph.llm.bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revgraph.llm.sharding import shard_by_bytes

    return shard_by_bytes(table(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revgraph.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def queries() -> dict:
    return {f.__name__: f for f in (op1_exact_dedup, op2_suffix_dedup, op3_embedding_dedup, op4_warc, op5_ngram_jaccard, op6_packing, op7_toxicity, op8_bpe, op9_sharding, op10_html)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": f"""
            WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
            FROM d WINDOW w AS (PARTITION BY text_sha256)""",
        "op4_warc": """
            WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
            f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
            SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
              CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to FROM f""",
    }
