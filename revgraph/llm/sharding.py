"""Sharding: contiguous shards of near-equal bytes, cut from global prefix sums of sizes.

Rows are ordered by (digest of the text, doc_id), so equal texts lie side by side; per-partition totals give every row
its global byte offset, and the offset alone decides the shard. A group of equal texts of at most `whole_share` of a
shard moves as one; larger groups are cut like any other run of rows, which keeps sizes equal however hot a text is.

Null texts count as empty (16 bytes of overhead remain); null doc_ids sort first; repeated rows are rows of their own;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revgraph.llm.common import cut, ranked, text_column

OVERHEAD = 16


def shard_by_bytes(docs: DataFrame, n_shards: int = 40, whole_share: float = 0.01) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column()).select(
        "doc_id", F.unhex(F.md5("text")).alias("digest"), (F.octet_length("text") + OVERHEAD).cast("long").alias("size"), F.crc32("text").alias("text_crc32")
    )
    rows, n, total = ranked(slim, ["digest", "doc_id"], "size")
    small = max(1, int(total / n_shards * whole_share))
    groups = rows.groupBy("digest").agg(F.min("start").alias("group_start"), F.sum("size").alias("bytes"), F.count("*").alias("n")).where(f"n > 1 and bytes <= {small}")
    groups = cut(groups.select("digest", "group_start"))  # cut, so that a hot digest's side of the join can be split
    placed = rows.join(groups, "digest", "left").withColumn("at", F.coalesce("group_start", "start"))
    # whole numbers in decimals: no rounding at 100 TB
    placed = placed.withColumn("shard", F.least(F.lit(n_shards - 1), F.floor(F.col("at").cast("decimal(30,0)") * n_shards / F.lit(max(1, total))).cast("int")))
    first = placed.groupBy("shard").agg(F.min("row_index").alias("first_row"))  # n_shards rows
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row_index") - F.col("first_row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
