"""Exact dedup by counting quotient filters.

Every partition builds a counting quotient filter of its 64-bit fingerprints: the high bits (quotient) name a block,
the remainders of a block are kept sorted beside their counts. Filters of one block merge without loss by merging
their sorted remainders and adding counts. Only fingerprints that the merged filters count more than once go on to
byte verification, where rows are grouped by the bytes themselves; a fingerprint shared by different texts is thereby
told apart. Rows with a fingerprint counted once are done after the filter.

Texts are equal when identical after lower-casing A-Z. Null texts count as empty; null doc_ids lose to any other;
rows repeated in full (same doc_id, same text) are all marked kept by `duplicates`, and `keep_one` returns one of them;
an empty table gives no rows; extra columns are ignored by `duplicates` and returned by `keep_one`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revgraph.llm.common import arrow_schema, cut, free_name, map_tables, partitions, text_buffer, text_column

#: Fingerprints up to which those seen more than once are broadcast (8 bytes each); beyond, they join by a shuffle.
BROADCAST_FINGERPRINTS = 1_000_000


def build_filter(fingerprints: np.ndarray, block_bits: int):
    """(block, sorted remainders, counts) of the filter's non-empty blocks."""
    if not len(fingerprints):
        return
    values, counts = np.unique(fingerprints.view(np.uint64), return_counts=True)
    shift = np.uint64(64 - block_bits)
    blocks = (values >> shift).astype(np.int64) if block_bits else np.zeros(len(values), np.int64)
    remainders = values & np.uint64((1 << (64 - block_bits)) - 1)
    edges = np.flatnonzero(np.diff(blocks, prepend=-1))
    for a, b in zip(edges, [*edges[1:], len(blocks)], strict=True):
        yield int(blocks[a]), remainders[a:b], counts[a:b].astype(np.int64)


def merge_filters(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Merge the sorted remainders of one block, adding counts: the filter of all rows, without loss."""
    remainders, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(remainders, kind="stable")  # a merge sort, linear on sorted runs
    remainders, counts = remainders[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], remainders[1:] != remainders[:-1]])) if len(remainders) else np.zeros(0, np.int64)
    return remainders[first], np.add.reduceat(counts, first) if len(first) else counts


def repeated_fingerprints(slim: DataFrame, fingerprint_bits: int) -> DataFrame:
    """fp of the fingerprints that more than one row has, by the merged filters."""
    block_bits = min(fingerprint_bits, max(4, (partitions(slim.sparkSession) * 4 - 1).bit_length()))
    schema = arrow_schema("block long, remainders binary, counts binary")

    def build(batches):
        held = [np.asarray(b.column(0)) for b in batches]
        for block, r, c in build_filter(np.concatenate(held) if held else np.zeros(0, np.int64), block_bits):
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([r.tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary())], schema=schema)

    def merge(t: pa.Table) -> pa.Table:
        parts = [(np.frombuffer(r.as_py(), np.uint64), np.frombuffer(c.as_py(), np.int64)) for r, c in zip(t.column("remainders"), t.column("counts"), strict=True)]
        remainders, counts = merge_filters(parts)
        high = np.uint64(t.column("block")[0].as_py() << (64 - block_bits))
        return pa.table({"fp": (remainders[counts > 1] | high).view(np.int64)}, pa.schema([("fp", pa.int64())]))

    return slim.select("fp").mapInArrow(build, "block long, remainders binary, counts binary").groupBy("block").applyInArrow(merge, "fp long")


def _digests(t: pa.Table):
    """doc_id, fp and raw as they are, and the SHA-256 of each text with A-Z lower-cased."""
    data, offsets = text_buffer(t.column("text"))
    low = memoryview(data.tobytes().lower())
    return [t.column("doc_id").combine_chunks(), t.column("fp").combine_chunks(), t.column("raw").combine_chunks(), [hashlib.sha256(low[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]]


def _normal_bytes(t: pa.Table):
    data, offsets = text_buffer(t.column("text"))
    low = data.tobytes().lower()
    return [t.column("doc_id").combine_chunks(), t.column("fp").combine_chunks(), [low[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]]


def duplicates(docs: DataFrame, fingerprint_bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; fingerprint_bits below 64 only for tests."""
    # equal texts are equal in any lower case, so this fingerprint never parts them; bytes decide afterwards
    mask = -1 << (64 - fingerprint_bits)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column()).withColumn("fp", F.xxhash64(F.lower("text")).bitwiseAND(F.lit(mask)))
    slim = cut(map_tables(read.select("doc_id", "fp", F.xxhash64("text").alias("raw"), "text"), _digests, "doc_id long, fp long, raw long, sha binary"))
    repeated = cut(repeated_fingerprints(slim, fingerprint_bits))
    few = repeated.count() <= BROADCAST_FINGERPRINTS
    hit = read.join(F.broadcast(repeated) if few else repeated, "fp", "left_semi")
    # byte verification: rows meet by their bytes; a hot text is first counted where it lies
    groups = map_tables(hit.select("doc_id", "fp", "text"), _normal_bytes, "doc_id long, fp long, bytes binary").groupBy("fp", "bytes").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = groups.where("group_size > 1").select("fp", F.unhex(F.sha2("bytes", 256)).alias("sha"), "keep_id", "group_size")
    return slim.join(groups, ["fp", "sha"], "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.col("raw").alias("raw_hash"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all columns of docs: of equal texts the row with the largest doc_id."""
    made = duplicates(docs)
    gone = cut(made.where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("raw_hash").alias("gone_raw")).distinct())
    few = gone.count() <= BROADCAST_FINGERPRINTS
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    out = docs.join(F.broadcast(gone) if few else gone, docs["doc_id"].cast("long").eqNullSafe(gone["gone_id"]) & (F.xxhash64(text) == gone["gone_raw"]), "left_anti")
    # rows repeated in full are rare: only ids that are kept twice are sorted out
    twice = cut(made.where("kept and group_size > 1").groupBy(F.col("doc_id").alias("twice_id"), "text_sha256").count().where("count > 1").select("twice_id").distinct())
    if not twice.head(1):
        return out
    same = docs["doc_id"].cast("long").eqNullSafe(twice["twice_id"])
    normal = free_name(docs, "_normal")
    again = out.join(twice, same, "left_semi").withColumn(normal, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return out.join(twice, same, "left_anti").unionByName(again.dropDuplicates(["doc_id", normal]).drop(normal))
