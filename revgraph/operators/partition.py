"""Partition diagnostics: range buckets of attributes and disjoint edge buckets. Results never depend on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revgraph.sources.store import materialize

#: Stop splitting the rest anew below so many edges, or when a round places less than one in so many.
LEAST_REST, LEAST_SHARE = 1000, 100


def range_buckets(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Rows with a bucket number such that buckets are contiguous in key, about equal, and never split a key."""
    return rows.repartitionByRange(n, key).withColumn("bucket", F.spark_partition_id())


def edge_buckets(edges: DataFrame, n: int, src: str = "src", dst: str = "dst", rounds: int = 8) -> DataFrame:
    """Edges with a bucket: no node is in two of the buckets 0 to n - 1 of a round; bucket -1 holds what is left.

    In each round every node follows its most common partner's choice: nodes first hash to n groups, then move to the
    group that most of their edges lead to; edges within a group are placed, the others are the rest, which is split
    anew with fresh groups until it is small or hardly shrinks. Buckets of later rounds go on counting.
    """
    left = edges.withColumns({"edge_no": F.monotonically_increasing_id()})
    left = materialize(left)
    size = left.count()
    parts = []
    for k in range(rounds):
        if not size:
            break
        ends = left.select(F.col(src).alias("node"), F.col(dst).alias("other")).unionByName(left.select(F.col(dst).alias("node"), F.col(src).alias("other")))
        group = lambda c: F.pmod(F.xxhash64(c, F.lit(k)), F.lit(n)).cast("int")
        votes = ends.groupBy("node", group("other").alias("to")).agg(F.count("*").alias("n"))
        own = votes.groupBy("node").agg(F.max(F.struct("n", "to"))["to"].alias("wish"))
        # nodes of one half move to their partners of the other half, which stay where they are
        place = own.select("node", F.when(F.pmod(F.xxhash64("node", F.lit(-1 - k)), F.lit(2)) == 0, F.col("wish")).otherwise(group("node")).alias("bucket"))
        a, b = place.select(F.col("node").alias(src), F.col("bucket").alias("a")), place.select(F.col("node").alias(dst), F.col("bucket").alias("b"))
        placed = materialize(left.join(a, src).join(b, dst))
        parts.append(placed.where("a = b").withColumn("bucket", F.col("a") + k * n).select(*edges.columns, "bucket"))
        left = placed.where("a <> b").drop("a", "b")
        before, size = size, left.count()
        if size < LEAST_REST or before - size < before / LEAST_SHARE:
            break
    out = left.withColumn("bucket", F.lit(-1)).select(*edges.columns, "bucket")
    for x in parts:
        out = out.unionByName(x)
    return out


def neighbourhood_buckets(edges: DataFrame, n: int, src: str = "src", dst: str = "dst", rounds: int = 8, hops: int = 2, apart=None) -> DataFrame:
    """Edges with a bucket: no node of a bucket is in, or next to a node of, another bucket of its round.

    In each round nodes take the smallest hash within so many hops as their cluster, and clusters hash to n groups. A
    node with a neighbour of another group is on the border; edges whose two ends lie inside a group are placed, the
    others are split anew with fresh hashes until they are few or hardly fewer. Neighbours are those of all edges but
    the ones that meet the condition `apart` (perspectives, say), which get bucket -2. Bucket -1 holds what is left.
    """
    free = edges if apart is None else edges.where(~F.coalesce(apart, F.lit(False)))
    left = materialize(free)
    pairs = left.select(F.col(src).alias("node"), F.col(dst).alias("other")).where("node is not null and other is not null")
    near = materialize(pairs.unionByName(pairs.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct())
    size, parts = left.count(), []
    for k in range(rounds):
        if not size:
            break
        own = near.select("node").distinct().withColumn("label", F.xxhash64("node", F.lit(k)))
        for _ in range(hops):
            seen = near.join(own.withColumnRenamed("node", "other"), "other").select("node", "label")
            own = own.unionByName(seen).groupBy("node").agg(F.min("label").alias("label"))
        groups = materialize(own.select("node", F.pmod(F.xxhash64("label"), F.lit(n)).cast("int").alias("group")))
        beside = near.join(groups.withColumnsRenamed({"node": "other", "group": "beside"}), "other").groupBy("node").agg(F.min("beside").alias("low"), F.max("beside").alias("high"))
        inside = groups.join(beside, "node").where("low = group and high = group").select("node", "group")
        a, b = inside.withColumnsRenamed({"node": src, "group": "group_a"}), inside.withColumnsRenamed({"node": dst, "group": "group_b"})
        placed = materialize(left.join(a, src, "left").join(b, dst, "left"))
        both = F.coalesce(F.col("group_a") == F.col("group_b"), F.lit(False))
        parts.append(placed.where(both).withColumn("bucket", F.col("group_a") + k * n).select(*edges.columns, "bucket"))
        left = placed.where(~both).select(*edges.columns)
        before, size = size, left.count()
        if size < LEAST_REST or before - size < before / LEAST_SHARE:
            break
    out = left.withColumn("bucket", F.lit(-1))
    if apart is not None:
        out = out.unionByName(edges.where(F.coalesce(apart, F.lit(False))).withColumn("bucket", F.lit(-2)))
    for x in parts:
        out = out.unionByName(x)
    return out
