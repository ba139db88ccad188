"""Look-ups on a snapshot: by id and property, edges of a node, children, and the predicate of what may be seen."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_id(vertices: DataFrame, ids: Iterable[str], kind: str | None = None) -> DataFrame:
    """The vertices of these ids, of one kind if it is given."""
    hit = vertices.where(F.col("vertex_id").isin(*ids))
    return hit if kind is None else hit.where(F.col("kind") == kind)


def by_property(vertices: DataFrame, **wanted: str | None) -> DataFrame:
    """The vertices whose properties have these values; null and '' are one."""
    for name, value in wanted.items():
        vertices = vertices.where(F.coalesce(name, F.lit("")) == (value or ""))
    return vertices


def edge_by_id(edges: DataFrame, ids: Iterable[str]) -> DataFrame:
    return edges.where(F.col("edge_id").isin(*ids))


def edges_of(edges: DataFrame, nodes: DataFrame, types: Iterable[str], direction: str = "out", low=None, high=None) -> DataFrame:
    """id and the edges of some types that leave (out), enter (in) or touch (both) the nodes (id), within an interval."""
    hit = edges.where(F.col("type").isin(*types))
    if low is not None:
        hit = hit.where((F.col("tran_start") <= F.lit(high)) & (F.col("tran_end") >= F.lit(low)))
    sides = {"out": ["src"], "in": ["dst"], "both": ["src", "dst"]}[direction]
    ends = hit.withColumn("id", F.explode(F.array_distinct(F.array(*sides))))
    return ends.join(nodes.select("id"), "id", "left_semi").select("id", *edges.columns)


def children(edges: DataFrame, nodes: DataFrame, low, high, perspectives: bool = False) -> DataFrame:
    """id, child: direct children by hasParent and, if asked for, by perspective edges."""
    below = edges_of(edges, nodes, ["hasParent"], "in", low, high).select("id", F.col("src").alias("child"))
    if perspectives:
        below = below.unionByName(edges_of(edges, nodes, ["perspective"], "out", low, high).select("id", F.col("dst").alias("child")))
    return below.distinct()


def permitted(vertices: DataFrame, edges: DataFrame, allowed: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The vertices that a predicate allows, and the edges between them; all of them by default."""
    if allowed is None:
        return vertices, edges
    kept = vertices.where(allowed)
    ids = kept.select("vertex_id")
    ends = edges.join(ids.withColumnRenamed("vertex_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("vertex_id", "dst"), "dst", "left_semi")
    return kept, ends.select(*edges.columns)
