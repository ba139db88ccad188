"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products, one representative per group.

Equal vectors of one label are first merged into a class with a weight. Centroids are fitted on a bounded sample
(SAMPLE vectors, by hash); every class is then indexed in its PROBES nearest cells of its label, so that close vectors
on either side of a border still meet. Cells are cut into blocks of about BLOCK classes and each pair of blocks is one
task: a matrix product in double precision. A pair that meets in several cells counts in the lowest of them only.
Tasks return link counts and a spanning forest, never the pairs. Recall against brute force is measured in the tests.

Vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null label or vec_id, link
with nothing and are kept; vectors of different lengths never link; repeated rows are vectors of their own; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revgraph.llm.common import arrow_schema, components, cut

SAMPLE, PROBES, BLOCK, CELL, MAX_CELLS = 20_000, 4, 1024, 256, 1024
LEAST = 0.93


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths, in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k unit centroids of unit rows; empty cells restart at the worst-served rows."""
    rng = np.random.default_rng(3)
    centre = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        sims = x @ centre.T
        at = sims.argmax(1)
        sums = np.zeros_like(centre)
        np.add.at(sums, at, x)
        norms = np.linalg.norm(sums, axis=1)
        empty = norms < 1e-9
        centre = np.where(empty[:, None], 0, sums / np.maximum(norms, 1e-9)[:, None])
        if empty.any():
            centre[empty] = x[np.argsort(sims.max(1))[: empty.sum()]]
    return centre


def forest(n: int, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node it reaches over the links (r, c)."""
    low = np.arange(n)
    while len(r):
        before = low.copy()
        np.minimum.at(low, r, low[c])
        np.minimum.at(low, c, low[r])
        low = low[low]
        if (low == before).all():
            break
    return low


def near_duplicates(embeddings: DataFrame, least: float = LEAST, probes: int = PROBES, cell_rows: int = CELL) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("fine", fine & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    classes = cut(rows.where("fine").groupBy("label", "v").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("weight")))
    dims = classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.approx_count_distinct("label").alias("labels")).collect()  # a row for each length of vectors
    centroids = {}
    for d, n, labels in map(tuple, dims):
        sample = classes.where(F.size("v") == d).select("class_id", "v").orderBy(F.xxhash64("class_id"), "class_id").limit(SAMPLE)
        x = unit(np.array([r[0] for r in sample.select("v").collect()]))  # SAMPLE rows at most
        k = int(np.clip(n // (max(1, labels) * cell_rows), 1, min(MAX_CELLS, len(x))))
        centroids[d] = spherical_kmeans(x, k)
    schema = arrow_schema("class_id long, cell int")
    kept_names = ["class_id", "label", "weight", "v"]

    def assign(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            sizes = np.diff(np.asarray(b.column(3).offsets))
            cells: list = [None] * b.num_rows
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                x = unit(matrix(b.column(3).take(pa.array(at))))
                sims = x @ centroids[int(d)].T
                p = min(probes, sims.shape[1])
                best = np.sort(np.argpartition(-sims, p - 1, axis=1)[:, :p], axis=1)
                for i, row in zip(at.tolist(), best.astype(np.int32), strict=True):
                    cells[i] = row
            yield pa.RecordBatch.from_arrays([*t.to_batches()[0].columns, pa.array(cells, pa.list_(pa.int32()))], names=[*kept_names, "cells"])

    indexed = classes.select(*kept_names).mapInArrow(assign, "class_id long, label string, weight long, v array<double>, cells array<int>")
    placed = indexed.withColumn("cell", F.explode("cells")).withColumn("d", F.size("v"))
    sizes = placed.groupBy("label", "d", "cell").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n")
    placed = placed.join(sizes, ["label", "d", "cell"]).withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks")
    out_schema = arrow_schema("class_id long, links long, root long")

    def links(t: pa.Table) -> pa.Table:
        t = t.sort_by("class_id")
        ids, weights, cell = np.asarray(t.column("class_id")), np.asarray(t.column("weight")), t.column("cell")[0].as_py()
        x = unit(matrix(t.column("v")))
        block = np.asarray(t.column("block"))
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        cells = matrix(t.column("cells")).astype(np.int32)
        count, found = np.zeros(len(ids), np.int64), []
        for a in range(0, len(left), BLOCK):
            for b in range(0, len(right), BLOCK):
                u, w = left[a : a + BLOCK], right[b : b + BLOCK]
                r, c = np.nonzero(x[u] @ x[w].T >= least)
                r, c = u[r], w[c]
                if i == j:
                    r, c = r[r < c], c[r < c]
                common = np.where((cells[r][:, :, None] == cells[c][:, None, :]).any(2), cells[r], 1 << 30).min(1) if len(r) else np.zeros(0)
                own = common == cell
                np.add.at(count, r[own], weights[c[own]])
                np.add.at(count, c[own], weights[r[own]])
                found.append((r[own], c[own]))
        r, c = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))
        low = forest(len(ids), r, c)
        has = count > 0
        return pa.table([ids[has], count[has], ids[low[has]]], schema=out_schema)

    linked = cut(placed.groupBy("label", "d", "cell", "i", "j").applyInArrow(links, "class_id long, links long, root long"))
    counts = linked.groupBy("class_id").agg(F.sum("links").alias("links"))
    groups = components(linked.select(F.col("class_id").alias("a"), F.col("root").alias("b")))
    several = classes.where("weight > 1").select("label", "v", "class_id", "weight")
    return (
        rows.join(several, ["label", "v"], "left")
        .withColumn("class_id", F.when(F.col("fine"), F.coalesce("class_id", "vec_id")))
        .withColumn("weight", F.when(F.col("fine"), F.coalesce("weight", F.lit(1))).otherwise(1))
        .join(counts, "class_id", "left")
        .join(groups.withColumnRenamed("id", "class_id"), "class_id", "left")
        .select(
            "vec_id",
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"),
            F.coalesce("root", "class_id", "vec_id").alias("component_id"),
            F.coalesce(F.col("vec_id") == F.coalesce("root", "class_id", "vec_id"), F.lit(True)).alias("kept"),
        )
    )
