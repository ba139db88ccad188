"""Hierarchy operators: paths by pointer doubling, resources, layers, ancestors, leaves, qualified names.

Paths are resolved for all nodes at once: in each round every node takes over the path of the node its pointer
reaches, so a hierarchy of depth d needs about log2(d) joins instead of d. Cycles never reach a root and are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revgraph.model import DISABLED_ELEMENTS
from revgraph.sources.store import materialize

#: Rounds after which circles are looked for: paths of 2 ** CIRCLE_ROUND nodes and more.
CIRCLE_ROUND = 3


def _without_circles(rows: DataFrame, ahead: DataFrame) -> DataFrame:
    """The rows whose pointers lead out of them, that is to finished ones; ahead: id, up of all of the rows.

    Pointers alone are doubled, until none leads on or more steps are made than there are rows.
    """
    n, steps, left = ahead.count(), 1, ahead
    inside = ahead.select(F.col("id").alias("up"))
    left = materialize(left.join(inside, "up", "left_semi"))  # those that stay inside for one step
    while steps <= n and left.head(1):
        step = left.select(F.col("id").alias("up"), F.col("up").alias("next"))
        left = materialize(left.join(step, "up").select("id", F.col("next").alias("up")))
        steps *= 2
    return rows.join(left.select("id"), "id", "left_anti") if left.head(1) else rows


def resolve_paths(nodes: DataFrame, keep: list[str] | None = None, rounds: int | None = None, store=materialize) -> DataFrame:
    """id and path (from the root down, structs of the columns in `keep`) for nodes with id and parent ('' or null: root).

    Nodes whose chain of parents leaves the table or runs in a circle have no row. Hierarchies of any depth are resolved
    unless `rounds` limits the doublings; rows that are finished are set aside and only looked up. store cuts lineage.
    """
    keep = keep or ["id", "name", "type"]
    at = nodes.select("id", F.when(F.coalesce("parent", F.lit("")) != "", F.col("parent")).alias("up"), F.array(F.struct(*keep)).alias("path"))
    done = [store(at.where("up is null"))]
    at = store(at.where("up is not null"))
    k = 0
    while at.head(1) and (rounds is None or k < rounds):
        above = at
        for x in done:
            above = above.unionByName(x)
        above = above.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("path").alias("upper"))
        moved = store(at.join(above, "up").select("id", F.col("next").alias("up"), F.concat("upper", "path").alias("path")))
        done.append(moved.where("up is null"))
        at = moved.where("up is not null")
        k += 1
        if k == CIRCLE_ROUND:
            at = materialize(_without_circles(at, at.select("id", "up")))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("id", "path")


def path_string(path) -> F.Column:
    """name[type].name[type]... of a path."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["name"], F.lit("["), x["type"], F.lit("]"))), ".")


def ancestors(paths: DataFrame, nodes: DataFrame, skip_disabled: bool = True) -> DataFrame:
    """id, ancestor_id, distance of every proper ancestor; disabled elements (technology:type) are left out."""
    pairs = paths.select("id", F.posexplode("path").alias("depth", "x"), F.size("path").alias("n")).where("depth < n - 1").select("id", F.col("x.id").alias("ancestor_id"), (F.col("n") - 1 - F.col("depth")).alias("distance"))
    if skip_disabled and "technology" in nodes.columns:
        bad = nodes.where(F.concat_ws(":", "technology", "type").isin(*DISABLED_ELEMENTS)).select(F.col("id").alias("ancestor_id"))
        pairs = pairs.join(bad, "ancestor_id", "left_anti")
    return pairs


def start_nodes(children: DataFrame, tops: DataFrame) -> DataFrame:
    """top, id: the nodes without children that descent from each top reaches, over parent and perspective edges alike.

    children: id, child (from hasParent and perspective edges); tops: id. A set of visited nodes keeps circles finite; a
    top without children is its own start node.
    """
    step = materialize(children.select("id", "child").distinct())
    frontier = materialize(tops.select(F.col("id").alias("top"), "id").distinct())
    seen = frontier
    while frontier.head(1):
        frontier = materialize(frontier.join(step, "id").select("top", F.col("child").alias("id")).distinct().join(seen, ["top", "id"], "left_anti"))
        seen = seen.unionByName(frontier)
    return seen.join(step.select("id").distinct(), "id", "left_anti").select("top", "id")


def leaves(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """ancestor_id, leaf_id: the nodes without children below each node; a node without children is its own leaf."""
    inner = nodes.where("coalesce(parent, '') <> ''").select(F.col("parent").alias("id")).distinct()
    tips = paths.join(inner, "id", "left_anti")
    return tips.select(F.explode("path").alias("x"), F.col("id").alias("leaf_id")).select(F.col("x.id").alias("ancestor_id"), "leaf_id")


def node_resource(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, resource_id: a node's own resource, or else the nearest ancestor's."""
    own = nodes.select(F.col("id").alias("at"), "resource_id").where("coalesce(resource_id, '') <> ''")
    steps = paths.select("id", F.posexplode("path").alias("depth", "x")).select("id", "depth", F.col("x.id").alias("at"))
    return steps.join(own, "at").groupBy("id").agg(F.max_by("resource_id", "depth").alias("resource_id"))


def node_layer(resources: DataFrame, resource_of: DataFrame, layers: DataFrame) -> DataFrame:
    """id, layer name and type over the node's resource."""
    r = resources.select(F.col("id").alias("resource_id"), "layer_id")
    return resource_of.join(r, "resource_id").join(layers.select(F.col("id").alias("layer_id"), F.col("name").alias("layer_name"), F.col("type").alias("layer_type")), "layer_id").select("id", "resource_id", "layer_name", "layer_type")


def find_qualified(paths: DataFrame, wanted: DataFrame) -> DataFrame:
    """request, id of the one node that a qualified name means.

    wanted: request, names (structs of name and type from the root down), resource. Names and types compare without
    case; an exact match beats the others; what stays ambiguous has no row. paths: id, path, resource (name).
    """
    key = lambda path: F.lower(F.array_join(F.transform(path, lambda x: F.concat(x["name"], F.lit("\x1f"), x["type"])), "\x1e"))
    exact = lambda path: F.array_join(F.transform(path, lambda x: F.concat(x["name"], F.lit("\x1f"), x["type"])), "\x1e")
    have = paths.select("id", key(F.col("path")).alias("k"), exact(F.col("path")).alias("e"), F.lower("resource").alias("r"))
    want = wanted.select("request", key(F.col("names")).alias("k"), exact(F.col("names")).alias("w"), F.lower("resource").alias("r"))
    hits = want.join(have, ["k", "r"]).withColumn("same", (F.col("w") == F.col("e")).cast("int"))
    best = hits.groupBy("request").agg(F.count("*").alias("n"), F.sum("same").alias("n_same"), F.min("id").alias("any"), F.min(F.when(F.col("same") == 1, F.col("id"))).alias("one"))
    return best.where("n_same = 1 or n_same = 0 and n = 1").select("request", F.coalesce("one", "any").alias("id"))
