"""Kinds, edge types, record layouts and table schemas."""

from __future__ import annotations

# --- fixed values of the record format ---------------------------------------------------------------------------

#: Record kinds in merge order and their columns after the kind literal.
LAYOUTS = {
    "source_code": ["id", "local_name", "hash", "technology", "connection"],
    "layer": ["id", "name", "type"],
    "resource": ["id", "name", "type", "description", "layer_id"],
    "node": ["id", "parent_id", "name", "type", "resource_id", "flag"],
    "node_attribute": ["object_id", "key", "value"],
    "edge": ["id", "source", "target", "type", "resource"],
    "edge_attribute": ["object_id", "key", "value"],
}
#: Legal numbers of fields, the kind literal included.
ARITIES = {"source_code": (6, 4), "layer": (4,), "resource": (6,), "node": (7, 6), "node_attribute": (4,), "edge": (6,), "edge_attribute": (4,)}
MAX_FIELD_BYTES = 4_194_304
FLAGS = ("remove", "removeMyself")
#: Edge types: stored name and the literal in files.
EDGE_TYPES = {
    "hasParent": "parent",
    "hasResource": "resource",
    "hasRevision": "revision",
    "hasAttribute": "attribute",
    "directFlow": "DIRECT",
    "filterFlow": "FILTER",
    "hasSource": "source",
    "inLayer": "layer",
    "mapsTo": "MAPS_TO",
    "perspective": "PERSPECTIVE",
}
#: Which kinds an edge type may join.
ENDPOINTS = [
    ("directFlow", "Node", "Node"),
    ("filterFlow", "Node", "Node"),
    ("hasParent", "Node", "Node"),
    ("mapsTo", "Node", "Node"),
    ("perspective", "Node", "Node"),
    ("hasAttribute", "Node", "Attribute"),
    ("hasResource", "Node", "Resource"),
    ("hasResource", "Resource", "SuperRoot"),
    ("hasRevision", "RevisionRoot", "RevisionNode"),
    ("hasSource", "SourceRoot", "SourceNode"),
    ("inLayer", "Resource", "Layer"),
]
#: The edges that carry a vertex's validity: direction seen from the vertex, and types. Roots have none.
CONTROL_EDGES = {
    "Resource": ("out", ["hasResource"]),
    "Node": ("out", ["hasResource", "hasParent"]),
    "Attribute": ("in", ["hasAttribute"]),
    "RevisionNode": ("in", ["hasRevision"]),
    "SourceNode": ("in", ["hasSource"]),
    "Layer": ("in", ["inLayer"]),
}
ROOTS = ("SuperRoot", "RevisionRoot", "SourceRoot")
DISABLED_ELEMENTS = ("PostgreSQL:Server", "PostgreSQL scripts:Block")
REVISION_STEP = "0.000001"

# --- schemas -------------------------------------------------------------------------------------------------------

REVISION = "decimal(16,6)"
VERTICES = "vertex_id string, kind string, nkey string, name string, type string, description string, value string, resource_id string"
EDGES = f"edge_id string, type string, src string, dst string, tran_start {REVISION}, tran_end {REVISION}, interpolated boolean, layer string, props map<string,string>"
REVISIONS = f"number {REVISION}, previous {REVISION}, next {REVISION}, committed boolean, commit_time timestamp"
RESULTS = ("NEW_OBJECT", "ALREADY_EXIST", "ERROR")
