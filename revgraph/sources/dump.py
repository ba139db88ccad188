"""Import of zipped binary dumps (entry `dump`, version 1.22): vertices first, then edges, in block data of an object stream."""

from __future__ import annotations

import io
import json
import struct
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from revgraph.functions.scalars import content_id
from revgraph.functions.values import BLOCK, LONG_STRING, MAGIC, STRING, _Reader
from revgraph.model import REVISION, ROOTS
from revgraph.operators.paths import resolve_paths
from revgraph.sources.store import materialize

VERSION = "1.22"
#: Fields of each vertex kind after its id, in order: q long, d double, ? boolean, U text, O object.
VERTEX_FIELDS = {
    "SUPER_ROOT": [],
    "REVISION_ROOT": [("latest_committed", "d"), ("latest_uncommitted", "d")],
    "LAYER": [("name", "U"), ("type", "U")],
    "RESOURCE": [("name", "U"), ("type", "U"), ("description", "U")],
    "NODE": [("name", "U"), ("type", "U")],
    "ATTRIBUTE": [("name", "U"), ("value", "O")],
    "REVISION_NODE": [("number", "d"), ("committed", "?"), ("commit_time", "U"), ("previous", "d"), ("next", "d")],
    "SOURCE_ROOT": [],
    "SOURCE_NODE": [("name", "U"), ("hash", "U"), ("source_id", "U")],
}
LONG_BLOCK = 0x7A


class ObjectStream:
    """Primitive values in block data, objects between blocks."""

    def __init__(self, data: bytes):
        self.r = _Reader(data)
        if self.r.take("H") != MAGIC or self.r.take("H") != 5:
            raise ValueError("not an object stream")
        self.left = 0

    def _fill(self) -> bool:
        while self.left == 0:
            if self.r.at >= len(self.r.data):
                return False
            tag = self.r.take("B")
            if tag == BLOCK:
                self.left = self.r.take("B")
            elif tag == LONG_BLOCK:
                self.left = self.r.take("I")
            else:
                raise ValueError(f"block data expected, found {tag:#x}")
        return True

    def raw(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            if not self._fill():
                raise EOFError
            step = min(n - len(out), self.left)
            out += self.r.data[self.r.at : self.r.at + step]
            self.r.at += step
            self.left -= step
        return out

    def get(self, kind: str):
        if kind == "U":
            return self.raw(struct.unpack(">H", self.raw(2))[0]).decode("utf-8", "surrogatepass")
        if kind == "O":
            if self.left:
                raise ValueError("an object inside block data")
            return self.r.value()
        return struct.unpack(">" + kind, self.raw(struct.calcsize(">" + kind)))[0]


def records(data: bytes):
    """(object kind, dict) of every record of an unzipped dump."""
    s = ObjectStream(data)
    if (found := s.get("U")) != VERSION:
        raise ValueError(f"dump version {found} is not {VERSION}")
    while True:
        try:
            kind = s.get("U")
        except EOFError:
            return
        if kind == "VERTEX":
            label = s.get("U")
            if label not in VERTEX_FIELDS:
                raise ValueError(f"unknown vertex kind {label}")
            yield kind, {"kind": label, "id": s.get("q")} | {n: s.get(k) for n, k in VERTEX_FIELDS[label]}
        elif kind == "EDGE":
            row = {"src": s.get("q"), "dst": s.get("q"), "type": s.get("U"), "tran_start": s.get("d"), "tran_end": s.get("d")}
            yield kind, row | {"props": {s.get("U"): s.get("O") for _ in range(s.get("i"))}}
        else:
            raise ValueError(f"unknown object kind {kind}")


def write_dump(rows: list[tuple[str, dict]]) -> bytes:
    """The zipped dump of such records; objects must be strings."""
    out, block = [struct.pack(">HH", MAGIC, 5)], bytearray()

    def flush():
        while block:
            part = bytes(block[:255])
            del block[:255]
            out.append(struct.pack(">BB", BLOCK, len(part)) + part)

    def put(kind, v):
        if kind == "U":
            raw = v.encode("utf-8", "surrogatepass")
            block.extend(struct.pack(">H", len(raw)) + raw)
        elif kind == "O":
            flush()
            raw = v.encode("utf-8", "surrogatepass")
            out.append((struct.pack(">BH", STRING, len(raw)) if len(raw) < 65536 else struct.pack(">Bq", LONG_STRING, len(raw))) + raw)
        else:
            block.extend(struct.pack(">" + kind, v))

    put("U", VERSION)
    for kind, row in rows:
        put("U", kind)
        if kind == "VERTEX":
            put("U", row["kind"])
            put("q", row["id"])
            for n, k in VERTEX_FIELDS[row["kind"]]:
                put(k, row[n])
        else:
            for n, k in (("src", "q"), ("dst", "q"), ("type", "U"), ("tran_start", "d"), ("tran_end", "d")):
                put(k, row[n])
            put("i", len(row["props"]))
            for k, v in row["props"].items():
                put("U", k)
                put("O", v)
    flush()
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("dump", b"".join(out))
    return packed.getvalue()


def read_dump(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of all dumps at a path, ids as stored in the dumps."""
    ddl = "object string, kind string, id long, src long, dst long, tran_start double, tran_end double, fields map<string,string>"
    names = ["object", "kind", "id", "src", "dst", "tran_start", "tran_end", "fields"]

    def run(batches):
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.map_(pa.string(), pa.string())]
        show = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
        for b in batches:
            for content in b.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    data = z.read("dump")
                rows = []
                for kind, r in records(data):
                    if kind == "VERTEX":
                        rows.append((kind, r["kind"], r["id"], None, None, None, None, [(k, show(v)) for k, v in r.items() if k not in ("kind", "id")]))
                    else:
                        rows.append((kind, r["type"], None, r["src"], r["dst"], r["tran_start"], r["tran_end"], [(k, show(v)) for k, v in r["props"].items() if v is not None]))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    made = materialize(spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ddl))  # each dump is parsed once
    return made.where("object = 'VERTEX'").select("kind", "id", "fields"), made.where("object = 'EDGE'").select(made["kind"].alias("type"), "src", "dst", "tran_start", "tran_end", made["fields"].alias("props"))


def stored_kind(label: F.Column) -> F.Column:
    """A dump's vertex label as the store's kind: SUPER_ROOT to SuperRoot."""
    return F.array_join(F.transform(F.split(label, "_"), lambda x: F.initcap(F.lower(x))), "")


def dump_snapshot(vertices: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """The store's tables from read_dump()'s frames: ids and natural keys as the merge makes them, so later batches meet
    the imported objects. Technology and connection of source codes are not in a dump and count as empty."""
    at = lambda name: F.col("fields")[name]
    kind = stored_kind(F.col("kind"))
    v = materialize(vertices.select(F.col("id").alias("dump_id"), kind.alias("kind"), F.when(kind.isin(*ROOTS), content_id(kind)).otherwise(content_id(F.lit("dump"), F.col("id"))).alias("vertex_id"), at("name").alias("name"), at("type").alias("type"), at("description").alias("description"), at("value").alias("value"), at("hash").alias("hash"), "fields"))
    ids = v.select("dump_id", "vertex_id")
    end = lambda c: ids.select(F.col("dump_id").alias(c), F.col("vertex_id").alias(c + "_id"))
    e = edges.join(end("src"), "src").join(end("dst"), "dst").select("type", F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), F.col("tran_start").cast(REVISION).alias("tran_start"), F.col("tran_end").cast(REVISION).alias("tran_end"), "props")
    e = materialize(e.select(content_id(F.col("type"), F.col("src"), F.col("dst"), F.col("tran_start")).alias("edge_id"), "*", (F.coalesce(F.col("props")["interpolated"], F.lit("false")) == "true").alias("interpolated"), F.col("props")["layer"].alias("layer")))
    resources = v.where("kind = 'Resource'").select(F.col("vertex_id").alias("resource_id"), content_id(F.lit("resource"), F.col("name"), F.col("type")).alias("resource_key"))
    own = e.where("type = 'hasResource'").join(resources, e["dst"] == resources["resource_id"]).groupBy(F.col("src").alias("vertex_id")).agg(F.max_by("resource_id", "tran_end").alias("resource_id"), F.max_by("resource_key", "tran_end").alias("resource_key"))
    parents = e.where("type = 'hasParent'").groupBy(F.col("src").alias("vertex_id")).agg(F.max_by("dst", "tran_end").alias("parent"))
    nodes = v.where("kind = 'Node'").join(own, "vertex_id", "left").join(parents, "vertex_id", "left").select(F.col("vertex_id").alias("id"), "parent", "name", "type", "resource_id", "resource_key")
    named = resolve_paths(nodes, ["name", "type", "resource_id", "resource_key"])
    steps = F.array_join(F.transform("path", lambda x: F.concat(x["name"], F.lit("\x1f"), x["type"])), "\x1e")
    keyed = materialize(named.select(F.col("id").alias("vertex_id"), content_id(F.col("path")[0]["resource_key"], steps).alias("node_key"), F.filter(F.reverse(F.transform("path", lambda x: x["resource_id"])), lambda x: x.isNotNull())[0].alias("resource_id")))
    owner = e.where("type = 'hasAttribute'").join(keyed.select(F.col("vertex_id").alias("src"), "node_key"), "src").groupBy(F.col("dst").alias("vertex_id")).agg(F.min("node_key").alias("owner_key"))
    layered = e.where("type = 'inLayer'").groupBy(F.col("dst").alias("vertex_id")).agg(F.min("src").alias("layer_resource"))
    joined = v.join(keyed, "vertex_id", "left").join(owner, "vertex_id", "left").join(layered, "vertex_id", "left")
    nkey = (
        F.when(F.col("kind") == "Node", F.col("node_key"))
        .when(F.col("kind") == "Resource", content_id(F.lit("resource"), F.col("name"), F.col("type")))
        .when(F.col("kind") == "Layer", content_id(F.col("layer_resource"), F.col("name")))
        .when(F.col("kind") == "Attribute", content_id(F.col("owner_key"), F.col("name"), F.col("value")))
        .when(F.col("kind") == "SourceNode", content_id(F.col("name"), F.col("hash"), F.lit(""), F.lit("")))
        .otherwise(F.col("kind"))
    )
    shown = F.when(F.col("kind") == "Attribute", F.col("name")).when(F.col("kind").isin(*ROOTS), F.col("kind")).otherwise(F.col("type"))
    kept = joined.where("kind <> 'RevisionNode'").select("vertex_id", "kind", nkey.alias("nkey"), "name", shown.alias("type"), "description", F.when(F.col("kind") == "SourceNode", F.col("hash")).otherwise(F.col("value")).alias("value"), "resource_id")
    number = lambda c: F.when(at(c).cast("double") >= 0, at(c).cast("double")).cast(REVISION)  # noqa: E731  -1 stands for none
    revisions = v.where("kind = 'RevisionNode'").select(number("number").alias("number"), number("previous").alias("previous"), number("next").alias("next"), (at("committed") == "true").alias("committed"), F.try_to_timestamp(at("commit_time")).alias("commit_time"))
    return {"vertices": kept, "edges": e.select("edge_id", "type", "src", "dst", "tran_start", "tran_end", "interpolated", "layer", "props"), "revisions": revisions}
