"""The merge engine on small batches: every kind new, again, changed and wrong; flags, perspectives and mappings."""

import base64
import glob
import os
import struct
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from revgraph.functions import scalars as fn
from revgraph.functions.values import encode_value, parse_list
from revgraph.model import LAYOUTS
from revgraph.operators import paths as hierarchy
from revgraph.operators import subtree
from revgraph.plans import catalogue as catalogue_queries
from revgraph.plans import revisions as catalogue
from revgraph.plans.merge import commit_revision, merge, merge_files, open_revision
from revgraph.sources.batch import late_sources, read_batch, scan
from revgraph.sources.dump import read_dump, write_dump
from revgraph.sources.store import Store, empty

FIRST = """source_code,44,c:\\\\tmp\\\\A.sql,5d21,ORACLE,conn
layer,0,Physical,Physical
layer,1,Logical,Logical
resource,2,DB,Oracle,"scripts, \\"quoted\\" x",0
resource,10,Model,ER,,1
resource,99,Lost,Oracle,,7
node,3,,srv,Server,2
node,4,3,tab,Table,2
node,5,4,col,Column,2
node,11,,ent,Entity,10
node,12,3,odd,Table,10
node,13,77,orphan,Table,2
node,4b,3,tab,Table,2
node_attribute,5,LEN,"10"
node_attribute,5,sourceLocation,44
node_attribute,5,sourceLocation,45
node_attribute,4,mapsTo,"J:[[\\"Model\\",null,\\"Model\\"],[\\"ENT\\",\\"entity\\",\\"Model\\"]]"
edge,0,5,12,DIRECT,2
edge,1,5,12,DIRECT,2
edge,2,5,66,DIRECT,2
edge,3,4,11,PERSPECTIVE,2
edge,4,5,4,STRANGE,2
edge_attribute,0,K,v1
edge_attribute,0,label,x
edge_attribute,9,K,v1
strange,1
layer,5
"""
SECOND = """layer,0,Physical,Physical
resource,2,DB,Oracle,other,0
node,3,,srv,Server,2
node,4,3,tab,Table,2
node,5,4,col,Column,2
node,6,4,new,Column,2
node,12,3,odd,Table,2
edge,0,5,6,FILTER,2
"""


@pytest.fixture(scope="module")
def merged(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("batch")
    (d / "a.csv").write_text(FIRST)
    store = Store(spark, str(d / "store"))
    store.wipe()
    open_revision(store)
    commit_revision(store)
    assert open_revision(store) == 1
    report = merge_files(store, str(d / "a.csv"), strategy="any").first()
    commit_revision(store)
    return store, report, d


def test_first_load(merged):
    store, r, _ = merged
    new, error = r.new_objects, r.error_objects
    assert new == {"source_code": 1, "layer": 2, "resource": 2, "node": 5, "node_attribute": 3, "edge": 3, "edge_attribute": 3}
    assert error == {"source_code": 0, "layer": 2, "resource": 1, "node": 1, "node_attribute": 1, "edge": 2, "edge_attribute": 1}
    assert r.unknown == 1
    snapshot = store.read()
    e = snapshot["edges"]
    assert {x.type: x["count"] for x in e.groupBy("type").count().collect()} == {"hasSource": 1, "hasResource": 5, "inLayer": 2, "hasParent": 3, "hasAttribute": 3, "directFlow": 1, "perspective": 1, "mapsTo": 1}
    assert e.where("type = 'directFlow'").first().props == {"K": "v1", "_label": "x"}
    assert e.where("type = 'perspective'").first().layer == "Logical"
    assert snapshot["vertices"].where("name = 'Logical perspective'").first().value == "ent[Entity]"
    assert {(x.tran_start, x.tran_end) for x in e.collect()} == {(Decimal("1.000000"), Decimal("1.999999"))}


def test_second_load(spark, merged):
    store, _, d = merged
    (d / "b.csv").write_text(SECOND + "node_attribute,5,LEN,10\nnode_attribute,5,LEN,11\nedge,7,5,12,DIRECT,2\n")
    snapshot = store.read()
    batch = read_batch(spark, str(d / "b.csv"))
    out, results = merge(snapshot, {k: batch[k] for k in LAYOUTS}, 2, 1)
    count = {(r.item_type, r.result): r["count"] for r in results.groupBy("item_type", "result").count().collect()}
    assert count == {("layer", "ALREADY_EXIST"): 1, ("resource", "ALREADY_EXIST"): 1, ("node", "ALREADY_EXIST"): 4, ("node", "NEW_OBJECT"): 1, ("node_attribute", "ALREADY_EXIST"): 1, ("node_attribute", "NEW_OBJECT"): 1, ("edge", "NEW_OBJECT"): 1, ("edge", "ALREADY_EXIST"): 1}
    flow = out["edges"].where("type = 'directFlow'").first()
    assert (flow.tran_start, flow.tran_end) == (Decimal("1.000000"), Decimal("2.999999"))
    assert out["edges"].where("type = 'perspective'").first().tran_end == Decimal("1.999999")


def test_copy_on_write(spark, merged):
    store, _, d = merged
    (d / "c.csv").write_text(SECOND + "edge,7,5,12,DIRECT,2\nedge_attribute,7,K,v2\nedge_attribute,7,label,x\n")
    batch = read_batch(spark, str(d / "c.csv"))
    out, _ = merge(store.read(), {k: batch[k] for k in LAYOUTS}, 2, 1)
    got = {(x.tran_start, x.tran_end, x.props["K"], x.props["_label"]) for x in out["edges"].where("type = 'directFlow'").collect()}
    assert got == {(Decimal("1.000000"), Decimal("1.000000"), "v1", "x"), (Decimal("2.000000"), Decimal("2.999999"), "v2", "x")}


@pytest.mark.parametrize(("flag", "end"), [("remove", "2.999999"), ("removeMyself", "1.000000")])
def test_flags(spark, merged, flag, end):
    store, _, d = merged
    (d / f"{flag}.csv").write_text(f"layer,0,Physical,Physical\nresource,2,DB,Oracle,x,0\nnode,3,,srv,Server,2\nnode,4,3,tab,Table,2,{flag}\n")
    batch = read_batch(spark, str(d / f"{flag}.csv"))
    out, _ = merge(store.read(), {k: batch[k] for k in LAYOUTS}, 2, 1)
    v = {x.vertex_id: x.name for x in out["vertices"].collect()}
    ends = {(v[x.src], v[x.dst]): x.tran_end for x in out["edges"].collect()}
    assert ends["tab", "srv"] == Decimal(end)
    assert ends["col", "tab"] == ends["col", "odd"] == Decimal("1.000000")
    assert ends["srv", "DB"] == Decimal("2.999999") and ends["ent", "Model"] == Decimal("1.999999")


def test_scan(spark, tmp_path):
    (tmp_path / "x.csv").write_text('"node","1","","a\nb","T","2"\nsource_code,1,a,h\nsource_code,1,a,h,t,c\nnode,1,,n,T,2,remove\n')
    got = [(r.kind, len(r.fields)) for r in sorted(scan(spark, str(tmp_path)).collect(), key=lambda r: r.line)]
    assert got == [("node", 6), ("source_code", 4), ("source_code", 6), ("node", 7)]
    b = read_batch(spark, str(tmp_path))
    assert sorted((r.technology, r.connection) for r in b["source_code"].collect()) == [("", ""), ("t", "c")]
    assert late_sources(scan(spark, str(tmp_path))).count() == 2


def test_parts_of_a_folder_are_one_file(spark, tmp_path):
    """Records of equal lines are dealt to several parts, and what reads them sees one file in its order."""
    from revgraph.sources.batch import write_records

    rows = [("f", 0, ["source_code", "1", "a", "h"]), *[("f", 3, ["node", str(i), "", 'a"\\b\nc', "T", "2"]) for i in range(400)], ("f", 9, ["edge_attribute", "e", "K", "v"])]
    records = spark.createDataFrame(rows, "file string, line long, fields array<string>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_records(records, str(tmp_path / "one"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "one").glob("part-*"))) > 1
    found = scan(spark, [str(tmp_path / "one")], parts=True)
    got = sorted(found.collect(), key=lambda r: r.line)
    assert len({r.file for r in got}) == 1 and len({r.line for r in got}) == len(rows)
    assert [r.kind for r in got] == [x[2][0] for x in rows] and late_sources(found).count() == 0
    assert sorted(tuple(r.fields) for r in got) == sorted(tuple(x[2]) for x in rows)


def test_revisions(spark):
    r = empty(spark)["revisions"]
    r, n = catalogue.create_major(r)
    assert n == 0
    with pytest.raises(catalogue.RevisionError):
        catalogue.create_major(r)
    r = catalogue.commit(r, 0, "2024-01-01 00:00:00")
    r, n = catalogue.create_minor(r)
    assert n == Decimal("0.000001") and catalogue.latest(r) == (0, n) and catalogue.head(r) == n
    with pytest.raises(catalogue.RevisionError):
        catalogue.commit(r, 5)
    with pytest.raises(catalogue.RevisionError):
        catalogue.require_open(r, 0)
    r, n = catalogue.create_major(catalogue.commit(r))
    assert n == 1 and catalogue.find(r, 0)["next"] == Decimal("0.000001") and catalogue.find(r, 7) is None


def test_values():
    def text(s):
        return b"\x74" + struct.pack(">H", len(s)) + s.encode()

    cls = b"\x72" + struct.pack(">H", 19) + b"java.util.ArrayList" + b"\0" * 8 + b"\x03" + struct.pack(">H", 1) + b"I\0\x04size" + b"\x78\x70"
    one = b"\x73" + cls + struct.pack(">i", 2) + b"\x77\x04" + struct.pack(">i", 2) + text("a") + b"\x70" + b"\x78"
    raw = b"\xac\xed\x00\x05" + one
    assert parse_list("B64:" + base64.b64encode(raw).decode()) == ["a", None]
    assert parse_list(encode_value([["a", "b", "c"]])) == [["a", "b", "c"]]
    for bad in ("B64:xx", "B64:" + base64.b64encode(raw.replace(b"ArrayList", b"ArrayLisX")).decode(), "B64:" + base64.b64encode(raw[:30]).decode(), "J:1"):
        with pytest.raises(ValueError):
            parse_list(bad)


def test_scalars(spark):
    rows = spark.createDataFrame([(999,), (1500,), (999_949,), (2_000_000,), (10**18,), (-5000,)], "n long")
    assert [r[0] for r in rows.select(fn.si_bytes(F.col("n"))).collect()] == ["999 B", "1.5 kB", "999.9 kB", "2.0 MB", "1.0 EB", "-5.0 kB"]
    one = spark.range(1).select(fn.java_hash(F.lit("abc")), fn.source_local_key(F.lit("ABC")), fn.java_hash(F.lit("polygenelubricants")), fn.camel_to_snake(F.lit("fooBarB")), fn.revision_label(F.lit("1.000123").cast("decimal(16,6)")), fn.max_minor(F.lit("3").cast("decimal(16,6)")), fn.duration(F.lit(90061 * 10**9)), fn.grouped(F.lit(1234567))).first()
    assert tuple(one) == (96354, "96354", -(2**31), "FOO_BAR_B", "1.123", Decimal("3.999999"), "1d 1h 1m", "1,234,567")


def test_dump(spark, tmp_path):
    rows = [("VERTEX", {"kind": "SUPER_ROOT", "id": 1}), ("VERTEX", {"kind": "NODE", "id": 2, "name": "é", "type": "T"}), ("VERTEX", {"kind": "ATTRIBUTE", "id": 3, "name": "k", "value": "v" * 700}), ("VERTEX", {"kind": "REVISION_NODE", "id": 4, "number": 1.0, "committed": True, "commit_time": "t", "previous": 0.0, "next": -1.0}), ("EDGE", {"src": 2, "dst": 3, "type": "hasAttribute", "tran_start": 1.0, "tran_end": 1.999999, "props": {"a": "b"}})]
    (tmp_path / "d.zip").write_bytes(write_dump(rows))
    v, e = read_dump(spark, str(tmp_path))
    assert {(r.kind, r.id, r.fields.get("name")) for r in v.collect()} == {("SUPER_ROOT", 1, None), ("NODE", 2, "é"), ("ATTRIBUTE", 3, "k"), ("REVISION_NODE", 4, None)}
    assert [(r.src, r.dst, r.type, r.props) for r in e.collect()] == [(2, 3, "hasAttribute", {"a": "b"})]


def test_paths_with_cycles(spark):
    n = spark.createDataFrame([("a", "", "A", "T"), ("b", "a", "B", "T"), ("c", "b", "C", "T"), ("x", "y", "X", "T"), ("y", "x", "Y", "T"), ("z", "gone", "Z", "T")], "id string, parent string, name string, type string")
    p = hierarchy.resolve_paths(n, rounds=4)
    assert {r.id: r.s for r in p.select("id", hierarchy.path_string(F.col("path")).alias("s")).collect()} == {"a": "A[T]", "b": "A[T].B[T]", "c": "A[T].B[T].C[T]"}
    assert {r.id for r in subtree.members(p, spark.createDataFrame([("b",)], "id string")).collect()} == {"b", "c"}


def test_stream(spark, tmp_path):
    from revgraph.streaming.group_commit import run

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("layer,0,P,P\nresource,2,DB,O,x,0\n")
    (tmp_path / "in" / "b.csv").write_text("layer,1,P,P\nresource,5,DB,O,x,1\nnode,3,,srv,Server,5\n")
    store = Store(spark, str(tmp_path / "store"))
    store.wipe()
    open_revision(store)
    seen = []
    run(store, str(tmp_path / "in"), str(tmp_path / "cp"), lambda r, _: seen.append(r.first())).awaitTermination()
    assert len(seen) == 1 and len(seen[0].files) == 2 and seen[0].new_objects["resource"] == 1 and seen[0].new_objects["node"] == 1


def si_text(n):
    if n < 1000:
        return f"{n} B"
    for i, prefix in enumerate("kMGTPE"):
        tenths = n // 1000**i / 1000
        if n // 1000**i < 999_950 or prefix == "E":
            return f"{Decimal(repr(tenths)).quantize(Decimal('0.1'), ROUND_HALF_UP)} {prefix}B"


def test_scalars_format_all_has_every_order_and_branch(spark, tmp_path):
    keys = [0, 1, 2, 3, 4, 5, 58, 59, 60, 61, 999, 1416, 1417, 42_490, 42_491, 150_000, 27_027_027] + list(range(100, 140))
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    want = set()
    for k in keys:
        n = 10 ** (k % 7 * 3) * (k % 9) + k * 37 + (50 - k * 37 % 100 if k % 2 else 0)
        s = k * 61 % (30 * 86400)
        day, hour, minute, sec = s // 86400 % 24, s // 3600 % 24, s // 60 % 60, s % 60
        took = f"{day}d {hour}h {minute}m" if day else f"{hour}h {minute}m {sec}s" if hour else f"{minute}m {sec}s 500.000000ms"
        want.add((k, "CUST_KEY_OF_ORDER", si_text(n), took, f"Order#{k}"))
    got = catalogue_queries.QUERIES["scalars_format_all"](spark, str(tmp_path)).collect()
    assert len(got) == len(keys) and set(map(tuple, got)) == want
    assert {r.bytes.split(" ")[1] for r in got} >= {"B", "kB", "MB", "GB", "TB", "PB", "EB"} and {r.took[-1] + r.took.split(" ")[0][-1] for r in got} == {"md", "sh", "sm"}


def test_perspectives_reach_every_part(spark, tmp_path):
    for parts, customers in ((1500, 40), (30, 200)):
        d = f"{tmp_path}/{parts}"
        spark.createDataFrame([(i, f"B{i}") for i in range(1, parts + 1)], "p_partkey long, p_brand string").write.parquet(d + "/part.parquet")
        spark.createDataFrame([(i,) for i in range(1, customers + 1)], "c_custkey long").write.parquet(d + "/customer.parquet")
        got = catalogue_queries.QUERIES["perspective_edges_all"](spark, d).collect()
        met, sources = {r.dst for r in got}, {r.src for r in got}
        assert len(sources) == customers and len(got) <= 3 * customers + parts
        assert len(met) == parts and sum(r.result == "NEW_OBJECT" for r in got) == customers


@pytest.mark.parametrize("name", ["csv_roundtrip_all", "stream_group_commit_all"])
def test_all_kinds_pass_the_csv(spark, name):
    got = {(r.kind, r.result) for r in catalogue_queries.QUERIES[name](spark, "/root/testdata/sf0.001").collect()}
    assert got == {(k, "ok") for k in ("layer", "resource", "node", "edge", "node_attribute", "source_code")} | {("node", "error"), ("node_attribute", "error"), ("strange", "unknown")}


def test_deep_hierarchies_and_circles(spark):
    n = 1500
    rows = [(f"d{i}", f"d{i - 1}" if i else "", str(i), "T") for i in range(n)] + [(f"x{i}", f"x{(i + 1) % 70}", "x", "T") for i in range(70)] + [("t", "x3", "t", "T"), ("u", "t", "u", "T")]
    p = hierarchy.resolve_paths(spark.createDataFrame(rows, "id string, parent string, name string, type string"), ["name"])
    got = {r.id: (r.n, r.last) for r in p.select("id", F.size("path").alias("n"), F.element_at("path", -1)["name"].alias("last")).collect()}
    assert got == {f"d{i}": (i + 1, str(i)) for i in range(n)}


def test_flow_beyond_a_hundred_hops(spark):
    from revgraph.operators import flow

    e = spark.createDataFrame([(f"e{i}", "directFlow", f"n{i}", f"n{i + 1}", 1.0, 2.0) for i in range(120)], "edge_id string, type string, src string, dst string, tran_start double, tran_end double")
    assert flow.reachable(e, spark.createDataFrame([("n0",)], "id string"), 1, 1).count() == 120


def test_reach_counts_store_no_pairs_of_ends(spark, monkeypatch):
    import random

    from revgraph.operators import flow

    draw = random.Random(7)
    pairs = {(f"n{draw.randrange(30)}", f"n{draw.randrange(30)}") for _ in range(45)} | {("n1", "n2"), ("n2", "n1"), ("n3", "n3")}
    pairs |= {(f"n{i}", "hub") for i in range(30)} | {("hub", f"end{i}") for i in range(400)} | {(f"n{i}", "hot") for i in range(20)}
    e = spark.createDataFrame([(f"e{i}", "directFlow", a, b, 1.0, 2.0) for i, (a, b) in enumerate(sorted(pairs))], "edge_id string, type string, src string, dst string, tran_start double, tran_end double")
    starts = spark.createDataFrame([(f"n{i}",) for i in range(30)] + [("end1",), ("away",), ("n1",)], "id string").repartition(5)
    want = {}
    for s in {f"n{i}" for i in range(30)}:
        seen, todo = {s}, [s]
        while todo:
            x = todo.pop()
            new = {b for a, b in pairs if a == x} - seen
            seen |= new
            todo += new
        want[s] = len(seen) - 1
    rows, stored = [], flow.materialize
    monkeypatch.setattr(flow, "materialize", lambda df: (made := stored(df), rows.append(made.count()))[0])
    kept = flow.Scratch.keep
    monkeypatch.setattr(flow.Scratch, "keep", lambda self, df: (made := kept(self, df), rows.append(made.count()))[0])
    monkeypatch.setattr(flow, "HOT_ENDS", 10)
    made = flow.reach_counts(e, starts, 1, 1).collect()
    assert {r.start: r.reached for r in made} == want and len(made) == 30
    assert max(rows) < 1000 < sum(want.values())


def test_edge_buckets_share_no_node(spark):
    from revgraph.operators.partition import edge_buckets

    e = spark.createDataFrame([(f"a{i % 300}", f"b{i % 300 if i % 7 else i % 11}") for i in range(3000)], "src string, dst string").distinct()
    made = edge_buckets(e, 4).collect()
    assert len(made) == e.count()
    held = {}
    for r in made:
        if r.bucket >= 0:
            for node in r[:2]:
                held.setdefault((r.bucket // 4, node), set()).add(r.bucket)
    assert all(len(x) == 1 for x in held.values())
    assert sum(r.bucket >= 0 for r in made) > len(made) / 3  # two hashes would agree on a quarter


def test_neighbourhood_buckets_do_not_touch(spark):
    from revgraph.operators.partition import neighbourhood_buckets

    stars = [(f"hub{i % 60}", f"leaf{i}", "flow") for i in range(1800)] + [(f"leaf{i}", f"leaf{i + 1}", "flow") for i in range(0, 1800, 400)]
    e = spark.createDataFrame([*stars, ("hub0", "hub1", "perspective"), ("hub2", None, "flow")], "src string, dst string, type string")
    made = neighbourhood_buckets(e, 4, apart=F.col("type") == "perspective").collect()
    assert len(made) == e.count()
    assert [r[:2] for r in made if r.bucket == -2] == [("hub0", "hub1")]
    near, held = {}, {}
    for r in made:
        if r.bucket != -2 and r.dst is not None:
            near.setdefault(r.src, set()).add(r.dst)
            near.setdefault(r.dst, set()).add(r.src)
        if r.bucket >= 0:
            for node in r[:2]:
                held.setdefault((r.bucket // 4, node), set()).add(r.bucket)
    assert all(len(x) == 1 for x in held.values())
    for (k, node), own in held.items():
        assert all(held.get((k, other), own) == own for other in near[node])
    assert sum(r.bucket >= 0 for r in made) > len(made) / 2
    none = neighbourhood_buckets(e.limit(0), 4)
    assert none.columns == [*e.columns, "bucket"] and none.count() == 0


def test_lookups_and_start_nodes(spark):
    from revgraph.operators import lookups

    v = spark.createDataFrame([("a", "Node", "x", None), ("b", "Node", "y", ""), ("c", "Node", "y", "d")], "vertex_id string, kind string, name string, description string")
    e = spark.createDataFrame([("1", "hasParent", "b", "a", 1.0, 2.0), ("2", "perspective", "b", "c", 1.0, 2.0), ("3", "hasParent", "c", "a", 5.0, 6.0)], "edge_id string, type string, src string, dst string, tran_start double, tran_end double")
    ids = lambda df: sorted(r[0] for r in df.collect())
    assert ids(lookups.by_id(v, ["a", "c"], "Node")) == ["a", "c"] and ids(lookups.by_property(v, name="y", description=None)) == ["b"]
    assert ids(lookups.edge_by_id(e, ["2"])) == ["2"]
    top = spark.createDataFrame([("a",), ("b",)], "id string")
    assert sorted(map(tuple, lookups.children(e, top, 1, 1, perspectives=True).collect())) == [("a", "b"), ("b", "c")]
    kids = lookups.children(e, v.select(F.col("vertex_id").alias("id")), 1, 1, perspectives=True).withColumnRenamed("x", "x")
    assert sorted(map(tuple, hierarchy.start_nodes(kids, top).collect())) == [("a", "c"), ("b", "c")]
    seen, between = lookups.permitted(v, e, F.col("name") == "y")
    assert ids(seen) == ["b", "c"] and ids(between) == ["2"]
    with pytest.raises(ValueError):
        subtree.require_alive(v, e, spark.createDataFrame([("c",)], "id string"), 1)
    subtree.require_alive(v, e, spark.createDataFrame([("b",)], "id string"), 1)


def test_store_refuses_the_second_writer(spark, tmp_path):
    from revgraph.sources.store import StoreConflict

    store = Store(spark, str(tmp_path / "s"))
    store.wipe()
    since = store.current()
    edges = store.tables()["edges"]
    open_revision(store)
    assert store.tables()["edges"] == edges  # only revisions were written
    with pytest.raises(StoreConflict):
        store.write({}, since)


def test_late_sources_are_errors(spark):
    from revgraph.plans.merge import readable

    rows = [("f", 0, "source_code", ["source_code", "1", "a", "h"]), ("f", 1, "layer", ["layer", "0", "P", "P"]), ("f", 2, "source_code", ["source_code", "2", "b", "h"]), ("f", 3, "odd", ["odd"])]
    batch, wrong, unknown = readable(spark.createDataFrame(rows, "file string, line long, kind string, fields array<string>"))
    assert [r.id for r in batch["source_code"].collect()] == ["1"] and [tuple(r) for r in wrong.collect()] == [("f", 2, "source_code", "ERROR")] and unknown == 1


def test_dump_becomes_a_store(spark, tmp_path):
    from revgraph.plans.merge import import_dump

    rows = [("VERTEX", {"kind": "SUPER_ROOT", "id": 1}), ("VERTEX", {"kind": "RESOURCE", "id": 5, "name": "DB", "type": "O", "description": "x"}), ("VERTEX", {"kind": "NODE", "id": 2, "name": "srv", "type": "Server"}), ("VERTEX", {"kind": "NODE", "id": 6, "name": "tab", "type": "Table"}), ("VERTEX", {"kind": "ATTRIBUTE", "id": 3, "name": "k", "value": "v"}), ("VERTEX", {"kind": "REVISION_NODE", "id": 4, "number": 1.0, "committed": True, "commit_time": "t", "previous": -1.0, "next": -1.0})]
    rows += [("EDGE", {"src": a, "dst": b, "type": t, "tran_start": 1.0, "tran_end": 1.999999, "props": {}}) for a, b, t in ((5, 1, "hasResource"), (2, 5, "hasResource"), (6, 2, "hasParent"), (6, 3, "hasAttribute"))]
    (tmp_path / "d.zip").write_bytes(write_dump(rows))
    store = Store(spark, str(tmp_path / "store"))
    store.wipe()
    import_dump(store, str(tmp_path / "d.zip"))
    assert store.read()["revisions"].first()["number"] == 1
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("layer,0,P,P\nresource,2,DB,O,x,0\nnode,3,,srv,Server,2\nnode,4,3,tab,Table,2\nnode,5,3,new,Table,2\nnode_attribute,4,k,v\n")
    number = open_revision(store)
    report = merge_files(store, str(tmp_path / "in"), number).first()
    assert report.existed_objects["node"] == 2 and report.new_objects["node"] == 1 and report.existed_objects["node_attribute"] == report.existed_objects["resource"] == 1


@pytest.mark.parametrize("bytes_", [1, 10**9])
def test_merge_leaves_no_table_that_is_not_read(spark, monkeypatch, bytes_):
    """Tables of a merge that were read for the last time are gone: the records, what they were resolved by, the batch.
    Joins in slices, steps one after the other, give what one join gives."""
    from revgraph.plans import merge as plans
    from revgraph.plans.merge import Merge, consolidated, readable
    from revgraph.sources import store
    from revgraph.sources.store import merge_scratch

    rows = [(0, ["layer", "0", "P", "P"]), (1, ["resource", "r", "DB", "Oracle", "", "0"]), (2, ["node", "a", "", "a", "T", "r"]), (3, ["node", "b", "a", "b", "T", "r"]), (4, ["node_attribute", "a", "k", "v"]), (5, ["edge", "e", "a", "b", "DIRECT", "r"]), (6, ["edge", "w", "a", "b", "STRANGE", "r"]), (7, ["edge_attribute", "e", "K", "v"])]
    monkeypatch.setattr(plans, "SLICE", bytes_)
    monkeypatch.setattr(store, "LARGE", bytes_)
    raw, scratch, last = merge_scratch(spark), merge_scratch(spark), merge_scratch(spark)
    records = spark.createDataFrame([("f", line, x[0], x) for line, x in rows], "file string, line long, kind string, fields array<string>")
    ready = consolidated(readable(raw.by_kind(records))[0], keep=scratch.keep)
    raw.remove()
    assert len(scratch.at) == 7 and "object_id" not in ready["edge_attribute"].columns and "source" not in ready["edge"].columns
    big = {k: ready[k].inputFiles()[0] for k in ("node", "node_attribute", "edge", "edge_attribute")}
    out, results = Merge(empty(spark), {}, 1, 0, keep=scratch.keep, last=last.keep, ready=ready, drop=scratch.drop).run()
    assert not [k for k, f in big.items() if os.path.exists(f.removeprefix("file://"))]
    assert ".zstd." in out["edges"].inputFiles()[0]
    scratch.remove()
    assert sorted((r.item_type, r.result) for r in results.collect()) == [("edge", "ERROR"), ("edge", "NEW_OBJECT"), *[(k, "NEW_OBJECT") for k in ("edge_attribute", "layer", "node", "node", "node_attribute", "resource")]]
    assert {r.type: dict(r.props) for r in out["edges"].collect()}["directFlow"] == {"K": "v"}
    last.remove()


def test_store_is_written_when_the_tables_of_the_merge_are_gone(spark, tmp_path, monkeypatch):
    """Beside the store there is one folder of scratch tables while it is written: what the next snapshot stands on."""
    from revgraph.sources.store import merge_scratch

    (tmp_path / "a.csv").write_text("source_code,1,a,h\nlayer,0,P,P\nresource,2,DB,O,x,0\nnode,3,,srv,Server,2\nnode,4,3,tab,Table,2\nedge,5,3,4,DIRECT,2\n")
    store, base = Store(spark, str(tmp_path / "store")), os.path.dirname(merge_scratch(spark).path).removeprefix("file:")
    seen, folders, write = [], lambda: set(glob.glob(f"{base}/scratch-*")), Store.write
    store.wipe()
    number = open_revision(store)
    before = folders()
    monkeypatch.setattr(Store, "write", lambda self, changed, since="": (seen.append(len(folders() - before)), write(self, changed, since))[1])
    report = merge_files(store, str(tmp_path / "a.csv"), number).first()
    assert seen == [1] and not folders() - before
    assert report.new_objects["node"] == 2 and list(report.requested_source_codes) == ["1"] and store.read()["edges"].where("type = 'directFlow'").count() == 1
    assert all(".zstd." in f for f in store.read()["edges"].inputFiles())


def test_merge_makes_shared_keys_once(spark):
    """Records of edge attributes meet stored keys of edges; the joins and paths behind them are not made anew."""
    from revgraph.operators.consolidate import resolve
    from revgraph.plans.merge import readable
    from revgraph.sources.store import Scratch, materialize

    rows = [(0, ["layer", "0", "P", "P"]), (1, ["resource", "r", "DB", "Oracle", "", "0"]), (2, ["node", "a", "", "a", "T", "r"]), (3, ["node", "b", "a", "b", "T", "r"]), (4, ["edge", "e", "a", "b", "DIRECT", "r"]), (5, ["edge_attribute", "e", "K", "v"]), (6, ["strange", "x"])]
    scratch = Scratch(spark)
    records = spark.createDataFrame([("f", line, x[0], x) for line, x in rows], "file string, line long, kind string, fields array<string>")
    batch, wrong, unknown = readable(scratch.by_kind(records))
    found = resolve(batch, scratch.keep)["edge_attribute"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert "PartitionFilters: [isnotnull(kind" in batch["edge"]._jdf.queryExecution().executedPlan().toString()
    got = materialize(found).first()
    assert got["nkey"] and got["owner_key"] and unknown == 1 and not wrong.head(1)
    scratch.remove()
