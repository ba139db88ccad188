"""Snapshots: immutable Parquet directories and numbered pointers to the current ones."""

from __future__ import annotations

import gc
import json
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revgraph.functions.scalars import content_id
from revgraph.model import EDGES, LAYOUTS, REVISIONS, ROOTS, VERTICES

TABLES = {"vertices": VERTICES, "edges": EDGES, "revisions": REVISIONS}


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared")
    return df.checkpoint(eager=True)


#: Bytes of a scratch folder beyond which steps keep the cores busy by themselves, and their shuffle files count.
LARGE = 32_000_000


def together(*steps, keep: Callable | None = None) -> list:
    """The results of steps that do not wait for each other, whose plans and small jobs would leave most cores idle; one
    after the other where the scratch folder that they keep their tables in is large already."""
    at = getattr(keep, "__self__", None)
    if isinstance(at, Scratch) and at.size() > LARGE:
        return [s() for s in steps]
    with ThreadPoolExecutor(max(1, len(steps))) as pool:
        return [x.result() for x in [pool.submit(s) for s in steps]]


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder, if it is there."""
    fs, at = _folder(spark, path)
    fs.delete(at, True)


#: Seconds between collections of the driver's garbage during a merge.
TIDY_S = 5


class Scratch:
    """A folder of Parquet tables in the shared checkpoint folder, smaller than checkpoints; its user removes it.

    every: seconds between the collections of the driver's garbage, without which shuffle files of what was written stay.
    codec: of the Parquet files; the session's by default.
    """

    def __init__(self, spark: SparkSession, every: float = 0, codec: str | None = None):
        self.every, self.codec, self.tidied, self.at = every, codec, time.monotonic(), WeakKeyDictionary()
        self.spark, base = spark, spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
        self.path = f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"

    def by_kind(self, records: DataFrame) -> DataFrame:
        """The records in a folder for each kind of LAYOUTS, so that a kind is read by itself; other kinds become `-`."""
        return self.keep(records.withColumn("kind", F.when(F.col("kind").isin(*LAYOUTS), F.col("kind")).otherwise("-")), "kind")

    def keep(self, df: DataFrame, folders: str | None = None) -> DataFrame:
        path = f"{self.path}/{uuid.uuid4().hex}"
        (df.write.partitionBy(folders) if folders else df.write).parquet(path, compression=self.codec)
        if time.monotonic() - self.tidied >= self.every:
            gc.collect()
            self.spark._jvm.System.gc()
            self.tidied = time.monotonic()
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.at[kept] = path
        return kept

    def size(self) -> int:
        """Bytes of all its tables."""
        fs, at = _folder(self.spark, self.path)
        return fs.getContentSummary(at).getLength() if fs.exists(at) else 0

    def drop(self, kept: DataFrame) -> None:
        """Remove a table that nothing reads again; others than those that keep() returned stay as they are."""
        if path := self.at.pop(kept, None):
            remove(self.spark, path)

    def remove(self) -> None:
        remove(self.spark, self.path)


def merge_scratch(spark: SparkSession) -> Scratch:
    """For the tables of a merge: most of their bytes are ids in hexadecimal, which Snappy does not shorten."""
    return Scratch(spark, TIDY_S, "zstd")


@contextmanager
def brief(keep: Callable) -> Iterator[Callable]:
    """A keep like the given one whose tables go at the end, if it is that of a scratch folder."""
    at = getattr(keep, "__self__", None)
    if not isinstance(at, Scratch):
        yield keep
        return
    own = Scratch(at.spark, at.every, at.codec)
    try:
        yield own.keep
    finally:
        own.remove()


def empty(spark: SparkSession) -> dict[str, DataFrame]:
    """An empty repository: the three root vertices, no edges, no revisions."""
    out = {k: spark.createDataFrame([], v) for k, v in TABLES.items()}
    roots = spark.createDataFrame([(k, k) for k in ROOTS], "kind string, nkey string")
    out["vertices"] = roots.select(content_id(F.col("kind")).alias("vertex_id"), "kind", "nkey", F.col("kind").alias("name"), F.col("kind").alias("type"), *[F.lit(None).cast("string").alias(c) for c in ("description", "value", "resource_id")])
    return out


def ensure_roots(snapshot: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Add the root vertices that are missing."""
    roots = empty(snapshot["vertices"].sparkSession)["vertices"]
    return snapshot | {"vertices": snapshot["vertices"].unionByName(roots.join(snapshot["vertices"], "vertex_id", "left_anti"))}


class StoreConflict(RuntimeError):
    pass


class Store:
    """A repository directory. Readers follow the newest numbered pointer, which names the directory of each table; a
    failed write leaves it where it was. Of two writers that start from one pointer the second is refused."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def current(self) -> str | None:
        """The name of the newest pointer."""
        fs, path = self._fs()
        if not fs.exists(path(f"{self.path}/current")):
            return None
        names = [x.getPath().getName() for x in fs.listStatus(path(f"{self.path}/current"))]
        return max((n for n in names if not n.startswith((".", "_"))), default=None)

    def tables(self) -> dict[str, str]:
        """The directory of each table."""
        at = self.current()
        if at is None:
            return {}
        fs, path = self._fs()
        stream = fs.open(path(f"{self.path}/current/{at}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self) -> dict[str, DataFrame]:
        at = self.tables()
        return {k: self.spark.read.schema(v).parquet(f"{self.path}/{at[k]}") for k, v in TABLES.items()} if at else empty(self.spark)

    def write(self, changed: dict[str, DataFrame], since: str | None = "") -> str:
        """Write the changed tables, edges partitioned by type, then move the pointer; other tables stay where they are.

        since: the pointer that the change was made from; the current one by default.
        """
        name = uuid.uuid4().hex
        since = self.current() if since == "" else since
        at = self.tables()

        def put(k: str) -> None:
            table = changed[k] if k in changed else empty(self.spark)[k]
            w = table.select(*_names(k)).write
            (w.partitionBy("type") if k == "edges" else w).parquet(f"{self.path}/{name}/{k}", compression="zstd")

        written = [k for k in TABLES if k in changed or k not in at]
        together(*[lambda k=k: put(k) for k in written])
        at |= {k: f"{name}/{k}" for k in written}
        fs, path = self._fs()
        n = 0 if since is None else int(since) + 1
        fs.mkdirs(path(f"{self.path}/current"))
        target = path(f"{self.path}/current/{n:08d}")
        if fs.exists(target):
            raise StoreConflict(f"another writer has moved the pointer beyond {since}")
        try:
            out = fs.create(target, False)  # fails where the pointer exists
        except Exception as e:
            raise StoreConflict(f"another writer has moved the pointer beyond {since}") from e
        out.write(json.dumps(at).encode())
        out.close()
        return name

    def wipe(self) -> None:
        self.write(empty(self.spark))


def _names(table: str) -> list[str]:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(TABLES[table]).names
