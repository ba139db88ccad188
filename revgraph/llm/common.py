"""Helpers shared by the operators: shared folder, lineage cuts, Arrow mapping, prefix sums, components, meeting of equal keys, hashes."""

from __future__ import annotations

import gc
import os
import time
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own beside the warehouse where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


#: Bytes of the Arrow batches that Spark hands to Python. By default 10,000 whole texts make one, which executors hold
#: twice while it grows and Python once more.
BATCH_BYTES = 1 << 20


@contextmanager
def small_batches(spark: SparkSession):
    """What runs meanwhile gets Arrow batches of BATCH_BYTES; they divide the rows anew and leave none out."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """Materialise once in the shared folder, so that what follows neither recomputes it nor depends on one executor."""
    shared_dir(df.sparkSession)
    with small_batches(df.sparkSession):
        return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Like cut(), but as a Parquet table, for rows that later steps read by column or that discard() is to remove."""
    path = fresh_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove stored() tables that nothing reads any more: all that came of them is cut or stored itself."""
    for t in tables:
        at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


#: py4j tells the JVM of frames that are gone in a thread that looks once a second.
RELEASE_S = 1.2


def tidy(spark: SparkSession, wait: bool = False) -> None:
    """Let Spark's cleaner remove the shuffle files of frames that are gone; it waits for collections of the driver's heap.

    wait: those of the step that has just ended too, which the JVM would else still hold.
    """
    gc.collect()
    if wait:
        time.sleep(RELEASE_S)
    spark._jvm.System.gc()


def tasks_for(rows: int, each: int, spark: SparkSession) -> int:
    """Tasks for so many rows, at most as many as a shuffle has."""
    return max(1, min(partitions(spark), -(-rows // each)))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_column(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column and its n + 1 offsets; nulls must have been filled."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = wide.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if not len(wide):
        return flat[:0], np.zeros(1, np.int64)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def release_memory() -> None:
    """Give freed memory back to the system: workers stay for later stages, and their pools would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        import ctypes

        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def gathered(batches, limit_bytes: int = 1 << 20, limit_rows: int = 20_000):
    """Join small Arrow batches up to the given size: fewer, larger steps of vector work in bounded memory."""
    held, rows, size = [], 0, 0
    for batch in batches:
        step = max(1, int(batch.num_rows * limit_bytes / max(batch.nbytes, limit_bytes)))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            held.append(part)
            rows, size = rows + part.num_rows, size + part.nbytes
            if size >= limit_bytes or rows >= limit_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, rows, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
    held = batch = part = None
    release_memory()


def sliced(batches, rows: int = 200):
    """Batches of few rows, for steps that turn nested columns into Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    b = None
    release_memory()


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(","))])


def map_tables(df: DataFrame, step, ddl: str, limit_bytes: int = 1 << 20, limit_rows: int = 20_000) -> DataFrame:
    """mapInArrow with step(pa.Table) -> list of columns in the order of ddl, or None for no rows."""
    schema = arrow_schema(ddl)

    def run(batches):
        for t in gathered(batches, limit_bytes, limit_rows):
            out = step(t)
            if out is not None:
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    return df.mapInArrow(run, ddl)


def ranked(slim: DataFrame, order: list[str], size: str, n: int | None = None) -> tuple[DataFrame, int, int]:
    """Global prefix sums along an order, from per-partition totals.

    Rows are range-partitioned and sorted by `order`; each task adds its running count and running sum of `size`;
    only one total per partition reaches the driver. Adds row_index and start (the sum before the row), both global
    and gapless; also returns the number of rows and the total. Equal rows are interchangeable.
    """
    spark = slim.sparkSession
    fields = [f"{f.name} {dict(bigint='long').get(f.dataType.simpleString(), f.dataType.simpleString())}" for f in slim.schema]
    ddl = ", ".join([*fields, "range_id int", "row_index long", "start long"])

    def run(batches):
        from pyspark import TaskContext

        at, rows, total = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            sizes = np.asarray(b.column(b.schema.get_field_index(size)).to_numpy(zero_copy_only=False), np.int64)
            ends = np.cumsum(sizes) + total
            extra = [pa.array(np.full(len(sizes), at, np.int32)), pa.array(np.arange(rows, rows + len(sizes), dtype=np.int64)), pa.array(ends - sizes)]
            rows += len(sizes)
            total = int(ends[-1]) if len(ends) else total
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, "range_id", "row_index", "start"])

    local = cut(slim.repartitionByRange(n or partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(run, ddl))
    totals = sorted(map(tuple, local.groupBy("range_id").agg(F.count("*").alias("n"), F.sum(size).alias("s")).collect()))  # a row for each partition
    before, rows, total = [], 0, 0
    for k, n_rows, s in totals:
        before.append((k, rows, total))
        rows, total = rows + n_rows, total + s
    offsets = spark.createDataFrame(before, "range_id int, rows_before long, sum_before long")
    joined = local.join(F.broadcast(offsets), "range_id")  # a row for each partition
    out = joined.select(*slim.columns, (F.col("row_index") + F.col("rows_before")).alias("row_index"), (F.col("start") + F.col("sum_before")).alias("start"))
    return out, rows, total


#: Edges up to which one task finds components by itself (16 bytes each); more edges take several tasks and rounds.
EDGES_A_TASK = 1_000_000


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of some edges and, for each, the smallest id that these edges reach from it."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(ids))
    while len(x):
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    return ids, ids[root]


def contracted(edges: DataFrame, tasks: int) -> DataFrame:
    """(u, v), u > v: in each of so many tasks, stars in place of the edges (a, b) that lie there."""

    def run(batches):
        held, rows = [], 0

        def star() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            ids, roots = local_roots(t.column(0).to_numpy(), t.column(1).to_numpy())
            u = ids != roots
            return pa.RecordBatch.from_arrays([pa.array(ids[u]), pa.array(roots[u])], names=["u", "v"])

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows > 2 * EDGES_A_TASK:  # keep the stars only
                held = [star().rename_columns(["a", "b"])]
                rows = held[0].num_rows
                if rows > EDGES_A_TASK:
                    yield held[0].rename_columns(["u", "v"])
                    held, rows = [], 0
        if held:
            yield star()
        held = None
        release_memory()

    return edges.select("a", "b").coalesce(tasks).mapInArrow(run, "u long, v long")


def components(edges: DataFrame, count: int | None = None) -> DataFrame:
    """Connected components of (a, b) as (id, root), root the smallest id; for ids that have an edge.

    Every task first replaces the edges it holds by stars. EDGES_A_TASK edges or fewer lie in one task and are done;
    else alternating large-star and small-star steps follow: each round is two minimum aggregations and two joins,
    never a collected neighbourhood. The edges of a hub are held against the minimum of the hub by a join that adaptive
    execution splits. Ends when a round changes nothing.
    """
    spark = edges.sparkSession
    count = edges.count() if count is None else count
    tasks = tasks_for(count, EDGES_A_TASK, spark)
    e = cut(contracted(edges.where("a is not null and b is not null"), tasks))
    before = None
    while count > EDGES_A_TASK:
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if before == now or not now[0]:
            break
        before = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(low2.select("u", F.col("m").alias("v"))).distinct())
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v")).distinct())


# --- meeting of equal keys ----------------------------------------------------------------------------------------

#: Keys that one bucket holds on average.
KEYS_A_BUCKET = 1_500_000
ENTRY = np.dtype([("id", "<i8"), ("need", "<i4"), ("n", "<i4"), ("band", "i1")])


def _bucket_bits(count: int) -> tuple[int, int]:
    """The bits of a bucket's number, and the bytes of a key that travel beside it."""
    bits = min(23, max(2, (-(-count // KEYS_A_BUCKET)).bit_length()))
    return bits, 6 if bits <= 15 else 5


def packed_entries(entries: np.ndarray) -> bytes:
    """Entries as planes of bytes, the highest first, and ids as steps: mostly zeros, which shuffles compress."""
    planes = []
    for c in ENTRY.names:
        x = np.diff(entries[c], prepend=entries[c].dtype.type(0)) if c == "id" else np.ascontiguousarray(entries[c])
        planes.append(x.view(np.uint8).reshape(len(x), x.itemsize).T[::-1].tobytes())
    return b"".join(planes)


def unpacked_entries(raw: bytes) -> np.ndarray:
    out, at = np.empty(len(raw) // ENTRY.itemsize, ENTRY), 0
    for c in ENTRY.names:
        size = ENTRY[c].itemsize
        planes = np.frombuffer(raw, np.uint8, len(out) * size, at).reshape(size, len(out))
        x = np.ascontiguousarray(planes[::-1].T).view(ENTRY[c]).reshape(-1)
        out[c] = np.cumsum(x) if c == "id" else x
        at += len(out) * size
    return out


def pieces_of(keys: np.ndarray, count: int) -> np.ndarray:
    """What shared_keys() calls these keys."""
    bits, width = _bucket_bits(count)
    return (keys & np.uint64((1 << 8 * width) - 1) | (keys >> np.uint64(64 - bits)) << np.uint64(8 * width)).view(np.int64)


def shared_keys(rows: DataFrame, keyed, count: int) -> DataFrame:
    """(piece, id, band, need) of the keys that two or more rows of `keyed` have.

    keyed(table) gives one array of ENTRY (n: how many keys it has) and the 64-bit keys of all entries in their order;
    count: about how many keys there are, from which the number of buckets follows.

    Tasks route packed arrays of keys to buckets by value, in which equal keys meet; only shared keys leave the buckets.
    What a batch already knows to be shared goes past the buckets, in bundles of that batch, and only a mark tells the
    bucket of it: a key that a third of all rows have costs its bucket one mark for each batch. Keys travel as their
    bucket and their low 48 bits (40 with over 2**15 buckets): chance matches cost a comparison later, no result.
    """
    bits, width = _bucket_bits(count)
    mark = np.iinfo(np.int32).min  # in the place of need
    low_bits = np.uint64((1 << 8 * width) - 1)
    routed_ddl, ddl = "bucket long, entries binary, pieces binary", "piece long, id long, band int, need long"
    out, made = arrow_schema(routed_ddl), arrow_schema(ddl)

    def packed(bucket: int, meta: np.ndarray, at: np.ndarray, pieces: np.ndarray, marks: int = 0) -> pa.RecordBatch:
        """One row; at: the sorted owners of the pieces that no mark stands for, which come last."""
        who, n = np.unique(at, return_counts=True)
        entries = meta[who]
        entries["n"] = n
        if marks:
            entries = np.append(entries, np.array([(0, mark, marks, 0)], ENTRY))
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([packed_entries(entries)], pa.binary()), pa.array([pieces.tobytes()], pa.binary())], schema=out)

    def route(batches):
        from pyspark import TaskContext

        bundle = -1 - (TaskContext.get().partitionId() << 32)  # below 0 and of its own for each batch
        for t in gathered(batches, 1 << 20, 20_000):
            meta, key = keyed(t)
            if not len(key):
                continue
            at = np.repeat(np.arange(len(meta), dtype=np.int32), meta["n"])
            order = np.argsort(key)
            key, at = key[order], at[order]
            first = np.ones(len(key) + 1, bool)
            first[1:-1] = key[1:] != key[:-1]
            twice = ~(first[:-1] & first[1:])
            bucket = (key >> np.uint64(64 - bits)).astype(np.int64)
            if twice.any():
                order = np.flatnonzero(twice)[np.argsort(at[twice], kind="stable")]
                yield packed(bundle, meta, at[order], (key[order] & low_bits).view(np.int64) | bucket[order] << 8 * width)
                bundle -= 1
            marked = twice & first[:-1]
            keep = np.flatnonzero(~twice | marked)
            key, at, bucket = key[keep], np.where(marked[keep], len(meta), at[keep]), bucket[keep]
            order = np.lexsort((at, bucket))
            key, at, bucket = key[order], at[order], bucket[order]
            found, edges = np.unique(bucket, return_index=True)
            narrow = key.view(np.uint8).reshape(-1, 8)[:, :width]
            for b, lo, hi in zip(found.tolist(), edges.tolist(), [*edges[1:].tolist(), len(bucket)], strict=True):
                real = int(np.searchsorted(at[lo:hi], len(meta)))
                yield packed(b, meta, at[lo : lo + real], narrow[lo:hi], hi - lo - real)

    def meet(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        parts = np.concatenate([unpacked_entries(x.as_py()) for x in t.column("entries")])
        at = np.repeat(np.arange(len(parts), dtype=np.int32), parts["n"])
        if bucket < 0:
            piece = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in t.column("pieces")])
        else:
            key = []
            for x in t.column("pieces"):
                narrow = np.frombuffer(x.as_py(), np.uint8).reshape(-1, width)
                wide = np.zeros((len(narrow), 8), np.uint8)
                wide[:, :width] = narrow
                key.append(wide.view(np.uint64)[:, 0])
            key = np.concatenate(key)
            order = np.argsort(key, kind="stable")
            key, at = key[order], at[order]
            # shared: of two entries, or of one and another batch's mark
            same = np.zeros(len(key), bool)
            same[1:] = key[1:] == key[:-1]
            same[:-1] |= same[1:]
            same &= parts["need"][at] != mark
            piece, at = key[same].view(np.int64) | bucket << 8 * width, at[same]
        found = parts[at]
        return pa.table([piece, found["id"], found["band"].astype(np.int32), found["need"].astype(np.int64)], schema=made)

    return rows.mapInArrow(route, routed_ddl).groupBy("bucket").applyInArrow(meet, ddl)


# --- vector hashing of byte buffers -------------------------------------------------------------------------------

#: Bytes of a buffer up to which a worker keeps the powers for it (20 bytes each): idle workers hold them through later stages.
KEPT = 1 << 20


def _constants(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    powers, inverses = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    powers[0] = inverses[0] = 1
    return np.cumprod(powers, dtype=np.uint64), np.cumprod(inverses, dtype=np.uint64)


class PrefixHash:
    """Polynomial hashes modulo 2**64 of any substrings of a buffer, from prefix sums; each byte counts by a random word.

    For choosing places only, where equal hashes of different strings cost a comparison and no result: strings of over
    1,000 bytes with much structure can collide. What decides equality uses PrimeHash or word_hashes.
    """

    BASE = 0x9E3779B97F4A7C15 | 5
    _powers: tuple[np.ndarray, np.ndarray] | None = None
    _words: dict[int, np.ndarray] = {}

    def __init__(self, data: np.ndarray, seed: int = 1):
        n = len(data) + 1
        powers = PrefixHash._powers
        if powers is None or len(powers[0]) < n:
            powers = _constants(max(n, 1 << 16) * 5 // 4, self.BASE)
            if n <= KEPT:
                PrefixHash._powers = powers
        if seed not in self._words:
            self._words[seed] = np.random.default_rng(seed).integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.inverses = powers[1]
        self.sums = np.zeros(n, np.uint64)
        counted = self._words[seed][data]
        counted *= powers[0][: n - 1]
        np.cumsum(counted, out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.inverses[starts]

    def windows(self, k: int) -> np.ndarray:
        """The hash of every window of k bytes."""
        n = len(self.sums) - k
        return (self.sums[k:] - self.sums[:n]) * self.inverses[:n] if n > 0 else np.zeros(0, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread all bits (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_P, _LOW31, _LOW30 = np.uint64((1 << 61) - 1), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)


def _folded(x: np.ndarray) -> np.ndarray:
    x = (x >> np.uint64(61)) + (x & _P)
    return np.where(x >= _P, x - _P, x)


#: Numbers that are multiplied at once, which bounds what is held between the steps.
STEP = 1 << 16


def times_p(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2**61 - 1 of numbers below it."""
    if len(a) > STEP:
        out = np.empty(len(a), np.uint64)
        for k in range(0, len(a), STEP):
            out[k : k + STEP] = times_p(a[k : k + STEP], b if len(b) == 1 else b[k : k + STEP])
        return out
    a1, a0, b1, b0 = a >> np.uint64(31), a & _LOW31, b >> np.uint64(31), b & _LOW31
    middle = a0 * b1 + a1 * b0
    return _folded(np.uint64(2) * a1 * b1 + (middle >> np.uint64(30)) + ((middle & _LOW30) << np.uint64(31)) + a0 * b0)


class PrimeHash:
    """Polynomial hashes modulo the prime 2**61 - 1 of any substrings of a buffer; base and byte values are random."""

    _powers: tuple[np.ndarray, np.ndarray] | None = None

    def __init__(self, data: np.ndarray, seed: int = 1):
        n = len(data) + 1
        if PrimeHash._powers is None or len(PrimeHash._powers[0]) < n:
            made = self._made(max(n, 1 << 16) * 5 // 4)
            if n <= KEPT:
                PrimeHash._powers = made
        else:
            made = PrimeHash._powers
        words = np.random.default_rng(seed).integers(1, int(_P), size=256, dtype=np.uint64)
        self.inverses = made[1]
        self.sums = np.zeros(n, np.uint64)
        high = low = np.uint64(0)
        for k in range(0, n - 1, STEP):
            counted = times_p(words[data[k : k + STEP]], made[0][k : k + len(data[k : k + STEP])])
            highs, lows = np.cumsum(counted >> np.uint64(31)) + high, np.cumsum(counted & _LOW31) + low
            high, low = highs[-1], lows[-1]
            self.sums[k + 1 : k + 1 + len(counted)] = _folded(times_p(_folded(highs), np.full(1, 1 << 31, np.uint64)) + _folded(lows))

    @staticmethod
    def _made(n: int) -> tuple[np.ndarray, np.ndarray]:
        base = int(np.random.default_rng(61).integers(1 << 60, int(_P)))
        out = []
        for b in (base, pow(base, -1, int(_P))):
            x, size = np.ones(n, np.uint64), 1
            while size < n:  # doubling: the next powers are the first ones times base ** size
                more = min(size, n - size)
                x[size : size + more] = times_p(x[:more], np.full(1, pow(b, size, int(_P)), np.uint64))
                size += more
            out.append(x)
        return out[0], out[1]

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return times_p(_folded(self.sums[ends] + _P - self.sums[starts]), self.inverses[starts])


#: Words up to so many bytes are hashed by steps of eight bytes; longer ones one by one.
LONG_WORD = 256


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of short strings of a buffer: eight bytes at a time, all bits mixed after each step."""
    size = ends - starts
    out = mixed(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    at, done = np.flatnonzero(size <= LONG_WORD), 0
    while True:
        at = at[size[at] > done]
        if not len(at):
            break
        block, left = eight[starts[at] + done], np.minimum(size[at] - done, 8).astype(np.uint64)
        block &= np.uint64((1 << 64) - 1) >> (np.uint64(64) - left * np.uint64(8))
        out[at] = mixed((out[at] ^ block) + np.uint64(0x9E3779B97F4A7C15))
        done += 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, from running minima of blocks in both directions."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    block = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(block, axis=1).reshape(-1)
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return np.frombuffer(data.tobytes().lower(), np.uint8)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return os.path.join(os.path.dirname(public_tokenizers.__file__), name)
