"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct 5-word shingles. Each set is sketched per size band: the shingles' hashes fall into
P pieces and each piece keeps the exclusive-or of its hashes, so one differing shingle changes one piece, and the number
of differing pieces is a lower bound of the symmetric difference. Sets of sizes a and b with similarity 3/4 or more
differ in D = (a + b) / 7 shingles at most; hence a set with more than D non-empty pieces shares at least
(non-empty - D) of them with any partner. Pigeonhole join: equal pieces of a band meet by their value; a document
whose shared pieces are fewer than that bound has no partner and leaves.

What stays is linked through verified pairs only: pairs whose fixed-size parity sketches (SKETCH bits) differ in D bits
at most are compared on their whole sets. First every piece's smallest id is paired with its other documents, and
connected components follow. A piece whose documents then lie in one component is done. In the others the sketches of
all documents are compared in blocks inside a task, and pairs across components that pass go on to verification: the
first ROUND partners of a document, and as long as such pairs are left, GROW times as many more. Components are
found anew after every turn, so documents that a turn has linked cost no further pairs; turns go by the places of
partners among all that passed at first, so no pair is lost or comes twice. Hot pieces are cut into block pairs, and
nothing is dropped.

Bands double in size. The smaller set of a pair is of its own band; the larger one of that band or the next, so sets
near a band's lower end are sketched in the band below too. Below SINGLE shingles every shingle is a piece of its own,
which makes the bound hold without exception; above, P is chosen so that the expected number of non-empty pieces
exceeds D by ten standard deviations or more.

Documents with equal sets form one class beforehand. Null texts and texts without words have the empty set and link
with nothing; null doc_ids form no links; repeated rows share their class; an empty table gives no rows; extra columns
are ignored by `near_duplicates` and returned by `keep_one`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revgraph.llm.common import ENTRY, KEYS_A_BUCKET, arrow_schema, components, cut, discard, free_name, gathered, lowered, map_tables, mixed, shared_keys, sliced, stored, tasks_for, text_buffer, text_column, tidy, word_hashes

WORDS = 5
SINGLE, DENSE = 64, 512
ROUND, GROW, BLOCK, SKETCH = 4, 8, 4096, 1024
#: Rows of pieces, and pairs to verify, for which one task suffices.
ROWS_A_TASK, PAIRS_A_TASK = 200_000, 20_000
#: Ids up to which a list of documents is broadcast (8 bytes each), and rows up to which their sketches are
#: (some 150 bytes each); beyond, they join by a shuffle.
BROADCAST_IDS, BROADCAST_SKETCHES = 1_000_000, 100_000
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True


def shingle_sets(column) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 64-bit shingle hashes of all texts, sorted within each, and the n + 1 offsets."""
    data, offsets = text_buffer(column)
    n = len(offsets) - 1
    data = lowered(data)
    gap = np.ones(len(data) + 1, bool)
    gap[:-1] = _SPACES[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = ~gap[:-1]
    begins[1:] &= gap[:-2] | edge[1:-1]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(gap | edge)
    ends = ends[np.searchsorted(ends, starts, side="right")]
    word = word_hashes(data, starts, ends)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    first = np.searchsorted(doc, np.arange(n + 1))  # words of each document
    counts = np.diff(first)
    factors = mixed(np.arange(1, WORDS + 1, dtype=np.uint64))
    shingle = np.zeros(max(0, len(word) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        shingle += word[k : k + len(shingle)] * factors[k]
    keep = np.zeros(len(shingle), bool)
    if len(shingle):
        keep = doc[: len(shingle)] == doc[WORDS - 1 :]
    owner, values = doc[: len(shingle)][keep], mixed(shingle[keep])
    short = np.flatnonzero((counts > 0) & (counts < WORDS))
    if len(short):  # the whole sequence as one shingle
        whole = np.array([mixed(np.array([sum(int(word[first[d] + k]) * int(factors[k]) for k in range(counts[d])) + int(counts[d]) & (1 << 64) - 1], np.uint64))[0] for d in short], np.uint64)
        owner, values = np.concatenate([owner, short]), np.concatenate([values, whole])
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.ones(len(values), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    owner, values = owner[new], values[new]
    return values, np.searchsorted(owner, np.arange(n + 1))


def bands(n: int) -> list[tuple[int, int, int]]:
    """(band, pieces, D) for each band that sets of n shingles are sketched in; pieces 0: every shingle is one.

    In its own band a set may be the smaller of a pair (partners up to 4n/3); in the band below it is the larger.
    """
    own = n.bit_length() - 1
    out = [(own, n // 3)]
    if own and 3 * n <= 4 * ((1 << own) - 1):
        out.append((own - 1, ((1 << own) - 1 + n) // 7))
    return [(b, 0 if 1 << b < SINGLE else (1 << b) * (2 if 1 << b < DENSE else 1), d) for b, d in out]


def sketch(values: np.ndarray, band: int, pieces: int) -> np.ndarray:
    """The values of the non-empty pieces of one set's parity sketch, each mixed with its band and place."""
    if not pieces:
        return mixed(values ^ np.uint64(band + 1))
    place = values >> np.uint64(64 - (pieces.bit_length() - 1))  # values are sorted, so pieces are runs
    edge = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return mixed(np.bitwise_xor.reduceat(mixed(values), edge) + mixed(place[edge] ^ np.uint64((band + 1) << 40)))


def _sets(t: pa.Table):
    values, offsets = shingle_sets(t.column("text"))
    sizes = np.diff(offsets)
    sums = np.zeros((2, len(values) + 1), np.uint64)
    np.cumsum(values, out=sums[0, 1:])
    np.cumsum(mixed(values ^ np.uint64(0x5BD1E995)), out=sums[1, 1:])
    marks = sums[:, offsets[1:]] - sums[:, offsets[:-1]]
    return [t.column("doc_id").combine_chunks(), sizes.astype(np.int64), marks[0].view(np.int64), marks[1].view(np.int64)]


def set_classes(read: DataFrame) -> DataFrame:
    """doc_id, n_shingles, mark, mark2 of every row; rows with equal marks have equal sets."""
    return map_tables(read, _sets, "doc_id long, n_shingles long, mark long, mark2 long")


def _sketched(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of the sketches of a batch, with their documents, bands and how many any partner must share."""
    values, offsets = shingle_sets(t.column("text"))
    ids = np.asarray(t.column("doc_id"))
    keys, owner = [np.zeros(0, np.uint64)], []
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if b > a:
            for band, pieces, d in bands(b - a):
                piece = sketch(values[a:b], band, pieces)
                keys.append(piece)
                owner.append((ids[i], len(piece) - d, len(piece), band))
    return np.array(owner, ENTRY), np.concatenate(keys)


def shared_pieces(texts: DataFrame, shingles: int = KEYS_A_BUCKET) -> DataFrame:
    """(piece, id, band, need) of the sketch pieces that two or more documents have; need: how many each must share."""
    return shared_keys(texts.select("doc_id", "text"), _sketched, 3 * shingles // 2)  # some sets are in two bands


def _few(ids: DataFrame):
    """Broadcast a checkpointed list when its counted size allows, else leave the join to a shuffle."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def shared_groups(texts: DataFrame, shingles: int) -> DataFrame:
    """(piece, id, low, n): the documents that meet in a piece, for documents that share enough pieces to have a partner.

    Pieces that the same documents share say the same, so one of them stands for all.
    """
    shared = stored(shared_pieces(texts, shingles), "pieces")
    enough = cut(shared.groupBy("id", "band").agg(F.count("*").alias("n"), F.first("need").alias("least")).where("n >= least").select("id", "band"))
    left = shared.join(_few(enough), ["id", "band"], "left_semi")
    groups = left.groupBy("piece").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("mark"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("mark2")).where("low <> high")
    one = cut(groups.groupBy("low", "high", "n", "mark", "mark2").agg(F.min("piece").alias("piece")).select("piece", "low", "n"))
    out = stored(left.select("piece", "id").join(_few(one), "piece").distinct(), "members")
    discard(shared)
    return out


def _packed_sets(t: pa.Table):
    """id, n, a parity sketch of SKETCH bits, and the set's sorted shingle hashes."""
    values, offsets = shingle_sets(t.column("text"))
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    bits = np.bincount(owner * SKETCH + (mixed(values) >> np.uint64(64 - (SKETCH.bit_length() - 1))).astype(np.int64), minlength=len(sizes) * SKETCH) & 1
    packed = np.packbits(bits.astype(np.uint8).reshape(-1, SKETCH), axis=1)
    return [t.column("doc_id").combine_chunks(), sizes.astype(np.int64), [x.tobytes() for x in packed], [values[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]]


def sketch_matrix(column) -> np.ndarray:
    """Sketches as rows of 64-bit words."""
    return text_buffer(column)[0].view(np.uint64).reshape(-1, SKETCH // 64)


def passing(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Whether sketches and sizes allow a similarity of 3/4; x and y broadcast against each other."""
    differ = np.zeros(np.broadcast_shapes(x.shape[:-1], y.shape[:-1]), np.int32)
    for w in range(x.shape[-1]):
        differ += np.bitwise_count(x[..., w] ^ y[..., w])
    return (differ <= (nx + ny) // 7) & (100 * np.minimum(nx, ny) >= 75 * np.maximum(nx, ny))


def plausible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) that their sketches allow."""

    def check(batches):
        for b in sliced(batches, 2000):
            ok = passing(sketch_matrix(b.column(2)), np.asarray(b.column(3)), sketch_matrix(b.column(4)), np.asarray(b.column(5)))
            mask = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])

    one, two = (sketches.select(F.col("id").alias(c), F.col("sketch").alias("s" + c), F.col("n").alias("n" + c)) for c in "ab")
    return pairs.join(two, "b").join(one, "a").select("a", "b", "sa", "na", "sb", "nb").mapInArrow(check, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets have a Jaccard similarity of 3/4 or more."""
    ddl = "a long, b long"
    schema = arrow_schema(ddl)

    def check(batches):
        for batch in sliced(batches, 500):
            keep = []
            last, one = None, None
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                raw = x.as_py()
                if raw != last:
                    last, one = raw, np.frombuffer(raw, np.uint64)
                two = np.frombuffer(y.as_py(), np.uint64)
                m, n = len(one), len(two)
                at = np.searchsorted(one, two)
                both = int((one[np.minimum(at, m - 1)] == two).sum())
                keep.append(100 * both >= 75 * (m + n - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], schema=schema)

    left, right = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb").mapInArrow(check, ddl)


def crossing(members: DataFrame, sketches: DataFrame, low: int, high: int) -> DataFrame:
    """(a, b, more): pairs of a piece across components that their sketches allow, a document's partners low to high.

    members: piece, id, n (of the piece), first_root, root. Partners are numbered across the first components, the same
    in every turn, so turns never overlap; pairs that root has since joined are left out. more tells that a later turn
    has pairs.
    """
    few = sketches.count() <= BROADCAST_SKETCHES
    drawn = sketches.withColumnRenamed("n", "size")
    rows = members.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).select("piece", "i", "j", "block", "id", "first_root", "root")
    if not few:
        rows = rows.join(drawn, "id")
    rows = rows.repartition("piece", "i", "j")
    if few:
        rows = rows.join(F.broadcast(drawn), "id")
    rows = rows.sortWithinPartitions("piece", "i", "j", "id")  # last: a sort below a join may be optimised away
    schema = arrow_schema("a long, b long, more boolean")

    def compare(t: pa.Table) -> pa.RecordBatch:
        ids, firsts, roots, size, block = (np.asarray(t.column(c)) for c in ("id", "first_root", "root", "size", "block"))
        s = sketch_matrix(t.column("sketch"))
        keys = np.stack([np.asarray(t.column(c), np.int64) for c in ("piece", "i", "j")])
        edge = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0), [True]]))
        out_a, out_b, more = [], [], False
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if (roots[lo:hi] == roots[lo]).all():
                continue
            i, j = keys[1, lo], keys[2, lo]
            left, right = lo + np.flatnonzero(block[lo:hi] == i), lo + np.flatnonzero(block[lo:hi] == j)
            if not len(left) or not len(right):
                continue
            for at in range(0, len(left), 256):
                u = left[at : at + 256]
                ok = np.concatenate([passing(s[u][:, None], size[u][:, None], s[right[k : k + 2048]][None], size[right[k : k + 2048]][None]) for k in range(0, len(right), 2048)], axis=1)
                if i == j:
                    ok &= ids[u][:, None] < ids[right][None]
                ok &= firsts[u][:, None] != firsts[right][None]
                place = np.cumsum(ok, axis=1)
                ok &= (roots[u][:, None] != roots[right][None]) & (place > low)
                more |= bool((ok & (place > high)).any())
                r, c = np.nonzero(ok & (place <= high))
                out_a.append(ids[u][r])
                out_b.append(ids[right][c])
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (out_a, out_b))
        if more:
            a, b = np.append(a, -1), np.append(b, -1)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array((np.arange(len(a)) == len(a) - 1) & more)], schema=schema)

    def run(batches):
        held = None
        for t in gathered(batches, 2 << 20, 1 << 30):
            t = t.select(["piece", "i", "j", "block", "id", "first_root", "root", "size", "sketch"])
            held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            last = tuple(held.column(c)[-1].as_py() for c in ("piece", "i", "j"))
            piece, i, j = (np.asarray(held.column(c)) for c in ("piece", "i", "j"))
            done = np.flatnonzero((piece != last[0]) | (i != last[1]) | (j != last[2]))
            whole = int(done[-1]) + 1 if len(done) else 0  # the last group may go on
            if whole:
                yield compare(held.slice(0, whole).combine_chunks())
                held = held.slice(whole).combine_chunks()
        if held is not None and held.num_rows:
            yield compare(held)

    return rows.mapInArrow(run, "a long, b long, more boolean")


def linked_ids(texts: DataFrame, shingles: int) -> DataFrame:
    """(id, root) of every document that is linked with another.

    texts: doc_id, text, one row for each class; shingles: how many they have together.
    """
    spark = texts.sparkSession
    members = shared_groups(texts, shingles)
    ids = cut(members.select("id").distinct())
    sets = stored(map_tables(texts.join(_few(ids), texts["doc_id"] == ids["id"], "left_semi"), _packed_sets, "id long, n long, sketch binary, shingles binary", 1 << 20, 1000), "sets")
    sketches = sets.select("id", "n", "sketch")
    pairs = plausible(members.where("id > low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct(), sketches)
    links = cut(verified(pairs, sets))
    roots = components(links)
    rest = members.where("id > low").select("piece", "id", "n")  # the smallest ids' pairs are settled
    rooted = rest.join(roots, "id", "left").select("piece", "id", "n", F.coalesce("root", "id").alias("first_root")).withColumn("root", F.col("first_root"))
    rooted, rows = _open(rooted)
    discard(members)
    low, high, more = 0, ROUND, rows > 0
    while more:
        tidy(spark)
        found = cut(crossing(rooted, sketches, low, high).groupBy("a", "b").agg(F.max("more").alias("more")))
        counted = found.groupBy("more").count().collect()  # at most two rows
        more = any(r["more"] for r in counted)
        count = sum(r["count"] for r in counted if not r["more"])
        if count:
            new = cut(verified(found.where("not more").select("a", "b").coalesce(tasks_for(count, PAIRS_A_TASK, spark)), sets))
            if new.head(1):
                links = cut(roots.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(new))
                roots = components(links)
                if more:
                    rooted, rows = _open(rooted.drop("root").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")))
        low, high = high, high * GROW
    discard(sets)
    return roots


def _open(rooted: DataFrame) -> tuple[DataFrame, int]:
    """The members of pieces whose documents do not yet lie in one component, and their number."""
    left = cut(rooted.groupBy("piece").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("piece"))
    out = cut(rooted.join(_few(left), "piece", "left_semi"))
    rows = out.count()
    return out.coalesce(tasks_for(rows, ROWS_A_TASK, out.sparkSession)), rows


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column())
    slim = stored(set_classes(read), "sets")
    shingles = slim.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    full = slim.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("n_shingles", "mark", "mark2").agg(F.min("doc_id").alias("class_id"), F.max("doc_id").alias("high"))
    copies = cut(classes.where("class_id <> high").drop("high"))
    spare = cut(full.join(copies, ["n_shingles", "mark", "mark2"]).where("doc_id <> class_id").select("doc_id").distinct())
    texts = read.where("doc_id is not null").join(_few(spare), "doc_id", "left_anti")
    roots = linked_ids(texts, shingles)
    return (
        slim.join(copies, ["n_shingles", "mark", "mark2"], "left")
        .withColumn("id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")))
        .join(roots, "id", "left")
        .select("doc_id", "n_shingles", F.coalesce("root", "id").alias("component_id"))
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """All columns of one document of each group: the smallest doc_id; rows without links stay."""
    mark = free_name(docs, "gone_id")
    gone = cut(near_duplicates(docs).where("doc_id <> component_id").select(F.col("doc_id").alias(mark)).distinct())
    return docs.join(_few(gone), docs["doc_id"].cast("long") == gone[mark], "left_anti")
