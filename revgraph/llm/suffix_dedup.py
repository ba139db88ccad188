"""Suffix-array dedup of bytes: strings of WINDOW bytes that start at two places are removed wherever they lie.

Exact copies of texts are settled by their digest: of a text that occurs twice every window is repeated. One text of
each such class goes on with the others.

Every window is assigned the smallest hash among its substrings of GRAM bytes (its anchor); equal windows have equal
anchors at equal offsets, so only windows of equal anchors need comparing, and consecutive windows of one anchor form
a span. Spans whose bytes are equal, as their 128-bit BLAKE2b digests tell, repeat as a whole. Spans that equal no
other but share their anchor are settled by suffix sorting: around each anchor, the suffixes to the right and the
reversed prefixes to the left are put in order by a merge sort whose comparisons find the common extension by binary
search over prefix polynomial hashes (modulo a prime). The extensions to the neighbours in order bound the windows that
can be repeated; those are matched by hash and verified byte by byte.

The suffixes of an anchor that more than HOT different spans share would not fit one task; there the windows themselves
are rows that meet by the digests of their bytes, with the same result. All joins are by key on the engine, whole texts
are read, and strings are judged on the input.

`without_repeats` can judge passages by words as well: every word becomes WORD_BYTES letters of its 64-bit hash, and the
same search runs over these letters with a window of that many words; matches are exact up to equal 48-bit word hashes.
What either search finds in the input is removed.

Null texts count as empty; texts shorter than the window keep every byte; rows whose doc_id is null or stands with
several texts are told apart by their text; repeated rows are copies of each other; an empty table gives no rows; extra
columns, whatever their names, are ignored by `removals` and returned by `without_repeats`.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revgraph.llm.common import PrefixHash, PrimeHash, arrow_schema, cut, discard, free_name, gathered, map_tables, mixed, sliced, sliding_min, stored, text_buffer, text_column

WINDOW, GRAM = 400, 64
HOT = 20_000
WORD_BYTES = 8
_WORD = re.compile(r"\S+")
#: Bytes that are hashed at once, and bytes of texts that make a batch for it.
SEGMENT = 1 << 18
#: Ids up to which a list of documents is broadcast (8 bytes each); beyond, it joins by a shuffle.
BROADCAST_IDS = 1_000_000
#: Spans from which a class of equal ones is common: its rows meet the class where they lie, or over SALTS tasks.
COMMON, SALTS = 1_000, 64
_LOW = np.uint64((1 << 24) - 1)


def anchors(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """(text, anchor hash, span digest, first start, last start, anchor) of every span; places within the text."""
    out = []
    raw = memoryview(data)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    for s in range(0, len(data), SEGMENT):
        part = data[s : s + SEGMENT + window - 1]
        if len(part) < window:
            break
        n = len(part) - window + 1
        grams = mixed(PrefixHash(part, 21).windows(gram))
        low = sliding_min((grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64), window - gram + 1)
        at = np.flatnonzero(ends[s : s + n] - np.arange(s, s + n) >= window)
        if not len(at):
            continue
        p = (low[at] & _LOW).astype(np.int64)
        new = np.ones(len(at) + 1, bool)
        new[1:-1] = (p[1:] != p[:-1]) | (at[1:] != at[:-1] + 1)
        edge = np.flatnonzero(new)
        first, last, p = at[edge[:-1]], at[edge[1:] - 1], p[edge[:-1]]
        doc = np.searchsorted(offsets, first + s, side="right") - 1
        base = offsets[doc] - s
        out.append((doc, grams[p].view(np.int64), digests(raw, first + s, last + s + window), first - base, last - base, p - base))
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else None


def digests(raw, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """128-bit BLAKE2b digests of parts of a buffer."""
    out = np.empty(len(starts), object)
    out[:] = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
    return out


class Suffixes:
    """Suffixes of one buffer, each ending at its own stop, compared by the common extension of prefix hashes."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray):
        self.data, self.starts, self.lengths = data, starts, stops - starts
        self.hash = PrimeHash(data, 31)

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common beginning of suffixes i and j, by binary search."""
        a, b = self.starts[i], self.starts[j]
        low, high = np.zeros(len(i), np.int64), np.minimum(self.lengths[i], self.lengths[j])
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.hash.of(a, a + mid) == self.hash.of(b, b + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def compare(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as suffix i is before, equal to or after suffix j."""
        n = self.extension(i, j)
        more_i, more_j = n < self.lengths[i], n < self.lengths[j]
        last = max(0, len(self.data) - 1)
        x = np.where(more_i, self.data[np.minimum(self.starts[i] + n, last)].astype(np.int64), -1)
        y = np.where(more_j, self.data[np.minimum(self.starts[j] + n, last)].astype(np.int64), -1)
        return np.sign(x - y)

    def order(self, group_at: np.ndarray) -> np.ndarray:
        """Merge sort within groups of consecutive suffixes; group_at: where the group of each begins."""
        n = len(group_at)
        slot = np.arange(n)
        size = np.bincount(group_at, minlength=n)[group_at]
        perm, width = slot.copy(), 1
        while width < (size.max() if n else 0):
            active = np.flatnonzero(size > width)
            local = active - group_at[active]
            run = local // width
            other = (run ^ 1) * width
            stop = np.minimum(other + width, size[active])
            pair = other < size[active]  # a last run without a partner stays
            active, local, run, other, stop = active[pair], local[pair], run[pair], other[pair], stop[pair]
            base = group_at[active]
            low, high = base + other, base + stop
            begin, left = low.copy(), run % 2 == 0
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) >> 1
                c = self.compare(perm[mid], perm[active[open_]])
                right = np.where(left[open_], c < 0, c <= 0)  # stable: of equals the left run comes first
                low[open_] = np.where(right, mid + 1, low[open_])
                high[open_] = np.where(right, high[open_], mid)
            place = base + (run & ~1) * width + (local - run * width) + (low - begin)
            merged = perm.copy()
            merged[place] = perm[active]
            perm, width = merged, width * 2
        return perm

    def neighbours(self, group_at: np.ndarray) -> np.ndarray:
        """The longest common extension of each suffix with the others of its group."""
        perm = self.order(group_at)
        best = np.zeros(len(perm), np.int64)
        same = np.flatnonzero(group_at[perm[1:]] == group_at[perm[:-1]])
        common = self.extension(perm[same], perm[same + 1])
        np.maximum.at(best, perm[same], common)
        np.maximum.at(best, perm[same + 1], common)
        return best


def repeated_windows(data: np.ndarray, offsets: np.ndarray, group: np.ndarray, anchor: np.ndarray, window: int = WINDOW):
    """(context, first start, last start) of the runs of windows that another context of the same group repeats.

    Context i is data[offsets[i]:offsets[i + 1]], its anchor lies `anchor[i]` bytes in; groups are consecutive.
    """
    n = len(group)
    at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    group_at = np.repeat(at, np.diff(np.append(at, n)))
    p = offsets[:-1] + anchor
    right = Suffixes(data, p, offsets[1:]).neighbours(group_at)
    mirrored = data[::-1].copy()
    left = Suffixes(mirrored, len(data) - p, len(data) - offsets[:-1]).neighbours(group_at)
    first = np.maximum(offsets[:-1], p - left)
    last = np.minimum(offsets[1:], p + right) - window
    some = np.flatnonzero(last >= first)
    if not len(some):
        return np.zeros((3, 0), np.int64)
    counts = last[some] - first[some] + 1
    owner = np.repeat(some, counts)
    starts = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + first[owner]
    key = mixed(PrimeHash(data, 41).of(starts, starts + window)) ^ mixed(group_at[owner].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    key, owner, starts = key[order], owner[order], starts[order]
    same = np.flatnonzero(key[1:] == key[:-1])
    good = np.zeros(len(key), bool)
    views = np.lib.stride_tricks.sliding_window_view(data, window)
    for k in range(0, len(same), 4096):  # collision verification
        i = same[k : k + 4096]
        i = i[(views[starts[i]] == views[starts[i + 1]]).all(1) & (group_at[owner[i]] == group_at[owner[i + 1]])]
        good[i] = good[i + 1] = True
    owner, starts = owner[good], starts[good]
    order = np.lexsort((starts, owner))
    owner, starts = owner[order], starts[order]
    if not len(owner):
        return np.zeros((3, 0), np.int64)
    edge = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + 1), [True]]))
    return np.stack([owner[edge[:-1]], starts[edge[:-1]] - offsets[owner[edge[:-1]]], starts[edge[1:] - 1] - offsets[owner[edge[:-1]]]])


def _anchor_rows(window: int, gram: int):
    def step(t: pa.Table):
        data, offsets = text_buffer(t.column("text"))
        made = anchors(data, offsets, window, gram)
        if made is None:
            return None
        ids = np.asarray(t.column("doc_id"))
        return [ids[made[0]], made[1], made[2], *(c.astype(np.int32) for c in made[3:])]

    return step


def _contexts(window: int):
    schema = arrow_schema("kh long, doc_id long, first int, anchor int, single boolean, hot boolean, bytes binary")

    def run(batches):
        for b in sliced(batches):
            rows = []
            for doc_id, text, asked in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                raw = text.as_py().encode()
                rows += [(r["kh"], doc_id, r["first"], r["p"] - r["first"], r["single"], r["hot"], raw[r["first"] : r["last"] + window]) for r in asked]
                if len(rows) > 8000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _settle(window: int):
    """Whole groups of contexts at a time, from partitions sorted by group."""
    schema = arrow_schema("doc_id long, start int, stop int")

    def settle(t: pa.Table):
        data, offsets = text_buffer(t.column("bytes"))
        context, first, last = repeated_windows(data, offsets, np.asarray(t.column("kh")), np.asarray(t.column("anchor"), np.int64), window)
        asked = np.asarray(t.column("single"))[context]
        context, first, last = context[asked], first[asked], last[asked]
        base = np.asarray(t.column("first"), np.int64)[context]
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(t.column("doc_id"))[context]), pa.array((base + first).astype(np.int32)), pa.array((base + last + window).astype(np.int32))], schema=schema)

    def run(batches):
        held = None
        for t in gathered(batches, 1 << 19, 1 << 30):
            held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            kh = np.asarray(held.column("kh"))
            whole = int(np.searchsorted(kh, kh[-1]))  # the last group may go on
            if whole:
                yield settle(held.slice(0, whole).combine_chunks())
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield settle(held.combine_chunks())

    return run


def _window_rows(window: int):
    def step(t: pa.Table):
        data, offsets = text_buffer(t.column("bytes"))
        counts = np.diff(offsets) - window + 1
        owner = np.repeat(np.arange(len(counts)), counts)
        starts = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + offsets[owner]
        place = (starts - offsets[owner] + np.asarray(t.column("first"), np.int64)[owner]).astype(np.int32)
        return [np.asarray(t.column("kh"))[owner], digests(memoryview(data), starts, starts + window), np.asarray(t.column("doc_id"))[owner], place, np.asarray(t.column("single"))[owner]]

    return step, "kh long, digest binary, doc_id long, start int, single boolean"


def _few(ids: DataFrame):
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _of_classes(spans: DataFrame, repeated: DataFrame) -> DataFrame:
    """The spans whose class is in repeated (kh, sh, n); those of one common class never gather in one task."""
    key = ["kh", "sh"]
    common = cut(repeated.where(F.col("n") >= COMMON).select(key))
    n_common = common.count()
    if not n_common:
        return spans.join(repeated.select(key), key, "left_semi")
    if n_common <= BROADCAST_IDS:
        common = F.broadcast(common)
    else:
        key = [*key, "salt"]
        spans = spans.withColumn("salt", F.pmod(F.xxhash64("doc_id", "first"), F.lit(SALTS)).cast("int"))
        common = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rare = spans.join(common, key, "left_anti").join(repeated.where(F.col("n") < COMMON).select("kh", "sh"), ["kh", "sh"], "left_semi")
    return spans.join(common, key, "left_semi").unionByName(rare)


def repeats(texts: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, ranges): the byte ranges of repeated windows in texts (doc_id, text), one row for each different text."""
    spans = stored(map_tables(texts, _anchor_rows(window, gram), "doc_id long, kh long, sh binary, first int, last int, p int", SEGMENT), "spans")
    again = spans.groupBy("kh").agg(F.count("*").alias("n")).where("n > 1").select("kh")
    shared = stored(spans.join(_few(cut(again)), "kh", "left_semi"), "shared")  # stored, so a hot anchor's partition can be split
    discard(spans)
    classes = cut(shared.groupBy("kh", "sh").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "first", "last", "p")).alias("rep")))
    whole = _of_classes(shared, classes.where("n > 1")).select("doc_id", F.col("first").alias("start"), (F.col("last") + window).alias("stop"))
    mixed_groups = classes.groupBy("kh").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("kh", (F.col("kinds") > hot).alias("hot"))
    asked = classes.join(mixed_groups, "kh").select("rep.*", "kh", (F.col("n") == 1).alias("single"), "hot")
    asked = cut(asked.groupBy("doc_id").agg(F.collect_list(F.struct("kh", "first", "last", "p", "single", "hot")).alias("asked")))  # a document's own spans
    held = texts.join(_few(asked.select("doc_id")), "doc_id", "left_semi")
    ddl = "kh long, doc_id long, first int, anchor int, single boolean, hot boolean, bytes binary"
    contexts = stored(held.join(asked, "doc_id").select("doc_id", "text", "asked").mapInArrow(_contexts(window), ddl), "contexts")
    settled = contexts.where("not hot").drop("hot").repartition("kh").sortWithinPartitions("kh").mapInArrow(_settle(window), "doc_id long, start int, stop int")
    step, ddl = _window_rows(window)
    windows = map_tables(contexts.where("hot").drop("hot"), step, ddl, 1 << 20)
    twice = windows.groupBy("kh", "digest").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    counted = windows.where("single").join(twice, ["kh", "digest"], "left_semi").select("doc_id", "start", (F.col("start") + window).alias("stop"))
    ranges = whole.unionByName(settled).unionByName(counted).groupBy("doc_id").agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))
    out = cut(ranges)
    discard(shared, contexts)
    return out


def merged_ranges(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping or touching ranges as maximal ones."""
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    edge = np.flatnonzero(np.concatenate([[True], starts[1:] > stops[:-1]]))
    return list(zip(starts[edge].tolist(), stops[np.append(edge[1:] - 1, len(stops) - 1)].tolist(), strict=True))


def _keyed(docs: DataFrame, key: str) -> DataFrame:
    """docs with a key that tells texts apart: doc_id, or a hash of the text where doc_id is null or has several texts."""
    by_text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    several = docs.select(F.col("doc_id").cast("long").alias("id"), by_text.alias("t")).where("id is not null").groupBy("id").agg(F.min("t").alias("low"), F.max("t").alias("high")).where("low <> high").select("id")
    several = cut(several)
    own = F.col("doc_id").cast("long")
    if several.head(1):
        odd = free_name(docs, "odd")
        marked = several.withColumn(odd, F.lit(True))
        docs = docs.join(_few(marked), docs["doc_id"].cast("long") == marked["id"], "left").drop(marked["id"])
        return docs.withColumn(key, F.when(F.col("doc_id").isNull() | F.col(odd), by_text).otherwise(own)).drop(odd)
    return docs.withColumn(key, F.coalesce(own, by_text))


def _judged(docs: DataFrame, window: int, gram: int, hot: int):
    """The rows' digests, the digests of texts that occur twice, and the ranges of the others by key; docs: doc_id, doc_key, text."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "doc_key", text_column())
    slim = cut(read.select("doc_id", "doc_key", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("sha")))
    copies = slim.groupBy("sha").agg(F.min("doc_key").alias("keep"), F.count("*").alias("n")).where("n > 1").select("sha", "keep")
    copies = cut(copies)
    spare = cut(slim.join(copies, "sha").where("doc_key <> keep").select("doc_key").distinct())
    texts = read.select("doc_key", "text").join(_few(spare), "doc_key", "left_anti").select(F.col("doc_key").alias("doc_id"), "text").where(F.octet_length("text") >= window)
    return read, slim, copies, repeats(texts, window, gram, hot).withColumnRenamed("doc_id", "doc_key")


def removals(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    read, slim, copies, ranges = _judged(_keyed(docs.select("doc_id", "text"), "doc_key"), window, gram, hot)
    ddl = "doc_key long, n_removed long, n_spans long, kept binary"
    schema = arrow_schema(ddl)

    def run(batches):
        for b in sliced(batches):
            rows = []
            for key, text, found in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                raw = text.as_py().encode()
                spans = merged_ranges(np.array([r["start"] for r in found]), np.array([r["stop"] for r in found]))
                rows.append((key, sum(e - s for s, e in spans), len(spans), hashlib.sha256(without(raw, spans)).digest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    singles = read.join(_few(ranges.select("doc_key")), "doc_key", "left_semi")
    made = singles.join(ranges, "doc_key").select("doc_key", "text", "ranges").mapInArrow(run, ddl).withColumnRenamed("kept", "kept_sha")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    several = F.col("keep").isNotNull() & (F.col("n_bytes") >= window)
    return (
        slim.join(copies, "sha", "left")
        .join(made, "doc_key", "left")
        .select(
            "doc_id",
            "n_bytes",
            F.when(several, F.col("n_bytes")).when(F.col("keep").isNotNull(), 0).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(several, 1).when(F.col("keep").isNotNull(), 0).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
            F.when(several, empty).otherwise(F.lower(F.hex(F.coalesce(F.when(F.col("keep").isNull(), F.col("kept_sha")), "sha")))).alias("kept_sha256"),
        )
    )


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for s, e in spans:
        out.append(raw[at:s])
        at = e
    return b"".join([*out, raw[at:]])


def word_letters(text: str) -> str:
    """WORD_BYTES letters for every word."""
    return base64.b64encode(b"".join(xxhash.xxh64_digest(w)[:6] for w in _WORD.findall(text))).decode()


def _lettered(t: pa.Table):
    return [t.column("doc_id").combine_chunks(), pa.array((word_letters(x.as_py()) for x in t.column("text")), pa.string())]


def word_ranges(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The bytes of the words that spans of letters hold whole."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, done, size = [], 0, 0
    for start, stop in spans:
        first, last = -(-start // WORD_BYTES), min(stop // WORD_BYTES, len(at)) - 1
        if first <= last:
            low, high = at[first][0], at[last][1]
            size += len(text[done:low].encode())
            low_byte = size
            size += len(text[low:high].encode())
            done = high
            out.append((low_byte, size))
    return out


def _everything():
    return F.array(F.struct(F.lit(0).alias("start"), F.lit((1 << 31) - 1).alias("stop")))


def _cuts(docs: DataFrame, window: int, gram: int, hot: int) -> DataFrame:
    """(doc_key, ranges): what is removed from each document; texts that occur twice go whole."""
    _, slim, copies, ranges = _judged(docs, window, gram, hot)
    gone = slim.join(copies, "sha").where(F.col("n_bytes") >= window).select("doc_key").distinct().select("doc_key", _everything().alias("ranges"))
    return ranges.join(gone.select("doc_key"), "doc_key", "left_anti").unionByName(gone)


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, words: int | None = None) -> DataFrame:
    """All rows and columns of docs, text (and n_chars, where there is one) less the repeated bytes.

    With `words`, passages of that many words that start at two places are removed too, whatever their bytes.
    Bytes of a character that is cut through go with it. A text that occurs twice and is at least a window long
    becomes empty; its row stays.
    """
    key, found_bytes, found_words = (free_name(docs, c) for c in ("cut_key", "cut_ranges", "cut_words"))
    marked = _keyed(docs, key)
    read = marked.select(F.col(key).alias("doc_id"), F.col(key).alias("doc_key"), text_column())
    cuts = _cuts(read, window, gram, hot).withColumn("word_ranges", F.lit(None).cast("array<struct<start:int,stop:int>>"))
    if words is not None:
        lettered = map_tables(read.select("doc_id", "text"), _lettered, "doc_id long, text string", 1 << 20).withColumn("doc_key", F.col("doc_id"))
        found = _cuts(lettered, words * WORD_BYTES, gram, hot).withColumnRenamed("ranges", "by_word")
        cuts = cuts.drop("word_ranges").join(found, "doc_key", "full").select("doc_key", "ranges", F.col("by_word").alias("word_ranges"))
    cuts = cut(cuts)

    def bounds(found) -> list[tuple[int, int]]:
        return merged_ranges(np.array([x["start"] for x in found]), np.array([x["stop"] for x in found])) if found is not None else []

    def cleaned(text, found, by_word):
        if text is None:
            return None
        spans = bounds(found) + word_ranges(text, bounds(by_word))
        return without(text.encode(), merged_ranges(*np.array(spans, np.int64).T)).decode("utf-8", "ignore") if spans else text

    def run(texts: pd.Series, found: pd.Series, by_word: pd.Series) -> pd.Series:
        return pd.Series([cleaned(*x) for x in zip(texts, found, by_word, strict=True)], dtype=object)

    clean = F.pandas_udf(run, "string")
    few = cuts.count() <= BROADCAST_IDS
    ids = cuts.select(F.col("doc_key").alias(key))
    by_key = cuts.select(F.col("doc_key").alias(key), F.col("ranges").alias(found_bytes), F.col("word_ranges").alias(found_words))
    touched = marked.join(F.broadcast(ids) if few else ids, key, "left_semi").join(by_key, key)
    touched = touched.withColumn("text", clean(F.col("text").cast("string"), F.col(found_bytes), F.col(found_words)))
    if "n_chars" in docs.columns:
        touched = touched.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    rest = marked.join(F.broadcast(ids) if few else ids, key, "left_anti")
    return touched.select(*docs.columns).unionByName(rest.select(*docs.columns))
