"""Packing along a space-filling curve.

Every document's tokens are hashed into a short vector, projected to few dimensions and ranked by the Hilbert key of
its cell; the documents, sorted by key, form one global stream of tokens that is cut every `length` tokens, so each
sequence holds neighbours on the curve and only the last sequence has padding. Global token offsets come from
per-partition totals. Ids are the vocabulary's of byte_bpe_50k.json; the rank file gives the same ids faster and is
used where the two libraries' patterns provably agree (plain Latin text without the special token's string).

Null texts are empty documents of the end token alone; null doc_ids and repeated rows are packed like any other row;
an empty table gives no rows; extra columns are ignored by `pack` and only the documents' own are read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revgraph.llm.common import arrow_schema, cut, fresh_path, gathered, ranked, text_column, tokenizer_path

END = 1
LENGTH = 2048
BUCKETS, DIMENSIONS, BITS = 256, 4, 10
#: Characters whose classes both libraries agree on.
_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e\xa1-ɏ‐-‧]")


class Encoder:
    """Token ids as the tokenizers library gives them for byte_bpe_50k.json with add_special_tokens=False."""

    _made = None

    @classmethod
    def get(cls) -> Encoder:
        if cls._made is None:
            cls._made = cls()
        return cls._made

    def __init__(self):
        import base64

        import public_tokenizers
        import tiktoken

        with open(tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = None

    def __call__(self, text: str) -> np.ndarray:
        if "<|" not in text and not _PLAIN.search(text):
            return np.asarray(self.fast.encode_ordinary(text), np.uint32)
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
            self.slow.no_truncation()
            self.slow.no_padding()
        return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of rows of integer cells (n, d), by Skilling's transform."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            on = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(on, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[d - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | x[i] >> b & 1
    return key


def curve_keys(tokens: list[np.ndarray]) -> np.ndarray:
    """Hilbert keys of documents: hashed token counts, a fixed random projection, cells by a squashing function."""
    rng = np.random.default_rng(7)
    project = rng.normal(size=(BUCKETS, DIMENSIONS))
    vectors = np.zeros((len(tokens), BUCKETS))
    for v, ids in zip(vectors, tokens, strict=True):
        v += np.sqrt(np.bincount((ids * np.uint32(2654435761)) >> np.uint32(24), minlength=BUCKETS))
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    at = 1 / (1 + np.exp(-2 * (vectors @ project)))
    return hilbert_key(np.minimum((at * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def tokenized(docs: DataFrame) -> DataFrame:
    """row_id, doc_id, key, n, crc, ids (16-bit, end token included) of every row, as a table in the shared folder."""
    schema = arrow_schema("doc_id long, key long, n long, crc long, ids binary")

    def run(batches):
        encode = Encoder.get()
        for t in gathered(batches, 2 << 20, 2000):
            tokens = [np.append(encode(x), np.uint32(END)) for x in t.column("text").to_pylist()]
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in tokens]
            yield pa.RecordBatch.from_arrays(
                [t.column("doc_id").combine_chunks(), pa.array(curve_keys(tokens)), pa.array([len(x) for x in tokens], pa.int64()), pa.array(crc, pa.int64()), pa.array([x.astype("<u2").tobytes() for x in tokens], pa.binary())], schema=schema
            )

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column()).mapInArrow(run, "doc_id long, key long, n long, crc long, ids binary")
    made = made.withColumn("row_id", F.monotonically_increasing_id())
    path = fresh_path(docs.sparkSession, "tokens")
    made.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(made.schema).parquet(path)


def pack(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    rows = tokenized(docs)
    placed, _, _ = ranked(rows.select("row_id", "doc_id", "key", "n", "crc"), ["key", "doc_id", "row_id"], "n")
    placed = placed.withColumn("sequence_id", F.expr(f"start div {length}")).withColumn("last", F.expr(f"(start + n - 1) div {length}"))
    whole = placed.where("sequence_id = last").select(
        "doc_id", F.lit(0).cast("long").alias("start"), F.col("n").alias("length"), F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), "sequence_id", F.expr(f"start % {length}").alias("offset")
    )
    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    schema = arrow_schema(ddl)

    def cut_pieces(batches):
        for b in batches:
            out = []
            for doc_id, start, n, raw in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                ids = np.frombuffer(raw, "<u2").astype("<u4")
                at = 0
                while at < n:
                    offset = (start + at) % length
                    step = min(n - at, length - offset)
                    out.append((doc_id, at, step, zlib.crc32(ids[at : at + step].tobytes()), n, (start + at) // length, offset))
                    at += step
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    parts = placed.where("sequence_id <> last").select("row_id", "start").join(rows.select("row_id", "doc_id", "n", "ids"), "row_id")
    return whole.unionByName(parts.select("doc_id", "start", "n", "ids").mapInArrow(cut_pieces, ddl))
