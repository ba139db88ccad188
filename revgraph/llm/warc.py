"""WARC archives of individually compressed records under a per-archive Zstandard dictionary.

Each task trains a dictionary on the first `sample_bytes` of its archive's records, writes it in a leading skippable
frame (magic 0x184D2A5D) and then every record as a Zstandard frame of its own. Archives are written under a temporary
name and renamed, so a lost or repeated task leaves nothing that a reader would list: readers take the manifest only.

Of records with equal payloads of at least `min_bytes`, the one with the smallest page_id is a response, the others
revisit it. Null html counts as empty, null urls are left out of the header, null page_ids never lead a group that
has another id; rows repeated in full are records of their own, and those of the leading page_id are all responses.
An empty table gives no archive and no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revgraph.llm.common import arrow_schema, cut, fresh_path

#: Fixed values of the format.
SKIPPABLE = 0x184D2A5D
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the file system that Spark resolves it on, the default one where it has none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def open_store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and path of a URI, as write_archives() makes it of any path; what Arrow cannot reach is refused.

    Only a caller of Writer itself may name a local folder by its bare path.
    """
    scheme, colon, rest = uri.partition(":")
    if not colon:
        return pa.fs.LocalFileSystem(), uri
    if scheme == "file":
        return pa.fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pa.fs.FileSystem.from_uri(f"s3:{rest}" if scheme in ("s3a", "s3n") else uri)


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One WARC record; refers_to None for a response, ("id", page_id) for a revisit."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to[1]}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Writer:
    """An archive in the making: holds the first records as the dictionary's sample, then streams."""

    def __init__(self, uri: str, sample_bytes: int, dictionary_bytes: int, level: int = 3):
        self.fs, base = open_store(uri)
        self.fs.create_dir(base, recursive=True)
        self.path, self.uri = f"{base}/{uuid.uuid4().hex}.warc.zst", uri
        self.sample_bytes, self.dictionary_bytes, self.level = sample_bytes, dictionary_bytes, level
        self.out, self.held, self.size, self.n = None, [], 0, 0

    def add(self, data: bytes) -> None:
        self.n += 1
        self.size += len(data)
        if self.out is None:
            self.held.append(data)
            if self.size >= self.sample_bytes:
                self._begin()
        else:
            self.out.write(self.compressor.compress(data))

    def _begin(self) -> None:
        import zstandard

        try:
            dictionary = zstandard.train_dictionary(self.dictionary_bytes, self.held)
        except zstandard.ZstdError:  # too few or too small records to train on
            dictionary = zstandard.ZstdCompressionDict(b"".join(self.held)[: self.dictionary_bytes] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw = dictionary.as_bytes()
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=dictionary, write_checksum=True)
        self.out = self.fs.open_output_stream(self.path + ".part", compression=None)
        self.out.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
        for data in self.held:
            self.out.write(self.compressor.compress(data))
        self.held = []

    def close(self) -> tuple[str, int, int]:
        if self.out is None:
            self._begin()
        self.out.close()
        self.fs.move(self.path + ".part", self.path)
        return f"{self.uri}/{self.path.rpartition('/')[2]}", self.n, self.size


def read_archive(uri: str):
    """(headers, http block) of every record; constant memory."""
    import zstandard

    base, _, name = uri.rpartition("/")
    fs, at = open_store(base)
    with fs.open_input_stream(f"{at}/{name}", compression=None) as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != SKIPPABLE:
            raise ValueError(f"{uri} has no dictionary frame")
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(f.read(size))).stream_reader(f, read_across_frames=True)
        buffer = b""

        def more() -> bool:
            nonlocal buffer
            got = reader.read(1 << 20)
            buffer += got
            return bool(got)

        while True:
            while (end := buffer.find(b"\r\n\r\n")) < 0:
                if not more():
                    if buffer:
                        raise ValueError(f"{uri} ends within a record")
                    return
            headers = dict(x.split(": ", 1) for x in buffer[:end].decode().split("\r\n")[1:])
            stop = end + 4 + int(headers["Content-Length"])
            while len(buffer) < stop + 4:
                if not more():
                    raise ValueError(f"{uri} ends within a record")
            yield headers, buffer[end + 4 : stop]
            buffer = buffer[stop + 4 :]


def write_archives(pages: DataFrame, out: str, min_bytes: int = 100, archive_bytes: int = 256 << 20, sample_bytes: int = 1 << 20, dictionary_bytes: int = 32 << 10) -> DataFrame:
    """Write all pages and return the manifest: path, records, bytes."""
    out = qualified(pages.sparkSession, out)
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    slim = read.where(F.octet_length("html") >= min_bytes).select("page_id", "digest")
    first = slim.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null")
    revisits = slim.join(first.select("digest", "first_id"), "digest").where("not page_id <=> first_id").distinct().select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "first_id")
    revisits = cut(revisits)
    few = revisits.count() <= 500_000  # some 100 bytes each; beyond, a shuffle join
    rows = read.join(F.broadcast(revisits) if few else revisits, F.expr("page_id <=> r_id and digest = r_digest"), "left").select("page_id", "url", "html", "digest", "first_id")
    schema = arrow_schema("path string, records long, bytes long")

    def write(batches):
        writer = None
        for b in batches:
            for page_id, url, html, digest, first_id in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                writer = writer or Writer(out, sample_bytes, dictionary_bytes)
                writer.add(record("null" if page_id is None else page_id, url, html.encode(), digest, None if first_id is None else ("id", first_id)))
                if writer.size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in writer.close()], schema=schema)
                    writer = None
        if writer:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in writer.close()], schema=schema)

    return cut(rows.mapInArrow(write, "path string, records long, bytes long"))


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record; responses' digests are recomputed."""
    schema = arrow_schema("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")

    def number(urn: str):
        x = urn.removeprefix("<urn:page:").removesuffix(">")
        return None if x == "null" else int(x)

    def read(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                rows = []
                for h, block in read_archive(path):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = int(head.rpartition(b"Content-Length: ")[2])
                    digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
                    if h["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{path}: {h['WARC-Record-ID']} is damaged")
                    rows.append((number(h["WARC-Record-ID"]), size, digest, h["WARC-Type"], number(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    n = max(1, manifest.count())
    return manifest.select("path").repartition(n).mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, out: str | None = None) -> DataFrame:
    """Write the archives, then read them back."""
    spark = pages.sparkSession
    return read_archives(write_archives(pages, out or fresh_path(spark, "warc")))
