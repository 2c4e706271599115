"""WARC archives with a Zstandard dictionary: writer and reader.

An archive is a ``.warc.zst`` file as public tools write it: a leading skippable frame (magic
0x184D2A5D) with the dictionary, then one Zstandard frame per record. Every task of the writer trains
the dictionary of its file on the first records that it archives, whatever their sizes: on the beginning of
each of at least 16 records or, where a file has fewer, on pieces of them. It writes the frame, and then
compresses record by record in a stream. Only a file whose records are too few bytes to train on has none. Files are written under a name of the attempt, and only the manifest, a table made by one Spark
write, says which files count, so lost executors and repeated tasks leave nothing half-written behind.

Equal payloads are stored once: the record of the smallest page id is a ``response``, the others are
``revisit`` records that name it. Only digests are grouped, with partial aggregation; groups of over a
thousandth of the rows (at most 1,000) are looked up by broadcast, the rest by a join.

Defined results: a null payload is empty; a null url is ``about:blank``; control characters and spaces
of a url are percent-encoded; a null id ranks after every other; rows that repeat the smallest id are
all responses; an empty table gives no archive and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.common import scalar_row, small_batches
from lintlake.session import shared_dir

SKIPPABLE = 0x184D2A5D
#: Bytes of the dictionary; records and bytes of samples it is trained on; bytes of a record's sample; fewest
#: samples; bytes of records that wait for a dictionary at most, once there are so many.
DICTIONARY, TRAIN_RECORDS, TRAIN_BYTES, SAMPLE_BYTES, LEAST_SAMPLES, HELD_BYTES = 64 << 10, 2_000, 8 << 20, 64 << 10, 16, 32 << 20
LEVEL = 6
#: A file is closed and another begun beyond this size.
FILE_BYTES = 1 << 30
DATE = "2026-01-01T00:00:00Z"
HEAD = "WARC/1.1\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _id(page) -> str:
    return "<urn:page:none>" if page is None else f"<urn:page:{page}>"


def _page(urn: str) -> int | None:
    inner = urn.strip("<>").rpartition(":")[2]
    return None if inner == "none" else int(inner)


def record(page, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """A response or revisit record; a revisit holds the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _id(page)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", "about:blank" if url is None else quote(url, safe="/:?#[]@!$&'()*+,;=%-._~")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if revisit:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", _id(refers_to)),
        ]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = HEAD + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Header fields of a record, its HTTP fields and its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record does not end where it should")
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["http"] = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    fields["payload"] = payload
    return fields


#: Schemes of stores that tasks can write to, as the store's own library names them.
STORES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def located(spark: SparkSession, folder: str) -> str:
    """The folder as a URI of the store that Spark means by it, also where it names none; an error for a
    store that tasks could not write to themselves."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    scheme, _, rest = path.makeQualified(store.getUri(), store.getWorkingDirectory()).toString().partition(":")
    if scheme not in STORES:
        raise ValueError(f"archives cannot be written to {scheme}: only to {', '.join(sorted(STORES))}")
    return f"{STORES[scheme]}:{rest if rest.startswith('//') else '//' + rest}"


class Archive:
    """One archive file: collects records for its dictionary, then streams frames."""

    def __init__(self, folder: str, dictionary: int = DICTIONARY, file_bytes: int = FILE_BYTES):
        self.store, path = fs.FileSystem.from_uri(folder)
        self.store.create_dir(path, recursive=True)
        self.path, self.size, self.limit = path, dictionary, file_bytes
        self.waiting: list[bytes] = []
        self.waiting_bytes = self.sample_bytes = self.records = self.written = 0
        self.out = None

    def _samples(self) -> list[bytes]:
        """The beginnings of the waiting records, cut into pieces if there are few."""
        samples = [r[:SAMPLE_BYTES] for r in self.waiting]
        if len(samples) < LEAST_SAMPLES:
            size = max(64, sum(map(len, samples)) // (4 * LEAST_SAMPLES))
            samples = [r[i : i + size] for r in samples for i in range(0, len(r), size)]
        return samples

    def _open(self) -> None:
        sample, samples, taken = self.waiting, self._samples(), None
        if len(samples) >= LEAST_SAMPLES:
            size = max(256, min(self.size, sum(map(len, samples)) // 8))
            try:
                taken = zstandard.train_dictionary(size, samples, k=512, d=8)
            except zstandard.ZstdError:  # too little or too uniform to train on: frames without one
                taken = None
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.out = self.store.open_output_stream(f"{self.path}/{self.name}", compression=None)
        if taken:
            raw = taken.as_bytes()
            self._put(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
        self.press = zstandard.ZstdCompressor(level=LEVEL, dict_data=taken)
        for r in sample:
            self._put(self.press.compress(r))
        self.waiting, self.waiting_bytes = [], 0

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)

    def add(self, raw: bytes) -> None:
        self.records += 1
        if self.out:
            self._put(self.press.compress(raw))
            return
        self.waiting.append(raw)
        self.waiting_bytes += len(raw)
        self.sample_bytes += min(len(raw), SAMPLE_BYTES)
        enough = len(self.waiting) >= TRAIN_RECORDS or self.sample_bytes >= TRAIN_BYTES or self.waiting_bytes >= HELD_BYTES
        if enough and len(self.waiting) >= LEAST_SAMPLES:
            self._open()

    def full(self) -> bool:
        return self.written >= self.limit

    def close(self) -> tuple[str, int, int] | None:
        if not self.records:
            return None
        if not self.out:
            self._open()
        self.out.close()
        return self.name, self.records, self.written


def frames(store, path: str, chunk: int = 1 << 16):
    """The records of an archive, one at a time. What is left of a chunk is copied at the end of each record,
    so chunks are small."""
    with store.open_input_stream(path, compression=None) as f:
        head = f.read(8)
        taken = None
        if len(head) == 8 and struct.unpack("<I", head[:4])[0] == SKIPPABLE:
            taken = zstandard.ZstdCompressionDict(f.read(struct.unpack("<I", head[4:])[0]))
            head = b""
        press = zstandard.ZstdDecompressor(dict_data=taken)
        one, parts, data = None, [], head or f.read(chunk)
        while data:
            one = one or press.decompressobj()
            parts.append(one.decompress(data))
            if one.eof:
                yield b"".join(parts)
                data = one.unused_data or f.read(chunk)
                one, parts = None, []
            else:
                data = f.read(chunk)
        if one:
            raise ValueError("an archive ends inside a record")


def write(pages: DataFrame, folder: str, id_col="page_id", url_col="url", payload_col="html") -> DataFrame:
    """Write the archives to ``folder`` and return the manifest (file, records, bytes)."""
    target = located(pages.sparkSession, folder)
    payload = F.coalesce(pages[payload_col].cast("string"), F.lit(""))
    rows = small_batches(pages).select(
        pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"), payload.alias("payload"),
        F.sha1(payload.cast("binary")).alias("digest"),
    )
    groups = (
        rows.select("digest", "page_id").groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    )
    total = scalar_row(rows.agg(F.count("*").alias("n"))).n
    hot = F.col("n") * 1000 > total
    tagged = rows.join(F.broadcast(groups.where(hot).select("digest", F.struct("first").alias("hot"))), "digest", "left")
    spread = tagged.where("hot IS NOT NULL").select("page_id", "url", "payload", "digest", F.col("hot.first").alias("first"))
    rest = tagged.where("hot IS NULL").join(groups.where(~hot).select("digest", "first"), "digest", "left")
    planned = rest.select("page_id", "url", "payload", "digest", "first").unionByName(spread)

    def run(batches):
        archive, done = Archive(target), []
        for b in batches:
            for page, url, text, digest, first in zip(*[b.column(i) for i in range(5)]):
                page, first = page.as_py(), first.as_py()
                revisit = first is not None and page != first
                code = base64.b32encode(bytes.fromhex(digest.as_py())).decode()
                archive.add(record(page, url.as_py(), text.as_py().encode(), code, first, revisit))
                if archive.full():
                    done.append(archive.close())
                    archive = Archive(target)
        done += [x for x in [archive.close()] if x]
        names, records, sizes = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())], ["file", "records", "bytes"]
        )

    made = planned.mapInArrow(run, "file string, records bigint, bytes bigint")
    path = f"{folder}/manifest"
    made.write.parquet(path)
    return pages.sparkSession.read.parquet(path)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the archives that the manifest names: page_id, url, record_type,
    payload_digest, payload_bytes, refers_to, payload (null in revisits, whose payload is elsewhere).

    The payload of every response is held against its digest."""
    files = spark.read.parquet(f"{folder}/manifest").select("file")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    target = located(spark, folder)

    def run(batches):
        store, root = fs.FileSystem.from_uri(target)
        schema = pa.schema([
            ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()),
            ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary()),
        ])
        out, held = [], 0
        for b in batches:
            for name in b.column(0).to_pylist():
                for raw in frames(store, f"{root}/{name}"):
                    x = parse(raw)
                    digest = x["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = x["WARC-Type"] == "revisit"
                    if not revisit and base32_sha1(x["payload"]) != digest:
                        raise ValueError(f"the payload of {x['WARC-Record-ID']} is damaged")
                    out.append((
                        _page(x["WARC-Record-ID"]), x["WARC-Target-URI"], x["WARC-Type"], digest, int(x["http"]["Content-Length"]),
                        _page(x["WARC-Refers-To"]) if revisit else None, None if revisit else x["payload"],
                    ))
                    held += len(x["payload"])
                    if len(out) >= 10_000 or held > 8 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)
                        out, held = [], 0
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)

    return files.repartition(n, "file").mapInArrow(
        run, "page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, payload binary"
    )


def archived(pages: DataFrame) -> DataFrame:
    """Write the pages, read them back, and return what the records say."""
    folder = shared_dir(pages.sparkSession, "warc")
    write(pages, folder)
    return read(pages.sparkSession, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
