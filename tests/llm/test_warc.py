"""Archives: an exact round trip, the dictionary frame, damage."""

import base64
import glob
import hashlib
import os
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from lintlake.llm import op1_warc as op1
from lintlake.session import shared_dir

PAGES = [
    (5, "http://a.example/x y", "same"), (3, None, "same"), (9, "http://ü.example/\r\nevil: 1", None), (2, "http://b.example", ""),
    (7, "http://c.example", "<html>" + "long " * 300_000), (8, "u", "Ä €\r\n\r\nWARC/1.1\r\n"), (8, "u", "Ä €\r\n\r\nWARC/1.1\r\n"), (None, "n", "same"),
    (None, "n", None),
]


def make(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns(
        {c: F.lit("extra") for c in ("digest", "first", "n", "hot", "payload", "file")}
    )


def brute(rows):
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = []
    for i, _, t in rows:
        raw = (t or "").encode()
        least = first.get(t or "", i)
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), *(("response", None) if i == least else ("revisit", least))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows", [PAGES, [], [(i, f"http://h/{i}", f"<p>page {i % 700} with words {i % 13}</p>" * 4) for i in range(3000)]])
def test_round_trip(spark, rows):
    found = op1.archived(make(spark, rows))
    assert sorted([tuple(r) for r in found.collect()], key=repr) == brute(rows)


def test_files_are_public_archives(spark):
    rows = [(i, f"http://h/{i}", f"<html><body>{'common words of every page ' * 6}{i}</body></html>") for i in range(400)]
    folder = shared_dir(spark, "warc-test")
    manifest = op1.write(make(spark, rows), folder).collect()
    assert sum(r.records for r in manifest) == 400
    local = folder.removeprefix("file:")
    seen, with_dictionary = 0, 0
    for path in glob.glob(os.path.join(local, "*.warc.zst")):
        data = open(path, "rb").read()
        magic, size = struct.unpack("<II", data[:8])
        taken = None
        if magic == 0x184D2A5D:
            taken, data, with_dictionary = zstandard.ZstdCompressionDict(data[8 : 8 + size]), data[8 + size :], with_dictionary + 1
        while data:
            one = zstandard.ZstdDecompressor(dict_data=taken).decompressobj()
            raw = one.decompress(data)
            assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
            data, seen = one.unused_data, seen + 1
    assert seen == 400 and with_dictionary
    texts = {r.page_id: bytes(r.payload).decode() for r in op1.read(spark, folder).collect()}
    assert texts == {i: t for i, _, t in rows}


def test_damage_is_noticed(tmp_path):
    from pyarrow import fs

    archive = op1.Archive(str(tmp_path))
    for i in range(100):
        payload = f"page {i} " * 20
        archive.add(op1.record(i, "http://x", payload.encode(), op1.base32_sha1(payload.encode()), None, False))
    path = tmp_path / archive.close()[0]
    store = fs.LocalFileSystem()
    assert len(list(op1.frames(store, str(path), chunk=64))) == 100
    path.write_bytes(path.read_bytes()[:-5])
    with pytest.raises(ValueError):
        list(op1.frames(store, str(path)))
    raw = op1.record(1, "http://x", b"payload", op1.base32_sha1(b"payload"), None, False)
    assert op1.parse(raw)["payload"] == b"payload"
    with pytest.raises(ValueError):
        op1.parse(raw[:-3])


def dictionary_of(path):
    data = open(path, "rb").read(8)
    magic, size = struct.unpack("<II", data)
    return size if magic == 0x184D2A5D else 0


@pytest.mark.parametrize("sizes", [[9 << 20, *[300] * 5000], [40 << 20, *[300] * 20], [400] * 15, [5000] * 2, [200_000]])
def test_every_file_has_a_dictionary(tmp_path, sizes):
    """Whatever the sizes and number of the first records; the records come back whole."""
    from pyarrow import fs

    draw = __import__("random").Random(1)
    words = ["".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(500)]
    archive, want = op1.Archive(str(tmp_path)), []
    for n in sizes:
        base = " ".join(draw.choice(words) for _ in range(min(n, 20_000) // 7))
        payload = (base * (n // len(base) + 1))[:n].encode()
        want.append(op1.record(len(want), "http://x", payload, op1.base32_sha1(payload), None, False))
        archive.add(want[-1])
    name, records, _ = archive.close()
    assert records == len(sizes) and dictionary_of(tmp_path / name) >= 256
    assert list(op1.frames(fs.LocalFileSystem(), str(tmp_path / name))) == want


def test_folders_are_those_that_spark_means(spark, tmp_path):
    assert op1.located(spark, f"{tmp_path}/a") == op1.located(spark, f"file:{tmp_path}/a") == f"file://{tmp_path}/a"
    with pytest.raises(ValueError, match="cannot be written to viewfs"):
        spark.conf.set("spark.hadoop.x", "1")
        spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.t.link./in", f"file://{tmp_path}")
        op1.located(spark, "viewfs://t/in")
    assert {op1.STORES[s] for s in ("s3a", "s3n", "s3")} == {"s3"}
