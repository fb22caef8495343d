"""Round trips of archives."""

import io
import struct

import pyarrow.fs
import zstandard
from pyspark.sql import functions as F

from cueline.llm.shared import shared_folder
from cueline.llm.warc import SKIPPABLE, archive, base32_sha1, http_head, open_store, read_archive, read_warc, record, train, warc_round_trip, write_warc


def test_bytes():
    pages = [f"<html><body>page {i} {'x' * i}\r\n\r\n</body></html>".encode() for i in range(400)]
    records = [record(i, "http://a b/\n", p, base32_sha1(p), i - 1 if i % 7 == 3 else None) for i, p in enumerate(pages)]
    data = archive(records, 1 << 14, 1 << 20)
    magic, size = struct.unpack("<II", data[:8])
    assert magic == SKIPPABLE and size > 200
    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
    assert zstandard.ZstdDecompressor(dict_data=dictionary).decompress(data[8 + size :][: len(data)], allow_extra_data=True) == records[0]
    assert len(data) < sum(len(zstandard.compress(r)) for r in records)
    back = list(read_archive(io.BytesIO(data), chunk=100))
    assert [b for _, b in back] == [http_head(len(p)) + (b"" if i % 7 == 3 else p) for i, p in enumerate(pages)]
    assert all(int(h["x-row-id"]) == i for i, (h, _) in enumerate(back))
    assert list(read_archive(io.BytesIO(archive([], 1 << 14, 1 << 20)))) == []


def test_round_trip(spark):
    long = "<p>é</p>" * 200_000
    rows = [(4, "u", "same", "k"), (2, None, "same", "k"), (9, "u", None, "k"), (3, "u\x00\n", "", "k"), (7, "u", long, "k"), (8, "u", long + "!", "k"), (None, "u", "same", "k"), (2, "u", "same", "k")]
    rows += [(100 + i, "u", f"<html>{i % 50} {'ab' * (i % 50)}</html>", "k") for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    got = warc_round_trip(df, archive_mb=1).collect()
    assert len(got) == len(rows)
    first: dict = {}
    for page, _, html, _ in rows:
        if page is not None:
            first[html or ""] = min(first.get(html or "", page), page)
    seen = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got)
    want = sorted((str(p), len((h or "").encode()), base32_sha1((h or "").encode()), "response" if first[h or ""] == p else "revisit", None if first[h or ""] == p else first[h or ""]) for p, _, h, _ in rows)
    assert seen == want
    assert warc_round_trip(df.limit(0)).count() == 0
    folder = shared_folder(spark, "warc-test")
    archives = write_warc(df, folder, min_bytes=5)
    payloads = {r.page_id: r for r in read_warc(archives).where("page_id IS NOT NULL").collect()}
    assert payloads[7].payload == long.encode() and payloads[4].record_type == "response"
    store, path = open_store(folder)
    ids, refers = [], set()
    for x in store.get_file_info(pyarrow.fs.FileSelector(path)):
        if x.path.endswith(".warc.zst"):
            with store.open_input_stream(x.path, compression=None) as stream:
                found = [h for h, _ in read_archive(stream)]
            assert found[0]["warc-type"] == "warcinfo" and all(h["content-type"] == "application/http; msgtype=response" for h in found[1:])
            ids += [h["warc-record-id"] for h in found]
            refers |= {h["warc-refers-to"] for h in found if "warc-refers-to" in h}
    assert len(ids) == len(set(ids)) and refers and refers <= set(ids)


def test_second_attempt(spark):
    """Archives of an attempt that does not count, over other cuts of the rows, are neither read nor do they replace any."""
    rows = [(i, "u", f"<html>{i} {'x' * 2000}</html>") for i in range(3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = shared_folder(spark, "warc-test")
    first = write_warc(df, folder, archive_mb=1)
    named = {r.path for r in first.collect()}
    other = write_warc(df.orderBy(F.desc("page_id")).repartition(5), f"{folder}/again", archive_mb=2)
    store, path = open_store(folder)
    for r in other.collect():  # as if the other attempts had written to the same folder
        _, where = open_store(r.path)
        store.copy_file(where, f"{path}/{where.rsplit('/', 1)[1]}")
    assert len(named) > 5 and sorted(r.page_id for r in read_warc(first).select("page_id").collect()) == list(range(3000))


def test_names_of_attempts(spark):
    """Two attempts of one task never share a file name."""
    df = spark.createDataFrame([(i, "u", str(i)) for i in range(10)], "page_id long, url string, html string").coalesce(1)
    a, b = (write_warc(df, shared_folder(spark, "warc-test")) for _ in range(2))
    assert not {r.path.rsplit("/", 1)[1] for r in a.collect()} & {r.path.rsplit("/", 1)[1] for r in b.collect()}


def test_dictionary_of_large_pages():
    """Few large records, of which every sixth would be too few, have a dictionary."""
    page = lambda i: b"".join(b"<li class='entry'><a href='/%d/%d'>item %d</a></li>\n" % (i, k, i * k) for k in range(6000))
    records = [record(i, "http://a/", page(i), base32_sha1(page(i)), None) for i in range(40)]
    assert sum(map(len, records)) > 10 << 20 and len(train(records, 1 << 14, 2 << 20)) > 200
    assert [b for _, b in read_archive(io.BytesIO(archive(records, 1 << 14, 2 << 20)))] == [http_head(len(page(i))) + page(i) for i in range(40)]


def test_dictionary_of_few_or_odd_records():
    """Records too few to learn from, and such as have nothing in common, have the beginning of them as dictionary."""
    import os

    for pages in ([b""], [b"<p>one</p>"] * 3, [os.urandom(200) for _ in range(40)], [os.urandom(100_000)]):
        records = [record(i, "http://a/", p, base32_sha1(p), None) for i, p in enumerate(pages)]
        assert train(records, 1 << 14, 2 << 20)
        assert [b for _, b in read_archive(io.BytesIO(archive(records, 1 << 14, 2 << 20)))] == [http_head(len(p)) + p for p in pages]
