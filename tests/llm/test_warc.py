import hashlib

import pytest
import zstandard

from quillsql.llm import queries, warc


def brute(rows):
    out, groups = {}, {}
    for page_id, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000:
            groups[data] = max(groups.get(data, page_id), page_id)
    for page_id, html in rows:
        data = (html or "").encode()
        winner = groups.get(data, page_id)
        out[page_id] = (len(data), hashlib.sha1(data).hexdigest(), "response" if winner == page_id else "revisit", None if winner == page_id else winner)
    return out


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in queries.op3_warc(spark, sf_dir).collect()}
    assert got == brute(rows)


def test_round_trip_with_copies_and_odd_rows(spark):
    big = "é" * 700
    rows = [(1, "http://a/ b", big), (2, None, big), (3, "u", "x" * 999), (4, "u", "x" * 999), (5, "u\n", None), (6, "", ""), (None, "u", "y" * 1500), (8, "u", "y" * 1500), (9, "u", "z\r\n\r\n" * 400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    bundles = warc.write_bundles(warc.mark_revisits(pages), frame_bytes=1500).cache()
    read = {r.page_id: r for r in warc.read_bundles(bundles).collect()}
    assert (read[1].record_type, read[1].refers_to, read[1].payload, read[1].payload_bytes) == ("revisit", 2, None, 1400)
    assert read[2].record_type == "response" and bytes(read[2].payload).decode() == big
    assert read[3].record_type == read[4].record_type == "response"
    assert read[5].payload_bytes == 0 and read[5].url == "u\n" and read[2].url is None and read[1].url == "http://a/ b"
    assert (read[None].record_type, read[None].refers_to) == ("revisit", 8)
    assert bytes(read[9].payload) == b"z\r\n\r\n" * 400
    # random access by the index, and any reader of Zstandard can unpack the whole
    held = {r.bundle_id: bytes(r.data) for r in bundles.collect()}
    for r in warc.record_index(bundles).collect():
        one = warc.read_record(held[r.bundle_id], r.frame, r.offset, r.length)
        assert warc.record_name(one["page_id"]) == r.record_id
    for data in held.values():
        whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        assert whole == b"".join(warc.read_frame(data, f) for f in range(len(warc.seek_table(data))))


def test_bad_payload_is_found():
    record = warc.encode_record(1, "u", b"abc", hashlib.sha1(b"abd").hexdigest(), "response", None)
    with pytest.raises(ValueError):
        list(warc.decode_records(record))
    with pytest.raises(ValueError):
        warc.seek_table(b"123456789")


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_bundles(warc.write_bundles(warc.mark_revisits(pages))).count() == 0
