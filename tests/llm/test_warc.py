import base64
import hashlib
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from pairlens.llm import warc as op


def pages():
    rows = [(k, f"http://h{k % 7}.example/{k} x", f"<html><body>page {k % 90} {'text ' * (k % 50)}</body></html>") for k in range(300)]
    rows += [(1000 + k, "http://hot", "<p>hot</p>") for k in range(200)]
    rows += [(2000, None, None), (2001, "http://e", ""), (2002, "http://l", "long é\r\n\r\n" * 60_000), (None, "http://n", "<p>hot</p>"), (None, "http://n", "alone"), (1199, "http://hot", "<p>hot</p>")]
    return rows


def brute(rows, least=0):
    by = {}
    for i, _, h in rows:
        by.setdefault(h or "", []).append(i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        ids = [x for x in by[h or ""] if x is not None]
        keep = max(ids, default=None) if len(raw) >= least and len(by[h or ""]) > 1 else None
        revisit = keep is not None and i != keep
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", keep if revisit else None))
    return sorted(out, key=str)


def test_round_trip_matches_brute_force(spark):
    rows = pages()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string").repartition(4)
    for least in (0, 20):
        assert sorted((tuple(r) for r in op.round_trip(df, least).collect()), key=str) == brute(rows, least)


def test_files_hold_payloads_and_dictionary(spark, tmp_path):
    rows = pages()[:200]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    folder = f"file://{tmp_path}/out"
    listed = op.write_archives(op.decided(df), folder, archive_bytes=20_000)
    made = listed.collect()
    assert sum(m.records for m in made) == 200 and len(made) > 3
    first = (tmp_path / "out" / made[0].file).read_bytes()
    assert struct.unpack("<I", first[:4])[0] == op.SKIPPABLE
    html = {r.page_id: r.payload for r in op.read_archives(listed, folder).collect() if r.record_type == "response"}
    assert html and all(html[i] == h.encode() for i, _, h in rows if i in html)


def test_archives_of_other_attempts_are_not_read(spark, tmp_path):
    df = spark.createDataFrame(pages()[:200], "page_id long, url string, html string").repartition(1)
    folder = f"file://{tmp_path}/out"
    order = op.decided(df).repartition(1)
    listed = op.write_archives(order.sortWithinPartitions("page_id"), folder, archive_bytes=9_000)
    # a task that runs once more, over its rows in another order, leaves archives of its own
    again = op.write_archives(order.sortWithinPartitions(F.length("payload")), folder, archive_bytes=9_000)
    assert {r.file for r in listed.collect()}.isdisjoint({r.file for r in again.collect()}) and [r.records for r in listed.collect()] != [r.records for r in again.collect()]
    for made in (listed, again):
        assert sorted(r.page_id for r in op.read_archives(made, folder).collect()) == list(range(200))
    (tmp_path / "out" / listed.first().file).write_bytes(b"")
    with pytest.raises(Exception, match="bytes, .* were written"):
        op.read_archives(listed, folder).collect()


def test_one_page_with_several_payloads(spark, tmp_path):
    rows = [(1, "http://a", "one"), (1, "http://a", "two"), (2, "http://b", "two"), (2, "http://b", "two")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted((tuple(r) for r in op.round_trip(df).collect()), key=str) == brute(rows)
    raw = [op.build(i, u, h.encode(), "response") for i, u, h in rows]
    ids = [op.read_record(r).headers["warc-record-id"] for r in raw]
    assert len(set(ids)) == 3 and [op.page_of(i) for i in ids] == [1, 1, 2, 2]


def test_empty_table(spark):
    assert op.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


RECORDS = [op.build(k, f"http://x/{k}", f"<p>payload {k} of the archive</p>".encode() * 9, "response") for k in range(60)]


@pytest.mark.parametrize("squeezed", [False, True])
def test_dictionary_may_be_compressed_and_is_needed(squeezed):
    own = op.train(RECORDS)
    raw = op.write_archive(RECORDS, own)
    if squeezed:
        small = zstandard.compress(own)
        raw = struct.pack("<II", op.SKIPPABLE, len(small)) + small + raw[8 + len(own) :]
    assert [r.page_id for r in op.read_archive(raw)] == list(range(60))
    bare = raw[8 + struct.unpack_from("<I", raw, 4)[0] :]
    with pytest.raises(op.WarcError):
        list(op.read_archive(bare))


def test_frames_of_any_size_are_walked():
    big = op.build(1, None, bytes(range(256)) * 4000, "response")
    raw = op.write_archive([big, RECORDS[0], op.build(2, "u", b"", "response")], None)
    assert [r.payload_bytes for r in op.read_archive(raw)] == [1_024_000, len(RECORDS[0].split(b"\r\n\r\n", 2)[2]) - 4, 0]
    for cut in (len(raw) - 1, 10, 3):
        with pytest.raises(op.WarcError):
            list(op.read_archive(raw[:cut]))


@pytest.mark.parametrize("old,new", [(b"WARC/1.1", b"WARC/9.9"), (b"WARC-Date", b"X-Date"), (b"payload 0", b"payload 1"), (b"Content-Type: text/html", b"Content-Typ: text/html"), (b"WARC-Type: response", b"WARC-Type: metadata")])
def test_damaged_records_are_refused(old, new):
    assert old in RECORDS[0]
    with pytest.raises(op.WarcError):
        op.read_record(RECORDS[0].replace(old, new, 1))
