import base64
import gzip
import hashlib

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import warc
from loomgraph.session import fresh_path

PAGES = [(k, f"http://h/{k}?q=%20ü", h) for k, h in enumerate(["<p>a</p>", "<p>b</p>", "<p>a</p>", "", None, "<p>ü\r\n\r\nWARC/1.1</p>", "<p>a</p>", "x" * 700_000, "long" * 40])]


def sha(h):
    return base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()


def brute(rows, least=0):
    out = []
    for p, _, h in rows:
        same = [q for q, _, g in rows if (g or "") == (h or "") and q is not None] if len((h or "").encode()) >= least else []
        owner = max(same, default=None)
        kind = "response" if owner is None or p == owner else "revisit"
        out.append((p, len((h or "").encode()), sha(h), kind, owner if kind == "revisit" else None))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, sha string")


@pytest.mark.parametrize("least", [0, 9, 10**6])
def test_round_trip(spark, least):
    got = warc.round_trip(frame(spark, PAGES).repartition(3), least)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(PAGES, least)


def test_odd_ids_repeated_rows_and_empty_tables(spark):
    rows = [(None, None, "a"), (None, "u", "b"), (4, "u\r\nX: y", "a"), (4, None, "a"), (5, None, "c")]
    assert sorted((tuple(r) for r in warc.round_trip(frame(spark, rows)).collect()), key=str) == brute(rows)
    assert warc.round_trip(frame(spark, PAGES).limit(0)).count() == 0


def test_archives_are_plain_warc_and_the_index_leads_to_each_record(spark):
    folder = fresh_path(spark, "warc-test")
    index = warc.write(frame(spark, PAGES), folder)
    fs, at = pafs.FileSystem.from_uri(folder)
    for r in index.collect():
        with fs.open_input_file(f"{at}/{r.file}") as f:
            whole = f.read()
        text = gzip.decompress(whole).decode()
        assert text.count("WARC-Record-ID: ") == index.where(F.col("file") == r.file).count()
        one = warc.decode_record(whole[r.offset : r.offset + r.length])
        assert (one["page_id"], one["record_type"], one["payload_digest"]) == (r.page_id, r.record_type, r.payload_digest)
    some = index.where("page_id % 2 = 0")
    assert {r.page_id: bytes(r.payload).decode() for r in warc.payloads(folder, index, some).collect()} == {p: h or "" for p, _, h in PAGES if p % 2 == 0}
    assert {r.page_id for r in warc.read(folder, some).collect()} == {0, 2, 4, 6, 8}


def test_ranges_join_over_small_gaps_only():
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 40, 10), ("a", 500, 10), ("b", 0, 10)]
    assert list(warc.coalesced(rows, gap=30, span=60)) == [("a", 0, 50, [(0, 10), (10, 5), (40, 10)]), ("a", 500, 10, [(0, 10)]), ("b", 0, 10, [(0, 10)])]
    assert len(list(warc.coalesced(rows, gap=1000, span=15))) == 4


def test_damage_is_noticed():
    member = warc.encode_record(1, "u", b"payload", None, False, warc.digest(b"other"))
    with pytest.raises(ValueError, match="damaged"):
        warc.decode_record(member)
