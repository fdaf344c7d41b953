"""Archives: an exact round trip at any split, and false magic in the data."""

import base64
import gzip
import hashlib
import io

import pytest

from cribble.llm.warc import MAGIC, members, parsed, read_archives, record_of, write_archives


def sha1(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.mark.parametrize("split", [1 << 22, 300, 17])
def test_round_trip(spark, split):
    bodies = ["<p>hé</p>" * 50, "", None, "other", "long " * 3000]
    items = [(i, ["http://a/%d" % i, None, "x\r\ny"][i % 3], bodies[i % 5] if i % 4 else f"own {i}") for i in range(200)]
    df = spark.createDataFrame(items, "id bigint, url string, body string").selectExpr("*", "1 AS refers_to", "2 AS print").repartition(3)
    last = {}
    for i, _, body in items:
        last[body or ""] = max(i, last.get(body or "", -1))
    rows = read_archives(write_archives(df, archive_bytes=5000), split, with_body=True).collect()
    assert len(rows) == 200
    by_id = {r.id: r for r in rows}
    for i, url, body in items:
        r, holder = by_id[i], last[body or ""]
        assert r.payload_bytes == len((body or "").encode()) and r.payload_digest == sha1(body)
        assert r.url == (url and url.replace("\r\n", "%0D%0A"))
        if holder == i:
            assert r.record_type == "response" and r.refers_to is None and bytes(r.body).decode() == (body or "")
        else:
            assert r.record_type == "revisit" and r.refers_to == holder and r.body is None


def test_odd_rows(spark):
    rows = [(1, "u", "a"), (1, "u", "a"), (2, "u", "b"), (None, "u", "b"), (3, None, None), (4, None, "")]
    df = spark.createDataFrame(rows, "id bigint, url string, body string").repartition(2)
    got = sorted(((r.id, r.record_type, r.refers_to) for r in read_archives(write_archives(df)).collect()), key=str)
    assert got == sorted([(1, "response", None)] * 2 + [(2, "response", None), (None, "revisit", 2), (3, "revisit", 4), (4, "response", None)], key=str)
    # Bodies shorter than asked for are never revisits.
    long = read_archives(write_archives(df, min_revisit=2)).collect()
    assert {r.record_type for r in long} == {"response"}
    assert read_archives(write_archives(df.limit(0))).count() == 0


def test_false_magic_is_passed_over():
    inner = gzip.compress(b"not a record") + MAGIC + b"junk" + gzip.compress(record_of(9, None, b"cut", None))[:-9]
    good = [gzip.compress(record_of(i, f"u{i}", bytes([65 + i]) * 700, None)) for i in range(5)]
    data = inner + good[0] + b"\x1f\x8b" + good[1] + inner + good[2] + good[3] + good[4]
    for step in (1, 7, 64, 1000, len(data)):
        found = [parsed(r)["id"] for a in range(0, len(data), step) for r in members(io.BytesIO(data), a, a + step)]
        assert found == [0, 1, 2, 3, 4]
