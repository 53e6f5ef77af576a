import base64
import gzip
import hashlib

import pytest

from tarnkite.llm import _common as c
from tarnkite.llm import warc


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, sha int, key string")


def rows_of(prose):
    rows = [(k, f"https://{'hot' if k % 3 else 'h%d' % (k % 11)}.Example.com:80/p/{k % 50}?q={k}", prose(k % 30, k % 20) + "é") for k in range(300)]
    return rows + [(900, None, None), (901, "", ""), (902, "no host\tat all\n", "x" * 300_000), (903, "http://u@h.org", None), (904, "http://h.org/%41é", "tail"), (904, "http://h.org/%41é", "tail"), (None, "http://h.org/n", "tail"), (905, "http://h.org/", "tail")]


def brute(rows, least=0):
    first, out = {}, []
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    for k in order:
        payload = (rows[k][2] or "").encode()
        head = first.setdefault(payload, k)
        again = head != k and len(payload) >= least
        out.append((rows[k][0], rows[k][1], len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if again else "response", rows[head][0] if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 50])
def test_round_trip_by_the_index(spark, prose, monkeypatch, least):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    monkeypatch.setattr(warc, "PART_BLOCKS", 3)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 5000)
    rows, folder = rows_of(prose), c.new_folder(spark, "warc-test")
    warc.archive_pages(table(spark, rows).repartition(3), folder, least)
    got = warc.read_pages(table(spark, rows), folder).collect()
    assert sorted(((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == brute(rows, least)
    text = {r[0]: (r[2] or "").encode() for r in rows}
    assert all(bytes(r.payload) == text[r.page_id] for r in got if r.record_type == "response")
    some = warc.read_pages(table(spark, [rows[7], rows[250], (12345, "http://none.org/", "")]), folder).collect()
    assert sorted(r.page_id for r in some) == [rows[7][0], rows[250][0]]


def test_archives_are_gzip_members_of_warc_records(spark, prose, tmp_path):
    warc.archive_pages(table(spark, rows_of(prose)[:5]).coalesce(1), f"file://{tmp_path}")
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "archives").glob("*.warc.gz")))
    assert raw.count(b"WARC/1.1\r\n") == 5
    assert raw.count(b"\r\n\r\n") >= 10


def test_keys_sort_by_reversed_host():
    assert warc.url_key("https://www.Example.com:80/a?b") == "com,example,www:80)/a?b"
    assert warc.url_key("http://h.org") == "org,h)/"
    assert warc.url_key(None) == ""
    assert "\t" not in warc.url_key("a\tb")
    assert warc.capture_key("http://h.org", 5) < warc.capture_key("http://h.org", 40) < warc.capture_key("http://h.org", None)


def test_empty_table(spark, prose):
    folder = c.new_folder(spark, "warc-empty")
    none = table(spark, rows_of(prose)).limit(0)
    warc.archive_pages(none, folder)
    assert warc.read_pages(none, folder).count() == 0
    assert warc.read_pages(table(spark, rows_of(prose)[:2]), folder).count() == 0


@pytest.mark.parametrize("least", [0, 50])
def test_payloads_that_pass_the_filter_by_chance(spark, prose, monkeypatch, least):
    """A filter of 64 bits lets most payloads through; they are told by their digests."""
    monkeypatch.setattr(c, "filter_bits", lambda n, **_: 6)
    rows, folder = rows_of(prose), c.new_folder(spark, "warc-filter")
    warc.archive_pages(table(spark, rows).repartition(3), folder, least)
    got = warc.read_pages(table(spark, rows), folder).collect()
    assert sorted(((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == brute(rows, least)
    text = {r[0]: (r[2] or "").encode() for r in rows}
    assert all(bytes(r.payload) == text[r.page_id] for r in got if r.record_type == "response")


def test_folders_by_scheme(monkeypatch):
    asked = []
    monkeypatch.setattr(warc.fs, "FileSystem", type("Fake", (), {"from_uri": staticmethod(lambda uri: asked.append(uri) or (None, uri))}))
    for folder in ("file:///a", "s3a://b/c", "s3n://b/c", "dbfs:/d/e", "hdfs://n/f"):
        warc.store(folder)
    assert asked == ["file:///a", "s3://b/c", "s3://b/c", "file:///dbfs/d/e", "hdfs://n/f"]
    monkeypatch.undo()
    with pytest.raises(ValueError, match="viewfs"):
        warc.store("viewfs://store/a")
