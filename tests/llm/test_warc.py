import base64
import hashlib
import zlib

from awkward import result
from haulage.llm import warc as W

COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
PAGES = [(5, "http://a/5", "<p>one</p>", "x"), (3, "http://a/3", "<p>one</p>", "x"), (9, "http://a/9", "<p>two é</p>\r\n\r\nmore", None),
         (1, None, None, "x"), (2, "http://a/2", "", "x"), (7, "http://a/7\r\nX-Evil: 1", "<b>" + "long " * 50_000 + "</b>", "x"),
         (None, "http://a/n", "<p>one</p>", "x"), (8, "http://a/8", "\r\n\r\n", "x"), (3, "http://a/3b", "<p>one</p>", "x"),
         (9, "http://a/9", "<p>other</p>", "x")] + [(100 + k, f"http://b/{k}", "<p>hot</p>", "x") for k in range(40)]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(4)


def brute(rows, least=0):
    first = {}
    for page, _, html, _ in rows:
        html = html or ""
        first[html] = min(first.get(html, 2**63 - 1), 2**63 - 1 if page is None else page)
    out = []
    for page, _, html, _ in rows:
        raw = (html or "").encode()
        response = page == first[html or ""] or len(raw) < least
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if response else "revisit",
                    None if response else first[html or ""]))
    return sorted(out, key=repr)


def test_records_read_back_equal_brute_force(spark):
    index = W.write_warc(pages(spark), max_file_bytes=2000)
    assert result(W.read_warc(index), *COLUMNS) == brute(PAGES)
    index = W.write_warc(pages(spark), min_bytes=11)
    assert result(W.read_warc(index), *COLUMNS) == brute(PAGES, 11)


def test_payloads_urls_and_selection(spark):
    index = W.write_warc(pages(spark))
    some = W.read_warc(index.where("page_id IN (9, 7, 2)")).collect()
    texts = {(p, (h or "").encode()) for p, _, h, _ in PAGES}
    assert sorted(r["page_id"] for r in some) == [2, 7, 9, 9]
    for r in some:
        assert (r["payload"] is None) == (r["record_type"] == "revisit")
        assert r["payload"] is None or (r["page_id"], bytes(r["payload"])) in texts
    assert {r["url"] for r in some if r["page_id"] == 7} == {"http://a/7%0D%0AX-Evil: 1"}


def test_archives_are_whole_gzip_members_that_the_index_covers(spark):
    rows = W.write_warc(pages(spark)).collect()
    by_file = {}
    for r in rows:
        by_file.setdefault((r["folder"], r["file"]), []).append((r["offset"], r["length"]))
    for (folder, name), ranges in by_file.items():
        data = open(f"{folder.removeprefix('file:')}/{name}", "rb").read()
        at = 0
        for offset, length in sorted(ranges):
            assert offset == at
            assert zlib.decompress(data[offset:offset + length], 31).startswith(b"WARC/1.1\r\n")
            at += length
        assert at == len(data)


def test_ranges_coalesce():
    runs = list(W.coalesced([(0, 10), (10, 5), (20, 5), (1000, 5)], gap=8, most=100))
    assert [(a, b, m) for a, b, m in runs] == [(0, 25, [0, 1, 2]), (1000, 1005, [3])]
    assert len(list(W.coalesced([(0, 60), (60, 60)], gap=8, most=100))) == 2


def test_empty_table(spark):
    index = W.write_warc(pages(spark, []))
    assert index.count() == 0 and W.read_warc(index).count() == 0
