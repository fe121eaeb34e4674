from __future__ import annotations

import hashlib

from prose import prose

from hornspark.llm import warc

PAGES = "page_id long, url string, html string, key string, size string"
BIG = "<html>" + prose(60, 1) + "é</html>"
ROWS = [
    (5, "http://www.Example.com:80/A?b=1#c", BIG), (2, "https://example.com/a", BIG), (9, "http://example.com/a", BIG), (3, None, "small"), (4, "not a url", "small"), (6, "http://[bad", None), (7, "http://x.org/é \r\nInjected: 1", ""),
    (2, "https://example.com/a", BIG), (None, "http://null.org/", BIG), (8, "http://null.org/", None), (10, "http://example.com/a", "y" * 100), (11, "http://example.com/a", "y" * 99), (12, "http://example.com/long", "z\r\n\r\n" * 100_000),
]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "k", None) for r in rows], PAGES)


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 3)
    archive = warc.write_archive(pages(spark, ROWS))
    got = [(r["page_id"], r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in archive.records().collect()]
    want = []
    for i, _, html in ROWS:
        raw = (html or "").encode()
        again = html == BIG and i != 2
        want.append((i, "revisit" if again else "response", len(raw), hashlib.sha256(raw).hexdigest(), 2 if again else None))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_lookups_by_url(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 2)
    archive = warc.write_archive(pages(spark, [*ROWS, *((100 + i, f"http://site{i % 7}.net/p{i}", f"page {i}") for i in range(40))]))
    asked = spark.createDataFrame([("http://EXAMPLE.com/a#x",), ("http://site3.net/p10",), ("http://nowhere.net/",), (None,)], "url string")
    found = {(r["query"], r["page_id"]) for r in archive.lookup(asked).collect()}
    assert found == {("http://EXAMPLE.com/a#x", i) for i in (2, 9, 10, 11)} | {("http://site3.net/p10", 110), (None, 3)}
    payload = archive.records(archive.lookup(asked.where("url LIKE '%site3%'"))).collect()
    assert [bytes(r["payload"]) for r in payload] == [b"page 10"]


def test_a_directory_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 3)
    monkeypatch.setattr(warc, "ENTRIES", 2)
    monkeypatch.setattr(warc, "HELD", 1)
    # A third of all rows have one URL, whose captures fill many blocks; two URLs have one key.
    rows = [(i, "http://hot.org/" if i % 3 == 0 else f"https://host{i % 11}.net/{i}", f"page {i}") for i in range(240)] + [(900, "https://hot.org/", "other"), (901, None, None)]
    archive = warc.write_archive(pages(spark, rows).repartition(3))
    assert len(archive.root) >= 30 and archive.n_captures == len(rows) and archive.bytes > 0
    asked = pages(spark, rows).select("url").distinct()
    found = sorted((r["query"] or "", r["page_id"]) for r in archive.lookup(asked).collect())
    key = lambda u: warc.url_key(u)
    assert found == sorted((q or "", i) for q in {r[1] for r in rows} for i, u, _ in rows if key(u) == key(q))
    own = archive.lookup(asked).where("query <=> url")
    assert sorted(r["page_id"] for r in archive.records(own).collect()) == sorted(r[0] for r in rows)


def test_empty_table(spark):
    archive = warc.write_archive(pages(spark, []))
    assert archive.records().collect() == [] and archive.lookup(spark.createDataFrame([("http://a.b/",)], "url string")).collect() == []


def test_keys():
    assert warc.url_key("HTTP://user@www2.Example.co.uk:8080/Path?Q=1#f") == "uk,co,example:8080)/path?q=1"
    assert warc.url_key("https://a.b:443") == "b,a)/" and warc.url_key(None) == ")" and warc.url_key("mailto:x") == ")mailto:x"
