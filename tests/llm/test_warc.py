import gzip
import hashlib
import io

from ontoweave.llm import warc

BIG = "<p>" + "x" * 200 + "é</p>"
PAGES = [(3, "http://a/b c", BIG), (1, "http://a/é", "small"), (2, None, "small"), (7, "http://b", BIG), (5, "http://c", None), (9, "http://d", ""), (8, "u", "y" * 300_000), (4, "v", BIG), (3, "http://twin", BIG), (None, "n", BIG)]


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, digest string")
    path = f"file://{tmp_path}/w"
    manifest = warc.write_warc(pages, path, file_bytes=1000)
    assert manifest.count() > 2
    got = warc.read_warc(spark, path).collect()
    assert sorted((r["page_id"] or -1) for r in got) == sorted((p[0] or -1) for p in PAGES)
    for r in got:
        html = {(p[0], p[2]) for p in PAGES if p[0] == r["page_id"]}
        payload = (next(iter(html))[1] or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), hashlib.sha256(payload).hexdigest())
        revisit = payload == BIG.encode() and r["page_id"] != 3
        assert (r["record_type"], r["refers_to"]) == (("revisit", 3) if revisit else ("response", None))
    again = warc.write_warc(pages, f"file://{tmp_path}/again", file_bytes=1000)
    key = lambda df: sorted((r["file"], r["sha256"]) for r in df.collect())
    assert key(manifest) == key(again), "the same rows give the same bytes"
    assert not [p.name for p in (tmp_path / "w").iterdir() if p.name.startswith(".0")], "no temporary names are left"


def test_record_ids_are_unique(spark, tmp_path):
    rows = [(1, f"http://a/{i % 3}", BIG) for i in range(7)] + [(2, "http://b", BIG)] * 3 + [(None, None, None)] * 2
    path = f"file://{tmp_path}/ids"
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    records = [h for f in sorted((tmp_path / "ids").glob("*.warc.gz")) for h, _, _ in warc.read_records(f.open("rb"))]
    ids = [h["WARC-Record-ID"] for h in records]
    assert len(ids) == len(set(ids)) and {h["WARC-Refers-To"] for h in records if "WARC-Refers-To" in h} <= set(ids)


def test_records_are_standard():
    data = warc.member(warc.page_record(1, "http://x/", b"<p>" * 50, None)) + warc.member(warc.page_record(2, "http://y/", b"<p>" * 50, 1, "http://x/"))
    text = gzip.decompress(data).decode()
    assert text.startswith("WARC/1.1\r\nWARC-Type: response\r\n") and "WARC-Type: revisit" in text and "WARC-Refers-To-Target-URI: http://x/" in text
    (h1, b1, at1), (h2, b2, at2) = warc.read_records(io.BytesIO(data))
    assert at1 == 0 < at2 and h2["WARC-Refers-To"] == h1["WARC-Record-ID"] and b2.endswith(b"\r\n\r\n") and b1.endswith(b"<p>")


def test_empty_table(spark):
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
