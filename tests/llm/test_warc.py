"""Archive conversion: round trips, both versions, revisits."""

from __future__ import annotations

import hashlib

from panelwise.llm import warc

BIG = "ä" * 600


def test_pages_come_back(spark):
    rows = [(1, "http://a/ b", BIG), (5, "http://c", BIG), (3, None, BIG), (3, None, BIG), (None, "x y", BIG), (7, "http://d", "same"), (8, "http://e", "same"),
            (9, "http://f", None), (10, "", "WARC/1.1\r\n\r\n\n"), (None, None, None), (11, "http://g", "z" * 300000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, offset int").repartition(2)
    arcs = warc.write_arc(pages, roll=2000)
    versions = {warc.unzip(warc.fetch(r.path)).split(b"\n")[1][:1] for r in arcs.collect()}
    assert versions == {b"1", b"2"}
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_warc(warc.convert(arcs)).collect())

    def plain(page_id, html):
        data = (html or "").encode()
        known = [p for p, _, h in rows if p is not None and (h or "") == (html or "")]
        top = max(known, default=None)
        again = len(data) >= 1000 and page_id is not None and page_id != top
        return str(page_id), len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top if again else None

    assert got == sorted(plain(p, h) for p, _, h in rows)


def test_converter_synthesises_fields():
    data = warc.arc_head(2, "n.arc", "20010203040506") + warc.arc_record(2, "n.arc", 0, "http://a", 4, b"hi", "20010203040506")
    made = [warc.warc_record(f, body, None, f"n:{at}") for at, f, body in warc.arc_records(data)]
    (info, _), (page, block) = warc.warc_records(b"".join(made))
    assert info["WARC-Type"] == "warcinfo" and info["WARC-Filename"] == "n.arc"
    assert page["WARC-Date"] == "2001-02-03T04:05:06Z" and page["WARC-Record-ID"] == "<urn:page:4>" and block.endswith(b"\r\n\r\nhi")
    assert page["WARC-Payload-Digest"] == warc.sha1(b"hi")


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_warc(warc.convert(warc.write_arc(pages))).collect() == []
