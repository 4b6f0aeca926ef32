import gzip
import hashlib
import io

import pytest

from granary.llm import warc


def brute(rows):
    first = {}
    for page, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 100 and page is not None:
            first[body] = min(page, first.get(body, page))
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        to = first.get(body)
        revisit = len(body) >= 100 and to is not None and page != to
        out.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    big = "x" * 99
    rows = [
        (5, "http://a/é b\n", big + "y"),
        (3, "http://a", big + "y"),
        (3, "http://a", big + "y"),
        (9, None, big),
        (10, "u", big),
        (11, "u", None),
        (12, "u", ""),
        (None, "u", big + "y"),
        (13, "u", "é" * 300_000),
        (14, "u", "\r\n\r\nWARC/1.1\r\n" * 20),
    ]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    archives = warc.write(frame, roll=2000)
    got = warc.read(archives, with_payload=True).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == brute(rows)
    html = {r[0]: (r[2] or "").encode() for r in rows}
    assert all(bytes(r.payload) == html[r.page_id] for r in got if r.record_type == "response")
    listed = archives.collect()
    assert sum(r.records for r in listed) == len(rows)
    for r in listed:
        body = open(r.path.removeprefix("file://"), "rb").read()
        assert len(body) == r.bytes and gzip.decompress(body).count(b"WARC/1.1\r\nWARC-Type") == r.records
    assert warc.read(warc.write(frame.limit(0))).count() == 0


def test_damage_is_found():
    body = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert warc.checked(body)[6] == b"payload"
    for bad in (
        body.replace(b"payload\r\n\r\n", b"paylaod\r\n\r\n"),
        body[:-1],
        body.replace(b"WARC/1.1", b"WARC/0.1"),
        body.replace(b"Content-Length: 8", b"Content-Length: 9", 1),
    ):
        if bad != body:
            with pytest.raises(warc.WarcError):
                warc.checked(bad)
    whole = warc.member(body) + warc.member(body)
    assert [at for at, _ in warc.members(io.BytesIO(whole), 7)] == [0, len(whole) // 2]
    for cut in (whole[:-1], whole[: len(whole) // 2] + b"x" + whole[len(whole) // 2 :], whole[:20] + b"\xff\xff\xff" + whole[23:]):
        with pytest.raises(warc.WarcError):
            list(warc.members(io.BytesIO(cut), 64))
