"""Archives: written, read back, opened at any record, and held against the rules."""

import hashlib
import os

import pytest
import zstandard

from corpusloom.llm import warc

SCHEMA = "page_id long, url string, html string"
LONG = "<p>" + "long payload " * 200
COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def plain(rows):
    found = []
    groups = {}
    for i, _, html in rows:
        if len((html or "").encode()) >= warc.LEAST:
            groups.setdefault(html, []).append(i)
    answered = set()
    for i, _, html in rows:
        data = (html or "").encode()
        last = max(groups.get(html, [i]), key=lambda x: (x is not None, x or 0))
        first = html not in groups or (i == last and html not in answered)
        answered |= {html} if i == last else set()
        found.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if first else "revisit", None if first else last))
    return sorted(found, key=repr)


def archived(spark, rows):
    return sorted((tuple(r) for r in warc.archived_pages(spark, rows).select(COLUMNS).collect()), key=repr)


ROWS = [
    (1, "http://a/1", LONG), (2, "http://a/2", LONG), (3, "http://a/3 x\r\ny", LONG + "é漢字"), (4, None, None), (5, "", ""), (6, "http://a/6", "short"), (7, "http://a/7", "short"),
    (8, "http://b", LONG * 2), (8, "http://b", LONG * 2), (8, "http://b", LONG * 2), (8, "http://c", LONG * 2), (None, None, LONG * 3), (None, None, LONG * 3), (9, "u", "x" * 999), (10, "u", "x" * 999), (11, "u", "y" * 1000), (12, "v", "y" * 1000), ((1 << 53) + 1, "v", "z"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def test_rules(spark, pages):
    assert archived(spark, pages) == plain(ROWS)
    extra = pages.selectExpr("*", "url AS payload", "page_id AS copies", "html AS _sha", "1 AS _n")
    assert archived(spark, extra) == plain(ROWS)
    assert archived(spark, pages.where("false")) == []


def test_many_groups_are_shuffled(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "FEW", 0)
    assert archived(spark, pages) == plain(ROWS)


def test_archives_hold_records_alone(spark, pages, tmp_path):
    table = warc.write_archives(pages.where("page_id < 100"), str(tmp_path / "t"), size=4000)
    assert table.count() > 3
    for r in table.collect():
        assert r.data[:4] == b"\x5d\x2a\x4d\x18"
        size = int.from_bytes(r.data[4:8], "little")
        words = zstandard.ZstdDecompressor().decompress(r.data[8 : 8 + size])
        tool = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
        records = list(warc.frames(r.data))
        assert len(records) == r.records + 1
        for offset, raw in records:  # each from its own offset
            assert tool.decompress(r.data[offset:], max_output_size=1 << 24) == raw
            fields, block = warc.parsed(raw)
            assert raw.endswith(b"\r\n\r\n") and fields["warc-date"] == warc.DATE and len(block) == int(fields["content-length"])
    read = warc.read_archives(table, payloads=True)
    responses = {r.page_id: bytes(r.payload).decode() for r in read.where("record_type = 'response'").collect()}
    assert all(responses[i] == (html or "") for i, _, html in ROWS if i in responses and i != 8)
    warc.export(table, str(tmp_path / "files"))
    files = spark.read.format("binaryFile").load(str(tmp_path / "files")).selectExpr("path AS archive", "content AS data")
    assert sorted(os.listdir(tmp_path / "files")) == sorted(f"{r.archive}.warc.zst" for r in table.collect())
    assert sorted(map(repr, warc.read_archives(files).drop("archive").collect())) == sorted(map(repr, warc.read_archives(table).drop("archive").collect()))


def test_revisits_name_their_response(spark, pages):
    made = warc.records(pages.where("page_id < 3"))
    raw = [warc.parsed(warc.record(r.asDict(), "n", k))[0] for k, r in enumerate(made.collect())]
    (response,), (revisit,) = ([f for f in raw if f["warc-type"] == t] for t in ("response", "revisit"))
    assert revisit["warc-refers-to"] == response["warc-record-id"] and revisit["warc-profile"] == warc.PROFILE
    assert revisit["warc-payload-digest"] == response["warc-payload-digest"] and revisit["warc-record-id"] != response["warc-record-id"]


def test_damage_is_told(spark):
    found = [warc.record({"page_id": k, "url": "u", "payload": b"x" * 2000, "payload_bytes": 2000, "payload_sha1": "00" * 20, "record_type": "response", "refers_to": None, "target": None}, "n", k) for k in range(3)]
    data = warc.archive(found, "n")
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.frames(data[:-5]))
    with pytest.raises(ValueError, match="no dictionary"):
        list(warc.frames(data[1:]))
    with pytest.raises(Exception, match="doesn't match its digest"):
        warc.read_archives(spark.createDataFrame([("n", bytearray(data))], "archive string, data binary")).collect()


def test_dictionary_pays():
    found = [warc.record({"page_id": k, "url": f"http://host/{k}", "payload": f"<html><head><title>{k}</title></head><body>{k * 7919}</body></html>".encode(), "payload_bytes": 10, "payload_sha1": hashlib.sha1(str(k).encode()).hexdigest(), "record_type": "response", "refers_to": None, "target": None}, "n", k) for k in range(2000)]
    alone = sum(len(zstandard.ZstdCompressor(level=warc.LEVEL).compress(r)) for r in found)
    assert len(warc.archive(found, "n")) < 0.7 * alone
