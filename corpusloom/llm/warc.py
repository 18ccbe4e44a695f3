"""WARC archives whose records are Zstandard frames of their own, under a dictionary made from the archive's records.

A writing task fills archives of some ARCHIVE bytes. From the records of each it builds a dictionary, puts it into a
skippable frame at the start, and compresses every record alone, so that a reader can start at any record with the
dictionary and an offset. Equal payloads of LEAST bytes or more are stored once: the record of the largest page_id is a
response, the others are revisits that refer to it.

Archives are rows of a table (name, data), written by Spark's own committer: that works on any store, and a lost
executor leaves no half archive. ``export`` turns the rows into files where a folder is mounted.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import re
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir, small_batches

LEAST = 1000  # payload bytes from which equal payloads are stored once
ARCHIVE = 16 << 20  # bytes of records in an archive before compression; one longer record has its own
DICTIONARY = 64 << 10
SAMPLE = 1 << 20  # bytes of an archive's records, evenly spread, that its dictionary is trained on
PIECE = 8 << 10
LEVEL = 6
FEW = 50_000  # groups of equal payloads, some 200 bytes each, that are broadcast; more are shuffled
DATE = "1970-01-01T00:00:00Z"

#: Fixed values of the formats: the skippable frame of a dictionary, and the profile of revisits.
MAGIC = (0x184D2A5D).to_bytes(4, "little")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVES = "archive string, records long, data binary"


# --- which record is which ---------------------------------------------------------------------------


def _joined(rows: DataFrame, groups: DataFrame, n: int, copies: int) -> DataFrame:
    """``rows`` with the group of their payload, if it has one. Few groups are broadcast. Of many, those with over a
    500th of the copies are, so at most 500, and only the rows of the others meet by a shuffle."""
    if n <= FEW:
        return rows.join(F.broadcast(groups), "_sha", "left")
    least = copies // 500 + 1
    hot = groups.select(F.col("_sha").alias("_key"), F.struct(*groups.columns).alias("_hot")).where(F.col("_hot.copies") >= least)
    cold = groups.select(F.col("_sha").alias("_key"), F.struct(*groups.columns).alias("_cold")).where(F.col("_cold.copies") < least)
    found = rows.withColumn("_key", F.col("_sha")).join(F.broadcast(hot), "_key", "left")
    # Rows that need no partner have a key of their own, so that they don't meet in one task.
    own = F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))
    found = found.withColumn("_key", F.when(F.col("_sha").isNull() | F.col("_hot").isNotNull(), own).otherwise(F.col("_sha")))
    both = found.join(cold, "_key", "left").withColumn("_g", F.coalesce("_hot", "_cold"))
    return both.select(*rows.columns, *(F.col(f"_g.{c}").alias(c) for c in groups.columns if c != "_sha"))


def records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, payload_bytes, payload_sha1, record_type, refers_to, target, payload) of every row of ``pages``.
    ``target`` is the identity of the response that a record is or refers to, null for payloads below ``least``.

    A null html is an empty payload. Of equal payloads the largest page_id is the response, null the smallest; of rows
    equal in page_id too, the one with the largest hash of its url; of rows equal in that as well, any one. Payloads of
    revisits are null, so that a group's payload is carried once. Columns beyond page_id, url, html are ignored.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"))
    size = F.octet_length("payload").cast("long")
    rows = rows.select("*", size.alias("payload_bytes"), F.sha1("payload").alias("payload_sha1"), F.when(size >= least, F.sha2("payload", 256)).alias("_sha"), F.md5(F.col("url").cast("binary")).alias("_u"))
    keys = rows.where("_sha IS NOT NULL").groupBy("_sha", "page_id", "_u").agg(F.count(F.lit(1)).alias("n"))
    last = F.struct("page_id", "_u")
    groups = keys.groupBy("_sha").agg(F.max(last).alias("_last"), F.max_by("n", last).alias("_n"), F.sum("n").alias("copies")).where("copies > 1")
    groups = cut(groups)
    n, copies, tied = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("copies"), F.lit(0)), F.count(F.when(F.col("_n") > 1, 1))).first()
    met = _joined(rows, groups, n, copies)
    # By value and nulls: a missing group compares as no winner, though page_id and url may be null themselves.
    wins = F.col("_last").isNull() | F.struct("page_id", "_u").eqNullSafe(F.col("_last"))
    target = F.when(F.col("_sha").isNotNull(), F.md5(F.concat_ws("|", "_sha", F.coalesce(F.col("_last.page_id"), F.col("page_id")).cast("string")).cast("binary")))

    def told(df: DataFrame, response: Column) -> DataFrame:
        return df.select(
            "page_id", "url", "payload_bytes", "payload_sha1", F.when(response, "response").otherwise("revisit").alias("record_type"),
            F.when(~response, F.col("_last.page_id")).alias("refers_to"), target.alias("target"), F.when(response, F.col("payload")).alias("payload"),
        )

    if not tied:
        return told(met, wins)
    # Rows equal in all columns that win together: one is taken as the response, the others follow from their number.
    same = wins & F.coalesce(F.col("_n") > 1, F.lit(False))
    one = met.where(same).dropDuplicates(["_sha"])
    step = 10_000
    parts = one.drop("payload").withColumn("_from", F.explode(F.expr(f"sequence(1, _n - 1, {step})"))).repartition("_sha", "_from")
    more = parts.withColumn("_each", F.explode(F.expr(f"sequence(_from, least(_from + {step} - 1, _n - 1))"))).withColumn("payload", F.lit(None).cast("binary"))
    return told(met.where(~same), wins).unionByName(told(one, F.lit(True))).unionByName(told(more, F.lit(False)))


# --- writing -----------------------------------------------------------------------------------------


def _header(fields: list[tuple[str, object]]) -> bytes:
    lines = [f"{k}: {v}" for k, v in fields if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode()


def _uri(url: str | None, page_id: object) -> str:
    """The url with what a header line can't hold escaped; a name made from the id where there is none."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"


def _id(seed: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(seed.encode()).digest(), version=4)}>"


def record(row: dict, name: str, at: int, date: str = DATE) -> bytes:
    """One record. What it answers with is in an HTTP head; a revisit has the head only, with the payload's full length."""
    body = row["payload"] if row["record_type"] == "response" else b""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode() + body
    revisit, target = row["record_type"] == "revisit", row["target"]
    mine = f"{name}|{at}" if revisit or target is None else target
    head = _header([
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", _id(mine)), ("WARC-Target-URI", _uri(row["url"], row["page_id"])), ("WARC-Date", date),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row["payload_sha1"])).decode()), ("WARC-Profile", PROFILE if revisit else None), ("WARC-Refers-To", _id(target) if revisit else None),
        ("X-Page-Id", row["page_id"]), ("X-Refers-To-Page-Id", row["refers_to"]), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block)),
    ])
    return head + block + b"\r\n\r\n"


def dictionary(found: list[bytes], size: int = DICTIONARY, sample: int = SAMPLE) -> bytes:
    """A dictionary from records: at most ``sample`` bytes of them, evenly spread, in pieces. Where they are too few to
    train on, the pieces themselves are one."""
    pieces = [r[k : k + PIECE] for r in found for k in range(0, len(r), PIECE)]
    step = max(1, -(-sum(map(len, pieces)) // sample))
    pieces = pieces[::step]
    try:
        return zstandard.train_dictionary(size, pieces, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-size:]


def archive(found: list[bytes], name: str, date: str = DATE, level: int = LEVEL) -> bytes:
    """The bytes of an archive: the dictionary's frame, a warcinfo record, and the records, a frame each."""
    info = b"software: corpusloom\r\nformat: WARC File Format 1.1\r\n"
    info = _header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _id(name)), ("WARC-Date", date), ("WARC-Filename", f"{name}.warc.zst"), ("Content-Type", "application/warc-fields"), ("Content-Length", len(info))]) + info + b"\r\n\r\n"
    words = dictionary(found)
    known = zstandard.ZstdCompressionDict(words)
    known.precompute_compress(level=level)
    tool = zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=True)
    frame = zstandard.ZstdCompressor(level=19).compress(words)
    return b"".join([MAGIC, len(frame).to_bytes(4, "little"), frame, *map(tool.compress, [info, *found])])


def archives(made: DataFrame, size: int = ARCHIVE, date: str = DATE) -> DataFrame:
    """The archives (name, number of records, data) of the rows of ``records``. A task writes one after another and holds
    the records of one; an empty task writes none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, n = TaskContext.get().partitionId(), 0
        name, held, total = f"pages-{part:06d}-{n:05d}", [], 0
        done = lambda: pd.DataFrame({"archive": [name], "records": [len(held)], "data": [archive(held, name, date)]})
        for b in batches:
            # Numbers stay Python's own: a column of ids and nulls would turn into floats.
            for row in b.astype(object).where(b.notna(), None).to_dict("records"):
                held.append(record(row, name, len(held), date))
                total += len(held[-1])
                if total >= size:
                    yield done()
                    n += 1
                    name, held, total = f"pages-{part:06d}-{n:05d}", [], 0
        if held:
            yield done()

    kept = made.withColumns({"page_id": F.col("page_id").cast("string"), "refers_to": F.col("refers_to").cast("string")})
    return small_batches(kept).mapInPandas(run, ARCHIVES)


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, size: int = ARCHIVE, date: str = DATE) -> DataFrame:
    """Write ``pages`` as a table of archives below ``folder``, on any store, and return that table. Files hold few
    archives each, so that a reader's batch is small."""
    archives(records(pages, least), size, date).write.option("compression", "none").option("maxRecordsPerFile", 8).parquet(folder)
    return pages.sparkSession.read.schema(ARCHIVES).parquet(folder)


def export(table: DataFrame, folder: str) -> None:
    """Write each archive as ``<name>.warc.zst`` into a folder that all tasks mount. A file appears whole or not at all."""

    def put(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            path = os.path.join(folder, f"{r.archive}.warc.zst")
            with open(f"{path}.{uuid.uuid4().hex}", "wb") as f:
                f.write(r.data)
            os.replace(f.name, path)

    table.select("archive", "data").foreachPartition(put)


# --- reading -----------------------------------------------------------------------------------------


def frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of every frame behind the dictionary's."""
    if data[:4] != MAGIC:
        raise ValueError("no dictionary at the start of the archive")
    at = 8 + int.from_bytes(data[4:8], "little")
    words = zstandard.ZstdDecompressor().decompress(data[8:at])
    known, view = zstandard.ZstdCompressionDict(words), memoryview(data)
    tool = zstandard.ZstdDecompressor(dict_data=known)
    while at < len(data):
        one, start, out = tool.decompressobj(), at, []
        while not one.eof:
            part = view[at : at + (1 << 16)]
            if not part:
                raise ValueError("the archive ends inside a record")
            out.append(one.decompress(part))
            at += len(part)
        at -= len(one.unused_data)
        yield start, b"".join(out)


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's fields, by lower-case name, and its block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def read_archives(table: DataFrame, id_type: str = "long", payloads: bool = False) -> DataFrame:
    """(archive, offset, page_id, url, payload_bytes, payload_digest, record_type, refers_to) of every record, with
    ``payload`` if asked for. A payload that doesn't match its digest, and an archive cut short, are errors. ``table``
    may also be ``spark.read.format("binaryFile")`` with ``path`` and ``content`` renamed to archive and data."""
    columns = ["archive", "offset", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["archive"], b["data"]):
                rows, held = [], 0
                for offset, raw in frames(data):
                    fields, block = parsed(raw)
                    if fields["warc-type"] == "warcinfo":
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"(?im)^content-length: *(\d+)", head)[1])
                    digest = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
                    if fields["warc-type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"{name}: the record at {offset} doesn't match its digest")
                    row = (name, offset, fields.get("x-page-id"), fields["warc-target-uri"], size, digest, fields["warc-type"], fields.get("x-refers-to-page-id"))
                    rows.append(row + (payload,) * payloads)
                    held += len(payload) if payloads else 0
                    if held >= 4 << 20:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    schema = "archive string, offset long, page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * payloads
    found = small_batches(table.select("archive", "data")).mapInPandas(run, schema)
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def archived_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """What op12 returns: archives are written into the shared folder and read back.

    Null html is an empty payload, null url a name made from the id, a null page_id stays null; rows repeated whole give
    one response and revisits of it, empty tables no archive, columns beyond page_id, url, html are ignored. A page of
    any length is one record; its archive then holds little else.
    """
    table = write_archives(pages, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    return read_archives(table, pages.schema["page_id"].dataType.simpleString()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
q AS (SELECT *, octet_length(encode(html)) AS n, max(page_id) OVER (PARTITION BY html) AS last, row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST, md5(url) DESC) AS k FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN n >= {LEAST} AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {LEAST} AND k > 1 THEN last END AS refers_to FROM q"""
