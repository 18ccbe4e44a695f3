"""GIF media columns: LZW code streams, palettes, disposal, transparency, timed frames, colour histograms.

Decoding runs in Python tasks, one medium at a time; a row is a medium or a frame of one. Nothing is
shuffled. Texts become media here to have something to store: their bytes are palette indexes of frames
of ROW by ROW pixels at most.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import in_blocks

UNIT = 576  # a payload is padded to a positive multiple of so many bytes
PAD = 255
ROW = 96  # pixels across and at most down; UNIT is 6 such rows
DELAY = 4  # hundredths of a second
BINS = 64  # two bits of each colour
BLOCK = 4 << 20  # bytes of text whose media are handed on together

_I = np.arange(256)
#: 256 colours, each its own: three bits of red and green, two of blue.
PALETTE = np.stack([(_I >> 5) * 36, (_I >> 2 & 7) * 36, (_I & 3) * 85], axis=1).astype(np.uint8)


@functools.lru_cache(8)
def _widths(least: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths of the codes after a clear code, until they stay at 12, and their bit offsets with the end."""
    table = (1 << least) + 2 + np.maximum(np.arange(4098 - (1 << least)) - 1, 0)
    widths = np.clip(np.floor(np.log2(table)).astype(np.int64) + 1, least + 1, 12)
    return widths, np.r_[0, np.cumsum(widths)]


def lzw_encode(data: bytes, least: int = 8) -> bytes:
    """A GIF code stream for ``data``: clear code first, another whenever the table is full, end code last."""
    clear, end = 1 << least, (1 << least) + 1
    codes, cuts, table, free = [clear], [], {}, end + 1
    add, get = codes.append, table.get
    rest = iter(data)
    now = next(rest, None)
    if now is not None:
        for b in rest:
            key = now << 8 | b
            longer = get(key)
            if longer is not None:
                now = longer
                continue
            add(now)
            now = b
            if free < 4096:
                table[key] = free
                free += 1
            else:
                add(clear)
                cuts.append(len(codes))
                table.clear()
                free = end + 1
        add(now)
    add(end)
    known, _ = _widths(least)
    edges = [1, *cuts, len(codes)]
    widths = np.concatenate([[least + 1], *(known[: b - a] if b - a <= len(known) else np.r_[known, np.full(b - a - len(known), 12)] for a, b in zip(edges, edges[1:]))])
    bit = np.arange(12)
    bits = (np.array(codes)[:, None] >> bit & 1).astype(np.uint8)[bit < widths[:, None]]
    return np.packbits(bits, bitorder="little").tobytes()


def lzw_decode(data: bytes, least: int) -> bytes:
    """The samples of a code stream; of a broken one, those before the fault."""
    clear, end = 1 << least, (1 << least) + 1
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    bits, at, out = 8 * len(data), 0, []
    table, last, steady = roots.copy(), b"", False
    known, offsets = _widths(least)
    while at < bits:
        widths, places = (np.full(4096, 12), 12 * np.arange(4097)) if steady else (known, offsets)
        n = int(np.searchsorted(places, bits - at, side="right")) - 1
        if n <= 0:
            break
        o = at + places[:n]
        codes = (raw[o >> 3] | raw[(o >> 3) + 1] << 8 | raw[(o >> 3) + 2] << 16) >> (o & 7) & (1 << widths[:n]) - 1
        stop = np.flatnonzero((codes == clear) | (codes == end))[:1].tolist()
        for code in codes[: stop[0] if stop else n].tolist():
            if code < len(table):
                entry = table[code]
            elif last and code == len(table):
                entry = last + last[:1]
            else:
                return b"".join(out)
            out.append(entry)
            if last and len(table) < 4096:
                table.append(last + entry[:1])
            last = entry
        if not stop:
            at, steady = at + int(places[n]), True
        elif codes[stop[0]] == end:
            break
        else:
            at += int(places[stop[0] + 1])
            table, last, steady = roots.copy(), b"", False
    return b"".join(out)


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(x)]) + x for x in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def encode_gif(payload: bytes, across: int = ROW, delay: int = DELAY) -> bytes:
    """An endless animation whose frames hold ``payload`` (whole rows) as palette indexes, top down."""
    step = across * across
    down = min(across, len(payload) // across)
    out = [b"GIF89a", struct.pack("<HHBBB", across, down, 0xF7, 0, 0), PALETTE.tobytes(), b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
    for i in range(0, len(payload), step):
        part = payload[i : i + step]
        out += [b"\x21\xf9\x04\x04", struct.pack("<HBB", delay, 0, 0), b"\x2c", struct.pack("<HHHHB", 0, 0, across, len(part) // across, 0), b"\x08", _blocks(lzw_encode(part))]
    return b"".join([*out, b"\x3b"])


class Frame:
    """A frame as shown: ``canvas`` is RGBA of the whole screen, ``box`` (left, top, width, height) what it drew."""

    __slots__ = ("start_ms", "delay_ms", "box", "disposal", "transparent", "canvas")

    def __init__(self, **values):
        for k, v in values.items():
            setattr(self, k, v)

    def histogram(self) -> np.ndarray:
        """Pixels of the canvas in each of 64 colours; transparent ones don't count."""
        seen = self.canvas[self.canvas[..., 3] > 0] >> 6
        return np.bincount(seen[:, 0].astype(np.int64) << 4 | seen[:, 1] << 2 | seen[:, 2], minlength=BINS)


def _rows(down: int, interlaced: bool) -> np.ndarray:
    """The place of each stored row."""
    return np.concatenate([np.arange(a, down, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))]) if interlaced else np.arange(down)


def decode_gif(data: bytes) -> Iterator[Frame]:
    """The timed frames of a GIF, composed under its disposal and transparency rules.

    What isn't a GIF has no frames; a truncated or broken one has those before the fault, and the frame
    at fault keeps the pixels that came. Boxes that reach beyond the screen are clipped.
    """
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        return
    across, down, flags = struct.unpack_from("<HHB", data, 6)
    at = 13

    def palette(flags: int) -> np.ndarray | None:
        nonlocal at
        if not flags & 0x80:
            return None
        raw = np.zeros((256, 3), np.uint8)
        got = np.frombuffer(data[at : at + 3 * (2 << (flags & 7))], np.uint8)
        raw.reshape(-1)[: len(got) // 3 * 3] = got[: len(got) // 3 * 3]
        at += 3 * (2 << (flags & 7))
        return raw

    def blocks() -> bytes:
        nonlocal at
        parts = []
        while at < len(data) and data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        at += 1
        return b"".join(parts)

    shared = palette(flags)
    canvas = np.zeros((down, across, 4), np.uint8)
    clock, control = 0, (0, 0, None)
    while at < len(data):
        kind = data[at]
        at += 1
        if kind == 0x21 and at < len(data):
            label = data[at]
            at += 1
            body = blocks()
            if label == 0xF9 and len(body) >= 4:
                control = (body[0] >> 2 & 7, 10 * struct.unpack_from("<H", body, 1)[0], body[3] if body[0] & 1 else None)
            continue
        if kind != 0x2C or at + 10 > len(data):
            return
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at)
        at += 9
        colours = palette(flags)
        colours = shared if colours is None else colours
        least = data[at] if at < len(data) else 0
        at += 1
        stream = blocks()
        if not 2 <= least <= 8 or colours is None:
            return
        got = np.frombuffer(lzw_decode(stream, least)[: w * h], np.uint8)
        here = np.zeros(w * h, bool)
        here[: len(got)] = True
        index = np.zeros(w * h, np.uint8)
        index[: len(got)] = got
        order = _rows(h, bool(flags & 0x40))
        image, shown = np.empty((h, w), np.uint8), np.empty((h, w), bool)
        image[order], shown[order] = index.reshape(h, w), here.reshape(h, w)
        disposal, delay, transparent = control
        if transparent is not None:
            shown &= image != transparent
        box = (slice(top, min(top + h, down)), slice(left, min(left + w, across)))
        image, shown = image[: max(0, down - top), : max(0, across - left)], shown[: max(0, down - top), : max(0, across - left)]
        before = canvas.copy() if disposal == 3 else None
        part = canvas[box]
        part[shown, :3] = colours[image[shown]]
        part[shown, 3] = 255
        yield Frame(start_ms=clock, delay_ms=delay, box=(left, top, w, h), disposal=disposal, transparent=transparent, canvas=canvas)
        clock += delay
        if disposal == 2:
            canvas[box] = 0
        elif before is not None:
            canvas = before
        control = (0, 0, None)


def samples(frame: Frame) -> bytes:
    """The palette indexes behind a frame of ``encode_gif``, from the colours shown."""
    left, top, w, h = frame.box
    seen = frame.canvas[top : top + h, left : left + w].astype(np.uint16)
    return ((seen[..., 0] // 36 << 5) | (seen[..., 1] // 36 << 2) | seen[..., 2] // 85).astype(np.uint8).tobytes()


def store_texts(docs: DataFrame, unit: int = UNIT) -> DataFrame:
    """(doc_id, n_bytes, media): every text's UTF-8 bytes, padded to a positive multiple of ``unit``, as a GIF.
    A null text is an empty one; repeated rows give equal rows, an empty table none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((i, t or b"") for b in batches for i, t in zip(b["doc_id"], b["text"]))
        for part in in_blocks(rows, BLOCK):
            media = [encode_gif(t.ljust(max(1, -(-len(t) // unit)) * unit, bytes([PAD]))) for _, t in part]
            yield pd.DataFrame({"doc_id": [i for i, _ in part], "n_bytes": [len(t) for _, t in part], "media": media})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInPandas(run, f"doc_id {kind}, n_bytes long, media binary")


def frames(media: DataFrame, key: str = "doc_id", column: str = "media", pixels: bool = False) -> DataFrame:
    """A row for each frame of each medium: ``key``, frame (from 0), start_ms, delay_ms, left, top, width,
    height, disposal, transparent (palette index or null), histogram (64 counts), rgba (the screen as
    shown, null unless ``pixels``). Null and undecodable media have no rows; further columns are ignored."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [key, "frame", "start_ms", "delay_ms", "left", "top", "width", "height", "disposal", "transparent", "histogram", "rgba"]
        for b in batches:
            for k, data in zip(b[key], b[column]):
                made = [(k, n, f.start_ms, f.delay_ms, *f.box, f.disposal, f.transparent, f.histogram().tolist(), f.canvas.tobytes() if pixels else None) for n, f in enumerate(decode_gif(data or b""))]
                if made:
                    yield pd.DataFrame(made, columns=names).astype({"transparent": "Int32"})

    kind = media.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, frame int, start_ms long, delay_ms long, left int, top int, width int, height int, disposal int, transparent int, histogram array<int>, rgba binary"
    return media.select(key, column).mapInPandas(run, schema)


def read_media(media: DataFrame) -> DataFrame:
    """A row for each medium of ``store_texts``: digests of the payload read back from the shown frames, the
    stored bytes' length and digest, frames, duration and the summed colour histogram."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, n, data in zip(b["doc_id"], b["n_bytes"], b["media"]):
                sha, tail, size, count, clock, seen = hashlib.sha256(), b"", 0, 0, 0, np.zeros(BINS, np.int64)
                for f in decode_gif(data):
                    part = samples(f)
                    sha.update(part)
                    tail, size, count, clock = (tail + part)[-32:], size + len(part), count + 1, f.start_ms + f.delay_ms
                    seen += f.histogram()
                out.append((k, n, size, sha.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), count, clock, seen))
            if out:
                out = pd.DataFrame(out, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_frames", "duration_ms", "histogram"])
                out["histogram"] = [x.tolist() for x in out["histogram"]]
                yield out

    kind = media.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, duration_ms long, histogram array<long>"
    return media.select("doc_id", "n_bytes", "media").mapInPandas(run, schema)


def media_documents(docs: DataFrame) -> DataFrame:
    """What op2 returns; ``feature`` is the summed histogram, comma-joined."""
    read = read_media(store_texts(docs))
    return read.withColumn("feature", F.array_join(F.transform("histogram", lambda x: x.cast("string")), ",")).drop("histogram")
