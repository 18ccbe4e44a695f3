import hashlib
import random
import struct

import numpy as np

from corpusloom.llm import gif


def test_lzw_round_trip():
    rng = random.Random(5)
    for least in (2, 5, 8):
        for n in (0, 1, 2, 300, 5000, 60_000):
            for data in (bytes(rng.choices(range(1 << least), k=n)), bytes(n)):
                assert gif.lzw_decode(gif.lzw_encode(data, least), least) == data


def test_late_clear_codes():
    """Streams that keep a full table for a while, as other encoders write them."""
    data = bytes(random.Random(1).choices(range(256), k=9000))
    codes = [256, *data, 257]
    width = lambda j: min(12, max(9, (258 + max(0, j - 1)).bit_length()))
    bits, at = 0, 0
    for j, c in enumerate(codes):
        bits |= c << at
        at += 9 if j == 0 else width(j - 1)
    assert gif.lzw_decode(bits.to_bytes(at // 8 + 1, "little"), 8) == data


def made(frames, across=4, down=4):
    """A GIF of (disposal, delay, transparent or None, box, pixels, interlaced) with a palette of 4 greys."""
    palette = bytes(v for i in range(4) for v in (60 * i,) * 3)
    out = [b"GIF89a", struct.pack("<HHBBB", across, down, 0x81, 0, 0), palette]
    for disposal, delay, clear, (x, y, w, h), pixels, laced in frames:
        out += [b"\x21\xf9\x04", struct.pack("<BHB", disposal << 2 | (clear is not None), delay, clear or 0), b"\0"]
        out += [b"\x2c", struct.pack("<HHHHB", x, y, w, h, 0x40 if laced else 0), b"\x02", gif._blocks(gif.lzw_encode(bytes(pixels), 2))]
    return b"".join(out) + b";"


def grey(frame):
    return np.where(frame.canvas[..., 3] > 0, frame.canvas[..., 0].astype(int) // 60, -1).tolist()


def test_disposal_transparency_interlace():
    full, one = (0, 0, 4, 4), (1, 1, 2, 2)
    data = made([(1, 5, None, full, [1] * 16, False), (3, 7, 0, one, [2, 0, 0, 2], False), (2, 9, None, one, [3] * 4, False), (0, 1, None, (0, 0, 1, 4), [0, 1, 2, 3], True)])
    shown = [(f.start_ms, f.delay_ms, grey(f)) for f in map(lambda f: gif.Frame(**{k: getattr(f, k) if k != "canvas" else f.canvas.copy() for k in gif.Frame.__slots__}), gif.decode_gif(data))]
    one_row = [1, 1, 1, 1]
    assert shown[0] == (0, 50, [one_row] * 4)
    assert shown[1] == (50, 70, [one_row, [1, 2, 1, 1], [1, 1, 2, 1], one_row])
    assert shown[2] == (120, 90, [one_row, [1, 3, 3, 1], [1, 3, 3, 1], one_row])
    assert shown[3] == (210, 10, [[0, 1, 1, 1], [2, -1, -1, 1], [1, -1, -1, 1], [3, 1, 1, 1]])


def test_broken_media():
    whole = made([(0, 1, None, (0, 0, 4, 4), [1] * 16, False)] * 3)
    assert len(list(gif.decode_gif(whole))) == 3
    for k in range(len(whole)):
        list(gif.decode_gif(whole[:k]))
    assert not list(gif.decode_gif(b"PNG")) and not list(gif.decode_gif(b""))


def test_store_and_read(spark, docs, edge):
    for table in (docs, edge):
        text = sorted((r.text or "").encode() for r in table.select("text").collect())
        pad = lambda t: t.ljust(max(1, -(-len(t) // 576)) * 576, b"\xff")
        got = gif.media_documents(table).collect()
        assert sorted((r.n_bytes, r.payload_bytes, r.payload_sha256) for r in got) == sorted((len(t), len(pad(t)), hashlib.sha256(pad(t)).hexdigest()) for t in text)
    frames = gif.frames(gif.store_texts(docs), pixels=True).where("frame = 0").collect()
    assert len(frames) == docs.count() and all(sum(f.histogram) == f.width * f.height for f in frames)
