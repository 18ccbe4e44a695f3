import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import tokenizers

from corpusloom.llm import bpe, packing

RANKS, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "'s", "'", "1", "23", "é", "　", "\xa0", "\x1c", "\x85", "=", "====", "!", "👍", "the", "Ing", ".", ",", " \n", "İ", "ΑΣ", "​", "é", "aaaaaa", "\r\n", "<|endoftext|>"]


def mixed(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 30))) for _ in range(n)] + ["a" * 3000, "=" * 5001, " " * 2001, "\n" * 700, ""]


@pytest.fixture(scope="module")
def library():
    tool = bpe.encoder(RANKS, public_tokenizers.PATTERN)
    return tool, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tool.table.rank, special_tokens={})


def test_replay_equals_library(library):
    tool, ref = library
    texts = mixed(4000, 3)
    for text, ids in zip(texts, tool.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == ref.encode_ordinary(text), text
        assert tool.decode(ids) == text.encode()


def test_ranks_out_of_order(tmp_path):
    """A merge that makes an earlier-ranked one possible, next to overlapping pairs."""
    import base64

    tokens = [bytes([i]) for i in range(256)] + [b"ab", b"aba", b"ba", b"aa", b"aaa", b"bab"]
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    tool = bpe.Encoder(str(path), r"\S+")
    ref = tiktoken.Encoding("x", pat_str=r"\S+", mergeable_ranks=tool.table.rank, special_tokens={})
    rng = random.Random(2)
    texts = ["".join(rng.choices("ab", k=rng.randint(1, 60))) for _ in range(3000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in tool.encode(texts)] == [ref.encode_ordinary(t) for t in texts]


def test_encoded_documents(spark, docs, library):
    _, ref = library
    text = {r.doc_id: r.text for r in docs.collect()}
    got = bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN, block=50_000)
    for r in got.collect():
        ids = np.array(ref.encode_ordinary(text[r.doc_id]), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    back = {r.doc_id: bytes(r.data).decode() for r in bpe.decode_documents(got, RANKS, public_tokenizers.PATTERN).collect()}
    assert back == text


@pytest.fixture(scope="module")
def word_library():
    return tokenizers.Tokenizer.from_file(WORDS)


def test_words_equal_library(word_library):
    """Against an instance of its own, special tokens included."""
    texts = mixed(4000, 9) + ["a <|endoftext|> b", "x<|endoftext|>.<|startoftext|>Y,", "<|EndOfText|>", "don't, CAN'T..."]
    for _ in range(2):  # the second time all are known
        ids, places = packing.word_encoder(WORDS).encode(pa.array(texts, pa.large_string()))
        for text, a, b in zip(texts, places, places[1:]):
            assert ids[a:b].tolist() == word_library.encode(text, add_special_tokens=False).ids, text


def test_exact_fill_is_found():
    """A gap is filled by one length, else two, else three, whenever available ones fill it."""
    rng = random.Random(4)
    for _ in range(300):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(6)}
        length = max(counts)
        if length == 40:
            continue
        got = packing.Sums(counts, 40).exact(length)
        pool = [x for x, n in counts.items() for _ in range(n - (x == length))]
        ways = [k for k in (1, 2, 3) if any(sum(c) == 40 - length for c in itertools.combinations(pool, k))]
        assert (got is None) == (not ways)
        if ways:
            assert len(got) == ways[0] and sum(got) == 40 - length


def test_plan_uses_every_piece():
    rng = random.Random(8)
    for size, kinds, most in ((10, 6, 9), (64, 40, 50), (2048, 300, 10**6), (2048, 3, 10**9)):
        for _ in range(8):
            counts = {rng.randint(1, size): rng.randint(1, most) for _ in range(kinds)}
            left = dict.fromkeys(counts, 0)
            patterns = packing.plan(counts, size)
            for times, lengths in patterns:
                assert sum(lengths) <= size
                for x in lengths:
                    left[x] += times
            assert left == counts and len(patterns) < 3 * size + 10
            bins, ideal = sum(t for t, _ in patterns), -(-sum(k * v for k, v in counts.items()) // size)
            assert bins <= ideal * 11 / 9 + 6 or max(counts) > size / 2


def test_packed_documents(spark, docs, word_library):
    want = {}
    for r in docs.collect():
        ids = np.array(word_library.encode(r.text, add_special_tokens=False).ids + [0], "<u4")
        for k in range(0, len(ids), 2048):
            x = ids[k : k + 2048]
            want[r.doc_id, k // 2048] = (k, len(x), zlib.crc32(x.tobytes()))
    got = packing.packed_documents(docs, WORDS).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(x[1] for x in want.values()) // 2048) + 2
