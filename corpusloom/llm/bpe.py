"""Byte-level BPE by merge replay.

The distinct words of a large block of documents are laid out as one array of tokens. An inverted index
leads from a merge to every word position whose pair it joins; merges are replayed in rank order over
all words at once, and each touches only the merged positions and their neighbours. Every document is
then a concatenation of its words' ids. Blocks stay inside a task: no word travels through a shuffle,
and a lost task repeats its own documents only.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 32 << 20  # bytes of text whose words are replayed together
CACHE = 400_000  # words and chunks kept from block to block in one Python worker


class MergeTable:
    """The ranks of a tiktoken file, and for every pair of tokens the token that it joins to."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(self.rank.values()) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, r in self.rank.items():
            self.bytes[r] = token
        self.first = np.array([self.rank[bytes([i])] for i in range(256)], np.int64)
        self.size = size
        keys, values = [], []
        # A merge may hide an earlier-ranked one that only it makes possible; then positions go one by one.
        self.careful = np.zeros(size, bool)
        for token, r in self.rank.items():
            for cut in range(1, len(token)):
                a, b = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a * size + b)
                    values.append(r)
                for part in (a, b):
                    if part is not None and part > r:
                        self.careful[part] = True
        order = np.argsort(keys)
        self.keys, self.values = np.array(keys, np.int64)[order], np.array(values, np.int64)[order]

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token of each pair, or -1."""
        want = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.values[at], -1)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The ids of every word as little-endian unsigned 32-bit integers."""
        data = np.frombuffer(b"".join(words), np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        n = len(data)
        token = self.first[data]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends[lengths > 0] - 1] = -1
        before[(ends - lengths)[lengths > 0]] = -1
        owner = np.repeat(np.arange(len(words)), lengths)
        alive, pair = np.ones(n, bool), np.full(n, -1, np.int64)

        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def enter(places: np.ndarray) -> None:
            """Look up the pairs at these places and put them in the index."""
            found = np.full(len(places), -1, np.int64)
            has = after[places] >= 0
            left = places[has]
            found[has] = self.joined(token[left], token[after[left]])
            pair[places] = found
            places, found = places[found >= 0], found[found >= 0]
            if len(places):
                order = np.argsort(found, kind="stable")
                places, found = places[order], found[order]
                cuts = np.flatnonzero(np.diff(found)) + 1
                for m, part in zip(found[np.r_[0, cuts]].tolist(), np.split(places, cuts)):
                    if m not in index:
                        index[m] = []
                        heapq.heappush(queue, m)
                    index[m].append(part)

        enter(np.arange(n))
        while queue:
            m = heapq.heappop(queue)
            parts = index.pop(m)
            places = np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]
            places = places[pair[places] == m]
            if not len(places):
                continue
            if self.careful[m]:
                whose = owner[places]
                lead = np.r_[True, whose[1:] != whose[:-1]]
                rest = places[~lead]
                if len(rest):
                    index[m] = [rest]
                    heapq.heappush(queue, m)
                places = places[lead]
            elif len(places) > 1:
                # Of pairs that overlap in a row, the first, third, fifth ... are joined.
                new = np.r_[True, places[1:] != after[places[:-1]]]
                where = np.arange(len(places))
                places = places[(where - np.maximum.accumulate(np.where(new, where, 0))) % 2 == 0]
            gone = after[places]
            token[places] = m
            beyond = after[gone]
            after[places] = beyond
            some = beyond >= 0
            before[beyond[some]] = places[some]
            alive[gone], pair[gone] = False, -1
            left = before[places]
            enter(np.unique(np.concatenate([places, left[left >= 0]])))

        ids = token[alive].astype("<u4").tobytes()
        stop = np.cumsum(np.bincount(owner[alive], minlength=len(words))) * 4
        return [ids[a:b] for a, b in zip([0, *stop.tolist()], stop.tolist())]


#: White space other than the plain space and the line feed, and places where a space meets white space.
_ODD = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")


class Encoder:
    """Encodes texts with one rank file and one pattern, remembering words between blocks."""

    def __init__(self, path: str, pattern: str):
        self.table, self.pattern = MergeTable(path), regex.compile(pattern)
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    @staticmethod
    def simple(text: str) -> bool:
        """Whether the pattern's matches never cross the border before a space: no space stands beside
        other white space."""
        return "  " not in text and "\n " not in text and " \n" not in text and not _ODD.search(text)

    def learn(self, texts: list[str]) -> None:
        chunks: set[str] = set()
        words: set[str] = set()
        for t in texts:
            if self.simple(t):
                head, *rest = t.split(" ")
                words.update(self.pattern.findall(head))
                chunks.update(rest)
            else:
                words.update(self.pattern.findall(t))
        fresh = {c: self.pattern.findall(" " + c) for c in chunks if c not in self.chunks}
        for found in fresh.values():
            words.update(found)
        todo = [w for w in words if w not in self.words]
        raw = [w.encode() for w in todo]
        whole = [self.table.rank.get(w) for w in raw]
        split = [w for w, r in zip(raw, whole) if r is None]
        made = iter(self.table.replay(split) if split else [])
        self.words.update((w, next(made) if r is None else r.to_bytes(4, "little")) for w, r in zip(todo, whole))
        self.chunks.update((c, b"".join(map(self.words.__getitem__, found))) for c, found in fresh.items())

    def ids(self, text: str) -> bytes:
        if self.simple(text):
            head, *rest = text.split(" ")
            return b"".join(map(self.words.__getitem__, self.pattern.findall(head))) + b"".join(map(self.chunks.__getitem__, rest))
        return b"".join(map(self.words.__getitem__, self.pattern.findall(text)))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.chunks) > CACHE or len(self.words) > CACHE:
            self.chunks.clear()
            self.words.clear()
        self.learn(texts)
        return [self.ids(t) for t in texts]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(1)
def encoder(path: str, pattern: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path, pattern)


def in_blocks(rows: Iterator[tuple], size: int) -> Iterator[list[tuple]]:
    """Consecutive rows (id, bytes) with about ``size`` bytes together; a longer text is a block of its own."""
    block, held = [], 0
    for row in rows:
        block.append(row)
        held += len(row[1]) + 64
        if held >= size:
            yield block
            block, held = [], 0
    if block:
        yield block


def encode_documents(docs: DataFrame, path: str, pattern: str, block: int = BLOCK, with_ids: bool = True) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, decoded_sha256) of every row; ``ids`` are little-endian unsigned
    32-bit integers, null unless ``with_ids``.

    A null text is an empty one: no ids. Repeated rows give equal rows, an empty table none; further
    columns are ignored. Texts of any length are encoded whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = encoder(path, pattern)
        rows = ((i, t or b"") for b in batches for i, t in zip(b["doc_id"], b["text"]))
        for part in in_blocks(rows, block):
            made = tool.encode([t.decode("utf-8", "replace") for _, t in part])
            sha = lambda x: hashlib.sha256(x).hexdigest()
            yield pd.DataFrame({"doc_id": [i for i, _ in part], "ids": made if with_ids else None, "n_tokens": [len(x) // 4 for x in made], "ids_sha256": list(map(sha, made)), "decoded_sha256": [sha(tool.decode(x)) for x in made]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInPandas(run, schema)


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, data): the bytes that the column ``ids`` stands for; null ids give no bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = encoder(path, pattern)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "data": [tool.decode(x or b"") for x in b["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, data binary")
