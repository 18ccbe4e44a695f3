"""Best-fit packing with exact-complement hashing.

Only lengths matter for a packing, and there are at most ``size`` of them, so the plan is made from the
histogram of piece lengths: a few thousand numbers, whatever the rows. For each length, longest first,
the gap it leaves is looked up among single lengths, sums of two and sums of three that are still
available, and such combinations are used as often as the counts allow. What stays is packed best fit,
longest first. The plan gives ranges of ranks within each length, and every piece finds its place by
its rank.
"""

from __future__ import annotations

import functools
import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, gapless_rank, give_back, small_batches

SIZE = 2048
CACHE = 400_000  # words and runs of characters that a Python worker knows; with more it starts anew. Looking them up hashes all of them
BLOCK = 4 << 20  # bytes of text that a Python worker encodes at a time; a longer text is a block of its own


class _Known:
    """Strings and their ids, held in Arrow arrays: some 20 bytes for each, where a dictionary takes 200."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.names = pa.array([], pa.large_string())
        self.ids, self.first, self.size = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def missing(self, names: pa.Array) -> pa.Array:
        return names.filter(pc.is_null(pc.index_in(names, value_set=self.names)))

    def add(self, names: pa.Array, ids: np.ndarray, size: np.ndarray) -> None:
        self.names = pa.concat_arrays([self.names, names])
        self.first = np.r_[self.first, len(self.ids) + np.cumsum(size) - size]
        self.ids, self.size = np.r_[self.ids, ids], np.r_[self.size, size]

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the strings at these places, side by side, and how many each has."""
        first, size = self.first[at], self.size[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(first - ends + size, size) + np.arange(total)], size

    def places(self, names: pa.Array) -> np.ndarray:
        return pc.index_in(names, value_set=self.names).to_numpy(zero_copy_only=False)


class WordEncoder:
    """Ids by the ``tokenizers`` library, asked once for each word.

    The vocabulary's normaliser and splitter never join text across white space, and its special tokens
    have none, so a text's ids are those of its white-space-separated runs, one after another. A run of
    letters with stops or commas after it is the word, in lower case, and its stops.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks fill the cores; each thread would hold memory
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        vocabulary = self.tool.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word
        self.ends[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True
        self.words, self.runs = _Known(), _Known()

    def _encode(self, batch: list[str]) -> list:
        return self.tool.encode_batch_fast(batch, add_special_tokens=False)

    def _learn_words(self, new: pa.Array) -> None:
        """Those of letters alone by many at a time, told apart by their end tokens."""
        plain = pc.utf8_is_alpha(new).to_numpy(zero_copy_only=False)
        texts = new.to_pylist()
        order, ids, size = [], [], []
        rest = np.flatnonzero(~plain).tolist()
        plain = np.flatnonzero(plain).tolist()
        for at in range(0, len(plain), 1000):
            group = plain[at : at + 1000]
            found = np.array(self._encode([" ".join(texts[k] for k in group)])[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[found]) + 1
            if len(stops) == len(group):
                order += group
                ids.append(found)
                size.append(np.diff(stops, prepend=0))
            else:  # a word fell apart
                rest += group
        for at in range(0, len(rest), 5000):
            group = rest[at : at + 5000]
            found = [e.ids for e in self._encode([texts[k] for k in group])]
            order += group
            ids.append(np.fromiter(itertools.chain.from_iterable(found), "<u4"))
            size.append(np.fromiter(map(len, found), np.int64, len(found)))
        if order:
            self.words.add(new.take(pa.array(order, pa.int64())), np.concatenate(ids), np.concatenate(size))

    def _learn_runs(self, new: pa.Array) -> None:
        word = pc.utf8_rtrim(new, characters=".,")
        # Some letters become a letter and a mark: those that normalise so, and the dotted capital I in lower case.
        letters = pc.and_(pc.utf8_is_alpha(word), pc.equal(pc.utf8_normalize(word, form="NFC"), word))
        letters = pc.and_not(letters, pc.match_substring(word, "\u0130"))
        stops = pc.if_else(letters, pc.struct_field(pc.extract_regex(new, "(?P<t>[.,]*)$"), "t"), "")
        word = pc.if_else(letters, pc.ascii_lower(word), new)
        both = pa.concat_arrays([word, stops])
        self._learn_words(self.words.missing(pc.unique(both)))
        ids, size = self.words.gather(np.stack([self.words.places(word), self.words.places(stops)], 1).ravel())
        self.runs.add(new, ids, size.reshape(-1, 2).sum(1))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts side by side, and the place where each text's begin, with the end."""
        if len(self.runs.names) > CACHE:
            self.runs.clear()
        if len(self.words.names) > CACHE:
            self.words.clear()
        runs = pc.ascii_split_whitespace(texts)
        flat = runs.flatten().dictionary_encode()
        names = flat.dictionary
        new = self.runs.missing(names)
        if len(new):
            self._learn_runs(new)
        ids, size = self.runs.gather(self.runs.places(names)[flat.indices.to_numpy()])
        return ids, np.r_[0, np.cumsum(size)][runs.offsets.to_numpy()]


@functools.lru_cache(1)
def word_encoder(path: str) -> WordEncoder:
    """One for each Python worker."""
    return WordEncoder(path)


def texts_of(column: pa.Array) -> pa.Array:
    """Strings from bytes; null is empty, and what isn't UTF-8 is replaced."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    try:
        return column.cast(pa.large_string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in column.to_pylist()], pa.large_string())


def cut_documents(docs: DataFrame, path: str, size: int = SIZE, end: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids) of every row: its ids, then ``end``, cut into pieces
    of ``size``. ``ids`` (little-endian unsigned 32-bit integers) is null unless ``with_ids``.

    Ids are the library's own without special tokens added; the strings of special tokens in a text are those
    tokens. A null text is an empty one: one piece of length 1. Repeated rows give equal pieces; an empty
    table gives none; further columns are ignored; a text of any length is encoded whole.
    """
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what earlier stages left in this worker, what reading the vocabulary took, and what each batch took
        tool, stop = word_encoder(path), np.array([end], "<u4").tobytes()
        give_back()
        for b in batches:
            lengths = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False))
            cuts = np.flatnonzero(np.diff(lengths // BLOCK, prepend=0)) + 1 if len(lengths) else []
            edges = sorted({0, *map(int, cuts), b.num_rows})
            for lo, hi in zip(edges, edges[1:]):
                ids, places = tool.encode(texts_of(b.column(1).slice(lo, hi - lo)))
                raw, rows = memoryview(ids.tobytes()), []
                for k, (p, q) in enumerate(itertools.pairwise(places.tolist())):
                    for start in range(0, q - p + 1, size):
                        n = min(size, q - p + 1 - start)
                        part = raw[4 * (p + start) : 4 * min(p + start + n, q)]
                        code = zlib.crc32(part) if start + n <= q - p else zlib.crc32(stop, zlib.crc32(part))
                        rows.append((k, start // size, start, n, code, (bytes(part) + stop * (start + n > q - p)) if with_ids else None))
                of, piece, start, n, code, data = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo).take(pa.array(of)).cast(id_type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(code, pa.int64()), pa.array(data, pa.binary())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"],
                )
            give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs).select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids binary")


class Sums:
    """An index of sums of one, two and three available lengths: a hash of lengths with their counts, and for
    every sum of two the pairs that make it. Sums of three are a length and a sum of two."""

    def __init__(self, counts: dict[int, int], size: int):
        self.have = {x: n for x, n in counts.items() if n > 0}
        self.size, self.pairs = size, {}
        kinds = sorted(self.have, reverse=True)
        for a, b in itertools.combinations_with_replacement(kinds, 2):  # a >= b, larger a first
            if a + b < size:
                self.pairs.setdefault(a + b, []).append((a, b))

    def can(self, *lengths: int) -> bool:
        return all(self.have.get(x, 0) >= lengths.count(x) for x in lengths)

    def pair(self, total: int, *beside: int) -> tuple[int, int] | None:
        """Two available lengths of that sum, beside others; pairs that have run out are forgotten."""
        found = self.pairs.get(total, [])
        while found and not self.can(*found[0]):
            found.pop(0)
        return next((p for p in found if self.can(*p, *beside)), None)

    def exact(self, length: int) -> tuple[int, ...] | None:
        """The fewest lengths, up to three, that fill the gap beside ``length`` exactly."""
        gap = self.size - length
        if gap == 0:
            return ()
        if self.can(gap, length):
            return (gap,)
        if two := self.pair(gap, length):
            return two
        for c in sorted(x for x in self.have if x < gap - 1)[::-1]:
            if self.can(c, length) and (two := self.pair(gap - c, c, length)):
                return (c, *two)
        return None

    def use(self, lengths: tuple[int, ...]) -> int:
        """Use the combination as often as the counts allow; how often."""
        need = {x: lengths.count(x) for x in lengths}
        times = min(self.have[x] // k for x, k in need.items())
        for x, k in need.items():
            self.have[x] -= times * k
            if not self.have[x]:
                del self.have[x]
        return times


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, list[int]]]:
    """Patterns (how often, lengths) that use every piece of ``counts`` (length to count) once."""
    sums, patterns = Sums(counts, size), []
    for length in sorted(counts, reverse=True):
        while length in sums.have:
            rest = sums.exact(length)
            if rest is None:
                break
            lengths = (length, *rest)
            patterns.append((sums.use(lengths), list(lengths)))
    have = np.zeros(size + 1, np.int64)
    for length, n in sums.have.items():
        have[length] = n
    # Best fit, longest first, for all equal bins at once.
    open_bins: dict[int, list[tuple[int, list[int]]]] = {}
    gaps = np.zeros(size + 1, bool)
    for length in range(size, 0, -1):
        while have[length]:
            fit = np.flatnonzero(gaps[length:])
            if len(fit):
                gap = length + int(fit[0])
                times, lengths = open_bins[gap].pop()
                now = min(times, int(have[length]))
                if now < times:
                    open_bins[gap].append((times - now, lengths))
                gaps[gap] = bool(open_bins[gap])
                have[length] -= now
                new = [(now, [*lengths, length])]
            else:
                each = size // length
                times, more = divmod(int(have[length]), each)
                have[length] = 0
                new = [(times, [length] * each)] * (times > 0) + [(1, [length] * more)] * (more > 0)
            for times, lengths in new:
                gap = size - sum(lengths)
                open_bins.setdefault(gap, []).append((times, lengths))
                gaps[gap] = gap > 0
    return patterns + [p for bins in open_bins.values() for p in bins]


def places(patterns: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, each, first sequence, first offset): the pieces of that length and
    of those ranks lie ``each`` to a sequence, side by side from that offset."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for times, lengths in patterns:
        offset = 0
        for x in dict.fromkeys(lengths):
            each = lengths.count(x)
            first = used.get(x, 0)
            used[x] = first + times * each
            out.append((x, first, used[x], each, sequence, offset))
            offset += x * each
        sequence += times
    return out


def pack(pieces: DataFrame, order: list[str], size: int = SIZE) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``size``.

    ``order`` names columns that tell rows of one length apart. ``pieces`` is read twice and shuffled
    once, so give a narrow, checkpointed one. The plan has at most some rows for each pair of lengths
    that share a pattern, however many pieces there are, and is broadcast. Equal rows are packed one by
    one; an empty table gives no rows.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = pieces.sparkSession.createDataFrame(places(plan(counts, size)), "length long, _from long, _to long, _each long, _sequence long, _offset long")
    ranked = gapless_rank(pieces.drop("sequence_id", "offset"), ["length"], order, "_rank", rows=sum(counts.values()))
    out = ranked.join(F.broadcast(table), (ranked["length"] == table["length"]) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))).drop(table["length"])
    k = F.col("_rank") - F.col("_from")
    out = out.withColumns({"sequence_id": F.col("_sequence") + F.floor(k / F.col("_each")), "offset": F.col("_offset") + k % F.col("_each") * F.col("length")})
    return out.drop("_rank", "_from", "_to", "_each", "_sequence", "_offset")


def packed_documents(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """What op10 returns."""
    pieces = cut(cut_documents(docs, path, size).drop("ids"))
    return pack(pieces, ["doc_id", "piece", "ids_crc32"], size).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
