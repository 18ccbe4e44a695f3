"""Repair of damaged conversations: least-cost edits to a legal order of roles, by a rank-convergence parallel Viterbi.

A conversation is a sequence of runs (rows equal in turn, role and text, with their number), so repeated rows cost one
step. Runs are sorted by ranges of (conversation, turn, role, text), and each task cuts its part into chunks; a chunk
is a few bytes a run, whatever the conversation's share of all rows.

Costs run backward: a vector holds what it costs to finish from each of four states. Every chunk but a conversation's
last starts from a speculative vector. In fix-up passes a chunk whose right neighbour ends in another vector runs again
from there, until its vector differs from the one before by a constant only: from there on the edits are the same.
Passes work on stretches of neighbouring chunks that double each time, so that chunks that keep their rank (one
role only, say) take a logarithm of passes.

The stitched costs then drive the trace: at each step the least letter among the cheapest edits. It runs in the stream
that hashes the repaired conversation, because a SHA-256 has to be fed in order; a task holds one chunk at a time.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_hot, small_batches

CHUNK = 256  # runs
STRETCH = 1 << 14  # chunks that one task of a fix-up pass runs through, at most

#: Costs of the edits, and of keeping a row that was cut short.
REROLE, DELETE, INSERT, CUT_SHORT = 1, 2, 5, 5

# States: nothing kept yet, after system, after user, after assistant. A conversation may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = (USER, USER, ASSISTANT, USER)  # what a new or changed role has to be
KEPT = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
ROLES = {USER: "user", ASSISTANT: "assistant"}
LAST = (0, 2 * INSERT, INSERT, 0)

WHITE = " \t\n\x0b\x0c\r"
DROPPED, EMPTIED, UNSTOPPED, REPEATED, USERS = range(5)


# --- the recurrence ----------------------------------------------------------------------------------


def _direct(after: tuple[int, ...], symbol: str) -> list[list[tuple[int, str, int]]]:
    """For each state the edits of one row as (cost to finish, letter, next state). A symbol is a role's initial, in
    capitals if the row was cut short, ``x`` for another role, ``X`` cut short, or ``-`` where the row must go."""
    more = CUT_SHORT if symbol.isupper() else 0
    kept = KEPT.get(symbol.lower(), (None,) * 4)
    found = []
    for state in range(4):
        own = [(DELETE + after[state], "D", state)]
        if symbol != "-":
            if kept[state] is not None:
                own.append((more + after[kept[state]], "K", kept[state]))
            own.append((REROLE + more + after[FOLLOWS[state]], "R", FOLLOWS[state]))
        found.append(own)
    return found


@functools.lru_cache(1 << 16)
def before(after: tuple[int, ...], symbol: str) -> tuple[int, ...]:
    """The vector before a row from the one after it, less its minimum: only differences matter."""
    best = [min(own)[0] for own in _direct(after, symbol)]
    for _ in range(2):  # more than two rows put in lead nowhere new
        best = [min(b, INSERT + best[FOLLOWS[s]]) for s, b in enumerate(best)]
    least = min(best)
    return tuple(b - least for b in best)


@functools.lru_cache(1 << 16)
def step(after: tuple[int, ...], symbol: str, state: int) -> tuple[str, int, int]:
    """(letters, cost, next state) of the cheapest edits of a row and of what is put in before it, ASCII-least."""
    direct, letters, cost = _direct(after, symbol), "", 0
    value = [min(own)[0] for own in direct]
    reach = lambda s, n: value[s] if n == 0 else min(value[s], INSERT + reach(FOLLOWS[s], n - 1))
    while True:
        best = reach(state, 2)
        options = {letter: (total, to) for total, letter, to in direct[state]}
        options["I"] = (INSERT + reach(FOLLOWS[state], 2), FOLLOWS[state])
        letter = min(k for k, (total, _) in options.items() if total == best)
        letters += letter
        to = options[letter][1]
        if letter != "I":
            return letters, cost + best - after[to], to
        cost, state = cost + INSERT, to


def ending(state: int) -> str:
    """What is put in at the end."""
    return {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}[state]


def backward(symbols: str, right: tuple[int, ...], old: bytes | None = None) -> tuple[bytes, tuple[int, ...]]:
    """(the vectors behind each run, four bytes each; the vector before the first). ``old`` are those of an earlier pass:
    where a vector is the old one, but for a constant, the rest stays."""
    out, v = bytearray(old or 4 * len(symbols)), right
    for k in range(len(symbols) - 1, -1, -1):
        mine = bytes(v)
        if old is not None and out[4 * k : 4 * k + 4] == mine:
            return bytes(out), before(tuple(out[:4]), symbols[0])
        out[4 * k : 4 * k + 4] = mine
        v = before(v, symbols[k])
    return bytes(out), v


# --- rows to chunks ----------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): the rows with the damage that crc32(``conv_id:turn``) % 20 says; null roles and
    texts, and null parts of that key, are one space. Dropped rows are gone, repeated ones have two copies."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(fault == EMPTIED, "").when(fault == UNSTOPPED, F.translate(part("text"), ".!?", "")).otherwise(part("text"))
    role = F.when(fault == USERS, "user").otherwise(part("role"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(fault == REPEATED, 2).otherwise(1).alias("copies"), fault.alias("_fault"))
    return rows.where(F.col("_fault") != DROPPED).drop("_fault")


def _key(*columns: str) -> Column:
    return F.md5(F.concat_ws("|", *(F.coalesce(F.hex(F.col(c).cast("string")), F.lit("-")) for c in columns)).cast("binary"))


def runs(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, n, symbol, blank): equal rows as one, with the symbol of the first of them. Of a role
    and text that several turns have, only those of the first turn aren't duplicates."""
    last = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    symbol = F.when(last == "", "-").when(last.isin(".", "!", "?"), known).otherwise(F.upper(known))
    marked = rows.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"), "copies", symbol.alias("symbol"), (last == "").alias("blank"))
    one = marked.groupBy("conv_id", "turn", "role", "digest").agg(F.sum("copies").alias("n"), F.first("symbol").alias("symbol"), F.first("blank").alias("blank"))
    one = cut(one.withColumn("_key", _key("conv_id", "role", "digest")))
    # What comes more than once is rare; its keys are joined, hot ones by broadcast.
    again = cut(one.where(~F.col("blank")).groupBy("_key").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("_first"), F.count(F.lit(1)).alias("_turns")).where("_turns > 1"))
    total = again.agg(F.coalesce(F.sum("_turns"), F.lit(0))).first()[0]
    if total:
        later = join_hot(one, again, "_key", "_turns", total).where(F.struct(F.col("turn").isNotNull(), "turn") != F.col("_first"))
        place = ["conv_id", "turn", "role", "digest"]
        flagged = one.select(*place, "n", "symbol", "blank", F.lit(0).alias("_dup")).unionByName(later.select(*place, F.lit(0).cast("long").alias("n"), "symbol", "blank", F.lit(1).alias("_dup")))
        one = flagged.groupBy(*place).agg(F.sum("n").alias("n"), F.first("symbol").alias("symbol"), F.first("blank").alias("blank"), F.max("_dup").alias("_dup"))
        one = one.withColumn("symbol", F.when(F.col("_dup") == 1, "-").otherwise(F.col("symbol")))
    return one.select("conv_id", "turn", "role", "digest", "n", "symbol", "blank")


ORDER = ["conv_id", "turn", "role", "digest"]


def as_text(df: DataFrame) -> DataFrame:
    """Ids and turns as text on the way to pandas, where a column of whole numbers and nulls would become floats."""
    return df.withColumns({"conv_id": F.col("conv_id").cast("string"), "turn": F.col("turn").cast("string")})


def chunks(found: DataFrame, size: int = CHUNK) -> DataFrame:
    """(conv_id, no, last, turn, role, digest, symbols): the runs of each conversation in order, ``size`` of them a row, with
    the place of the first; conv_id and turn as text. Numbers go on where a conversation lies in several tasks."""
    columns = ["part", "at", "piece", "conv_id", "turn", "role", "digest", "symbols"]
    schema = "part int, at int, piece int, conv_id string, turn string, role string, digest string, symbols string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, at, piece, now = TaskContext.get().partitionId(), 0, -1, object()
        held: list = []
        for b in batches:
            out = []
            for conv, turn, role, digest, symbol in zip(b["conv_id"], b["turn"], b["role"], b["digest"], b["symbol"]):
                if conv != now or len(held[-1]) >= size:
                    if held:
                        out.append((*held[:-1], "".join(held[-1])))
                    piece, at, now = piece + (conv != now), 0 if conv != now else at + 1, conv
                    held = [part, at, piece, conv, turn, role, digest, []]
                held[-1].append(symbol)
            yield pd.DataFrame(out, columns=columns)
        if held:
            yield pd.DataFrame([(*held[:-1], "".join(held[-1]))], columns=columns)

    ordered = found.select(*ORDER, "symbol").repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    made = cut(small_batches(as_text(ordered)).mapInPandas(run, schema))
    # A task's first and last conversation may go on elsewhere: a few rows a task tell how many chunks come before.
    pieces = made.groupBy("part", "piece").agg(F.first("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"))
    ends = pieces.groupBy("part").agg(F.max("piece").alias("most"))
    edge = pieces.join(ends, "part").where("piece = 0 OR piece = most")
    own = Window.partitionBy("conv_id").orderBy("part")
    edge = edge.select("part", "piece", F.coalesce(F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.lead("part").over(own).isNotNull().alias("more"), F.col("n").alias("_n"))
    whole = made.join(pieces.select("part", "piece", "n"), ["part", "piece"]).join(edge.drop("_n"), ["part", "piece"], "left")
    no = F.col("at") + F.coalesce("before", F.lit(0))
    last = (F.col("at") == F.col("n") - 1) & ~F.coalesce("more", F.lit(False))
    return whole.select("conv_id", no.cast("long").alias("no"), last.alias("last"), "turn", "role", "digest", "symbols")


# --- costs -------------------------------------------------------------------------------------------


def costs(cut_up: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """``chunks`` with ``vectors``: the cost vectors behind each of their runs, all constants apart."""
    names = cut_up.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut_up.schema.fields) + ", vectors binary, left binary, right binary"

    def speculate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [backward(s, LAST) for s in b["symbols"]]
            yield b.assign(vectors=[d[0] for d in done], left=[bytes(d[1]) for d in done], right=bytes(LAST))

    now = cut(small_batches(cut_up).mapInPandas(speculate, schema))
    single = now.where("no = 0 AND last")
    many, group, passes = now.where("NOT (no = 0 AND last)"), 1, 0
    key = ["_conv", "no"]

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        """A stretch of neighbouring chunks from right to left."""
        pdf = pdf.sort_values("no", ascending=False, ignore_index=True)
        vectors, lefts, rights = list(pdf["vectors"]), list(pdf["left"]), list(pdf["right"])
        came = None
        for k, (symbols, last, following) in enumerate(zip(pdf["symbols"], pdf["last"], pdf["next"])):
            want = bytes(LAST) if last else came if came is not None else following
            if want != rights[k]:
                vectors[k], left = backward(symbols, tuple(want), vectors[k])
                lefts[k], rights[k] = bytes(left), want
            came = lefts[k]
        return pdf.assign(vectors=vectors, left=lefts, right=rights)[[*names, "vectors", "left", "right"]]

    while True:
        # Each chunk with the vector that its right neighbour has now.
        named = many.withColumn("_conv", _key("conv_id"))
        heads = named.select("_conv", (F.col("no") - 1).alias("no"), F.col("left").alias("next"))
        joined = cut(named.join(heads, key, "left"))
        if joined.where("NOT last AND next <> right").isEmpty():
            return single.unionByName(many).select(*names, "vectors")
        # Stretches shift by half each second pass, so that no border stays where it was.
        shift = (group // 2) * (passes % 2)
        stretches = joined.withColumn("_group", F.floor((F.col("no") + shift) / group)).groupBy("_conv", "_group")
        many = cut(stretches.applyInPandas(again, schema))
        group, passes = min(2 * group, stretch), passes + 1


# --- trace -------------------------------------------------------------------------------------------

RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Trace:
    """One conversation, fed in order."""

    def __init__(self):
        self.state, self.cost, self.letters, self.first, self.hash = START, 0, [], True, hashlib.sha256()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.turn = self.initial = None

    def put(self, role: str, text: str) -> None:
        self.hash.update((("" if self.first else "\n") + f"{role}:{text}").encode())
        self.first = False

    def add(self, letters: str, state: int, role: str, text: str) -> None:
        """The edits of one row, in the state before them."""
        self.letters.append(letters)
        for x in letters:
            if x == "K":
                self.put(role, text)
            elif x in "IR":
                self.put(ROLES[FOLLOWS[state]], "" if x == "I" else text)
            if x in "IR":
                state = FOLLOWS[state]

    def run(self, turn: int | None, role: str, text: str, n: int, symbol: str, after: tuple[int, ...]) -> None:
        """A run of ``n`` equal rows: the first may stay, the others must go."""
        blank = not text.strip(WHITE)
        self.blank += n * blank
        self.duplicate += 0 if blank else n - (symbol != "-")
        self.truncated += symbol.isupper()
        letters, cost, to = step(after, symbol, self.state)
        self.add(letters, self.state, role, text)
        self.letters.append("D" * (n - 1))
        self.cost, self.state = self.cost + cost + DELETE * (n - 1), to
        initial = role[:1]
        self.illegal += n - 1 + (self.initial is not None and self.initial + initial not in ("su", "ua", "au"))
        self.initial = initial
        if turn is not None:
            self.turns += turn != self.turn
            self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn

    def row(self) -> tuple:
        tail = ending(self.state)
        self.add(tail, self.state, "", "")
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost + INSERT * len(tail), "".join(self.letters), self.hash.hexdigest()


def traced(conversations: DataFrame, rows: DataFrame, found: DataFrame, costed: DataFrame) -> DataFrame:
    """One row for each conv_id of ``conversations``. A task reads a conversation's chunks, each before the texts of its runs,
    in the order of both, and keeps what a hash and one chunk need."""
    kind, turn = (conversations.schema[c].dataType for c in ("conv_id", "turn"))
    none = lambda t: F.lit(None).cast(t)
    stream = conversations.select("conv_id").distinct().select("conv_id", none(turn).alias("turn"), none("string").alias("role"), none("string").alias("digest"), F.lit(0).alias("kind"), none("string").alias("text"), none("long").alias("n"), none("binary").alias("vectors"))
    heads = costed.select(F.col("conv_id").cast(kind).alias("conv_id"), F.col("turn").cast(turn).alias("turn"), "role", "digest", F.lit(1).alias("kind"), F.col("symbols").alias("text"), none("long").alias("n"), "vectors")
    sizes = found.select("conv_id", "turn", "role", "digest", F.lit(2).alias("kind"), none("string").alias("text"), "n", none("binary").alias("vectors"))
    texts = rows.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"), F.lit(3).alias("kind"), "text", none("long").alias("n"), none("binary").alias("vectors"))
    merged = stream.unionByName(heads).unionByName(sizes).unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", F.col("kind") > 0, "turn", "role", "digest", "kind")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, trace, symbols, vectors, at, n = None, None, "", b"", 0, 0
        for b in batches:
            out = []
            for conv, at_turn, role, what, text, size, vecs in zip(b["conv_id"], b["turn"], b["role"], b["kind"], b["text"], b["n"], b["vectors"]):
                if what == 0:
                    if trace is not None:
                        out.append((now, *trace.row()))
                    now, trace = conv, _Trace()
                elif what == 1:
                    symbols, vectors, at = text, vecs, 0
                elif what == 2:
                    n = int(size)
                elif n:  # the first of the run's texts; the others are the same
                    trace.run(None if at_turn is None else int(at_turn), role, text, n, symbols[at], tuple(vectors[4 * at : 4 * at + 4]))
                    at, n = at + 1, 0
            yield pd.DataFrame(out, columns=columns)
        if trace is not None:
            yield pd.DataFrame([(now, *trace.row())], columns=columns)

    columns = ["conv_id", *(x.split()[0] for x in RESULT.split(", "))]
    done = small_batches(as_text(merged)).mapInPandas(run, f"conv_id string, {RESULT}")
    return done.withColumn("conv_id", F.col("conv_id").cast(kind))


def repaired_conversations(conversations: DataFrame, size: int = CHUNK, stretch: int = STRETCH) -> DataFrame:
    """What op13 returns: every conv_id once, null among them.

    Rows of one turn are ordered by role, then by the MD5 of the text; null turns come first. Null roles and texts are one
    space; an empty text is blank; repeated rows are duplicates of the first; an empty table gives no rows; other columns are
    ignored. A conversation of any length is cut into chunks; only its hash is made in one task, from a stream.
    """
    rows = damaged(conversations)
    found = cut(runs(rows))
    return traced(conversations, rows, found, costs(chunks(found, size), stretch))

