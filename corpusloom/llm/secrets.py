"""Secret scans with character Markov models, in DataFrame functions only.

Three fixed patterns give the base spans. Beyond them, every run of eight or more token characters is
searched for stretches of high log-likelihood ratio under two first-order Markov models of characters, one
of random strings and one of ordinary identifiers: a stretch ends where its ratio has fallen by DROP, counts
by its total and its mean, and grows to the borders of its letters and digits. The model of ordinary
identifiers is counted from a labelled sample of the corpus itself, long words of documents without base
finds, and from the names in Python's own library, so that a few odd texts aren't all it knows; that of random
strings is half uniform, half counted from what the base patterns find. A string counts once however often it
comes, and each of its pairs once however long it is. Since documents without base finds may hold random strings
all the same, ordinary strings that the first count already finds random are left out of a second one.
"""

from __future__ import annotations

import builtins
import math
import sys
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hash_below

#: The base patterns, by kind. Matches are leftmost and don't overlap within a kind.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 8
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
#: A run that is too short can't hold a longer match, so the least length may stand in the pattern here.
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = "[A-Za-z0-9+/_=-]{8,}"
SAMPLE = 4000  # at most so many different texts of either label are read for the models
BACKOFF = 5.0
FLAT = (0.01, 0.5)  # uniform parts of the models of ordinary and of random strings
LEAST_TOTAL = 20.0  # nats
LEAST_EACH = 0.6
DROP = 12.0
SUSPECT = (12.0, 0.3)  # total and mean from which an ordinary string isn't learned from
_BLOCK = 256
_PIECE = 1024  # code points


def _let(value: str, body: str) -> str:
    """SQL: ``body`` with v for ``value``, which is computed once. A column that a lambda reads may be computed
    again for every element, because projections are merged."""
    return f"transform(array({value}), v -> {body})[0]"


def _found(df: DataFrame, name: str, pattern: str, gate: Column, text: str = "_text") -> DataFrame:
    """Add ``name``: array of (start, end, value) of the pattern's matches in ``text``, where ``gate`` holds.

    The places follow from the lengths of the matches and of the pieces between them. Their running sum
    goes by blocks, so that a text with very many matches stays cheap.
    """
    q = pattern.replace("\\", "\\\\").replace("'", "\\'").replace('"', '\\"')
    m, p, n, b, before = (f"_{name}_{x}" for x in "mpnbs")
    df = df.withColumn(m, F.when(gate & F.col(text).rlike(pattern), F.expr(f"regexp_extract_all({text}, '{q}', 0)")).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(p, F.expr(f"CASE WHEN size({m}) > 0 THEN transform(split({text}, '{q}', -1), x -> length(x)) ELSE array() END"))
    df = df.withColumn(n, F.expr(f"zip_with(slice({p}, 1, size({m})), {m}, (a, x) -> a + length(x))"))
    df = df.withColumn(b, F.expr(f"transform(sequence(0, size({n}) div {_BLOCK}), k -> aggregate(slice({n}, cast(k * {_BLOCK} + 1 AS int), {_BLOCK}), 0, (s, x) -> s + x))"))
    df = df.withColumn(before, F.expr(f"transform({b}, (x, k) -> aggregate(slice({b}, 1, k), 0, (s, y) -> s + y))"))
    start = f"v.s[cast(i div {_BLOCK} AS int)] + aggregate(slice(v.n, cast((i div {_BLOCK}) * {_BLOCK} + 1 AS int), i % {_BLOCK}), 0, (s, y) -> s + y) + v.p[i]"
    each = f"transform(transform(v.m, (x, i) -> named_struct('start', {start}, 'value', x)), x -> named_struct('start', x.start, 'end', x.start + length(x.value), 'value', x.value))"
    df = df.withColumn(name, F.expr(_let(f"named_struct('m', {m}, 'p', {p}, 'n', {n}, 's', {before})", each)))
    return df.drop(m, p, n, b, before)


def base_spans(docs: DataFrame) -> DataFrame:
    """Add ``_text`` and the columns ``assign``, ``access`` and ``hex`` to ``docs``."""
    df = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    low = F.lower("_text")
    words = F.lit(False)
    for w in ASSIGN_WORDS:
        words = words | F.contains(low, F.lit(w))
    df = _found(df, "assign", ASSIGN, words)
    df = df.withColumn("assign", F.filter("assign", lambda x: F.length(F.regexp_extract(x["value"], ASSIGN, 2)) >= ASSIGN_LEAST))
    df = _found(df, "access", ACCESS, F.contains("_text", F.lit("AKIA")))
    return _found(df, "hex", HEX, F.lit(True))


def replaced(df: DataFrame, name: str, text: str, spans: str, fill: str) -> DataFrame:
    """Add ``name``: ``text`` with what the array ``spans`` (start, end; sorted by start) covers replaced by the
    SQL expression ``fill`` of a span x and of ``past``, the furthest end before it.

    The text is cut into pieces first, so the work grows with the text and the spans, not their product.
    """
    ends = f"named_struct('e', transform({spans}, x -> x.end), 'x', {spans}, 't', CASE WHEN size({spans}) > 0 THEN regexp_extract_all({text}, '(?s).{{1,{_PIECE}}}', 0) END)"
    blocks = f"named_struct('w', v, 'b', transform(sequence(0, size(v.e) div {_BLOCK}), k -> array_max(slice(v.e, cast(k * {_BLOCK} + 1 AS int), {_BLOCK}))))"
    past = f"greatest(0, array_max(slice(v.b, 1, cast(i div {_BLOCK} AS int))), array_max(slice(v.w.e, cast((i div {_BLOCK}) * {_BLOCK} + 1 AS int), i % {_BLOCK})))"
    with_past = f"named_struct('w', v.w, 'm', transform(v.w.e, (x, i) -> {past}), 'last', array_max(v.b))"

    def part(a: str, z: str) -> str:
        inside = f"substring(v.w.t[cast(k AS int)], cast(greatest({a} - k * {_PIECE}, 0) + 1 AS int), cast(least({z} - k * {_PIECE}, {_PIECE}) - greatest({a} - k * {_PIECE}, 0) AS int))"
        return f"CASE WHEN {z} > {a} THEN array_join(transform(sequence({a} div {_PIECE}, ({z} - 1) div {_PIECE}), k -> {inside}), '') ELSE '' END"

    each = f"zip_with(v.w.x, v.m, (x, past) -> concat({part('past', 'x.start')}, {fill}))"
    whole = f"concat(array_join({each}, ''), {part('v.last', f'length({text})')})"
    made = _let(ends, _let(blocks, _let(with_past, whole)))
    return df.withColumn(name, F.expr(f"CASE WHEN size({spans}) > 0 THEN {made} ELSE {text} END"))


def _places(s: Column) -> Column:
    """For each character its place in ALPHABET from 1, or 0."""
    table = F.split(F.lit(",".join(str(ALPHABET.find(chr(c)) + 1) for c in range(128))), ",").cast("array<int>")
    return F.transform(F.split(s, ""), lambda c: F.coalesce(F.get(table, F.ascii(c)), F.lit(0)))


def _pairs(s: Column) -> Column:
    """A number for each two neighbouring characters of a string."""
    less = lambda v: F.greatest(F.size(v) - 1, F.lit(0))
    return _bound(_places(s), lambda v: F.zip_with(F.slice(v, 1, less(v)), F.slice(v, 2, less(v)), lambda a, b: a * (len(ALPHABET) + 1) + b))


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``value``, which is computed once however often ``f`` reads it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def markov_ratios(docs: DataFrame, sample: int = SAMPLE) -> list[float]:
    """The log-likelihood ratio of every ordered pair of characters, random against ordinary, as a table
    over ALPHABET plus one place for any other character. Its size is fixed; at most ``sample``
    different texts of either label, those with the smallest hashes, are counted. Without base finds the
    model of random strings is uniform; without ordinary strings every ratio is 0, so nothing is found."""
    texts = docs.select("text").withColumn("_r", F.xxhash64(F.coalesce("text", F.lit(""))))
    has = (F.size("assign") + F.size("access") + F.size("hex")) > 0
    values = F.concat(F.transform("assign", lambda x: F.regexp_extract(x["value"], ASSIGN, 2)), F.transform("access", lambda x: x["value"]), F.transform("hex", lambda x: x["value"]))
    hashes = cut(base_spans(texts).select("_r", has.alias("has"), F.col("_text").rlike(RUN).alias("word")).distinct())
    strings = {}
    for label, mine in ((1, F.col("has")), (0, ~F.col("has") & F.col("word"))):
        most = hash_below(hashes.where(mine), "_r", sample)
        chosen = base_spans(texts if most is None else texts.where(F.col("_r") <= most))
        words = F.regexp_extract_all("_text", F.lit(RUN), F.lit(0))
        # By a value, not a filter, and with equal texts made one before they are exploded: what either asks of a text would
        # be pushed down with a copy of all its expressions.
        found = chosen.select("_r", F.when(has == bool(label), F.array_distinct(values if label else F.concat(words, F.transform(words, F.upper)))).alias("v"))  # any identifier may stand in capitals
        strings[label] = cut(found.dropDuplicates(["_r"]).select(F.explode("v").alias("s")).distinct())

    def counted(rows: DataFrame) -> dict[int, int]:
        return {r.p: r.n for r in rows.select(F.explode(F.array_distinct(_pairs(F.col("s")))).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}

    random, ordinary = counted(strings[1]), counted(strings[0])
    if not ordinary:
        return [0.0] * (len(ALPHABET) + 1) ** 2
    first = _table(random, ordinary)
    suspect = F.size(_stretches(F.col("s"), _literal(first), *SUSPECT)) > 0
    return _table(random, counted(strings[0].where(~suspect)))


def known_names() -> list[str]:
    """Names in Python's library, as they are and in small letters; those in capitals say little, as they are few."""
    own = {*sys.stdlib_module_names, *dir(builtins), *(x for kind in (str, bytes, dict, list, set, int, float) for x in dir(kind))}
    return sorted({f(x) for x in own if not x.isupper() for f in (str, str.lower)})


def _literal(ratios: list[float]) -> Column:
    return F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")


def _table(random: dict[int, int], ordinary: dict[int, int]) -> list[float]:
    """The ratios from the counts of pairs of either kind, the known names added."""
    size = len(ALPHABET) + 1
    place = lambda c: ALPHABET.find(c) + 1
    known = Counter(p for name in known_names() for p in {place(a) * size + place(b) for a, b in zip(name, name[1:])})
    counts = {1: random, 0: known + Counter(ordinary)}
    chance = {}
    for label in (0, 1):
        n = [[counts[label].get(a * size + b, 0) for b in range(size)] for a in range(size)]
        # A character without many followers of its own falls back on how often each follows any.
        after = [sum(row[b] for row in n) + 0.5 for b in range(size)]
        whole = sum(after)
        chance[label] = [[(row[b] + BACKOFF * after[b] / whole) / (sum(row) + BACKOFF) for b in range(size)] for row in n]
    # Random strings come in more alphabets than the samples show, and identifiers in more spellings: no pair alone decides.
    mixed = lambda c, flat: (1 - flat) * c + flat / size
    table = [math.log(mixed(chance[1][a][b], FLAT[1]) / mixed(chance[0][a][b], FLAT[0])) for a in range(size) for b in range(size)]
    signs = {0, *range(ALPHABET.index("+") + 1, size)}  # pairs with a sign may speak against random strings, not for them
    return [min(x, 0.0) if {k // size, k % size} & signs else x for k, x in enumerate(table)]


def _stretches(s: Column, table: Column, least_total: float, least_each: float) -> Column:
    """(start, end) of the stretches of a run whose ratio is high, borders of letters and digits included."""
    kind = "array<struct<start:int,end:int,score:double>>"
    state = F.struct(F.lit(0.0).alias("now"), F.lit(0).alias("start"), F.lit(0.0).alias("best"), F.lit(0).alias("end"), F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def closed(t: Column) -> Column:
        enough = (t["best"] >= least_total) & (t["best"] >= least_each * (t["end"] - t["start"] - 1))
        mine = F.struct(t["start"].alias("start"), t["end"].alias("end"), t["best"].alias("score"))
        return F.when(enough, F.concat(t["out"], F.array(mine))).otherwise(t["out"])

    def step(t: Column, p: Column) -> Column:
        on = (t["now"] > 0) & (t["best"] - t["now"] < DROP)
        now = F.when(on, t["now"] + p).otherwise(p)
        better = ~on | (now > t["best"])
        return F.struct(
            now.alias("now"), F.when(on, t["start"]).otherwise(t["at"]).alias("start"), F.when(better, now).otherwise(t["best"]).alias("best"),
            F.when(better, t["at"] + 2).otherwise(t["end"]).alias("end"), (t["at"] + 1).alias("at"), F.when(on, t["out"]).otherwise(closed(t)).alias("out"),
        )

    found = F.aggregate(F.transform(_pairs(s), lambda p: F.get(table, p)), state, step, closed)
    # A stretch grows to the left as far as the one before it, and to the right as far as the next begins then.
    left = lambda x: F.length(F.regexp_extract(F.substring(s, F.lit(1), x["start"] + 1), "[A-Za-z0-9]+$", 0))
    right = lambda x: F.length(F.regexp_extract(F.substring(s, x["end"], F.length(s)), "^[A-Za-z0-9]+", 0))
    wide = F.transform(found, lambda x: F.struct((x["start"] - F.greatest(left(x) - 1, F.lit(0))).alias("start"), (x["end"] + F.greatest(right(x) - 1, F.lit(0))).alias("end"), x["end"].alias("own")))
    starts = lambda w: F.transform(w, lambda x, i: F.struct(F.greatest(x["start"], F.coalesce(F.get(w, i - 1)["own"], F.lit(0))).alias("start"), x["end"].alias("end")))
    ends = lambda w: F.transform(w, lambda x, i: F.struct(x["start"], F.least(x["end"], F.coalesce(F.get(w, i + 1)["start"], x["end"])).alias("end")))
    return _bound(_bound(wide, starts), ends)


def find_secrets(docs: DataFrame, ratios: list[float] | None = None, sample: int = SAMPLE, least_total: float = LEAST_TOTAL, least_each: float = LEAST_EACH) -> DataFrame:
    """Add ``assign``, ``access``, ``hex``, ``markov`` (arrays of start, end, value; code points, end
    exclusive) and ``spans`` (all of them as start, rank of the kind, end, kind, in that order) to ``docs``.
    ``ratios`` come from ``markov_ratios``, by default of ``docs`` itself.

    A null text is an empty one and has no spans; repeated rows give equal spans; an empty table gives no
    rows; columns of ``docs`` with those names are replaced. Spans that start together are ordered by kind, as
    listed. Markov spans never overlap base spans or each other: what the base patterns cover is blanked
    first. The work grows in proportion to a text's length and its matches, however long it is.
    """
    ratios = markov_ratios(docs, sample) if ratios is None else ratios
    df = base_spans(docs.drop(*KINDS, "spans"))
    df = df.withColumn("_base", F.array_sort(F.transform(F.concat("assign", "access", "hex"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))))
    df = replaced(df, "_open", "_text", "_base", "repeat(' ', greatest(x.end - greatest(x.start, past), 0))")
    table = _literal(ratios)
    inside = lambda s: _stretches(s, table, least_total, least_each)
    # Distinct runs tell whether a text has a stretch at all; only the few texts that do are looked at place by place.
    words = F.array_distinct(F.regexp_extract_all("_open", F.lit(RUN), F.lit(0)))
    df = _found(df, "_runs", RUN, F.exists(words, lambda s: F.size(inside(s)) > 0), "_open")
    own = lambda x: lambda y: F.struct((x["start"] + y["start"]).alias("start"), (x["start"] + y["end"]).alias("end"), F.substring(x["value"], y["start"] + 1, y["end"] - y["start"]).alias("value"))
    df = df.withColumn("markov", F.flatten(F.transform("_runs", lambda x: F.transform(inside(x["value"]), own(x)))))
    kind = lambda k: F.transform(KINDS[k], lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("rank"), x["end"].alias("end"), F.lit(KINDS[k]).alias("kind")))
    return df.withColumn("spans", F.array_sort(F.concat(*map(kind, range(4))))).drop("_text", "_base", "_open", "_runs")


def redact(docs: DataFrame, mark: str = "[secret]", ratios: list[float] | None = None) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; overlapping spans become one mark.
    Rows without a secret stay as they are, null texts too; repeated rows give equal rows, an empty table none,
    columns of any name are kept. The work grows with a text's length and its spans, not their product."""
    found = find_secrets(docs.select("text", F.struct(*docs.columns).alias("_row")), ratios)
    found = replaced(found, "_clean", "text", "spans", "CASE WHEN x.start >= past THEN '" + mark.replace("\\", "\\\\").replace("'", "\\'") + "' ELSE '' END")
    return found.select(*(F.col("_clean").alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns))


def scanned_documents(docs: DataFrame, ratios: list[float] | None = None) -> DataFrame:
    """What op7 returns."""
    found = find_secrets(docs, ratios)
    write = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["rank"] < 3)
    count = lambda k: F.size(k).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(write(base).cast("binary"), 256).alias("base_sha256"), write("spans").alias("spans"), count("markov").alias("n_markov"),
    )
