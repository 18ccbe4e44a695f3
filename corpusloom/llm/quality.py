"""Quality rules with cross-document line frequency, in DataFrame functions only.

A line is normalised (lower case, every digit 0, other runs of signs and spaces one space) and hashed
together with its host. Lines that occur in more than ``max_docs`` distinct documents of one host are
removed; a document that keeps less than ``min_share`` of its normalised characters is depleted and rejected.
Texts are read once: a checkpointed table of line hashes and lengths serves the counts and the removals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, WORD, cut, join_hot

MAX_DOCS = 20
MIN_SHARE = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "[^#*$%&|<>]+"  # what is not one of the counted signs


def normalised_lines(text: Column) -> Column:
    """One normalised string for each \\n-split line, empty where it has no letter or digit."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " "), "[0-9]", "0")
    return F.split(F.trim(F.regexp_replace(plain, " *\n *", "\n")), "\n")


def base_rules(docs: DataFrame) -> DataFrame:
    """Add the base counts and ``base_failed`` to ``docs``. A null text has no words, characters or lines; very long
    texts, ties and repeated rows are nothing special, each row is judged alone; an empty table stays
    empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    a = docs.withColumns({"_text": text, "_words": F.regexp_extract_all(text, F.lit(WORD), 0)})
    a = a.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace("_text", SYMBOLS, "")).cast("long"),
        "_full": F.filter(F.split("_text", "\n"), lambda x: x.rlike(f"[^{WHITE}]")),
        # Windows sorted by hash, so that equal ones stand side by side.
        "_windows": F.expr("CASE WHEN size(_words) < 3 THEN array() ELSE sort_array(transform(sequence(0, size(_words) - 3), i -> struct(xxhash64(_words[i], _words[i + 1], _words[i + 2]) AS h, i AS i))) END"),
    })
    a = a.withColumn("_same", F.expr("zip_with(_windows, slice(_windows, 2, size(_windows)), (a, b) -> a.h = b.h)"))
    a = a.withColumn("_repeats", F.expr("sort_array(transform(filter(_windows, (x, k) -> _same[k] OR (k > 0 AND _same[k - 1])), x -> x.i))"))
    covered = "aggregate(_repeats, named_struct('n', 0L, 'e', 0), (s, p) -> named_struct('n', s.n + p + 3 - greatest(p, s.e), 'e', p + 3), s -> s.n)"
    a = a.withColumns({"n_dup_lines": (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"), "n_repeat_words": F.expr(covered)})
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return a.withColumn("base_failed", failed).drop("_text", "_words", "_full", "_windows", "_same", "_repeats")


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """Add the base counts, ``line_chars``, ``_doc`` (the id), ``_row`` (a number for each row) and ``_lines``:
    (hash, chars) of each line, where the hash covers host and line and is null without a letter or digit.
    Checkpointed, so the row numbers stay what they are."""
    lines = F.transform(normalised_lines(F.coalesce("text", F.lit(""))), lambda x: F.struct(F.when(x != "", F.xxhash64(x, F.col(host))).alias("hash"), F.length(x).alias("chars")))
    made = base_rules(docs.withColumns({"_doc": F.col("doc_id"), "_lines": lines}))
    total = F.aggregate("_lines", F.lit(0).cast("long"), lambda s, x: s + x["chars"])
    return made.withColumns({"line_chars": total, "_row": F.monotonically_increasing_id()})


def frequent_lines(rows: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(_row, removed, removed_chars): for each of ``rows`` (_row, _doc, _lines; checkpointed) with a line above the
    limit, the places of its removed lines (from 0) and their normalised length. A line common to any share
    of the documents is counted and joined in parts."""
    each = rows.select("_row", "_doc", F.posexplode("_lines").alias("_at", "_x")).select("_row", "_doc", "_at", F.col("_x.hash").alias("_line"), F.col("_x.chars").alias("_chars")).where("_line IS NOT NULL")
    seen = each.groupBy("_line").agg(F.countDistinct("_doc").alias("_docs"), F.count(F.lit(1)).alias("_n"))
    often = cut(seen.where(F.col("_docs") > max_docs).select("_line", "_n"))
    total = often.agg(F.sum("_n")).first()[0] or 0
    gone = join_hot(each.drop("_doc"), often, "_line", "_n", total)
    return gone.groupBy("_row").agg(F.sort_array(F.collect_list("_at")).alias("removed"), F.sum("_chars").alias("removed_chars"))


def line_frequency(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, min_share: float = MIN_SHARE, with_text: bool = True) -> DataFrame:
    """Base rules and line frequency: every row of ``docs`` with the base counts, ``base_failed``,
    ``removed`` (places of removed lines), ``line_chars``, ``removed_chars``, ``kept`` and, ``with_text``,
    ``clean_text``; without it ``docs``' text and host go as well, and only the rest is held in between.

    Documents are distinct doc_ids: rows that repeat an id count once for a line, rows with a null id not at
    all, though they lose frequent lines too. A null host is a host of its own. Empty and null texts fail the
    base rules; a text without letters and digits has no lines to lose; an empty table gives no rows; columns
    of ``docs`` with the names of new ones are replaced. A line in exactly ``max_docs`` documents stays. Very
    long texts are arrays of one row, and are never exploded into words.
    """
    new = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "line_chars", "removed", "removed_chars", "kept", "clean_text", "_row", "_doc", "_lines")
    base = measured(docs.drop(*new), host)
    base = cut(base if with_text else base.drop("text", host))
    out = base.drop("_lines", "_doc").join(frequent_lines(base.select("_row", "_doc", "_lines"), max_docs), "_row", "left")
    out = out.withColumns({"removed": F.coalesce("removed", F.array().cast("array<int>")), "removed_chars": F.coalesce("removed_chars", F.lit(0)).cast("long")})
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("line_chars") - F.col("removed_chars") >= min_share * F.col("line_chars")))
    if with_text:
        lines = F.split("text", "\n")
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "removed")
        out = out.withColumn("_split", lines).withColumn("clean_text", F.array_join(F.transform(stay, lambda i: F.col("_split")[i]), "\n")).drop("_split")
    return out.drop("_row")


def judged_documents(docs: DataFrame) -> DataFrame:
    """What op1 returns."""
    made = line_frequency(docs.select("doc_id", "text", "source"), with_text=False)
    return made.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "line_chars", "removed_chars")


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
t AS (SELECT doc_id, i, concat_ws(' ', words[i], words[i + 1], words[i + 2]) AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3) x),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS k FROM t) x WHERE k > 1) y GROUP BY doc_id),
n AS (SELECT doc_id, source, string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(text),
  '[^\p{{L}}\p{{N}}\n]+', ' ', 'g'), '[0-9]', '0', 'g'), ' *\n *', chr(10), 'g'), ' '), chr(10)) AS l FROM d),
e AS (SELECT doc_id, source, unnest(l) AS line FROM n),
o AS (SELECT source, line FROM e WHERE line <> '' GROUP BY source, line HAVING count(DISTINCT doc_id) > {MAX_DOCS}),
r AS (SELECT doc_id, CAST(sum(length(e.line)) AS BIGINT) AS line_chars,
  CAST(coalesce(sum(length(e.line)) FILTER (WHERE o.line IS NOT NULL), 0) AS BIGINT) AS removed_chars
  FROM e LEFT JOIN o ON e.line = o.line AND e.source IS NOT DISTINCT FROM o.source GROUP BY doc_id),
b AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND line_chars - removed_chars >= {MIN_SHARE} * line_chars AS kept, line_chars, removed_chars
FROM f JOIN r ON f.doc_id = r.doc_id
"""
