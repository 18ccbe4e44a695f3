import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from corpusloom.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, max_docs=quality.MAX_DOCS):
    normal = lambda x: " ".join(re.sub(r"[^\W_]+|.", lambda m: re.sub("[0-9]", "0", m[0]) if m[0][0].isalnum() else " ", x.lower()).split())
    lines = {i: [normal(x) for x in t.split("\n")] for i, t, _ in rows}
    seen = defaultdict(set)
    for i, _, s in rows:
        for x in filter(None, lines[i]):
            seen[s, x].add(i)
    out = {}
    for i, t, s in rows:
        w = WORD.findall(t)
        c = Counter(zip(w, w[1:], w[2:]))
        cover = {p for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        full = [x for x in t.split("\n") if WORD.search(x)]
        chars = sum(map(len, lines[i]))
        lost = sum(len(x) for x in lines[i] if len(seen[s, x]) > max_docs)
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        out[i] = (len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), len(full) - len(set(full)), len(cover), failed, not failed and chars - lost >= 0.5 * chars)
    return out


def test_against_brute_force(spark, docs):
    got = quality.line_frequency(docs.withColumn("source", F.lit("one")), max_docs=3).collect()
    rows = [(r.doc_id, r.text, "one") for r in docs.collect()]
    want = brute(rows, 3)
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got} == want
    for r in got:
        lines = r.text.split("\n")
        assert r.clean_text == "\n".join(x for k, x in enumerate(lines) if k not in set(r.removed))


def test_frequent_line_goes(spark):
    body = [" ".join(f"w{k}x{j}" for j in range(60)) for k in range(30)]
    docs = spark.createDataFrame([(k, f"{b}\nCall 555 now!", "h") for k, b in enumerate(body)] + [(99, "Call 777 now " * 40 + "\n" + "call 000 now\n" * 60, "h")], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.line_frequency(docs).collect()}
    assert all(got[k].kept and got[k].removed == [1] and got[k].clean_text == body[k] for k in range(30))
    assert not got[99].kept


def test_oracle(spark, duck, docs):
    got = sorted(map(tuple, quality.judged_documents(docs).collect()))
    assert got == sorted(duck.sql(quality.ORACLE).fetchall())


def test_repeated_rows_and_null_hosts(spark, duck):
    """Rows that repeat a document count once for its lines, rows without an id not at all; nulls and empty
    hosts are two hosts. The SQL says the same where ids don't repeat."""
    body = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    text = lambda k: body(k) + "\nsubscribe to our letter now"
    rows = [(1, text(1), "h")] * 25 + [(k, text(k), "h") for k in range(2, 10)]
    schema = "doc_id long, text string, source string"
    assert all(r.kept and r.removed == [] for r in quality.line_frequency(spark.createDataFrame(rows, schema)).collect())
    rows += [(k, text(k), "h") for k in range(10, 22)] + [(None, text(0), "h")]
    assert all(r.kept and r.removed == [1] for r in quality.line_frequency(spark.createDataFrame(rows, schema)).collect())
    split = [(k, text(k), None if k % 2 else "") for k in range(40)]
    assert all(r.removed == [] for r in quality.line_frequency(spark.createDataFrame(split, schema)).collect())
    split += [(k, text(k), None) for k in range(40, 50)]
    made = spark.createDataFrame(split, schema)
    held = made.toPandas()  # noqa: F841
    sql = quality.ORACLE.replace("FROM documents", "FROM held")
    assert sorted(map(tuple, quality.judged_documents(made).collect())) == sorted(__import__("duckdb").sql(sql).fetchall())
    assert {r.doc_id for r in quality.line_frequency(made).collect() if r.removed} == {r[0] for r in split if r[2] is None}


def test_line_in_every_document(spark):
    """A line that all rows share is split over tasks and goes everywhere."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat(repeat(concat(translate(id, '0123456789', 'abcdefghij'), ' '), 60), '\n', 'the same old line') AS text", "'h' AS source")
    got = quality.line_frequency(docs.repartition(16)).agg(F.count("*"), F.sum(F.size("removed"))).first()
    assert tuple(got) == (3000, 3000)
