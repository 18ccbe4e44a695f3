"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bpe, gif, langid, licenses, packing, quality, secrets, shards, simhash, toxicity

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def some_labels(docs):
    return docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0).alias("toxic"), F.lit(None).alias("quality"))


RUNS = {
    "quality": quality.judged_documents,
    "quality_whole": lambda d: quality.line_frequency(d).select("doc_id", "clean_text", "removed"),
    "gif": gif.media_documents,
    "toxicity": lambda d: toxicity.judged_documents(d, some_labels(d)),
    "shards": shards.sharded_documents,
    "bpe": lambda d: bpe.encode_documents(d, RANKS, public_tokenizers.PATTERN),
    "langid": langid.identified_documents,
    "secrets": secrets.scanned_documents,
    "redact": secrets.redact,
    "simhash": simhash.near_duplicates,
    "licenses": licenses.licensed_documents,
}


@pytest.mark.parametrize("name", RUNS)
def test_rows_and_clashes(name, edge, clashing, nothing):
    plain, other = RUNS[name](edge), RUNS[name](clashing)
    assert plain.count() == edge.count()
    columns = [c for c in plain.columns if c in other.columns]
    key = lambda df: sorted(map(repr, df.select(*columns).collect()))
    assert key(plain) == key(other)
    assert RUNS[name](nothing).count() == 0


def test_packing(edge, clashing, nothing):
    pieces = packing.packed_documents(edge, WORDS)
    assert sum(r.length for r in pieces.collect()) == sum(r.length for r in packing.packed_documents(clashing, WORDS).collect())
    assert pieces.select("doc_id").distinct().count() == edge.select("doc_id").distinct().count()
    assert packing.packed_documents(nothing, WORDS).count() == 0


def test_defined_results(edge):
    q = {r.doc_id: r for r in quality.judged_documents(edge.where("doc_id > 1")).collect()}
    assert (q[3].n_words, q[3].word_chars, q[3].base_failed, q[3].kept) == (0, 0, True, False)
    assert q[7].n_words == q[7].n_repeat_words + 1 and q[7].base_failed
    assert q[9].n_symbols == 480 and q[9].n_repeat_words == 60
    lang = {r.doc_id: r for r in langid.identified_documents(edge.where("doc_id > 1")).collect()}
    assert {lang[i].lang_pred for i in (3, 4, 5, 9)} == {"und"}
    sim = {r.doc_id: r for r in simhash.near_duplicates(edge).where("doc_id IS NOT NULL").collect()}
    assert sim[3].fingerprint == "0" * 16 and sim[4].component_id == 3 and sim[2].component_id == 1
    lic = {r.doc_id: r for r in licenses.licensed_documents(edge).collect()}
    assert lic[11].line_licenses == "MIT" and lic[11].license is None and lic[3].license is None
    red = {r.doc_id: r.text for r in secrets.redact(edge).collect()}
    assert red[3] is None and red[10] == '[secret]" password: short [secret] [secret]'
    enc = {r.doc_id: r for r in bpe.encode_documents(edge, RANKS, public_tokenizers.PATTERN).collect()}
    assert enc[3].n_tokens == enc[4].n_tokens == 0
