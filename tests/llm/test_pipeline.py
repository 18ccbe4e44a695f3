"""The pipeline's stages against plain versions of their decisions."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from corpusloom.llm import langid, secrets, toxicity

from test_shingles import plain

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic, lang, near, clean, pack = (f for _, f in pipeline.STAGES)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    a = toxic(spark, docs, SF).cache()
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert a.columns == docs.columns and ids(a) == {r.doc_id for r in docs.collect() if model.probability(model.evidence(r.text)) < 0.7}
    b = lang(spark, a, SF).cache()
    model = langid.train(a)
    told = {r.doc_id for r in a.collect() for v, s in [model.predict(r.text)] if v != "und" and s >= langid.LEAST_SCORE}
    assert b.columns == docs.columns and ids(b) == told
    c = near(spark, b, SF).cache()
    assert c.columns == docs.columns and c.count() == len(ids(c))
    assert ids(c) == set(plain(sorted((r.doc_id, r.text) for r in b.collect()))[0].values())
    d = clean(spark, c, SF).cache()
    assert d.dtypes == docs.dtypes and ids(d) == ids(c)
    assert all(r.n_chars == len(r.text) for r in d.collect())
    found = secrets.scanned_documents(d).where("n_assign + n_access + n_hex > 0").count()
    assert found == 0 and secrets.scanned_documents(c).where("spans <> ''").count() > 0
    assert ids(pack(spark, d, SF)) == ids(d)


def test_run(spark):
    got = pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and "sequence_id" in got.columns


@pytest.mark.parametrize("stage", [f for _, f in pipeline.STAGES], ids=[n for n, _ in pipeline.STAGES])
def test_edges_of_stages(spark, edge, nothing, stage):
    """Nulls, empty and long texts, ties, repeated rows, an empty table and further columns, stage by stage."""
    small = "/root/testdata/sf0.001"
    last = stage is pipeline.STAGES[-1][1]
    got = stage(spark, edge, small).collect()
    assert stage(spark, nothing, small).count() == 0
    names = ["_text", "_hash", "_id", "_row", "score", "spans", "kept", "node", "length", "_open"]
    more = stage(spark, edge.withColumns({c: F.lit("x") for c in names}), small)
    if last:
        assert {r.doc_id for r in got} == {r.doc_id for r in edge.collect()}
        assert sorted((str(r.doc_id), r.piece, r.length) for r in more.collect()) == sorted((str(r.doc_id), r.piece, r.length) for r in got)
        return
    assert more.columns == [*edge.columns, *names]
    key = lambda rows: sorted(repr([r[c] for c in edge.columns]) for r in rows)
    assert key(more.collect()) == key(got)
    if stage is pipeline.drop_near_duplicates:
        assert sorted(str(r.doc_id) for r in got) == sorted(map(str, [1, 3, 6, 7, 8, 9, 10, 11, None]))
    if stage is pipeline.redact_secrets:
        assert len(got) == edge.count()
