"""What the trained models learn from."""

import random

from corpusloom.llm import langid, toxicity


def test_unrelated_labelled_documents_stay(spark):
    """Texts that share single runs of words, and equal texts of the other label, are no copies."""
    rng = random.Random(8)
    runs = [" ".join(f"{a}{b}" for b in "abc") for a in ("ka", "lo", "mi", "nu")]
    letters = "abcdefghijklmnop"
    word = lambda: "".join(rng.choices(letters, k=5))
    texts = [" ".join([runs[k % 4], *(word() for _ in range(6))]) for k in range(2000)]
    rows = [(k, k % 2, t) for k, t in enumerate(texts)]
    rows += [(5000, 0, texts[1]), (5001, 1, texts[1]), (5002, 1, texts[3] + " " + word())]
    long = [word() for _ in range(100)]
    rows += [(6000, 1, " ".join(long)), (6001, 1, " ".join(long[1:])), (6002, 0, " ".join(long))]
    got = {r.doc_id for r in toxicity.without_copies(spark.createDataFrame(rows, "doc_id long, toxic int, text string")).collect()}
    assert set(range(2000)) <= got and 5000 in got and 5001 not in got
    assert 5002 not in got if len(texts[3].split()) - 2 >= 0.8 * (len(texts[3].split()) - 1) else 5002 in got
    assert {6000, 6002} <= got and 6001 not in got


def test_rare_language_is_learned(spark):
    """One language in thousands of documents of another, with more languages than one."""
    rng = random.Random(9)
    sound = {"en": "aeiou", "de": "äöüxq", "fr": "éèàçy", "zz": "wkjvz"}
    text = lambda lang: " ".join("".join(rng.choices("bdt" + sound[lang], k=5)) for _ in range(60))
    langs = ["en"] * 9000 + ["de"] * 4000 + ["fr"] * 3000 + ["zz"] * 5
    docs = spark.createDataFrame([(k, text(v), v) for k, v in enumerate(langs)], "doc_id long, text string, lang string")
    n = {r.lang: r["count"] for r in langid.sampled(docs.select("doc_id", "lang")).groupBy("lang").count().collect()}
    assert n["zz"] == 5 and n["en"] == n["de"] == n["fr"] == 1331
    few = langid.train(docs, sample=90)
    assert all(few.predict(text(v))[0] == v for v in sound)


def test_shares():
    assert langid.share([]) == langid.LEAST
    assert langid.share([10, 10]) >= 10
    for sizes in ([9000, 4000, 3000, 5], [4000] * 4, [1] * 300, [50_000] * 300, [1, 5000]):
        given = sum(min(n, langid.share(sizes)) for n in sizes)
        assert given <= max(langid.SAMPLE, langid.LEAST * len(sizes)) and min(langid.share(sizes), *sizes) >= 1
        assert given > langid.SAMPLE - len(sizes) or langid.share(sizes) >= max(sizes)
