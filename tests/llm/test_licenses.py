import os

import pytest

from corpusloom.llm import licenses

COMMON = "/usr/share/common-licenses"


def test_spellings_and_whole_texts(spark):
    mit = licenses.KNOWN["MIT"][0]
    variants = [mit, mit.upper().replace("LICENSE", "LICENCE"), "Copyright (c) 2021 A. Person\n" + mit.replace(", ", " ,  "), mit.replace("NONINFRINGEMENT", "NON-INFRINGEMENT")]
    table = spark.createDataFrame([*enumerate(variants), (9, mit + " Extra."), (10, "Some text\n  released UNDER the mit licence!\nRest")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.licensed_documents(table).collect()}
    assert all(got[k].license == "MIT" for k in range(len(variants)))
    assert got[9].license is None and got[10].license is None and got[10].line_licenses == "MIT"


def test_oracle(spark, duck, docs):
    got = sorted(map(str, (tuple(r) for r in licenses.licensed_documents(docs).collect())))
    assert got == sorted(map(str, duck.sql(licenses.oracle()).fetchall()))


@pytest.mark.parametrize("most", [licenses.BROADCAST, 0])
def test_table_of_known_texts(spark, monkeypatch, most):
    """A given table, broadcast and shuffled: nulls and texts without words tell nothing, of equal texts the first name counts."""
    monkeypatch.setattr(licenses, "BROADCAST", most)
    known = spark.createDataFrame([("B", "Use it as you like.", 1), ("A", "USE IT,\nas you like", 2), ("N", None, 3), ("E", " \n--", 4), (None, "Other words", 5), ("C", "Keep this\nnotice", 6)], "license string, text string, digest long")
    docs = spark.createDataFrame([(1, "Copyright (c) 2020 X\nuse it as you like!"), (2, "keep this notice"), (3, None), (4, ""), (5, "Other words"), (6, "text\nkeep this notice\nuse it as you like")], "doc_id long, text string")
    got = {r.doc_id: (r.license, r.line_licenses, r.n_license_lines) for r in licenses.licensed_documents(docs, known).collect()}
    assert got == {1: ("A", "A", 1), 2: ("C", "C", 1), 3: (None, "", 0), 4: (None, "", 0), 5: (None, "", 0), 6: (None, "A,C", 2)}


@pytest.mark.skipif(not os.path.isdir(COMMON), reason="the system has no licence texts")
def test_whole_texts_from_files(spark, tmp_path):
    """Whole licences from files, found under another owner, case, spacing and punctuation."""
    names = [n for n in sorted(os.listdir(COMMON)) if not os.path.islink(f"{COMMON}/{n}")]
    texts = {}
    for n in names:
        with open(f"{COMMON}/{n}", encoding="utf-8", errors="replace") as f:
            texts[n] = f.read()
        (tmp_path / f"{n}.txt").write_text(texts[n], encoding="utf-8")
    assert {"Apache-2.0", "GPL-3", "LGPL-2.1", "MPL-2.0", "CC0-1.0"} <= set(names)
    rows = [(k, change(texts[n])) for n in names for k, change in (
        (n, str), (n, str.upper), (n, lambda t: "Copyright 2024 A. Person\n" + t.replace("\n", " \n  ")), (None, lambda t: t + "\nNo warranty for Sundays."))]
    docs = spark.createDataFrame([(i, t, n) for i, (n, t) in enumerate(rows)], "doc_id long, text string, want string")
    got = licenses.find_licenses(docs, licenses.license_files(spark, str(tmp_path)))
    assert [(r.want, r.license) for r in got.orderBy("doc_id").collect()] == [(n, n) for n, _ in rows]
