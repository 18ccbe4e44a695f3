"""Encodings told apart on texts of 200 bytes and more."""

import random

import pytest

from corpusloom.functions import encodings, pysource
from corpusloom.operators import parse

TEXTS = {
    ("cp1251", "koi8-r"): "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему. Все смешалось в доме. Жена узнала, что муж был в связи с бывшею в их доме гувернанткой, и объявила мужу, что не может жить с ним в одном доме. Положение это продолжалось уже третий день и мучительно чувствовалось.",
    ("shift_jis", "euc-jp"): "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。何でも薄暗いじめじめした所でニャーニャー泣いていた事だけは記憶している。吾輩はここで始めて人間というものを見た。しかもあとで聞くとそれは書生という人間中で一番獰悪な種族であったそうだ。",
    ("gb18030",): "我们的程序在读取文件的时候，如果没有找到这个文件，就会给出一个错误。你可以在这里看到所有的消息，也可以把它们写到另外一个地方去。以后我们还要做很多的工作，因为这只是一个开始。大家都知道，这样的事情不是一天就能做好的，要有时间和人。",
    ("big5",): "我們的程式在讀取檔案的時候，如果沒有找到這個檔案，就會給出一個錯誤。你可以在這裡看到所有的消息，也可以把它們寫到另外一個地方去。以後我們還要做很多的工作，因為這只是一個開始。大家都知道，這樣的事情不是一天就能做好的，要有時間和人。",
    ("euc-kr",): "우리는 이 프로그램이 파일을 읽을 때에 무엇을 하는지 알고 있다. 파일이 없으면 오류가 나고, 그 내용은 기록에 남는다. 사람들은 이것을 보고 다시 시작할 수 있다. 앞으로도 해야 할 일이 많지만 지금은 여기까지만 한다. 다음에 또 만나서 이야기하기로 하자.",
    ("cp1252",): "Il était une fois, dans un village éloigné, une petite fille très aimée de sa mère et encore plus de sa grand-mère. Où êtes-vous allés cet été ? À la plage, près de la forêt, là où l'eau est très salée. Die Straße führt über die Brücke, und die Mädchen hören schöne Lieder für später.",
}


def pieces(size, n=40):
    rng = random.Random(1)
    for names, text in TEXTS.items():
        for name in names:
            for _ in range(n):
                at = rng.randrange(0, 200)
                yield name, (text[at % len(text):] + text * 3).encode(name)[:size]


def test_nearly_all_texts_of_200_bytes():
    found = [(name, *encodings.detect(data)) for name, data in pieces(200)]
    right = sum(name == got for name, got, _ in found)
    assert right >= 0.95 * len(found), sorted({(n, g) for n, g, _ in found if n != g})
    assert all(0 <= c <= 1 for _, _, c in found)
    short = [(name, *encodings.detect(data)) for name, data in pieces(24)]
    mean = lambda rows: sum(c for *_, c in rows) / len(rows)
    assert mean([r for r in found if r[0] == r[1]]) > mean([r for r in short if r[0] != r[1]] or [("", "", 0.0)])


def test_little_to_tell():
    assert encodings.detect(b"") == ("utf-8", 1.0) == encodings.detect("漢字 é".encode())
    assert encodings.detect(b"caf\xe9 = 1\n")[0] == "cp1252" and encodings.detect(b"\xa7 1 = \xa0\n")[0] == "cp1252"


def test_the_chain_reads_them(spark):
    """A source in such an encoding is parsed with its text as written."""
    rows, want = [], {}
    for names, text in TEXTS.items():
        for name in names:
            rows.append((name, f'"""{text}"""\ndef f():\n    pass\n'.encode(name)))
            want[name] = text
    files = spark.createDataFrame(rows, "path string, content binary")
    got = {r.file_path: (r.fallback_level, r.elements[0].docstring) for r in parse.parse_files(files, fallbacks=True).collect()}
    assert got == {name: (1, text) for name, text in want.items()}
    assert {r.path: r.encoding for r in encodings.detect_encodings(files).collect()} == {n: n for n in want}


@pytest.mark.parametrize("cookie", ["koi8-r", "cp1251"])
def test_a_cookie_comes_first(cookie):
    data = f"# coding: {cookie}\nx = 'слово'\n".encode(cookie)
    assert pysource.encodings(data)[0] == cookie
