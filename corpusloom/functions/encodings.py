"""Which encoding bytes that aren't UTF-8 are in, with a confidence: a model of frequent characters for each.

In running text a few dozen characters make up most of what is written, and each of them is a byte or a pair of bytes. A
candidate decodes the bytes and is rated by its share of frequent characters among those beyond ASCII; a wrong one
gives rare ones, or breaks. Cyrillic has a letter for nearly every byte, so more of them must be frequent, and its
words are runs of such bytes; where they stand alone inside ASCII words the text is western.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most frequent characters of the scripts, and the encodings that texts in them come in.
RUSSIAN = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэф"
JAPANESE = "のにはをたがでてとしれさいるなっかもりこあらすきんくよそうまけつえおだみちせばやめ、。ー日人大年本一国出会中上生分子者アイスルトンリクラレドシタコフマジ"
SIMPLIFIED = "的一是不了在人有我他这中大来上国个到说们为子和你地出道也时年得就那要下以生会自着去之过家学对可里后小么心多天而能好都然没日于起还发成事只作当想看文无开手十用主行方又如前所本见经头面公同三已老从动两长，。"
TRADITIONAL = "的一是不了在人有我他這中大來上國個到說們為子和你地出道也時年得就那要下以生會自著去之過家學對可裡後小麼心多天而能好都然沒日於起還發成事只作當想看文無開手十用主行方又如前所本見經頭面公同三已老從動兩長，。"
KOREAN = "이다는을에의가고하은를한로기도지서사인어시자리대들으나그있스정아과해부라수일장것보제전와만요면여상주게적안었구공습니원조성국위"
CANDIDATES = {"cp1251": RUSSIAN, "koi8-r": RUSSIAN, "shift_jis": JAPANESE, "euc-jp": JAPANESE, "gb18030": SIMPLIFIED, "big5": TRADITIONAL, "euc-kr": KOREAN}
WESTERN = "cp1252"

LEAST = 0.25  # share of frequent characters below which a candidate is no match
LEAST_OF_BYTES = 0.7  # the same for encodings of one byte a character
ALONE = 0.5  # share of runs beyond ASCII that touch an ASCII letter, from which those don't match
SHARP = 12.0  # how fast confidence falls with the lead over the next candidate
_RUN = re.compile(rb"[\x80-\xff]+")
_TOUCHING = re.compile(rb"(?<=[A-Za-z])[\x80-\xff]+|[\x80-\xff]+(?=[A-Za-z])")


def _share(data: bytes, name: str, frequent: frozenset[str]) -> float:
    """The share of frequent characters among those beyond ASCII; 0 where the bytes don't decode."""
    try:
        text = data.decode(name)
    except UnicodeDecodeError as e:
        if e.start < len(data) - 3:  # a text may be cut inside a character, nowhere else
            return 0.0
        text = data[: e.start].decode(name)
    beyond = Counter(c for c in text if c > "\x7f")
    return sum(n for c, n in beyond.items() if c in frequent) / beyond.total() if beyond else 0.0


_FREQUENT = {name: frozenset(chars) for name, chars in CANDIDATES.items()}


def detect(data: bytes) -> tuple[str, float]:
    """(encoding, confidence from 0 to 1). Valid UTF-8 is sure; without bytes beyond ASCII there is nothing to tell."""
    try:
        data.decode("utf-8")
        return "utf-8", 1.0
    except UnicodeDecodeError:
        pass
    runs = len(_RUN.findall(data))
    alone = len(_TOUCHING.findall(data)) / max(runs, 1)
    least = {name: LEAST if chars is not RUSSIAN else LEAST_OF_BYTES if alone < ALONE else 2.0 for name, chars in CANDIDATES.items()}
    rated = sorted(((s, name) for name, chars in _FREQUENT.items() if (s := _share(data, name, chars)) >= least[name]), reverse=True)
    if not rated:
        return WESTERN, alone if runs > 3 else 0.75 * alone
    lead = rated[0][0] - max(rated[1][0] if len(rated) > 1 else 0.0, LEAST)
    return rated[0][1], 1 - math.exp(-SHARP * max(lead, 0.0))


def detect_encodings(files: DataFrame, partitions: int | None = None) -> DataFrame:
    """(path, encoding, confidence) of each file (path, content). A null content is an empty file. A small table in few
    partitions is dealt out to ``partitions``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [detect(c or b"") for c in b["content"]]
            yield pd.DataFrame({"path": b["path"], "encoding": [e for e, _ in found], "confidence": [c for _, c in found]})

    if partitions:
        files = files.repartition(partitions)
    return files.select("path", F.col("content").cast("binary").alias("content")).mapInPandas(run, "path string, encoding string, confidence double")
