"""Language identification in two steps: the family first, then the language within it.

Both steps are one-versus-one linear support vector machines over frequencies of hashed byte bigrams and
trigrams of lower-case letters. Families are few and far apart; languages of one family are told apart
by machines trained on these languages only, so that what separates them isn't drowned by what separates
families. Margins become chances by a logistic slope for each machine.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, give_back, small_batches

SAMPLE = 4_000  # at most so many labelled documents are learned from,
LEAST = 20  # but so many of each language at least, or all that it has
SNIPPETS = (40, 160)  # code points; a document gives its whole text and one of each from its inside, for short texts
BUCKETS = 4096
LEAST_SCORE = 0.35

#: Languages by family; a language in no list is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
}
_FAMILY = {x: f for f, xs in FAMILIES.items() for x in xs}
_LETTER = regex.compile(r"\p{L}")
_BYTES = np.array([c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)], np.uint32)


def family(lang: str) -> str:
    return _FAMILY.get(lang, lang)


def features(text: str) -> np.ndarray:
    """Frequencies of hashed byte bigrams and trigrams; runs of anything but letters are one space."""
    raw = _BYTES[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)]
    raw = raw[np.r_[True, (raw[1:] != 32) | (raw[:-1] != 32)]]
    two = raw[:-1] << 8 | raw[1:]
    three = two[:-1] << 8 | raw[2:]
    grams = np.concatenate([two, three | 1 << 24])
    places = grams * np.uint32(2654435761) >> 20
    return np.bincount(places, minlength=BUCKETS) / max(len(grams), 1)


class Sparse:
    """Rows of (places, values). What the machines see is each value less its column's mean, times its scale; that is
    never laid out, because 12,000 rows of features would be 200 MB."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], mean: np.ndarray, scale: np.ndarray):
        self.rows, self.mean, self.scale, self.weight = rows, mean, scale, scale**2
        far = mean * self.weight
        self.centre = float(mean @ far)
        self.cross = np.array([-(v @ far[p]) for p, v in rows])
        self.norm = np.array([v.astype(float) ** 2 @ self.weight[p] for p, v in rows]) + 2 * self.cross + self.centre

    @staticmethod
    def of(x: np.ndarray) -> Sparse:
        return Sparse([(np.arange(x.shape[1]), row) for row in x], np.zeros(x.shape[1]), np.ones(x.shape[1]))


def svm(x: Sparse, rows: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Weights of a linear machine with hinge loss for some rows of ``x``, by dual coordinate descent in a fixed
    order, and its values for these rows. y: 1 or -1 for each of them. The weights are ``sparse / scale`` less
    ``shift`` times the scaled mean, so that a step costs the features of one text."""
    alpha, sparse, shift, along = np.zeros(len(rows)), np.zeros(len(x.mean)), 0.0, 0.0

    def value(i: int) -> float:
        p, v = x.rows[i]
        return float(sparse[p] @ v) + along + shift * (x.cross[i] + x.centre)

    order = np.random.default_rng(7)
    for _ in range(rounds):
        for k in order.permutation(len(rows)):
            i = rows[k]
            if x.norm[i] <= 0:
                continue
            new = min(max(alpha[k] - (y[k] * value(i) - 1) / x.norm[i], 0.0), c)
            if new != alpha[k]:
                step, (p, v) = (new - alpha[k]) * y[k], x.rows[i]
                sparse[p] += step * x.weight[p] * v
                along += step * x.cross[i]
                shift += step
                alpha[k] = new
    return sparse / x.scale - shift * x.mean * x.scale, np.array([value(i) for i in rows])


class Machines:
    """One-versus-one machines between classes; ``chances`` couples their votes. They read rows of ``x`` where
    ``y`` has one of the classes, without copies."""

    def __init__(self, classes: list[str], x: Sparse | np.ndarray, y: np.ndarray):
        x = Sparse.of(x) if isinstance(x, np.ndarray) else x
        self.classes = [str(c) for c in classes]
        self.pairs, weights, slopes = list(itertools.combinations(range(len(classes)), 2)), [], []
        for a, b in self.pairs:
            rows = np.flatnonzero((y == classes[a]) | (y == classes[b]))
            sign = np.where(y[rows] == classes[a], 1.0, -1.0)
            w, values = svm(x, rows, sign)
            margin, slope = sign * values, 1.0
            for _ in range(30):  # logistic slope of the margins, with a weak prior at 1
                p = 1 / (1 + np.exp(np.clip(slope * margin, -30, 30)))
                slope = float(np.clip(slope + ((margin * p).sum() - 0.1 * (slope - 1)) / ((margin**2 * p * (1 - p)).sum() + 0.1), 0.05, 20))
            weights.append(w.astype(np.float32))
            slopes.append(slope)
        self.weights = np.stack(weights, 1) if weights else np.zeros((len(x.mean), 0))
        self.slopes = np.array(slopes)

    def chances(self, x: np.ndarray) -> np.ndarray:
        log = np.zeros(len(self.classes))
        for (a, b), m in zip(self.pairs, self.slopes * (x @ self.weights)):
            log[a] -= np.logaddexp(0, -m)
            log[b] -= np.logaddexp(0, m)
        log = np.exp(log - log.max())
        return log / log.sum()


class LanguageModel:
    """``rows``: places and values of the features of each training text, last a one at BUCKETS, the machines' shift;
    ``langs``: its language."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str]):
        self.empty = not rows
        if self.empty:
            return
        total, square = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
        for p, v in rows:
            total[p] += v
            square[p] += v.astype(float) ** 2
        self.mean = (total / len(rows))[:BUCKETS]
        spread = np.sqrt(np.maximum((square / len(rows))[:BUCKETS] - self.mean**2, 0.0))
        self.scale = 1 / np.maximum(spread, np.median(spread[spread > 0]) if (spread > 0).any() else 1.0) / np.sqrt(BUCKETS)
        x = Sparse(rows, np.append(self.mean, 0.0), np.append(self.scale, 1.0))
        y, kin = np.array(langs), np.array([family(v) for v in langs])
        self.families = Machines(sorted(set(kin)), x, kin)
        self.within = {f: Machines(sorted(set(y[kin == f])), x, y) for f in self.families.classes}

    def predict(self, text: str | None) -> tuple[str, float]:
        if self.empty or not text or not _LETTER.search(text):
            return "und", 0.0
        x = np.append((features(text) - self.mean) * self.scale, 1.0)
        by_family = self.families.chances(x)
        f = int(by_family.argmax())
        machines = self.within[self.families.classes[f]]
        by_lang = machines.chances(x)
        k = int(by_lang.argmax())
        return machines.classes[k], float(by_family[f] * by_lang[k])


def share(sizes: list[int], sample: int = SAMPLE, least: int = LEAST) -> int:
    """How many documents a language may give: the most with which all give ``sample`` together, and ``least`` anyway."""
    left = sample
    for k, n in enumerate(sorted(sizes)):
        each = left // (len(sizes) - k)
        if n > each:
            return max(each, least)
        left -= n
    return max(max(sizes, default=0), least)


def sampled(rows: DataFrame, sample: int = SAMPLE, least: int = LEAST) -> DataFrame:
    """(doc_id, lang): the same number of documents of each language, or all that it has, by the smallest hashes
    of their ids. At most ``sample`` in all, or ``least`` for each language if that is more. ``rows`` must
    hold distinct pairs. One number for each language passes through the driver."""
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    most = share(list(sizes.values()), sample, least)
    # about 1.2 times as many as are wanted are ranked, of a language of any size
    limits = [(v, min((1 << 63) - 1, int((1 << 64) * min(1.0, (1.2 * most + 100) / n)) - (1 << 63))) for v, n in sizes.items()]
    low = F.broadcast(rows.sparkSession.createDataFrame(limits, "lang string, _most long"))
    ranked = rows.withColumn("_hash", F.xxhash64("doc_id")).join(low, "lang").where("_hash <= _most")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_hash", "doc_id"))
    return ranked.withColumn("_place", place).where(F.col("_place") <= most).select("doc_id", "lang")


def train(docs: DataFrame, sample: int = SAMPLE, least: int = LEAST) -> LanguageModel:
    """Learn from text and lang of documents outside the held-out fold, at most ``sample`` in even shares of the
    languages, or ``least`` for each language if that is more: every labelled language is learned. Tasks reduce
    each document's whole text, and two snippets of it, to the features that occur; these come to the driver,
    where the machines are fitted. Of several texts of one id and language the first counts. Without any
    document every language is ``und``."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", 5) != 0))
    chosen = sampled(rows.select("doc_id", "lang").distinct(), sample, least)
    texts = rows.select("doc_id", "text", "lang").join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(997)) / 997.0
    parts = [F.substring("text", (F.greatest(F.length("text") - n, F.lit(0)) * place).cast("int") + 1, F.lit(n)) for n in SNIPPETS]

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, lang, part in zip(b["doc_id"], b["lang"], b["parts"]):
                for t in dict.fromkeys(part):
                    if _LETTER.search(t):
                        x = np.append(features(t), 1.0)
                        places = np.flatnonzero(x)
                        out.append((i, lang, places.astype("<u2").tobytes(), x[places].astype("<f4").tobytes()))
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "lang", "places", "found"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = small_batches(texts).select("doc_id", "lang", F.array("text", *parts).alias("parts")).mapInPandas(reduced, f"doc_id {kind}, lang string, places binary, found binary").toPandas()
    got = got.sort_values(["doc_id", "lang", "places", "found"]) if len(got) else got
    model = LanguageModel([(np.frombuffer(p, "<u2"), np.frombuffer(v, "<f4")) for p, v in zip(got["places"], got["found"])], list(got["lang"]))
    del got
    give_back()
    return model


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) of every row. A text that is null or has no letter is ``und`` with score
    0; repeated rows give equal rows, an empty table none; further columns are ignored. Texts are read whole, in
    time linear in their length; of equally likely languages the first by name is taken."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = sent.value
        for b in batches:
            made = [tool.predict(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang_pred": [v for v, _ in made], "score": [s for _, s in made]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs).select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, lang_pred string, score double")


def keep_told(docs: DataFrame, model: LanguageModel, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language can be told with a score of ``least`` or more.
    Null, empty and letterless texts go; repeated rows stay or go together; columns of any name are kept; an
    empty table stays empty; long texts are read whole."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def told(text: pd.Series) -> pd.Series:
        tool = sent.value
        return pd.Series([v != "und" and s >= least for v, s in map(tool.predict, text)], dtype=bool)

    return small_batches(docs).where(F.pandas_udf(told, "boolean")("text"))


def identified_documents(docs: DataFrame) -> DataFrame:
    """What op6 returns."""
    found = predict_languages(docs, train(docs))
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
