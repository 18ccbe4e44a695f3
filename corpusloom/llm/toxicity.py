"""Toxicity by maximum-scoring segments of token log-odds.

Log-odds of tokens between toxic and other labelled documents have Dirichlet priors in levels: a word's
prior has the class shares of its longest stem, a stem's those of the stem one letter shorter, and the
shortest one's those of the background. A token without counts of its own thus takes what is known of
its stem; all tokens that differ clearly from their level above are in the model. Every token costs a
little, so that ordinary text has a negative drift, and one linear scan finds all maximal-scoring
segments, however often their words come elsewhere in the text. A segment is then rated by its own
tokens, repeats within it counting 1, 1/2, 1/3 and so on, because the log-odds speak of documents that have
a token. In ordinary text the number of segments rated above s follows K n exp(-lambda s) in its tail,
which is fitted to labelled documents that aren't toxic. The significant segments of a document are
summed up by their log p-values under that law, and a logistic curve turns the sum into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import cut, fold, give_back, labelled_sample, small_batches

SAMPLE = 40_000  # at most so many labelled documents are learned from
STEMS = (4, 5, 6, 7, 8)  # letters
PRIOR = 5.0  # strength of a prior, in documents
LEAST_Z = 4.0  # by how many deviations a token must differ from its level above
DRIFT = 0.05  # what a token costs
THRESHOLD = 0.7
SIGNIFICANT = 3.0  # surprise of a passage that counts: one in twenty ordinary texts has one by chance
TAIL = 0.9  # the law is fitted to the ordinary segments above this quantile of their scores
ALIKE = 0.75  # share of equal min-hashes at which labelled documents are copies; its error is 0.05 at a similarity of 0.8
_TOKEN = re.compile(r"[^\W\d_]+")
_KNOWN = 100_000  # tokens that a Python worker holds


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def levels(token: str) -> list[str]:
    """The token and its stems, the most specific first."""
    return [token, *(token[:size] + "*" for size in reversed(STEMS) if len(token) > size)]


def segments(scores: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first token, end, score), by one linear scan.

    ``scores`` has the places and scores of the tokens in the model; every token, those included, costs
    ``drift``. Each segment remembers the nearest one before it that starts at a lower running total, so
    the search backwards skips what can't be joined.
    """
    out: list[tuple[int, int, float, float, int]] = []  # first, end, total before and after, that one's index
    total, last = 0.0, 0
    for place, score in scores:
        left = total - drift * (place - last)
        total = left + score - drift
        last = place + 1
        if total <= left:
            continue
        first, k = place, len(out) - 1
        while True:
            while k >= 0 and out[k][2] >= left:
                k = out[k][4]
            if k < 0 or out[k][3] >= total:
                out.append((first, last, left, total, k))
                break
            first, _, left, _, before = out[k]
            del out[k:]
            k = before
    return [(a, b, r - l) for a, b, l, r, _ in out]


class ToxicModel:
    """Scores of words and stems, the law of segment scores, and the curve of the probability."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.lam, self.k = 1.0, 0.01
        self.slope, self.shift = 1.0, -3.0
        self._known: dict[str, float] = {}

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """The number of tokens, and all maximal-scoring segments (first token, end, rating)."""
        words, known = tokens(text), self._known
        if len(known) > _KNOWN:
            known.clear()
        for w in set(words).difference(known):
            known[w] = next((self.weights[x] for x in levels(w) if x in self.weights), 0.0)
        found = [(i, s) for i, s in enumerate(map(known.__getitem__, words)) if s]
        out, k = [], 0
        for a, b, score in segments(found):
            while found[k][0] < a:
                k += 1
            times: Counter[str] = Counter()
            while k < len(found) and found[k][0] < b:
                i, s = found[k]
                times[words[i]] += 1
                score -= s - s / times[words[i]]
                k += 1
            out.append((a, b, score))
        return len(words), out

    def surprise(self, n: int, score: float) -> float:
        """-log of the chance that ordinary text of ``n`` tokens has a segment of this score."""
        log_e = math.log(self.k * max(n, 1)) - self.lam * score
        if log_e < -20:
            return -log_e
        return -math.log(-math.expm1(-math.exp(min(log_e, 6.0))))

    def significant(self, text: str) -> tuple[int, list[tuple[int, int, float, float]]]:
        """The tokens, and the significant passages: first token, end, score, surprise."""
        n, found = self.scan(text)
        rated = [(a, b, s, self.surprise(n, s)) for a, b, s in found]
        return n, [x for x in rated if x[3] > SIGNIFICANT]

    @staticmethod
    def summed(surprises: Iterable[float]) -> float:
        return math.log1p(sum(x for x in surprises if x > SIGNIFICANT))

    def evidence(self, text: str) -> float:
        return self.summed(x[3] for x in self.significant(text)[1])

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.slope * evidence + self.shift))))

    def __reduce__(self):
        return _restored, (self.weights, self.lam, self.k, self.slope, self.shift)


def _restored(weights: dict[str, float], lam: float, k: float, slope: float, shift: float) -> ToxicModel:
    model = ToxicModel(weights)
    model.lam, model.k, model.slope, model.shift = lam, k, slope, shift
    return model


def _split(data: bytes) -> list[bytes]:
    return [w.encode() for w in tokens(data.decode("utf-8", "replace"))]


def without_copies(labelled: DataFrame) -> DataFrame:
    """(doc_id, toxic, text_hash) of the ids in ``labelled`` (doc_id, toxic, text) that aren't copies; of several texts of
    an id the one with the smallest hash counts. An id goes if a band of min-hashes of its runs of three tokens
    leads to the smallest id of its label there, and ALIKE of all their min-hashes are equal. Copies of one
    document are no separate evidence for its words; others stay, whatever single runs they share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [shingles.least_hashes(shingles.grams(_split(t or b""), 3)) for t in b["text"]]
            if made:
                yield pd.DataFrame({"doc_id": b["doc_id"].array, "toxic": b["toxic"].array, "text_hash": b["text_hash"].array, "least": [h.view("i8") for h in made], "band": [shingles.bands(h, t) for h, t in zip(made, b["toxic"])]})
        give_back()

    schema = f"doc_id {labelled.schema['doc_id'].dataType.simpleString()}, toxic int, text_hash long, least array<long>, band array<long>"
    rows = small_batches(labelled).select("doc_id", "toxic", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text")).mapInPandas(run, schema)
    prints = cut(rows.groupBy("doc_id").agg(F.min(F.struct("text_hash", "toxic", "least", "band")).alias("p")).select("doc_id", "p.*"))
    spread = prints.select("doc_id", F.explode("band").alias("band"))
    first = spread.groupBy("band").agg(F.min("doc_id").alias("first"))
    pairs = spread.join(first, "band").where("doc_id <> first").select("doc_id", "first").distinct()
    one, two = prints.select("doc_id", F.col("least").alias("_a")), prints.select(F.col("doc_id").alias("first"), F.col("least").alias("_b"))
    same = F.aggregate(F.zip_with("_a", "_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    gone = pairs.join(one, "doc_id").join(two, "first").where(same >= ALIKE * F.size("_a")).select("doc_id").distinct()
    return prints.select("doc_id", "toxic", "text_hash").join(gone, "doc_id", "left_anti")


def token_counts(labelled: DataFrame) -> DataFrame:
    """(token, c1, c0): in how many toxic and other documents each word and stem occurs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = (Counter(), Counter())

        def flush() -> Iterator[pd.DataFrame]:
            keys = list(counts[0] | counts[1])
            if keys:  # an empty frame would have columns without a type
                yield pd.DataFrame({"token": keys, "c1": [counts[1][x] for x in keys], "c0": [counts[0][x] for x in keys]})
            for c in counts:
                c.clear()

        for b in batches:
            for text, toxic in zip(b["text"], b["toxic"]):
                counts[int(toxic)].update({x for w in set(tokens(text or "")) for x in levels(w)})
                if len(counts[0]) + len(counts[1]) > _KNOWN:
                    yield from flush()
        yield from flush()
        give_back()

    return labelled.select("text", "toxic").mapInPandas(run, "token string, c1 long, c0 long").groupBy("token").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))


def log_odds(counts: DataFrame, n1: int, n0: int) -> dict[str, float]:
    """The log-odds of all tokens that differ clearly from their level above; ``counts`` is read twice."""
    plain = F.rtrim(F.col("token"), F.lit("*"))
    above = F.filter(F.array(*map(F.lit, STEMS)), lambda k: F.length(plain) > k)
    names = F.transform(above, lambda k: F.struct(k.alias("size"), F.concat(F.substring(plain, F.lit(1), k), F.lit("*")).alias("stem")))
    spread = counts.select("token", F.explode(names).alias("_up")).select("token", "_up.*")
    of_stem = counts.where(F.col("token").endswith("*")).withColumnRenamed("token", "stem")
    ups = spread.join(of_stem, "stem").groupBy("token").agg(F.array_sort(F.collect_list(F.struct("size", "c1", "c0"))).alias("ups"))  # a row for each size at most

    def shrunk(c1: Column, c0: Column, level: Column) -> tuple[Column, Column]:
        share = F.exp(level) * n1 / (F.exp(level) * n1 + n0)
        a, b = c1 + PRIOR * share, c0 + PRIOR * (1 - share)
        return F.log(a / n1) - F.log(b / n0), F.sqrt(1 / a + 1 / b)

    none = F.array().cast("array<struct<size:int,c1:bigint,c0:bigint>>")
    level = F.aggregate(F.coalesce("ups", none), F.lit(0.0), lambda up, c: shrunk(c["c1"], c["c0"], up)[0])
    rated = counts.join(ups, "token", "left").select("token", "c1", "c0", level.alias("level"))
    odds, error = shrunk(F.col("c1"), F.col("c0"), F.col("level"))
    best = rated.select("token", odds.alias("odds"), ((odds - F.col("level")) / error).alias("z")).where(F.abs("z") >= LEAST_Z)
    return {r.token: r.odds for r in best.select("token", "odds").collect()}


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and shift of a logistic curve, by Newton steps with a weak prior."""
    design, w = np.stack([x, np.ones_like(x)], 1), np.array([1.0, -2.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + 0.1 * (w - [1.0, -2.0])
        hess = design.T @ (design * (p * (1 - p))[:, None]) + 0.1 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(w[0])), float(w[1])


def labelled_texts(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, toxic, text), one row for each of at most ``sample`` labelled ids outside the held-out fold, those
    with the smallest hashes, without copies. Of several labels of an id the largest counts."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = labelled_sample(known.where(fold("doc_id", 3) != 1), sample)
    texts = docs.select("doc_id", "text")
    stay = without_copies(texts.join(F.broadcast(chosen), "doc_id"))
    rows = texts.withColumn("text_hash", F.xxhash64("text")).join(F.broadcast(stay), ["doc_id", "text_hash"])
    return rows.groupBy("doc_id", "toxic").agg(F.first("text").alias("text"))  # rows may repeat


def fit_law(model: ToxicModel, ordinary: DataFrame) -> None:
    """Set lambda and K from ``ordinary`` (n, found): above a high quantile u the scores of segments are u plus an
    exponential, and their number is K n exp(-lambda u). Only sums reach the driver."""
    scores = ordinary.select(F.explode("found").alias("s")).where("s > 0")
    u = scores.agg(F.percentile_approx("s", TAIL, 10_000)).first()[0]
    n = ordinary.agg(F.sum("n")).first()[0] or 0
    if not n:
        return
    u = u or 0.0
    over = scores.where(F.col("s") > u).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("s") - u).alias("sum")).first()
    mean = ((over["sum"] or 0.0) + 0.5) / (over["n"] + 1)  # as with one more score, half a unit above: few scores don't make a steep law
    model.lam = min(max(1 / mean, 0.2), 5.0)
    model.k = (over["n"] + 1) * math.exp(model.lam * u) / n


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicModel:
    """Learn from labelled documents outside the held-out fold, at most ``sample``.

    Of copies among them one is used. Four fifths give the counts, the others the law of segment scores and
    the curve. ``sample`` ids and labels, the clear tokens of these documents, and ``sample`` numbers pass
    through the driver. Without labels of both kinds nothing scores.
    """
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(10))
    rows = cut(labelled_texts(docs, labels, sample).withColumn("counted", part < 8))
    n = {r.toxic: r.n for r in rows.where("counted").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return ToxicModel({})
    model = ToxicModel(log_odds(cut(token_counts(rows.where("counted"))), n[1], n[0]))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [sent.value.scan(t or "") for t in b["text"]]
            if made:
                yield pd.DataFrame({"toxic": b["toxic"].array, "n": [m for m, _ in made], "found": [[s for _, _, s in f] for _, f in made]})

    held = cut(rows.where("NOT counted").select("toxic", "text").mapInPandas(scan, "toxic int, n long, found array<double>"))
    fit_law(model, held.where("toxic = 0"))
    law = ToxicModel({})
    law.lam, law.k = model.lam, model.k

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"toxic": b["toxic"].array, "x": [law.summed(law.surprise(n, s) for s in f) for n, f in zip(b["n"], b["found"])]})

    got = held.mapInPandas(sums, "toxic int, x double").toPandas()
    if len(got):
        model.slope, model.shift = fit_curve(got["x"].to_numpy(float), got["toxic"].to_numpy(float))
    del got
    give_back()
    return model


def score_documents(docs: DataFrame, model: ToxicModel, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted, n_passages, passages) of every row; ``passages``: first token, end, score
    and surprise of each significant one. A null text is an empty one; repeated rows give equal rows, an
    empty table none; further columns are ignored. Texts are scanned whole in linear time, however long;
    a score of exactly ``threshold`` is predicted toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # the clear tokens of at most SAMPLE documents

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = sent.value
        for b in batches:
            found = [tool.significant(t or "")[1] for t in b["text"]]
            score = [tool.probability(tool.summed(x[3] for x in f)) for f in found]
            rows = [[dict(zip(("first", "end", "score", "surprise"), x)) for x in f] for f in found]
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": score, "predicted": [int(s >= threshold) for s in score], "passages": rows})

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, score double, predicted int, passages array<struct<first:int,end:int,score:double,surprise:double>>"
    return small_batches(docs).select("doc_id", "text").mapInPandas(run, schema).withColumn("n_passages", F.size("passages"))


def keep_clean(docs: DataFrame, model: ToxicModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below ``threshold``. Null and empty texts stay
    unless such labelled texts are mostly toxic; repeated rows stay or go together; columns of any name are
    kept; an empty table stays empty."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def clean(text: pd.Series) -> pd.Series:
        tool = sent.value
        return pd.Series([tool.probability(tool.evidence(t or "")) < threshold for t in text], dtype=bool)

    return small_batches(docs).where(F.pandas_udf(clean, "boolean")("text"))


def judged_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What op3 returns."""
    scored = score_documents(docs, train(docs, labels))
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted", "n_passages")
