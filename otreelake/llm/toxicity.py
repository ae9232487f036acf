"""Toxicity as severity grades by cumulative-link ordinal regression.

P(grade >= k | x) = sigmoid(w.x - t_k) for k = 1 to 3, with one weight vector for all thresholds and t_1 < t_2 < t_3, so the grades are
ordered by construction. The expected severity is the sum of the three probabilities, between 0 and 3.

Labels say toxic or not. The grades of labelled toxic documents come from them and the texts: words that toxic documents
have far more often than others are marked, and a document's grade is 1 with none or few marked words, up to 3 with
many, by thirds of the number among toxic documents that have any.

Features are words (letters, lower case) and beginnings of words of 3 to 8 letters that go on (`lowei+`), which hold what inflection
hides, each with 1 + log(count). Only features whose document frequencies in the two labels differ significantly get a weight, and
of a word and its beginnings only the one that says most.

The model is fitted on a bounded sample of labelled documents: at most `SAMPLE` of each label, by a hash of the id, and of those
that are near copies of one another only the first: copies would make any of their words look like evidence. Features are counted and
chosen in Spark; numpy on the driver fits the weights of the chosen ones. Scoring reads every whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, filter_batches, map_batches

#: Labelled documents of either label that the fit reads at most.
SAMPLE = 4000
#: Features that the model may weigh, the least documents that have one, and the least strength of its association with the label (in standard deviations).
FEATURES, LEAST_DOCS, LEAST_Z = 5000, 4, 4.2
#: Where no cut can be fitted, a document is toxic from this expected severity on.
TOXIC_FROM = 0.5
GRADES = 3

#: Lengths of the beginnings.
STEMS = range(3, 9)
#: Words whose features a worker remembers.
CACHE_ENTRIES = 200_000

_WORD = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:k]}+" for k in STEMS if k < len(word))]


def features(text: str | None) -> Counter:
    found: Counter = Counter()
    for word, n in Counter(_WORD.findall(text.lower()) if text else ()).items():
        for f in features_of(word):
            found[f] += n
    return found


@dataclass(frozen=True)
class OrdinalModel:
    weights: dict[str, float]
    thresholds: tuple[float, ...]
    toxic_from: float = TOXIC_FROM

    def counts(self, text: str | None, known: dict[str, tuple[str, ...]]) -> Counter:
        """Counts of the features that have a weight. known: what earlier words had."""
        found: Counter = Counter()
        for word, n in Counter(_WORD.findall(text.lower()) if text else ()).items():
            own = known.get(word)
            if own is None:
                own = tuple(f for f in features_of(word) if f in self.weights)
                if len(known) >= CACHE_ENTRIES:
                    known.clear()
                known[word] = own
            for f in own:
                found[f] += n
        return found

    def severity(self, text: str | None, known: dict[str, tuple[str, ...]] | None = None) -> tuple[float, int]:
        """Expected severity and the likeliest grade; a text without words has the grade of no evidence."""
        x = sum(self.weights[f] * (1 + math.log(n)) for f, n in self.counts(text, {} if known is None else known).items())
        at_least = [1 / (1 + math.exp(min(700.0, t - x))) for t in self.thresholds]
        levels = [a - b for a, b in zip([1.0, *at_least], [*at_least, 0.0], strict=True)]
        return sum(at_least), max(range(len(levels)), key=levels.__getitem__)


def most_telling(strength: dict[str, float]) -> list[str]:
    """Features by strength, without those of which a beginning says more, or a longer form as much."""
    dropped = set()
    for f, z in strength.items():
        word = f.removesuffix("+")
        for shorter in (f"{word[:k]}+" for k in STEMS if k < len(word)):
            if shorter in strength and z > 0:
                dropped.add(f if strength[shorter] > z else shorter)
    return sorted(strength.keys() - dropped, key=lambda f: (-abs(strength[f]), f))[:FEATURES]


def association(n: Column, m: Column, total_n: int, total_m: int) -> Column:
    """Signed root of the likelihood-ratio statistic: how far a feature's document frequencies n of total_n and m of total_m are from one rate."""
    total = max(1, total_n + total_m)

    def term(seen: Column, row: Column, col: int) -> Column:
        return F.when(seen > 0, seen * F.log(seen * total / (row * col))).otherwise(0.0)

    g = 2 * (term(n, n + m, total_n) + term(m, n + m, total_m) + term(total_n - n, total - n - m, total_n) + term(total_m - m, total - n - m, total_m))
    return F.signum(n * total_m - m * total_n) * F.sqrt(F.greatest(g, F.lit(0.0)))


def sketch(text: str | None) -> list[int]:
    """Minima of 16 hashes over the pairs of neighbouring words; none for a text without a pair."""
    words = _WORD.findall((text or "").lower())
    pairs = np.array([xxhash.xxh32_intdigest(f"{a} {b}") for a, b in set(pairwise(words))], np.uint64)
    return [int((pairs * np.uint64(2 * k + 1) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).min()) for k in range(16)] if len(pairs) else []


def first_copies(sketches: list[list[int]], alike: int = 6) -> list[bool]:
    """Whether no earlier sketch agrees in `alike` places or more."""
    having: dict[tuple[int, int], list[int]] = {}
    first = []
    for i, s in enumerate(sketches):
        hits = Counter(j for place in enumerate(s) for j in having.get(place, ()))
        first.append(not hits or max(hits.values()) < alike)
        if first[-1]:
            for place in enumerate(s):
                having.setdefault(place, []).append(i)
    return first


@dataclass(frozen=True)
class Sparse:
    """Documents' features: of each entry the document, the feature and the value."""

    rows: np.ndarray
    cols: np.ndarray
    vals: np.ndarray
    documents: int
    features: int

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.vals * w[self.cols], self.documents) if len(self.rows) else np.zeros(self.documents)

    def of(self, kept: np.ndarray) -> Sparse:
        """Some of the documents."""
        place = np.cumsum(kept) - 1
        own = kept[self.rows]
        return Sparse(place[self.rows[own]], self.cols[own], self.vals[own], int(kept.sum()), self.features)


def thresholds(t: np.ndarray) -> np.ndarray:
    """t holds t_1 and the logarithms of the steps to the others."""
    return t[0] + np.concatenate([[0.0], np.cumsum(np.exp(t[1:]))])


def expected_severity(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    return (1 / (1 + np.exp(np.clip(thresholds(t) - x[:, None], -700, 700)))).sum(1)


def loss_and_gradients(w: np.ndarray, t: np.ndarray, data: Sparse, grade: np.ndarray, ridge: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean of -log P(grade) and half the ridge's square, with the derivatives by the shared weights and by t."""
    x = data.dot(w)
    at_least = 1 / (1 + np.exp(np.clip(thresholds(t) - x[:, None], -30, 30)))
    upper, lower = np.hstack([np.ones((len(x), 1)), at_least]), np.hstack([at_least, np.zeros((len(x), 1))])
    k, n = np.arange(len(x)), max(1, len(x))
    p = np.maximum((upper - lower)[k, grade], 1e-9)
    slope = np.zeros((len(x), GRADES + 2))
    slope[:, 1:-1] = at_least * (1 - at_least)
    by_theta = np.zeros((len(x), GRADES + 2))
    by_theta[k, grade] = slope[k, grade] / p
    by_theta[k, grade + 1] -= slope[k, grade + 1] / p
    by_theta = by_theta[:, 1:-1]  # of -log p
    by_x = -by_theta.sum(1) / n
    g_theta = by_theta.sum(0) / n
    g_w = (np.bincount(data.cols, data.vals * by_x[data.rows], len(w)) if len(data.rows) else np.zeros(len(w))) + ridge * w
    g_t = np.array([g_theta.sum(), *(g_theta[j:].sum() * math.exp(t[j]) for j in range(1, GRADES))])
    return float(-np.log(p).sum() / n + ridge * (w @ w) / 2), g_w, g_t


def solve(data: Sparse, grade: np.ndarray, steps: int, rate: float, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and t by Adam."""
    w, t = np.zeros(data.features), np.array([3.0, *([0.0] * (GRADES - 1))])
    moment, speed = np.zeros(len(w) + GRADES), np.zeros(len(w) + GRADES)
    for step in range(1, steps + 1):
        g = np.concatenate(loss_and_gradients(w, t, data, grade, ridge)[1:])
        moment, speed = 0.9 * moment + 0.1 * g, 0.999 * speed + 0.001 * g * g
        move = rate * (moment / (1 - 0.9**step)) / (np.sqrt(speed / (1 - 0.999**step)) + 1e-8)
        w, t = w - move[: len(w)], t - move[len(w) :]
        t[1:] = np.clip(t[1:], -6, 3)
    return w, t


#: Parts of the sample of which each is judged by a model of the others, to find the cut.
FOLDS = 4


def fit(strength: dict[str, float], chosen: list[str], counts: list[Counter], toxic: list[int], steps: int = 1500, rate: float = 0.1, ridge: float = 1e-5) -> OrdinalModel:
    """The model of labelled counts of the chosen features. The cut is that of the expected severities that each part of the sample has under a model of the other parts."""
    place = {f: i for i, f in enumerate(chosen)}
    marked = {f for f in chosen if strength[f] > 0}
    evidence = [sum(n for w, n in c.items() if w in marked) for c in counts]
    some = sorted(e for e, y in zip(evidence, toxic, strict=True) if y and e)
    cuts = [some[len(some) * k // GRADES] for k in range(1, GRADES)] if some else [1] * (GRADES - 1)
    grade = np.array([0 if not y else 1 + sum(e > c for c in cuts) for e, y in zip(evidence, toxic, strict=True)])

    entries = [(i, place[w], 1 + math.log(n)) for i, c in enumerate(counts) for w, n in c.items() if w in place]
    rows, cols, vals = (np.array(x, kind) for x, kind in zip(zip(*entries), (np.int64, np.int64, float))) if entries else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    data, known = Sparse(rows, cols, vals, len(counts), len(place)), np.array(toxic)
    part = np.arange(len(counts)) % FOLDS  # documents come in order of their ids, which say nothing
    judged = np.zeros(len(counts))
    for k in range(FOLDS):
        others = part != k
        if len(set(known[others])) < 2:
            judged[~others] = np.nan
            continue
        w, t = solve(data.of(others), grade[others], steps // 3, rate, ridge)
        judged[~others] = expected_severity(data.of(~others).dot(w), t)
    fair = ~np.isnan(judged)
    w, t = solve(data, grade, steps, rate, ridge)
    cut_at = best_cut(judged[fair], known[fair])
    return OrdinalModel({word: float(w[i]) for word, i in place.items()}, tuple(map(float, thresholds(t))), cut_at)


def best_cut(expected: np.ndarray, toxic: np.ndarray) -> float:
    """The expected severity with the best F1 in the sample, halfway (in logarithms) to the next lower one there."""
    levels, at = np.unique(expected, return_inverse=True)
    if len(levels) < 2 or not toxic.any():
        return TOXIC_FROM
    hits = np.cumsum(np.bincount(at, toxic, len(levels))[::-1])[::-1]
    taken = np.cumsum(np.bincount(at, minlength=len(levels))[::-1])[::-1]
    k = 1 + int(np.argmax((2 * hits / (taken + toxic.sum()))[1:]))  # the lowest level is that of no evidence
    return float(np.sqrt(levels[k - 1] * levels[k]))


def fit_on(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> OrdinalModel:
    """The model of a bounded sample of labelled documents: `sample` ids of either label at most, by hash; a document without text counts as empty.
    Labels other than 0 and 1, null ids and labels without a document are left out; of repeated labels the higher counts, of repeated ids the least text. Where only one label
    occurs there is nothing to learn, and the model finds nothing toxic."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.where("_toxic = 1").orderBy(*order).limit(sample).union(known.where("_toxic = 0").orderBy(*order).limit(sample))
    kind = dict(docs.dtypes)["doc_id"]
    # 2 * sample ids at most
    texts = cut(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "_toxic").agg(F.min("text").alias("text")))
    sketches = map_batches(texts, lambda c: {"doc_id": c["doc_id"], "sketch": [sketch(t) for t in c["text"]], "toxic": c["_toxic"]}, f"doc_id {kind}, sketch array<bigint>, toxic int").toArrow().sort_by("doc_id").to_pylist()
    first = {r["doc_id"]: r["toxic"] for r, f in zip(sketches, first_copies([r["sketch"] for r in sketches]), strict=True) if f}  # 2 * sample at most
    n = sum(first.values())
    if not n or n == len(first):
        return OrdinalModel({}, (3.0, 4.0, 5.0))
    kept = texts.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in first], f"doc_id {kind}")), "doc_id", "left_semi")
    made = map_batches(kept, lambda c: {"toxic": c["_toxic"], "f": [list(features(t)) for t in c["text"]]}, "toxic int, f array<string>")
    seen = made.select("toxic", F.explode("f").alias("f")).groupBy("f").agg(F.sum("toxic").alias("n"), F.count(F.lit(1)).alias("all")).where(F.col("all") >= LEAST_DOCS)
    strong = seen.select("f", association(F.col("n"), F.col("all") - F.col("n"), n, len(first) - n).alias("z")).where(F.abs("z") >= LEAST_Z)
    strength = {r["f"]: r["z"] for r in strong.orderBy(F.abs("z").desc(), "f").limit(4 * FEATURES).collect()}
    chosen = most_telling(strength)
    chooser = OrdinalModel(dict.fromkeys(chosen, 1.0), ())

    def count(cols: dict) -> dict:
        found = [chooser.counts(t, {}) for t in cols["text"]]
        return {"doc_id": cols["doc_id"], "f": [list(c) for c in found], "n": [list(c.values()) for c in found]}

    rows = map_batches(kept, count, f"doc_id {kind}, f array<string>, n array<int>").toArrow().sort_by("doc_id").to_pylist()
    return fit(strength, chosen, [Counter(dict(zip(r["f"], r["n"], strict=True))) for r in rows], [first[r["doc_id"]] for r in rows])


def grade_toxicity(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """docs with expected_severity (0 to 3), severity (the likeliest grade) and toxic. Null and empty texts have the severity of no evidence; rows and other columns stay; columns of the new names are replaced."""
    docs = docs.drop("expected_severity", "severity", "toxic")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES words at most

    def grade(cols: dict, known: dict) -> dict:
        got = [sent.value.severity(t, known) for t in cols["text"]]
        return {"expected_severity": [round(s, 6) for s, _ in got], "severity": [g for _, g in got], "toxic": [s >= model.toxic_from for s, _ in got]}

    return map_batches(docs, grade, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", expected_severity double, severity int, toxic boolean", dict)


def drop_toxic(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """docs without those that the model finds toxic; rows that stay are unchanged, whatever their columns are called."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return filter_batches(docs, lambda cols, known: [sent.value.severity(t, known)[0] < sent.value.toxic_from for t in cols["text"]], dict)
