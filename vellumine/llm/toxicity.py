"""Toxicity by multiple-instance learning: sentences are judged, documents are labelled.

A document is a bag of sentences. A sentence's probability is logistic in the features
of its words; the document's is the noisy-or, 1 - prod(1 - p). Weights are fitted to the
documents' labels through that noisy-or, so the model itself decides which sentences
carry a label, and ``locate`` names them. Features of a word are the word and its
beginnings, so compounds of one stem share what is learnt.

The fit uses at most ``FIT_ROWS`` labelled documents, those with the smallest hash of
doc_id, never one that is held out. Scores never read labels, lang, source or doc_id.

Cases: a null or empty text, or one without a word, has score 0. A null label counts
as none; a document labelled both ways counts as toxic. With no label of both kinds
every score is 0. A null doc_id is never labelled and not held out. Repeated rows stay.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.llm.common import carried, restored, sized_join
from vellumine.shared import cut

#: Labelled documents that the fit uses at most.
FIT_ROWS = 20_000
#: Documents in which a feature must stand, and the least that it must tell (G statistic).
LEAST_DOCS, LEAST_G = 4, 3.0
BEGINNINGS = range(4, 9)
THRESHOLD = 0.3
STEPS, RATE, RIDGE = 400, 0.05, 2e-4
#: Feature numbers that a step of the fit looks at together.
BLOCK = 1 << 20
#: Word weights that a worker remembers.
REMEMBERED = 500_000

_SENTENCE = re.compile(r"[^.!?\n\r]+")
_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    return [word, *(word[:k] + "+" for k in BEGINNINGS if k <= len(word))]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled(labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, toxic of the documents that the fit may use."""
    given = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    return given.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def _chosen(bags: DataFrame) -> dict[str, int]:
    """The features that tell most about the label, by the G statistic, numbered."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for b in batches:
            for text, toxic in zip(b["text"], b["toxic"], strict=True):
                words = set(_WORD.findall((text or "").lower()))
                seen[int(toxic > 0)].update({f for w in words for f in features(w)})
        names = list(seen[0].keys() | seen[1].keys())
        for i in range(0, len(names), 100_000):
            part = names[i : i + 100_000]
            yield pd.DataFrame({"feature": part, "clean": [seen[0][f] for f in part], "toxic": [seen[1][f] for f in part]})

    counts = bags.mapInPandas(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b"))
    size = bags.agg(F.count_if(F.col("toxic") <= 0), F.count_if(F.col("toxic") > 0)).first()
    if not (size[0] and size[1]):
        return {}
    n0, n1 = float(size[0]), float(size[1])
    with_it, rate = F.col("a") + F.col("b"), n1 / (n0 + n1)

    def term(x: Column, expected: Column) -> Column:
        return F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)

    g = term(F.col("a"), with_it * (1 - rate)) + term(F.col("b"), with_it * rate)
    g = g + term(n0 - F.col("a"), (n0 + n1 - with_it) * (1 - rate)) + term(n1 - F.col("b"), (n0 + n1 - with_it) * rate)
    best = counts.where(with_it >= LEAST_DOCS).withColumn("g", g).where(F.col("g") > LEAST_G)
    return {row["feature"]: i for i, row in enumerate(sorted(best.select("feature").collect()))}


def train(docs: DataFrame, labels: DataFrame, *, rows: int = FIT_ROWS) -> dict[str, Any]:
    """weights by feature and the bias of a sentence."""
    bags = cut(sized_join(docs.select("doc_id", "text"), labelled(labels, rows), "doc_id", row_bytes=48).select("text", "toxic"), "bags")
    chosen = _chosen(bags)
    if not chosen:
        return {"weights": {}, "bias": -np.inf}
    shared = bags.sparkSession.sparkContext.broadcast(chosen)

    def sentences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chosen = shared.value
        for b in batches:
            got = []
            for text, toxic in zip(b["text"], b["toxic"], strict=True):
                plain, lists = 0, []
                for s in _SENTENCE.findall((text or "").lower()):
                    words = set(_WORD.findall(s))
                    found = sorted({chosen[f] for w in words for f in features(w) if f in chosen})
                    if found:
                        lists.append(found)
                    elif words:
                        plain += 1
                got.append((int(toxic > 0), plain, np.array([x for y in lists for x in y], np.int32).tobytes(), np.array([len(y) for y in lists], np.int32).tobytes()))
            yield pd.DataFrame(got, columns=["y", "plain", "ids", "sizes"])

    fit = bags.mapInPandas(sentences, "y int, plain int, ids binary, sizes binary").toPandas()
    weights, bias = _fit(fit, len(chosen))
    return {"weights": {f: float(weights[i]) for f, i in chosen.items() if abs(weights[i]) > 1e-4}, "bias": bias}


def _ints(held: bytes | list[int]) -> np.ndarray:
    return np.frombuffer(held, np.int32) if isinstance(held, (bytes, bytearray)) else np.asarray(held, np.int32)


def _fit(fit: pd.DataFrame, n: int) -> tuple[np.ndarray, float]:
    """Adam on the noisy-or likelihood; every sentence without a feature has the bias's probability.

    The feature numbers of all sentences stay as they came, four bytes each; a step goes through them by blocks.
    """
    y, plain = fit["y"].to_numpy(), fit["plain"].to_numpy(float)
    of_bag = [_ints(s) for s in fit["sizes"]]
    bag = np.repeat(np.arange(len(y)), [len(s) for s in of_bag])
    sizes = np.concatenate([*of_bag, np.zeros(0, np.int32)])
    ids = np.concatenate([*map(_ints, fit["ids"]), np.zeros(0, np.int32)])
    ends = np.cumsum(sizes, dtype=np.int64)
    starts = ends - sizes
    edges = np.unique(np.r_[np.searchsorted(starts, np.arange(0, max(len(ids), 1), BLOCK)), len(sizes)])
    blocks = [(a, c, slice(starts[a], ends[c - 1])) for a, c in zip(edges[:-1], edges[1:], strict=True)]
    w, b = np.zeros(n), -5.0
    m, v, mb, vb = np.zeros(n), np.zeros(n), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = np.full(len(sizes), b)
        for a, c, part in blocks:
            z[a:c] += np.add.reduceat(w[ids[part]], starts[a:c] - starts[a])
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-b))
        none = np.bincount(bag, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y)) + plain * np.log1p(-p0)
        any_ = np.maximum(-np.expm1(none), 1e-9)
        pull = np.where(y == 1, (1 - any_) / any_, -1.0) / len(y)
        gz = pull[bag] * p
        gw = np.zeros(n)
        for a, c, part in blocks:
            gw += np.bincount(ids[part], np.repeat(gz[a:c], sizes[a:c]), n)
        gw = gw - RIDGE * w / max(n, 1) ** 0.5
        gb = gz.sum() + (pull * plain * p0).sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        scale = RATE * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
        w, b = w + scale * m / (np.sqrt(v) + 1e-9), b + scale * mb / (vb**0.5 + 1e-9)
    return w, float(b)


class _Words(dict):
    """Weight of a word; remembers what it has worked out."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = sum(self.weights.get(f, 0.0) for f in features(word))
        return found


def sentence_scores(text: str | None, words: _Words, bias: float) -> Iterator[tuple[int, int, float]]:
    """(start, end, probability) of each sentence that holds a word."""
    for s in _SENTENCE.finditer(text or ""):
        if found := set(_WORD.findall(s[0].lower())):
            z = bias + sum(map(words.__getitem__, found))
            yield s.start(), s.end(), 1 / (1 + np.exp(-min(max(z, -60.0), 60.0)))


def scored(docs: DataFrame, model: dict[str, Any], *, least: float = 0.5) -> DataFrame:
    """doc_id, score, and offending: (start, end, score) of the sentences with at least ``least``, in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, bias = _Words(shared.value["weights"]), shared.value["bias"]
        for b in batches:
            scores, places = [], []
            for text in b["text"]:
                free, marked = 1.0, []
                if np.isfinite(bias):
                    for start, end, p in sentence_scores(text, words, bias):
                        free *= 1 - p
                        if p >= least:
                            marked.append({"start": start, "end": end, "score": float(p)})
                scores.append(float(min(max(1 - free, 0.0), 1.0)))
                places.append(marked)
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": scores, "offending": places})

    return restored(docs.select(carried("doc_id").alias("doc_id"), "text").mapInPandas(run, "doc_id string, score double, offending array<struct<start:int,end:int,score:double>>"), "doc_id")


def judge(docs: DataFrame, labels: DataFrame, *, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, offending, one row per row of ``docs``."""
    got = scored(docs, train(docs, labels, rows=rows))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "offending")
