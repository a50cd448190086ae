"""Toxicity by multiple-instance learning: a document is a bag of sentences.

Every sentence has a logistic score over its words and their beginnings; the document's score is their noisy-or,
``1 - prod(1 - p)``. Only documents carry labels, so the gradient of the document's likelihood decides which sentences
take the blame, and the same sentence scores then locate the offending ones.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lynceus.llm.common import crc_part

END = re.compile(r"[.!?\n]")
WORDS = re.compile(r"\w+")
#: Lengths of the word beginnings that are features too.
PREFIXES = (4, 5, 6, 7)

RESULT = T.StructType([
    T.StructField("score", T.DoubleType()),
    T.StructField("sentences", T.ArrayType(T.StructType([
        T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
        T.StructField("score", T.DoubleType())])))])


@dataclass(frozen=True)
class ToxicityModel:
    """Log-odds of a sentence: ``bias`` plus the weights of its distinct words. ``bias`` None: nothing to learn from."""

    bias: float | None = None
    weights: dict[str, float] = field(default_factory=dict)


def _bags(text: str) -> list[set[str]]:
    """The distinct words of each sentence that has any."""
    return [words for part in END.split(text) if (words := set(WORDS.findall(part.lower())))]


def _features(word: str) -> list[str]:
    """The word and its beginnings, which stems of many endings share."""
    return [word[:n] for n in PREFIXES if n < len(word)] + [word]


def learn(texts: list[str], labels: list[int], min_docs: int = 3, rounds: int = 150, rate: float = 0.5,
          sparsity: float = 0.6, ridge: float = 0.1, positive_weight: float = 2.5) -> ToxicityModel:
    """Maximum a posteriori fit to the document labels under noisy-or: AdaGrad with an elastic-net prior.

    Features in fewer than ``min_docs`` documents get no weight. Without documents of both classes the model is empty
    and scores every text 0.
    """
    y = np.asarray(labels, dtype=bool)
    if not len(y) or y.all() or not y.any():
        return ToxicityModel()
    seen: dict[str, int] = {}
    for text in texts:
        for f in {f for bag in _bags(text) for w in bag for f in _features(w)}:
            seen[f] = seen.get(f, 0) + 1
    ids = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= min_docs))}
    del seen
    sentence_doc, length, feature_id = array("i"), array("i"), array("i")
    for d, text in enumerate(texts):
        for bag in _bags(text):
            known = sorted({ids[f] for w in bag for f in _features(w) if f in ids})
            feature_id.extend(known)
            length.append(len(known))
            sentence_doc.append(d)
    sd, fi = np.frombuffer(sentence_doc, np.int32), np.frombuffer(feature_id, np.int32)
    fs = np.repeat(np.arange(len(sd), dtype=np.int32), np.frombuffer(length, np.int32))
    w, b = np.zeros(len(ids)), -4.0
    gw, gb = np.full(len(ids), 1e-8), 1e-8
    for _ in range(rounds):
        z = b + np.bincount(fs, w[fi], len(sd))
        p = 1 / (1 + np.exp(-z))
        miss = np.bincount(sd, np.logaddexp(0, z), len(y))  # -log of the chance that no sentence is toxic
        pull = np.where(y, -positive_weight / np.expm1(np.clip(miss, 1e-9, 500)), 1.0)
        g = pull[sd] * p
        dw = np.bincount(fi, g[fs], len(ids)) + ridge * w
        db = g.sum()
        gw += dw * dw
        gb += db * db
        step = rate / np.sqrt(gw)
        w -= step * dw
        w = np.sign(w) * np.maximum(0, np.abs(w) - step * sparsity)
        b -= rate * db / np.sqrt(gb)
    return ToxicityModel(float(b), {f: float(w[i]) for f, i in ids.items() if w[i]})


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id",
        max_docs: int = 8000, max_chars: int = 50_000) -> ToxicityModel:
    """The model of a bounded sample of labelled documents.

    The ``max_docs`` labels of the smallest key hash are learned from in one task. Of a text of more than ``max_chars``
    characters it learns from sentences drawn by the hash of their place, some ``max_chars`` characters in all. Null
    texts and null labels are skipped; of several labels of a key the largest holds. Other columns are not read,
    whatever their names. Tables without documents of both classes give an empty model. Only weights reach the driver.
    """

    def train(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*frames, pd.DataFrame({"text": [], "label": []})])
        model = learn(rows["text"].tolist(), rows["label"].astype(int).tolist())
        yield pd.DataFrame({"feature": [None, *model.weights], "weight": [model.bias, *model.weights.values()]},
                           ).astype({"weight": float})

    parts = 1_000_000
    drawn = F.filter(F.split("text", END.pattern), lambda s, i: (
        F.pmod(F.xxhash64(i), F.lit(parts)) * F.length("text") < parts * max_chars))
    bounded = F.when(F.length("text") <= max_chars, F.col("text")).otherwise(F.array_join(drawn, "\n"))
    wanted = (labels.where(F.col(label).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("__label"))
              .withColumn("__h", F.xxhash64(key)).orderBy("__h", key).limit(max_docs))
    rows = (docs.select(key, F.col(text).alias("text")).where("text is not null")
            .join(F.broadcast(wanted), key)  # max_docs rows of two numbers
            .select(bounded.alias("text"), F.col("__label").alias("label"), "__h", key)
            .orderBy("__h", key, "text").limit(max_docs).select("text", "label"))
    found = {r[0]: r[1] for r in rows.mapInPandas(train, "feature string, weight double").collect()}
    bias = found.pop(None, None)
    return ToxicityModel(None if bias is None or math.isnan(bias) else bias, found)


class Judge:
    """Scores texts by a model; remembers the log-odds of the words it has met, up to a bound."""

    def __init__(self, model: ToxicityModel, floor: float = 0.5, remember: int = 500_000):
        self.model, self.floor, self.remember = model, floor, remember
        self.known: dict[str, float] = {}

    def odds(self, words: dict[str, None]) -> float:
        known, get = self.known, self.model.weights.get
        total = self.model.bias
        for w in words:
            if (x := known.get(w)) is None:
                if len(known) >= self.remember:
                    known.clear()
                x = known[w] = sum(get(f, 0.0) for f in _features(w))
            total += x
        return total

    def __call__(self, text: str) -> tuple[float, list[dict]]:
        """Score of one text and its sentences (code point offsets) that score ``floor`` or more."""
        if self.model.bias is None:
            return 0.0, []
        quiet, found, start = 0.0, [], 0  # quiet: log of the chance that no sentence is toxic
        for part in END.split(text):
            if words := set(WORDS.findall(part.lower())):
                z = self.odds(words)
                quiet -= z if z > 30 else math.log1p(math.exp(z))
                p = 1 / (1 + math.exp(-z)) if z > -700 else 0.0
                if p >= self.floor:
                    found.append({"start": start, "end": start + len(part), "score": p})
            start += len(part) + 1
        return max(0.0, -math.expm1(quiet)), found


def toxicity(text: Column, model: ToxicityModel, floor: float = 0.5) -> Column:
    """Struct column: ``score`` (0 to 1) and the offending ``sentences`` (start, end, score).

    A null or empty text has no sentence and scores 0. Each row is scored by itself, so repeated rows and ties score
    alike; other columns are not touched. Whole texts are read, however long.
    """

    @F.pandas_udf(RESULT)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        judge = Judge(model, floor)
        for texts in batches:
            out = [judge(x or "") for x in texts]
            yield pd.DataFrame({"score": [x[0] for x in out], "sentences": [x[1] for x in out]})

    return score(text)


def op10(docs: DataFrame, labels: DataFrame, limit: float = 0.7) -> DataFrame:
    """The contract's columns for every row of ``docs``, and the offending sentences."""
    model = fit(docs, labels.where(crc_part(F.col("doc_id"), 3) != 1))
    return (docs.select("doc_id", (crc_part(F.col("doc_id"), 3) == 1).alias("held_out"),
                        toxicity(F.col("text"), model).alias("t"))
            .select("doc_id", "held_out", "t.score", (F.col("t.score") >= limit).cast("int").alias("predicted"),
                    "t.sentences"))
