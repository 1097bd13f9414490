"""Toxicity by multiple-instance learning (operator 10).

A document is a bag of sentences. A sentence's probability is a logistic function of its distinct words and their
beginnings, measured against a sentence without any evidence (whose probability is 0); a document's is their noisy-or,
1 - prod(1 - p). Only documents carry labels, so the weights are trained on the document's likelihood, and
afterwards the sentence probabilities say where the offence is. Training and scoring use the same noisy-or: slight evidence in many
sentences adds up; only sentences without any count nothing, however long the document.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_of, prepare, save, table, text_or_empty

#: The classifier is fitted on at most so many labelled rows of either label, the first in the order of a hash of their id.
SAMPLE_PER_LABEL = 3000
#: Features whose surplus of toxic documents could be chance (among all features tested) get no weight; at most so many do.
MAX_FEATURES = 20_000
THRESHOLD, BIAS = 0.7, -6.0
PREFIXES = (4, 5)
SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")
WORD = re.compile(r"[^\W_]+")
MAX_KEPT = 100_000


def features(word: str) -> list[str]:
    """The word and, marked by a star, its beginnings."""
    return [word, *[word[:n] + "*" for n in PREFIXES if len(word) >= n]]


def telling(in_all: Counter, in_toxic: Counter, share: float) -> list[str]:
    """Features that more toxic documents have than chance explains: by the divergence from the overall share, corrected for their number."""
    bound, found = math.log(max(len(in_all), 1)), []
    for f, k in in_all.items():
        rate = in_toxic[f] / k
        if rate > share:
            gain = rate * math.log(rate / share) + ((1 - rate) * math.log((1 - rate) / (1 - share)) if rate < 1 else 0.0)
            if k * gain >= bound:
                found.append((-k * gain, f))
    return [f for _, f in sorted(found)[:MAX_FEATURES]]


def fit(texts: list[str], labels: list[int], rounds: int = 600, sparsity: float = 5e-5) -> dict[str, float]:
    """Weights of features. Equal texts count once; without both labels nothing gets a weight."""
    first: dict[str, int] = {}
    for text, y in zip(texts, labels, strict=True):
        first[text] = max(y, first.get(text, 0))
    texts, labels = list(first), list(first.values())
    n, toxic = len(texts), sum(labels)
    if not n or not toxic or toxic == n:
        return {}
    in_all, in_toxic = Counter(), Counter()
    for text, y in zip(texts, labels, strict=True):
        seen = {f for w in set(WORD.findall(text.lower())) for f in features(w)}
        in_all.update(seen)
        if y:
            in_toxic.update(seen)
    names = telling(in_all, in_toxic, toxic / n)
    index = {f: i for i, f in enumerate(names)}
    doc_of, cells, cols = [], [], []
    for d, text in enumerate(texts):
        for s in SENTENCE.findall(text.lower()):
            own = [i for w in set(WORD.findall(s)) for f in features(w) if (i := index.get(f)) is not None]
            if own:
                cols += own
                cells += [len(doc_of)] * len(own)
                doc_of.append(d)
    y = np.array(labels, dtype=np.float64)
    # Either label counts for half, as if both were as frequent.
    weight = np.where(y > 0, 0.5 / toxic, 0.5 / (n - toxic))
    doc_of, cells, cols = (np.array(x, dtype=np.int64) for x in (doc_of, cells, cols))
    w, squares, idle = np.full(len(names), 0.5), np.full(len(names), 1e-12), math.log1p(math.exp(BIAS))
    for step in range(rounds):
        z = BIAS + np.bincount(cells, w[cols], minlength=len(doc_of))
        hazard = np.bincount(doc_of, np.maximum(np.logaddexp(0, z) - idle, 0), minlength=n)
        alive = np.exp(-np.maximum(hazard, 1e-9))
        slope = weight * np.where(y > 0, -alive / (1 - alive), 1.0)
        grad = np.bincount(cols, (slope[doc_of] / (1 + np.exp(-z)))[cells], minlength=len(names))
        squares += grad**2
        rate = 0.5 / (1 + step / 100) / np.sqrt(squares)
        w -= rate * grad
        w = np.sign(w) * np.maximum(np.abs(w) - rate * sparsity, 0)
    return {f: float(x) for f, x in zip(names, w, strict=True) if x}


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> dict[str, float]:
    """Fits on a bounded sample of the labelled rows whose crc32(doc_id) mod 3 isn't 1. Rows without id or label don't count."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (bucket_of(F.col("doc_id"), 3) != 1)).select("doc_id", "toxic")
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("toxic")]
    chosen = usable.filter("toxic = 1").orderBy(*order).limit(per_label).unionAll(usable.filter("toxic = 0").orderBy(*order).limit(per_label))
    sample = docs.select("doc_id", text_or_empty().alias("text")).join(save(chosen, "toxicity-chosen"), "doc_id")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sorted(x for b in rows for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
        found = fit([x[1] for x in own], [x[2] for x in own])
        yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array(list(found.values()))], names=["feature", "weight"])

    # One task sees the sample, whose size is bounded above; the model has at most MAX_FEATURES rows.
    model = sample.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).repartition(1).mapInArrow(run, "feature string, weight double")
    return {r.feature: r.weight for r in save(model, "toxicity-model").collect()}


class Scorer:
    def __init__(self, model: dict[str, float]):
        self.model, self.kept, self.idle = model, {}, math.log1p(math.exp(BIAS))

    def word(self, word: str) -> float:
        known = self.kept.get(word)
        if known is None:
            get = self.model.get
            known = sum([get(f, 0.0) for f in features(word)])
            if len(self.kept) >= MAX_KEPT:
                self.kept.clear()
            self.kept[word] = known
        return known

    def sentences(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's probability and the (start, end, probability) of sentences of 0.5 and more, in code points."""
        low, alive, offending, kept = text.lower(), 0.0, [], self.kept
        spans = len(low) == len(text)
        for m in SENTENCE.finditer(low):
            z = 0.0
            for w in set(WORD.findall(m[0])):
                x = kept.get(w)
                z += self.word(w) if x is None else x
            if z > 0:
                hazard = math.log1p(math.exp(min(BIAS + z, 30.0))) - self.idle
                p = -math.expm1(-hazard)
                alive -= hazard
                if p >= 0.5:
                    offending.append((m.start(), m.end(), p))
        if not spans and offending:  # lower-casing changed the length: find the same sentences in the text itself
            own = [m.span() for m in SENTENCE.finditer(text)]
            places = {m.start(): k for k, m in enumerate(SENTENCE.finditer(low))}
            offending = [(*own[places[a]], p) for a, _, p in offending if places[a] < len(own)]
        return -math.expm1(alive), offending


def score(docs: DataFrame, model: dict[str, float], text: str = "text", prefix: str = "") -> DataFrame:
    """Adds score (0 to 1; empty and NULL texts 0), predicted and offending ("start:end" of each offending sentence, joined by commas).

    Reads the text alone; other columns pass through. No shuffle.
    """
    fixed = dict(model)

    def run(texts: pa.Array) -> pa.Array:
        scorer = _scorer(fixed)
        scores, spans = [], []
        for t in texts.to_pylist():
            p, bad = scorer.sentences(t)
            scores.append(p)
            spans.append(",".join(f"{a}:{b}" for a, b, _ in bad))
        return pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(spans, pa.string())], names=["score", "offending"])

    out = docs.withColumn("__tox", F.arrow_udf(run, "struct<score: double, offending: string>")(text_or_empty(text)))
    return (
        out.withColumn(f"{prefix}score", F.col("__tox.score"))
        .withColumn(f"{prefix}predicted", (F.col("__tox.score") >= THRESHOLD).cast("int"))
        .withColumn(f"{prefix}offending", F.col("__tox.offending"))
        .drop("__tox")
    )


_SCORERS: dict[int, Scorer] = {}


def _scorer(model: dict[str, float]) -> Scorer:
    if id(model) not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[id(model)] = Scorer(model)
    return _SCORERS[id(model)]


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the model doesn't call toxic, all columns as they were."""
    scored = score(docs, train(docs, labels), prefix="__tox_")
    return scored.filter("__tox_predicted = 0").select(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    scored = score(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels")))
    # Rows without id are in no fold; they aren't held out, though none of them trains.
    held_out = F.coalesce(bucket_of(F.col("doc_id"), 3) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "offending")
