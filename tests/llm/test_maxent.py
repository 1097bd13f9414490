import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerscope.llm import maxent as M
from answerscope.llm.common import save, table

SAMPLE = "/root/testdata/sf0.001"


def words(text):
    return (text or "").encode().lower().split() + [b""]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def check_base(rows, got):
    counts = Counter(w for d, t in rows if not held(d) for w in words(t))
    total, kinds = sum(counts.values()), len(counts)
    want = sorted(((str(d), held(d), len(w := words(t)), sum(counts[x] > 0 for x in w), total, round(sum(math.log10((counts[x] + 1) / (total + kinds + 1)) for x in w), 6)) for d, t in rows))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want


@pytest.mark.parametrize("head", [M.HEAD, 50, 0])
def test_base_scores(session, head):
    """With a small head most words go through the join."""
    docs = table(session, SAMPLE, "documents").select("doc_id", "text", M.held_out(F.col("doc_id")).alias("held_out"))
    got = M.score(docs, docs.filter(~F.col("held_out")), head=head, updates=1).collect()
    check_base([(r.doc_id, r.text) for r in docs.collect()], got)
    assert all(r.score < 0 for r in got)


def test_model_beats_base_on_held_out(session):
    got = M.op5_maxent(session, "/root/testdata/sf0.01").filter("held_out")
    sums = got.agg(F.sum("score").alias("model"), F.sum("base_score").alias("base"), F.sum("n_tokens").alias("n")).first()
    assert sums.model / sums.n > sums.base / sums.n + 0.08


def test_updates_raise_the_likelihood(session):
    docs = table(session, SAMPLE, "documents")
    vocab = M.vocabulary(save(M.word_counts(docs), "t"))
    _, likelihoods = M.learn(save(M.class_counts(docs, vocab), "t"), updates=5)
    assert likelihoods == sorted(likelihoods) and likelihoods[-1] > likelihoods[0]


def test_probabilities_add_up(session, docs_of):
    """Over all known words and one unknown word of each class, P(word | history) sums to one."""
    docs = docs_of([(i, "the cat sat on the mat and the dog ran " + f"x{i % 5} y{i % 3}") for i in range(30)])
    vocab = M.vocabulary(save(M.word_counts(docs), "t"))
    weights, _ = M.learn(save(M.class_counts(docs, vocab), "t"), updates=2)
    logs = M.log_softmax(weights, np.arange(M.CLASSES**2))
    assert np.exp(logs).sum(axis=1) == pytest.approx(1)
    places, inside = vocab.lookup(), np.zeros(M.CLASSES)
    for word, count in zip(vocab.words, vocab.counts, strict=True):
        k = 0 if word == M.END else vocab.class_of[places[word]]
        inside[k] += (count + 1) / 10 ** vocab.class_log[k]
    unknown = 1 / 10 ** vocab.class_log[M.SINGLE :]
    assert inside[M.SINGLE :] + unknown == pytest.approx(1)
    assert all(x == pytest.approx(1) for x in inside[: M.SINGLE] if x)


def test_histories_do_not_cross_texts():
    got = M.histories(np.array([5, 6, 0, 7, 0, 0]), np.array([0, 3, 5]))
    assert [(h // M.CLASSES, h % M.CLASSES) for h in got] == [(0, 0), (5, 0), (6, 5), (0, 0), (7, 0), (0, 0)]


def test_edge_rows(edge):
    docs = edge.withColumn("held_out", M.held_out(F.col("doc_id")))
    got = M.score(docs, docs.filter(~F.col("held_out")), updates=1)
    check_base([(r.doc_id, r.text) for r in edge.collect()], got.collect())
    none = M.score(docs, docs.limit(0), updates=1).collect()
    assert all(r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 and r.score < 0 for r in none)
    assert M.score(docs.limit(0), docs, updates=1).count() == 0
