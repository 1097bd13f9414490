import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from answerscope.llm import toxicity as T
from answerscope.llm.common import table


@pytest.fixture(scope="module")
def model():
    rng, texts, labels = random.Random(1), [], []
    syllables = "an or ti ea th ou re st en ing".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    for i in range(900):
        sentences = [[word() for _ in range(rng.randint(2, 12))] for _ in range(rng.randint(1, 12))]
        if i % 5 == 0:
            bad = rng.choice(sentences)
            bad.insert(rng.randint(0, len(bad)), rng.choice(["blarg", "Zornak" + word(), "fumple"]))
        texts.append(" ".join(" ".join(s) + "." for s in sentences))
        labels.append(int(i % 5 == 0))
    return T.fit(texts, labels)


def test_finds_sentences_from_document_labels(model):
    scorer, text = T.Scorer(model), "An ti ou. Ré ing BLARG th! Or ea st? Zornaktiti re."
    p, offending = scorer.sentences(text)
    assert p > T.THRESHOLD and [text[a:b].strip() for a, b, _ in offending] == ["Ré ing BLARG th!", "Zornaktiti re."]
    q, none = scorer.sentences("An ti ou. Re ing th! Or ea st? " * 4000)
    assert q < 0.3 and none == []
    assert scorer.sentences("") == (0, [])


def test_lower_case_of_another_length(model):
    text = "İİİİ an. Or blarg ti. Ea."
    _, offending = T.Scorer(model).sentences(text)
    assert [text[a:b].strip() for a, b, _ in offending] == ["Or blarg ti."]


def test_held_out_accuracy(session):
    folder = "/root/testdata/sf0.1"
    got = T.op10_toxicity(session, folder).join(table(session, folder, "labels").select("doc_id", "toxic"), "doc_id").filter("held_out")
    r = got.agg(
        F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("recall"), F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))).alias("false_alarms")
    ).first()
    # About one label in twenty of these rows is 1 on a text that shows no offending word.
    assert r.recall > 0.85 and r.false_alarms < 0.01


def test_held_out_labels_are_not_read(session, docs_of):
    docs = docs_of([(i, f"word{i} blarg" if i % 4 == 0 else f"word{i} fine") for i in range(400)])
    labels = session.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    flipped = labels.withColumn("toxic", F.when(T.bucket_of(F.col("doc_id"), 3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert T.train(docs, labels) == T.train(docs, flipped) != {}


def test_edge_rows(session, edge):
    labels = session.createDataFrame([(1, 1, None), (3, None, None), (None, 1, None), (6, 0, 1), (6, 1, 0)], "doc_id long, toxic int, quality int")
    model = T.train(edge, labels)
    got = T.score(edge, model)
    assert got.count() == edge.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= T.THRESHOLD) for r in got.collect())
    assert T.train(edge, labels.limit(0)) == T.train(edge.limit(0), labels) == {}
    assert T.drop_toxic(edge, labels.limit(0)).columns == edge.columns and T.drop_toxic(edge, labels.limit(0)).count() == edge.count()
    assert T.score(edge.limit(0), {}).count() == 0


def test_spread_evidence_adds_up():
    """40 sentences of 0.049 each make 1 - 0.951 ** 40 = 0.87, as in training."""
    z = math.log(math.expm1(-math.log(0.951) + math.log1p(math.exp(T.BIAS)))) - T.BIAS
    p, offending = T.Scorer({"hint": z}).sentences("A hint here. " * 40)
    assert p == pytest.approx(1 - 0.951**40) and p > T.THRESHOLD and offending == []
    assert T.Scorer({"hint": z}).sentences("Nothing here. " * 4000) == (0, [])


def plain_score(text, model):
    """Noisy-or over sentences: the product of what each leaves, relative to a sentence without evidence."""
    alive = 1.0
    for sentence in T.SENTENCE.findall(text.lower()):
        z = sum(model.get(f, 0.0) for w in set(T.WORD.findall(sentence)) for f in T.features(w))
        if z > 0:
            alive *= (1 + math.exp(T.BIAS)) / (1 + math.exp(min(T.BIAS + z, 30.0)))
    return 1 - alive


def test_query_against_plain_scores(session, tmp_path):
    """Every row of the query, ids and NULL ids, scored by the plain product with the same model."""
    folder = "/root/testdata/sf0.001"
    docs, labels = table(session, folder, "documents"), table(session, folder, "labels")
    more = session.createDataFrame([(None, "No id, stupid!"), (-7, None)], "doc_id long, text string")
    docs.select("doc_id", "text").unionByName(more).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    model = T.train(table(session, str(tmp_path), "documents"), labels)
    got = sorted(((r.doc_id, r.held_out, r.predicted, r.score) for r in T.op10_toxicity(session, str(tmp_path)).collect()), key=str)
    want = []
    for r in table(session, str(tmp_path), "documents").collect():
        p = plain_score(r.text or "", model)
        want.append((r.doc_id, r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1, int(p >= T.THRESHOLD), p))
    want.sort(key=str)
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(g[3] == pytest.approx(w[3], abs=1e-9) for g, w in zip(got, want, strict=True))
