import hashlib
import random

import pytest
from pyspark.sql import functions as F

from answerscope.llm import merkle


def plain(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = {}
    for i, (doc_id, text) in enumerate(order):
        other, text = order[(i + 1) % len(order)][1] or "", text or ""
        half = len(text) // 2
        out.setdefault(doc_id, []).append((len(text), hashlib.sha256((text[: len(text) - half] + other[:half]).encode()).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


def result(session, tmp_path, rows):
    session.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = {}
    for r in merkle.op7_merkle(session, str(tmp_path)).collect():
        out.setdefault(r.doc_id, []).append((r.n_chars, r.edited_sha256))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_edited == 1) == (r.fingerprint == r.edited_fingerprint)
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("ids", [range(900), range(0, 900_000, 1000), [0, 1, 2, 10**12, 10**12 + 1], [5], [-7, -3, 4]])
def test_next_document(session, tmp_path, ids):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("ab.\né🎉 ") for _ in range(rng.randint(0, 30)))) for i in ids]
    assert result(session, tmp_path, rows) == plain(rows)


def test_edge_rows(session, tmp_path):
    rows = [(1, "a. b"), (2, None), (2, "x"), (2, "x"), (None, "no id"), (None, None), (7, "word. " * 50_000), (6, "")]
    assert result(session, tmp_path, rows) == plain(rows)
    empty = tmp_path / "none"
    session.createDataFrame([], "doc_id long, text string").write.parquet(str(empty / "documents.parquet"))
    assert merkle.op7_merkle(session, str(empty)).count() == 0


def test_roots_tell_texts_apart(docs_of):
    texts = ["", "\n", "\n\n", "a", "a\n", "a\n\n", "a\nb", "a\n\nb", "ab", "\na\nb", "a\n\n\nb", "b\na", "a\nb\n"]
    got = merkle.fingerprint(docs_of(list(enumerate(texts * 2)))).collect()
    by_root = {}
    for r in got:
        by_root.setdefault(r.fingerprint, set()).add(r.text)
    assert len(by_root) == len(texts) and all(len(v) == 1 for v in by_root.values())


def test_branches_locate_an_edit(docs_of):
    a = "one.\ntwo.\n\nthree.\nfour.\n\nfive."
    frame = docs_of([(1, a)]).withColumn("b", F.lit(a.replace("four", "4")))
    found = frame.select(merkle.changed_paragraphs(merkle.tree(F.col("text")), merkle.tree(F.col("b"))).alias("x")).first().x
    assert [(p.section, p.paragraph) for p in found] == [(1, 1)] or [(p.section, p.paragraph) for p in found] == [(1, 2)]


def test_likeness_and_plan(session, edge):
    got = merkle.op7_merkle(session, "/root/testdata/sf0.01")
    near = got.agg(F.avg("near_edited").alias("e"), F.avg("near_next").alias("n"), F.avg((F.col("near_edited") > F.col("near_next")).cast("int")).alias("above")).first()
    assert near.e > 0.4 and near.n < 0.05 and near.above > 0.97
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert set(edge.columns) | {"tree"} == set(merkle.fingerprint(edge).columns)
