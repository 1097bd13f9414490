import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerscope.llm import mixing
from answerscope.llm.common import table

COUNT = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        level = (total - sum(3 * sizes[s] for s in full)) / max(sum(weight[s] for s in free), 1e-9)
        more = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not more:
            return {s: 3.0 * sizes[s] if s in full else level * weight[s] for s in names}
        full |= more


def check(rows):
    sizes, taken, target = {}, {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    assert all(r.source_size == sizes[r.source] for r in rows)
    want = plain_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= 1


def mixed(session, docs):
    sizes, quota, mixture = mixing.mix(docs)
    taken = mixture.groupBy("row_id").agg(F.sum(F.col("to") - F.col("from")).alias("taken"))
    return sizes.join(quota.select("source_no", "source_size", "target"), "source_no").join(taken, "row_id", "left").fillna(0, "taken").collect()


def test_permutations():
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        keys = mixing.keys_of("s", 1)
        image = mixing.permuted(np.arange(n), n, keys)
        assert sorted(image) == list(range(n))
        assert (mixing.permuted(image, n, keys, back=True) == np.arange(n)).all()


@pytest.mark.parametrize("tiny", [1, 40, 400])
def test_targets_and_words(session, tiny):
    """One source holds most words, another next to none, so that it fills up."""
    rows = [(i, "w " * (i % 50), None if i % 31 == 0 else "big" if i % 3 else f"s{i % 4}") for i in range(1500)] + [(9000 + i, "x", "a-tiny") for i in range(tiny)]
    docs = session.createDataFrame(rows, "doc_id long, text string, source string")
    first = mixed(session, docs)
    check(first)
    key = lambda rows: sorted((r.doc_id, r.taken) for r in rows)
    assert key(mixed(session, docs.repartition(7))) == key(first)


def test_edge_rows(session, edge):
    check(mixed(session, edge))
    texts = mixing.mixed_texts(edge)
    assert texts.columns == edge.columns
    by = {}
    for r in texts.collect():
        assert r.n_chars == len(r.text)
        by[r.source] = by.get(r.source, 0) + len(COUNT.findall(r.text))
    assert {s: n for s, n in by.items() if n} == {s: n for s, n in sums(mixed(session, edge)).items() if n}
    assert mixed(session, edge.limit(0)) == [] and mixing.mixed_texts(edge.limit(0)).count() == 0
    silent = session.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    check(mixed(session, silent))


def sums(rows):
    out = {}
    for r in rows:
        out[r.source] = out.get(r.source, 0) + r.taken
    return out


def test_shards_draw_all_slots(session):
    docs = table(session, "/root/testdata/sf0.01", "documents")
    old, mixing.SHARD_SLOTS = mixing.SHARD_SLOTS, 512
    try:
        check(mixed(session, docs))
        _, quota, mixture = mixing.mix(docs)
        assert mixture.select("shard").distinct().count() >= 10
    finally:
        mixing.SHARD_SLOTS = old


def test_pieces_of_text():
    spans = lambda *x: [dict(zip(("turn", "from", "to"), s, strict=True)) for s in x]
    text = " a  b\nc d "
    assert mixing.cut_out(text, spans((0, 0, 2), (0, 2, 4))) == text
    assert mixing.cut_out(text, spans((0, 0, 4), (1, 1, 3))) == text + "\nb\nc"
    assert mixing.cut_out(text, spans((0, 0, 1), (0, 2, 4))) == "a\nc d"  # a piece ends with its last word
