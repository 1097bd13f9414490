import hashlib
import random
import re

import pytest

from answerscope.llm import exact


def plain(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(norm(text), []).append(doc_id)
    return sorted((d, min(groups[norm(t)]), len(groups[norm(t)]), d == min(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for d, t in rows)


@pytest.mark.parametrize(("size", "bits"), [(4, 64), (7, 64), (1024, 64), (5, 3)])
def test_against_plain_grouping(docs_of, size, bits):
    """With three-bit keys different blocks meet in one key, and the keys are drawn anew."""
    rng = random.Random(size)
    texts = ["".join(rng.choice("ab é\n") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    rows = [(i, rng.choice([t, t + " ", t.replace(" ", "  ")])) for i, t in enumerate(texts * 3)]
    got = exact.exact_dedup(docs_of(rows), size=size, bits=bits).collect()
    assert sorted(tuple(r) for r in got) == plain(rows)


def test_same_blocks_in_another_order_differ(docs_of):
    rows = [(1, "aaaabbbb"), (2, "bbbbaaaa"), (3, "aaaabbbbaaaa"), (4, "aaaabbbb"), (5, "aaaa")]
    got = {r.doc_id: r.keep_id for r in exact.exact_dedup(docs_of(rows), size=4).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 1, 5: 5}


def test_edge_rows(edge):
    got = exact.exact_dedup(edge).collect()
    assert len(got) == edge.count() and sum(r.kept for r in got) == 7
    kept = exact.drop_copies(edge)
    assert kept.columns == edge.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "5", "6", "8", "9", "None"])
    assert exact.exact_dedup(edge.limit(0)).count() == 0 and exact.drop_copies(edge.limit(0)).count() == 0


def test_no_python_in_the_plan(edge):
    plan = exact.exact_dedup(edge)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
