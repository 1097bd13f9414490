"""Signatures, the stored index and near-duplicate classes against plain versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerscope.functions import sets
from answerscope.operators import similarity as M


def grams(text):
    words = [w for w in re.split("[^a-z0-9]+", (text or "").translate({i: i + 32 for i in range(65, 91)})) if w]
    if not words:
        return frozenset()
    return frozenset(" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2)))


def signature(text):
    numbers = sorted(int(hashlib.md5(g.encode()).hexdigest()[:15], 16) for g in grams(text))
    if not numbers:
        return None
    least = {}
    for h in numbers:
        least.setdefault(h >> 53, h)
    return [least[min(least, key=lambda j: (j - i) * M.STEPS_BACK[i] % 128)] for i in range(128)]


def corpus(seed, n=200):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(900)}"
    rows = ["", "one", "one two", "One, TWO!", None, " ".join(word() for _ in range(3000))]
    while len(rows) < n:
        base = [word() for _ in range(rng.choice([3, 8, 20, 60, 200]))]
        for _ in range(rng.choice([1, 1, 3, 10])):
            rows.append(" ".join(base))
            for _ in range(max(1, len(base) // rng.choice([8, 25, 80]))):
                base[rng.randrange(len(base))] = word()
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.fixture(scope="module")
def texts(spark):
    rows = corpus(3)
    return rows, spark.createDataFrame(rows, "id long, text string").repartition(3)


def test_signatures(texts):
    rows, df = texts
    got = {r.id: r.signature for r in M.minhash(df).collect()}
    assert got == {i: signature(t) for i, t in rows}


def test_no_python_in_the_plan(texts):
    plan = M.minhash(texts[1])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_estimates_are_close(spark):
    """The error of the estimate is that of 128 permutations: 0.044 at a similarity of 0.5, whatever the size of the sets."""
    rng = random.Random(9)
    for size in (12, 90, 900):
        errors = []
        for _ in range(60):
            a = [f"a{rng.random()}" for _ in range(size)]
            b = a[: size // 2] + [f"b{rng.random()}" for _ in range(size // 2)]
            x, y = signature(" ".join(a)), signature(" ".join(b))
            both = len(grams(" ".join(a)) & grams(" ".join(b)))
            true = both / (len(grams(" ".join(a)) | grams(" ".join(b))))
            errors.append(sum(p == q for p, q in zip(x, y)) / 128 - true)
        assert abs(sum(errors) / 60) < 0.03 and sum(e * e for e in errors) / 60 < 0.06**2


def test_index_finds_what_a_scan_finds(spark, texts, tmp_path, rows):
    given, df = texts
    named = df.withColumnRenamed("id", "name")
    path = str(tmp_path / "index")
    M.write_index(named.filter("name % 2 = 0"), path)
    M.write_index(named.filter("name % 2 = 1"), path, mode="append")
    for i, text in given[:4]:
        for threshold in (0.01, 0.6):
            scan = M.similar_to(named, text, threshold, 30) if text else None
            got = [tuple(r) for r in M.similar_in_index(spark, path, text or "", threshold, 30).collect()]
            assert got == ([] if scan is None else [tuple(r) for r in scan.select("name", "score").collect()]), i
    with pytest.raises(ValueError):
        M.similar_in_index(spark, path, "one two three", 0.0)


def test_index_filters_reach_the_files(spark, texts, tmp_path):
    path = str(tmp_path / "index")
    M.write_index(texts[1].withColumnRenamed("id", "name"), path)
    plan = M.similar_in_index(spark, path, "some words of a text")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan


def plain_links(rows, threshold):
    sets, classes = {}, {}
    for i, text in rows:
        if own := grams(text):
            classes.setdefault(own, []).append(i)
    heads = {own: min(ids) for own, ids in classes.items()}
    for a, x in heads.items():
        for b, y in heads.items():
            if x < y and len(a & b) / len(a | b) >= threshold:
                sets[x, y] = len(a & b) / len(a | b)
    members = {i: (heads[g], len(classes[g])) if (g := grams(t)) else (i, 1) for i, t in rows}
    return members, sets


def test_near_duplicates_against_all_pairs(texts):
    given, df = texts
    members, links = M.near_duplicates(df)
    want_members, want = plain_links(given, 0.6)
    assert {r.id: (r.class_id, r.copies) for r in members.collect()} == want_members
    got = {(r.class_a, r.class_b): r.jaccard for r in links.collect()}
    assert set(got) <= set(want) and all(abs(want[k] - v) < 1e-12 for k, v in got.items())
    assert len(got) >= 0.99 * len(want) > 50
    degrees = Counter(c for pair in got for c in pair)
    classes = M.near_duplicate_classes(members, links).collect()
    assert {r.id: r.n_links for r in classes} == {i: degrees[c] for i, (c, _) in want_members.items()}


def test_near_duplicates_of_some(texts):
    """Links of a query set: all links with a class of one of its rows, and no others."""
    given, df = texts
    every = {(r.class_a, r.class_b) for r in M.near_duplicates(df)[1].collect()}
    some = {(r.class_a, r.class_b) for r in M.near_duplicates(df, queries=F.col("id") % 10 == 0)[1].collect()}
    classes = {c for i, (c, _) in plain_links(given, 0.6)[0].items() if i % 10 == 0}
    assert some == {p for p in every if classes & set(p)} and some


def test_many_copies_stay_one_class(spark):
    """A third of the rows is one text; its class is one row on both sides of every join."""
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "the same text again and again").otherwise(F.concat(F.lit("text number "), F.col("id").cast("string"))).alias("text"))
    members, links = M.near_duplicates(df)
    assert members.filter("class_id = 0").count() == 1000 and links.count() == 0
    assert M.near_duplicates(df.limit(0))[0].count() == 0 and M.near_duplicates(df.limit(0))[1].count() == 0


def test_an_index_signs_each_text_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    texts = spark.createDataFrame([(i, f"word{i} two three four {i * 7}") for i in range(50)], "name int, text string").repartition(3)
    M.write_index(texts.withColumn("text", counted.asNondeterministic()("text")), str(tmp_path / "index"))
    assert seen.value == 50


def test_near_duplicates_cut_each_text_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    rows = [(i, f"some words of family {i // 5} and the rest of it {'x' * (i % 5)}") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, text string").repartition(3).withColumn("text", counted.asNondeterministic()("text"))
    assert len(M.near_duplicate_classes(*M.near_duplicates(df)).collect()) == 60
    assert seen.value == 60


def test_large_buckets_give_the_same_links(texts, monkeypatch):
    """Buckets of more than two classes, cut into blocks of three, give each link once, as pairs do; ids may be text."""
    given, df = texts
    named = df.withColumn("name", F.concat(F.lit("d"), F.col("id")))
    monkeypatch.setattr(M, "LARGE", 2)
    monkeypatch.setattr(M, "BLOCK", 3)
    members, links = M.near_duplicates(named, "name")
    heads = {r.class_id for r in members.collect()}
    got = [(r.class_a, r.class_b, r.jaccard) for r in links.collect()]
    assert len({g[:2] for g in got}) == len(got) and heads >= {c for g in got for c in g[:2]}
    # The least id of a class is another one as text; links go between classes all the same.
    by_number = M.near_duplicates(df)
    number = {r.id: r.class_id for r in by_number[0].collect()}
    assert {tuple(sorted((number[int(a[1:])], number[int(b[1:])]))): round(s, 9) for a, b, s in got} == {
        (r.class_a, r.class_b): round(r.jaccard, 9) for r in by_number[1].collect()
    }
    assert len(got) >= 0.99 * len(plain_links(given, 0.6)[1]) > 50
    asked = M.near_duplicates(df, queries=F.col("id") % 10 == 0)[1].count()
    monkeypatch.undo()
    assert asked == M.near_duplicates(df, queries=F.col("id") % 10 == 0)[1].count() > 0


def test_ids_may_repeat_or_be_missing(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "A b, c d"), (2, "x y z"), (None, "q r s"), (3, None), (None, "")]
    members, links = M.near_duplicates(spark.createDataFrame(rows, "id int, text string"))
    got = Counter((r.id, r.class_id, r.copies) for r in members.collect())
    assert got == Counter([(1, 1, 3), (1, 1, 3), (None, 1, 3), (2, 2, 1), (None, None, 1), (3, 3, 1), (None, None, 1)])
    assert links.count() == 0


def test_sets_of_a_place():
    rng = np.random.default_rng(5)
    own = [np.sort(rng.choice(90, rng.integers(1, 60), replace=False)) for _ in range(40)]
    own += [np.append(s[1:], 1000 + i) for i, s in enumerate(own[:20])]
    groups = [np.sort(rng.choice(6, rng.integers(0, 3), replace=False)) for _ in own]
    size, n_groups = (np.array([len(s) for s in x]) for x in (own, groups))
    left, right = np.arange(0, 30), np.arange(20, 60)
    before = sets.common_before(np.concatenate(groups), n_groups, 4, left, right)
    assert before.tolist() == [[any(g < 4 for g in set(groups[a]) & set(groups[b])) for b in right] for a in left]
    allowed = rng.random((30, 40)) < 0.7
    a, b, score = sets.similar_pairs(np.concatenate(own), size, allowed, left, right, 0.5, columns=64, pairs=7)
    true = {(x, y): len(set(own[x]) & set(own[y])) / len(set(own[x]) | set(own[y])) for i, x in enumerate(left) for j, y in enumerate(right) if allowed[i, j]}
    assert dict(zip(zip(a.tolist(), b.tolist()), score.tolist())) == {(int(x), int(y)): s for (x, y), s in true.items() if s >= 0.5}  # noqa: B905
    assert len(a) > 10
