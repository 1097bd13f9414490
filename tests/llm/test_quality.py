import random
import re
from collections import Counter

import pytest

from answerscope.llm import quality
from tests.oracle import compare, connect

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """The base columns, by their definition."""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(grams)
    repeated = {i + s for i, g in enumerate(grams) if counts[g] > 1 for s in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    low = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(line in lines[:i] for i, line in enumerate(lines)), len(repeated), low


def base(row):
    return row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed


def test_base_columns_against_plain(docs_of):
    rng = random.Random(4)
    pieces = ["one", "two ", "three.", "\n", "#", " a b c ", "\t", "é ü", "x|y", "four five six.\n", " ", "日本 "]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randint(0, 120))) for _ in range(300)]
    found = {r.doc_id: base(r) for r in quality.clean_lines(docs_of(list(enumerate(texts)))).collect()}
    assert found == {i: plain(text) for i, text in enumerate(texts)}


GOOD = "This is a sentence of plain prose that ends as sentences do.\n"


@pytest.mark.parametrize(
    ("line", "rule"),
    [
        ("price### of&&& all$$$ things***", "symbols"), ("buy!! it!! now!! today", "marks"), ("WE SHOUT AT YOU ALL DAY", "shouting"),
        ("Home | About | Contact | News", "symbols"), ("Home › About › Contact us here", "navigation"), ("About us", "navigation"), ("Please read our Privacy Policy before you go on.", "boilerplate"),
        ("What is it?", None), ("He said: “go.”", None), ("a sentence without an end is kept", None), ("C# costs 5% more than the others in this long line of text.", None),
    ],
)
def test_rules_of_a_line(line, rule):
    assert quality.failed_rule(line, line.encode().split()) == rule


def test_losing_too_much_rejects(docs_of):
    """Two short lines of navigation don't matter, 120 words of shop talk do; a text below the base rules goes in any case."""
    numbered = "".join(f"Line{i} has{i} some{i} words{i} of{i} its{i} own{i}.\n" for i in range(12))
    some, much = "Home\nAbout us\n", "".join(f"buy{i}!! it{i}!!\n" for i in range(60))
    rows = [(1, numbered), (2, some + numbered), (3, much + numbered), (4, GOOD)]
    found = {r.doc_id: r for r in quality.clean_lines(docs_of(rows)).collect()}
    assert [found[i].kept for i in (1, 2, 3, 4)] == [True, True, False, False]
    assert [found[i].base_failed for i in (1, 2, 3, 4)] == [False, False, False, True]
    assert found[2].clean_text == numbered and found[3].clean_text == numbered and found[3].lines_marks == 60 and found[2].lost_words == 3
    assert sorted(r.doc_id for r in quality.good_documents(docs_of(rows)).collect()) == [1, 2]


def test_edge_rows(edge):
    found = quality.clean_lines(edge).collect()
    assert len(found) == edge.count()
    assert sorted(map(base, found)) == sorted(plain(r.text or "") for r in edge.collect())
    assert quality.clean_lines(edge.limit(0)).count() == 0


def test_oracle_and_labels(session):
    """The SQL gives the same rows; documents labelled good stay, documents labelled poor go."""
    folder = "/root/testdata/sf0.01"
    ok, note = compare(session, connect(folder), "op13_line_rules", quality.op13_line_rules, quality.ORACLE, folder)
    assert ok, note
    labels = session.read.parquet(f"{folder}/labels.parquet")
    got = quality.op13_line_rules(session, folder).join(labels, "doc_id").where("NOT base_failed").groupBy("quality", "kept").count().collect()
    counts = {(r.quality, r.kept): r["count"] for r in got}
    assert counts.get((1, False), 0) == 0 and counts.get((0, True), 0) == 0 and counts[1, True] > 100
