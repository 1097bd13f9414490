import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from answerscope.llm import periodic
from answerscope.llm.words import numbered

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def period_of(words):
    return next(q for q in range(1, len(words) + 1) if all(words[i] == words[i + q] for i in range(len(words) - q)))


def plain_runs(words, least=6, exponent=4):
    """Every maximal stretch with period q, for all q; kept if q is its smallest period."""
    found, n = [], len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q) and period_of(words[i : j + q]) == q:
                found.append((i, j - i + q, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def changed(doc_id, words):
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def plain(doc_id, text):
    words = changed(doc_id, WORD.findall(text or ""))
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    of_best = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *of_best, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(kept)


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def query(session, monkeypatch, frame):
    monkeypatch.setattr(periodic, "table", lambda *_: frame)
    return sorted((tuple(r) for r in periodic.op12_run_detection(session, "").select(*COLUMNS).collect()), key=str)


def drawn(seed, n):
    """Texts over few words with planted repetitions."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 6)):
            piece = [rng.choice("abc") for _ in range(rng.randint(1, 7))]
            words += piece * rng.choice([1, 1, 2, 4, 6]) + piece[: rng.randint(0, len(piece))]
        out.append(words)
    return out


@pytest.mark.parametrize(("least", "exponent"), [(6, 4), (2, 2), (4, 3), (9, 2)])
def test_runs_against_every_stretch(least, exponent):
    for seed in range(4):
        texts = drawn(seed, 80)
        classes, starts = numbered([[w.encode() for w in words] for words in texts])
        found = [[] for _ in texts]
        for start, length, period in periodic.runs_of(classes, least, exponent):
            k = int(np.searchsorted(starts, start, "right")) - 1
            found[k].append((start - int(starts[k]), length, period))
        assert found == [plain_runs(words, least, exponent) for words in texts]


def test_fibonacci_words_and_one_word():
    """Words with as many repetitions as there can be, and runs that touch both ends."""
    a, b = "a", "ab"
    while len(b) < 400:
        a, b = b, b + a
    for words in (list(b), ["x"] * 300, ["x"] * 5, ["x"] * 6, list("ab") * 100, list("aab") * 50 + list("ab") * 30):
        classes, _ = numbered([[w.encode() for w in words]])
        assert periodic.runs_of(classes, 2, 2) == plain_runs(words, 2, 2)
        assert periodic.runs_of(classes) == plain_runs(words)


def test_query_against_plain(session, monkeypatch, docs_of):
    rows = [(i, rng) for i, rng in enumerate(" ".join(w) for w in drawn(11, 300))]
    rows += [(10**12, "a " * 40), (-5, "b c " * 9), (3, "x\ny\x0bz \t" * 8)]
    assert query(session, monkeypatch, docs_of(rows)) == sorted((plain(*r) for r in rows), key=str)


def test_edge_rows(edge, session, monkeypatch):
    """The two long texts, of 60 000 words of six kinds, are too long for the plain version; they give a row each."""
    assert len(query(session, monkeypatch, edge)) == edge.count()
    short = edge.where("n_chars IS NULL OR n_chars < 1000")
    assert query(session, monkeypatch, short) == sorted((plain(r.doc_id, r.text) for r in short.collect()), key=str)
    assert query(session, monkeypatch, edge.limit(0)) == []


def test_long_texts_take_near_linear_time():
    """A text of one word, and one that repeats a long stretch, 200 000 words each."""
    rng = random.Random(2)
    piece = [b"%d" % rng.randint(0, 50) for _ in range(20_000)]
    for words, want in (([b"x"] * 200_000, [(0, 200_000, 1)]), (piece * 10, [(0, 200_000, 20_000)])):
        began = time.time()
        classes, _ = numbered([words])
        found = periodic.runs_of(classes)
        assert [r for r in found if r[1] > 1000] == want and time.time() - began < 30


def test_ordered_sets_keep_their_order(monkeypatch):
    monkeypatch.setattr(periodic, "BLOCK", 3)
    rng = random.Random(1)
    places = rng.sample(range(1000), 200)
    held = periodic.Positions(places[0])
    for k, place in enumerate(places[1:], 1):
        before = sorted(places[:k])
        below = max((x for x in before if x < place), default=None)
        above = min((x for x in before if x > place), default=None)
        assert held.put(place) == (below, above)
    assert list(held) == sorted(places) and held.size == 200


def test_parameters_are_checked(docs_of):
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs_of([]), exponent=1)
