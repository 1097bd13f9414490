import random

import pytest

from answerscope.llm import lines as L
from answerscope.llm.common import table


def plain(rows, least=L.LEAST_WORDS):
    seen, out = {}, []
    for place, (doc_id, text) in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))):
        runs = [None]
        for a, b, n, unit in L.units(text or ""):
            if unit not in seen:
                seen[unit] = doc_id
                runs.append(None)
            elif runs[-1] is None:
                runs[-1] = [a, b, n, 1, seen[unit]]
            else:
                runs[-1][1:4] = [b, runs[-1][2] + n, runs[-1][3] + 1]
        out += [(str(doc_id), *r) for r in runs if r and r[2] >= least]
    return sorted(out, key=str)


def found(frame):
    return sorted(((str(r.doc_id), r.start, r.end, r.n_words, r.n_units, r.first_doc_id) for r in frame.collect()), key=str)


def test_sample_against_one_pass(session):
    docs = table(session, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    assert found(L.repeats(docs)) == plain([tuple(r) for r in docs.collect()])
    assert L.op3_line_hashing(session, "/root/testdata/sf0.001").count() == L.repeats(docs).count()


def test_passage_inside_lines_goes_and_the_rest_stays(docs_of):
    passage = " ".join(f"Sentence number {i} of the quoted passage says something." for i in range(8))
    rows = [(1, f"First host begins here {passage} and then ends."), (2, f"Another one\nwith text {passage}\nMore text of its own."), (3, "Nothing at all repeated here. Yes. No.")]
    got = {r.doc_id: r for r in L.deduplicated(docs_of(rows)).collect()}
    assert got[1].text == rows[0][1] and got[1].removed is None and got[3].text == rows[2][1]
    assert "number 4" not in got[2].text and got[2].text.startswith("Another one\nwith text") and got[2].text.endswith("More text of its own.")
    (span,) = got[2].removed
    assert span.first_doc_id == 1 and rows[1][1][span.start : span.end].strip().startswith("Sentence number 1")


def test_short_phrases_stay(docs_of):
    rows = [(i, f"Yes it is so. Number {i} differs from all others in this sentence. No it is not.") for i in range(20)]
    assert L.repeats(docs_of(rows)).count() == 0


def test_paragraph_units(docs_of):
    a, b = " ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}" for i in range(30))
    got = found(L.repeats(docs_of([(2, f"{b}\n\nown\n\n{a}"), (1, f"{a}\n\n{b.upper()}")]), paragraphs=True))
    assert [(d, n, f) for d, _, _, n, _, f in got] == [("2", 30, 1), ("2", 30, 1)]


@pytest.mark.parametrize("text", ["", "...", "a", "a.b.c", "One two three four. " * 3, "\n\nx\n", "no end"])
def test_units_are_in_order_and_apart(text):
    at = 0
    for a, b, n, own in L.units(text):
        assert at <= a < b <= len(text) and n == len(own.split()) and L.normal(text[a:b]) == own
        at = b


def test_edge_rows(edge):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    got = found(L.repeats(edge.select("doc_id", "text")))
    assert got == plain(rows)
    out = L.deduplicated(edge)
    assert out.count() == edge.count() and set(out.columns) == set(edge.columns)
    assert L.repeats(edge.select("doc_id", "text").limit(0)).count() == 0 and L.deduplicated(edge.limit(0)).count() == 0


@pytest.mark.parametrize("stops", [(), (27,), (3, 30), (12, 26, 40), range(2, 51, 3)])
def test_passages_of_51_words_go_wherever_they_are_pasted(stops):
    """Glued to words of either host, with few or no sentence ends, some whole units of a passage are left in each."""
    rng = random.Random(5)
    for n in range(200):
        passage = " ".join(f"w{rng.randrange(400)}" + "." * (i in stops) for i in range(51))
        hosts = [" ".join(f"{side}{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 40))) for side in "abcd"]
        rows = [(1, f"{hosts[0]} {passage} {hosts[1]}"), (2, f"{hosts[2]} {passage} {hosts[3]}")]
        spans = plain(rows)
        assert spans and all(rows[1][1].index(passage) <= s[1] < s[2] <= rows[1][1].index(passage) + len(passage) + 1 for s in spans), n


def test_passage_without_sentence_ends(docs_of):
    passage = " ".join(f"word{i}" for i in range(54))
    rows = [(1, f"one host {passage} ends"), (2, f"some other host starts like this {passage} and goes on")]
    (span,) = L.repeats(docs_of(rows)).collect()
    assert span.doc_id == 2 and span.n_words >= L.LEAST_WORDS and rows[1][1][span.start : span.end] in passage + " "
