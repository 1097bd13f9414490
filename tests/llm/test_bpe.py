import hashlib
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from answerscope.llm import bpe

PATH, PATTERN = bpe.vocabulary()
RANKS = bpe.read_ranks(PATH)
ORACLE = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER, MACHINE = bpe.codec(PATH, PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aeht ring=-_ 01\n\té日🎉", max_size=80))
def test_encodes_and_decodes_like_the_library(text):
    ids = list(ENCODER.encode(text))
    assert ids == ORACLE.encode_ordinary(text)
    assert MACHINE.decode(ids) == text


@pytest.mark.parametrize("text", ["", "a" * 5000, " " * 3000, "=" * 700 + "\n" * 300, "<|endoftext|>", "ab" * 4000, "日本語" * 500])
def test_runs_and_specials(text):
    assert list(ENCODER.encode(text)) == ORACLE.encode_ordinary(text)


def test_full_table_of_states_starts_anew():
    small = bpe.Transducer(RANKS, max_states=20)
    rng = random.Random(1)
    for _ in range(300):
        word = "".join(rng.choice("theringaouszk") for _ in range(rng.randint(1, 14)))
        assert small.encode(word.encode()) == ORACLE.encode_ordinary(word)


def test_tokens_come_out_before_the_end():
    machine = bpe.Transducer(RANKS)
    state, out = machine.start, []
    for byte in b"internationalization" * 20:
        emitted, state = machine.move(state, byte)
        out += emitted
    assert len(out) > 20  # emitted while reading; only a bounded rest is due at the end
    assert out + list(state[-1]) == ORACLE.encode_ordinary("internationalization" * 20)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=30), st.lists(st.integers(1, 5), max_size=10))
def test_streaming_utf8_equals_decoding_at_once(data, cuts):
    pieces, at = [], 0
    for c in cuts:
        pieces.append(data[at : at + c])
        at += c
    pieces.append(data[at:])
    machine = bpe.Utf8Machine(dict(enumerate(pieces)))
    assert machine.decode(range(len(pieces))) == data.decode("utf-8", "replace")


def test_rows(edge):
    got = bpe.digests(edge, PATH, PATTERN, with_ids=True).collect()
    want = [r.text or "" for r in edge.collect()]
    assert [list(r.token_ids) for r in got] == [ORACLE.encode_ordinary(t) for t in want]
    for r, t in zip(got, want, strict=True):
        ids = ORACLE.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert bpe.digests(edge.limit(0), PATH, PATTERN).count() == 0


def test_round_trip_keeps_other_columns(edge):
    back = bpe.decode(bpe.encode(edge, PATH, PATTERN), PATH)
    assert set(edge.columns) < set(back.columns)
    assert all((r.text or "") == r.decoded for r in back.collect())
