"""Byte-level BPE encoding and decoding (operator 4).

The merge ranks are compiled into a finite-state transducer that is determinised while it runs. A state
holds the hypotheses about the token that is being read: for every place where a token may have begun, the
tokens before it that are not emitted yet, the last token before it and the bytes read since. A token may
follow another only if merging the bytes of both by rank gives back the two. Exactly one hypothesis ends at
each byte; the tokens on which all hypotheses agree are emitted, so the transducer looks ahead no further than
the longest token. Transitions are kept once computed, in a table of bounded size that starts anew when full.

Decoding runs an incremental UTF-8 machine over the tokens: its state is the unfinished character, its moves
(state, token) -> (text, state) are kept likewise.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import os
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, prepare, table, text_or_empty

#: Bounds of the tables that grow while running; a full table is emptied, which costs time only.
MAX_STATES, MAX_PIECES, MAX_MOVES = 300_000, 300_000, 100_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id from a file of lines `base64 rank`."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Merges:
    """What the ranks say about tokens: how a token was merged and which tokens can stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        # Every beginning of a token, as one object each: states hold many references to them.
        self.begun: dict[bytes, bytes] = {}
        for t in ranks:
            for i in range(1, len(t) + 1):
                self.begun.setdefault(t[:i], t[:i])
        self._spines: dict[tuple[bytes, int], list[tuple[bytes, float]]] = {}
        self._valid: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.known: dict[tuple[bytes, bytes], bool] = {}

    def merge(self, data: bytes) -> tuple[list[bytes], tuple[bytes, bytes] | None]:
        """The plain procedure: again and again merge the leftmost pair of lowest rank. Also the last pair merged."""
        parts, last = [data[i : i + 1] for i in range(len(data))], None
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            last = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, last

    def halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The pair whose merge makes the token; None for a single byte."""
        if token not in self._valid:
            parts, last = self.merge(token)
            self._valid[token] = last if len(parts) == 1 else (b"", b"")
        return self._valid[token]

    def reachable(self, token: bytes) -> bool:
        return self.halves(token) != (b"", b"")

    def spine(self, token: bytes, side: int) -> list[tuple[bytes, float]]:
        """The token, its half on that side, that half's half ..., each with the rank at which it is merged into the one before."""
        key = (token, side)
        if key not in self._spines:
            out, until = [], float("inf")
            while True:
                out.append((token, until))
                pair = self.halves(token)
                if pair is None:
                    break
                token, until = pair[side], self.ranks[token]
            self._spines[key] = out
        return self._spines[key]

    def fits(self, a: bytes, b: bytes) -> bool:
        """Whether merging the bytes of a and b gives a and b again; an empty a stands for the beginning.

        It doesn't when, along the border, parts of both that are there at the same time merge before either is merged
        into its own token. Of equal ranks the left one goes first.
        """
        if len(self.known) >= MAX_STATES // 3:
            self.known.clear()
        self.known[(a, b)] = stand = self.reachable(b) and (not a or self._apart(a, b))
        return stand

    def _apart(self, a: bytes, b: bytes) -> bool:
        ranks, right = self.ranks, self.spine(b, 0)
        for x, x_until in self.spine(a, 1):
            for y, y_until in right:
                across = ranks.get(x + y)
                if across is not None and across < x_until and across <= y_until and ranks[x] < y_until and ranks[y] <= x_until:
                    return False
        return True


class Transducer:
    """Bytes of a piece of text -> token ids."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.merges, self.ids, self.max_states = Merges(ranks), ranks, max_states
        self.reset()

    def reset(self) -> None:
        """Empties the table of states."""
        # A state is a dict byte -> (emitted ids, next state); -1 holds the ids that are due at the end, -2 the hypotheses,
        # flat: tokens that are not emitted yet, the last token before, the bytes read since.
        self.states: dict[tuple, dict] = {}
        self.start = self.state(((), b"", b""))

    def state(self, hypotheses: tuple) -> dict:
        found = self.states.get(hypotheses)
        if found is None:
            due = hypotheses[-3]  # the hypothesis that is complete comes last
            found = self.states[hypotheses] = {-1: tuple([self.ids[t] for t in due]) if due else (), -2: hypotheses}
        return found

    def move(self, state: dict, byte: int) -> tuple[tuple[int, ...], dict]:
        """Computes and keeps the transition of a state on a byte."""
        merges, ranks, last_byte, hypotheses = self.merges, self.ids, bytes((byte,)), state[-2]
        begun, known = merges.begun, merges.known
        # Hypotheses stay in the order of the place where their token began.
        alive: list = []
        complete = None
        for i in range(0, len(hypotheses), 3):
            out, before = hypotheses[i], hypotheses[i + 1]
            read = begun.get(hypotheses[i + 2] + last_byte)
            if read is not None:
                alive += (out, before, read)
                if complete is None and read in ranks:
                    fits = known.get((before, read))
                    if merges.fits(before, read) if fits is None else fits:
                        complete = ((*out, read), read, b"")
        alive += complete
        agreed = alive[0]
        for out in alive[3::3]:
            if agreed and out[: len(agreed)] != agreed:
                agreed = os.path.commonprefix((agreed, out))
        if agreed:
            k = len(agreed)
            alive[::3] = [out[k:] for out in alive[::3]]
        done = (tuple([ranks[t] for t in agreed]) if agreed else (), self.state(tuple(alive)))
        state[byte] = done
        return done

    def encode(self, data: bytes) -> list[int]:
        if len(self.states) > self.max_states:
            self.reset()
            gc.unfreeze()
            gc.collect()  # states refer to each other in circles
        state, ids = self.start, []
        for byte in data:
            moved = state.get(byte)
            emitted, state = moved if moved is not None else self.move(state, byte)
            if emitted:
                ids += emitted
        ids += state[-1]
        return ids


class Encoder:
    """Text -> token ids: each match of the pattern goes through the transducer by itself."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_states: int = MAX_STATES, max_pieces: int = MAX_PIECES):
        self.transducer, self.pieces, self.max_pieces = Transducer(ranks, max_states), {}, max_pieces
        self.split = regex.compile(pattern).findall

    def encode(self, text: str) -> array:
        """Ids as unsigned 32-bit integers. Short pieces are remembered; they recur often."""
        ids, pieces, run = array("I"), self.pieces, self.transducer.encode
        for piece in self.split(text):
            known = pieces.get(piece)
            if known is None:
                known = run(piece.encode("utf-8", "surrogatepass"))
                if len(piece) <= 32:
                    if len(pieces) >= self.max_pieces:
                        pieces.clear()
                    pieces[piece] = known = tuple(known)
            ids.extend(known)
        return ids


class Utf8Machine:
    """Incremental decoding: feed tokens, get the text that is complete so far; malformed bytes become U+FFFD.

    The state is the bytes of an unfinished character (at most three).
    """

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.moves: dict[bytes, dict[int, tuple[str, bytes]]] = {}
        self.kept = 0

    @staticmethod
    def expected(lead: int) -> int:
        """Continuation bytes after a lead byte; -1 if it can't begin a character."""
        if lead < 0x80:
            return 0
        if 0xC2 <= lead <= 0xDF:
            return 1
        if 0xE0 <= lead <= 0xEF:
            return 2
        return 3 if 0xF0 <= lead <= 0xF4 else -1

    @staticmethod
    def continues(read: bytes, byte: int) -> bool:
        """Whether the byte may follow the bytes read of a character; the second byte has narrower bounds after some leads."""
        if len(read) == 1:
            low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(read[0], (0x80, 0xBF))
            return low <= byte <= high
        return 0x80 <= byte <= 0xBF

    def read(self, state: bytes, data: bytes) -> tuple[str, bytes]:
        out: list[str] = []
        for byte in data:
            if state and self.continues(state, byte):
                state += bytes((byte,))
                if len(state) == self.expected(state[0]) + 1:
                    out.append(state.decode())
                    state = b""
                continue
            if state:
                out.append("�")
                state = b""
            n = self.expected(byte)
            if n == 0:
                out.append(chr(byte))
            elif n < 0:
                out.append("�")
            else:
                state = bytes((byte,))
        return "".join(out), state

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Pieces of text as tokens come in; what is unfinished at the end becomes U+FFFD."""
        state, moves = b"", self.moves.setdefault(b"", {})
        for token in ids:
            moved = moves.get(token)
            if moved is None:
                moved = self.read(state, self.tokens[token])
                if self.kept >= MAX_MOVES:
                    self.moves, self.kept = {b"": {}}, 0
                    moves = self.moves.setdefault(state, {})
                moves[token], self.kept = moved, self.kept + 1
            piece, after = moved
            if after != state:
                state, moves = after, self.moves.setdefault(after, {})
            if piece:
                yield piece
        if state:
            yield "�"

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.stream(ids))


_LOADED: dict[tuple, tuple[Encoder, Utf8Machine]] = {}


def codec(path: str, pattern: str, tables: tuple[int, int] = (MAX_STATES, MAX_PIECES)) -> tuple[Encoder, Utf8Machine]:
    """Encoder and decoder of a rank file, made once per Python process. `tables` bounds the states and the pieces that are remembered."""
    key = (path, pattern, tables)
    if key not in _LOADED:
        ranks = read_ranks(path)
        _LOADED[key] = (Encoder(ranks, pattern, *tables), Utf8Machine({i: t for t, i in ranks.items()}))
    return _LOADED[key]


def forget(path: str, pattern: str, tables: tuple[int, int]) -> None:
    """Drops an encoder and decoder from this Python process."""
    _LOADED.pop((path, pattern, tables), None)
    gc.unfreeze()
    gc.collect()  # states refer to each other in circles


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """Adds `ids`, the token ids of each whole text (NULL counts as empty: no ids). Other columns stay as they are.

    `path` must be a file that every executor has (installed with the tokenizers). No shuffle; a row depends on itself only.
    """
    def run(s):
        encoder, _ = codec(path, pattern)
        return pa.array([np.frombuffer(encoder.encode(t), np.uint32).astype(np.int64) for t in s.to_pylist()], pa.list_(pa.int64()))

    return docs.withColumn(ids, F.arrow_udf(run, "array<bigint>")(text_or_empty(text)))


def decode(tokens: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """Adds `text`, decoded by the streaming machine (NULL or empty ids: empty). An id outside the vocabulary raises KeyError."""

    def run(s):
        _, machine = codec(path, "")
        return pa.array([machine.decode(x or ()) for x in s.to_pylist()], pa.string())

    return tokens.withColumn(text, F.arrow_udf(run, "string")(F.col(ids)))


def digests(
    docs: DataFrame, path: str, pattern: str, with_ids: bool = False, tables: tuple[int, int] = (MAX_STATES, MAX_PIECES), keep: bool = True
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and token_ids) per row; NULL text counts as empty, repeated rows give repeated results.

    Smaller `tables` save memory (about 1 kB a state, 0.2 kB a piece) and cost time. Without `keep` a task drops them at its end and the
    next one starts anew: Spark hands out its workers in turn, more than there are tasks at once where a stage before needed them.

    Encoding, decoding and hashing of a text happen in one visit, so that the ids of long texts aren't moved unless asked for.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["token_ids"] * with_ids

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, machine = codec(path, pattern, tables)
        pa.default_memory_pool().release_unused()  # what earlier tasks of this worker left
        for batch in batches(rows, 4 << 20):
            gc.freeze()  # the tables are large and live on; the collector need not visit them again and again
            counts, id_hashes, text_hashes, all_ids = [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = encoder.encode(text)
                counts.append(len(ids))
                id_hashes.append(hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest())
                text_hashes.append(hashlib.sha256(machine.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
                if with_ids:
                    all_ids.append(np.asarray(ids, np.int32))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_hashes), pa.array(text_hashes)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(all_ids, pa.list_(pa.int32()))] * with_ids, names=names)
        if not keep:
            del encoder, machine
            forget(path, pattern, tables)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, schema)


def vocabulary() -> tuple[str, str]:
    """Path and pattern of the installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(prepare(spark), sf_dir, "documents"), *vocabulary())
