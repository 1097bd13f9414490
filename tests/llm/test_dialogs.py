import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from answerscope.llm import dialogs

WORD = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if way == 0:
            continue
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        out += [(conv, turn, "user" if way == 4 else role, text)] * (2 if way == 3 else 1)
    return out


def cheapest(rows):
    """Dijkstra over (rows used, state) with whole audits; rows are (role, text, must go, truncated)."""
    heap, done = [(0, "", 0, "", ())], {}
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    while heap:
        cost, audit, i, state, kept = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done[i, state] = True
        if i == len(rows) and state in ("", "a"):
            return cost, audit, kept
        for role in ("user", "assistant"):
            if (state, role[0]) in step:
                heapq.heappush(heap, (cost + 2, audit + "I", i, step[state, role[0]], (*kept, f"{role}:")))
        if i < len(rows):
            role, text, gone, truncated = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, kept))
            if not gone:
                if (state, role[:1]) in step:
                    heapq.heappush(heap, (cost + truncated, audit + "K", i + 1, step[state, role[:1]], (*kept, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if (state, new[0]) in step:
                        heapq.heappush(heap, (cost + 2 + truncated, audit + "R", i + 1, step[state, new[0]], (*kept, f"{new}:{text}")))


def plain(rows, hurt=damaged):
    out = {}
    after = hurt(rows)
    for conv in {r[0] for r in rows}:
        sha = lambda t: hashlib.sha256(t.encode()).digest()
        mine = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], sha(r[3])))
        seen, faulty, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in mine:
            letters = WORD.findall(text)
            fault = "blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            faulty.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, kept = cheapest(faulty)
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def query(session, monkeypatch, rows, schema="conv_id long, turn long, role string, text string"):
    frame = session.createDataFrame(rows, schema)
    monkeypatch.setattr(dialogs, "table", lambda *_: frame)
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in dialogs.op11_suffix_dawg(session, "").collect()}


def drawn(seed, conversations, most, roles=("system", "user", "assistant", "user", "assistant", "tool", "usr", "", None)):
    rng = random.Random(seed)
    texts = ["a.", "b", "c!", "", None, " \n", "d?  ", "e ", "f. g", "日本。"]
    rows = []
    for conv in range(conversations):
        turn = 0
        for _ in range(rng.randint(0, most)):
            turn += rng.choice([0, 1, 1, 1, 1, 3])
            rows.append((conv, rng.choice([turn] * 9 + [None]), rng.choice(roles), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_dijkstra(session, monkeypatch, seed):
    rows = drawn(seed, 150, 9) + [(None, None, None, None), (None, 1, "user", "x."), (None, 1, "user", "x."), (10**6, 5, "assistant", "only.")]
    assert query(session, monkeypatch, rows) == plain(rows)


def test_a_conversation_over_many_tasks(session, monkeypatch):
    """One conversation holds most rows; range partitions cut it, and equal signatures end differently."""
    rng = random.Random(5)
    rows = [(7, i, rng.choice(["user", "assistant", "system"]), rng.choice([f"t{i}.", f"t{i}", "again."])) for i in range(400)]
    rows += [(7, 3, "user", "same.")] * 300 + drawn(6, 12, 6)
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    session.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        found = query(session, monkeypatch, rows)
    finally:
        session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        session.conf.set("spark.sql.shuffle.partitions", "4")
    assert found == plain(rows)


def test_all_rows_dropped_and_empty_table(session, monkeypatch):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert query(session, monkeypatch, [(gone, 0, "user", "x.")]) == {gone: (0, 0, 0, 0, 0, 0, "", empty)}
    assert query(session, monkeypatch, []) == {}


def test_other_columns_and_ends_of_turns(session, monkeypatch):
    """Columns with clashing names play no part; the widest turns there are don't overflow."""
    names = "key, part, n, text_row, digest, fresh, cost, audit, state"
    schema = "conv_id long, turn long, role string, text string, " + ", ".join(f"`{n}` string" for n in names.split(", "))
    rows = [(1, -(2**63), "user", "a."), (1, 2**63 - 1, "assistant", "b."), (2, 0, "user", "c."), (2, 1, "assistant", "d.")]
    found = query(session, monkeypatch, [(*r, *["z"] * 9) for r in rows], schema)
    want = plain(rows)
    assert {k: v[1:] for k, v in found.items()} == {k: v[1:] for k, v in want.items()} and found[2] == want[2]


def test_nodes_are_shared_from_the_end(monkeypatch):
    """Signatures that end alike are worked out once: as many nodes as there are different suffixes."""
    made = []
    true = dialogs.Node.__init__
    monkeypatch.setattr(dialogs.Node, "__init__", lambda self, *a: (made.append(1), true(self, *a))[1])
    signatures = sorted(["auau"[::-1], "uau"[::-1], "xuau"[::-1], "uua"[::-1], "ua"[::-1]])
    assert sum(1 for _ in dialogs._suffixes((s, dialogs.END) for s in signatures)) == 5
    suffixes = {s[:i] for s in signatures for i in range(1, len(s) + 1)}
    assert len(made) == len(suffixes)


def test_sample_tables(session):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in session.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in dialogs.op11_suffix_dawg(session, folder).select("conv_id", *[F.col(c) for c in COLUMNS]).collect()}
    assert found == plain(rows)
