import hashlib
import re

from answerscope.llm import secrets

HARD = [
    'password: token: abcdefgh', "API_KEY = 'abcDEF123'", "secret=abc", "AKIA" + "A" * 15, "AKIA" + "B" * 16, "f" * 24 + "g" + "0" * 23, "ſecret=abcdefg", "toKen:=abcdefgh",
    "é" * 5 + ' "passwd":  "hunter2!"', "token=secret=abcdefg", "AKIAAKIA" + "C" * 16, "0123456789abcdef" * 3 + "Z", "password=\nabcdefg", "", None,
]


def plain(text):
    text, assign = text or "", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(assign, text, re.IGNORECASE | re.ASCII) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def base(found):
    listed = found.select("doc_id", secrets.listed(found["findings"], secrets.BASE).alias("x"))
    return {r.doc_id: r.x for r in listed.collect()}


def test_base_spans(docs_of):
    _, found = secrets.scan_versions(docs_of(list(enumerate(HARD))))
    assert base(found) == {i: plain(t) for i, t in enumerate(HARD)}
    assert base(found)[0] == "" and base(found)[6] == ""


def test_ledger_scans_only_what_it_lacks(docs_of, session):
    first, _ = secrets.scan_versions(docs_of([(1, "token=abcdef1"), (2, "token=abcdef1"), (3, "clean")]))
    assert first.count() == 2  # two blobs
    both = docs_of([(1, "token=abcdef1"), (4, "secret=zzzzzz9"), (5, "clean")])
    second, found = secrets.scan_versions(both, first)
    assert second.count() == 1  # one unseen blob
    assert base(found) == {1: "assign:0:13", 4: "assign:0:14", 5: ""}
    # A new version of one rule scans every blob again, for that rule alone.
    newer = (secrets.Rule("hex", 2, "[0-9a-f]{4,}"), *[r for r in secrets.RULES if r.kind != "hex"])
    third, found = secrets.scan_versions(both, first.unionByName(second), newer)
    assert third.count() == 3 and {tuple(r.rules) for r in third.collect()} == {("hex@2",)}
    assert base(found)[1] == "assign:0:13,hex:6:13"
    again, _ = secrets.scan_versions(both, first.unionByName(second).unionByName(third), newer)
    assert again.count() == 0


def test_edge_rows(edge):
    fresh, found = secrets.scan_versions(edge)
    assert found.count() == edge.count() and "text" not in found.columns
    assert fresh.count() == 8
    long = next(r.text for r in edge.collect() if r.doc_id == 6)
    assert [r.x for r in found.filter("doc_id = 7").select(secrets.listed(found["findings"], secrets.BASE).alias("x")).collect()] == [plain(long)] * 2
    fresh, found = secrets.scan_versions(edge.limit(0))
    assert fresh.count() == found.count() == 0


def test_query_digest(session):
    from answerscope.llm.common import table

    got = {r.doc_id: r for r in secrets.op2_blob_ledger(session, "/root/testdata/sf0.001").collect()}
    for r in table(session, "/root/testdata/sf0.001", "documents").collect():
        assert got[r.doc_id].base_sha256 == hashlib.sha256(plain(r.text).encode()).hexdigest()


def test_web_tokens_in_linear_time():
    """Broken tokens one after the other, 4 MB of them, and a whole one at the end."""
    import time

    find = next(r for r in secrets.RULES if r.kind == "web_token").spans()
    for piece in ("-eyJ", "eyJaaaaaaaa.", ".eyJaaaaaaaaaaa"):
        text = piece * (4_000_000 // len(piece)) + " eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeKKF2QT4"
        began = time.time()
        assert find(text)[-1][1] == len(text) and time.time() - began < 20
