"""Mentions against a plain search of every name, the shared pattern, and work that doesn't grow with the names."""

import ipaddress
import random
import re
import time

from answerscope.operators import crawlers, extract


def plain(text, entries):
    """First hit per entity by offset; ties to the longest spelling; ranks by offset, brand, order, name."""
    low, found = text.lower(), {}
    for entity, variant, brand, ordinal in entries:
        for name in {entity, variant} - {None, ""}:
            at = low.find(name.lower())
            if at >= 0:
                key = (at, -len(name.encode()), name)
                found.setdefault((entity, brand), [key, ordinal])
                found[entity, brand] = [min(key, found[entity, brand][0]), min(ordinal, found[entity, brand][1])]
    for (entity, brand), value in found.items():
        value[1] = min(o for e, _, b, o in entries if (e, b) == (entity, brand))
    order = sorted(found, key=lambda k: (found[k][0][0], not k[1], found[k][1], k[0]))
    return [(entity, brand, len(low[: found[entity, brand][0][0]].encode()), rank) for rank, (entity, brand) in enumerate(order, 1)]


def test_pattern_gives_the_longest_name_of_each_place():
    rng = random.Random(2)
    for _ in range(200):
        names = {"".join(rng.choice("ab.(é") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 12))}
        text = "".join(rng.choice("ab.(é x") for _ in range(60))
        found = [m.group(1) for m in re.finditer(extract.names_pattern(names), text)]
        starts = [[n for n in names if text.startswith(n, i)] for i in range(len(text))]
        assert found == [max(hits, key=len) for hits in starts if hits]
    assert extract.names_pattern([]) is None


def test_mentions_against_plain_search(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcO.+") for _ in range(rng.randint(1, 4)))
    schema = "project_id int, entity string, variant string, is_brand boolean, ordinal int"
    dictionary = {p: [(word(), rng.choice([None, "", word()]), rng.random() < 0.3, rng.randrange(5)) for _ in range(25)] for p in range(3)}
    texts = [(rng.randrange(4), i, rng.choice([" ", "é", ""]).join(word() for _ in range(rng.randint(0, 12)))) for i in range(150)] + [(1, 1000, None), (1, 1001, "")]
    frame = spark.createDataFrame([(p, *e) for p, es in dictionary.items() for e in es], schema)
    got = {}
    for r in extract.match_entities(spark.createDataFrame(texts, "project_id int, run_id int, text string"), frame).orderBy("run_id", "rank").collect():
        got.setdefault(r.run_id, []).append((r.entity, r.is_brand, r.char_offset, r["rank"]))
    want = {i: hits for p, i, t in texts if (hits := plain(t or "", dictionary.get(p, [])))}
    assert got == want


def test_work_does_not_grow_with_the_names(spark):
    """100 names against 10 000, each in the same texts, at most twice the time."""
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    name = lambda: "".join(rng.choice(letters) for _ in range(9))
    names = [name() for _ in range(10_000)]
    texts = [(1, i, " ".join(name() if rng.random() < 0.98 else rng.choice(names[:100]) for _ in range(120))) for i in range(4000)]
    answers = spark.createDataFrame(texts, "project_id int, run_id int, text string").repartition(4).cache()
    answers.count()
    took = {}
    for n in (100, 10_000):
        frame = spark.createDataFrame([(1, x, None, False, i) for i, x in enumerate(names[:n])], "project_id int, entity string, variant string, is_brand boolean, ordinal int").cache()
        frame.count()
        for _ in range(2):
            began = time.time()
            extract.match_entities(answers, frame).write.format("noop").mode("overwrite").save()
            took[n] = time.time() - began
    assert took[10_000] < 2 * took[100] + 1, took


def test_claims_and_citations_need_no_shuffle(spark):
    answers = spark.createDataFrame([(1, 1, "See https://a.org/x. The brand is at b.com, b.com and https://a.org/x!")], "project_id int, run_id int, text string")
    frame = spark.createDataFrame([(1, "brand", None, True, 0)], "project_id int, entity string, variant string, is_brand boolean, ordinal int")
    cited = extract.extract_citations(answers)
    assert sorted((r.domain, r.url or "", r.frequency) for r in cited.collect()) == [("a.org", "https://a.org/x", 1), ("a.org", "https://a.org/x!", 1), ("b.com", "", 2)]
    assert "Exchange" not in cited._jdf.queryExecution().executedPlan().toString()
    claims = extract.extract_claims(answers, frame)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in claims and "Sort" not in claims


def test_starts_of_many_stretches(spark):
    """Offsets of 1000 sentences, over several blocks."""
    text = "".join(f"brand {'é' * (i % 7)}{i}. " for i in range(1000))
    answers = spark.createDataFrame([(1, 1, text)], "project_id int, run_id int, text string")
    frame = spark.createDataFrame([(1, "brand", None, True, 0)], "project_id int, entity string, variant string, is_brand boolean, ordinal int")
    got = sorted(r.char_offset for r in extract.extract_claims(answers, frame).collect())
    data = text.encode()
    assert got == [m.start() for m in re.finditer(b"brand", data)]


def test_addresses_in_many_ranges(spark):
    """Two bots with 300 blocks of all lengths each, both families, against the address library."""
    rng = random.Random(8)
    blocks, hits = [], []
    for bot in "ab":
        for _ in range(300):
            if rng.random() < 0.6:
                net = ipaddress.ip_network((rng.getrandbits(32), rng.choice([7, 8, 13, 22, 24, 29, 31, 32])), strict=False)
            else:
                net = ipaddress.ip_network(((0x20010DB8 << 96) | rng.getrandbits(96), rng.choice([33, 47, 48, 62, 64, 127, 128])), strict=False)
            blocks.append((bot, net))
            inside = net[rng.randrange(net.num_addresses)]
            hits += [(bot, str(inside)), ("a", str(inside)), (bot, str(inside + rng.choice([-1, 1, 256, 1 << 16])) if 70_000 < int(inside) < (1 << 32) - 70_000 else "no address")]
    hits += [("c", "10.0.0.1"), ("a", None), (None, "10.0.0.1")]
    ranges = spark.createDataFrame([(b, str(n)) for b, n in blocks] + [("a", "bad/99")], "bot_id string, cidr string")
    df = spark.createDataFrame([(i, b, ip) for i, (b, ip) in enumerate(hits)], "i int, bot_id string, client_ip string")
    got = {r.i: r.ip_verified for r in crawlers.verify_ips(df, ranges).collect()}

    def verified(bot, ip):
        try:
            address = ipaddress.ip_address(ip)
        except ValueError:
            return False
        return any(b == bot and n.version == address.version and address in n for b, n in blocks)

    assert got == {i: verified(b, ip) for i, (b, ip) in enumerate(hits)}
