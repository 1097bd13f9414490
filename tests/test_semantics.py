"""Small literal cases with values worked out by hand."""

from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from answerscope.functions import ordering as O
from answerscope.functions import scalars as S
from answerscope.functions.asof import as_of_join
from answerscope.operators import anomaly, audit, citations, cost, crawlers, extract, privacy, recommend, registry, runs, similarity, site, visibility
from answerscope.sources import logs

T0 = datetime(2026, 5, 1)
DICT = [(1, "Pinecone", None, True, 0), (1, "Qdrant", None, False, 1), (1, "Weaviate", None, False, 2), (1, "Chroma", None, False, 3)]
DICT_SCHEMA = "project_id int, entity string, variant string, is_brand boolean, ordinal int"


def answers(spark, *texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "project_id int, run_id int, text string")


def dictionary(spark, rows=DICT):
    return spark.createDataFrame(rows, DICT_SCHEMA)


def mentions(spark, text, rows=DICT):
    found = extract.extract_mentions(answers(spark, text), dictionary(spark, rows)).orderBy("rank").collect()
    return [(r["entity"], r["char_offset"], r["rank"], r["matched_text"], r["sentiment_label"], r["sentiment_score"]) for r in found]


# --- anomalies ---------------------------------------------------------------------------------

SERIES = [
    ([2.0] * 5, []),
    ([2.0] * 8 + [None], ["rank_disappeared"]),
    ([2.0] * 7 + [3.0], []),
    ([2.0] * 7 + [8.0], ["constant_window_shift"]),
    ([2.0, 3.0, 2.0, 4.0, 3.0, 2.0, 3.0, 4.0], []),
    ([2.0, 3.0, 2.0, 3.0, 2.0, 3.0, 2.0, 20.0], ["zscore"]),
    ([None] * 7 + [3.0], ["first_appearance"]),
    ([None, 2.0] * 4 + [None], []),
]


def samples(spark, *series):
    rows = [(f"p{s}", T0 + timedelta(days=i), s * 1000 + i, v) for s, vals in enumerate(series) for i, v in enumerate(vals)]
    return spark.createDataFrame(rows, "provider string, observed_at timestamp, run_id int, rank double")


@pytest.mark.parametrize("block", [8, 4096])
def test_rank_verdicts(spark, block):
    found = anomaly.visibility_anomalies(samples(spark, *[s for s, _ in SERIES]), 7, 2.5, ["provider"], block).orderBy("provider", "observed_at").collect()
    got = {}
    for r in found:
        got.setdefault(r["provider"], []).append(r["signal"])
    assert got == {f"p{i}": want for i, (_, want) in enumerate(SERIES) if want}


def test_only_the_provider_that_moved(spark):
    found = anomaly.visibility_anomalies(samples(spark, [2.0] * 8, [8.0] * 7 + [1.0]), 7, 2.5, ["provider"]).collect()
    assert [(r["provider"], r["signal"]) for r in found] == [("p1", "constant_window_shift")]


def test_false_alarm_budget(spark):
    import random

    rnd = random.Random(7)
    year = [float(min(max(round(rnd.gauss(3, 0.7)), 1), 6)) for _ in range(365)]
    assert anomaly.visibility_anomalies(samples(spark, year), 14, 2.5, ["provider"]).count() <= 12


def _novel(spark, days, block=4096):
    rows = [("openai", T0 + timedelta(days=i), i) for i in range(len(days))]
    cites = [(i, d) for i, ds in enumerate(days) for d in ds]
    got = anomaly.citation_novelty(
        spark.createDataFrame(rows, "provider string, observed_at timestamp, run_id int"), spark.createDataFrame(cites or [(-1, "x")], "run_id int, domain string"),
        7, 2, ["provider"], block,
    )
    return [(r["domain"], r["frequency"]) for r in got.orderBy("observed_at", "domain").collect()]


def test_novel_domains(spark):
    known = [["docs.example.com"] * 2] * 7
    assert _novel(spark, known + [["new.io"] * 3 + ["docs.example.com"]]) == [("new.io", 3)]
    assert _novel(spark, known + [["rare.io"]]) == []
    assert _novel(spark, known + [["docs.example.com"] * 4], block=7) == []
    assert _novel(spark, known + [["zeta.io", "alpha.io", "mu.io"] * 2]) == [("alpha.io", 2), ("mu.io", 2), ("zeta.io", 2)]


def test_volatility(spark):
    cases = {"absent": [None] * 3, "one": [2.0], "flat": [2.0] * 4, "swing": [1.0, 10.0, 1.0, 10.0], "spike": [1.0] * 9 + [1000.0], "wide": [1.0, 100.0], "half": [2.0, None, 3.0, None]}
    rows = [(k, v) for k, vs in cases.items() for v in vs]
    got = {r["k"]: r for r in visibility.coefficient_of_variation(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert got["absent"]["value"] is None and got["absent"]["samples"] == 3
    assert got["one"]["value"] == 0.0 and got["flat"]["value"] == 0.0
    assert got["swing"]["value"] > 0.5 and got["spike"]["value"] == 1.0 and 0.9 < got["wide"]["value"] < 1
    assert got["half"]["presence_ratio"] == 0.5


# --- extraction --------------------------------------------------------------------------------


def test_mentions_rank_and_tone(spark):
    text = "For search, qdrant is fast and reliable. Others like Pinecone. " + "x " * 200 + "Weaviate is slow, limited and buggy."
    assert mentions(spark, text) == [
        ("Qdrant", 12, 1, "qdrant", "positive", 80), ("Pinecone", 53, 2, "Pinecone", "positive", 80), ("Weaviate", 463, 3, "Weaviate", "negative", 10),
    ]


def test_offsets_are_bytes(spark):
    assert mentions(spark, "日本語 Pinecone と Qdrant")[:2] == [("Pinecone", 10, 1, "Pinecone", "neutral", 50), ("Qdrant", 23, 2, "Qdrant", "neutral", 50)]


def test_longest_name_wins_at_one_place_and_inside_words(spark):
    rows = [(1, "Acme", "Acme Inc.", True, 0), (1, "Bolt", None, False, 1)]
    assert [m[:4] for m in mentions(spark, "Thunderbolts by acme inc. today", rows)] == [("Bolt", 7, 1, "bolt"), ("Acme", 16, 2, "acme inc.")]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["Qdrant", "Weaviate", "Chroma"]), max_size=7, unique=True), st.integers(0, 7), st.booleans())
def test_brand_rank_property(spark, rivals, place, present):
    names = list(rivals)
    if present:
        names.insert(min(place, len(names)), "Pinecone")
    found = mentions(spark, " ".join(f"{n} is a vector database." for n in names))
    ranks = {m[0]: m[2] for m in found}
    assert ranks == {n: i + 1 for i, n in enumerate(names)}


def test_citations_from_text(spark, rows):
    text = "See https://docs.acme.com/a, (https://Docs.Acme.com/a) http://x.org:8080/p?q=1. and acme.com, acme.com; jane.doe@corp.com https://bad.org:99999/x v1.2"
    got = rows(extract.extract_citations(answers(spark, text)), "domain", "url", "frequency", "source_type")
    assert got == [
        ("acme.com", None, 2, "general_web"), ("corp.com", None, 1, "general_web"), ("docs.acme.com", "https://Docs.Acme.com/a", 1, "docs"),
        ("docs.acme.com", "https://docs.acme.com/a", 1, "docs"), ("jane.doe", None, 1, "general_web"), ("x.org", "http://x.org:8080/p?q=1", 1, "general_web"),
    ]
    no_mail = rows(extract.extract_citations(answers(spark, text), emails=False), "domain")
    assert ("corp.com",) not in no_mail and ("jane.doe",) not in no_mail


def test_source_types(spark):
    cases = [("old.reddit.com", "/", "reddit"), ("en.wikipedia.org", "/", "wikipedia"), ("m.youtube.com", "/", "youtube"), ("notyoutube.com", "/", "general_web"),
             ("youtu.be", "/", "youtube"), ("docs.x.io", "/", "docs"), ("x.io", "/docs/a", "docs"), ("x.readthedocs.io", "/", "docs"), ("x.io", "/", "general_web")]
    df = spark.createDataFrame(cases, "d string, p string, want string")
    assert df.filter(S.source_type(F.col("d"), F.col("p")) != F.col("want")).count() == 0


def test_claims(spark, rows):
    got = rows(extract.extract_claims(answers(spark, "Hi there.  Pinecone is ok! Qdrant too\nété pinecone"), dictionary(spark)), "claim_text", "char_offset")
    assert got == [("Pinecone is ok!", 11), ("été pinecone", 38)]


def test_answer_text_shapes(spark):
    cases = [
        ('" plain "', "plain"), ('{"choices":[{"message":{"content":"a"}}]}', "a"), ('{"choices":[{"message":{"content":[{"text":"a"},{"text":" "},{"text":"b"}]}}]}', "a\nb"),
        ('{"text":"t"}', "t"), ('{"content":[{"type":"text","text":"x"},{"type":"tool","text":"y"}]}', "x"),
        ('{"candidates":[{"content":{"parts":[{"text":"g"},{"text":"h"}]}}]}', "g\nh"), ('{"error":"nope"}', None), ('{"text":5}', None), ("not json", None),
    ]
    df = spark.createDataFrame(cases, "raw string, want string")
    assert df.filter(~extract.answer_text(F.col("raw")).eqNullSafe(F.col("want"))).count() == 0


def test_registered_extractor(spark):
    extract.register_extractor("upper", lambda a, d: a.select("project_id", "run_id", F.upper("text").alias("entity")))
    try:
        got = extract.run_extractors(answers(spark, "Qdrant"), dictionary(spark))
        assert {(r["extractor"], r["entity"]) for r in got.collect()} == {("builtin", "Qdrant"), ("upper", "QDRANT")}
    finally:
        extract._EXTRACTORS.clear()


# --- pages -------------------------------------------------------------------------------------

STRONG = (
    '<html><head><title>What is it? | Acme</title><link rel="canonical" href="https://acme.com/a"><meta property="og:site_name" content="Acme">'
    '<script type="application/ld+json">{}</script></head><body><h1>What is it?</h1><p>The answer is here.</p><h2>More</h2><p>According to '
    '<a href="https://other.org/study#x">a study</a></p></body></html>'
)


def test_audit_scores(spark):
    pages = spark.createDataFrame([("https://acme.com/a", STRONG), ("https://acme.com/b", "<title>Acme</title><p>Buy now.</p>")], "url string, html string")
    got = audit.audit_pages(pages)
    score = {r["url"]: r["page_score"] for r in got.select("url", "page_score").distinct().collect()}
    assert score["https://acme.com/a"] == 90 and score["https://acme.com/b"] < 50
    assert {r["category"] for r in got.filter("url like '%b' and status <> 'pass'").collect()} == {"identity", "extractability", "corroboration"}
    with_policy = audit.audit_pages(pages, llms_txt=True).filter("url like '%a'").first()
    assert with_policy["page_score"] == 100
    assert audit.audit_gate(got, ["high"]).filter("url like '%a'").count() == 0


def test_links(spark, rows):
    html = """<a href="/x/../y?q#f"><a HREF='rel/é'><a href=//cdn.org/p><a href="mailto:a@b.c"><a href="https://ACME.com:443/z"><a href="#top"><a href="style.CSS">"""
    page = spark.createDataFrame([("https://acme.com/d/p?k=1", html)], "url string, html string")
    assert rows(audit.page_links(page), "kind", "link") == [
        ("outbound", "https://cdn.org/p"), ("owned", "https://acme.com/d/p?k=1"), ("owned", "https://acme.com/d/rel/%C3%A9"), ("owned", "https://acme.com/y?q"), ("owned", "https://acme.com/z"),
    ]


def test_clean_text(spark):
    df = spark.createDataFrame([("a<b>c</b> > d&nbsp;&amp; <unclosed tail", "a c d &")], "html string, want string")
    assert df.select((S.clean_text(F.col("html")) == F.col("want")).alias("ok")).first()["ok"]


def test_sitemap(spark, rows):
    xml = spark.createDataFrame([("<urlset><LOC> https://b.org/2 </LOC><loc>https://a.org/1</loc><loc>https://a.org/1</loc></urlset>",)], "xml string")
    assert rows(audit.sitemap_locs(xml)) == [("https://a.org/1",), ("https://b.org/2",)]
    assert rows(audit.sitemap_locs(xml, F.lit("https://a.org/"), 1)) == [("https://a.org/1",)]


# --- logs and addresses ------------------------------------------------------------------------


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_access_log(spark):
    df = logs.read_access_log(
        lines(spark, '203.0.113.9 - - [31/May/2026:09:00:00 +0200] "GET /docs HTTP/1.1" 200 42 "-" "GPTBot/1.0"', 'x [bad] "GET" nope', "no quotes"), "f", "2026-01-01 00:00:00"
    )
    a, b = df.orderBy(F.col("status").desc()).collect()
    assert (a["path"], a["status"], a["ts"], a["user_agent"]) == ("/docs", 200, datetime(2026, 5, 31, 7), "GPTBot/1.0")
    assert (b["path"], b["status"], b["ts"], b["user_agent"]) == ("/", 0, datetime(2026, 1, 1), "")
    assert df.select(S.bot_id(F.col("user_agent"))).filter("1=1").collect()[0][0] in ("openai-gptbot", None)


def test_custom_log(spark):
    row = logs.read_custom_log(lines(spark, "evt-1 2026-05-31T09:00:00Z 203.0.113.9 /pricing 500 NL ClaudeBot", "too short"), "{id} {ts} {ip} {path} {status} {region} {ua}", "c", T0).collect()
    assert len(row) == 1 and row[0]["raw_event_id"] == "evt-1" and row[0]["status"] == 500 and row[0]["region"] == "NL"


def test_json_aliases(spark, rows):
    df = lines(
        spark, '{"ray_id":"r1","timestamp":"2026-05-31T09:00:00Z","user_agent":"u","path":"/a","status":404,"client_ip":"1.2.3.4","country":"NL"}',
        '{"id":"i2","ts":1780218000000000,"UserAgent":"u","Path":"/b","status":"404"}', '{"ts":true,"timestamp":"2026-05-31T09:00:00Z","user_agent":"u","path":"/c"}',
        '{"ts":"yesterday","user_agent":"u","path":"/d"}', '{"ts":1,"user_agent":"u"}', "not json",
    )
    got = rows(logs.read_cdn_json(df, "cdn"), "raw_event_id", "path", "status", "ts")
    assert got == [("i2", "/b", 0, datetime(2026, 5, 31, 9)), ("r1", "/a", 404, datetime(2026, 5, 31, 9))]
    assert logs.read_ga4_json(lines(spark, '{"event_id":"e","event_timestamp":5,"ua":"u","page_location":"/x"}')).first()["status"] == 200


def test_address_checks(spark):
    ranges = spark.createDataFrame([("b", "203.0.113.0/24"), ("b", "2001:db8::/33"), ("c", "10.0.0.0/8")], "bot_id string, cidr string")
    cases = [("b", "203.0.113.7", True), ("b", "198.51.100.7", False), ("b", "2001:db8:7fff::1", True), ("b", "2001:db8:8000::1", False), ("c", "203.0.113.7", False),
             ("c", "::ffff:10.0.0.1", False), ("b", "bad", False), ("z", "10.0.0.1", False), ("c", None, False)]
    df = spark.createDataFrame(cases, "bot_id string, client_ip string, want boolean")
    got = crawlers.verify_ips(df, ranges)
    assert got.count() == len(cases) and got.filter("ip_verified <> want").count() == 0


def test_one_address_column(spark):
    df = spark.createDataFrame([("1.2.3.4",), (" ",)], "client_ip string")
    for mode, want in (("raw", ("1.2.3.4", None)), ("truncated", (None, "1.2.3.0"))):
        r = S.store_ip(df, mode, "s").first()
        assert (r["client_ip"], r["client_ip_truncated"]) == want and r["client_ip_hash"] is None
    assert S.store_ip(df, "hashed", "s").filter("client_ip_hash IS NULL").count() == 1
    with pytest.raises(ValueError):
        S.store_ip(df, "open")


# --- site --------------------------------------------------------------------------------------


def test_frozen_days_keep_their_numbers(spark, rows):
    day = [("page_view", f"s{i}", datetime(2026, 5, 1, 10, i)) for i in range(3)]
    schema = "event_type string, session_id string, ts timestamp"
    first = site.event_rollup(spark.createDataFrame(day, schema), None, "2026-05-02 01:00:00")
    again = site.event_rollup(spark.createDataFrame(day[:1], schema), first, "2026-05-02 02:00:00")
    assert rows(again, "event_count", "unique_sessions", "finalized") == [(3, 3, True)]


def test_calendar_window(spark):
    days = spark.createDataFrame([((T0 - timedelta(days=i)).date(),) for i in range(9)], "day date")
    assert S.calendar_window(days, T0, 7).count() == 7 and S.calendar_window(days, T0, 30).count() == 9


def test_funnel(spark):
    counts = spark.createDataFrame([("contribute_start", 10), ("contribute_step", 4), ("contribute_complete", 6)], "event_type string, count long")
    assert [r["drop_off_pct"] for r in site.funnel(counts).orderBy("step").collect()] == [None, 60.0, None]


def test_paths_and_referrers(spark):
    cases = [("https://x.com/a?t=1#z", "/a"), ("https://x.com", "/"), ("//x.com/p", "/p"), ("//x.com", "(other)"), ("word", "(other)"), ("a\x00b", "(other)"), ("  ", None), ("/" + "é" * 200, "/" + "é" * 127)]
    df = spark.createDataFrame(cases, "raw string, want string")
    assert df.filter(~S.site_path(F.col("raw"), 256).eqNullSafe(F.col("want"))).count() == 0
    refs = [("https://News.Y.com:80/x?y", "news.y.com"), ("jane@corp.com", "(other)"), ("localhost", "(other)"), ("", None)]
    df = spark.createDataFrame(refs, "raw string, want string")
    assert df.filter(~S.referrer_at_ingest(F.col("raw")).eqNullSafe(F.col("want"))).count() == 0


# --- names, texts, prices ----------------------------------------------------------------------


def test_names(spark):
    cases = [("Аpple", "apple", 100), ("Acme", "Acmes", 90), ("Acme, Co", "Acme. Co", 90), ("A.c.m.e", "Acme", 85), ("Acme", "Acme Group", 70), ("Acme", "Other", 0), ("...", "Zeta", 70)]
    df = spark.createDataFrame(cases, "a string, b string, want int")
    assert df.filter(S.name_similarity(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_dedup_links_match_brute_force(spark):
    names = ["Acme", "ACME", "Acmes", "Acme Group", "A.c.m.e.", "Zeta", "Zet", "Beta", "...", "Acme Grp", "Omega Labs", "Omega-Labs", "Omega - Labs!"]
    ents = spark.createDataFrame([(f"d{i:02}", n) for i, n in enumerate(names)], "domain string, display_name string")
    links = {(r["domain_a"], r["domain_b"]): r["score"] for r in similarity.dedup_links(ents).collect()}
    pairs = ents.alias("a").join(ents.alias("b"), F.col("a.domain") < F.col("b.domain")).select(
        F.col("a.domain").alias("x"), F.col("b.domain").alias("y"), S.name_similarity(F.col("a.display_name"), F.col("b.display_name")).alias("s")
    )
    truth = {(r["x"], r["y"]): r["s"] for r in pairs.collect()}
    assert all(truth[k] == s for k, s in links.items())

    # Groups are linked through representatives; the connected sets must be those of all pairs.
    def groups(edges):
        parent = {f"d{i:02}": f"d{i:02}" for i in range(len(names))}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            parent[root(a)] = root(b)
        return sorted(sorted(x for x in parent if root(x) == r) for r in {root(x) for x in parent})

    for low in (90, 60):
        assert groups(k for k, s in links.items() if s >= low) == groups(k for k, s in truth.items() if s >= low)


def test_similarity(spark):
    a, b = "best food for dog owners today", "best food for dog owners now"
    df = spark.createDataFrame([("same", a), ("near", b), ("far", "how to bake sourdough bread at home"), ("none", "!!")], "name string, text string")
    exact = {r["name"]: r["score"] for r in similarity.similar_to(df, a, 0.0, exact=True).collect()}
    assert exact["same"] == 1.0 and exact["near"] == pytest.approx(3 / 5) and exact["far"] == 0.0
    est = {r["name"]: r["score"] for r in similarity.similar_to(df, a, 0.3).collect()}
    assert est["same"] == 1.0 and abs(est["near"] - 0.6) < 0.2 and "far" not in est and "none" not in est


def test_cadences(spark):
    cases = [("hourly", 24.0), ("Daily", 1.0), ("weekly", 1 / 7), ("every 15 minutes", 96.0), ("every 6 hours", 4.0), ("*/7 * * * *", 216.0), ("0 */6 * * *", 4.0), ("0 9 * * 1", 1 / 7), ("0 9 1 * *", None), ("every 0 hours", None)]
    df = spark.createDataFrame(cases, "e string, want double")
    assert df.filter(~S.ticks_per_day(F.col("e")).eqNullSafe(F.col("want"))).count() == 0


def test_previous_row_across_chunks(spark):
    rows = [(k, i, i * 7 % 5) for k in (1, 2) for i in (0, 1, 2, 9, 10, 25, 26, 40)]
    df = spark.createDataFrame(rows, "k int, at int, v int")
    got = O.with_previous(df, ["k"], ["at"], {"was": "v", "then": "at"}, F.floor(F.col("at") / 10)).orderBy("k", "at").collect()
    want = [(k, i, v, *((rows[n - 1][2], rows[n - 1][1]) if n % 8 else (None, None))) for n, (k, i, v) in enumerate(rows)]
    assert [(r.k, r["at"], r.v, r.was, r.then) for r in got] == want


def test_no_org_sees_no_rows(spark):
    runs_ = spark.createDataFrame([(1, "o"), (2, None)], "run_id int, org_id string")
    assert S.org_scope(runs_, None).count() == 0 and S.org_scope(runs_, "o").count() == 1


def test_sql_functions_agree(spark):
    S.register_sql_functions(spark)
    df = spark.createDataFrame([("openai", "GPTBot", "https://www.X.com./a"), ("zz", "none", "y.org/b"), (None, "ClaudeBot", " http://www.Аpple.com.. ")], "p string, ua string, u string")
    same = df.select(F.expr("run_cost_usd(p)").eqNullSafe(S.run_cost(F.col("p"))) & F.expr("bot_identity(ua)").eqNullSafe(S.bot_id(F.col("ua"))) & (F.expr("plain_domain(u)") == S.normalize_domain(F.col("u"))))
    assert all(r[0] for r in same.collect())


def test_hmac(spark):
    import hashlib
    import hmac

    for key in (b"k", b"x" * 100):
        got = spark.createDataFrame([("p1",)], "p string").select(privacy.hmac_sha256(F.col("p"), key)).first()[0]
        assert got == hmac.new(key, b"p1", hashlib.sha256).hexdigest()


def test_report_windows():
    assert [runs.parse_since(x) for x in ("5s", "2m", "1h", "7d")] == [5, 120, 3600, 604800]
    with pytest.raises(ValueError):
        runs.parse_since("7w")


# --- graph and heatmap seed --------------------------------------------------------------------


def test_graph_and_heatmap_seed(spark, rows):
    prompts = spark.createDataFrame([(1, 1, "vector-db")], "prompt_id int, project_id int, name string")
    rs = spark.createDataFrame([(1, 1, "openai", "m", T0, "ok"), (2, 1, "anthropic", "m", T0, "ok")], "run_id int, prompt_id int, provider string, model string, started_at timestamp, status string")
    ms = spark.createDataFrame([(1, "acme", 2)], "run_id int, entity string, rank int")
    cs = spark.createDataFrame([(1, "docs.acme.com", 1, "docs"), (1, "arxiv.org", 1, "paper"), (1, "arxiv.org", 1, "paper"), (2, "docs.acme.com", 1, "docs")], "run_id int, domain string, frequency int, source_type string")
    edges, nodes = citations.citation_graph(rs, prompts, cs, T0, 7)
    assert rows(edges, "source", "target", "weight") == [("anthropic", "docs.acme.com", 1), ("openai", "arxiv.org", 2), ("openai", "docs.acme.com", 1)]
    assert nodes.count() == 4
    assert rows(visibility.heatmap(rs, prompts, ms, "acme", T0, 7), "provider_identity", "presence_rate", "avg_rank") == [("anthropic", 0.0, None), ("openai", 1.0, 2.0)]
    assert visibility.heatmap(rs, prompts, ms, "acme", T0, 7, max_runs=1).count() == 1


# --- recommendations ---------------------------------------------------------------------------

STATES = ["generated", "surfaced", "acknowledged", "acted", "measured", "dismissed", "stale"]


def test_every_transition(spark):
    rows = [(f"{a}>{b}", i, T0 + timedelta(hours=i), s) for a in STATES for b in STATES for i, s in enumerate((a, b))]
    bad = recommend.illegal_transitions(spark.createDataFrame(rows, "rec_id string, event_id int, changed_at timestamp, state string"))
    from answerscope.functions.constants import LIFECYCLE_EDGES

    want = {f"{a}>{b}" for a in STATES for b in STATES if a != b and (a, b) not in LIFECYCLE_EDGES}
    assert {r["rec_id"] for r in bad.collect()} == want


def test_all_rules_fire_and_repeat(spark):
    rank = "array<struct<provider:string,mean_rank:double,cited:boolean>>"
    facts = spark.createDataFrame(
        [(1, 7, "vector db", 6, 4.5, [("anthropic", None, False), ("openai", 2.0, True)], [("Rival", 1.5)], False, ["docs.rival.com"], ["r1"], False, ["c1"], False)],
        f"project_id int, prompt_id int, prompt string, n_runs int, brand_mean_rank double, provider_ranks {rank}, competitor_ranks array<struct<competitor:string,mean_rank:double>>, own_docs_cited boolean, "
        "competitor_docs array<string>, run_ids array<string>, run_ids_truncated boolean, citation_ids array<string>, citation_ids_truncated boolean",
    )
    config = spark.createDataFrame([(1, "docs.acme.com", ["openai", "anthropic", "gemini"], True)], "project_id int, docs_domain string, enabled_providers array<string>, opted_in boolean")
    drift = spark.createDataFrame([(1, d, c) for d, c in (("a", "gained"), ("b", "gained"), ("c", "gained"), ("x", "dropped"), ("y", "dropped"), ("k", "kept"))], "project_id int, domain string, change string")
    gate = spark.createDataFrame([(1, True)], "project_id int, gate boolean")
    bench = spark.createDataFrame([(1, "databases", 9.0, 5.0, 0.25, False, ["best db"])], "project_id int, category string, brand_rank double, p75 double, in_graph double, local_has_prompts boolean, suggested array<string>")
    p50 = spark.createDataFrame([(1, 0.4)], "project_id int, p50 double")
    make = lambda: recommend.envelope(recommend.recommend(facts, config, drift, gate, bench, p50), "1", "14d", T0)
    one = {r["kind"]: r for r in make().collect()}
    assert sorted(one) == sorted(recommend.KINDS)
    assert {k: r["rec_id"] + r["input_fingerprint"] for k, r in one.items()} == {r["kind"]: r["rec_id"] + r["input_fingerprint"] for r in make().collect()}
    assert '"dropped_domains":["x","y"]' in one["citation_domain_drift"]["payload"] and '"gained_domains":["a","b","c"]' in one["citation_domain_drift"]["payload"]
    assert "gemini" in one["provider_blindspot"]["summary"] and "anthropic" in one["provider_blindspot"]["payload"]


def test_registered_trend(spark):
    series = spark.createDataFrame([("a", 1.0)], "k string, value double")
    recommend.register_trend("demo", "jump", lambda s: s.select("k", F.col("value").alias("score")))
    try:
        builtin = series.select("k", F.col("value").alias("score"), F.lit("response_change").alias("trend_kind"))
        assert {r["trend_kind"] for r in recommend.run_trends(series, builtin).collect()} == {"response_change", "plugin:demo:jump"}
    finally:
        recommend._TRENDS.clear()


# --- skew-safe helpers against the plain forms -------------------------------------------------


def skewed(spark):
    # One key holds most rows.
    return spark.range(3000).select(
        F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("k"), F.col("id").alias("i"),
        F.timestamp_seconds(F.lit(1700000000) + F.pmod(F.xxhash64("id"), F.lit(400000))).alias("at"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5000))).alias("v"),
    )


def test_number_rows(spark):
    from pyspark.sql import Window

    df = O.number_rows(skewed(spark), ["k"], ["at", "i"], F.date_trunc("hour", F.col("at")))
    plain = F.row_number().over(Window.partitionBy("k").orderBy("at", "i"))
    assert df.withColumn("want", plain).filter("pos <> want").count() == 0 and df.count() == 3000


def test_percentiles(spark, rows):
    got = O.exact_percentiles(skewed(spark), ["k"], "v", {"a": 0.5, "b": 0.95}, band=100.0).orderBy("k").collect()
    want = skewed(spark).groupBy("k").agg(F.percentile("v", F.lit(0.5)).alias("a"), F.percentile("v", F.lit(0.95)).alias("b")).orderBy("k").collect()
    assert [(r["k"], round(r["a"], 6), round(r["b"], 6)) for r in got] == [(r["k"], round(r["a"], 6), round(r["b"], 6)) for r in want]


def test_rank_by_total(spark):
    from pyspark.sql import Window

    df = skewed(spark).select("i", (F.col("v") * 1000).alias("v"))
    assert O.rank_by_total(df, "v").withColumn("want", F.rank().over(Window.orderBy(F.col("v").desc()))).filter("rank <> want").count() == 0


@pytest.mark.parametrize("strict", [False, True])
def test_as_of_join(spark, strict):
    left = skewed(spark).select("k", "i", "at")
    right = skewed(spark).filter("i % 3 = 0").select("k", F.col("at").alias("t"), F.col("i").alias("j"))
    got = {r["i"]: r["j"] for r in as_of_join(left, right, ["k"], "at", "t", ["j"], ["j"], strict=strict).collect()}
    by_key = {}
    for r in right.collect():
        by_key.setdefault(r["k"], []).append((r["t"], r["j"]))
    for r in left.collect():
        cand = [x for x in by_key.get(r["k"], []) if (x[0] < r["at"] if strict else x[0] <= r["at"])]
        assert got[r["i"]] == (max(cand)[1] if cand else None)
    assert len(got) == 3000


def test_blocks_do_not_change_verdicts(spark):
    s = skewed(spark).select(F.col("k").alias("provider"), F.col("at").alias("observed_at"), F.col("i").alias("run_id"), F.when(F.col("v") % 3 > 0, F.col("v") % 9).cast("double").alias("rank"))
    small, big = (anomaly.visibility_anomalies(s, 14, 2.0, ["provider"], block=b).select("run_id", "signal") for b in (20, 100000))
    assert small.exceptAll(big).count() == 0 and big.exceptAll(small).count() == 0 and big.count() > 0


def test_claim_window(spark):
    claims = spark.createDataFrame([(1, 1, "a", T0), (2, 1, "a", T0 + timedelta(days=40)), (3, 1, "b", T0)], "claim_id int, project_id int, entity string, created_at timestamp")
    facts = spark.createDataFrame([(1, "a", T0 - timedelta(days=1), T0 + timedelta(days=2)), (1, "a", T0, None), (1, "a", None, T0)], "project_id int, entity string, valid_from timestamp, valid_to timestamp")
    assert {r["claim_id"]: r["facts_in_force"] for r in registry.facts_at(claims, facts).collect()} == {1: 2, 2: 1, 3: 0}


def test_gap_report(spark, rows):
    sched = spark.createDataFrame([(1, "every 6 hours", 5, T0)], "schedule_id int, cadence string, debounce_minutes int, created_at timestamp")
    ticks = spark.createDataFrame([(1, T0 + timedelta(hours=6), "claimed", T0 + timedelta(hours=6), None), (1, T0 + timedelta(hours=18), "done", T0 + timedelta(hours=18), T0 + timedelta(hours=19))],
                                  "schedule_id int, tick_ts timestamp, status string, claimed_at timestamp, completed_at timestamp")
    manual = spark.createDataFrame([(1, T0 + timedelta(hours=17, minutes=57))], "schedule_id int, run_at timestamp")
    missed, debounced, orphaned = cost.tick_gaps(sched, ticks, manual, T0 + timedelta(days=1))
    assert rows(missed, "slot_ts") == [(T0 + timedelta(hours=12),), (T0 + timedelta(days=1),)]
    assert rows(debounced, "tick_ts") == [(T0 + timedelta(hours=18),)]
    assert rows(orphaned, "tick_ts") == [(T0 + timedelta(hours=6),)]
