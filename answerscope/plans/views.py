"""Product tables derived from the sample tables, once for Spark and once as SQL text.

Both sides state the same arithmetic, so an independent engine can check each query. Every view
covers all rows of its source tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.logs import load_bot_ranges
from ..sources.tables import load_table

AS_OF = "2024-01-31 00:00:00"
OPEN_DAY = "2024-01-30 12:00:00"
BRANDS = ["brand0", "brand1", "brand2", "brand3"]


def pick(i: Column, *values) -> Column:
    """values[i mod n]; None gives NULL."""
    n = len(values)
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i % n).cast("int") + 1)


class Views:
    """Lazy frames over one folder of sample tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return load_table(self.spark, self.folder, name)

    @cached_property
    def prompts(self) -> DataFrame:
        p = F.col("p_partkey")
        return self.table("part").select(
            p.alias("prompt_id"), (p % 3).alias("project_id"), F.concat(F.lit("prompt-"), p.cast("string")).alias("name"),
            F.col("p_name").alias("text"), F.array("p_type", "p_brand").alias("tags"),
        )

    @cached_property
    def projects(self) -> DataFrame:
        return self.prompts.select("project_id").distinct().select(
            "project_id", F.concat(F.lit("project-"), F.col("project_id").cast("string")).alias("name"),
            F.concat(F.lit("org-"), (F.col("project_id") % 2).cast("string")).alias("org_id"),
            F.when(F.col("project_id") == 2, F.lit("2024-01-10").cast("timestamp")).alias("archived_at"),
        )

    @cached_property
    def runs(self) -> DataFrame:
        e = F.col("event_id")
        ts = F.col("ts").cast("timestamp")
        failed = F.col("event_type") == "error"
        return self.table("events").select(
            e.alias("run_id"), F.col("user_id").alias("prompt_id"), pick(e, "openai", "anthropic", "gemini", "openrouter").alias("provider"),
            F.concat(F.lit("vendor/m"), (e % 3).cast("string")).alias("model"), ts.alias("started_at"),
            F.when(e % 11 != 0, F.timestamp_micros(F.unix_micros(ts) + F.round(F.col("value") * 1000).cast("long"))).alias("finished_at"),
            F.when(failed, "failed").otherwise("ok").alias("status"),
            F.when(failed, pick(e, "timeout", "rate_limit", "auth", "network", "parse", "other")).alias("error_kind"),
            ts.alias("created_at"), F.when(F.col("user_id") % 5 < 4, F.concat(F.lit("org-"), (F.col("user_id") % 5).cast("string"))).alias("org_id"),
        )

    @cached_property
    def mentions(self) -> DataFrame:
        p, s = F.col("l_partkey"), F.col("l_suppkey")
        return self.table("lineitem").select(
            F.floor(F.col("l_orderkey") * 2 / 3).cast("long").alias("run_id"), F.concat(F.lit("brand"), (p % 9).cast("string")).alias("entity"),
            F.col("l_linenumber").alias("rank"), (p % 9 == 0).alias("is_brand"),
            pick(s, "positive", "neutral", "negative", None).alias("sentiment_label"),
            pick(s, 80, 50, 20, None).alias("sentiment_score"),
        )

    @cached_property
    def citations(self) -> DataFrame:
        key = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
        domain = F.concat(F.lit("d"), F.col("l_suppkey").cast("string"), F.lit(".example.com"))
        return self.table("lineitem").select(
            F.concat_ws("-", *[F.col(c).cast("string") for c in key]).alias("citation_id"),
            F.floor(F.col("l_orderkey") * 2 / 3).cast("long").alias("run_id"), domain.alias("domain"),
            F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("https://"), domain, F.lit("/p"), (F.col("l_partkey") % 10).cast("string"))).alias("url"),
            F.col("l_quantity").cast("int").alias("frequency"),
            pick(F.col("l_partkey"), "docs", "reddit", "wikipedia", "youtube", "general_web", None).alias("source_type"),
        )

    @cached_property
    def samples(self) -> DataFrame:
        """Rank of brand0 per run, the input of the anomaly detectors."""
        from ..operators.visibility import base_runs, best_rank

        return best_rank(base_runs(self.runs, self.prompts), self.mentions, "brand0").select(
            "project_id", "prompt_id", "provider", "run_id", F.col("started_at").alias("observed_at"), "rank"
        )

    @cached_property
    def pages(self) -> DataFrame:
        return self.table("pages")

    @cached_property
    def event_pages(self) -> DataFrame:
        """Events with the page they touched; 40 events share a page."""
        return self.table("events").withColumn("page_id", F.floor(F.col("event_id") / 40).cast("long")).join(
            self.pages.select("page_id", "url"), "page_id"
        )

    @cached_property
    def site_events(self) -> DataFrame:
        e = F.col("event_id")
        kind = F.col("event_type")
        mapped = (
            F.when(kind == "view", "page_view").when(kind == "click", "contribute_start").when(kind == "signup", "contribute_step")
            .when(kind == "purchase", "contribute_complete").when(e % 3 == 0, "verify_start").when(e % 3 == 1, "verify_complete").otherwise("verify_fail")
        )
        method = pick(e, "dns", "DNS_TXT", "email", "fax")
        return self.event_pages.select(
            e.alias("event_id"), F.when(e % 97 == 0, "unknown_kind").otherwise(mapped).alias("event_type"),
            F.col("user_id").cast("string").alias("session_id"), F.col("url").alias("path"),
            F.when(e % 7 == 0, F.lit("jane@corp.com")).when(e % 7 == 1, F.lit("direct")).otherwise(F.col("url")).alias("referrer"),
            F.concat(F.lit('{"method":"'), method, F.lit('"}')).alias("properties"), F.col("ts").cast("timestamp").alias("ts"),
        )

    @cached_property
    def hits(self) -> DataFrame:
        """Raw crawler hits: ten bots and two browsers, addresses inside and outside the ranges."""
        e = F.col("event_id")
        agent = pick(
            e, "Mozilla/5.0 GPTBot/1.0", "ChatGPT-User/2.0", "OAI-SearchBot/1.0", "ClaudeBot/1.0", "PerplexityBot/1.0", "Google-Extended",
            "Googlebot/2.1", "CCBot/2.0", "Bytespider", "Amazonbot/0.1", "Mozilla/5.0 Firefox", "Mozilla/5.0 Safari",
        )
        head = pick(e, "20.42.", "20.42.", "20.42.", "160.79.", "34.117.", "66.249.", "66.249.")
        ip = F.concat(head, (e % 256).cast("string"), F.lit("."), (F.col("user_id") % 256).cast("string"))
        return self.event_pages.select(
            (F.col("user_id") % 3).alias("project_id"), F.concat(F.lit("evt-"), e.cast("string")).alias("raw_event_id"),
            F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"), agent.alias("user_agent"), F.col("url").alias("path"),
            pick(e, 200, 200, 200, 404, 500).alias("status"), F.lit("file").alias("source_adapter"),
            F.when(e % 5 == 4, F.concat(F.lit("2001:db8:"), F.lower(F.hex(e % 65536)), F.lit("::1"))).otherwise(ip).alias("client_ip"),
            pick(e, "NL", "", None).alias("region"),
        )

    @cached_property
    def crawler_events(self) -> DataFrame:
        from ..operators.crawlers import normalize_hits

        return normalize_hits(self.hits, load_bot_ranges(self.spark), "hashed", "salt")

    @cached_property
    def log_lines(self) -> DataFrame:
        stamp = F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss")
        return self.hits.select(
            F.concat(
                F.col("client_ip"), F.lit(" - - ["), stamp, F.lit(' +0000] "GET '), F.col("path"), F.lit(' HTTP/1.1" '),
                F.col("status").cast("string"), F.lit(' 42 "-" "'), F.col("user_agent"), F.lit('"'),
            ).alias("value")
        )

    @cached_property
    def answers(self) -> DataFrame:
        """All assistant turns, each with a url and a bare host appended."""
        page = self.pages.select(F.col("page_id").alias("conv_id"), "url")
        tail = F.concat(F.lit(" See "), F.col("url"), F.lit(". Also ("), F.lit("https://docs.host"), (F.col("turn") % 5).cast("string"),
                        F.lit(".example.org/docs/a) and host"), (F.col("conv_id") % 7).cast("string"), F.lit(".example.net, the best reliable.\nNot slow"))
        says = self.table("conversations").filter(F.col("role") == "assistant").join(page, "conv_id", "left")
        return says.select(
            (F.col("conv_id") % 3).alias("project_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("run_id"),
            F.concat("text", F.coalesce(tail, F.lit(" no links"))).alias("text"),
        )

    @cached_property
    def dictionary(self) -> DataFrame:
        """Brand `that` (also `the`) and three competitors for each project."""
        entries = F.array(
            *[
                F.struct(F.lit(e).alias("entity"), F.lit(v).alias("variant"), F.lit(b).alias("is_brand"), F.lit(o).alias("ordinal"))
                for e, v, b, o in DICTIONARY
            ]
        )
        return self.projects.select("project_id", F.inline(entries))

    @cached_property
    def responses(self) -> DataFrame:
        """Raw provider responses around the answers: five shapes by run id, some with annotations."""
        r = F.col("run_id")
        text = F.col("text")
        block = F.array(F.struct(F.lit("text").alias("type"), text.alias("text")), F.struct(F.lit("tool").alias("type"), F.lit("skip").alias("text")))
        url = F.concat(F.lit("https://a"), (r % 13).cast("string"), F.lit(".example.org/docs/x,"))
        note = F.array(F.struct(F.struct(url.alias("url")).alias("url_citation")), F.struct(F.struct(F.lit("https://www.reddit.com/r/x").alias("url")).alias("url_citation")))
        chat = F.struct(F.array(F.struct(F.struct(text.alias("content"), note.alias("annotations")).alias("message"))).alias("choices"))
        shapes = [
            F.to_json(chat), F.to_json(F.struct(F.array(F.struct(F.struct(block.alias("content")).alias("message"))).alias("choices"))),
            F.to_json(F.struct(text.alias("text"))), F.to_json(F.struct(block.alias("content"))),
            F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(text.alias("text"))).alias("parts")).alias("content"))).alias("candidates"))),
            F.lit('{"error":"no text here"}'),
        ]
        raw = F.lit(None).cast("string")
        for i, s in enumerate(shapes):
            raw = F.when(r % 6 == i, s).otherwise(raw)
        return self.answers.select("project_id", "run_id", pick(r, *["ok"] * 8, "failed").alias("status"), raw.alias("raw_response"))

    @cached_property
    def audit_pages_in(self) -> DataFrame:
        """Pages with one marker appended by page id, so that every rule both passes and fails."""
        p = F.col("page_id")
        extra = pick(
            p,
            '<a href="https://example.com/ref">Source: study</a>', '<link rel="canonical" href="/c">', '<script type="application/ld+json">{}</script>',
            "<h2>What is it</h2><p>According to us</p>", '<meta name="robots" content="noai"><meta property="og:site_name" content="x">', "<ol><li>x</li></ol>",
        )
        return self.pages.select("page_id", "url", F.concat("html", extra).alias("html"))

    @cached_property
    def entities(self) -> DataFrame:
        s = F.col("s_suppkey")
        name = (
            F.when(s % 7 == 1, F.upper("s_name")).when(s % 7 == 2, F.concat("s_name", F.lit("!")))
            .when(s % 7 == 3, F.concat("s_name", F.lit(" Inc"))).when(s % 7 == 4, F.replace("s_name", F.lit("e"), F.lit("е"))).otherwise(F.col("s_name"))
        )
        return self.table("supplier").select(
            F.concat(F.lit("d"), s.cast("string"), F.lit(".example.com")).alias("domain"), name.alias("display_name"),
            pick(s, "verified", "unclaimed", "revoked", "pending").alias("claim_status"),
            pick(s, "dns_txt", "email_magic_link", None).alias("verification_method"),
            F.timestamp_seconds(F.lit(1704067200) + s * 3600).alias("created_at"),
            F.when(s % 4 == 0, F.timestamp_seconds(F.lit(1704067200) + s * 3600)).alias("verified_at"),
            F.when(s % 4 == 2, F.timestamp_seconds(F.lit(1704067200) + s * 7200)).alias("grace_period_start"),
        )

    @cached_property
    def dup_entities(self) -> DataFrame:
        """Each supplier twice: as it is, and under a look-alike, punctuated or longer name."""
        base = self.table("supplier").select("s_suppkey", "s_name")
        plain = base.select(F.concat(F.lit("a"), F.col("s_suppkey").cast("string")).alias("domain"), F.col("s_name").alias("display_name"))
        s = F.col("s_suppkey")
        other = (
            F.when(s % 4 == 0, F.upper("s_name")).when(s % 4 == 1, F.concat("s_name", F.lit(" !!"))).when(s % 4 == 2, F.concat("s_name", F.lit(" Group")))
            .otherwise(F.concat(F.replace("s_name", F.lit("e"), F.lit("е")), F.lit("x")))
        )
        return plain.unionByName(base.select(F.concat(F.lit("b"), s.cast("string")).alias("domain"), other.alias("display_name")))

    @cached_property
    def consent(self) -> DataFrame:
        o = F.col("o_orderkey")
        return self.table("orders").select(
            o.alias("consent_id"), (F.col("o_custkey") % 50).alias("project_id"), pick(o, "benchmark", "named").alias("tier"),
            F.when(F.col("o_orderstatus") == "F", "optout").otherwise("optin").alias("event"), pick(o, "v2", "v2", "v2", "v1").alias("terms_version"),
            F.timestamp_seconds(F.lit(1704067200) + (o * 7919) % 2592000).alias("created_at"),
        )

    @cached_property
    def observed(self) -> DataFrame:
        """Runs as the benchmark sees them."""
        r = F.col("run_id")
        slug = F.when(r % 10 == 0, F.concat(F.lit("Prompt "), F.col("prompt_id").cast("string"))).otherwise(F.concat(F.lit("prompt-"), F.col("prompt_id").cast("string")))
        return self.runs.select(
            "run_id", (F.col("prompt_id") % 50).alias("project_id"), slug.alias("prompt_slug"), "provider", "model",
            F.col("started_at").alias("observed_at"), (r % 7).alias("observed_rank"), F.array(F.lit("a.com"), F.lit("b.com")).alias("citation_domains"),
            pick(r, "v2", "v2", "v1").alias("terms"), (r % 3 < 2).alias("contribute"),
        )

    @cached_property
    def contributions(self) -> DataFrame:
        o = F.col("o_orderkey")
        return self.table("orders").select(
            o.alias("contribution_id"), (F.col("o_custkey") % 40).alias("project_id"),
            F.when(o % 9 < 8, F.concat(F.lit("d"), (F.col("o_custkey") % 100).cast("string"), F.lit(".example.com"))).alias("entity_domain"),
            F.concat(F.lit("d"), (o % 60).cast("string"), F.lit(".example.com")).alias("domain"), F.col("o_orderpriority").alias("category"),
            pick(o, "openai", "anthropic", "gemini").alias("provider"), pick(o, 30, 7).alias("window_days"), (o % 20).alias("run_count"),
            (F.col("o_orderstatus") != "F").alias("opted_in"), (o % 4 > 0).alias("verified"),
            F.when(o % 17 == 0, F.col("o_orderdate").cast("timestamp")).alias("revoked_at"), (o % 101).alias("score"),
        )

    @cached_property
    def attempts(self) -> DataFrame:
        o = F.col("o_orderkey")
        return self.table("orders").select(
            o.alias("attempt_id"), F.sha2(F.concat(F.lit("tok-"), (o % 500).cast("string")), 256).alias("token_hash"),
            F.concat(F.lit("d"), (F.col("o_custkey") % 150).cast("string"), F.lit(".example.com")).alias("domain"),
            pick(o, "verified", "failed", "revoked", "expired", "pending").alias("status"),
            F.when(o % 3 == 0, F.timestamp_seconds(F.lit(1704067200) + o * 11)).alias("used_at"),
            F.timestamp_seconds(F.lit(1704067200) + (o * 53) % 2592000).alias("created_at"),
        )

    @cached_property
    def tokens(self) -> DataFrame:
        return self.table("customer").select(F.concat(F.lit("tok-"), F.col("c_custkey").cast("string")).alias("token"))

    @cached_property
    def disputes(self) -> DataFrame:
        c = F.col("c_custkey")
        return self.table("customer").select(c.alias("dispute_id"), F.concat(F.lit("d"), c.cast("string"), F.lit(".example.com")).alias("domain"), (c % 3 == 0).alias("suppressed"))

    @cached_property
    def recommendations(self) -> DataFrame:
        o = F.col("o_orderkey")
        return self.table("orders").select(
            o.alias("rec_id"), (F.col("o_custkey") % 3).alias("project_id"), F.concat(F.lit("kind"), (o % 7).cast("string")).alias("kind"),
            pick(o, "generated", "surfaced", "acknowledged", "acted", "measured", "dismissed", "stale").alias("state"),
            F.when(o % 10 == 0, F.lit("demo")).alias("plugin_source"), F.col("o_orderdate").cast("timestamp").alias("generated_at"),
            F.sha2(F.concat(F.lit("f"), (o % 997).cast("string")), 256).alias("input_fingerprint"),
        )

    @cached_property
    def lifecycle(self) -> DataFrame:
        key = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"]
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("rec_id"), F.concat_ws("-", *[F.col(c).cast("string") for c in key[1:4]], F.round(F.col("l_extendedprice") * 100).cast("long").cast("string")).alias("event_id"),
            F.col("l_shipdate").cast("timestamp").alias("changed_at"),
            pick(F.col("l_linenumber") + F.col("l_partkey") % 2, "generated", "surfaced", "acknowledged", "acted", "measured", "dismissed", "stale").alias("state"),
        )

    @cached_property
    def acted(self) -> DataFrame:
        o = F.col("o_orderkey")
        return self.table("orders").select(
            o.alias("rec_id"), (o % 3).alias("project_id"), F.timestamp_seconds(F.lit(1704067200) + (o * 71) % 2000000).alias("acted_at"),
            ((o % 100) / 100.0).alias("value_at_acted"),
        )

    @cached_property
    def tool_calls(self) -> DataFrame:
        e = F.col("event_id")
        return self.table("events").select(
            e.alias("id"), F.col("event_type").alias("tool_name"), F.when(e % 10 == 0, "error").otherwise("ok").alias("status"),
            F.round(F.col("value") * 10).cast("int").alias("latency_ms"), F.col("ts").cast("timestamp").alias("called_at"),
        )

    @cached_property
    def schedules(self) -> DataFrame:
        c = F.col("c_custkey")
        return self.table("customer").select(
            c.alias("schedule_id"), (c % 3).alias("project_id"),
            pick(c, "daily", "every 6 hours", "weekly", "every 48 hours", "hourly", "*/5 * * * *", "0 9 * * 1", "every 2 minutes", "often").alias("cadence"),
            F.when(c % 2 == 0, F.array(F.lit("openai"), F.lit("grok"))).otherwise(F.array(F.lit("mistral"))).alias("providers"),
            (c % 5 + 1).alias("prompt_count"), (c % 4 * 5).alias("debounce_minutes"), F.timestamp_seconds(F.lit(1705276800) + c * 60).alias("created_at"),
        )

    @cached_property
    def ticks(self) -> DataFrame:
        e = F.col("event_id")
        slot = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 21600) * 21600
        return self.table("events").select(
            F.col("user_id").alias("schedule_id"), e.alias("tick_id"), F.timestamp_seconds(slot).alias("tick_ts"),
            pick(e, "completed", "claimed", "failed").alias("status"), F.col("ts").cast("timestamp").alias("claimed_at"),
            F.when(e % 2 == 0, F.col("ts").cast("timestamp")).alias("completed_at"),
        )

    @cached_property
    def manual_runs(self) -> DataFrame:
        return self.table("events").select(F.col("user_id").alias("schedule_id"), F.col("ts").cast("timestamp").alias("run_at"))

    @cached_property
    def deliveries(self) -> DataFrame:
        e = F.col("event_id")
        return self.table("events").select(
            e.alias("id"), F.col("user_id").alias("webhook_id"), F.when(F.col("event_type").isin("error", "view", "click"), "dropped").when(e % 4 == 0, "pending").otherwise("delivered").alias("status"),
            F.col("ts").cast("timestamp").alias("created_at"),
            F.when(e % 3 > 0, F.col("ts").cast("timestamp")).alias("next_attempt_at"),
        )

    @cached_property
    def anomaly_events(self) -> DataFrame:
        e = F.col("event_id")
        field = pick(e, "z", "delta", "novel_count", "frequency", "other")
        payload = F.concat(
            F.lit('{"provider":"'), pick(e, "openai", "gemini"), F.lit('","detail":{"prompt":"p'), F.col("user_id").cast("string"), F.lit('","'), field, F.lit('":'),
            ((e % 12) - 6).cast("string"), F.lit("}}"),
        )
        return self.table("events").select(
            F.floor(e / 2).cast("long").alias("event_id"), e.alias("delivery_id"), (F.floor(e / 2) % 3).cast("long").alias("project_id"),
            F.when(e % 4 < 2, "visibility.anomaly").when(e % 12 < 10, "citation.anomaly").otherwise("run.finished").alias("event_kind"),
            payload.alias("payload"), F.col("ts").cast("timestamp").alias("created_at"),
        )

    @cached_property
    def provenance(self) -> DataFrame:
        return self.table("lineitem").select(
            F.floor(F.col("l_orderkey") * 2 / 3).cast("long").alias("run_id"), pick(F.col("l_linenumber"), "call", "parse", "extract", "persist").alias("step"),
            pick(F.col("l_partkey"), "ok", "ok", "ok", "error", "skipped").alias("status"), F.col("l_shipdate").cast("timestamp").alias("step_at"),
        )

    @cached_property
    def audit_log(self) -> DataFrame:
        o = F.col("o_orderkey")
        email = F.concat(F.lit("u"), (F.col("o_custkey") % 40).cast("string"), F.lit("@x.org"))
        return self.table("orders").select(
            o.alias("id"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.concat(F.lit("org-"), (F.col("o_custkey") % 4).cast("string")).alias("org_id"),
            email.alias("actor_login"), pick(o, "org.update", "org.invite", "key.create", "run.delete").alias("action"),
            F.when(o % 3 > 0, F.concat(F.lit("t"), o.cast("string"))).alias("target"),
            F.concat(F.lit('{"email":"'), email, F.lit('","n":"'), o.cast("string"), F.lit('"}')).alias("metadata"),
        )

    @cached_property
    def audit_runs(self) -> DataFrame:
        o = F.col("o_orderkey")
        return self.table("orders").select(
            o.alias("audit_id"), (F.col("o_custkey") % 3).alias("project_id"), F.concat(F.lit("https://s"), (F.col("o_custkey") % 30).cast("string"), F.lit(".org")).alias("target"),
            (o % 101).cast("int").alias("score"), (o % 40).alias("pages"), (o % 5 > 0).alias("gate_passed"),
            F.timestamp_seconds(F.lit(1704067200) + o * 97).alias("created_at"),
        )

    @cached_property
    def subscriptions(self) -> DataFrame:
        c = F.col("c_custkey")
        return self.table("customer").select(
            F.concat(F.lit("User"), c.cast("string"), F.lit("@x.org")).alias("email"), (c % 11 == 0).alias("all_marketing_off"), (c % 3 > 0).alias("rank_change_enabled"),
            pick(c, "off", "daily", "weekly").alias("digest_frequency"), (F.col("c_nationkey") % 2 == 0).alias("is_eu_resident"), (c % 5 < 3).alias("marketing_consent"),
        )

    @cached_property
    def suppressions(self) -> DataFrame:
        return self.table("supplier").select(F.concat(F.lit("user"), (F.col("s_suppkey") * 3).cast("string"), F.lit("@X.org")).alias("email"))

    @cached_property
    def claims(self) -> DataFrame:
        e = F.col("event_id")
        return self.table("events").select(
            e.alias("claim_id"), (F.col("user_id") % 3).alias("project_id"), F.concat(F.lit("brand"), (e % 9).cast("string")).alias("entity"),
            pick(e, 80, 80, 120).alias("confidence"), pick(e, "supported", "contradicted", "unverifiable", None).alias("verdict"), F.col("ts").cast("timestamp").alias("created_at"),
        )

    @cached_property
    def facts(self) -> DataFrame:
        p = F.col("p_partkey")
        start = F.lit(1704067200) + (p * 911) % 2000000
        return self.table("part").select(
            (p % 3).alias("project_id"), F.concat(F.lit("brand"), (p % 9).cast("string")).alias("entity"), F.concat(F.lit("fact"), p.cast("string")).alias("fact_key"),
            F.timestamp_seconds(start).alias("valid_from"),
            F.when(p % 4 > 0, F.timestamp_seconds(start + (p % 30 - 1) * 86400)).alias("valid_to"),
        )

    @cached_property
    def brand_config(self) -> DataFrame:
        rivals = F.array(
            *[F.struct(F.lit(b).alias("name"), F.concat(F.lit("d"), (F.col("project_id") + 10 + i).cast("string"), F.lit(".example.com")).alias("docs_domain")) for i, b in enumerate(BRANDS[1:])]
        )
        return self.projects.select(
            "project_id", F.lit("brand0").alias("brand"), F.concat(F.lit("d"), (F.col("project_id") + 1).cast("string"), F.lit(".example.com")).alias("docs_domain"),
            rivals.alias("competitors"), F.array(*[F.lit(p) for p in ("openai", "anthropic", "gemini", "openrouter", "grok")]).alias("enabled_providers"),
            (F.col("project_id") < 2).alias("opted_in"),
        )

    @cached_property
    def categories(self) -> DataFrame:
        """Benchmark figures per project and category, from the customers of each segment."""
        seg = self.table("customer").groupBy((F.col("c_custkey") % 3).alias("project_id"), F.col("c_mktsegment").alias("category")).agg(
            F.count("*").alias("n"), F.count_if(F.col("c_nationkey") < 5).alias("in_n"), F.sum(F.col("c_nationkey")).alias("s")
        )
        return seg.select(
            "project_id", "category", (F.col("s") / F.col("n")).alias("brand_rank"), F.lit(12.0).alias("p75"), (F.col("in_n") / F.col("n")).alias("in_graph"),
            (F.col("category") < "H").alias("local_has_prompts"), F.array(F.concat(F.lit("best "), F.lower("category"))).alias("suggested"),
        )

    @cached_property
    def suite(self) -> DataFrame:
        p = F.col("p_partkey")
        slug = F.concat(F.lit("suite-v1/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), (p - p % 2).cast("string"))
        return self.table("part").select(
            F.lit("suite-v1").alias("suite_id"), F.lit("1").alias("suite_version"), F.lit("v2").alias("terms_version"),
            F.when(p % 13 == 0, F.concat(F.lit("Other "), slug)).otherwise(slug).alias("slug"),
            F.when(p % 11 == 0, F.lit("suite-v0")).otherwise(F.lit("suite-v1")).alias("version"), F.col("p_type").alias("category"),
            F.when(p % 17 == 0, F.lit(" ")).otherwise(F.col("p_name")).alias("description"), F.lit("c").alias("contribution_cohort"),
            F.lit("d").alias("cohort_description"), F.col("p_name").alias("prompt_template"),
        )


DICTIONARY = [
    ("that", "the", True, 0), ("from", "form", False, 1), ("with", "avec", False, 2), ("this", "that's", False, 3),
]
_DICT_SQL = ", ".join(f"('{e}', '{v.replace(chr(39), chr(39) * 2)}', {str(b).lower()}, {o})" for e, v, b, o in DICTIONARY)


def case(i: str, *values) -> str:
    """SQL text of pick()."""
    lit = lambda v: "NULL" if v is None else (f"'{v}'" if isinstance(v, str) else str(v).lower())
    return "CASE (" + i + f") % {len(values)} " + " ".join(f"WHEN {k} THEN {lit(v)}" for k, v in enumerate(values)) + " END"


def _secs(expr: str) -> str:
    return f"(TIMESTAMP '1970-01-01' + to_seconds({expr}))"


SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "prompts": ((), "SELECT p_partkey AS prompt_id, p_partkey % 3 AS project_id, 'prompt-' || p_partkey AS name, p_name AS text, [p_type, p_brand] AS tags FROM part"),
    "projects": (("prompts",), "SELECT DISTINCT project_id, 'project-' || project_id AS name, 'org-' || (project_id % 2) AS org_id, CASE WHEN project_id = 2 THEN TIMESTAMP '2024-01-10' END AS archived_at FROM prompts"),
    "runs": ((), f"""SELECT event_id AS run_id, user_id AS prompt_id, {case('event_id', 'openai', 'anthropic', 'gemini', 'openrouter')} AS provider,
        'vendor/m' || (event_id % 3) AS model, ts AS started_at,
        CASE WHEN event_id % 11 <> 0 THEN ts + to_microseconds(CAST(round(value * 1000) AS BIGINT)) END AS finished_at,
        CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status,
        CASE WHEN event_type = 'error' THEN {case('event_id', 'timeout', 'rate_limit', 'auth', 'network', 'parse', 'other')} END AS error_kind,
        ts AS created_at, CASE WHEN user_id % 5 < 4 THEN 'org-' || (user_id % 5) END AS org_id FROM events"""),
    "mentions": ((), f"""SELECT l_orderkey * 2 // 3 AS run_id, 'brand' || (l_partkey % 9) AS entity, l_linenumber AS rank, l_partkey % 9 = 0 AS is_brand,
        {case('l_suppkey', 'positive', 'neutral', 'negative', None)} AS sentiment_label, {case('l_suppkey', 80, 50, 20, None)} AS sentiment_score FROM lineitem"""),
    "citations": ((), f"""SELECT l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS citation_id, l_orderkey * 2 // 3 AS run_id,
        'd' || l_suppkey || '.example.com' AS domain,
        CASE WHEN l_linenumber % 2 = 0 THEN 'https://d' || l_suppkey || '.example.com/p' || (l_partkey % 10) END AS url,
        CAST(trunc(l_quantity) AS INT) AS frequency, {case('l_partkey', 'docs', 'reddit', 'wikipedia', 'youtube', 'general_web', None)} AS source_type FROM lineitem"""),
    "base": (("runs", "prompts"), """SELECT r.*, p.project_id, p.name AS prompt,
        CASE WHEN provider = 'openrouter' THEN 'openrouter:' || model ELSE provider END AS provider_identity FROM runs r JOIN prompts p USING (prompt_id)"""),
    "ranked": (("base", "mentions"), """SELECT b.*, m.rank FROM base b LEFT JOIN
        (SELECT run_id, min(rank) AS rank FROM mentions WHERE entity = 'brand0' GROUP BY run_id) m USING (run_id)"""),
    "samples": (("ranked",), "SELECT project_id, prompt_id, provider, run_id, started_at AS observed_at, rank FROM ranked"),
    "event_pages": ((), "SELECT e.*, p.page_id, p.url FROM events e JOIN pages p ON p.page_id = e.event_id // 40"),
    "site_events": (("event_pages",), f"""SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 'unknown_kind' WHEN event_type = 'view' THEN 'page_view' WHEN event_type = 'click' THEN 'contribute_start'
        WHEN event_type = 'signup' THEN 'contribute_step' WHEN event_type = 'purchase' THEN 'contribute_complete' WHEN event_id % 3 = 0 THEN 'verify_start'
        WHEN event_id % 3 = 1 THEN 'verify_complete' ELSE 'verify_fail' END AS event_type, CAST(user_id AS VARCHAR) AS session_id, url AS path,
        CASE WHEN event_id % 7 = 0 THEN 'jane@corp.com' WHEN event_id % 7 = 1 THEN 'direct' ELSE url END AS referrer,
        {case('event_id', 'dns', 'DNS_TXT', 'email', 'fax')} AS method, ts FROM event_pages"""),
    "hits": (("event_pages",), f"""SELECT user_id % 3 AS project_id, 'evt-' || event_id AS raw_event_id, date_trunc('second', ts) AS ts,
        {case('event_id', 'Mozilla/5.0 GPTBot/1.0', 'ChatGPT-User/2.0', 'OAI-SearchBot/1.0', 'ClaudeBot/1.0', 'PerplexityBot/1.0', 'Google-Extended',
              'Googlebot/2.1', 'CCBot/2.0', 'Bytespider', 'Amazonbot/0.1', 'Mozilla/5.0 Firefox', 'Mozilla/5.0 Safari')} AS user_agent, url AS path,
        {case('event_id', 200, 200, 200, 404, 500)} AS status, 'file' AS source_adapter, event_id % 5 = 4 AS is_v6,
        CASE WHEN event_id % 5 = 4 THEN '2001:db8:' || lower(to_hex(event_id % 65536)) || '::1' ELSE
        {case('event_id', '20.42.', '20.42.', '20.42.', '160.79.', '34.117.', '66.249.', '66.249.')} || (event_id % 256) || '.' || (user_id % 256) END AS client_ip,
        {case('event_id', 'NL', '', None)} AS region FROM event_pages"""),
    "bots": ((), """SELECT * FROM (VALUES (1, 'oai-searchbot', 'openai-oai-searchbot', '20.42.0.0', 16), (2, 'chatgpt-user', 'openai-chatgpt-user', '20.42.0.0', 16),
        (3, 'gptbot', 'openai-gptbot', '20.42.0.0', 16), (4, 'claudebot', 'anthropic-claudebot', '160.79.104.0', 23), (5, 'perplexitybot', 'perplexitybot', '34.117.0.0', 16),
        (6, 'google-extended', 'google-extended', '66.249.64.0', 19), (7, 'googlebot', 'googlebot', '66.249.64.0', 19), (8, 'ccbot', 'common-crawl-ccbot', '18.97.0.0', 16),
        (9, 'bytespider', 'bytedance-bytespider', NULL, NULL), (10, 'amazonbot', 'amazonbot', NULL, NULL)) t(ord, needle, bot_id, net, bits)"""),
    "crawler_events": (("hits", "bots"), """SELECT h.*, b.bot_id, coalesce(NOT is_v6 AND net IS NOT NULL AND
        (list_reduce([CAST(x AS BIGINT) FOR x IN string_split(CASE WHEN is_v6 THEN '0' ELSE client_ip END, '.')], lambda a, c: a * 256 + c) >> (32 - bits))
        = (list_reduce([CAST(x AS BIGINT) FOR x IN string_split(net, '.')], lambda a, c: a * 256 + c) >> (32 - bits)), false) AS ip_verified,
        regexp_replace(path, '^https?://[^/]*', '') AS clean_path, CASE WHEN region <> '' THEN region END AS clean_region
        FROM hits h JOIN bots b ON contains(lower(h.user_agent), b.needle) QUALIFY row_number() OVER (PARTITION BY raw_event_id ORDER BY ord) = 1"""),
    "answers": ((), """SELECT c.conv_id % 3 AS project_id, c.conv_id * 1000 + c.turn AS run_id, c.text || coalesce(' See ' || p.url || '. Also (https://docs.host' || (c.turn % 5)
        || '.example.org/docs/a) and host' || (c.conv_id % 7) || '.example.net, the best reliable.' || chr(10) || 'Not slow', ' no links') AS text
        FROM conversations c LEFT JOIN pages p ON p.page_id = c.conv_id WHERE c.role = 'assistant'"""),
    "dictionary": (("projects",), f"SELECT project_id, d.* FROM projects, (VALUES {_DICT_SQL}) d(entity, variant, is_brand, ordinal)"),
    "audit_pages_in": ((), f"""SELECT page_id, url, html || {case('page_id', '<a href="https://example.com/ref">Source: study</a>', '<link rel="canonical" href="/c">',
        '<script type="application/ld+json">{}</script>', '<h2>What is it</h2><p>According to us</p>', '<meta name="robots" content="noai"><meta property="og:site_name" content="x">',
        '<ol><li>x</li></ol>')} AS html FROM pages"""),
    "entities": ((), f"""SELECT 'd' || s_suppkey || '.example.com' AS domain, CASE s_suppkey % 7 WHEN 1 THEN upper(s_name) WHEN 2 THEN s_name || '!' WHEN 3 THEN s_name || ' Inc'
        WHEN 4 THEN replace(s_name, 'e', 'е') ELSE s_name END AS display_name, {case('s_suppkey', 'verified', 'unclaimed', 'revoked', 'pending')} AS claim_status,
        {case('s_suppkey', 'dns_txt', 'email_magic_link', None)} AS verification_method, {_secs('1704067200 + s_suppkey * 3600')} AS created_at,
        CASE WHEN s_suppkey % 4 = 0 THEN {_secs('1704067200 + s_suppkey * 3600')} END AS verified_at,
        CASE WHEN s_suppkey % 4 = 2 THEN {_secs('1704067200 + s_suppkey * 7200')} END AS grace_period_start FROM supplier"""),
    "dup_entities": ((), """SELECT 'a' || s_suppkey AS domain, s_name AS display_name FROM supplier UNION ALL
        SELECT 'b' || s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN upper(s_name) WHEN 1 THEN s_name || ' !!' WHEN 2 THEN s_name || ' Group' ELSE replace(s_name, 'e', 'е') || 'x' END FROM supplier"""),
    "consent": ((), f"""SELECT o_orderkey AS consent_id, o_custkey % 50 AS project_id, {case('o_orderkey', 'benchmark', 'named')} AS tier,
        CASE WHEN o_orderstatus = 'F' THEN 'optout' ELSE 'optin' END AS event, {case('o_orderkey', 'v2', 'v2', 'v2', 'v1')} AS terms_version,
        {_secs('1704067200 + (o_orderkey * 7919) % 2592000')} AS created_at FROM orders"""),
    "observed": (("runs",), f"""SELECT run_id, prompt_id % 50 AS project_id, CASE WHEN run_id % 10 = 0 THEN 'Prompt ' ELSE 'prompt-' END || prompt_id AS prompt_slug, provider, model,
        started_at AS observed_at, run_id % 7 AS observed_rank, {case('run_id', 'v2', 'v2', 'v1')} AS terms, run_id % 3 < 2 AS contribute FROM runs"""),
    "contributions": ((), f"""SELECT o_orderkey AS contribution_id, o_custkey % 40 AS project_id, CASE WHEN o_orderkey % 9 < 8 THEN 'd' || (o_custkey % 100) || '.example.com' END AS entity_domain,
        'd' || (o_orderkey % 60) || '.example.com' AS domain, o_orderpriority AS category, {case('o_orderkey', 'openai', 'anthropic', 'gemini')} AS provider,
        {case('o_orderkey', 30, 7)} AS window_days, o_orderkey % 20 AS run_count, o_orderstatus <> 'F' AS opted_in, o_orderkey % 4 > 0 AS verified,
        CASE WHEN o_orderkey % 17 = 0 THEN o_orderdate END AS revoked_at, o_orderkey % 101 AS score FROM orders"""),
    "attempts": ((), f"""SELECT o_orderkey AS attempt_id, sha256('tok-' || (o_orderkey % 500)) AS token_hash, 'd' || (o_custkey % 150) || '.example.com' AS domain,
        {case('o_orderkey', 'verified', 'failed', 'revoked', 'expired', 'pending')} AS status, CASE WHEN o_orderkey % 3 = 0 THEN {_secs('1704067200 + o_orderkey * 11')} END AS used_at,
        {_secs('1704067200 + (o_orderkey * 53) % 2592000')} AS created_at FROM orders"""),
    "tokens": ((), "SELECT 'tok-' || c_custkey AS token FROM customer"),
    "disputes": ((), "SELECT c_custkey AS dispute_id, 'd' || c_custkey || '.example.com' AS domain, c_custkey % 3 = 0 AS suppressed FROM customer"),
    "recommendations": ((), f"""SELECT o_orderkey AS rec_id, o_custkey % 3 AS project_id, 'kind' || (o_orderkey % 7) AS kind,
        {case('o_orderkey', 'generated', 'surfaced', 'acknowledged', 'acted', 'measured', 'dismissed', 'stale')} AS state, CASE WHEN o_orderkey % 10 = 0 THEN 'demo' END AS plugin_source,
        o_orderdate AS generated_at, sha256('f' || (o_orderkey % 997)) AS input_fingerprint FROM orders"""),
    "lifecycle": ((), f"""SELECT l_orderkey AS rec_id, l_partkey || '-' || l_suppkey || '-' || l_linenumber || '-' || CAST(round(l_extendedprice * 100) AS BIGINT) AS event_id, l_shipdate AS changed_at,
        {case('l_linenumber + l_partkey % 2', 'generated', 'surfaced', 'acknowledged', 'acted', 'measured', 'dismissed', 'stale')} AS state FROM lineitem"""),
    "acted": ((), f"SELECT o_orderkey AS rec_id, o_orderkey % 3 AS project_id, {_secs('1704067200 + (o_orderkey * 71) % 2000000')} AS acted_at, (o_orderkey % 100) / 100.0::DOUBLE AS value_at_acted FROM orders"),
    "tool_calls": ((), "SELECT event_id AS id, event_type AS tool_name, CASE WHEN event_id % 10 = 0 THEN 'error' ELSE 'ok' END AS status, CAST(round(value * 10) AS INT) AS latency_ms, ts AS called_at FROM events"),
    "schedules": ((), f"""SELECT c_custkey AS schedule_id, c_custkey % 3 AS project_id,
        {case('c_custkey', 'daily', 'every 6 hours', 'weekly', 'every 48 hours', 'hourly', '*/5 * * * *', '0 9 * * 1', 'every 2 minutes', 'often')} AS cadence,
        CASE (c_custkey) % 9 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 4.0 WHEN 2 THEN 1.0::DOUBLE / 7.0 WHEN 3 THEN 0.5 WHEN 4 THEN 24.0 WHEN 5 THEN 288.0 WHEN 6 THEN 1.0::DOUBLE / 7.0 WHEN 7 THEN 720.0 END AS tpd,
        {case('c_custkey', 0.029, 0.008)} AS usd, {case('c_custkey', 2, 1)} AS n_providers, {case('c_custkey', 'openai', 'mistral')} AS first_provider,
        c_custkey % 5 + 1 AS prompt_count, c_custkey % 4 * 5 AS debounce_minutes, {_secs('1705276800 + c_custkey * 60')} AS created_at FROM customer"""),
    "ticks": ((), f"""SELECT user_id AS schedule_id, event_id AS tick_id, {_secs('(CAST(floor(epoch(ts)) AS BIGINT) // 21600) * 21600')} AS tick_ts,
        {case('event_id', 'completed', 'claimed', 'failed')} AS status, ts AS claimed_at, CASE WHEN event_id % 2 = 0 THEN ts END AS completed_at FROM events"""),
    "manual_runs": ((), "SELECT user_id AS schedule_id, ts AS run_at FROM events"),
    "deliveries": ((), """SELECT event_id AS id, user_id AS webhook_id, CASE WHEN event_type IN ('error', 'view', 'click') THEN 'dropped' WHEN event_id % 4 = 0 THEN 'pending' ELSE 'delivered' END AS status,
        ts AS created_at, CASE WHEN event_id % 3 > 0 THEN ts END AS next_attempt_at FROM events"""),
    "anomaly_events": ((), f"""SELECT event_id // 2 AS event_id, event_id AS delivery_id, event_id // 2 % 3 AS project_id, CASE WHEN event_id % 4 < 2 THEN 'visibility.anomaly' WHEN event_id % 12 < 10 THEN 'citation.anomaly' ELSE 'run.finished' END AS event_kind,
        {case('event_id', 'openai', 'gemini')} AS provider, 'p' || user_id AS prompt, {case('event_id', 'z', 'delta', 'novel_count', 'frequency', 'other')} AS field, event_id % 12 - 6 AS v, ts AS created_at FROM events"""),
    "provenance": ((), f"""SELECT l_orderkey * 2 // 3 AS run_id, {case('l_linenumber', 'call', 'parse', 'extract', 'persist')} AS step, {case('l_partkey', 'ok', 'ok', 'ok', 'error', 'skipped')} AS status,
        l_shipdate AS step_at FROM lineitem"""),
    "audit_log": ((), f"""SELECT o_orderkey AS id, o_orderdate AS ts, 'org-' || (o_custkey % 4) AS org_id, 'u' || (o_custkey % 40) || '@x.org' AS actor_login,
        {case('o_orderkey', 'org.update', 'org.invite', 'key.create', 'run.delete')} AS action, CASE WHEN o_orderkey % 3 > 0 THEN 't' || o_orderkey END AS target FROM orders"""),
    "audit_runs": ((), f"""SELECT o_orderkey AS audit_id, o_custkey % 3 AS project_id, 'https://s' || (o_custkey % 30) || '.org' AS target, o_orderkey % 101 AS score, o_orderkey % 40 AS pages,
        o_orderkey % 5 > 0 AS gate_passed, {_secs('1704067200 + o_orderkey * 97')} AS created_at FROM orders"""),
    "subscriptions": ((), f"""SELECT 'User' || c_custkey || '@x.org' AS email, c_custkey % 11 = 0 AS all_marketing_off, c_custkey % 3 > 0 AS rank_change_enabled,
        {case('c_custkey', 'off', 'daily', 'weekly')} AS digest_frequency, c_nationkey % 2 = 0 AS is_eu_resident, c_custkey % 5 < 3 AS marketing_consent FROM customer"""),
    "suppressions": ((), "SELECT 'user' || (s_suppkey * 3) || '@X.org' AS email FROM supplier"),
    "claims": ((), f"""SELECT event_id AS claim_id, user_id % 3 AS project_id, 'brand' || (event_id % 9) AS entity, {case('event_id', 80, 80, 120)} AS confidence,
        {case('event_id', 'supported', 'contradicted', 'unverifiable', None)} AS verdict, ts AS created_at FROM events"""),
    "facts": ((), f"""SELECT p_partkey % 3 AS project_id, 'brand' || (p_partkey % 9) AS entity, 'fact' || p_partkey AS fact_key, {_secs('1704067200 + (p_partkey * 911) % 2000000')} AS valid_from,
        CASE WHEN p_partkey % 4 > 0 THEN {_secs('1704067200 + (p_partkey * 911) % 2000000 + (p_partkey % 30 - 1) * 86400')} END AS valid_to FROM part"""),
    "categories": ((), """SELECT c_custkey % 3 AS project_id, c_mktsegment AS category, sum(c_nationkey)::DOUBLE / count(*) AS brand_rank, 12.0::DOUBLE AS p75,
        count(*) FILTER (WHERE c_nationkey < 5)::DOUBLE / count(*) AS in_graph, c_mktsegment < 'H' AS local_has_prompts FROM customer GROUP BY 1, 2"""),
    "suite": ((), """SELECT 'suite-v1' AS suite_id, CASE WHEN p_partkey % 13 = 0 THEN 'Other ' ELSE '' END || 'suite-v1/' || replace(p_name, ' ', '-') || '-' || (p_partkey - p_partkey % 2) AS slug,
        CASE WHEN p_partkey % 11 = 0 THEN 'suite-v0' ELSE 'suite-v1' END AS version, CASE WHEN p_partkey % 17 = 0 THEN ' ' ELSE p_name END AS description FROM part"""),
}


def sql(body: str, *views: str) -> str:
    """Prefix a SELECT with the views it names, in dependency order. `body` may bring its own CTEs after `WITH`."""
    order: list[str] = []

    def add(name: str) -> None:
        deps, _ = SQL[name]
        for d in deps:
            add(d)
        if name not in order:
            order.append(name)

    for v in views:
        add(v)
    ctes = ",\n".join(f"{n} AS ({SQL[n][1]})" for n in order)
    body = body.strip()
    if not ctes:
        return body
    return f"WITH {ctes},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes}\n{body}"
