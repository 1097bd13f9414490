"""Crawler and site traffic queries, log sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.ordering import latest_by
from ..operators import constraints as K
from ..operators import crawlers as W
from ..operators import site as P
from ..sources import logs, sinks
from .catalog import d, query, r, t
from .views import AS_OF, OPEN_DAY, sql

_HIT = f"raw_event_id, {t('ts')} AS ts, user_agent, path, status, client_ip"


def _sha(line: str) -> str:
    return f"'file:' || sha256({line})"


_LINE = """client_ip || ' - - [' || strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000] "GET ' || path || ' HTTP/1.1" ' || status || ' 42 "-" "' || user_agent || '"'"""


@query("access_log_hits", "S-2", sql(f"SELECT {_sha(_LINE)} AS raw_event_id, {t('ts')} AS ts, user_agent, path, status, client_ip FROM hits", "hits"))
def _(v):
    return logs.read_access_log(v.log_lines, "file", AS_OF).drop("source_adapter", "region")


@query("custom_log_hits", "S-3", sql(f"SELECT raw_event_id, {t('ts')} AS ts, split_part(user_agent, ' ', 1) AS user_agent, path, status, client_ip, 'EU' AS region FROM hits", "hits"))
def _(v):
    line = F.concat_ws(
        " ", "raw_event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "client_ip", "path", F.col("status").cast("string"), F.lit("EU"), F.split_part("user_agent", F.lit(" "), F.lit(1))
    )
    return logs.read_custom_log(v.hits.select(line.alias("value")), "{id} {ts} {ip} {path} {status} {region} {ua}", "file", AS_OF).drop("source_adapter")


_RAYS = "CASE WHEN status = 404 THEN NULL ELSE raw_event_id END"


@query("cdn_json_hits", "S-4 F-15 T-10", sql(f"""SELECT raw_event_id, {t('ts')} AS ts, user_agent, path, CASE WHEN status = 500 THEN 0 ELSE status END AS status, client_ip, nullif(region, '') AS region
  FROM hits WHERE status <> 404""", "hits"))
def _(v):
    h = v.hits
    # Times are RFC 3339 text or integer microseconds; a status given as text is not a number; a first alias of the wrong type drops the row.
    text_time = F.to_json(F.struct(
        F.col("raw_event_id").alias("ray_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "user_agent", "path", "status", "client_ip",
        F.when(F.col("region") != "", F.col("region")).alias("country"),
    ))
    micro_time = F.to_json(F.struct(
        F.col("raw_event_id").alias("id"), F.unix_micros("ts").alias("ts"), F.col("user_agent").alias("UserAgent"), F.col("path").alias("uri"), F.col("status").cast("string").alias("Status"),
        F.col("client_ip").alias("ip"), F.when(F.col("region") != "", F.col("region")).alias("region"),
    ))
    wrong = F.to_json(F.struct(F.lit(True).alias("ts"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "user_agent", "path"))
    body = F.when(F.col("status") == 500, micro_time).when(F.col("status") == 404, wrong).otherwise(text_time)
    return logs.read_cdn_json(h.select(body.alias("value")), "cdn").drop("source_adapter")


@query("ga4_hits", "S-5", sql(f"SELECT raw_event_id, {t('ts')} AS ts, user_agent, path, 200 AS status, client_ip FROM hits", "hits"))
def _(v):
    body = F.to_json(F.struct(F.col("raw_event_id").alias("event_id"), F.unix_micros("ts").alias("event_timestamp"), F.col("user_agent").alias("ua"), F.col("path").alias("page_location"), F.col("client_ip").alias("ip")))
    return logs.read_ga4_json(v.hits.select(body.alias("value"))).drop("source_adapter", "region")


@query("bot_identity", "F-1 X-U3", sql("""SELECT h.user_agent, (SELECT bot_id FROM bots b WHERE contains(lower(h.user_agent), needle) ORDER BY ord LIMIT 1) AS bot, count(*) AS hits FROM hits h GROUP BY 1, 2""", "hits", "bots"))
def _(v):
    S.register_sql_functions(v.spark)
    return v.hits.groupBy("user_agent", F.expr("bot_identity(user_agent)").alias("bot")).agg(F.count("*").alias("hits"))


@query("crawler_events", "J-9 F-2 F-4 F-5", sql(f"""SELECT project_id, raw_event_id, {t('ts')} AS ts, bot_id, clean_path AS path, status, ip_verified, clean_region AS region, sha256('salt:' || client_ip) AS client_ip_hash
  FROM crawler_events""", "crawler_events"))
def _(v):
    return v.crawler_events.select("project_id", "raw_event_id", "ts", "bot_id", "path", "status", "ip_verified", "region", "client_ip_hash")


@query("bot_ranges", "S-7", """SELECT * FROM (VALUES ('openai-gptbot', '4:142a0000', '4:142affff'), ('openai-chatgpt-user', '4:142a0000', '4:142affff'), ('openai-oai-searchbot', '4:142a0000', '4:142affff'),
  ('anthropic-claudebot', '4:a04f6800', '4:a04f69ff'), ('perplexitybot', '4:22750000', '4:2275ffff'), ('google-extended', '4:42f94000', '4:42f95fff'), ('googlebot', '4:42f94000', '4:42f95fff'),
  ('common-crawl-ccbot', '4:12610000', '4:1261ffff')) t(bot_id, lo, hi) WHERE bot_id IN (SELECT bot_id FROM (SELECT CASE event_id % 12 WHEN 0 THEN 'openai-gptbot' WHEN 1 THEN 'openai-chatgpt-user'
  WHEN 2 THEN 'openai-oai-searchbot' WHEN 3 THEN 'anthropic-claudebot' WHEN 4 THEN 'perplexitybot' WHEN 5 THEN 'google-extended' WHEN 6 THEN 'googlebot' WHEN 7 THEN 'common-crawl-ccbot' END AS bot_id FROM events))""")
def _(v):
    lo, hi = S.cidr_bounds(F.col("cidr"))
    seen = v.hits.select(S.bot_id(F.col("user_agent")).alias("bot_id"))
    return logs.load_bot_ranges(v.spark).join(seen, "bot_id", "left_semi").select("bot_id", lo.alias("lo"), hi.alias("hi"))


@query("truncated_ips", "F-3 X-U4", sql("""SELECT raw_event_id, CASE WHEN is_v6 THEN CASE WHEN regexp_extract(client_ip, '^2001:db8:([0-9a-f]+)', 1) = '0' THEN '2001:db8::' ELSE '2001:db8:' || regexp_extract(client_ip, '^2001:db8:([0-9a-f]+)', 1) || '::' END
  ELSE regexp_replace(client_ip, '[0-9]+$', '0') END AS client_ip_truncated, 'truncated' AS privacy_mode FROM hits""", "hits"))
def _(v):
    return S.store_ip(v.hits, "truncated").select("raw_event_id", "client_ip_truncated", "privacy_mode")


_CE = "FROM crawler_events WHERE ts >= TIMESTAMP '2024-01-17 00:00:00' AND ip_verified"


@query("crawler_bots", "A-23", sql("""SELECT project_id, bot_id, count(*) AS hits, count(*) FILTER (WHERE ip_verified) AS verified_hits, count(*) FILTER (WHERE status >= 400) AS error_hits
  FROM crawler_events WHERE ts >= TIMESTAMP '2024-01-17 00:00:00' GROUP BY 1, 2""", "crawler_events"))
def _(v):
    return W.crawler_bots(v.crawler_events, AS_OF, 14, include_unverified=True)


@query("crawler_paths", "A-23 K-1", sql(f"""SELECT project_id, clean_path AS path, count(*) AS hits, count(*) FILTER (WHERE status >= 400) AS error_hits {_CE} GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY count(*) DESC, clean_path) <= 20""", "crawler_events"))
def _(v):
    return W.crawler_paths(v.crawler_events, AS_OF, 14)


@query("crawler_error_paths", "A-23 K-1", sql(f"""SELECT project_id, clean_path AS path, count(*) AS hits, count(*) FILTER (WHERE status >= 400) AS error_hits {_CE} GROUP BY 1, 2 HAVING count(*) FILTER (WHERE status >= 400) > 0
  QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY count(*) FILTER (WHERE status >= 400) DESC, count(*) DESC, clean_path) <= 20""", "crawler_events"))
def _(v):
    return W.crawler_error_paths(v.crawler_events, AS_OF, 14)


@query("crawler_trend", "A-23", sql(f"SELECT project_id, {d('ts')} AS day, count(*) AS hits, epoch_ms(CAST(date_trunc('day', min(ts)) AS TIMESTAMP)) AS epoch_ms {_CE} GROUP BY 1, 2", "crawler_events"))
def _(v):
    return W.crawler_trend(v.crawler_events, AS_OF, 14)


@query("crawls_only", "A-24", sql(f"SELECT project_id, bot_id, count(*) AS verified_crawl_hits, 0 AS attributed_referrals, CAST(NULL AS DOUBLE) AS ratio, 'crawls_only' AS state {_CE} GROUP BY 1, 2", "crawler_events"))
def _(v):
    return W.crawl_refer_ratio(v.crawler_events, AS_OF, 14)


@query("crawl_refer_ratio", "A-24", sql(f"""WITH c AS (SELECT project_id, bot_id, count(*) AS n {_CE} GROUP BY 1, 2), f AS (SELECT project_id, bot_id, count(*) AS n FROM crawler_events WHERE ts >= TIMESTAMP '2024-01-17 00:00:00' AND status = 200 GROUP BY 1, 2)
  SELECT project_id, bot_id, c.n AS verified_crawl_hits, coalesce(f.n, 0) AS attributed_referrals, {r('coalesce(f.n, 0)::DOUBLE / c.n')} AS ratio, 'attributed' AS state FROM c LEFT JOIN f USING (project_id, bot_id)""", "crawler_events"))
def _(v):
    return W.crawl_refer_ratio(v.crawler_events, AS_OF, 14, v.crawler_events.filter(F.col("status") == 200).select("project_id", "bot_id", "ts"))


@query("crawler_constraints", "P-10", sql("SELECT 'status_range' AS rule, count(*) FILTER (WHERE status NOT BETWEEN 100 AND 599) AS violations FROM crawler_events UNION ALL SELECT 'one_ip_shape', 0", "crawler_events"))
def _(v):
    return K.violations(v.crawler_events, K.crawler_rules())


@query("duplicate_event_keys", "P-10", "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(v):
    return K.duplicate_keys(v.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query("appended_hits", "S-8", sql("SELECT raw_event_id, status FROM hits WHERE status = 500", "hits"))
def _(v):
    twice = v.hits.unionByName(v.hits.filter(F.col("status") > 200))
    return sinks.append_new(twice, v.hits.filter(F.col("status") != 500), ["source_adapter", "raw_event_id"], ["ts"]).select("raw_event_id", "status")


@query("latest_versions", "S-9", sql(f"SELECT session_id, event_id, {t('ts')} AS ts FROM site_events QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY site_events.ts DESC, event_id DESC) = 1", "site_events"))
def _(v):
    return sinks.keep_latest(v.site_events, ["session_id"], "ts", ["event_id"]).select("session_id", "event_id", "ts")


# --- site --------------------------------------------------------------------------------------

_KNOWN = "se AS (SELECT * FROM site_events WHERE event_type <> 'unknown_kind' AND ts < TIMESTAMP '2024-01-30 12:00:00')"
_FIRST = "TIMESTAMP '2024-01-20 12:00:00'"


def _known(v):
    return P.known_events(v.site_events).filter(F.col("ts") < F.lit(OPEN_DAY).cast("timestamp"))


def _first_half(v):
    """The rollup as it was computed on 20 January, when that day was still open."""
    return _known(v).filter(F.col("ts") < F.lit("2024-01-20 12:00:00").cast("timestamp"))


def _rollup(v):
    return P.event_rollup(_known(v), None, OPEN_DAY)


@query("known_site_events", "P-8", sql("SELECT event_type, count(*) AS n FROM site_events WHERE event_type <> 'unknown_kind' GROUP BY 1", "site_events"))
def _(v):
    return P.known_events(v.site_events).groupBy("event_type").agg(F.count("*").alias("n"))


@query("site_event_rollup", "A-27 P-8", sql(f"""WITH {_KNOWN} SELECT event_type, {d('ts')} AS day, count(*) AS event_count, count(DISTINCT session_id) AS unique_sessions, CAST(ts AS DATE) < DATE '2024-01-30' AS finalized
  FROM se GROUP BY 1, 2, 5""", "site_events"))
def _(v):
    return _rollup(v)


@query("site_event_rollup_frozen", "A-27 T-6", sql(f"""WITH {_KNOWN} SELECT event_type, {d('ts')} AS day, count(*) AS event_count, count(DISTINCT session_id) AS unique_sessions, CAST(ts AS DATE) < DATE '2024-01-30' AS finalized
  FROM se GROUP BY 1, 2, 5""", "site_events"))
def _(v):
    # The second run sees only the raw rows left after pruning; finalized days must keep their numbers.
    first = P.event_rollup(_first_half(v), None, "2024-01-20 12:00:00")
    left = _known(v).filter(F.col("ts") >= F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return P.event_rollup(left, first, OPEN_DAY)


_PATH = """CASE WHEN path LIKE 'http%' THEN coalesce(nullif(split_part(split_part(regexp_replace(path, '^https?://[^/]*', ''), '?', 1), '#', 1), ''), '/') ELSE '(other)' END"""
_REF = """CASE WHEN contains(referrer, '@') THEN NULL WHEN referrer = 'direct' THEN '(other)' ELSE lower(split_part(split_part(regexp_replace(referrer, '^https?://', ''), '/', 1), ':', 1)) END"""


@query("site_page_rollup", "A-28 F-12", sql(f"""WITH {_KNOWN} SELECT {_PATH} AS path, {d('ts')} AS day, count(*) AS views, CAST(ts AS DATE) < DATE '2024-01-30' AS finalized FROM se WHERE event_type = 'page_view' GROUP BY 1, 2, 4""", "site_events"))
def _(v):
    return P.page_rollup(_known(v), None, OPEN_DAY)


@query("site_referrer_rollup", "A-28 F-13", sql(f"""WITH {_KNOWN}, x AS (SELECT {_REF} AS referrer, ts FROM se WHERE event_type = 'page_view')
  SELECT referrer, {d('ts')} AS day, count(*) AS visits, CAST(ts AS DATE) < DATE '2024-01-30' AS finalized FROM x WHERE referrer IS NOT NULL GROUP BY 1, 2, 4""", "site_events"))
def _(v):
    return P.referrer_rollup(_known(v), None, OPEN_DAY)


_LAST7 = "CAST(ts AS DATE) >= DATE '2024-01-24'"


@query("sessions_per_day", "A-29 P-3 T-14", sql(f"WITH {_KNOWN} SELECT {d('ts')} AS day, count(DISTINCT session_id) AS count FROM se WHERE event_type = 'page_view' AND {_LAST7} GROUP BY 1", "site_events"))
def _(v):
    return P.sessions_per_day(_rollup(v), OPEN_DAY, 7)


@query("top_pages", "A-29 K-1", sql(f"WITH {_KNOWN} SELECT {_PATH} AS label, count(*) AS count FROM se WHERE event_type = 'page_view' AND {_LAST7} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "site_events"))
def _(v):
    return P.top_pages(P.page_rollup(_known(v), None, OPEN_DAY), OPEN_DAY, 7, 10)


@query("top_referrers", "A-29 K-1", sql(f"""WITH {_KNOWN}, x AS (SELECT {_REF} AS label FROM se WHERE event_type = 'page_view' AND {_LAST7}) SELECT label, count(*) AS count FROM x WHERE label IS NOT NULL
  GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""", "site_events"))
def _(v):
    return P.top_referrers(P.referrer_rollup(_known(v), None, OPEN_DAY), OPEN_DAY, 7, 10)


@query("event_type_totals", "A-29", sql(f"WITH {_KNOWN} SELECT event_type, count(*) AS count FROM se WHERE {_LAST7} GROUP BY 1", "site_events"))
def _(v):
    return P.event_type_totals(_rollup(v), OPEN_DAY, 7)


@query("badge_embeds", "A-29", sql(f"WITH {_KNOWN} SELECT {d('ts')} AS day, count(*) AS count FROM se WHERE event_type = 'page_view' AND {_LAST7} GROUP BY 1", "site_events"))
def _(v):
    views = _known(v).withColumn("event_type", F.when(F.col("event_type") == "page_view", "badge_embed_view").otherwise(F.col("event_type")))
    return P.badge_embeds_per_day(P.event_rollup(views, None, OPEN_DAY), OPEN_DAY, 7)


@query("verify_funnel", "A-30 F-10 F-15", sql(f"""WITH {_KNOWN}, x AS (SELECT CASE lower(method) WHEN 'dns' THEN 'dns' WHEN 'dns_txt' THEN 'dns' WHEN 'email' THEN 'email' ELSE 'unknown' END AS m, event_type FROM se WHERE event_type LIKE 'verify%' AND {_LAST7})
  SELECT m AS method, count(*) FILTER (WHERE event_type = 'verify_start') AS start, count(*) FILTER (WHERE event_type = 'verify_complete') AS complete, count(*) FILTER (WHERE event_type = 'verify_fail') AS fail,
  {r("CASE WHEN count(*) FILTER (WHERE event_type = 'verify_start') > 0 THEN count(*) FILTER (WHERE event_type = 'verify_complete')::DOUBLE / count(*) FILTER (WHERE event_type = 'verify_start') * 100 END")} AS success_pct FROM x GROUP BY 1""", "site_events"))
def _(v):
    return P.verify_funnel(_known(v), OPEN_DAY, 7)


@query("contribute_funnel", "A-31", sql(f"""WITH {_KNOWN}, s AS (SELECT i AS step, l AS label, (SELECT count(*) FROM se WHERE event_type = l AND {_LAST7}) AS count FROM (VALUES (0, 'contribute_start'), (1, 'contribute_step'), (2, 'contribute_complete')) q(i, l)),
  p AS (SELECT *, lag(count) OVER (ORDER BY step) AS pv FROM s) SELECT step, label, count, {r('CASE WHEN pv > 0 AND count <= pv THEN (pv - count)::DOUBLE / pv * 100 END')} AS drop_off_pct FROM p""", "site_events"))
def _(v):
    return P.funnel(P.event_type_totals(_rollup(v), OPEN_DAY, 7))


@query("admitted_events", "F-12 F-13 F-10", sql(f"""SELECT event_id, {_PATH} AS path, CASE WHEN contains(referrer, '@') OR referrer = 'direct' THEN '(other)' ELSE lower(split_part(split_part(regexp_replace(referrer, '^https?://', ''), '/', 1), ':', 1)) END AS referrer,
  CASE lower(method) WHEN 'dns' THEN 'dns' WHEN 'dns_txt' THEN 'dns' WHEN 'email' THEN 'email' ELSE 'unknown' END AS method FROM site_events WHERE event_type <> 'unknown_kind'""", "site_events"))
def _(v):
    return P.admit_record(v.site_events).select("event_id", "path", "referrer", F.get_json_object("properties", "$.method").alias("method"))


@query("retained_events", "ST-5", sql("SELECT event_id FROM site_events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00'", "site_events"))
def _(v):
    return P.retain(v.site_events, "2024-01-20 00:00:00", 10).select("event_id")


@query("latest_by_key", "A-26", sql(f"SELECT project_id, tier, consent_id, event, {t('created_at')} AS created_at FROM consent QUALIFY row_number() OVER (PARTITION BY project_id, tier ORDER BY consent.created_at DESC, consent_id DESC) = 1", "consent"))
def _(v):
    return latest_by(v.consent, ["project_id", "tier"], [F.col("created_at").desc(), F.col("consent_id").desc()]).select("project_id", "tier", "consent_id", "event", "created_at")
