"""Visibility, run, citation and brand queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import ordering as O
from ..functions import scalars as S
from ..operators import brands as B
from ..operators import citations as C
from ..operators import recommend as RC
from ..operators import runs as R
from ..operators import visibility as V
from .catalog import d, lst, query, r, t
from .views import AS_OF, BRANDS, sql

DAYS = 14
_W = "started_at >= TIMESTAMP '2024-01-17 00:00:00'"
_WC = _W + " AND started_at <= TIMESTAMP '2024-01-31 00:00:00'"
_BRAND_ARGS = ("brand0", AS_OF, DAYS)

# --- visibility --------------------------------------------------------------------------------

_MATRIX = f"""SELECT project_id, prompt_id, prompt, provider_identity, count(*) AS run_count, count(rank) AS mention_count,
  {r('avg(rank)')} AS avg_rank, {r('count(rank)::DOUBLE / count(*)')} AS presence FROM ranked WHERE {_W} AND status = 'ok' GROUP BY ALL"""


@query("visibility_matrix", "A-1 J-1 J-2 P-1 P-2 P-5 F-23 S-1", sql(_MATRIX, "ranked"))
def _(v):
    return V.visibility_matrix(v.runs, v.prompts, v.mentions, *_BRAND_ARGS)


@query("visibility_trend_all", "A-2 F-6", sql(f"""SELECT project_id, {d("started_at")} AS day, provider_identity, {r('avg(rank)')} AS avg_rank,
  {r('count(rank)::DOUBLE / count(*)')} AS presence_rate FROM ranked WHERE {_W} AND status = 'ok' GROUP BY ALL""", "ranked"))
def _(v):
    return V.visibility_trend_all(v.runs, v.prompts, v.mentions, *_BRAND_ARGS)


@query("visibility_trend", "A-3", sql(f"""SELECT project_id, prompt_id, {d("started_at")} AS day, provider_identity, {r('avg(rank)')} AS avg_rank,
  {r('count(rank)::DOUBLE / count(*)')} AS presence_rate FROM ranked WHERE {_W} AND status = 'ok' GROUP BY ALL""", "ranked"))
def _(v):
    return V.visibility_trend(v.runs, v.prompts, v.mentions, *_BRAND_ARGS)


@query("visibility_trend_placeholder", "A-3 T-5", sql(f"""SELECT DISTINCT project_id, prompt_id, {d("started_at")} AS day, provider_identity, CAST(NULL AS DOUBLE) AS avg_rank,
  1.0::DOUBLE AS presence_rate FROM ranked WHERE {_W} AND status = 'ok'""", "ranked"))
def _(v):
    return V.visibility_trend(v.runs, v.prompts, v.mentions, *_BRAND_ARGS, real=False)


@query("heatmap", "A-4 P-2", sql(f"""SELECT project_id, {d("started_at")} AS day, provider_identity, count(*) AS runs, {r('count(rank)::DOUBLE / count(*)')} AS presence_rate,
  {r('avg(rank)')} AS avg_rank FROM ranked WHERE {_WC} AND status = 'ok' GROUP BY ALL""", "ranked"))
def _(v):
    return V.heatmap(v.runs, v.prompts, v.mentions, *_BRAND_ARGS)


_VOL = f"""WITH daily AS (SELECT project_id, prompt_id, provider_identity, CAST(started_at AS DATE) AS day, avg(rank) AS rank FROM ranked WHERE {_WC} AND status = 'ok' GROUP BY ALL),
  series AS (SELECT DISTINCT project_id, prompt_id, provider_identity FROM daily),
  cal AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-18', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day),
  dense AS (SELECT s.*, c.day, x.rank FROM series s CROSS JOIN cal c LEFT JOIN daily x USING (project_id, prompt_id, provider_identity, day)),
  agg AS (SELECT project_id, prompt_id, provider_identity, count(rank) AS n, avg(rank) AS m, stddev_pop(rank) AS sd, count(*) AS samples FROM dense GROUP BY ALL)
SELECT project_id, prompt_id, provider_identity, {r("CASE WHEN n = 0 THEN NULL WHEN n = 1 THEN 0 ELSE least(sd / abs(m), 1) END")} AS value,
  {r('n::DOUBLE / samples')} AS presence_ratio, samples FROM agg"""


@query("volatility", "W-4 T-16", sql(_VOL, "ranked"))
def _(v):
    return V.volatility(v.runs, v.prompts, v.mentions, *_BRAND_ARGS)


@query("visibility_gate", "A-48", sql("""SELECT project_id, prompt_id, provider_identity, min(rank) AS best_rank, coalesce(min(rank) <= 2, false) AS passed
  FROM ranked WHERE status = 'ok' GROUP BY ALL""", "ranked"))
def _(v):
    return V.visibility_gate(v.mentions, v.runs, v.prompts, "brand0", 2)


_SUMMARY = f"""summary AS (SELECT p.prompt_id, p.project_id, p.name, count(r.run_id) AS run_count, max(r.started_at) AS last_run_at,
  CASE WHEN count(r.run_id) > 0 THEN count(*) FILTER (WHERE r.status = 'ok')::DOUBLE / count(r.run_id) END AS success_rate,
  avg(date_diff('microsecond', r.started_at, r.finished_at) / 1000.0) FILTER (WHERE r.status = 'ok') AS avg_latency_ms,
  list_sort(list_distinct(list(r.provider) FILTER (WHERE r.run_id IS NOT NULL))) AS providers
  FROM prompts p LEFT JOIN (SELECT * FROM base WHERE {_W}) r ON r.prompt_id = p.prompt_id GROUP BY ALL)"""


@query("run_summary", "A-13 J-3", sql(f"""WITH {_SUMMARY} SELECT prompt_id, project_id, name, run_count, {t('last_run_at')} AS last_run_at, {r('success_rate')} AS success_rate,
  {r('avg_latency_ms')} AS avg_latency_ms, coalesce({lst('providers')}, '') AS providers FROM summary""", "base"))
def _(v):
    return R.run_summary(v.runs, v.prompts, "2024-01-17 00:00:00")


@query("overview_totals", "A-21", sql(f"""WITH {_SUMMARY} SELECT project_id, sum(run_count)::BIGINT AS runs,
  {r('coalesce(sum(success_rate * run_count) / sum(run_count) FILTER (WHERE success_rate IS NOT NULL), 0)')} AS success_rate,
  {r('coalesce(sum(avg_latency_ms * run_count) / sum(run_count) FILTER (WHERE avg_latency_ms IS NOT NULL), 0)')} AS avg_latency_ms FROM summary GROUP BY ALL""", "base"))
def _(v):
    totals, _ = V.overview(R.run_summary(v.runs, v.prompts, "2024-01-17 00:00:00"), V.visibility_matrix(v.runs, v.prompts, v.mentions, *_BRAND_ARGS))
    return totals


@query("overview_providers", "A-21", sql(f"""WITH m AS ({_MATRIX.replace(r('avg(rank)'), 'avg(rank)')})
  SELECT project_id, provider_identity, sum(run_count)::BIGINT AS runs, sum(mention_count)::BIGINT AS mentions,
  {r('coalesce(sum(avg_rank * run_count) / sum(run_count) FILTER (WHERE avg_rank IS NOT NULL), 0)')} AS avg_rank,
  {r('sum(mention_count)::DOUBLE / sum(run_count)')} AS presence FROM m GROUP BY ALL""", "ranked"))
def _(v):
    _, providers = V.overview(R.run_summary(v.runs, v.prompts, "2024-01-17 00:00:00"), V.visibility_matrix(v.runs, v.prompts, v.mentions, *_BRAND_ARGS))
    return providers


@query("bucket_series", "A-22", sql(f"""WITH p AS (SELECT project_id, CAST(started_at AS DATE) AS day, provider_identity, avg(rank) AS a, count(rank)::DOUBLE / count(*) AS b
  FROM ranked WHERE {_W} AND status = 'ok' GROUP BY ALL) SELECT project_id, {d('day')} AS day, {r('avg(a)')} AS mean_rank, {r('avg(b)')} AS mean_presence FROM p GROUP BY ALL""", "ranked"))
def _(v):
    return V.bucket_series(V.visibility_trend_all(v.runs, v.prompts, v.mentions, *_BRAND_ARGS))


_DAILY_VALUE = "WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(value) AS value FROM events GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) - 1 AS x FROM s)"


@query("trend_rollup", "A-40 X-U1", f"""{_DAILY_VALUE}, a AS (SELECT user_id, count(*) AS count, min(value) AS lo, max(value) AS hi, avg(value) AS mean, coalesce(regr_slope(value, x), 0) AS slope FROM n GROUP BY ALL)
  SELECT user_id, count, round(lo, 4) AS min, round(hi, 4) AS max, round(mean, 4) AS mean, round(CASE WHEN isnan(slope) THEN 0 ELSE slope END, 4) AS slope,
  CASE WHEN slope > 1e-9 AND NOT isnan(slope) THEN 'rising' WHEN slope < -1e-9 THEN 'falling' ELSE 'flat' END AS direction FROM a""")
def _(v):
    daily = v.table("events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("value"))
    return V.trend_rollup(daily, ["user_id"], "day")


# --- runs --------------------------------------------------------------------------------------


@query("recent_runs", "P-6 J-1", sql(f"""SELECT run_id, prompt_id, prompt, project_id, provider_identity, {t('started_at')} AS started_at, {t('finished_at')} AS finished_at, status
  FROM base WHERE project_id = 1 ORDER BY base.started_at DESC, run_id LIMIT 200 OFFSET 10""", "base"))
def _(v):
    return R.list_runs(v.runs, v.prompts, 200, 10, project_id=1)


@query("sql_run_cost", "X-U3 F-17", sql(f"""SELECT p AS provider, count(*) AS runs, CASE WHEN p IS NULL THEN NULL ELSE {r('any_value(CASE p ' + ' '.join(f"WHEN '{n}' THEN {K.TOKENS_PER_RUN * float(x) / 1e6:.10f}" for n, x in K.PROVIDER_PRICES.items()) + ' ELSE 0 END)')} END AS usd
  FROM (SELECT CASE WHEN run_id % 13 > 0 THEN provider END AS p FROM runs) GROUP BY 1""", "runs"))
def _(v):
    S.register_sql_functions(v.spark)
    some = v.runs.select(F.when(F.col("run_id") % 13 > 0, F.col("provider")).alias("provider"))
    return some.groupBy("provider", F.expr("run_cost_usd(provider)").alias("usd")).agg(F.count("*").alias("runs"))


@query("kpi_trend", "A-12 F-7", sql(f"""SELECT project_id, {t("date_trunc('hour', started_at)")} AS bucket, count(*) AS runs, {r("count(*) FILTER (WHERE status = 'ok')::DOUBLE / count(*)")} AS success_rate,
  {r("avg(date_diff('microsecond', started_at, finished_at) / 1000.0) FILTER (WHERE status = 'ok')")} AS avg_latency_ms
  FROM base WHERE started_at >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY ALL""", "base"))
def _(v):
    return R.kpi_trend(v.runs, v.prompts, AS_OF, 168)


@query("tag_summary", "A-14 J-5 F-16", sql(f"""WITH x AS (SELECT project_id, unnest(tags) AS tag, prompt_id FROM prompts)
  SELECT x.project_id, tag, count(DISTINCT x.prompt_id) AS prompt_count, count(b.run_id) AS run_count,
  {r("CASE WHEN count(b.run_id) > 0 THEN count(*) FILTER (WHERE b.status = 'ok')::DOUBLE / count(b.run_id) END")} AS success_rate,
  coalesce({lst('list_sort(list_distinct(list(b.provider) FILTER (WHERE b.run_id IS NOT NULL)))')}, '') AS providers
  FROM x LEFT JOIN (SELECT * FROM base WHERE {_W}) b ON b.prompt_id = x.prompt_id GROUP BY ALL""", "base"))
def _(v):
    return R.tag_summary(v.runs, v.prompts, "2024-01-17 00:00:00")


@query("runs_by_prompt", "J-3", sql(f"""SELECT p.prompt_id, p.project_id, r.run_id, r.provider FROM prompts p LEFT JOIN (SELECT * FROM runs WHERE {_W}) r ON r.prompt_id = p.prompt_id""", "prompts", "runs"))
def _(v):
    return V.runs_by_prompt(v.prompts, v.runs, "2024-01-17 00:00:00").select("prompt_id", "project_id", "run_id", "provider")


@query("runs_by_tag", "J-5", sql(f"""SELECT x.project_id, x.tag, x.prompt_id, count(r.run_id) AS runs FROM (SELECT project_id, prompt_id, unnest(tags) AS tag FROM prompts) x
  LEFT JOIN (SELECT * FROM runs WHERE {_W}) r ON r.prompt_id = x.prompt_id GROUP BY ALL""", "prompts", "runs"))
def _(v):
    return R.runs_by_tag(v.prompts, v.runs, "2024-01-17 00:00:00").groupBy("project_id", "tag", "prompt_id").agg(F.count("run_id").alias("runs"))


@query("run_totals", "A-41", sql("SELECT count(*) AS total, count(*) FILTER (WHERE status = 'ok') AS succeeded, count(*) FILTER (WHERE status = 'failed') AS failed FROM runs", "runs"))
def _(v):
    return R.run_totals(v.runs)


@query("run_detail_mentions", "P-14", sql("""SELECT m.run_id, m.entity, m.rank, b.provider_identity FROM mentions m JOIN base b ON b.run_id = m.run_id WHERE b.status = 'failed'""", "mentions", "base"))
def _(v):
    failed = v.runs.filter(F.col("status") == "failed").select("run_id")
    runs = v.runs.withColumn("raw_response", F.lit("{}"))
    return R.run_detail(failed, runs, v.mentions, v.citations, v.provenance)[0].select("run_id", "entity", "rank", "provider_identity")


@query("run_detail_citations", "P-14", sql("""SELECT c.run_id, c.domain, c.url, c.frequency, b.provider_identity FROM citations c JOIN base b ON b.run_id = c.run_id WHERE b.status = 'failed'""", "citations", "base"))
def _(v):
    failed = v.runs.filter(F.col("status") == "failed").select("run_id")
    runs = v.runs.withColumn("raw_response", F.lit("{}"))
    return R.run_detail(failed, runs, v.mentions, v.citations, v.provenance)[1].select("run_id", "domain", "url", "frequency", "provider_identity")


@query("run_detail_steps", "P-14", sql(f"""SELECT s.run_id, s.step, s.status, {t('s.step_at')} AS step_at, b.provider_identity FROM provenance s JOIN base b ON b.run_id = s.run_id WHERE b.status = 'failed'""", "provenance", "base"))
def _(v):
    failed = v.runs.filter(F.col("status") == "failed").select("run_id")
    runs = v.runs.withColumn("raw_response", F.lit("{}"))
    return R.run_detail(failed, runs, v.mentions, v.citations, v.provenance)[2].select("run_id", "step", "status", "step_at", "provider_identity")


@query("run_detail_responses", "P-14", sql("""SELECT b.run_id, b.provider_identity, r.provider, r.model, b.status, '{"props":' || e.props || '}' AS raw_response FROM base b JOIN runs r USING (run_id)
  JOIN events e ON e.event_id = b.run_id WHERE b.status = 'failed'""", "base", "runs"))
def _(v):
    """The response frame of each failed run, here the props of its event."""
    frames = v.table("events").select(F.col("event_id").alias("run_id"), F.concat(F.lit('{"props":'), "props", F.lit("}")).alias("raw_response"))
    failed = v.runs.filter(F.col("status") == "failed").select("run_id")
    return R.run_detail(failed, v.runs.join(frames, "run_id"), v.mentions, v.citations, v.provenance)[3]


@query("provenance_per_run", "A-43", sql("SELECT run_id, count(*) AS steps FROM provenance GROUP BY 1", "provenance"))
def _(v):
    return R.provenance_summary(v.provenance, v.runs)[0]


@query("provenance_by_step", "A-43", sql("""SELECT step, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'error') AS error,
  count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) AS total FROM provenance GROUP BY 1""", "provenance"))
def _(v):
    return R.provenance_summary(v.provenance, v.runs)[1]


@query("failed_runs_by_error", "A-43", sql("SELECT error_kind, count(*) AS failed_runs FROM runs WHERE status = 'failed' GROUP BY 1", "runs"))
def _(v):
    return R.provenance_summary(v.provenance, v.runs)[2]


@query("tool_latency", "A-36", sql(f"""SELECT tool_name, count(*) AS total, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'error') AS error,
  {r("count(*) FILTER (WHERE status = 'error')::DOUBLE / count(*)")} AS error_rate, {r('quantile_cont(latency_ms, 0.5)')} AS p50, {r('quantile_cont(latency_ms, 0.95)')} AS p95 FROM tool_calls GROUP BY 1""", "tool_calls"))
def _(v):
    return R.latency_stats(v.tool_calls)


@query("status_throughput", "A-37", sql("""SELECT count(*) FILTER (WHERE status = 'verified') AS verified, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'revoked') AS revoked,
  count(*) FILTER (WHERE status = 'expired') AS expired, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) AS total FROM attempts WHERE created_at >= TIMESTAMP '2024-01-24 00:00:00'""", "attempts"))
def _(v):
    return R.status_throughput(v.attempts, AS_OF, 168, ["verified", "failed", "revoked", "expired", "pending"])


@query("schedule_freshness", "A-46", sql(f"""SELECT s.schedule_id, s.project_id, {t('max(k.tick_ts)')} AS last_tick_at, max_by(k.status, strftime(k.tick_ts, '%Y-%m-%d %H:%M:%S') || k.status) AS last_tick_status
  FROM schedules s LEFT JOIN ticks k ON k.schedule_id = s.schedule_id GROUP BY 1, 2""", "schedules", "ticks"))
def _(v):
    return R.freshness(v.schedules, v.ticks, v.projects, AS_OF)[0]


@query("project_freshness", "A-46", sql("""SELECT p.project_id, CAST(epoch(TIMESTAMP '2024-01-31 00:00:00' - max(k.tick_ts)) AS BIGINT) AS last_run_age_s FROM projects p
  LEFT JOIN schedules s ON s.project_id = p.project_id LEFT JOIN ticks k ON k.schedule_id = s.schedule_id WHERE p.archived_at IS NULL GROUP BY 1""", "projects", "schedules", "ticks"))
def _(v):
    return R.freshness(v.schedules, v.ticks, v.projects, AS_OF)[1]


@query("table_freshness", "A-46", sql(f"""SELECT 'runs' AS table_name, count(*) AS rows, {t('max(created_at)')} AS last_write FROM runs
  UNION ALL SELECT 'tool_calls', count(*), {t('max(called_at)')} FROM tool_calls UNION ALL SELECT 'consent', count(*), {t('max(created_at)')} FROM consent""", "runs", "tool_calls", "consent"))
def _(v):
    return R.table_freshness({"runs": (v.runs, "created_at"), "tool_calls": (v.tool_calls, "called_at"), "consent": (v.consent, "created_at")})


_REP = "count(*) AS total, count(*) FILTER (WHERE status = 'ok') AS succeeded, count(*) FILTER (WHERE status = 'failed') AS failed"
_REPW = "WHERE started_at >= TIMESTAMP '2024-01-24 00:00:00' AND started_at <= TIMESTAMP '2024-01-31 00:00:00'"


@query("window_report", "A-49", sql(f"""SELECT provider, NULL AS prompt, 'provider' AS level, {_REP} FROM base {_REPW} GROUP BY provider UNION ALL
  SELECT NULL, prompt, 'prompt', {_REP} FROM base {_REPW} GROUP BY prompt UNION ALL SELECT NULL, NULL, 'all', {_REP} FROM base {_REPW}""", "base"))
def _(v):
    return R.report(v.runs, v.prompts, AS_OF, "7d")


@query("window_report_sentiment", "A-49 A-15", sql(f"""WITH s AS (SELECT b.project_id, b.prompt_id, b.prompt, b.provider, m.entity, CAST(b.started_at AS DATE) AS day, count(*) FILTER (WHERE sentiment_label = 'positive') AS positive,
  count(*) FILTER (WHERE sentiment_label = 'neutral') AS neutral, count(*) FILTER (WHERE sentiment_label = 'negative') AS negative, count(*) AS total, coalesce(avg(sentiment_score), 50) AS a
  FROM mentions m JOIN base b ON b.run_id = m.run_id WHERE started_at >= TIMESTAMP '2024-01-24 00:00:00' AND sentiment_label IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6)
  SELECT project_id, prompt_id, prompt, provider, entity, {d('day')} AS day, total, {r('a')} AS avg_score, {r('positive::DOUBLE / total')} AS positive_share,
  {r('neutral::DOUBLE / total')} AS neutral_share, {r('negative::DOUBLE / total')} AS negative_share FROM s""", "mentions", "base"))
def _(v):
    return R.report_sentiment(v.runs, v.prompts, v.mentions, AS_OF, "7d").drop("positive", "neutral", "negative")


@query("org_usage", "A-39", sql("""WITH u AS (SELECT org_id, count(*) AS n FROM runs WHERE created_at >= TIMESTAMP '2024-01-30 00:00:00' AND org_id IS NOT NULL GROUP BY 1),
  b AS (SELECT org_id, count(DISTINCT project_id) AS n FROM projects GROUP BY 1), m AS (SELECT 'org-' || (c_nationkey % 6) AS org_id, count(DISTINCT c_custkey) AS n FROM customer GROUP BY 1)
  SELECT org_id, coalesce(u.n, 0) AS runs_today, coalesce(b.n, 0) AS brands, coalesce(m.n, 0) AS members FROM b FULL JOIN m USING (org_id) FULL JOIN u USING (org_id)""", "runs", "projects"))
def _(v):
    members = v.table("customer").select(F.concat(F.lit("org-"), (F.col("c_nationkey") % 6).cast("string")).alias("org_id"), F.col("c_custkey").alias("user_id"))
    return R.org_usage(v.runs, v.prompts, v.projects, members, "2024-01-30 12:00:00")


# --- citations ---------------------------------------------------------------------------------

_CB = f"cb AS (SELECT b.project_id, b.run_id, b.provider, b.provider_identity, b.prompt, b.started_at, b.status, c.domain, c.frequency, c.source_type FROM base b JOIN citations c ON c.run_id = b.run_id WHERE {_W})"


def _modal(null_ok: bool) -> str:
    votes = "count(*)" if null_ok else "count(source_type)"
    return f"""modal AS (SELECT project_id, domain, source_type, {votes} AS n FROM cb GROUP BY 1, 2, 3
      QUALIFY row_number() OVER (PARTITION BY project_id, domain ORDER BY n DESC, source_type NULLS LAST) = 1)"""


_SUM = "tot AS (SELECT project_id, domain, sum(frequency)::BIGINT AS frequency FROM cb GROUP BY 1, 2)"


@query("citation_summary", "A-5 T-3 T-4", sql(f"""WITH {_CB}, {_modal(True)}, {_SUM} SELECT t.project_id, t.domain, t.frequency, m.source_type FROM tot t JOIN modal m USING (project_id, domain)
  QUALIFY row_number() OVER (PARTITION BY t.project_id ORDER BY t.frequency DESC, t.domain) <= 50""", "base", "citations"))
def _(v):
    return C.citation_summary(v.runs, v.prompts, v.citations, AS_OF, DAYS, 50)


@query("citation_summary_typed", "A-5 P-4", sql(f"""WITH {_CB.replace('WHERE ', "WHERE b.provider = 'openai' AND ")}, {_modal(False)}, {_SUM} SELECT t.project_id, t.domain, t.frequency, m.source_type
  FROM tot t JOIN modal m USING (project_id, domain)""", "base", "citations"))
def _(v):
    return C.citation_summary(v.runs, v.prompts, v.citations, AS_OF, DAYS, None, null_is_value=False, provider="openai")


@query("domains_by_type", "A-42", sql(f"""WITH {_CB}, {_modal(True)}, {_SUM} SELECT t.project_id, coalesce(m.source_type, 'unknown') AS source_type, count(*) AS domains, sum(t.frequency)::BIGINT AS frequency
  FROM tot t JOIN modal m USING (project_id, domain) GROUP BY 1, 2""", "base", "citations"))
def _(v):
    return C.domains_by_type(C.citation_summary(v.runs, v.prompts, v.citations, AS_OF, DAYS, None))


@query("citation_sample_runs", "A-6 K-2", sql(f"""WITH {_CB}, u AS (SELECT DISTINCT project_id, domain, run_id FROM cb QUALIFY row_number() OVER (PARTITION BY project_id, domain ORDER BY run_id) >= 1),
  k AS (SELECT *, row_number() OVER (PARTITION BY project_id, domain ORDER BY run_id) AS rn FROM (SELECT DISTINCT project_id, domain, run_id FROM cb))
  SELECT project_id, domain, {lst('list(run_id ORDER BY run_id)')} AS sample_run_ids FROM k WHERE rn <= 5 GROUP BY 1, 2""", "base", "citations"))
def _(v):
    return C.sample_runs(v.runs, v.prompts, v.citations, AS_OF, DAYS)


@query("citation_providers", "A-7", sql(f"WITH {_CB} SELECT project_id, provider_identity, sum(frequency)::BIGINT AS frequency FROM cb GROUP BY 1, 2", "base", "citations"))
def _(v):
    return C.provider_breakdown(v.runs, v.prompts, v.citations, AS_OF, DAYS)


@query("citation_growth", "A-8", sql(f"""WITH g AS (SELECT b.project_id, coalesce(sum(c.frequency) FILTER (WHERE {_W}), 0)::BIGINT AS current, coalesce(sum(c.frequency) FILTER (WHERE NOT ({_W})), 0)::BIGINT AS prior
  FROM base b JOIN citations c ON c.run_id = b.run_id WHERE started_at >= TIMESTAMP '2024-01-03 00:00:00' GROUP BY 1)
  SELECT *, {r('CASE WHEN prior > 0 THEN (current - prior)::DOUBLE / prior END')} AS growth_rate FROM g""", "base", "citations"))
def _(v):
    return C.growth_rate(v.runs, v.prompts, v.citations, AS_OF, DAYS)


@query("citation_score", "A-9 F-19", sql(f"""WITH {_CB}, a AS (SELECT project_id, sum(frequency)::BIGINT AS total, count(DISTINCT domain) AS distinct_domains,
  coalesce(sum(frequency) FILTER (WHERE source_type IS NULL OR source_type NOT IN ('reddit', 'youtube')), 0) AS q FROM cb GROUP BY 1),
  s AS (SELECT *, least(total / 100.0, 1.0) * 40.0 AS v, least(distinct_domains / 30.0, 1.0) * 30.0 AS dv, q::DOUBLE / total AS sh FROM a)
  SELECT project_id, total, distinct_domains, round(sh, 3) AS quality_share, round(v::DOUBLE, 1) AS volume_component, round(dv::DOUBLE, 1) AS diversity_component,
  round(sh * 30.0, 1) AS quality_component, round(v::DOUBLE + dv::DOUBLE + sh * 30.0, 1) AS score FROM s""", "base", "citations"))
def _(v):
    return C.citation_score(v.runs, v.prompts, v.citations, AS_OF, DAYS)


@query("citation_trend", "A-10 J-4", sql(f"""WITH x AS (SELECT b.project_id, c.domain, date_trunc('hour', b.started_at) AS bucket, sum(c.frequency)::BIGINT AS frequency FROM base b JOIN citations c ON c.run_id = b.run_id
  WHERE b.started_at >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY ALL), top AS (SELECT project_id, domain FROM x GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY sum(frequency) DESC, domain) <= 10)
  SELECT x.project_id, x.domain, {t('x.bucket')} AS bucket, x.frequency FROM x SEMI JOIN top USING (project_id, domain)""", "base", "citations"))
def _(v):
    return C.citation_trend(v.runs, v.prompts, v.citations, AS_OF, 168, 10)


_EDGES = f"""{_CB}, e AS (SELECT project_id, provider_identity AS source, domain AS target, sum(greatest(frequency, 1))::BIGINT AS weight FROM cb WHERE status = 'ok' GROUP BY 1, 2, 3
  QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY weight DESC, source, target) <= 5000)"""


@query("citation_graph_edges", "A-11", sql(f"WITH {_EDGES} SELECT * FROM e", "base", "citations"))
def _(v):
    return C.citation_graph(v.runs, v.prompts, v.citations, AS_OF, DAYS)[0]


@query("citation_graph_nodes", "A-11", sql(f"""WITH {_EDGES}, n AS (SELECT project_id, 'provider' AS kind, source AS label FROM e UNION SELECT project_id, 'domain', target FROM e)
  SELECT project_id, kind || ':' || label AS id, kind, label FROM n""", "base", "citations"))
def _(v):
    return C.citation_graph(v.runs, v.prompts, v.citations, AS_OF, DAYS)[1]


@query("citations_in_window", "J-4", sql(f"SELECT domain, count(*) AS n FROM citations SEMI JOIN (SELECT run_id FROM runs WHERE {_W}) USING (run_id) GROUP BY 1", "citations", "runs"))
def _(v):
    return C.in_window(v.citations, S.window_filter(v.runs, AS_OF, DAYS)).groupBy("domain").agg(F.count("*").alias("n"))


@query("merged_citations", "U-1", sql("""SELECT run_id, domain, url, sum(frequency)::BIGINT AS frequency, min(source_type) AS source_type FROM
  (SELECT run_id, domain, url, frequency, source_type FROM citations UNION ALL SELECT run_id, domain, NULL, 1, 'docs' FROM citations) GROUP BY 1, 2, 3""", "citations"))
def _(v):
    a = v.citations.select("run_id", "domain", "url", "frequency", "source_type")
    b = v.citations.select("run_id", "domain", F.lit(None).cast("string").alias("url"), F.lit(1).alias("frequency"), F.lit("docs").alias("source_type"))
    return C.merge_citations(a, b)


_DRIFT = """dr AS (SELECT b.project_id, c.domain, CASE WHEN bool_or(b.started_at < TIMESTAMP '2024-01-17') AND bool_or(b.started_at >= TIMESTAMP '2024-01-17') THEN 'kept'
  WHEN bool_or(b.started_at < TIMESTAMP '2024-01-17') THEN 'dropped' ELSE 'gained' END AS change FROM base b JOIN citations c ON c.run_id = b.run_id
  WHERE b.started_at >= TIMESTAMP '2024-01-03' AND b.started_at <= TIMESTAMP '2024-01-31' GROUP BY 1, 2)"""


@query("domain_drift", "W-10 U-2", sql(f"WITH {_DRIFT} SELECT * FROM dr", "base", "citations"))
def _(v):
    return C.domain_drift(v.citations, v.runs, v.prompts, AS_OF, DAYS)


@query("domain_drift_distance", "W-10", sql(f"""WITH {_DRIFT} SELECT project_id, count(*) FILTER (WHERE change = 'gained') AS gained, count(*) FILTER (WHERE change = 'dropped') AS dropped,
  count(*) AS "union", {r("count(*) FILTER (WHERE change <> 'kept')::DOUBLE / count(*)")} AS distance FROM dr GROUP BY 1""", "base", "citations"))
def _(v):
    return C.drift_distance(C.domain_drift(v.citations, v.runs, v.prompts, AS_OF, DAYS))


@query("domain_set_sizes", "U-2", sql(f"""WITH a AS (SELECT DISTINCT b.project_id, c.domain FROM base b JOIN citations c ON c.run_id = b.run_id WHERE b.provider = 'openai'),
  z AS (SELECT DISTINCT b.project_id, c.domain FROM base b JOIN citations c ON c.run_id = b.run_id WHERE b.provider = 'gemini'),
  f AS (SELECT coalesce(a.project_id, z.project_id) AS project_id, a.domain AS x, z.domain AS y FROM a FULL JOIN z ON a.project_id = z.project_id AND a.domain = z.domain)
  SELECT project_id, count(*) FILTER (WHERE x = y) AS intersection, count(*) AS "union", count(*) FILTER (WHERE y IS NULL) AS only_a, count(*) FILTER (WHERE x IS NULL) AS only_b,
  {r("1 - count(*) FILTER (WHERE x = y)::DOUBLE / count(*)")} AS distance FROM f GROUP BY 1""", "base", "citations"))
def _(v):
    cited = V.base_runs(v.runs, v.prompts).select("run_id", "project_id", "provider").join(C.run_domains(v.citations).select("run_id", "domain"), "run_id")
    side = lambda p: cited.filter(F.col("provider") == p).select("project_id", "domain")
    return C.set_sizes(C.set_overlap(side("openai"), side("gemini"), "domain", ("project_id",)), ("project_id",))


def _diff(cols: str, src: str) -> str:
    on = " AND ".join(f"x.{c.strip()} IS NOT DISTINCT FROM p.{c.strip()}" for c in cols.split(","))
    return f"""WITH pr AS (SELECT run_id, lag(run_id) OVER (PARTITION BY prompt_id, provider ORDER BY started_at, run_id) AS prior_run_id FROM runs), s AS (SELECT DISTINCT run_id, {src}),
  now AS (SELECT pr.run_id, pr.prior_run_id, {cols} FROM pr JOIN s USING (run_id) WHERE prior_run_id IS NOT NULL), old AS (SELECT pr.run_id, pr.prior_run_id, {cols} FROM pr JOIN s ON s.run_id = pr.prior_run_id)
  SELECT x.*, 'added' AS change FROM now x ANTI JOIN old p ON x.run_id = p.run_id AND {on} UNION ALL SELECT x.*, 'dropped' FROM old x ANTI JOIN now p ON x.run_id = p.run_id AND {on}"""


@query("run_diff_mentions", "J-6", sql(_diff("entity, is_brand", "lower(entity) AS entity, is_brand FROM mentions"), "runs", "mentions"))
def _(v):
    return C.diff_runs(v.mentions, v.citations, v.runs)[0]


@query("run_diff_citations", "J-6", sql(_diff("domain, url", "domain, url FROM citations"), "runs", "citations"))
def _(v):
    return C.diff_runs(v.mentions, v.citations, v.runs)[1]


@query("leaderboard", "A-32 J-7 K-1", sql("""WITH t AS (SELECT domain, sum(frequency)::BIGINT AS total FROM citations GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100)
  SELECT t.domain, t.total, row_number() OVER (ORDER BY t.total DESC, t.domain) AS rank, coalesce(e.display_name, t.domain) AS display_name, coalesce(e.claim_status, 'unclaimed') AS claim_status
  FROM t LEFT JOIN entities e USING (domain)""", "citations", "entities"))
def _(v):
    return C.leaderboard(v.citations, v.entities)


@query("domain_profile", "A-33 T-7", sql("""WITH t AS (SELECT domain, sum(frequency)::BIGINT AS total, count(DISTINCT run_id) AS citing_runs FROM citations GROUP BY 1)
  SELECT *, rank() OVER (ORDER BY total DESC) AS rank FROM t""", "citations"))
def _(v):
    return C.domain_profile(v.citations)


# --- brands ------------------------------------------------------------------------------------

_CMP = f"""mm AS (SELECT b.project_id, b.prompt_id, b.prompt, b.provider_identity, m.entity, m.rank FROM mentions m JOIN base b ON b.run_id = m.run_id WHERE {_W} AND status = 'ok' AND m.entity IN ('brand0', 'brand1', 'brand2', 'brand3')),
  g AS (SELECT DISTINCT project_id, prompt_id, prompt, provider_identity FROM mm),
  cmp AS (SELECT g.*, s.subject, min(mm.rank) AS best_rank, count(mm.entity) AS mention_count FROM g CROSS JOIN (VALUES ('brand0'), ('brand1'), ('brand2'), ('brand3')) s(subject)
    LEFT JOIN mm ON mm.prompt_id = g.prompt_id AND mm.provider_identity = g.provider_identity AND mm.entity = s.subject GROUP BY ALL)"""
_SOV = """sov AS (SELECT project_id, subject, sum(mention_count)::BIGINT AS mentions, sum(mention_count)::DOUBLE / sum(sum(mention_count)) OVER (PARTITION BY project_id) AS share FROM cmp GROUP BY 1, 2)"""


def _cmp(v):
    return B.compare_brands(v.runs, v.prompts, v.mentions, AS_OF, DAYS, BRANDS)


@query("compare_brands", "A-16", sql(f"WITH {_CMP} SELECT * FROM cmp", "mentions", "base"))
def _(v):
    return _cmp(v)


@query("share_of_voice", "A-17", sql(f"WITH {_CMP}, {_SOV} SELECT project_id, subject, mentions, {r('share')} AS share FROM sov", "mentions", "base"))
def _(v):
    return B.share_of_voice(_cmp(v))


_WL = """st AS (SELECT project_id, provider_identity, subject, avg(best_rank) AS mr, sum(mention_count) AS mt FROM cmp GROUP BY 1, 2, 3),
  wl AS (SELECT a.project_id, a.provider_identity, a.subject AS competitor, CASE WHEN a.mr IS NOT NULL AND u.mr IS NOT NULL THEN a.mr < u.mr ELSE a.mt > coalesce(u.mt, 0) END AS ahead
    FROM st a LEFT JOIN st u ON u.project_id = a.project_id AND u.provider_identity = a.provider_identity AND u.subject = 'brand0' WHERE a.subject <> 'brand0')"""


@query("win_loss", "A-18", sql(f"WITH {_CMP}, {_WL} SELECT * FROM wl", "mentions", "base"))
def _(v):
    return B.win_loss(_cmp(v), "brand0")[0]


@query("providers_won", "A-18", sql(f"WITH {_CMP}, {_WL} SELECT project_id, competitor, coalesce({lst('list_sort(list(provider_identity) FILTER (WHERE ahead))')}, '') AS wins FROM wl GROUP BY 1, 2", "mentions", "base"))
def _(v):
    return B.win_loss(_cmp(v), "brand0")[1]


_ROSTER = "roster AS (SELECT project_id, n AS name, n = 'brand0' AS is_primary FROM projects, (VALUES ('brand0'), ('brand1'), ('brand2'), ('brand3'), ('brand4'), ('Brand77')) x(n))"
_STATS = """bs AS (SELECT a.project_id, a.name AS brand, count(m.entity) AS mention_count, avg(m.rank) AS avg_rank, list_sort(list_distinct(list(m.provider_identity) FILTER (WHERE m.entity IS NOT NULL))) AS providers
  FROM roster a LEFT JOIN (SELECT b.project_id, b.provider_identity, m.entity, m.rank FROM mentions m JOIN base b ON b.run_id = m.run_id WHERE b.started_at >= TIMESTAMP '2024-01-24') m
  ON m.project_id = a.project_id AND lower(m.entity) IN (lower(a.name), CASE WHEN a.name = 'brand0' THEN 'brand8' ELSE lower(a.name) END) GROUP BY 1, 2)"""


def _roster(v):
    names = F.explode(F.array(*[F.lit(n) for n in [*BRANDS, "brand4", "Brand77"]])).alias("name")
    return v.projects.select("project_id", names).withColumn("is_primary", F.col("name") == "brand0")


def _stats(v):
    own = _roster(v).select("project_id", F.col("name").alias("brand"), F.explode(F.array("name", F.when(F.col("name") == "brand0", F.lit("BRAND8")).otherwise(F.col("name")))).alias("alias"))
    return B.brand_stats(v.mentions, v.runs, v.prompts, own, AS_OF)


@query("brand_stats", "A-20", sql(f"WITH {_ROSTER}, {_STATS} SELECT project_id, brand, mention_count, {r('avg_rank')} AS avg_rank, coalesce({lst('providers')}, '') AS providers FROM bs", "projects", "mentions", "base"))
def _(v):
    return _stats(v)


@query("movers", "A-19", sql(f"""WITH {_CMP}, {_SOV}, {_ROSTER}, {_STATS}, bx AS (SELECT r.*, bs.avg_rank FROM roster r JOIN bs ON bs.project_id = r.project_id AND bs.brand = r.name),
  top AS (SELECT * FROM sov WHERE lower(subject) <> 'brand0' QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY share DESC, subject) <= 6)
  SELECT t.project_id, t.subject AS name, {r('t.share')} AS share, {r('b.avg_rank')} AS avg_rank, false AS is_new FROM top t LEFT JOIN bx b ON b.project_id = t.project_id AND lower(b.name) = lower(t.subject)
  UNION ALL SELECT b.project_id, b.name, 0.0, {r('b.avg_rank')}, true FROM bx b ANTI JOIN sov s ON s.project_id = b.project_id AND lower(s.subject) = lower(b.name) WHERE NOT is_primary""", "projects", "mentions", "base"))
def _(v):
    brands = _roster(v).join(_stats(v).withColumnRenamed("brand", "name"), ["project_id", "name"])
    return B.movers(B.share_of_voice(_cmp(v)), brands, "brand0")


@query("sentiment_points", "A-15", sql(f"""WITH s AS (SELECT b.project_id, b.prompt_id, b.provider, m.entity, CAST(b.started_at AS DATE) AS day, count(*) FILTER (WHERE sentiment_label = 'positive') AS positive,
  count(*) FILTER (WHERE sentiment_label = 'neutral') AS neutral, count(*) FILTER (WHERE sentiment_label = 'negative') AS negative, count(*) AS total, coalesce(avg(sentiment_score), 50) AS a
  FROM mentions m JOIN base b ON b.run_id = m.run_id WHERE {_W} AND sentiment_label IS NOT NULL GROUP BY 1, 2, 3, 4, 5)
  SELECT project_id, prompt_id, provider, entity, {d('day')} AS day, positive, neutral, negative, total, {r('a')} AS avg_score, {r('positive::DOUBLE / total')} AS positive_share,
  {r('neutral::DOUBLE / total')} AS neutral_share, {r('negative::DOUBLE / total')} AS negative_share FROM s""", "mentions", "base"))
def _(v):
    return B.sentiment_points(v.runs, v.prompts, v.mentions, AS_OF, DAYS)


# --- ordering ----------------------------------------------------------------------------------


@query("top_domains", "K-1 K-3", sql("SELECT domain, sum(frequency)::BIGINT AS hits FROM citations GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", "citations"))
def _(v):
    return O.stable_order(O.top_n(v.citations.groupBy("domain").agg(F.sum("frequency").alias("hits")), "hits", 20, ["domain"]), ["domain"])


@query("top_runs_per_prompt", "K-2", sql(f"""SELECT prompt_id, run_id, rn, truncated FROM (SELECT prompt_id, run_id, row_number() OVER (PARTITION BY prompt_id ORDER BY started_at DESC, run_id) AS rn,
  count(*) OVER (PARTITION BY prompt_id) > 50 AS truncated FROM runs) WHERE rn <= 50""", "runs"))
def _(v):
    top = O.top_k_per_group(v.runs, ["prompt_id"], [F.col("started_at").desc(), F.col("run_id")], 50, flag_truncated=True)
    return top.select("prompt_id", "run_id", "rn", "truncated")


@query("recommendation_page", "K-4", sql(f"""SELECT rec_id, kind, {t('generated_at')} AS generated_at FROM recommendations WHERE project_id = 1 AND state NOT IN ('dismissed', 'measured', 'stale') AND (recommendations.generated_at, rec_id) < (TIMESTAMP '2000-01-01 00:00:00', 100)
  ORDER BY recommendations.generated_at DESC, rec_id DESC LIMIT 50""", "recommendations"))
def _(v):
    return RC.active_page(v.recommendations, 1, {"generated_at": "2000-01-01 00:00:00", "rec_id": 100}, 50).select("rec_id", "kind", "generated_at")


@query("due_deliveries", "K-5", sql(f"""SELECT id, webhook_id, {t('next_attempt_at')} AS next_attempt_at FROM deliveries WHERE status = 'pending' AND (next_attempt_at IS NULL OR next_attempt_at <= TIMESTAMP '2024-01-15 00:00:00')
  ORDER BY deliveries.next_attempt_at NULLS FIRST, created_at, id LIMIT 500""", "deliveries"))
def _(v):
    return O.due_queue(v.deliveries, "2024-01-15 00:00:00", 500).select("id", "webhook_id", "next_attempt_at")
