"""Anomaly, recommendation, lifecycle, cost and schedule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.ordering import exact_percentiles
from ..operators import anomaly as A
from ..operators import citations as Ci
from ..operators import cost as Co
from ..operators import recommend as R
from ..operators import visibility as V
from .catalog import d, query, r, t
from .views import AS_OF, sql

# --- anomalies ---------------------------------------------------------------------------------

_WIN = "(PARTITION BY project_id, prompt_id, provider ORDER BY observed_at, run_id ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)"
_VERDICT = f"""w AS (SELECT *, count(*) OVER {_WIN} AS n, count(rank) OVER {_WIN} AS seen, avg(rank) OVER {_WIN} AS m, stddev_pop(rank) OVER {_WIN} AS sd FROM samples),
  j AS (SELECT *, CASE WHEN rank IS NULL AND seen = 14 THEN 'rank_disappeared' WHEN rank IS NULL THEN NULL WHEN seen = 0 THEN 'first_appearance'
    WHEN sd < 1e-9 THEN CASE WHEN abs(rank - m) >= 2 THEN 'constant_window_shift' END WHEN abs((rank - m) / sd) >= 2.0 THEN 'zscore' END AS signal FROM w WHERE n = 14)"""


def _anomaly_sql(samples_from: str) -> str:
    return f"""WITH {samples_from}{_VERDICT} SELECT project_id, prompt_id, provider, {t('observed_at')} AS observed_at, run_id, signal, CAST(rank AS DOUBLE) AS rank,
  {r("CASE WHEN signal = 'zscore' THEN (rank - m) / sd END")} AS z, {r('m')} AS window_mean, {r('sd')} AS window_sd FROM j WHERE signal IS NOT NULL"""


@query("rank_anomalies", "W-1 T-9", sql(_anomaly_sql(""), "samples"))
def _(v):
    return A.visibility_anomalies(v.samples, 14, 2.0)


@query("project_rank_anomalies", "W-1", sql(f"""WITH {_VERDICT.replace('PARTITION BY project_id, prompt_id, provider', 'PARTITION BY project_id')} SELECT project_id, {t('observed_at')} AS observed_at, run_id, signal, CAST(rank AS DOUBLE) AS rank,
  {r("CASE WHEN signal = 'zscore' THEN (rank - m) / sd END")} AS z, {r('m')} AS window_mean, {r('sd')} AS window_sd FROM j WHERE signal IS NOT NULL""", "samples"))
def _(v):
    # Three long series: a small block makes many tasks share each of them.
    return A.visibility_anomalies(v.samples, 14, 2.0, keys=["project_id"], block=64)


@query("citation_novelty", "W-2", sql(f"""WITH sq AS (SELECT project_id, provider, run_id, observed_at, row_number() OVER (PARTITION BY project_id, provider ORDER BY observed_at, run_id) AS seq FROM samples),
  c AS (SELECT sq.*, x.domain, x.n FROM sq JOIN (SELECT run_id, domain, count(*) AS n FROM citations GROUP BY 1, 2) x USING (run_id)),
  l AS (SELECT *, lag(seq) OVER (PARTITION BY project_id, provider, domain ORDER BY seq) AS prev FROM c)
  SELECT project_id, provider, {t('observed_at')} AS observed_at, run_id, domain, n AS frequency FROM l WHERE seq > 14 AND n >= 2 AND (prev IS NULL OR seq - prev > 14)""", "samples", "citations"))
def _(v):
    return A.citation_novelty(v.samples, v.citations, 14, 2, keys=["project_id", "provider"], block=128)


def _feed(fields: str) -> str:
    return f"""WITH one AS (SELECT * FROM anomaly_events WHERE created_at >= TIMESTAMP '2024-01-17' AND event_kind IN ('visibility.anomaly', 'citation.anomaly')
  QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY created_at DESC, delivery_id DESC) = 1), x AS (SELECT *, CASE WHEN field IN ({fields}) THEN v ELSE 0 END::DOUBLE AS delta FROM one)
  SELECT event_id, project_id, CASE event_kind WHEN 'visibility.anomaly' THEN 'visibility_drop' ELSE 'citation_loss' END AS kind, prompt, provider, {t('created_at')} AS detected_at, {r('delta')} AS delta,
  CASE WHEN abs(delta) >= 4 THEN 'high' WHEN abs(delta) >= 2.5 THEN 'medium' ELSE 'low' END AS severity FROM x"""


@query("anomaly_feed", "W-3 F-11 T-13", sql(_feed("'z', 'delta', 'novel_count'"), "anomaly_events"))
def _(v):
    return A.anomaly_feed(v.anomaly_events, AS_OF, 14)


@query("anomaly_feed_by_frequency", "W-3 T-13", sql(_feed("'z', 'delta', 'novel_count', 'frequency'"), "anomaly_events"))
def _(v):
    return A.anomaly_feed(v.anomaly_events, AS_OF, 14, frequency_counts=True)


@query("failure_streaks", "W-6", sql("""WITH n AS (SELECT webhook_id, status, row_number() OVER (PARTITION BY webhook_id ORDER BY created_at DESC, id DESC) AS rn FROM deliveries)
  SELECT webhook_id, coalesce(min(rn) FILTER (WHERE status <> 'dropped') - 1, count(*)) AS streak FROM n GROUP BY 1""", "deliveries"))
def _(v):
    return A.failure_streak(v.deliveries)


# --- recommendations ---------------------------------------------------------------------------

_CFG = """cfg AS (SELECT project_id, 'd' || (project_id + 1) || '.example.com' AS docs_domain, project_id < 2 AS opted_in FROM projects),
  rv AS (SELECT project_id, 'brand' || (i + 1) AS name, 'd' || (project_id + 10 + i) || '.example.com' AS docs_domain FROM projects, (VALUES (0), (1), (2)) x(i))"""
_FACTS = f"""{_CFG}, bw AS (SELECT * FROM base WHERE started_at >= TIMESTAMP '2024-01-17' AND started_at <= TIMESTAMP '2024-01-31' AND status = 'ok'),
  bm AS (SELECT run_id, entity, min(rank) AS rank FROM mentions GROUP BY 1, 2), tm AS (SELECT bw.project_id, bw.prompt_id, bw.provider, bm.entity, bm.rank FROM bw JOIN bm USING (run_id)),
  br AS (SELECT prompt_id, avg(rank) AS mr FROM tm WHERE entity = 'brand0' GROUP BY 1),
  cr AS (SELECT prompt_id, entity AS competitor, avg(rank) AS mr FROM tm WHERE entity IN ('brand1', 'brand2', 'brand3') GROUP BY 1, 2),
  pv AS (SELECT b.prompt_id, b.provider, avg(m.rank) AS mr FROM (SELECT DISTINCT prompt_id, provider FROM bw) b LEFT JOIN (SELECT * FROM tm WHERE entity = 'brand0') m USING (prompt_id, provider) GROUP BY 1, 2),
  dm AS (SELECT DISTINCT bw.project_id, bw.prompt_id, c.domain FROM bw JOIN citations c USING (run_id)),
  fx AS (SELECT p.project_id, p.prompt_id, p.prompt, p.n_runs, br.mr AS brand_mean_rank, (SELECT count(*) FROM dm WHERE dm.prompt_id = p.prompt_id) AS domain_count,
    EXISTS (SELECT 1 FROM dm JOIN cfg USING (project_id) WHERE dm.prompt_id = p.prompt_id AND dm.domain = cfg.docs_domain) AS own_docs_cited,
    coalesce((SELECT string_agg(DISTINCT dm.domain, '|' ORDER BY dm.domain) FROM dm JOIN rv ON rv.project_id = dm.project_id AND rv.docs_domain = dm.domain WHERE dm.prompt_id = p.prompt_id), '') AS competitor_docs
    FROM (SELECT project_id, prompt_id, prompt, count(*) AS n_runs FROM bw GROUP BY 1, 2, 3) p LEFT JOIN br USING (prompt_id))"""
_SRC = ("projects", "base", "mentions", "citations")


def _facts(v):
    return R.assemble_facts(v.runs, v.prompts, v.mentions, v.citations, v.brand_config, AS_OF)


@query("recommendation_facts", "R-0 T-11", sql(f"""WITH {_FACTS}, ids AS (SELECT prompt_id, run_id, row_number() OVER (PARTITION BY prompt_id ORDER BY run_id) AS rn FROM bw)
  SELECT project_id, fx.prompt_id, prompt, n_runs, {r('brand_mean_rank')} AS brand_mean_rank, domain_count, own_docs_cited, competitor_docs, (SELECT string_agg(run_id, '|' ORDER BY rn) FROM ids WHERE ids.prompt_id = fx.prompt_id AND rn <= 50) AS run_ids,
  n_runs > 50 AS run_ids_truncated FROM fx""", *_SRC))
def _(v):
    return _facts(v).select("project_id", "prompt_id", "prompt", "n_runs", "brand_mean_rank", "domain_count", "own_docs_cited", "competitor_docs", "run_ids", "run_ids_truncated")


@query("provider_rank_facts", "R-0", sql(f"WITH {_FACTS} SELECT prompt_id, provider, {r('mr')} AS mean_rank, mr IS NOT NULL AS cited FROM pv", *_SRC))
def _(v):
    return _facts(v).select("prompt_id", F.inline("provider_ranks"))


def _rec(kind: str, severity: str, confidence: str, identity: str, frm: str) -> str:
    return f"""SELECT project_id, '{kind}' AS kind, '{severity}' AS severity, '{confidence}' AS confidence, {identity} AS identity,
  left(sha256('{kind}|' || project_id || '|' || {identity}), 32) AS rec_id FROM {frm}"""


_KEEP = ["project_id", "kind", "severity", "confidence", "identity", "rec_id"]


def _sealed(rows):
    return R.envelope(rows, "1.0", "14d", AS_OF).select(*_KEEP)


_DOCS = _rec(R.KINDS[0], "medium", "high", "CAST(prompt_id AS VARCHAR)", "fx JOIN cfg USING (project_id) WHERE n_runs >= 5 AND NOT own_docs_cited AND competitor_docs <> ''")
_OUT = _rec(R.KINDS[1], "high", "high", "prompt_id || '|' || competitor", """(SELECT fx.project_id, fx.prompt_id, cr.competitor FROM fx JOIN cr USING (prompt_id) WHERE fx.brand_mean_rank > 3 AND fx.brand_mean_rank - cr.mr >= 2
  QUALIFY row_number() OVER (PARTITION BY fx.prompt_id ORDER BY cr.mr, cr.competitor) = 1)""")
_BLIND = _rec(R.KINDS[4], "medium", "high", "prompt_id || '|' || provider", """(SELECT fx.project_id, fx.prompt_id, pv.provider FROM fx JOIN pv USING (prompt_id) WHERE pv.mr <= 3
  QUALIFY row_number() OVER (PARTITION BY fx.prompt_id ORDER BY pv.provider) = 1)""")


@query("docs_not_cited", "R-1 R-8", sql(f"WITH {_FACTS} {_DOCS}", *_SRC))
def _(v):
    return _sealed(R.rule_docs_not_cited(_facts(v), v.brand_config))


@query("sealed_docs_not_cited", "R-8 R-1", sql(f"""WITH {_FACTS}, c AS (SELECT project_id, CAST(prompt_id AS VARCHAR) AS prompt_id, docs_domain, prompt, string_split(competitor_docs, '|') AS docs,
    (SELECT min(provider) FROM pv WHERE pv.prompt_id = fx.prompt_id) AS provider FROM fx JOIN cfg USING (project_id) WHERE n_runs >= 5 AND NOT own_docs_cited AND competitor_docs <> ''),
  p AS (SELECT *, CAST(to_json({{'affected_prompt_id': prompt_id, 'affected_provider': provider, 'competitor_docs_present': docs}}) AS VARCHAR) AS payload FROM c)
  SELECT project_id, left(sha256('{R.KINDS[0]}|' || project_id || '|' || prompt_id), 32) AS rec_id,
    'sha256:' || sha256(CAST(to_json({{'engine_version': '1.0', 'kind': '{R.KINDS[0]}', 'payload': payload, 'project_id': CAST(project_id AS VARCHAR), 'window': '14d'}}) AS VARCHAR)) AS input_fingerprint,
    CASE WHEN length(s) > 240 THEN left(s, 239) || '…' ELSE s END AS summary, 'new' AS state FROM (SELECT *, 'Answers to "' || prompt || '" link competitor documentation and never ' || docs_domain AS s FROM p)""", *_SRC))
def _(v):
    """The envelope of one rule's cards: id, fingerprint of the canonical JSON and clamped summary."""
    sealed = R.envelope(R.rule_docs_not_cited(_facts(v), v.brand_config), "1.0", "14d", AS_OF)
    return sealed.select("project_id", "rec_id", "input_fingerprint", "summary", "state")


@query("competitor_outranks", "R-2 R-8", sql(f"WITH {_FACTS} {_OUT}", *_SRC))
def _(v):
    return _sealed(R.rule_competitor_outranks(_facts(v)))


_DIST = """dr AS (SELECT b.project_id, split_part(c.citation_id, '-', 2) AS domain, bool_or(b.started_at < TIMESTAMP '2024-01-29') AS a, bool_or(b.started_at >= TIMESTAMP '2024-01-29') AS z FROM base b JOIN citations c ON c.run_id = b.run_id
  WHERE b.started_at >= TIMESTAMP '2024-01-27' AND b.started_at <= TIMESTAMP '2024-01-31' GROUP BY 1, 2), ds AS (SELECT project_id, count(*) FILTER (WHERE NOT (a AND z))::DOUBLE / count(*) AS distance FROM dr GROUP BY 1)"""


def _drift(v):
    # One domain per cited part: enough of them that two windows differ.
    parts = v.citations.withColumn("domain", F.split_part("citation_id", F.lit("-"), F.lit(2)))
    return Ci.domain_drift(parts, v.runs, v.prompts, AS_OF, 2)


def _gate(v):
    return v.projects.select("project_id", (F.col("project_id") > 0).alias("gate"))


_DRIFTREC = _rec(R.KINDS[2], "medium", "medium", "'window-drift'", "ds WHERE project_id > 0 AND distance > 0.4")


@query("citation_drift_rule", "R-3", sql(f"WITH {_DIST} {_DRIFTREC}", "base", "citations"))
def _(v):
    return _sealed(R.rule_domain_drift(_drift(v), _gate(v)))


def _named(side: str) -> str:
    return f"to_json(coalesce(list_sort(list(domain) FILTER (WHERE {side})), []::VARCHAR[])[1:50])"


@query("drift_payload", "R-3", sql(f"""WITH {_DIST} SELECT project_id, {_named('a AND NOT z')} AS dropped_domains, count(*) FILTER (WHERE a AND NOT z) > 50 AS dropped_truncated, {_named('z AND NOT a')} AS gained_domains,
  count(*) FILTER (WHERE z AND NOT a) > 50 AS gained_truncated FROM dr JOIN ds USING (project_id) WHERE project_id > 0 AND distance > 0.4 GROUP BY 1""", "base", "citations"))
def _(v):
    """The lists of domains that a drift recommendation shows."""
    rows = R.rule_domain_drift(_drift(v), _gate(v))
    names = ("dropped_domains", "dropped_truncated", "gained_domains", "gained_truncated")
    part = lambda n: F.get_json_object("payload", f"$.{n}")
    return rows.select("project_id", *[part(n).cast("boolean").alias(n) if n.endswith("truncated") else part(n).alias(n) for n in names])


_GAP = _rec(R.KINDS[3], "low", "medium", "category", "categories WHERE project_id < 2 AND NOT local_has_prompts AND in_graph >= 0.1")
_UNDER = _rec(R.KINDS[6], "medium", "medium", "category", "categories WHERE project_id < 2 AND brand_rank > p75")


@query("coverage_gap", "R-4", sql(_GAP, "categories"))
def _(v):
    return _sealed(R.rule_coverage_gap(v.categories, v.brand_config))


@query("provider_blindspot", "R-5", sql(f"WITH {_FACTS} {_BLIND}", *_SRC))
def _(v):
    return _sealed(R.rule_provider_blindspot(_facts(v), v.brand_config))


_P50 = "pc AS (SELECT doc_id % 3 AS project_id, quantile_cont(CASE WHEN quality = 1 THEN 0.9 ELSE 0.1 + doc_id % 3 * 0.2 END, 0.5) AS p50 FROM labels GROUP BY 1)"


def _p50(v):
    doc = F.col("doc_id")
    conf = v.table("labels").select((doc % 3).alias("project_id"), F.when(F.col("quality") == 1, F.lit(0.9)).otherwise(F.lit(0.1) + doc % 3 * 0.2).alias("c"))
    return exact_percentiles(conf, ["project_id"], "c", {"p50": 0.5})


@query("extraction_p50", "R-6", f"WITH {_P50} SELECT project_id, {r('p50')} AS p50 FROM pc")
def _(v):
    return _p50(v)


_LOWC = _rec(R.KINDS[5], "low", "high", "'p50'", "pc WHERE p50 < 0.95")


@query("low_extraction_confidence", "R-6", f"WITH {_P50} {_LOWC}")
def _(v):
    return _sealed(R.rule_low_confidence(_p50(v), threshold=0.95))


@query("benchmark_underperformance", "R-7", sql(_UNDER, "categories"))
def _(v):
    return _sealed(R.rule_underperformance(v.categories, v.brand_config))


def _all(v):
    return R.recommend(_facts(v), v.brand_config, _drift(v), _gate(v), v.categories, _p50(v))


@query("recommendations_by_kind", "R-9", sql(f"""WITH {_FACTS}, {_DIST}, {_P50}, a AS ({_DOCS} UNION ALL {_OUT} UNION ALL {_DRIFTREC} UNION ALL {_GAP} UNION ALL {_BLIND} UNION ALL {_LOWC.replace('0.95', '0.6')} UNION ALL {_UNDER})
  SELECT kind, list_position([{', '.join(f"'{k}'" for k in R.KINDS)}], kind) AS kind_order, count(*) AS n FROM a GROUP BY 1""", *_SRC, "categories"))
def _(v):
    return _all(v).groupBy("kind", "kind_order").agg(F.count("*").alias("n"))


@query("sealed_recommendations", "R-8")
def _(v):
    return R.envelope(_all(v), "1.0", "14d", AS_OF).select("rec_id", "kind", "project_id", "input_fingerprint", "summary", "state")


@query("new_recommendations", "D-10", sql("""WITH c AS (SELECT project_id, kind, input_fingerprint, min(rec_id) AS rec_id FROM recommendations WHERE state = 'generated' AND plugin_source IS NULL GROUP BY 1, 2, 3)
  SELECT c.* FROM c ANTI JOIN (SELECT * FROM recommendations WHERE plugin_source IS NOT NULL AND state IN ('generated', 'surfaced', 'acknowledged', 'acted')) e
  ON e.project_id = c.project_id AND e.kind = c.kind AND e.input_fingerprint = c.input_fingerprint""", "recommendations"))
def _(v):
    fresh = v.recommendations.filter("state = 'generated' AND plugin_source IS NULL")
    return R.new_recommendations(fresh, v.recommendations.filter("plugin_source IS NOT NULL")).select("project_id", "kind", "input_fingerprint", "rec_id")


_ADOPT = """ad AS (SELECT project_id, kind, count(*) FILTER (WHERE state IN ('surfaced', 'acknowledged', 'acted', 'measured', 'dismissed')) AS surfaced, count(*) FILTER (WHERE state IN ('acted', 'measured')) AS acted,
  count(*) FILTER (WHERE state = 'dismissed') AS dismissed FROM recommendations WHERE plugin_source IS NULL GROUP BY 1, 2)"""


@query("adoption_by_kind", "A-38", sql(f"WITH {_ADOPT} SELECT * FROM ad", "recommendations"))
def _(v):
    return R.adoption_by_kind(v.recommendations)


@query("adoption_rate", "A-38", sql(f"WITH {_ADOPT} SELECT project_id, sum(acted)::BIGINT AS numerator, sum(surfaced)::BIGINT AS denominator, {r('sum(acted)::DOUBLE / sum(surfaced)')} AS rate FROM ad GROUP BY 1", "recommendations"))
def _(v):
    return R.adoption_rate(v.recommendations)


@query("illegal_transitions", "W-7", sql(f"""WITH l AS (SELECT *, lag(state) OVER (PARTITION BY rec_id ORDER BY changed_at, event_id) AS from_state FROM lifecycle)
  SELECT rec_id, event_id, {t('changed_at')} AS changed_at, from_state, state AS to_state FROM l WHERE from_state IS NOT NULL AND from_state <> state AND (from_state || '>' || state) NOT IN
  ('generated>surfaced', 'generated>stale', 'surfaced>acknowledged', 'surfaced>dismissed', 'acknowledged>acted', 'acknowledged>dismissed', 'acted>measured')""", "lifecycle"))
def _(v):
    return R.illegal_transitions(v.lifecycle)


@query("measured_outcomes", "W-8", sql(f"""WITH pt AS (SELECT project_id, started_at, sum((status = 'ok')::INT) AS m, count(*) AS n FROM base GROUP BY 1, 2),
  cm AS (SELECT *, sum(m) OVER (PARTITION BY project_id ORDER BY started_at) AS cs, sum(n) OVER (PARTITION BY project_id ORDER BY started_at) AS cn FROM pt),
  a AS (SELECT *, acted_at + INTERVAL 14 DAY AS due_at FROM acted WHERE acted_at + INTERVAL 14 DAY <= TIMESTAMP '2024-01-31'),
  l AS (SELECT a.*, x.cs AS s0, x.cn AS n0 FROM a ASOF LEFT JOIN cm x ON x.project_id = a.project_id AND x.started_at <= a.acted_at),
  h AS (SELECT l.*, (y.cn - coalesce(n0, 0))::BIGINT AS post_runs, (y.cs - coalesce(s0, 0))::DOUBLE AS s FROM l ASOF LEFT JOIN cm y ON y.project_id = l.project_id AND y.started_at <= l.due_at)
  SELECT rec_id, coalesce(post_runs, 0) AS post_runs, {r('CASE WHEN post_runs > 0 THEN s / post_runs END')} AS value_at_measure,
  CASE WHEN coalesce(post_runs, 0) < 10 THEN 'inconclusive' WHEN s / post_runs > value_at_acted THEN 'improved' WHEN s / post_runs < value_at_acted THEN 'regressed' ELSE 'unchanged' END AS status FROM h""", "base", "acted"))
def _(v):
    runs = V.base_runs(v.runs, v.prompts).withColumn("ok", (F.col("status") == "ok").cast("int"))
    return R.measure_outcomes(v.acted, runs, "ok", AS_OF).select("rec_id", "post_runs", "value_at_measure", "status")


# --- cost and schedules ------------------------------------------------------------------------

_PRICE = "CASE provider WHEN 'openai' THEN 0.015 WHEN 'anthropic' THEN 0.018 WHEN 'gemini' THEN 0.0105 WHEN 'openrouter' THEN 0.015 END"
_COST = f"""dc AS (SELECT b.org_id, b.project_id, CAST(b.created_at AS DATE) AS cost_date, b.provider, count(*) AS run_count, count(*) * {_PRICE}::DOUBLE AS cost_usd FROM base b
  WHERE status = 'ok' AND org_id IS NOT NULL GROUP BY 1, 2, 3, 4)"""


@query("brand_cost_daily", "A-25 F-17", sql(f"WITH {_COST} SELECT org_id, project_id, {d('cost_date')} AS cost_date, provider, run_count, {r('cost_usd')} AS cost_usd FROM dc", "base"))
def _(v):
    return Co.brand_cost_daily(v.runs, v.prompts)


@query("org_cost", "A-25", sql(f"""WITH {_COST}, k AS (SELECT * FROM dc WHERE cost_date >= DATE '2024-01-10') SELECT org_id, project_id, provider, sum(run_count)::BIGINT AS run_count, {r('sum(cost_usd)')} AS cost_usd FROM k GROUP BY 1, 2, 3
  UNION ALL SELECT org_id, NULL, NULL, sum(run_count)::BIGINT, {r('sum(cost_usd)')} FROM k GROUP BY 1""", "base"))
def _(v):
    return Co.org_cost(Co.brand_cost_daily(v.runs, v.prompts), start="2024-01-10")


@query("monthly_cost", "F-17 F-18", sql(f"""SELECT schedule_id, {r('tpd')} AS ticks_per_day, {r('usd')} AS usd_per_run, {r('tpd * 30.4375 * prompt_count * n_providers')} AS runs_per_month, {r('tpd * 30.4375 * prompt_count * usd')} AS monthly_usd FROM schedules""", "schedules"))
def _(v):
    return Co.monthly_cost(v.schedules).select("schedule_id", "ticks_per_day", "usd_per_run", "runs_per_month", "monthly_usd")


@query("schedule_cap_violations", "F-18", sql(f"""SELECT schedule_id, cadence, {r('tpd')} AS ticks_per_day, CASE WHEN tpd IS NULL THEN 'unsupported_cadence' WHEN tpd / 24 > 12 THEN 'per_schedule_hourly_cap' ELSE 'provider_daily_cap' END AS violation,
  CASE WHEN tpd / 24 <= 12 THEN first_provider END AS provider FROM schedules WHERE tpd IS NULL OR tpd > 96""", "schedules"))
def _(v):
    return Co.cap_violations(v.schedules)


_STEP = "CASE schedule_id % 9 WHEN 0 THEN 86400 WHEN 1 THEN 21600 WHEN 2 THEN 604800 WHEN 3 THEN 172800 WHEN 4 THEN 3600 WHEN 5 THEN 300 WHEN 6 THEN 604800 WHEN 7 THEN 120 END"


@query("missed_slots", "W-9", sql(f"""WITH z AS (SELECT schedule_id, {_STEP} AS step, epoch(created_at)::BIGINT AS c FROM schedules WHERE schedule_id % 9 < 8), g AS (SELECT schedule_id, unnest(generate_series((c // step) * step + step, epoch(TIMESTAMP '2024-01-31')::BIGINT, step)) AS s FROM z)
  SELECT schedule_id, strftime(TIMESTAMP '1970-01-01' + to_seconds(s), '%Y-%m-%d') AS day, count(*) AS missed FROM g ANTI JOIN (SELECT schedule_id, epoch(tick_ts)::BIGINT AS s FROM ticks) k USING (schedule_id, s) GROUP BY 1, 2""", "schedules", "ticks"))
def _(v):
    missed = Co.tick_gaps(v.schedules, v.ticks, v.manual_runs, AS_OF)[0]
    return missed.groupBy("schedule_id", F.to_date("slot_ts").alias("day")).agg(F.count("*").alias("missed"))


@query("debounced_ticks", "W-9", sql(f"""WITH x AS (SELECT k.schedule_id, k.tick_ts, m.run_at, s.debounce_minutes FROM ticks k JOIN schedules s USING (schedule_id) ASOF LEFT JOIN manual_runs m ON m.schedule_id = k.schedule_id AND m.run_at <= k.tick_ts)
  SELECT schedule_id, {t('tick_ts')} AS tick_ts, {t('run_at')} AS manual_run_at FROM x WHERE date_diff('microsecond', run_at, tick_ts) < debounce_minutes * 60000000""", "schedules", "ticks", "manual_runs"))
def _(v):
    return Co.tick_gaps(v.schedules, v.ticks, v.manual_runs, AS_OF)[1]


@query("orphaned_ticks", "W-9", sql(f"SELECT schedule_id, {t('tick_ts')} AS tick_ts, {t('claimed_at')} AS claimed_at FROM ticks WHERE status = 'claimed' AND completed_at IS NULL AND claimed_at < TIMESTAMP '2024-01-31' - INTERVAL 300 SECOND", "ticks"))
def _(v):
    return Co.tick_gaps(v.schedules, v.ticks, v.manual_runs, AS_OF)[2]


@query("trend_kinds", "F-21 X-U1", sql("SELECT DISTINCT 'plugin:demo:' || kind AS trend_kind, true AS is_plugin, false AS is_builtin FROM recommendations", "recommendations"))
def _(v):
    kind = S.trend_kind("demo", F.col("kind"))
    return v.recommendations.select(kind.alias("trend_kind"), S.is_plugin_trend(kind).alias("is_plugin"), S.is_builtin_trend(kind).alias("is_builtin")).distinct()
