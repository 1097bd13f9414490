"""Registry, consent, privacy, validation and export queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import audit as A
from ..operators import constraints as K
from ..operators import privacy as P
from ..operators import registry as G
from ..session import checkpoint_root
from ..sources import bundles, exports, sinks
from .catalog import query, r, t
from .views import AS_OF, sql

TERMS = "v2"


@query("org_runs", "P-7", sql("SELECT run_id, org_id FROM runs WHERE org_id = 'org-1'", "runs"))
def _(v):
    return S.org_scope(v.runs, "org-1").select("run_id", "org_id")


@query("filtered_runs", "P-4", sql("SELECT run_id, provider FROM runs WHERE provider IN ('openai', 'gemini')", "runs"))
def _(v):
    return S.opt_in(S.opt_eq(S.opt_in(v.runs, "status", []), "model", None), "provider", ["openai", "gemini"]).select("run_id", "provider")


@query("audit_trail", "P-12", sql(f"""SELECT id, {t('ts')} AS ts, actor_login, action FROM audit_log WHERE org_id = 'org-1' AND ts BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1998-01-01' AND action LIKE 'org.%'""", "audit_log"))
def _(v):
    return G.audit_range(v.audit_log, "org-1", "1995-01-01", "1998-01-01", action_prefix="org.").select("id", "ts", "actor_login", "action")


@query("audit_csv_rows", "S-15", sql(f"SELECT id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, actor_login, action, coalesce(target, '') AS target FROM audit_log", "audit_log"))
def _(v):
    return v.audit_log.select("id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), "actor_login", "action", F.coalesce("target", F.lit("")).alias("target"))


@query("entity_search", "P-13", sql(f"""SELECT domain, display_name, {t('created_at')} AS created_at FROM entities WHERE claim_status = 'verified' AND contains(lower(domain), 'd1') ORDER BY entities.created_at DESC, domain LIMIT 20 OFFSET 1""", "entities"))
def _(v):
    return G.search_entities(v.entities, claim_status="verified", domain="D1", limit=20, offset=1).select("domain", "display_name", "created_at")


@query("consent_records", "P-15", sql(f"""SELECT consent_id, project_id, {t('created_at')} AS created_at FROM consent WHERE tier = 'named' AND event = 'optin' AND created_at >= TIMESTAMP '2024-01-10' ORDER BY consent.created_at DESC, consent_id DESC LIMIT 100 OFFSET 5""", "consent"))
def _(v):
    return G.consent_records(v.consent, tier="named", event="optin", start="2024-01-10", limit=100, offset=5).select("consent_id", "project_id", "created_at")


@query("audit_history", "P-16", sql(f"""SELECT audit_id, project_id, target, score, pages, gate_passed, {t('created_at')} AS created_at, score - lag(score) OVER (PARTITION BY project_id, target ORDER BY audit_runs.created_at) AS score_change FROM audit_runs""", "audit_runs"))
def _(v):
    return A.audit_history(v.audit_runs)


@query("latest_consent", "A-26", sql("SELECT project_id, tier, consent_id, event, terms_version FROM consent QUALIFY row_number() OVER (PARTITION BY project_id, tier ORDER BY created_at DESC, consent_id DESC) = 1", "consent"))
def _(v):
    return G.latest_consent(v.consent).select("project_id", "tier", "consent_id", "event", "terms_version")


@query("distinct_providers", "U-4", sql("SELECT DISTINCT provider, model FROM runs", "runs"))
def _(v):
    return G.distinct_keys(v.runs, ["provider", "model"])


_ASOF = f"""k AS (SELECT project_id, created_at, consent_id, event, terms_version, lead(created_at) OVER (PARTITION BY project_id ORDER BY created_at, consent_id) AS nxt FROM consent WHERE tier = 'benchmark'),
  ao AS (SELECT o.*, k.event AS consent_event, k.terms_version AS ctv, coalesce(k.event = 'optin' AND k.terms_version = '{TERMS}', false) AS opted_in FROM observed o LEFT JOIN k
    ON k.project_id = o.project_id AND k.created_at <= o.observed_at AND (k.nxt IS NULL OR o.observed_at < k.nxt))"""


@query("consent_as_of", "J-13", sql(f"WITH {_ASOF} SELECT run_id, project_id, consent_event, opted_in FROM ao", "consent", "observed"))
def _(v):
    return G.consent_as_of(v.observed, v.consent, "benchmark", TERMS).select("run_id", "project_id", "consent_event", "opted_in")


@query("contribution_decisions", "E-6", sql(f"""WITH {_ASOF} SELECT CASE WHEN NOT contribute THEN 'not_requested' WHEN NOT opted_in THEN 'skipped_not_opted_in' WHEN NOT regexp_matches(prompt_slug, '^[a-z0-9-]+$') THEN 'redaction_rejected' ELSE 'sealed' END AS decision,
  count(*) AS runs FROM ao GROUP BY 1""", "consent", "observed"))
def _(v):
    return G.contribution_decision(v.observed, v.consent, "benchmark", TERMS).groupBy("decision").agg(F.count("*").alias("runs"))


@query("redacted_runs", "P-9 F-8 F-9", sql(f"""SELECT prompt_slug, provider, model, {t("date_trunc('hour', observed_at)")} AS observed_at_hour, observed_rank, 'a.com|b.com' AS citation_domains, 'v2' AS terms_version
  FROM observed WHERE terms = 'v2' AND prompt_slug LIKE 'prompt-%'""", "observed"))
def _(v):
    return P.redact_runs(v.observed, b"secret", F.col("terms"), TERMS)[0].drop("project_hmac")


#: The key `secret` as HMAC pads it for the inner and the outer hash.
_PADS = [bytes(b ^ x for b in b"secret".ljust(64, b"\0")).hex() for x in (0x36, 0x5C)]


@query("redaction_hashes", "P-9", sql(f"""SELECT sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(CAST(project_id AS VARCHAR))))) AS project_hmac, count(*) AS runs
  FROM observed WHERE terms = 'v2' AND prompt_slug NOT LIKE 'Prompt%' GROUP BY 1""", "observed"))
def _(v):
    return P.redact_runs(v.observed, b"secret", F.col("terms"), TERMS)[0].groupBy("project_hmac").agg(F.count("*").alias("runs"))


@query("refused_runs", "P-9", sql("SELECT run_id, CASE WHEN terms <> 'v2' THEN 'stale_consent' ELSE 'invalid_slug' END AS reason FROM observed WHERE terms <> 'v2' OR prompt_slug LIKE 'Prompt%'", "observed"))
def _(v):
    return P.redact_runs(v.observed, b"secret", F.col("terms"), TERMS)[1]


@query("resolved_tokens", "J-10", sql("""WITH pf AS (SELECT token_hash, domain FROM attempts WHERE status = 'verified' AND used_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY token_hash ORDER BY used_at DESC, domain) = 1)
  SELECT k.token, p.domain, CASE WHEN p.domain IS NOT NULL THEN coalesce(e.claim_status, 'unknown') END AS claim_status,
  CASE WHEN p.domain IS NULL THEN 'unknown_token' WHEN e.claim_status = 'verified' THEN 'resolved' ELSE 'unverified' END AS decision
  FROM tokens k LEFT JOIN pf p ON p.token_hash = sha256(k.token) LEFT JOIN entities e ON e.domain = p.domain""", "tokens", "attempts", "entities"))
def _(v):
    return G.resolve_tokens(v.tokens, v.attempts, v.entities)


@query("domain_projects", "J-11", sql("""SELECT entity_domain AS domain, count(DISTINCT project_id) AS projects, CASE WHEN count(DISTINCT project_id) = 1 THEN 'unique' ELSE 'ambiguous' END AS mapping,
  CASE WHEN count(DISTINCT project_id) = 1 THEN min(project_id) END AS project_id FROM contributions WHERE entity_domain IS NOT NULL GROUP BY 1""", "contributions"))
def _(v):
    return G.domain_projects(v.contributions)


@query("facts_in_force", "J-12", sql("""SELECT c.claim_id, count(f.fact_key) AS facts_in_force FROM claims c LEFT JOIN facts f ON f.project_id = c.project_id AND f.entity = c.entity AND f.valid_from <= c.created_at
  AND (f.valid_to IS NULL OR c.created_at < f.valid_to) AND (f.valid_to IS NULL OR f.valid_to > f.valid_from) GROUP BY 1""", "claims", "facts"))
def _(v):
    sane = v.facts.filter(F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from")))
    return G.facts_at(v.claims, sane).select("claim_id", "facts_in_force")


@query("claim_totals", "A-44", sql("""WITH c AS (SELECT project_id, count(*) AS claims, count(*) FILTER (WHERE verdict = 'supported') AS supported, count(*) FILTER (WHERE verdict = 'contradicted') AS contradicted,
  count(*) FILTER (WHERE verdict = 'unverifiable') AS unverifiable, count(*) FILTER (WHERE verdict IS NULL) AS unjudged FROM claims WHERE created_at >= TIMESTAMP '2024-01-24' GROUP BY 1)
  SELECT c.*, coalesce(f.n, 0) AS facts FROM c LEFT JOIN (SELECT project_id, count(*) AS n FROM facts GROUP BY 1) f USING (project_id)""", "claims", "facts"))
def _(v):
    return G.claims_summary(v.claims, v.facts, AS_OF, 7)[1]


@query("newest_claims", "A-44", sql(f"SELECT claim_id, project_id, {t('created_at')} AS created_at FROM claims WHERE created_at >= TIMESTAMP '2024-01-24' QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY claims.created_at DESC, claim_id DESC) <= 50", "claims"))
def _(v):
    return G.claims_summary(v.claims, v.facts, AS_OF, 7)[0].select("claim_id", "project_id", "created_at")


_SEG = f"""sg AS (SELECT category, domain, count(*) AS contributor_count, {r('avg(s)')} AS visibility_score FROM (SELECT category, domain, project_id, avg(score) AS s FROM contributions WHERE opted_in AND verified AND revoked_at IS NULL GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


@query("named_leaderboard", "A-34", sql(f"""WITH {_SEG} SELECT *, row_number() OVER (ORDER BY visibility_score DESC, category, domain) AS rank FROM (SELECT * FROM sg WHERE contributor_count >= 30 ORDER BY visibility_score DESC, category, domain LIMIT 100)""", "contributions"))
def _(v):
    return G.k_floor_leaderboard(v.contributions, 30)[0]


@query("suppressed_segments", "A-34", sql(f"WITH {_SEG} SELECT category, domain, contributor_count FROM sg WHERE contributor_count < 30", "contributions"))
def _(v):
    return G.k_floor_leaderboard(v.contributions, 30)[1]


@query("segment_density", "A-45", sql("SELECT provider, category, window_days, count(DISTINCT project_id) AS contributor_count, count(DISTINCT project_id) >= 5 AS meets_floor FROM contributions GROUP BY 1, 2, 3", "contributions"))
def _(v):
    return G.segment_density(v.contributions)


@query("density_check", "A-35", sql("""WITH a AS (SELECT 'distinct_contributors' AS threshold_name, 20 AS required, (SELECT count(DISTINCT project_id) FROM contributions) AS actual
  UNION ALL SELECT 'categories_above_k5_floor', 20, (SELECT count(DISTINCT category) FROM (SELECT category, provider FROM contributions WHERE window_days = 30 GROUP BY 1, 2 HAVING count(DISTINCT project_id) >= 5))
  UNION ALL SELECT 'ranked_domains_per_category', 10, (SELECT coalesce(min(n), 0) FROM (SELECT count(DISTINCT domain) AS n FROM contributions GROUP BY category))
  UNION ALL SELECT 'prompt_runs_per_segment', 100, (SELECT coalesce(min(n), 0)::BIGINT FROM (SELECT sum(run_count) AS n FROM contributions WHERE window_days = 30 GROUP BY category, provider))) SELECT *, actual >= required AS passed FROM a""", "contributions"))
def _(v):
    return G.density_check(v.contributions)


@query("contribution_status", "A-47", sql("""SELECT c.project_id, coalesce(n.n, 0) AS contributions, n.n IS NOT NULL AS has_contributions FROM (SELECT DISTINCT project_id FROM consent) c
  LEFT JOIN (SELECT project_id, count(*) AS n FROM contributions GROUP BY 1) n USING (project_id)""", "consent", "contributions"))
def _(v):
    return G.contribution_status(v.consent, v.contributions)


@query("erased_audit_log", "E-1", sql("""SELECT id, CASE WHEN org_id = 'org-1' AND actor_login = 'u5@x.org' THEN '<erased>' ELSE actor_login END AS actor_login,
  CASE WHEN org_id = 'org-1' AND actor_login = 'u5@x.org' THEN 'true' END AS erased, CASE WHEN org_id = 'org-1' AND actor_login = 'u5@x.org' THEN NULL ELSE actor_login END AS email, CAST(id AS VARCHAR) AS n FROM audit_log""", "audit_log"))
def _(v):
    get = lambda k: F.get_json_object("metadata", f"$.{k}").alias(k)
    return P.erase_subject(v.audit_log, "org-1", "u5@x.org")[0].select("id", "actor_login", get("erased"), get("email"), get("n"))


@query("erasure_count", "E-1", sql("SELECT count(*) FILTER (WHERE org_id = 'org-1' AND actor_login = 'u5@x.org') AS audit_rows_tombstoned FROM audit_log", "audit_log"))
def _(v):
    return P.erase_subject(v.audit_log, "org-1", "u5@x.org")[1]


@query("subject_export", "E-2", sql(f"SELECT id, {t('ts')} AS ts, actor_login, action, target FROM audit_log WHERE org_id = 'org-1' AND actor_login = 'u5@x.org'", "audit_log"))
def _(v):
    return P.export_subject(v.audit_log, "org-1", "u5@x.org").drop("record")


@query("domain_erasure_counts", "E-3", sql("""SELECT 'entities' AS table_name, count(*) FILTER (WHERE domain = 'd3.example.com') AS rows FROM entities UNION ALL SELECT 'verification_attempts', count(*) FILTER (WHERE domain = 'd3.example.com') FROM attempts
  UNION ALL SELECT 'disputes', count(*) FILTER (WHERE domain = 'd3.example.com') FROM disputes UNION ALL SELECT 'contributions_delinked', count(*) FILTER (WHERE entity_domain = 'd3.example.com') FROM contributions""", "entities", "attempts", "disputes", "contributions"))
def _(v):
    return P.erase_domain("d3.example.com", v.entities, v.attempts, v.disputes, v.contributions)[4]


@query("delinked_contributions", "E-3", sql("SELECT contribution_id, nullif(entity_domain, 'd3.example.com') AS entity_domain FROM contributions", "contributions"))
def _(v):
    return P.erase_domain("d3.example.com", v.entities, v.attempts, v.disputes, v.contributions)[3].select("contribution_id", "entity_domain")


@query("audience", "E-4", sql("""SELECT s.email, CASE WHEN x.e IS NOT NULL THEN 'suppressed_by_list' WHEN all_marketing_off OR digest_frequency = 'off' THEN 'disabled_by_preference'
  WHEN is_eu_resident AND NOT marketing_consent THEN 'blocked_by_eu_consent' ELSE 'send' END AS decision FROM subscriptions s LEFT JOIN (SELECT DISTINCT lower(email) AS e FROM suppressions) x ON x.e = lower(s.email)""", "subscriptions", "suppressions"))
def _(v):
    return P.select_audience(v.subscriptions, v.suppressions, "digest").select("email", "decision")


@query("public_domains", "E-5", sql("SELECT domain, sum(frequency)::BIGINT AS total FROM citations WHERE domain NOT IN (SELECT domain FROM disputes WHERE suppressed) GROUP BY 1", "citations", "disputes"))
def _(v):
    return P.drop_suppressed(v.citations.groupBy("domain").agg(F.sum("frequency").alias("total")), v.disputes)


_OVER = "claim_status = 'revoked' AND grace_period_start < TIMESTAMP '2024-01-31' - INTERVAL 28 DAY"


@query("reopened_entities", "E-7", sql(f"""SELECT domain, CASE WHEN {_OVER} THEN 'unclaimed' ELSE claim_status END AS claim_status, CASE WHEN NOT coalesce({_OVER}, false) THEN verification_method END AS verification_method,
  CASE WHEN NOT coalesce({_OVER}, false) THEN {t('grace_period_start')} END AS grace_period_start FROM entities""", "entities"))
def _(v):
    return P.reopen_expired(v.entities, AS_OF, 28).select("domain", "claim_status", "verification_method", "grace_period_start")


@query("claim_constraints", "P-10", sql("SELECT 'confidence_range' AS rule, count(*) FILTER (WHERE confidence NOT BETWEEN 0 AND 100) AS violations FROM claims", "claims"))
def _(v):
    return K.violations(v.claims, K.claim_rules())


@query("fact_constraints", "P-10", sql("SELECT 'valid_range' AS rule, count(*) FILTER (WHERE valid_to <= valid_from) AS violations FROM facts", "facts"))
def _(v):
    return K.violations(v.facts, K.fact_rules())


_INGEST = """inq AS (SELECT run_id, project_id, prompt_slug, CASE WHEN run_id % 13 = 0 THEN ' ' ELSE model END AS model, CASE run_id % 6 WHEN 0 THEN 'plugin:x' WHEN 1 THEN 'unknown' ELSE provider END AS provider,
  run_id % 17 > 0 AS has_text, run_id % 19 > 0 AS good_meta FROM observed),
  jd AS (SELECT *, CASE WHEN prompt_slug LIKE 'Prompt%' THEN 'bad_slug' WHEN trim(model) = '' THEN 'empty_model' WHEN NOT has_text THEN 'no_content' WHEN NOT good_meta THEN 'bad_metadata' WHEN provider = 'unknown' THEN 'provider_not_supported'
    WHEN NOT EXISTS (SELECT 1 FROM prompts p WHERE p.project_id = inq.project_id AND p.name = inq.prompt_slug) THEN 'prompt_not_found' END AS code FROM inq)"""


def _ingest(v):
    i = F.col("run_id")
    sent = v.observed.select(
        "run_id", "project_id", "prompt_slug", F.when(i % 13 == 0, " ").otherwise(F.col("model")).alias("model"),
        F.when(i % 6 == 0, "plugin:x").when(i % 6 == 1, "unknown").otherwise(F.col("provider")).alias("provider"),
        F.lit(None).cast("string").alias("raw_response"), F.when(i % 17 > 0, "text").alias("response_text"), F.when(i % 19 > 0, "{}").otherwise("[1]").alias("metadata"),
    )
    return K.validate_ingest(sent, v.prompts)


@query("accepted_runs", "P-11", sql(f"WITH {_INGEST} SELECT run_id, prompt_slug FROM jd WHERE code IS NULL", "observed", "prompts"))
def _(v):
    return _ingest(v)[0].select("run_id", "prompt_slug")


@query("rejected_runs", "P-11", sql(f"WITH {_INGEST} SELECT run_id, code FROM jd WHERE code IS NOT NULL", "observed", "prompts"))
def _(v):
    return _ingest(v)[1].select("run_id", "code")


@query("suite_violations", "S-14", sql("""WITH v AS (SELECT slug, 'empty_field' AS violation FROM suite WHERE trim(description) = '' UNION ALL SELECT slug, 'version_differs_from_suite' FROM suite WHERE version <> suite_id
  UNION ALL SELECT slug, 'not_namespaced' FROM suite WHERE slug NOT LIKE 'suite-v1/%' UNION ALL SELECT slug, 'unsafe_slug' FROM suite WHERE NOT regexp_matches(slug, '^[a-z0-9/-]+$')
  UNION ALL SELECT slug, 'duplicate_slug' FROM suite GROUP BY slug HAVING count(*) > 1) SELECT slug, violation FROM v""", "suite"))
def _(v):
    return K.validate_suite(v.suite, TERMS).select("slug", "violation")


@query("bundle_contents", "S-12", sql("""SELECT p.project_id, p.prompt_id, count(r.run_id) AS runs, min(r.run_id) AS first_run, max(r.run_id) AS last_run FROM prompts p LEFT JOIN runs r ON r.prompt_id = p.prompt_id GROUP BY 1, 2""", "prompts", "runs"))
def _(v):
    bundle = bundles.export_bundle(v.projects, v.prompts, v.runs, per_part=20)
    q = bundle.select(F.col("id").cast("long").alias("project_id"), F.explode("prompts").alias("q"))
    ids = F.transform("q.runs", lambda x: x["id"].cast("long"))
    return q.select("project_id", F.col("q.id").cast("long").alias("prompt_id"), F.size("q.runs").alias("n"), F.array_min(ids).alias("a"), F.array_max(ids).alias("b")).groupBy("project_id", "prompt_id").agg(
        F.sum("n").alias("runs"), F.min("a").alias("first_run"), F.max("b").alias("last_run")
    )


@query("bundle_import_counts", "S-13", sql("""SELECT 'projects' AS level, count(*) FILTER (WHERE project_id <> 0) AS imported, count(*) FILTER (WHERE project_id = 0) AS skipped FROM projects
  UNION ALL SELECT 'prompts', count(*) FILTER (WHERE project_id <> 0), count(*) FILTER (WHERE project_id = 0) FROM prompts
  UNION ALL SELECT 'runs', count(*) FILTER (WHERE status = 'ok'), count(*) FILTER (WHERE status <> 'ok') FROM runs""", "projects", "prompts", "runs"))
def _(v):
    bundle = bundles.export_bundle(v.projects, v.prompts, v.runs)
    kept = v.projects.filter("project_id = 0"), v.prompts.filter("project_id = 0"), v.runs.filter("status = 'failed'")
    return bundles.import_bundle(bundle, *kept)[3]


@query("export_rerun_rows", "S-10 S-11", sql("SELECT domain, sum(frequency)::BIGINT AS total FROM citations GROUP BY 1 HAVING sum(frequency) % 2 = 0", "citations"))
def _(v):
    """What a reader sees after an export that was interrupted and resumed, and then a second one with half the rows."""
    totals = v.citations.groupBy("domain").agg(F.sum("frequency").alias("total"))
    path = f"{checkpoint_root(v.spark)}/export-{uuid.uuid4().hex}"
    for rows, stop in ((totals, 3), (totals, None), (totals.filter("total % 2 = 0"), None)):
        sinks.export_metrics_batched(rows, ["domain"], f"{path}/rows", f"{path}/state", "totals", batch_size=20, stop_after=stop)
    return v.spark.read.schema("domain STRING, total BIGINT").parquet(f"{path}/rows").select("domain", "total")


@query("published_export", "S-11", sql("SELECT domain, sum(frequency)::BIGINT AS total FROM citations GROUP BY 1", "citations"))
def _(v):
    """What a reader sees while the next run, of half the rows, stands interrupted: the run before, whole."""
    totals = v.citations.groupBy("domain").agg(F.sum("frequency").alias("total"))
    root = f"{checkpoint_root(v.spark)}/published-{uuid.uuid4().hex}"
    exports.export_run(totals, ["domain"], root, "totals", batch_size=2, commits=3, stop_after=1)
    exports.export_run(totals, ["domain"], root, "totals", batch_size=2, commits=3)
    exports.export_run(totals.filter("total % 2 = 0"), ["domain"], root, "totals", batch_size=2, commits=3, stop_after=1)
    return exports.read_export(v.spark, root, "totals").select("domain", "total")


@query("published_projects", "S-10", sql("SELECT project_id, prompt_id, CASE WHEN project_id = 1 THEN 'new' ELSE name END AS name FROM prompts WHERE project_id <> 2", "prompts"))
def _(v):
    """All projects, then a load of one of them that also covers a project without rows any more."""
    rows = v.prompts.select("project_id", "prompt_id", "name")
    root = f"{checkpoint_root(v.spark)}/published-{uuid.uuid4().hex}"
    exports.export_projects(rows, "prompt_id", root, "points")
    again = rows.filter("project_id = 1").withColumn("name", F.lit("new"))
    exports.export_projects(again, "prompt_id", root, "points", v.projects.filter("project_id > 0"))
    return exports.read_projects(v.spark, root, "points").select("project_id", "prompt_id", "name")


@query("export_batches", "S-11")
def _(v):
    return sinks.batch_of(v.citations.groupBy("domain").agg(F.sum("frequency").alias("total")), ["domain"], 8).groupBy("batch_id").agg(F.count("*").alias("rows"))
