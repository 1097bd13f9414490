"""Entity registry, contributions, the public benchmark's floors, claims against facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import scalars as S
from ..functions.asof import as_of_join
from ..functions.ordering import latest_by, page, running_total, time_chunks, top_k_per_group, top_n


def resolve_tokens(tokens: DataFrame, attempts: DataFrame, entities: DataFrame) -> DataFrame:
    """Token -> the latest attempt that was verified and used up -> the entity's claim status now."""
    spent = attempts.filter((F.col("status") == "verified") & F.col("used_at").isNotNull())
    proof = latest_by(spent.select("token_hash", "domain", "used_at"), ["token_hash"], [F.col("used_at").desc(), F.col("domain")])
    hashed = tokens.withColumn("token_hash", F.sha2("token", 256))
    out = hashed.join(proof.select("token_hash", "domain"), "token_hash", "left").join(
        entities.select("domain", "claim_status"), "domain", "left"
    )
    decision = (
        F.when(F.col("domain").isNull(), "unknown_token").when(F.col("claim_status") == "verified", "resolved").otherwise("unverified")
    )
    status = F.when(F.col("domain").isNotNull(), F.coalesce("claim_status", F.lit("unknown")))
    return out.select("token", "domain", status.alias("claim_status"), decision.alias("decision"))


def domain_projects(contributions: DataFrame) -> DataFrame:
    """Per domain: no, one or several projects; the project only when it is the single one."""
    pairs = contributions.filter("entity_domain IS NOT NULL").groupBy(F.col("entity_domain").alias("domain")).agg(
        F.count_distinct("project_id").alias("projects"), F.min("project_id").alias("p")
    )
    mapping = F.when(F.col("projects") == 0, "none").when(F.col("projects") == 1, "unique").otherwise("ambiguous")
    return pairs.select("domain", "projects", mapping.alias("mapping"), F.when(F.col("projects") == 1, F.col("p")).alias("project_id"))


def search_entities(entities, claim_status=None, method=None, domain: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Registry rows by status, method and case-insensitive domain part, newest first."""
    rows = S.opt_eq(S.opt_eq(entities, "claim_status", claim_status), "verification_method", method)
    if domain is not None:
        rows = rows.filter(F.lower("domain").contains(domain.lower()))
    return page(rows, [F.col("created_at").desc(), F.col("domain")], limit, offset)


def audit_range(events, org_id, start, end, action_prefix=None, action=None, actor=None, limit: int | None = None) -> DataFrame:
    """One org's audit trail between two times, with a limit the oldest rows; no org means none."""
    rows = S.org_scope(events, org_id).filter(F.col("ts").between(S.as_ts(start), S.as_ts(end)))
    rows = S.opt_eq(S.opt_eq(rows, "action", action), "actor_login", actor)
    if action_prefix is not None:
        rows = rows.filter(F.col("action").startswith(action_prefix))
    return rows if limit is None else page(rows, [F.col("ts"), F.col("id")], limit)


def consent_records(consent, tier=None, project_id=None, event=None, start=None, end=None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Ledger rows by optional tier, project, event and time range, newest first."""
    rows = S.opt_eq(S.opt_eq(S.opt_eq(consent, "tier", tier), "project_id", project_id), "event", event)
    if start is not None:
        rows = rows.filter(F.col("created_at") >= S.as_ts(start))
    if end is not None:
        rows = rows.filter(F.col("created_at") <= S.as_ts(end))
    return page(rows, [F.col("created_at").desc(), F.col("consent_id").desc()], limit, offset)


def distinct_keys(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols).distinct()


def latest_consent(consent: DataFrame) -> DataFrame:
    """The consent row in force now per project and tier."""
    return latest_by(consent, ["project_id", "tier"], [F.col("created_at").desc(), F.col("consent_id").desc()])


def consent_as_of(runs: DataFrame, consent: DataFrame, tier: str, current_terms: str) -> DataFrame:
    """Each run with the consent in force when it was observed, and whether that is an active opt-in."""
    mine = consent.filter(F.col("tier") == tier)
    out = as_of_join(runs, mine, ["project_id"], "observed_at", "created_at", ["event", "terms_version"], ["consent_id"])
    active = (F.col("consent_event") == "optin") & (F.col("terms_version") == current_terms)
    return out.withColumnRenamed("event", "consent_event").withColumn("opted_in", F.coalesce(active, F.lit(False)))


def contribution_decision(runs: DataFrame, consent: DataFrame, tier: str, current_terms: str) -> DataFrame:
    """Why a run is or is not contributed: not asked, not opted in, or rejected by the redaction rules."""
    seen = consent_as_of(runs, consent, tier, current_terms)
    asked = F.coalesce(F.col("contribute"), F.lit(False))
    status = (
        F.when(~asked, "not_requested").when(~F.col("opted_in"), "skipped_not_opted_in")
        .when(~S.is_slug(F.col("prompt_slug")), "redaction_rejected").otherwise("sealed")
    )
    return seen.withColumn("decision", status)


def facts_at(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """Each claim with the number of ground-truth facts of its entity in force when it was made.

    Facts open and close on a time line; the open count is a running total looked up as of the claim,
    so a claim never meets the entity's facts one by one.
    """
    keys = ["project_id", "entity"]
    opens = facts.select(*keys, F.coalesce("valid_from", F.lit("0001-01-01").cast("timestamp")).alias("at"), F.lit(1).alias("d"))
    closes = facts.filter("valid_to IS NOT NULL").select(*keys, F.col("valid_to").alias("at"), F.lit(-1).alias("d"))
    steps = opens.unionByName(closes).groupBy(*keys, "at").agg(F.sum("d").alias("d"))
    line = running_total(steps, keys, "at", "d", time_chunks(F.col("at")), "facts_in_force")
    out = as_of_join(claims, line, keys, "created_at", "at", ["facts_in_force"], chunk=("day", "minute"))
    return out.withColumn("facts_in_force", F.coalesce("facts_in_force", F.lit(0)))


def claims_summary(claims, facts, as_of, days: int, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """Each project's newest claims of the window, and per project: claims, facts, verdicts by status."""
    recent = S.window_filter(claims, as_of, days, col="created_at")
    newest = top_k_per_group(recent, ["project_id"], [F.col("created_at").desc(), F.col("claim_id").desc()], limit).drop("rn")
    verdict = F.col("verdict")
    sums = recent.groupBy("project_id").agg(
        F.count("*").alias("claims"), F.count_if(verdict == "supported").alias("supported"),
        F.count_if(verdict == "contradicted").alias("contradicted"), F.count_if(verdict == "unverifiable").alias("unverifiable"),
        F.count_if(verdict.isNull()).alias("unjudged"),
    )
    known = facts.groupBy("project_id").agg(F.count("*").alias("facts"))
    return newest, sums.join(known, "project_id", "left").withColumn("facts", F.coalesce("facts", F.lit(0)))


def segment_contributors(contributions: DataFrame) -> DataFrame:
    """Distinct contributors and mean score per segment."""
    per = contributions.groupBy("category", "domain", "project_id").agg(F.avg("score").alias("score"))
    return per.groupBy("category", "domain").agg(F.count("*").alias("contributor_count"), F.avg("score").alias("visibility_score"))


def k_floor_leaderboard(contributions: DataFrame, k: int = C.K_FLOOR, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """Segments of opted-in, verified, unrevoked contributors with at least k of them, best first; and the rest."""
    named = contributions.filter(F.col("opted_in") & F.col("verified") & F.col("revoked_at").isNull())
    segments = segment_contributors(named).withColumn("visibility_score", F.round("visibility_score", 6))
    shown = top_n(segments.filter(F.col("contributor_count") >= k), "visibility_score", limit, ["category", "domain"])
    # At most `limit` rows are ranked.
    order = Window.orderBy(F.col("visibility_score").desc(), "category", "domain")
    return shown.withColumn("rank", F.row_number().over(order)), segments.filter(F.col("contributor_count") < k).select(
        "category", "domain", "contributor_count"
    )


def segment_density(contributions: DataFrame, floor: int = C.K_FLOOR) -> DataFrame:
    """Distinct contributors per provider, category and window, flagged against the floor."""
    out = contributions.groupBy("provider", "category", "window_days").agg(F.count_distinct("project_id").alias("contributor_count"))
    return out.withColumn("meets_floor", F.col("contributor_count") >= floor)


def density_check(contributions: DataFrame, floor: int = C.K_FLOOR, window_days: int = 30) -> DataFrame:
    """Four density figures against their thresholds, one row each."""
    recent = contributions.filter(F.col("window_days") == window_days)
    people = contributions.agg(F.count_distinct("project_id").alias("v"))
    above = segment_density(recent, floor).filter("meets_floor").agg(F.count_distinct("category").alias("v"))
    domains = contributions.groupBy("category").agg(F.count_distinct("domain").alias("n")).agg(F.coalesce(F.min("n"), F.lit(0)).alias("v"))
    runs = recent.groupBy("category", "provider").agg(F.sum("run_count").alias("n")).agg(F.coalesce(F.min("n"), F.lit(0)).alias("v"))
    parts = [
        ("distinct_contributors", C.MIN_CONTRIBUTORS, people), ("categories_above_k5_floor", C.MIN_CATEGORIES, above),
        ("ranked_domains_per_category", C.MIN_DOMAINS_PER_CATEGORY, domains), ("prompt_runs_per_segment", C.MIN_RUNS_PER_SEGMENT, runs),
    ]
    rows = [
        df.select(F.lit(name).alias("threshold_name"), F.lit(need).alias("required"), F.col("v").alias("actual"), (F.col("v") >= need).alias("passed"))
        for name, need, df in parts
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def contribution_status(consent: DataFrame, contributions: DataFrame) -> DataFrame:
    """Projects that ever consented, with the number of their contributions."""
    counts = contributions.groupBy("project_id").agg(F.count("*").alias("n"))
    return distinct_keys(consent, ["project_id"]).join(counts, "project_id", "left").select(
        "project_id", F.coalesce("n", F.lit(0)).alias("contributions"), F.col("n").isNotNull().alias("has_contributions")
    )
