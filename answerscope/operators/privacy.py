"""Redaction, erasure and audience jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.ordering import at_least_one


def hmac_sha256(message: Column, key: bytes) -> Column:
    """Hex HMAC-SHA256 of a text; the two key pads are literals, so it is two `sha2` calls per row."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.lit(bytearray(b ^ x for b in block))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def redact_runs(runs: DataFrame, secret: bytes, consented_terms: Column | str, current_terms: str) -> tuple[DataFrame, DataFrame]:
    """Allow-listed columns of runs that may be shared, with the hour only and a keyed project hash; and the refused ones."""
    terms = consented_terms if isinstance(consented_terms, Column) else F.lit(consented_terms)
    reason = F.when(~F.coalesce(terms == current_terms, F.lit(False)), "stale_consent").when(~S.is_slug(F.col("prompt_slug")), "invalid_slug")
    judged = runs.withColumn("reason", reason)
    accepted = judged.filter("reason IS NULL").select(
        "prompt_slug", "provider", "model", S.hour(F.col("observed_at")).alias("observed_at_hour"), "observed_rank",
        "citation_domains", hmac_sha256(F.col("project_id").cast("string"), secret).alias("project_hmac"),
        F.lit(current_terms).alias("terms_version"),
    )
    return accepted, judged.filter("reason IS NOT NULL").select("run_id", "reason")


def erase_subject(audit: DataFrame, org_id: str, actor: str) -> tuple[DataFrame, DataFrame]:
    """Audit rows with one actor tombstoned and the e-mail removed, and the number of rows touched."""
    hit = (F.col("org_id") == org_id) & (F.col("actor_login") == actor)
    kept = F.map_filter(F.from_json("metadata", "map<string,string>"), lambda k, _: ~k.isin("email", "erased"))
    marked = F.to_json(F.map_concat(F.coalesce(kept, F.create_map().cast("map<string,string>")), F.create_map(F.lit("erased"), F.lit("true"))))
    out = audit.withColumns(
        {"actor_login": F.when(hit, "<erased>").otherwise(F.col("actor_login")), "metadata": F.when(hit, marked).otherwise(F.col("metadata"))}
    )
    return out, audit.agg(F.count_if(hit).alias("audit_rows_tombstoned"))


def export_subject(audit: DataFrame, org_id: str, actor: str, limit: int | None = None) -> DataFrame:
    """All of the actor's events in the org, with the row as JSON; with a limit the newest ones."""
    mine = S.org_scope(audit, org_id).filter(F.col("actor_login") == actor)
    cols = ["id", "ts", "actor_login", "action", "target"]
    if limit is not None:
        mine = mine.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(at_least_one(limit))
    return mine.select(*cols, F.to_json(F.struct(*cols)).alias("record"))


def erase_domain(domain: str, entities, attempts, disputes, contributions) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Entity, attempts and disputes without the domain, contributions de-linked, and the counts."""
    def without(df):
        return df.filter((F.col("domain") != domain) | F.col("domain").isNull())

    gone = F.col("domain") == domain
    link = F.when(F.col("entity_domain") == domain, F.lit(None)).otherwise(F.col("entity_domain"))
    counts = [
        df.agg(F.lit(name).alias("table_name"), F.count_if(cond).alias("rows"))
        for name, df, cond in (
            ("entities", entities, gone), ("verification_attempts", attempts, gone), ("disputes", disputes, gone),
            ("contributions_delinked", contributions, F.col("entity_domain") == domain),
        )
    ]
    total = counts[0]
    for c in counts[1:]:
        total = total.unionByName(c)
    return without(entities), without(attempts), without(disputes), contributions.withColumn("entity_domain", link), total


def select_audience(subscriptions: DataFrame, suppressions: DataFrame, category: str) -> DataFrame:
    """Decision per recipient: list suppression, then preference, then EU consent, then send."""
    listed = suppressions.select(F.lower("email").alias("__e")).distinct()
    out = subscriptions.join(listed, F.lower("email") == F.col("__e"), "left")
    wanted = F.col("rank_change_enabled") if category == "rank_change" else F.col("digest_frequency") != "off"
    decision = (
        F.when(F.col("__e").isNotNull(), "suppressed_by_list")
        .when(F.col("all_marketing_off") | ~wanted, "disabled_by_preference")
        .when(F.col("is_eu_resident") & ~F.col("marketing_consent"), "blocked_by_eu_consent").otherwise("send")
    )
    return out.withColumn("decision", decision).drop("__e")


def drop_suppressed(df: DataFrame, disputes: DataFrame, col: str = "domain") -> DataFrame:
    """Rows whose domain has no suppressing dispute."""
    hidden = disputes.filter("suppressed").select(F.col("domain").alias(col)).distinct()
    return df.join(hidden, col, "left_anti")


def reopen_expired(entities: DataFrame, as_of, days: int = 14) -> DataFrame:
    """Revoked entities past their grace period become unclaimed with their claim fields cleared."""
    over = (F.col("claim_status") == "revoked") & (F.col("grace_period_start") < S.as_ts(as_of) - F.make_dt_interval(F.lit(days)))
    over = F.coalesce(over, F.lit(False))
    clear = lambda c: F.when(~over, F.col(c))
    return entities.withColumns(
        {
            "claim_status": F.when(over, "unclaimed").otherwise(F.col("claim_status")), "verified_at": clear("verified_at"),
            "verification_method": clear("verification_method"), "grace_period_start": clear("grace_period_start"),
        }
    )
