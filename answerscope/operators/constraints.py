"""Data-quality reports: what the reference tables enforce as constraints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

def crawler_rules() -> dict[str, Column]:
    """Status 100..599 and exactly the address column the privacy mode allows."""
    have = sum((F.col(c).isNotNull().cast("int") for c in ("client_ip", "client_ip_truncated", "client_ip_hash")), F.lit(0))
    shape = (
        F.when(F.col("privacy_mode") == "raw", F.col("client_ip").isNotNull())
        .when(F.col("privacy_mode") == "truncated", F.col("client_ip_truncated").isNotNull())
        .otherwise(F.col("client_ip_hash").isNotNull())
    )
    return {"status_range": F.col("status").between(100, 599), "one_ip_shape": (have == 0) | ((have == 1) & shape)}


def claim_rules() -> dict[str, Column]:
    return {"confidence_range": F.col("confidence").between(0, 100)}


def fact_rules() -> dict[str, Column]:
    return {"valid_range": F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from"))}


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) in one aggregation; a NULL rule result passes, like a CHECK."""
    row = df.agg(*[F.count_if(~rule).alias(name) for name, rule in rules.items()])
    items = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])
    return row.select(F.inline(items))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter(F.col("rows") > 1)


def validate_ingest(df: DataFrame, prompts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs that may be stored, and the others with the code of the first rule they break."""
    blank = lambda c: F.coalesce(S.squeeze(F.col(c)) == "", F.lit(True))
    bad_meta = F.col("metadata").isNotNull() & ~F.coalesce(F.col("metadata").rlike(r"(?s)\A\s*\{.*\}\s*\z"), F.lit(False))
    code = (
        F.when(~S.is_slug(F.col("prompt_slug")), "bad_slug")
        .when(blank("model"), "empty_model")
        .when(F.col("raw_response").isNull() & F.col("response_text").isNull(), "no_content")
        .when(bad_meta, "bad_metadata")
        .when(~F.coalesce(S.is_provider(F.col("provider")), F.lit(False)), "provider_not_supported")
    )
    known = prompts.select("project_id", F.col("name").alias("prompt_slug"), F.lit(True).alias("__known")).distinct()
    judged = df.join(known, ["project_id", "prompt_slug"], "left").withColumn(
        "code", F.coalesce(code, F.when(F.col("__known").isNull(), "prompt_not_found"))
    ).drop("__known")
    return judged.filter("code IS NULL").drop("code"), judged.filter("code IS NOT NULL")


def validate_suite(suite: DataFrame, current_terms: str) -> DataFrame:
    """Violations of a prompt suite: one row per entry and broken rule.

    Input: one row per entry with suite_id, suite_version, terms_version and the entry's own fields.
    """
    fields = ["slug", "version", "category", "description", "contribution_cohort", "cohort_description", "prompt_template"]
    empty = lambda c: F.coalesce(S.squeeze(F.col(c)) == "", F.lit(True))
    any_empty = F.lit(False)
    for f in fields:
        any_empty = any_empty | empty(f)
    rules = {
        "terms_version_mismatch": F.col("terms_version") != current_terms,
        "empty_suite_id_or_version": empty("suite_id") | empty("suite_version"),
        "empty_field": any_empty,
        "version_differs_from_suite": F.col("version") != F.col("suite_id"),
        "not_namespaced": ~F.col("slug").startswith(F.concat(F.col("suite_id"), F.lit("/"))),
        "unsafe_slug": ~S.is_slug(F.col("slug"), "/"),
    }
    broken = F.filter(F.array(*[F.when(F.coalesce(r, F.lit(False)), F.lit(n)) for n, r in rules.items()]), lambda x: x.isNotNull())
    per_entry = suite.select("suite_id", "slug", F.explode(broken).alias("violation"))
    repeated = duplicate_keys(suite, ["suite_id", "slug"]).select("suite_id", "slug", F.lit("duplicate_slug").alias("violation"))
    return per_entry.unionByName(repeated)
