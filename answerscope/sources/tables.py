"""Star-schema tables with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP, o_orderpriority STRING",
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE, "
        "l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP"
    ),
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}

# The product tables as they are stored in Parquet (ids as text).
STAR = {
    "projects": "project_id STRING, name STRING, created_at TIMESTAMP, archived_at TIMESTAMP, org_id STRING, variants ARRAY<STRING>, "
    "competitors ARRAY<STRUCT<name: STRING, variants: ARRAY<STRING>>>, site_url STRING",
    "prompts": "prompt_id STRING, project_id STRING, name STRING, text STRING, tags ARRAY<STRING>, created_at TIMESTAMP",
    "runs": "run_id STRING, prompt_id STRING, provider STRING, model STRING, started_at TIMESTAMP, finished_at TIMESTAMP, raw_response STRING, "
    "request_parameters STRING, status STRING, error_kind STRING, created_at TIMESTAMP, org_id STRING",
    "mentions": "run_id STRING, entity STRING, char_offset INT, rank INT, matched_text STRING, is_brand BOOLEAN, sentiment_label STRING, "
    "sentiment_score SMALLINT, sentiment_lane STRING",
    "citations": "citation_id STRING, run_id STRING, url STRING, domain STRING, frequency INT, source_type STRING",
    "crawler_events": "project_id STRING, ts TIMESTAMP, bot_id STRING, path STRING, status INT, source_adapter STRING, raw_event_id STRING, "
    "ip_verified BOOLEAN, region STRING, client_ip STRING, client_ip_truncated STRING, client_ip_hash STRING, privacy_mode STRING",
    "site_events": "event_type STRING, session_id STRING, path STRING, referrer STRING, properties STRING, ts TIMESTAMP",
}


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table with its declared schema; nothing is inferred."""
    schema = SCHEMAS.get(name) or STAR[name]
    suffix = ".parquet" if name in SCHEMAS else ""
    return spark.read.schema(schema).parquet(f"{folder}/{name}{suffix}")


def load_tables(spark: SparkSession, folder: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    return {n: load_table(spark, folder, n) for n in (names or list(SCHEMAS))}
