"""Crawler log sources: access logs, custom patterns, CDN and analytics-export JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.scalars import as_ts, compute_once

RFC3339 = r"\A\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})\z"
CDN_KEYS = {
    "id": ["id", "ray_id", "request_id"], "ts": ["ts", "timestamp", "datetime", "time"],
    "user_agent": ["user_agent", "UserAgent", "client_user_agent"], "path": ["path", "Path", "uri", "url"],
    "status": ["status", "Status", "status_code"], "ip": ["ip", "client_ip", "ClientIP", "c-ip"], "region": ["region", "country", "colo"],
}
GA4_KEYS = {
    "id": ["event_id", "id"], "ts": ["ts", "timestamp", "event_timestamp"], "user_agent": ["user_agent", "ua"],
    "path": ["page_path", "path", "page_location"], "status": ["status"], "ip": ["ip", "client_ip"], "region": ["region", "country"],
}
HIT = ["raw_event_id", "ts", "user_agent", "path", "status", "source_adapter", "client_ip", "region"]


def _rfc3339(c: Column) -> Column:
    return F.when(c.rlike(RFC3339), c.try_cast("timestamp"))


def line_id(source: str, line: Column) -> Column:
    """Stable id of a line. A distributed read has no line numbers; equal lines of one source are one event."""
    return F.concat(F.lit(f"{source}:"), F.sha2(line, 256))


def read_access_log(lines: DataFrame, source: str, as_of) -> DataFrame:
    """Common and Combined format. A line without a quoted request is dropped; a bad time becomes `as_of`."""
    v = F.col("value")
    quoted = F.regexp_extract_all(v, F.lit('"([^"]*)"'), F.lit(1))
    request, agent = F.get(quoted, F.lit(0)), F.get(quoted, F.lit(2))
    stamp = F.regexp_extract(v, r"\[([^\]]*)\]", 1)
    path = F.regexp_extract(request, r"\A\s*\S+\s+(\S+)", 1)
    status = F.regexp_extract(v, r'\A[^"]*"[^"]*"\s*(\S+)', 1)
    code = F.when(status.rlike(r"\A\+?\d+\z"), status.try_cast("int"))
    ip = F.regexp_extract(v, r"\A\s*(\S+)", 1)
    return lines.filter((ip != "") & request.isNotNull()).select(
        line_id(source, v).alias("raw_event_id"),
        F.coalesce(F.try_to_timestamp(stamp, F.lit("dd/MMM/yyyy:HH:mm:ss Z")), as_ts(as_of)).alias("ts"),
        F.coalesce(agent, F.lit("")).alias("user_agent"), F.when(path == "", F.lit("/")).otherwise(path).alias("path"),
        F.coalesce(F.when(code <= 65535, code), F.lit(0)).alias("status"), F.lit(source).alias("source_adapter"),
        ip.alias("client_ip"), F.lit(None).cast("string").alias("region"),
    )


def read_custom_log(lines: DataFrame, pattern: str, source: str, as_of) -> DataFrame:
    """Whitespace pattern of `{label}`s. Lines of another length, or without agent or path, are dropped."""
    labels = [p.strip("{}") for p in pattern.split()]
    # A repeated label keeps its last position.
    at = {label: i for i, label in enumerate(labels)}
    parts = F.filter(F.split("value", r"\s+"), lambda x: x != "")
    none = F.lit(None).cast("string")
    field = lambda name: F.get("__p", F.lit(at[name])) if name in at else none
    agent, status = field("ua") if "ua" in at else field("user_agent"), field("status")
    code = F.when(status.rlike(r"\A\+?\d+\z"), status.try_cast("int"))
    split = compute_once(lines, "value", parts.alias("__p")).filter(F.size("__p") == len(labels))
    rows = compute_once(
        split,
        F.coalesce(field("id"), line_id(source, F.col("value"))).alias("raw_event_id"),
        F.coalesce(_rfc3339(field("ts")), as_ts(as_of)).alias("ts"), agent.alias("user_agent"), field("path").alias("path"),
        F.coalesce(F.when(code <= 65535, code), F.lit(0)).alias("status"), F.lit(source).alias("source_adapter"),
        field("ip").alias("client_ip"), field("region").alias("region"),
    )
    return rows.filter("user_agent IS NOT NULL AND path IS NOT NULL")


def _json_hits(df: DataFrame, source: str, keys: dict[str, list[str]], default_status: int) -> DataFrame:
    """One mapper for all JSON sources. The first present alias decides, even when its type is wrong."""
    # Staged so that the document is parsed once and each alias is looked up once.
    parsed = df.select("value", F.try_parse_json("value").alias("__d"))
    picked = parsed.select(
        "value", *[F.coalesce(*[F.try_variant_get("__d", f"$['{k}']", "variant") for k in ks]).alias(f"__{n}") for n, ks in keys.items()]
    )
    # Type and text of the chosen alias per field.
    typed = picked.select("value", *[
        e for n in keys for e in (F.schema_of_variant(f"__{n}").alias(f"{n}_type"), F.try_variant_get(f"__{n}", "$", "string").alias(f"{n}_text"))
    ])

    def string(name: str) -> Column:
        return F.when(F.col(f"{name}_type") == "STRING", F.col(f"{name}_text"))

    ts_text = F.col("ts_text")
    ts = F.when(F.col("ts_type") == "STRING", _rfc3339(ts_text)).when(F.col("ts_type") == "BIGINT", F.timestamp_micros(ts_text.try_cast("long")))
    code = F.when(F.col("status_type") == "BIGINT", F.col("status_text").try_cast("long"))
    rows = compute_once(
        typed,
        F.coalesce(string("id"), line_id(source, F.col("value"))).alias("raw_event_id"), ts.alias("ts"), string("user_agent").alias("user_agent"),
        string("path").alias("path"), F.coalesce(F.when(code.between(0, 65535), code), F.lit(default_status)).cast("int").alias("status"),
        F.lit(source).alias("source_adapter"), string("ip").alias("client_ip"), string("region").alias("region"),
    )
    return rows.filter("ts IS NOT NULL AND user_agent IS NOT NULL AND path IS NOT NULL")


def read_cdn_json(df: DataFrame, source: str) -> DataFrame:
    """CDN log documents in `value` (four vendors share the aliases); time is RFC 3339 or integer microseconds."""
    return _json_hits(df, source, CDN_KEYS, 0)


def read_ga4_json(df: DataFrame, source: str = "ga4") -> DataFrame:
    """Analytics-export documents; a missing status is 200."""
    return _json_hits(df, source, GA4_KEYS, 200)


def load_bot_ranges(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(bot_id, cidr) rows of a JSON file, or the seeded ranges."""
    schema = "bot_id STRING, cidr STRING"
    if path:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    return spark.createDataFrame(C.BOT_RANGES, schema)

