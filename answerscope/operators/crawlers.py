"""Crawler traffic: bot identity, address verification, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.ordering import top_k_per_group


def verify_ips(hits: DataFrame, ranges: DataFrame, bot: str = "bot_id", ip: str = "client_ip") -> DataFrame:
    """`ip_verified`: any range of that bot contains the address. Families never mix; bad addresses fail.

    Ranges become one row per bot, so a hit meets one row and the join cannot multiply hits. A range is the beginnings its addresses
    share, dealt to the root of their number of lists by a hash: an address is looked up once for each length that occurs, in one
    short list, however many ranges the bot has.
    """
    starts = ranges.select(F.col("bot_id").alias("__bot"), F.explode(S.cidr_prefixes(F.col("cidr"))).alias("start"))
    of_bot = starts.groupBy("__bot").agg(F.collect_set("start").alias("all"), F.collect_set(F.length("start")).alias("__lengths"))
    listed = of_bot.withColumn("lists", F.ceil(F.sqrt(F.size("all"))).cast("int"))
    place = lambda start, lists: F.pmod(F.xxhash64(start), lists).cast("int")
    per_bot = listed.select(
        "__bot", "__lengths",
        F.transform(F.sequence(F.lit(0), F.col("lists") - 1), lambda i: F.filter("all", lambda s: place(s, F.col("lists")) == i)).alias("__starts"),
    )
    keyed = hits.withColumn("__key", S.ip_key(F.col(ip)))

    def found(start: Column) -> Column:
        return F.array_contains(F.get("__starts", place(start, F.size("__starts"))), start)

    inside = F.exists("__lengths", lambda n: found(F.left("__key", n)))
    return (
        keyed.join(per_bot, F.col(bot) == F.col("__bot"), "left")
        .withColumn("ip_verified", F.coalesce(inside, F.lit(False)))
        .drop("__key", "__bot", "__lengths", "__starts")
    )


def normalize_hits(hits: DataFrame, ranges: DataFrame, mode: str = "hashed", salt: str = "") -> DataFrame:
    """Raw hits to stored events: known bots only, clean path, verified flag, one address column."""
    known = hits.withColumn("bot_id", S.bot_id(F.col("user_agent"))).filter(F.col("bot_id").isNotNull())
    checked = verify_ips(known, ranges).withColumns(
        {"path": S.crawler_path(F.col("path")), "region": F.when(S.squeeze(F.col("region")) != "", F.col("region"))}
    )
    return S.store_ip(checked, mode, salt).drop("user_agent")


def _window(events: DataFrame, as_of, days: int, include_unverified: bool) -> DataFrame:
    recent = S.window_filter(events, as_of, days, col="ts")
    return recent if include_unverified else recent.filter("ip_verified")


def crawler_bots(events, as_of, days: int, include_unverified: bool = False) -> DataFrame:
    return _window(events, as_of, days, include_unverified).groupBy("project_id", "bot_id").agg(
        F.count("*").alias("hits"), F.count_if("ip_verified").alias("verified_hits"),
        F.count_if(F.col("status") >= 400).alias("error_hits"),
    )


def _paths(events, as_of, days, include_unverified) -> DataFrame:
    return _window(events, as_of, days, include_unverified).groupBy("project_id", "path").agg(
        F.count("*").alias("hits"), F.count_if(F.col("status") >= 400).alias("error_hits")
    )


def crawler_paths(events, as_of, days: int, include_unverified: bool = False, limit: int = 20) -> DataFrame:
    """Each project's top paths by hits, then name."""
    paths = _paths(events, as_of, days, include_unverified)
    return top_k_per_group(paths, ["project_id"], [F.col("hits").desc(), F.col("path")], limit).drop("rn")


def crawler_error_paths(events, as_of, days: int, include_unverified: bool = False, limit: int = 20) -> DataFrame:
    """Each project's top paths by errors, then hits, then name."""
    bad = _paths(events, as_of, days, include_unverified).filter(F.col("error_hits") > 0)
    return top_k_per_group(bad, ["project_id"], [F.col("error_hits").desc(), F.col("hits").desc(), F.col("path")], limit).drop("rn")


def crawler_trend(events, as_of, days: int, include_unverified: bool = False) -> DataFrame:
    """Hits per project and UTC day, also as an epoch-millisecond point."""
    daily = _window(events, as_of, days, include_unverified).groupBy("project_id", S.day(F.col("ts")).alias("day")).agg(F.count("*").alias("hits"))
    return daily.withColumn("epoch_ms", F.unix_millis(F.col("day").cast("timestamp")))


def crawl_refer_ratio(events, as_of, days: int, referrals: DataFrame | None = None) -> DataFrame:
    """Verified crawl hits per project and bot against attributed referrals; `crawls_only` without a referral table."""
    crawls = _window(events, as_of, days, False).groupBy("project_id", "bot_id").agg(F.count("*").alias("verified_crawl_hits"))
    if referrals is None:
        return crawls.withColumns(
            {"attributed_referrals": F.lit(0).cast("long"), "ratio": F.lit(None).cast("double"), "state": F.lit("crawls_only")}
        )
    refs = S.window_filter(referrals, as_of, days, col="ts").groupBy("project_id", "bot_id").agg(F.count("*").alias("n"))
    return crawls.join(refs, ["project_id", "bot_id"], "left").select(
        "project_id", "bot_id", "verified_crawl_hits", F.coalesce("n", F.lit(0)).alias("attributed_referrals"),
        S.safe_rate(F.coalesce("n", F.lit(0)), F.col("verified_crawl_hits"), None).alias("ratio"),
        F.lit("attributed").alias("state"),
    )
