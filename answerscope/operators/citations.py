"""Citation metrics. Citations meet the runs of the window first and are summed once, by what the metric asks for,
so the history outside the window is never aggregated."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.ordering import at_least_one, rank_by_total, time_chunks, top_k_per_group, top_n
from .visibility import base_runs


def run_domains(citations: DataFrame) -> DataFrame:
    """(run, domain, source type) rows with what the metrics sum: frequency, rows and a weight of at least 1."""
    weight = F.greatest(F.col("frequency"), F.lit(1)).alias("weight")
    return citations.select("run_id", "domain", "source_type", "frequency", F.lit(1).cast("long").alias("rows"), weight)


def in_window(citations: DataFrame, window_runs: DataFrame) -> DataFrame:
    """Citations of the given runs only."""
    return citations.join(window_runs.select("run_id"), "run_id", "left_semi")


def _base(runs, prompts, citations, as_of, days, status=None, provider=None, prompt=None) -> DataFrame:
    recent = S.opt_eq(S.window_filter(runs, as_of, days), "provider", provider)
    if status:
        recent = recent.filter(F.col("status") == status)
    slim = base_runs(recent.select("run_id", "prompt_id", "provider", "model", "started_at"), prompts)
    return S.opt_eq(slim, "prompt", prompt).join(run_domains(citations), "run_id")


def citation_summary(
    runs, prompts, citations, as_of, days: int, limit: int | None = 50, null_is_value: bool = True,
    provider: str | None = None, prompt: str | None = None,
) -> DataFrame:
    """Frequency and modal source type per domain; the top `limit` per project, None for all.

    Not filtered by status. The mode counts rows, ties go to the type's name with NULL last.
    """
    base = _base(runs, prompts, citations, as_of, days, provider=provider, prompt=prompt)
    typed = base.groupBy("project_id", "domain", "source_type").agg(
        F.sum("frequency").alias("frequency"), F.sum("rows").alias("rows")
    )
    votes = F.col("rows") if null_is_value else F.when(F.col("source_type").isNotNull(), F.col("rows")).otherwise(F.lit(0))
    # At most one row per source type is left per domain, so min_by needs no window over the domain.
    best = F.min_by(
        F.col("source_type"),
        F.struct((-votes).alias("v"), F.col("source_type").isNull().alias("n"), F.coalesce("source_type", F.lit("")).alias("s")),
    )
    out = typed.groupBy("project_id", "domain").agg(F.sum("frequency").alias("frequency"), best.alias("source_type"))
    if limit is None:
        return out
    order = [F.col("frequency").desc(), F.col("domain")]
    return top_k_per_group(out, ["project_id"], order, at_least_one(limit)).drop("rn")


def sample_runs(runs, prompts, citations, as_of, days: int, k: int = 5) -> DataFrame:
    """The k lowest run ids citing each domain. Spark keeps k per domain before the shuffle."""
    base = _base(runs, prompts, citations, as_of, days).select("project_id", "domain", "run_id").distinct()
    top = top_k_per_group(base, ["project_id", "domain"], [F.col("run_id")], k)
    return top.groupBy("project_id", "domain").agg(F.sort_array(F.collect_list("run_id")).alias("sample_run_ids"))


def provider_breakdown(runs, prompts, citations, as_of, days: int, domain: str | None = None) -> DataFrame:
    """Citation frequency per provider identity."""
    base = S.opt_eq(_base(runs, prompts, citations, as_of, days), "domain", domain)
    return base.groupBy("project_id", "provider_identity").agg(F.sum("frequency").alias("frequency"))


def growth_rate(runs, prompts, citations, as_of, days: int, provider: str | None = None) -> DataFrame:
    """(current - prior) / prior over two adjacent equal windows; NULL when prior is 0. One pass."""
    recent = runs.filter(F.col("started_at") >= S.days_before(as_of, 2 * days, high=730))
    slim = base_runs(S.opt_eq(recent, "provider", provider).select("run_id", "prompt_id", "provider", "model", "started_at"), prompts)
    is_cur = F.col("started_at") >= S.days_before(as_of, days)
    agg = slim.join(run_domains(citations), "run_id").groupBy("project_id").agg(
        F.coalesce(F.sum(F.when(is_cur, F.col("frequency"))), F.lit(0)).alias("current"),
        F.coalesce(F.sum(F.when(~is_cur, F.col("frequency"))), F.lit(0)).alias("prior"),
    )
    return agg.withColumn("growth_rate", S.safe_rate(F.col("current") - F.col("prior"), F.col("prior"), None))


def citation_score(runs, prompts, citations, as_of, days: int) -> DataFrame:
    """0..100: volume up to 40, domain diversity up to 30, share of quality sources up to 30."""
    per_domain = _base(runs, prompts, citations, as_of, days).groupBy("project_id", "domain").agg(
        F.sum("frequency").alias("f"),
        F.coalesce(
            F.sum(F.when(F.col("source_type").isNull() | ~F.col("source_type").isin("reddit", "youtube"), F.col("frequency"))),
            F.lit(0),
        ).alias("q"),
    )
    agg = per_domain.groupBy("project_id").agg(
        F.sum("f").alias("total"), F.count("*").alias("distinct_domains"), F.sum("q").alias("quality")
    )
    volume = F.least(F.col("total") / 100.0, F.lit(1.0)) * 40.0
    diversity = F.least(F.col("distinct_domains") / 30.0, F.lit(1.0)) * 30.0
    share = S.safe_rate(F.col("quality"), F.col("total"))
    r = S.round_half_up
    return agg.select(
        "project_id", "total", "distinct_domains", r(share, 3).alias("quality_share"),
        r(volume, 1).alias("volume_component"), r(diversity, 1).alias("diversity_component"),
        r(share * 30.0, 1).alias("quality_component"), r(volume + diversity + share * 30.0, 1).alias("score"),
    )


def citation_trend(runs, prompts, citations, as_of, hours: int, limit: int) -> DataFrame:
    """Hourly frequency of each project's top domains of the window."""
    recent = runs.filter(F.col("started_at") >= S.hours_before(as_of, hours))
    slim = base_runs(recent.select("run_id", "prompt_id", "provider", "model", "started_at"), prompts)
    hourly = slim.join(run_domains(citations), "run_id").groupBy(
        "project_id", "domain", S.hour(F.col("started_at")).alias("bucket")
    ).agg(F.sum("frequency").alias("frequency"))
    totals = hourly.groupBy("project_id", "domain").agg(F.sum("frequency").alias("total"))
    top = top_k_per_group(totals, ["project_id"], [F.col("total").desc(), F.col("domain")], limit)
    return hourly.join(top.select("project_id", "domain"), ["project_id", "domain"], "left_semi")


def citation_graph(runs, prompts, citations, as_of, days: int, max_edges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges provider -> domain weighted by frequency (a row counts at least 1), and their end points."""
    base = _base(runs, prompts, citations, as_of, days, status="ok")
    edges = base.groupBy("project_id", F.col("provider_identity").alias("source"), F.col("domain").alias("target")).agg(
        F.sum("weight").alias("weight")
    )
    if max_edges is not None:
        order = [F.col("weight").desc(), F.col("source"), F.col("target")]
        edges = top_k_per_group(edges, ["project_id"], order, max_edges).drop("rn")
    ends = edges.select("project_id", F.lit("provider").alias("kind"), F.col("source").alias("label")).unionByName(
        edges.select("project_id", F.lit("domain").alias("kind"), F.col("target").alias("label"))
    )
    nodes = ends.distinct().select("project_id", F.concat_ws(":", "kind", "label").alias("id"), "kind", "label")
    return edges, nodes


def domains_by_type(summary: DataFrame) -> DataFrame:
    """Domains and frequency per source type; NULL is `unknown`."""
    return summary.groupBy("project_id", F.coalesce("source_type", F.lit("unknown")).alias("source_type")).agg(
        F.count("*").alias("domains"), F.sum("frequency").alias("frequency")
    )


def merge_citations(a: DataFrame, b: DataFrame, keys=("run_id",)) -> DataFrame:
    """Union of two citation lists; frequencies add up per (domain, url), a NULL url being one value."""
    both = a.unionByName(b)
    return both.groupBy(*keys, "domain", "url").agg(
        F.sum("frequency").alias("frequency"), F.min("source_type").alias("source_type")
    )


def set_overlap(a: DataFrame, b: DataFrame, key: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Each distinct key with its side: both, only_a, only_b. Sizes give Jaccard; see set_sizes."""
    sides = a.select(*by, key, F.lit(1).alias("__side")).unionByName(b.select(*by, key, F.lit(2).alias("__side")))
    seen = sides.groupBy(*by, key).agg(F.bit_or("__side").alias("__m"))
    return seen.select(*by, key, F.element_at(F.array(F.lit("only_a"), F.lit("only_b"), F.lit("both")), F.col("__m")).alias("side"))


def set_sizes(overlap: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """intersection, union, only_a, only_b and the Jaccard distance of a set_overlap result."""
    out = overlap.groupBy(*by).agg(
        F.count_if(F.col("side") == "both").alias("intersection"), F.count("*").alias("union"),
        F.count_if(F.col("side") == "only_a").alias("only_a"), F.count_if(F.col("side") == "only_b").alias("only_b"),
    )
    return out.withColumn("distance", F.when(F.col("union") > 0, 1 - F.col("intersection") / F.col("union")).otherwise(0.0))


def domain_drift(citations, runs, prompts, as_of, days: int) -> DataFrame:
    """Per project: which cited domains were gained, dropped or kept between two adjacent windows."""
    slim = base_runs(
        runs.filter((F.col("started_at") >= S.days_before(as_of, 2 * days, high=730)) & (F.col("started_at") <= S.as_ts(as_of)))
        .select("run_id", "prompt_id", "provider", "model", "started_at"),
        prompts,
    )
    cited = slim.join(citations.select("run_id", "domain"), "run_id")
    side = F.when(F.col("started_at") >= S.days_before(as_of, days), 2).otherwise(1)
    seen = cited.groupBy("project_id", "domain").agg(F.bit_or(side).alias("m"))
    return seen.select(
        "project_id", "domain",
        F.element_at(F.array(F.lit("dropped"), F.lit("gained"), F.lit("kept")), F.col("m")).alias("change"),
    )


def drift_distance(drift: DataFrame) -> DataFrame:
    """Jaccard distance and sizes per project from domain_drift rows."""
    out = drift.groupBy("project_id").agg(
        F.count_if(F.col("change") == "gained").alias("gained"),
        F.count_if(F.col("change") == "dropped").alias("dropped"), F.count("*").alias("union"),
    )
    return out.withColumn("distance", S.safe_rate(F.col("gained") + F.col("dropped"), F.col("union")))


def diff_runs(mentions: DataFrame, citations: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each run added and dropped against the run before it of the same prompt and provider.

    The prior run is looked up hour by hour, so a hot prompt x provider is not one task. Every run's rows are met once: as
    their own run's (side 1) and as the past of the run that follows (side 2).
    """
    from ..functions.ordering import with_previous

    placed = with_previous(
        runs.select("run_id", "started_at", "prompt_id", "provider"), ["prompt_id", "provider"], ["started_at", "run_id"], {"prior_run_id": "run_id"},
        time_chunks(F.col("started_at")),
    )
    pairs = placed.filter("prior_run_id IS NOT NULL").select("run_id", "prior_run_id")
    own = F.struct(F.col("run_id").alias("member"), F.lit(1).alias("side"))
    past = F.struct(F.col("prior_run_id").alias("member"), F.lit(2).alias("side"))
    sides = pairs.select("run_id", "prior_run_id", F.inline(F.array(own, past)))

    def changes(rows: DataFrame, key: list[str]) -> DataFrame:
        met = rows.withColumnRenamed("run_id", "member").join(sides, "member")
        seen = met.groupBy("run_id", "prior_run_id", *key).agg(F.bit_or("side").alias("m")).filter("m < 3")
        return seen.select("run_id", "prior_run_id", *key, F.when(F.col("m") == 1, "added").otherwise("dropped").alias("change"))

    named = mentions.select("run_id", F.lower("entity").alias("entity"), "is_brand")
    return changes(named, ["entity", "is_brand"]), changes(citations.select("run_id", "domain", "url"), ["domain", "url"])


def leaderboard(citations: DataFrame, entities: DataFrame, limit: int = 100) -> DataFrame:
    """The most cited domains over all projects, with registry names and claim status."""
    totals = citations.groupBy("domain").agg(F.sum("frequency").alias("total"))
    best = top_n(totals, "total", limit, ["domain"])
    # `limit` rows at most are left, so one unpartitioned window is small by construction.
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("total").desc(), "domain")))
    return enrich_domains(ranked.withColumn("domain", S.normalize_domain(F.col("domain"))), entities)


def enrich_domains(df: DataFrame, entities: DataFrame) -> DataFrame:
    """Registry name and claim status; unknown domains show themselves as `unclaimed`."""
    reg = entities.select("domain", F.col("display_name").alias("__n"), F.col("claim_status").alias("__s"))
    return df.join(reg, "domain", "left").select(
        *df.columns, F.coalesce("__n", "domain").alias("display_name"), F.coalesce("__s", F.lit("unclaimed")).alias("claim_status")
    )


def domain_profile(citations: DataFrame) -> DataFrame:
    """Per domain: total, distinct citing runs and rank = 1 + domains cited strictly more."""
    per_run = citations.groupBy("domain", "run_id").agg(F.sum("frequency").alias("f"))
    totals = per_run.groupBy("domain").agg(F.sum("f").alias("total"), F.count("*").alias("citing_runs"))
    return rank_by_total(totals, "total")
