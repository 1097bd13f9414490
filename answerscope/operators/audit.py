"""HTML page audit, links and sitemaps. One pass per page, no shuffle until pages are summed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import scalars as S

STRUCTURAL, CITATION = "structural_content_suggestion", "citation_quality_uplift"
SEVERITIES = {"low": 1, "medium": 2, "high": 3}


def one_per_url(pages: DataFrame) -> DataFrame:
    """One row per url: the smallest html when a url repeats, whatever the input order."""
    rest = [c for c in pages.columns if c not in ("url", "html")]
    # The choice is made among digests; whole pages move once, to the join, and only equal rows can be left to collapse.
    marked = pages.withColumn("__sha", F.sha2("html", 256))
    order = F.struct("__sha", *rest)
    first = pages.select("url", *rest, F.sha2("html", 256).alias("__sha")).groupBy("url").agg(F.min(order).alias("__first"))
    named = first.withColumnRenamed("url", "__url")
    same = F.col("url").eqNullSafe(F.col("__url")) & order.eqNullSafe(F.col("__first"))
    return marked.join(named, same).dropDuplicates(["url"]).select("url", "html", *rest)


def _tag_texts(html: Column, tag: str) -> Column:
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1))
    return F.transform(found, S.clean_text)


def href_values(html: Column) -> Column:
    """Values of every `href=`, quoted or bare."""
    found = F.regexp_extract_all(html, F.lit(r"""(?is)href=\s*("[^"]*"|'[^']*'|(?!["'])[^\s>]*)"""), F.lit(1))
    return F.transform(found, lambda h: S.squeeze(F.regexp_replace(h, r"""\A["']|["']\z""", "")))


def _authority(scheme: Column, authority: Column) -> Column:
    """Lower case, without user info and without the scheme's default port."""
    host = F.lower(F.regexp_replace(authority, r"\A.*@", ""))
    return F.when(scheme == "http", F.regexp_replace(host, r":(80)?\z", "")).otherwise(F.regexp_replace(host, r":(443)?\z", ""))


def _tidy_path(path: Column) -> Column:
    """Resolve `.` and `..` segments and percent-encode what a url path may not contain."""

    def fold(p: Column) -> Column:
        segments = F.split(F.regexp_replace(p, r"\A/", ""), "/")
        folded = F.aggregate(
            segments, F.array().cast("array<string>"),
            lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(s == ".", acc).otherwise(F.array_append(acc, s)),
        )
        tail = F.when(p.rlike(r"/\.{1,2}\z"), F.lit("/")).otherwise(F.lit(""))
        return F.concat(F.lit("/"), F.array_join(folded, "/"), tail)

    clean = F.when(path.rlike(r"(\A|/)\.{1,2}(/|\z)"), fold(path)).when(path == "", F.lit("/")).otherwise(path)
    return S.let(clean, _percent)


def _percent(c: Column) -> Column:
    bad = r'[^\x21-\x7e]|["<>`{}]'
    coded = F.array_join(
        F.transform(
            F.split(c, ""),
            lambda ch: F.when(ch.rlike(bad), F.regexp_replace(F.hex(ch.cast("binary")), "(..)", "%$1")).otherwise(ch),
        ),
        "",
    )
    return F.when(c.rlike(bad), coded).otherwise(c)


_URL_PARTS = r"\A([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#]*))?([^?#]*)(\?[^#]*)?"


def _split_url(url: Column) -> Column:
    part = lambda i: F.regexp_extract(url, _URL_PARTS, i)
    return F.struct(F.lower(part(1)).alias("scheme"), part(2).alias("auth"), part(3).alias("path"), part(4).alias("query"))


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute http(s) url of a link on page `base`, without fragment; NULL for other schemes."""

    def absolute(u: Column) -> Column:
        ok = u["scheme"].isin("http", "https") & (u["auth"] != "")
        return F.when(
            ok, F.concat(u["scheme"], F.lit("://"), _authority(u["scheme"], u["auth"]), _tidy_path(u["path"]), _percent(u["query"]))
        )

    def on_page(b: Column) -> Column:
        ref = F.regexp_replace(href, r"(?s)#.*\z", "")
        ref_path, ref_query = F.regexp_extract(ref, r"\A([^?]*)", 1), F.regexp_extract(ref, r"(\?.*)\z", 1)
        folder = F.regexp_extract(b["path"], r"\A(.*/)", 1)
        path = (
            F.when(ref_path.startswith("/"), ref_path).when(ref_path == "", b["path"])
            .otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), ref_path))
        )
        return F.struct(b["scheme"].alias("scheme"), b["auth"].alias("auth"), path.alias("path"), F.when(ref == "", b["query"]).otherwise(ref_query).alias("query"))

    def target(b: Column) -> Column:
        parts = (
            F.when(href.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:"), _split_url(href))
            .when(href.startswith("//"), _split_url(F.concat(b["scheme"], F.lit(":"), href)))
            .otherwise(on_page(b))
        )
        return F.when(b["scheme"].isin("http", "https"), S.let(parts, absolute))

    return S.let(_split_url(base), target)


def origin(url: Column) -> Column:
    scheme = F.lower(F.regexp_extract(url, r"\A([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    return F.concat(scheme, F.lit("://"), _authority(scheme, F.regexp_extract(url, r"://([^/?#]*)", 1)))


def page_links(pages: DataFrame) -> DataFrame:
    """(url, link, kind): kind `owned` for crawlable links of the same origin, `outbound` for other origins."""
    hrefs = pages.select("url", F.explode(F.array_distinct(href_values(F.col("html")))).alias("href"))
    links = S.compute_once(hrefs, "url", resolve_url(F.col("url"), F.col("href")).alias("link")).filter("link IS NOT NULL")
    kind = F.when(origin(F.col("url")) == origin(F.col("link")), F.when(S.is_crawlable(F.col("link")), "owned")).otherwise("outbound")
    return S.compute_once(links, "url", "link", kind.alias("kind")).filter("kind IS NOT NULL").distinct()


def outbound_links(url: Column, html: Column) -> Column:
    """Sorted distinct links of a page to other origins, as an array."""
    # Only a link with its own scheme or host can leave the page's origin.
    foreign = F.filter(F.array_distinct(href_values(html)), lambda h: h.rlike(r"\A([A-Za-z][A-Za-z0-9+.-]*:|//)"))
    links = F.transform(foreign, lambda h: resolve_url(url, h))
    return S.let(origin(url), lambda own: F.sort_array(F.array_distinct(F.filter(links, lambda u: u.isNotNull() & (origin(u) != own)))))


def page_facts(pages: DataFrame) -> DataFrame:
    """Title, headings (h1, then h2, then h3), paragraphs, outbound links, lower html and text per page."""
    html = F.col("html")
    headings = F.concat(*[_tag_texts(html, t) for t in ("h1", "h2", "h3")])
    return pages.withColumns(
        {
            "title": F.get(_tag_texts(html, "title"), F.lit(0)),
            "headings": F.filter(headings, lambda h: h != ""),
            "lower_html": F.lower(html),
            "lower_text": F.lower(S.clean_text(html)),
            "outbound": outbound_links(F.col("url"), html),
        }
    ).withColumn("paragraph_count", F.regexp_count("lower_html", F.lit("<p")))


def audit_pages(pages: DataFrame, llms_txt: bool | Column = False) -> DataFrame:
    """Ten findings per page (pass 100, fail 0) and the page score, the rounded mean."""
    facts = page_facts(pages)
    low, text, title = F.col("lower_html"), F.col("lower_text"), F.col("title")
    has = S.contains_any
    outbound = F.size("outbound") > 0
    policy = llms_txt if isinstance(llms_txt, Column) else F.lit(llms_txt)
    robots = low.contains('name="robots"') & has(low, C.AI_ROBOTS_MARKERS)
    site_title = F.coalesce(title.contains(" | ") | title.contains(" - "), F.lit(False))
    asked = F.get(F.filter("headings", S.is_question), F.lit(0))
    sections = (F.size("headings") >= 2) & (F.col("paragraph_count") >= 2)
    counts = F.concat(F.size("headings").cast("string"), F.lit(" headings, "), F.col("paragraph_count").cast("string"), F.lit(" paragraphs"))
    one = lambda s: F.array(s if isinstance(s, Column) else F.lit(s))
    rules = [
        ("identity.schema_org_json_ld", "high", STRUCTURAL, has(low, C.SCHEMA_MARKERS), one(C.EVIDENCE["schema"])),
        ("identity.canonical_url", "medium", STRUCTURAL, has(low, C.CANONICAL_MARKERS), one(C.EVIDENCE["canonical"])),
        ("identity.site_name", "medium", STRUCTURAL, low.contains("og:site_name") | site_title, one(C.EVIDENCE["site_name"])),
        ("identity.llms_txt", "low", STRUCTURAL, policy | robots,
         one(F.when(policy, C.EVIDENCE["llms_txt"]).otherwise(C.EVIDENCE["robots"]))),
        ("extractability.answer_blocks", "high", STRUCTURAL, has(low, C.ANSWER_MARKERS) | text.contains("the answer"),
         one(C.EVIDENCE["answer"])),
        ("extractability.question_headings", "medium", STRUCTURAL, asked.isNotNull(), one(asked)),
        ("extractability.semantic_sections", "low", STRUCTURAL, sections, one(counts)),
        ("corroboration.outbound_links", "high", CITATION, outbound, F.slice("outbound", 1, 3)),
        ("corroboration.named_sources", "medium", CITATION, has(text, C.NAMED_SOURCE_PHRASES), one(C.EVIDENCE["sources"])),
        ("corroboration.source_context", "medium", CITATION, outbound & has(low, C.SOURCE_CONTEXT_WORDS),
         one(C.EVIDENCE["context"])),
    ]
    flagged = facts.withColumns({f"__p{i}": r[3] for i, r in enumerate(rules)})
    passed = sum((F.col(f"__p{i}").cast("int") for i in range(len(rules))), F.lit(0))
    n = len(rules)
    page_score = F.least(F.floor((passed * 100 + n // 2) / n), F.lit(100)).cast("int")
    rows = F.array(
        *[
            F.struct(
                F.lit(rule).alias("rule_id"), F.lit(rule.split(".")[0]).alias("category"), F.lit(sev).alias("severity"),
                F.when(F.col(f"__p{i}"), "pass").otherwise("fail" if sev == "high" else "warn").alias("status"),
                F.when(F.col(f"__p{i}"), 100).otherwise(0).alias("score"), F.lit(kind).alias("recommendation_kind"),
                F.when(F.col(f"__p{i}"), ev).otherwise(F.array().cast("array<string>")).alias("evidence"),
            )
            for i, (rule, sev, kind, _, ev) in enumerate(rules)
        ]
    )
    keep = [c for c in pages.columns if c != "html"]
    return flagged.select(*keep, "title", page_score.alias("page_score"), F.inline(rows))


def audit_summary(findings: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Site score (half-up mean of page scores) and pages; violations per rule."""
    first = findings.filter(F.col("rule_id") == "identity.schema_org_json_ld")
    n = F.count("*")
    site = first.groupBy(*by).agg(
        n.alias("pages"), F.least(F.floor((F.sum("page_score") + F.floor(n / 2)) / n), F.lit(100)).cast("int").alias("site_score")
    )
    rules = findings.groupBy(*by, "rule_id").agg(F.count_if(F.col("status") != "pass").alias("violations"))
    return site, rules


def audit_gate(findings: DataFrame, fail_on: Sequence[str]) -> DataFrame:
    """Violations that match a rule id or reach a severity named in `fail_on`; empty means the gate passes."""
    levels = [SEVERITIES[f] for f in fail_on if f in SEVERITIES]
    rules = [f for f in fail_on if f not in SEVERITIES]
    level = F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1)
    hit = F.col("rule_id").isin(rules) if rules else F.lit(False)
    if levels:
        hit = hit | (level >= min(levels))
    return findings.filter((F.col("status") != "pass") & hit)


def audit_history(audit_runs: DataFrame, project_id=None) -> DataFrame:
    """Audit runs with the score change against the run before of the same target, newest first.

    The earlier score comes from an as-of lookup, so a target with very many runs is not one task.
    """
    from ..functions.asof import as_of_join

    mine = S.opt_eq(audit_runs, "project_id", project_id)
    prior = mine.select("project_id", "target", F.col("created_at").alias("__at"), F.col("score").alias("prior_score"), F.col("audit_id").alias("__id"))
    out = as_of_join(mine, prior, ["project_id", "target"], "created_at", "__at", ["prior_score"], ["__id"], chunk=("day", "minute"), strict=True)
    return out.withColumn("score_change", F.col("score") - F.col("prior_score")).drop("prior_score").orderBy(F.col("created_at").desc(), "audit_id")


def sitemap_locs(xml: DataFrame, same_origin_as: Column | None = None, limit: int | None = None) -> DataFrame:
    """Sorted distinct <loc> urls of sitemap documents in `xml`, optionally of one origin and at most `limit`."""
    found = F.regexp_extract_all("xml", F.lit(r"(?is)<loc>(.*?)</loc>"), F.lit(1))
    locs = xml.select(F.explode(found).alias("loc"), *([same_origin_as.alias("__o")] if same_origin_as is not None else []))
    locs = locs.withColumn("loc", S.squeeze(F.col("loc")))
    if same_origin_as is not None:
        locs = locs.filter(origin(F.col("loc")) == origin(F.col("__o")))
    out = locs.select("loc").distinct()
    return out.orderBy("loc").limit(limit) if limit is not None else out
