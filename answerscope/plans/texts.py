"""Answer extraction, page audit and similarity queries over whole texts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import scalars as S
from ..operators import audit as A
from ..operators import extract as X
from ..operators import similarity as M
from ..session import checkpoint_root
from .catalog import query, r
from .views import sql


def _words(terms) -> str:
    return "[" + ", ".join(f"'{w}'" for w in terms) + "]"


_HITS = """needles AS (SELECT project_id, entity, is_brand, ordinal, unnest([entity, variant]) AS v FROM dictionary),
  hits AS (SELECT a.project_id, a.run_id, a.text, n.entity, n.is_brand, n.ordinal, n.v, instr(lower(a.text), lower(n.v)) AS pos FROM answers a JOIN needles n ON n.project_id = a.project_id WHERE instr(lower(a.text), lower(n.v)) > 0),
  one AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY run_id, entity ORDER BY pos, strlen(v) DESC, v) = 1),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY pos, (NOT is_brand)::INT, ordinal, entity) AS rank, strlen(left(lower(text), pos - 1)) AS char_offset FROM one)"""

_TONE = f""", ctx AS (SELECT *, [w FOR w IN regexp_split_to_array(lower(substring(text, greatest(pos - 160, 1), pos - 1 + 160 - greatest(pos - 161, 0))), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+')] AS words FROM ranked),
  tone AS (SELECT *, len([w FOR w IN words IF list_contains({_words(C.POSITIVE_TERMS)}, w)]) - len([w FOR w IN words IF list_contains({_words(C.NEGATIVE_TERMS)}, w)]) AS d FROM ctx)"""


@query("entity_matches", "J-8 W-5 T-1 T-2", sql(f"WITH {_HITS} SELECT project_id, run_id, entity, is_brand, char_offset, rank, substring(text, pos, length(v)) AS matched_text FROM ranked", "answers", "dictionary"))
def _(v):
    return X.match_entities(v.answers, v.dictionary)


@query("extracted_mentions", "X-1 X-3", sql(f"""WITH {_HITS}{_TONE} SELECT project_id, run_id, entity, is_brand, char_offset, rank, substring(text, pos, length(v)) AS matched_text,
  CASE WHEN d > 0 THEN 'positive' WHEN d < 0 THEN 'negative' ELSE 'neutral' END AS sentiment_label,
  CASE WHEN d > 0 THEN 60 + least(d, 4) * 10 WHEN d < 0 THEN 40 - least(-d, 4) * 10 ELSE 50 END AS sentiment_score, 'deterministic_lexicon' AS sentiment_lane FROM tone""", "answers", "dictionary"))
def _(v):
    return X.extract_mentions(v.answers, v.dictionary)


@query("brand_rank", "X-2", sql(f"WITH {_HITS} SELECT a.run_id, r.rank AS brand_rank FROM answers a LEFT JOIN ranked r ON r.run_id = a.run_id AND r.is_brand", "answers", "dictionary"))
def _(v):
    return X.brand_rank(v.answers, X.match_entities(v.answers, v.dictionary))


@query("ranked_hits", "W-5", sql(f"""WITH {_HITS} SELECT run_id, entity, rank FROM ranked""", "answers", "dictionary"))
def _(v):
    hits = X.match_entities(v.answers, v.dictionary).select("run_id", "project_id", "entity", "is_brand", "char_offset")
    ordered = hits.join(v.dictionary.select("project_id", "entity", "ordinal").distinct(), ["project_id", "entity"])
    return X.rank_mentions(ordered).select("run_id", "entity", "rank")


_URL = r"(?i)\bhttps?://[a-z0-9][a-z0-9.\-]*[a-z0-9](?::\d+)?(?:/[^\s)\]]*)?"
_BARE = r"(?i)\b(?:[a-z0-9](?:[a-z0-9\-]{0,61}[a-z0-9])?\.)+[a-z]{2,24}\b"
_TYPE = """CASE WHEN contains(domain, 'reddit.com') THEN 'reddit' WHEN domain LIKE '%wikipedia.org' THEN 'wikipedia' WHEN domain IN ('youtube.com', 'youtu.be') OR domain LIKE '%.youtube.com' THEN 'youtube'
  WHEN domain LIKE 'docs.%' OR path LIKE '/docs%' OR domain LIKE '%.readthedocs.io' THEN 'docs' ELSE 'general_web' END"""


def _cites(src: str) -> str:
    return f"""u AS (SELECT run_id, regexp_replace(unnest(regexp_extract_all(text, '{_URL}')), '[.,;:)]+$', '') AS url FROM {src}),
  a AS (SELECT run_id, lower(regexp_extract(url, '(?i)^https?://([^/:?#]+)', 1)) AS domain, url, regexp_extract(url, '(?i)^https?://[^/?#]+(/[^?#]*)', 1) AS path FROM u),
  b AS (SELECT run_id, lower(unnest(regexp_extract_all(regexp_replace(text, '{_URL}', ' ', 'g'), '{_BARE}'))) AS domain, NULL AS url, '/' AS path FROM {src}),
  cit AS (SELECT run_id, domain, url, count(*) AS frequency, min({_TYPE}) AS source_type FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2, 3)"""


@query("extracted_citations", "X-4 X-6 T-15", sql(f"WITH {_cites('answers')} SELECT * FROM cit", "answers"))
def _(v):
    return X.extract_citations(v.answers)


@query("document_citations", "X-4", f"WITH docs AS (SELECT doc_id AS run_id, text FROM documents), {_cites('docs')} SELECT * FROM cit")
def _(v):
    return X.extract_citations(v.table("documents").select(F.col("doc_id").alias("run_id"), "text"))


@query("annotation_citations", "X-5", sql("""SELECT run_id, 'a' || (run_id % 13) || '.example.org' AS domain, 'https://a' || (run_id % 13) || '.example.org/docs/x' AS url, 1 AS frequency, 'docs' AS source_type FROM answers WHERE run_id % 6 = 0
  UNION ALL SELECT run_id, 'www.reddit.com', 'https://www.reddit.com/r/x', 1, 'reddit' FROM answers WHERE run_id % 6 = 0""", "answers"))
def _(v):
    return X.citations_from_annotations(v.responses)


_CLAIMS = """spans AS (SELECT a.project_id, a.run_id, generate_subscripts(regexp_extract_all(text, '[^.!?\\n]*[.!?\\n]|[^.!?\\n]+'), 1) AS i, unnest(regexp_extract_all(text, '[^.!?\\n]*[.!?\\n]|[^.!?\\n]+')) AS s FROM answers a),
  placed AS (SELECT *, coalesce(sum(strlen(s)) OVER (PARTITION BY run_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o, regexp_replace(s, '^\\s+|\\s+$', '', 'g') AS c FROM spans),
  claims AS (SELECT project_id, run_id, 'that' AS entity, c AS claim_text, 'factual_statement' AS claim_kind, o + strlen(s) - strlen(regexp_replace(s, '^\\s+', '')) AS char_offset, 80 AS confidence,
    'deterministic_sentence' AS extractor_lane FROM placed WHERE c <> '' AND (contains(lower(c), 'that') OR contains(lower(c), 'the')))"""


@query("extracted_claims", "X-7", sql(f"WITH {_CLAIMS} SELECT * FROM claims", "answers"))
def _(v):
    return X.extract_claims(v.answers, v.dictionary)


@query("answer_text", "X-8", sql("""SELECT project_id, run_id, CASE WHEN run_id % 6 = 1 THEN text || chr(10) || 'skip' ELSE text END AS text
  FROM answers WHERE run_id % 6 < 5 AND run_id % 9 < 8""", "answers"))
def _(v):
    return X.answers_of(v.responses)


@query("resolved_domains", "X-9", sql(f"""WITH {_cites('answers')}, dom AS (SELECT run_id, domain FROM cit WHERE run_id % 4 > 0 UNION SELECT run_id, unnest(['a.com', 'b.org']) FROM answers WHERE run_id % 4 = 0)
  SELECT a.run_id, coalesce(string_agg(d.domain, '|' ORDER BY d.domain), '') AS domains FROM answers a LEFT JOIN dom d USING (run_id) GROUP BY 1""", "answers"))
def _(v):
    given = F.when(F.col("run_id") % 4 == 0, F.array(F.lit(" B.org"), F.lit("a.com"), F.lit(""), F.lit("A.com ")))
    return X.resolve_domains(v.answers.withColumn("citation_domains", given))


@query("extraction_counts", "X-10 X-U2", sql(f"""WITH src AS (SELECT * FROM answers WHERE run_id % 6 < 5 AND run_id % 9 < 8), {_HITS.replace('FROM answers a', 'FROM src a')}, {_cites('src')}, {_CLAIMS.replace('FROM answers a', 'FROM src a')},
  note AS (SELECT run_id, 2 AS n FROM src WHERE run_id % 6 = 0)
  SELECT (SELECT count(*) FROM ranked) AS mentions, (SELECT sum(frequency) FROM cit)::BIGINT + (SELECT coalesce(sum(n), 0) FROM note)::BIGINT AS citation_frequency, (SELECT count(*) FROM claims) AS claims""", "answers", "dictionary"))
def _(v):
    out = X.extract_all(v.responses, v.dictionary)
    m = out["mentions"].agg(F.count("*").alias("mentions"))
    c = out["citations"].agg(F.sum("frequency").alias("citation_frequency"))
    k = out["claims"].agg(F.count("*").alias("claims"))
    return m.select("mentions", c.scalar().alias("citation_frequency"), k.scalar().alias("claims"))


# --- audit -------------------------------------------------------------------------------------


def _tag(tag: str) -> str:
    return f"[{_clean('x')} FOR x IN regexp_extract_all(html, '(?is)<{tag}[^>]*>(.*?)</{tag}>', 1)]"


def _clean(x: str) -> str:
    return f"trim(regexp_replace(replace(replace(replace(regexp_replace({x}, '<[^>]*(>|$)', '  ', 'gs'), '>', ' '), '&amp;', '&'), '&nbsp;', ' '), '\\s+', ' ', 'g'))"


def _any(x: str, needles) -> str:
    return "(" + " OR ".join(f"contains({x}, '{n.replace(chr(39), chr(39) * 2)}')" for n in needles) + ")"


_FACTS = f"""f AS (SELECT page_id, url, lower(html) AS low, lower({_clean('html')}) AS txt, {_tag('title')}[1] AS title,
    [h FOR h IN list_concat(list_concat({_tag('h1')}, {_tag('h2')}), {_tag('h3')}) IF h <> ''] AS heads, contains(html, 'https://example.com/ref') AS linked FROM audit_pages_in),
  g AS (SELECT *, len(regexp_extract_all(low, '<p')) AS paras,
    [h FOR h IN heads IF (h LIKE '%?' OR regexp_matches(lower(h), '^({"|".join(p.strip() for p in C.QUESTION_PREFIXES)}) '))][1] AS asked FROM f),
  p AS (SELECT *, [
    {_any('low', C.SCHEMA_MARKERS)}, {_any('low', C.CANONICAL_MARKERS)}, contains(low, 'og:site_name') OR coalesce(contains(title, ' | ') OR contains(title, ' - '), false),
    contains(low, 'name="robots"') AND {_any('low', C.AI_ROBOTS_MARKERS)}, {_any('low', C.ANSWER_MARKERS)} OR contains(txt, 'the answer'), asked IS NOT NULL,
    len(heads) >= 2 AND paras >= 2, linked, {_any('txt', C.NAMED_SOURCE_PHRASES)}, linked AND {_any('low', C.SOURCE_CONTEXT_WORDS)}] AS ok FROM g),
  s AS (SELECT *, (len([x FOR x IN ok IF x]) * 100 + 5) // 10 AS page_score FROM p),
  rules AS (SELECT * FROM (VALUES (1, 'identity.schema_org_json_ld', 'high'), (2, 'identity.canonical_url', 'medium'), (3, 'identity.site_name', 'medium'), (4, 'identity.llms_txt', 'low'),
    (5, 'extractability.answer_blocks', 'high'), (6, 'extractability.question_headings', 'medium'), (7, 'extractability.semantic_sections', 'low'), (8, 'corroboration.outbound_links', 'high'),
    (9, 'corroboration.named_sources', 'medium'), (10, 'corroboration.source_context', 'medium')) r(i, rule_id, severity)),
  found AS (SELECT s.page_id, s.url, s.title, s.page_score, r.rule_id, split_part(r.rule_id, '.', 1) AS category, r.severity,
    CASE WHEN ok[r.i] THEN 'pass' WHEN r.severity = 'high' THEN 'fail' ELSE 'warn' END AS status, CASE WHEN ok[r.i] THEN 100 ELSE 0 END AS score, s.asked, s.heads, s.paras, r.i FROM s, rules r)"""


@query("page_audit", "X-11 F-20 F-22 T-12 T-18", sql(f"""WITH {_FACTS} SELECT page_id, url, title, page_score, rule_id, category, severity, status, score,
  CASE WHEN i IN (8, 9, 10) THEN 'citation_quality_uplift' ELSE 'structural_content_suggestion' END AS recommendation_kind,
  CASE WHEN status <> 'pass' THEN '' WHEN i = 1 THEN 'found JSON-LD/schema.org marker' WHEN i = 2 THEN 'found rel=canonical' WHEN i = 3 THEN 'found og:site_name or title site separator'
  WHEN i = 4 THEN 'found AI-crawler meta robots directive' WHEN i = 5 THEN 'found answer-like block or list structure' WHEN i = 6 THEN asked WHEN i = 7 THEN len(heads) || ' headings, ' || paras || ' paragraphs'
  WHEN i = 8 THEN 'https://example.com/ref' WHEN i = 9 THEN 'found named-source phrase' ELSE 'found source-context label near page links' END AS evidence FROM found""", "audit_pages_in"))
def _(v):
    return A.audit_pages(v.audit_pages_in)


@query("audit_site_score", "X-12", sql(f"WITH {_FACTS}, o AS (SELECT DISTINCT page_id, page_score FROM s) SELECT count(*) AS pages, (sum(page_score)::BIGINT + count(*) // 2) // count(*) AS site_score FROM o", "audit_pages_in"))
def _(v):
    return A.audit_summary(A.audit_pages(v.audit_pages_in))[0]


@query("audit_rule_failures", "X-12", sql(f"WITH {_FACTS} SELECT rule_id, count(*) FILTER (WHERE status <> 'pass') AS violations FROM found GROUP BY 1", "audit_pages_in"))
def _(v):
    return A.audit_summary(A.audit_pages(v.audit_pages_in))[1]


@query("audit_gate", "X-12", sql(f"WITH {_FACTS} SELECT page_id, rule_id, severity FROM found WHERE status <> 'pass' AND (severity = 'high' OR rule_id = 'identity.llms_txt')", "audit_pages_in"))
def _(v):
    return A.audit_gate(A.audit_pages(v.audit_pages_in), ["high", "identity.llms_txt"]).select("page_id", "rule_id", "severity")


_ENC = "list_reduce([CASE WHEN ord(ch) > 126 OR ord(ch) < 33 OR ch IN ('\"', '<', '>', '`', '{{', '}}') THEN regexp_replace(hex(encode(ch)), '(..)', '%\\1', 'g') ELSE ch END FOR ch IN string_split({x}, '')], lambda a, b: a || b)"
_HREF = """regexp_replace(unnest(regexp_extract_all(html, '(?is)href=\\s*("[^"]*"|''[^'']*''|[^\\s>"''][^\\s>]*)', 1)), '^["'']|["'']$', '', 'g')"""


@query("page_links", "X-13 X-15", sql(f"""WITH h AS (SELECT DISTINCT url, trim({_HREF}) AS href FROM audit_pages_in),
  l AS (SELECT url, CASE WHEN href LIKE 'http%' THEN href WHEN href LIKE '/%' THEN lower(regexp_extract(url, '^(https?://[^/?#]*)', 1)) || {_ENC.format(x="regexp_replace(href, '#.*$', '')")} END AS link FROM h WHERE href <> '')
  SELECT DISTINCT url, link, CASE WHEN link = 'https://example.com/ref' THEN 'outbound' ELSE 'owned' END AS kind FROM l WHERE link IS NOT NULL""", "audit_pages_in"))
def _(v):
    return A.page_links(v.audit_pages_in)


@query("sitemap_locs", "X-14", "SELECT DISTINCT url AS loc FROM pages")
def _(v):
    xml = v.pages.select(F.concat(F.lit("<urlset><url><LOC> "), "url", F.lit("</loc></url><url><loc>"), "url", F.lit("</loc></url></urlset>")).alias("xml"))
    return A.sitemap_locs(xml)


@query("one_page_per_url", "U-3", """WITH p AS (SELECT page_id, url, html FROM pages UNION ALL SELECT page_id + 1000000, url, html || 'x' FROM pages UNION ALL SELECT page_id + 2000000, url, html FROM pages)
  SELECT url, page_id, sha256(html) AS page FROM p QUALIFY row_number() OVER (PARTITION BY url ORDER BY sha256(html), page_id) = 1""")
def _(v):
    """Every url three times: two equal pages, which tie, and one that differs."""
    again = v.pages.select((F.col("page_id") + 1000000).alias("page_id"), "url", F.concat("html", F.lit("x")).alias("html"))
    same = v.pages.select((F.col("page_id") + 2000000).alias("page_id"), "url", "html")
    return A.one_per_url(v.pages.unionByName(again).unionByName(same)).select("url", "page_id", F.sha2("html", 256).alias("page"))


@query("crawlable_urls", "X-15", """SELECT page_id, NOT regexp_matches(lower(regexp_extract(u, '^https?://[^/?#]*([^?#]*)', 1)), '^/(_next|static)/|\\.(js|css|png|pdf)$') AS crawlable FROM
  (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://x.org/static/' || page_id WHEN 1 THEN 'https://x.org/a.PNG?v=1' WHEN 2 THEN 'https://x.org/_next/a' WHEN 3 THEN 'https://x.org/paper.pdf#p2' ELSE url END AS u FROM pages)""")
def _(v):
    i = F.col("page_id") % 5
    u = (
        F.when(i == 0, F.concat(F.lit("https://x.org/static/"), F.col("page_id").cast("string"))).when(i == 1, "https://x.org/a.PNG?v=1")
        .when(i == 2, "https://x.org/_next/a").when(i == 3, "https://x.org/paper.pdf#p2").otherwise(F.col("url"))
    )
    return v.pages.select("page_id", S.is_crawlable(u).alias("crawlable"))


# --- similarity --------------------------------------------------------------------------------

_TOK = "[w FOR w IN regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+') IF w <> '']"
_SH = f"""tk AS (SELECT doc_id, {_TOK} AS w FROM documents),
  sh AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN generate_series(1, len(w) - 2)]) END AS g FROM tk)"""


@query("shingles", "D-1 F-14", f"WITH {_SH} SELECT doc_id, len(g) AS shingles, coalesce('sha256:' || sha256(array_to_string(list_sort(g), ',')), '') AS tag FROM sh")
def _(v):
    sh = M.shingles(v.table("documents"))
    return sh.select("doc_id", F.size("shingles").alias("shingles"), S.sha256_tag(F.array_join(F.sort_array("shingles"), ",")).alias("tag"))


_GRAMS = f"""{_SH}, gr AS (SELECT DISTINCT doc_id, ('0x' || left(md5(unnest(g)), {M.GRAM_DIGITS}))::BIGINT AS h FROM sh)"""
_SIG = f"""{_GRAMS}, fs AS (SELECT doc_id, h >> {M.GRAM_BITS - M.SLOT_BITS} AS j, min(h) AS h FROM gr GROUP BY 1, 2),
  sg AS (SELECT doc_id, i, arg_min(h, ((j - i) * {M.STEPS_BACK}[i + 1] % {M.SLOTS} + {M.SLOTS}) % {M.SLOTS}) AS v FROM fs, range({M.SLOTS}) t(i) GROUP BY 1, 2)"""


@query("minhash_signatures", "D-2 T-8", f"""WITH {_SIG} SELECT doc_id, count(i) AS slots, coalesce(sha256(string_agg(v::VARCHAR, ',' ORDER BY i)), '') AS digest
  FROM (SELECT doc_id FROM documents) LEFT JOIN sg USING (doc_id) GROUP BY 1""")
def _(v):
    signed = M.minhash(v.table("documents"))
    text = F.array_join(F.col("signature").cast("array<string>"), ",")
    return signed.select("doc_id", F.coalesce(F.size("signature"), F.lit(0)).alias("slots"), F.coalesce(F.sha2(text, 256), F.lit("")).alias("digest"))


def _first_doc(v):
    return v.table("documents").agg(F.min_by("text", "doc_id").alias("text"))


_ESTIMATED = f"""WITH {_SIG}, q AS (SELECT i, v FROM sg WHERE doc_id = (SELECT min(doc_id) FROM documents)),
  e AS (SELECT sg.doc_id, count(*) / {M.SLOTS} AS score FROM sg JOIN q USING (i, v) GROUP BY 1)
  SELECT doc_id, {r('score')} AS score FROM e WHERE e.score >= 0.05 ORDER BY e.score DESC, doc_id LIMIT 50"""


@query("similar_documents", "D-3", _ESTIMATED)
def _(v):
    return M.similar_to(v.table("documents"), _first_doc(v), 0.05, 50, name="doc_id").select("doc_id", "score")


@query("similar_documents_indexed", "D-3", _ESTIMATED)
def _(v):
    """The same search in a stored index of all documents."""
    path = f"{checkpoint_root(v.spark)}/similarity-{uuid.uuid4().hex}"
    M.write_index(v.table("documents"), path, name="doc_id")
    return M.similar_in_index(v.spark, path, _first_doc(v), 0.05, 50).select(F.col("name").alias("doc_id"), "score")


_NEAR = f"""WITH {_GRAMS}, kd AS (SELECT sh.doc_id, sha256(string_agg(h::VARCHAR, ',' ORDER BY h)) AS k FROM sh JOIN gr USING (doc_id) GROUP BY 1),
  cl AS (SELECT k, min(doc_id) AS class_id, count(*) AS copies FROM kd GROUP BY 1),
  sets AS (SELECT doc_id AS class_id, h, count(*) OVER (PARTITION BY doc_id) AS n FROM gr WHERE doc_id IN (SELECT class_id FROM cl)),
  links AS (SELECT a.class_id AS class_a, b.class_id AS class_b, count(*)::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*)) AS jaccard
    FROM sets a JOIN sets b ON a.h = b.h AND a.class_id < b.class_id GROUP BY 1, 2 HAVING jaccard >= 0.6)"""


@query("near_duplicate_classes", "D-5", f"""{_NEAR}, ends AS (SELECT class_a AS class_id FROM links UNION ALL SELECT class_b FROM links), deg AS (SELECT class_id, count(*) AS n_links FROM ends GROUP BY 1)
  SELECT d.doc_id, coalesce(cl.class_id, d.doc_id) AS class_id, coalesce(cl.copies, 1) AS copies, coalesce(deg.n_links, 0) AS n_links
  FROM documents d LEFT JOIN kd USING (doc_id) LEFT JOIN cl USING (k) LEFT JOIN deg ON deg.class_id = cl.class_id""")
def _(v):
    """Classes of equal shingle sets and their links at 0.6, over all documents."""
    return M.near_duplicate_classes(*M.near_duplicates(v.table("documents"), "doc_id")).withColumnRenamed("id", "doc_id")


@query("near_duplicate_search", "D-5", f"""{_NEAR}, asked AS (SELECT DISTINCT cl.class_id FROM kd JOIN cl USING (k) WHERE doc_id % 50 = 0)
  SELECT class_a, class_b, {r('jaccard')} AS jaccard FROM links WHERE class_a IN (SELECT class_id FROM asked) OR class_b IN (SELECT class_id FROM asked)""")
def _(v):
    """Documents with an id divisible by 50 against all documents."""
    return M.near_duplicates(v.table("documents"), "doc_id", queries=F.col("doc_id") % 50 == 0)[1]


_JAC = """CASE WHEN len(s.g) + len(q.g) > 0 THEN len(list_intersect(s.g, q.g))::DOUBLE / (len(s.g) + len(q.g) - len(list_intersect(s.g, q.g))) ELSE 0 END"""


@query("similar_documents_exact", "D-3 D-4", f"""WITH {_SH}, q AS (SELECT g FROM sh ORDER BY doc_id LIMIT 1), j AS (SELECT s.doc_id, {_JAC} AS score FROM sh s, q)
  SELECT doc_id, {r('score')} AS score FROM j WHERE j.score >= 0.01 ORDER BY j.score DESC, doc_id LIMIT 50""")
def _(v):
    return M.similar_to(v.table("documents"), _first_doc(v), 0.01, 50, name="doc_id", exact=True).select("doc_id", "score")


@query("benchmark_jaccard", "D-4", f"""WITH {_SH.replace('documents', '(SELECT item_id AS doc_id, text FROM benchmark)')}, x AS (SELECT doc_id, {_TOK} AS w FROM (SELECT item_id AS doc_id, text || ' one more tail of words' AS text FROM benchmark)),
  q AS (SELECT doc_id, list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN generate_series(1, len(w) - 2)]) AS g FROM x)
  SELECT s.doc_id AS item_id, {r(_JAC)} AS jaccard FROM sh s JOIN q ON q.doc_id = s.doc_id""")
def _(v):
    b = v.table("benchmark")
    longer = M.shingles(b.withColumn("text", F.concat("text", F.lit(" one more tail of words")))).select("item_id", F.col("shingles").alias("other"))
    return M.shingles(b).join(longer, "item_id").select("item_id", M.jaccard(F.col("shingles"), F.col("other")).alias("jaccard"))


# --- names and domains -------------------------------------------------------------------------

_FOLD = "translate(lower({x}), 'аеос', 'aeoc')"


@query("sql_domain_functions", "X-U3", """WITH d AS (SELECT page_id, regexp_replace(lower(split_part(regexp_replace(url, '^https?://', ''), '/', 1)), '^www\\.', '') AS domain, regexp_replace(url, '^https?://[^/]*', '') AS path FROM pages)
  SELECT page_id, domain, CASE WHEN page_id % 4 = 0 THEN 'reddit' WHEN page_id % 4 = 1 THEN 'wikipedia' WHEN page_id % 4 = 2 OR path LIKE '/docs%' THEN 'docs' ELSE 'general_web' END AS source_type FROM d""")
def _(v):
    S.register_sql_functions(v.spark)
    host = "concat(element_at(array('www.reddit.com', 'xx.wikipedia.org', 'docs.', ''), cast(page_id % 4 as int) + 1), IF(page_id % 4 >= 2, plain_domain(url), ''))"
    return v.pages.select(
        "page_id", F.expr("plain_domain(url)").alias("domain"), F.expr(f"citation_source_type({host}, regexp_replace(url, '^https?://[^/]*', ''))").alias("source_type")
    )


@query("normalized_domains", "D-6 D-7", """SELECT page_id, regexp_replace(lower(split_part(regexp_replace(url, '^https?://', ''), '/', 1)), '^www\\.', '') AS domain, replace(regexp_replace(lower(split_part(regexp_replace(url, '^https?://', ''), '/', 1)), '^www\\.', ''), '.example', '.apple') AS folded FROM pages""")
def _(v):
    cyr = F.concat(F.lit("https://www."), F.replace(S.normalize_domain(F.col("url")), F.lit(".example"), F.lit(".АррӀе".replace("Ӏ", "l"))), F.lit("./x"))
    return v.pages.select("page_id", S.normalize_domain(F.col("url")).alias("domain"), S.normalize_domain(cyr).alias("folded"))


_STRIP = "trim(regexp_replace(regexp_replace({x}, '[^a-z0-9а-я\\s]', '', 'g'), '\\s+', ' ', 'g'))"
_PAIR = f"""SELECT s_suppkey, {_FOLD.format(x='a')} AS na, {_FOLD.format(x='b')} AS nb FROM (SELECT s_suppkey, s_name AS a, CASE s_suppkey % 5 WHEN 0 THEN upper(s_name) WHEN 1 THEN s_name || '!!' WHEN 2 THEN s_name || ' Inc'
  WHEN 3 THEN replace(s_name, 'e', 'е') || '7' ELSE 'Nobody' END AS b FROM supplier)"""


@query("name_similarity", "D-8", f"""WITH p AS ({_PAIR}), z AS (SELECT *, {_STRIP.format(x='na')} AS pa, {_STRIP.format(x='nb')} AS pb FROM p)
  SELECT s_suppkey, CASE WHEN na = nb THEN 100 WHEN levenshtein(na, nb) <= 1 THEN 90 WHEN pa = pb THEN 85 WHEN starts_with(pa, pb) OR starts_with(pb, pa) THEN 70 ELSE 0 END AS score FROM z""")
def _(v):
    s, name = F.col("s_suppkey") % 5, F.col("s_name")
    other = (
        F.when(s == 0, F.upper(name)).when(s == 1, F.concat(name, F.lit("!!"))).when(s == 2, F.concat(name, F.lit(" Inc")))
        .when(s == 3, F.concat(F.replace(name, F.lit("e"), F.lit("е")), F.lit("7"))).otherwise(F.lit("Nobody"))
    )
    return v.table("supplier").select("s_suppkey", S.name_similarity(name, other).alias("score"))


_DEDUP = f"""n AS (SELECT domain, {_FOLD.format(x='display_name')} AS n FROM dup_entities),
  nm AS (SELECT n, min(domain) AS rep, {_STRIP.format(x='n')} AS s FROM n GROUP BY n),
  hd AS (SELECT s, min(n) AS hn, arg_min(rep, n) AS hrep FROM nm GROUP BY s),
  lk AS (SELECT rep AS a, domain AS b, 100 AS score FROM n JOIN nm USING (n) WHERE domain <> rep
    UNION ALL SELECT least(x.rep, y.rep), greatest(x.rep, y.rep), 90 FROM nm x JOIN nm y ON x.n < y.n WHERE abs(length(x.n) - length(y.n)) <= 1 AND levenshtein(x.n, y.n) <= 1
    UNION ALL SELECT least(hrep, rep), greatest(hrep, rep), CASE WHEN levenshtein(hn, n) <= 1 THEN 90 ELSE 85 END FROM nm JOIN hd USING (s) WHERE n <> hn
    UNION ALL SELECT least(x.hrep, y.hrep), greatest(x.hrep, y.hrep), 70 FROM hd x JOIN hd y ON x.s <> y.s AND starts_with(y.s, x.s) WHERE levenshtein(x.hn, y.hn) > 1),
  links AS (SELECT a AS domain_a, b AS domain_b, max(score) AS score FROM lk GROUP BY 1, 2)"""


@query("entities_to_merge", "D-9", sql(f"WITH {_DEDUP} SELECT * FROM links WHERE score >= 90", "dup_entities"))
def _(v):
    return M.dedup_entities(v.dup_entities)[0]


@query("entities_to_review", "D-9", sql(f"WITH {_DEDUP} SELECT * FROM links WHERE score < 90", "dup_entities"))
def _(v):
    return M.dedup_entities(v.dup_entities)[1]
