"""Answer text -> mentions, citations, claims.

Citations and claims work inside one row with array expressions and need no shuffle. Mentions search a text once for all names of
its project, by one pattern that shares the names' beginnings; only what was found, without the text, meets the dictionary and is grouped
by answer. The dictionary joins by project id.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import scalars as S
from ..session import materialize
from .citations import merge_citations

#: Sentences whose lengths are added up together, see _starts.
BLOCK = 64


def _alternatives(names: Sequence[str], at: int) -> str:
    """A pattern for the rests, from place `at`, of sorted names that agree before it; it prefers the longest."""
    out, i = [], 0
    while i < len(names):
        same = [n for n in names[i:] if n[at] == names[i][at]]
        end = len(os.path.commonprefix([same[0], same[-1]]))
        piece = "".join(c if c.isalnum() or ord(c) > 127 else "\\" + c for c in same[0][at:end])
        rest = [n for n in same if len(n) > end]
        if rest:
            piece += _alternatives(rest, end) + ("?" if len(rest) < len(same) else "")
        out.append(piece)
        i += len(same)
    return "(?:" + "|".join(out) + ")"


def names_pattern(names: Sequence[str] | None) -> str | None:
    """A pattern that finds, at every place of a text, the longest of the names that begins there (its group 1).

    Names that begin alike share a branch, so trying a place costs a walk down the shared beginnings, however many names there are.
    """
    return f"(?=({_alternatives(sorted(set(names)), 0)}))" if names else None


def _names(dictionary: DataFrame) -> DataFrame:
    """One row per project, entity and lower-cased name: the spelling that wins ties, the entity's flags and least ordinal.

    Input rows are (project_id, entity, variant, is_brand, ordinal); the entity's own name counts too.
    """
    named = dictionary.select("project_id", "entity", "is_brand", "ordinal", F.explode(F.array("entity", "variant")).alias("v"))
    named = named.filter(F.col("v").isNotNull() & (F.col("v") != ""))
    first = named.groupBy("project_id", "entity", "is_brand").agg(F.min("ordinal").alias("ordinal"))
    spelled = named.groupBy("project_id", "entity", "is_brand", F.lower("v").alias("low")).agg(
        F.min(F.struct((-F.octet_length("v")).alias("neg"), F.col("v").alias("name"))).alias("spelling")
    )
    return spelled.join(first, ["project_id", "entity", "is_brand"])


def _byte_slice(data: Column, size: Column) -> Column:
    """The first `size` bytes as a string, NULL when there are fewer or they are no whole characters."""
    cut = F.substring(data, F.lit(1), size).cast("string")
    return F.when((F.octet_length(cut) == size) & F.is_valid_utf8(cut), cut)


def match_entities(answers: DataFrame, dictionary: DataFrame, tone: bool = False) -> DataFrame:
    """First match of each entity per answer: (project_id, run_id, entity, is_brand, char_offset, matched_text, rank), with `tone` its sentiment.

    Earliest case-insensitive hit of any name, ties to the name with more bytes. `char_offset` is in
    bytes of the lower-cased text. Rank orders by offset, brand first, then configured order. A run_id is one answer of its project.

    The pattern gives the names that are the longest at some place of the text. A shorter name that begins a longer one is met with it: the
    longer name's row in the dictionary lists the names it begins with. The names of one project fit in a row.
    """
    names = _names(dictionary)
    every = F.udf(names_pattern, "string", useArrow=False)(F.collect_set("low")).alias("__pattern")
    patterns = names.groupBy("project_id").agg(every, F.max(-F.col("spelling.neg")).alias("__longest"))
    # In the order of projects a pattern is compiled once for all answers of its project in a task.
    ordered = answers.select("project_id", "run_id", "text").sortWithinPartitions("project_id")
    base = ordered.join(patterns, "project_id").withColumn("__low", F.lower("text"))
    low = F.col("__low")
    each = base.select(
        "project_id", "run_id", "text", "__low", "__longest", F.explode(F.array_distinct(F.regexp_extract_all(low, F.col("__pattern"), F.lit(1)))).alias("longest")
    )
    placed = each.withColumn("pos", F.position(F.col("longest"), low)).withColumn("char_offset", F.octet_length(F.left(low, F.col("pos") - 1)))
    hits = placed.select(
        "project_id", "run_id", "longest", "pos", "char_offset", F.substring(F.col("text").cast("binary"), F.col("char_offset") + 1, F.col("__longest")).alias("bytes"),
        *([sentiment(F.col("text"), F.col("char_offset")).alias("tone")] if tone else []),
    )

    heads = names.select("project_id", F.col("low").alias("longest")).distinct()
    begins = heads.select("project_id", "longest", F.explode(F.transform(F.sequence(F.lit(1), F.length("longest")), lambda k: F.left("longest", k))).alias("low"))
    entries = begins.join(names, ["project_id", "low"]).drop("low")
    found = hits.join(entries, ["project_id", "longest"]).repartition("project_id", "run_id")
    carried = ["pos", "spelling", "char_offset", "bytes", *(["tone"] if tone else [])]
    first = found.groupBy("project_id", "run_id", "entity", "is_brand", "ordinal").agg(F.min_by(F.struct(*carried), F.struct("pos", "spelling")).alias("m"))
    order = Window.partitionBy("project_id", "run_id").orderBy("m.pos", F.col("is_brand").desc(), "ordinal", "entity")
    name = F.col("m.spelling.name")
    return first.select(
        "project_id", "run_id", "entity", "is_brand", "m.char_offset", F.row_number().over(order).alias("rank"),
        F.coalesce(_byte_slice(F.col("m.bytes"), F.octet_length(name)), name).alias("matched_text"), *(["m.tone"] if tone else []),
    )


def rank_mentions(hits: DataFrame) -> DataFrame:
    """Ordinal of unranked (run_id, char_offset, is_brand, ordinal, entity) hits; at most one hit per entity and run."""
    from pyspark.sql import Window

    w = Window.partitionBy("run_id").orderBy("char_offset", F.col("is_brand").desc(), "ordinal", "entity")
    return hits.withColumn("rank", F.row_number().over(w))


def brand_rank(answers: DataFrame, mentions: DataFrame) -> DataFrame:
    """Rank of the brand per answer, NULL when it is absent."""
    brand = mentions.filter("is_brand").groupBy("run_id").agg(F.min("rank").alias("brand_rank"))
    return answers.select("run_id").join(brand, "run_id", "left")


def sentiment(text: Column, char_offset: Column) -> Column:
    """struct(label, score, lane) from the lexicon words within 160 characters of a byte offset."""
    at = F.char_length(F.substring(text.cast("binary"), F.lit(1), char_offset).cast("string"))
    start = F.greatest(at - C.SENTIMENT_RADIUS, F.lit(0))
    context = F.lower(F.substring(text, start + 1, at + C.SENTIMENT_RADIUS - start))
    words = F.split(context, r"[^\p{IsAlphabetic}\p{N}]+")
    count = lambda terms: F.size(F.filter(words, lambda w: w.isin(terms)))
    diff = count(C.POSITIVE_TERMS) - count(C.NEGATIVE_TERMS)
    label = F.when(diff > 0, "positive").when(diff < 0, "negative").otherwise("neutral")
    score = (
        F.when(diff > 0, 60 + F.least(diff, F.lit(4)) * 10).when(diff < 0, 40 - F.least(-diff, F.lit(4)) * 10).otherwise(50)
    )
    return F.struct(label.alias("label"), score.cast("int").alias("score"), F.lit(C.SENTIMENT_LANE).alias("lane"))


def extract_mentions(answers: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Ranked mentions with the three sentiment columns."""
    tone = match_entities(answers, dictionary, tone=True)
    return tone.withColumns(
        {"sentiment_label": F.col("tone.label"), "sentiment_score": F.col("tone.score"), "sentiment_lane": F.col("tone.lane")}
    ).drop("tone")


def _url_parts(url: Column) -> tuple[Column, Column]:
    """Host (NULL when the url cannot be valid) and path of an absolute http url."""
    host = F.lower(F.regexp_extract(url, r"(?i)\Ahttps?://([^/:?#]+)", 1))
    port = F.regexp_extract(url, r"(?i)\Ahttps?://[^/:?#]+:(\d+)", 1).try_cast("long")
    numeric = host.rlike(r"(\A|\.)\d+\z") & ~host.rlike(rf"\A{S._V4}\z")
    ok = (host != "") & (F.coalesce(port, F.lit(0)) <= 65535) & ~numeric
    path = F.regexp_extract(url, r"(?i)\Ahttps?://[^/?#]+(/[^?#]*)", 1)
    return F.when(ok, host), path


def _trim_url(c: Column) -> Column:
    return F.regexp_replace(c, r"[.,;:)]+\z", "")


def _counted(items: Column) -> Column:
    """Different items with their numbers, in order: [(item, n)]. Sorted once, so linear in the items but for the sort."""

    def runs(ordered: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: (i == 0) | ~F.get(ordered, i).eqNullSafe(F.get(ordered, i - 1)))
        return S.let(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(ordered, i).alias("item"), (F.coalesce(F.get(at, k + 1), F.size(ordered)) - i).alias("n"))))

    return F.when(F.size(items) > 0, S.let(F.array_sort(items), runs))


def _surfaces(text: Column, emails: bool) -> Column:
    """Urls and the bare domains outside them, in the order of their kinds: [(url, domain)] with one of the two NULL."""
    none = F.lit(None).cast("string")
    urls = F.transform(F.regexp_extract_all(text, F.lit(C.URL), F.lit(0)), lambda u: F.struct(_trim_url(u).alias("url"), none.alias("domain")))
    rest = F.regexp_replace(text, C.URL, " ")
    if not emails:
        rest = F.regexp_replace(rest, r"[^\s@]+@[^\s@]+", " ")
    bare = F.transform(F.regexp_extract_all(rest, F.lit(C.BARE_DOMAIN), F.lit(0)), lambda d: F.struct(none.alias("url"), F.lower(d).alias("domain")))
    return F.concat(urls, bare)


def extract_citations(answers: DataFrame, emails: bool = True, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Absolute urls keyed (host, url), then bare domains outside them keyed (host, NULL), with how often the text has them.

    One pass over each text, counted in its row. `emails=False` drops the two halves of e-mail addresses, which otherwise count as domains.
    """
    # Both patterns need a dot or "://"; other texts skip the regular expressions.
    dotted = answers.filter(F.col("text").contains("."))
    each = dotted.select(*keys, F.explode(_counted(_surfaces(F.col("text"), emails))).alias("s"))
    return _located(each, keys, F.col("s.item.url"), F.col("s.item.domain"), F.col("s.n"))


def _located(each: DataFrame, keys: Sequence[str], url: Column, domain: Column, n: Column) -> DataFrame:
    """Host and kind of counted urls and domains; urls without a valid host go."""
    host, path = _url_parts(F.col("url"))
    named = each.select(*keys, url.alias("url"), domain.alias("__bare"), n.cast("int").alias("frequency"))
    parts = S.compute_once(named, *keys, F.coalesce("__bare", host).alias("domain"), "url", "frequency", F.when(F.col("__bare").isNull(), path).otherwise("/").alias("__path"))
    return parts.filter("domain IS NOT NULL").select(*keys, "domain", "url", "frequency", S.source_type(F.col("domain"), F.col("__path")).alias("source_type"))


def _annotation_urls(raw: Column) -> Column:
    """Urls of structured `choices[].message.annotations[].url_citation` objects; NULL where the response has none."""
    shape = "choices ARRAY<STRUCT<message: STRUCT<annotations: ARRAY<STRUCT<url_citation: STRUCT<url: STRING>>>>>>"
    notes = F.transform(F.from_json(raw, shape)["choices"], lambda c: c["message"]["annotations"])
    urls = F.transform(F.flatten(F.filter(notes, lambda n: n.isNotNull())), lambda a: _trim_url(a["url_citation"]["url"]))
    return F.when(raw.contains("url_citation"), F.filter(urls, lambda u: u.isNotNull()))


def _from_urls(rows: DataFrame, urls: Column, keys: Sequence[str]) -> DataFrame:
    each = rows.select(*keys, F.explode(_counted(urls)).alias("s"))
    return _located(each, keys, F.col("s.item"), F.lit(None).cast("string"), F.col("s.n"))


def citations_from_annotations(runs: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Citations of structured annotations, counted in the response's row."""
    return _from_urls(runs, _annotation_urls(F.col("raw_response")), keys)


def _starts(lengths: Column) -> Column:
    """Where each of the stretches begins that follow one another with these lengths.

    Lengths are added up in blocks: work and memory grow with the number of stretches times the block, not with its square.
    """
    blocks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int"))
    total = lambda values, upto: F.aggregate(F.slice(values, 1, upto), F.lit(0), lambda s, v: s + v)
    sums = F.transform(blocks, lambda b: F.aggregate(F.slice(lengths, b * BLOCK + 1, BLOCK), F.lit(0), lambda s, v: s + v))
    before = S.let(sums, lambda s: F.transform(s, lambda _, b: total(s, b)))
    inside = lambda i: F.aggregate(F.slice(lengths, i - i % BLOCK + 1, i % BLOCK), F.lit(0), lambda s, v: s + v)
    return S.let(before, lambda at: F.transform(lengths, lambda _, i: F.get(at, F.floor(i / BLOCK).cast("int")) + inside(i)))


def extract_claims(answers: DataFrame, dictionary: DataFrame) -> DataFrame:
    """One claim per sentence-like span naming the brand, with the span's byte offset."""
    brand = (
        dictionary.filter("is_brand")
        .select("project_id", "entity", F.explode(F.array("entity", "variant")).alias("v"))
        .filter(F.col("v").isNotNull() & (S.squeeze(F.col("v")) != ""))
        .groupBy("project_id", "entity").agg(F.collect_set(F.lower("v")).alias("__names"))
    )
    low = F.lower("text")
    base = answers.select("project_id", "run_id", "text").join(brand, "project_id")
    named = base.filter(F.exists("__names", lambda v: low.contains(v)))
    spans = named.select("project_id", "run_id", "entity", "__names", F.regexp_extract_all("text", F.lit(r"[^.!?\n]*[.!?\n]|[^.!?\n]+"), F.lit(0)).alias("__spans"))
    # The lengths are a column of their own, so that they are computed once.
    sized = spans.withColumn("__sizes", F.transform("__spans", lambda s: F.octet_length(s)))
    placed = sized.select("project_id", "run_id", "entity", "__names", F.inline(F.arrays_zip(F.col("__spans").alias("s"), _starts(F.col("__sizes")).alias("o"))))
    rows = placed.filter(F.exists("__names", lambda v: F.lower(S.squeeze(F.col("s"))).contains(v)))
    lead = F.octet_length("s") - F.octet_length(F.regexp_replace("s", r"(?U)\A\s+", ""))
    return S.compute_once(
        rows, "project_id", "run_id", "entity", S.squeeze(F.col("s")).alias("claim_text"), F.lit(C.CLAIM_KIND).alias("claim_kind"),
        (F.col("o") + lead).alias("char_offset"), F.lit(C.CLAIM_CONFIDENCE).alias("confidence"), F.lit(C.CLAIM_LANE).alias("extractor_lane"),
    ).filter(F.col("claim_text") != "")


def answer_text(raw: Column) -> Column:
    """Text of a provider response, from the first known shape that has any; NULL otherwise."""
    doc = F.try_parse_json(raw)
    none = F.lit(None).cast("string")

    def string_at(v: Column, path: str) -> Column:
        is_text = F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING"
        s = F.when(is_text, F.try_variant_get(v, path, "string"))
        return F.when(S.squeeze(s) != "", s)

    def blocks(path: str, only_type: str | None = None) -> Column:
        items = F.try_variant_get(doc, path, "array<variant>")
        if only_type:
            items = F.filter(items, lambda b: F.try_variant_get(b, "$.type", "string") == only_type)
        texts = F.filter(F.transform(items, lambda b: string_at(b, "$.text")), lambda t: t.isNotNull())
        return F.when(F.size(texts) > 0, F.array_join(texts, "\n")).otherwise(none)

    plain = S.squeeze(F.when(F.schema_of_variant(doc) == "STRING", F.try_variant_get(doc, "$", "string")))
    content = "$.choices[0].message.content"
    return F.coalesce(
        F.when(plain != "", plain), string_at(doc, content), blocks(content), string_at(doc, "$.text"),
        blocks("$.content", "text"), blocks("$.candidates[0].content.parts"),
    )


def answers_of(runs: DataFrame) -> DataFrame:
    """(project_id, run_id, text) of ok runs: given response text, else the text of the raw response."""
    return _parsed(runs).select("project_id", "run_id", "text").filter(F.col("text").isNotNull())


def _parsed(runs: DataFrame) -> DataFrame:
    """(project_id, run_id, text, note_urls) of ok runs; text and urls may be NULL."""
    text = answer_text(F.col("raw_response"))
    if "response_text" in runs.columns:
        text = F.coalesce(F.when(S.squeeze(F.col("response_text")) != "", F.col("response_text")), text)
    ok = runs.filter(F.col("status") == "ok")
    return S.compute_once(ok, "project_id", "run_id", text.alias("text"), _annotation_urls(F.col("raw_response")).alias("note_urls"))


def resolve_domains(df: DataFrame) -> DataFrame:
    """`domains`: the explicit `citation_domains` when given, else the domains found in `text`; lower, sorted, distinct. A row each, no shuffle."""
    host = lambda s: F.coalesce(s["domain"], _url_parts(s["url"])[0])
    found = F.transform(_surfaces(F.coalesce("text", F.lit("")), True), host)
    each = F.transform(F.when(F.col("citation_domains").isNotNull(), F.col("citation_domains")).otherwise(found), lambda d: F.lower(S.squeeze(d)))
    return df.select("run_id", F.array_sort(F.array_distinct(F.filter(each, lambda d: d != ""))).alias("domains"))


_EXTRACTORS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {}


def register_extractor(name: str, fn: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """Add a mention extractor `fn(answers, dictionary)` whose rows join the built-in ones."""
    _EXTRACTORS[name] = fn


def run_extractors(answers: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Mentions of the built-in lane and of every registered extractor, tagged by `extractor`."""
    out = extract_mentions(answers, dictionary).withColumn("extractor", F.lit("builtin"))
    for name, fn in _EXTRACTORS.items():
        out = out.unionByName(fn(answers, dictionary).withColumn("extractor", F.lit(name)), allowMissingColumns=True)
    return out


def extract_all(runs: DataFrame, dictionary: DataFrame) -> dict[str, DataFrame]:
    """Mentions, citations (text and annotations merged) and claims of a batch; failed runs yield nothing.

    The responses are parsed once, into a table of texts and annotation urls in the shared folder that the three outputs read.
    """
    parsed = materialize(_parsed(runs), "answers")
    answers = parsed.select("project_id", "run_id", "text").filter(F.col("text").isNotNull())
    return {
        "mentions": extract_mentions(answers, dictionary),
        "citations": merge_citations(extract_citations(answers), _from_urls(parsed, F.col("note_urls"), ("run_id",))),
        "claims": extract_claims(answers, dictionary),
    }
