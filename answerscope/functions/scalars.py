"""Column -> Column functions. Everything here is a built-in expression; there is no Python UDF."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import constants as C


def as_ts(value) -> Column:
    """A timestamp literal from a datetime or an ISO string."""
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def squeeze(c: Column) -> Column:
    """Strip surrounding whitespace of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def compute_once(df: DataFrame, *cols) -> DataFrame:
    """select(*cols) behind a one-element explode.

    A filter on a plain projection is pushed below it with its expressions copied, so a parsed field
    would be parsed again for the filter. Nothing is pushed below a generator's own output.
    """
    return df.select(F.explode(F.array(F.struct(*cols))).alias("__row")).select("__row.*")


# --- time, rates, rounding ---------------------------------------------------------------------


def day(c: Column) -> Column:
    return F.to_date(c)


def hour(c: Column) -> Column:
    return F.date_trunc("hour", c)


def latency_ms(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1000.0)


def safe_rate(num: Column, den: Column, empty=0.0) -> Column:
    """num / den, or `empty` (0.0 or None, the caller's choice per metric) when den is 0 or NULL."""
    return F.when(den > 0, num / den).otherwise(F.lit(empty).cast("double"))


def round_half_up(c: Column, n: int) -> Column:
    return F.round(c, n)


def days_before(as_of, days: int, low: int = 1, high: int = 365) -> Column:
    """Start of a trailing window; the length is clamped like every trailing window."""
    n = min(max(days, low), high)
    return as_ts(as_of) - F.make_dt_interval(F.lit(n))


def hours_before(as_of, hours: int, high: int = 8760) -> Column:
    n = min(max(hours, 1), high)
    return as_ts(as_of) - F.make_dt_interval(F.lit(0), F.lit(n))


def window_filter(df: DataFrame, as_of, days: int, closed_end: bool = False, col: str = "started_at") -> DataFrame:
    """Trailing N-day window on a timestamp column; reaches the Parquet scan as a pushed filter."""
    out = df.filter(F.col(col) >= days_before(as_of, days))
    return out.filter(F.col(col) <= as_ts(as_of)) if closed_end else out


def calendar_window(df: DataFrame, as_of, days: int, col: str = "day") -> DataFrame:
    """Today and the N-1 earlier UTC days."""
    return df.filter(F.col(col) >= F.date_sub(F.to_date(as_ts(as_of)), days - 1))


def opt_eq(df: DataFrame, col: str, value) -> DataFrame:
    """Equality filter where None means all rows."""
    return df if value is None else df.filter(F.col(col) == value)


def opt_in(df: DataFrame, col: str, values: Sequence | None) -> DataFrame:
    """Membership filter where an empty list means all rows."""
    return df.filter(F.col(col).isin(list(values))) if values else df


def org_scope(df: DataFrame, org_id: str | None) -> DataFrame:
    """Rows of one org; without an org nothing, never everything."""
    return df.filter(F.lit(False)) if not org_id else df.filter(F.col("org_id") == org_id)


# --- identity, slugs, buckets ------------------------------------------------------------------


def provider_identity(provider: Column, model: Column) -> Column:
    return F.when(provider == "openrouter", F.concat(F.lit("openrouter:"), model)).otherwise(provider)


def with_provider_identity(runs: DataFrame) -> DataFrame:
    return runs.withColumn("provider_identity", provider_identity(F.col("provider"), F.col("model")))


def is_slug(c: Column, extra: str = "") -> Column:
    return F.coalesce(c.rlike(rf"\A[a-z0-9{extra}-]+\z"), F.lit(False))


def is_provider(c: Column) -> Column:
    """A first-party provider name or `plugin:<id>`."""
    name = squeeze(c)
    return name.isin(list(C.PROVIDER_PRICES)) | name.rlike(r"\Aplugin:.+")


def bot_id(ua: Column) -> Column:
    """First needle in the fixed order found in the user agent, else NULL."""
    low = F.lower(ua)
    out = F.lit(None).cast("string")
    for needle, bot in reversed(C.BOT_NEEDLES):
        out = F.when(low.contains(needle), F.lit(bot)).otherwise(out)
    return out


def method_bucket(c: Column) -> Column:
    m = F.lower(squeeze(c))
    return F.when(m.isin("dns", "dns_txt"), "dns").when(m.isin("email", "email_magic_link"), "email").otherwise("unknown")


def severity(delta: Column) -> Column:
    size = F.abs(delta)
    return F.when(size >= 4.0, "high").when(size >= 2.5, "medium").otherwise("low")


def trend_kind(plugin: Column | str, kind: Column | str) -> Column:
    """`plugin:<name>:<kind>`."""
    lift = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.concat(F.lit("plugin:"), lift(plugin), F.lit(":"), lift(kind))


def is_plugin_trend(kind: Column) -> Column:
    return kind.startswith("plugin:")


def is_builtin_trend(kind: Column) -> Column:
    return kind.isin(C.BUILTIN_TREND_KINDS)


def sha256_tag(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def sorted_set(c: Column) -> Column:
    """Distinct values in order, for columns with a small closed domain such as providers."""
    return F.sort_array(F.collect_set(c))


def json_first(js: Column, keys: Sequence[str]) -> Column:
    """The raw text of the first key that is present, whatever its type; later keys are not consulted."""
    return F.coalesce(*[F.get_json_object(js, f"$['{k}']") for k in keys])


# --- paths, hosts, domains ---------------------------------------------------------------------


def crawler_path(c: Column) -> Column:
    t = squeeze(c)
    return (
        F.when(t == "", F.lit("/"))
        .when(t.rlike(r"\Ahttps?://[^/]*/"), F.regexp_replace(t, r"\Ahttps?://[^/]*", ""))
        .otherwise(t)
    )


def site_path(c: Column, max_bytes: int | None = None) -> Column:
    """Site-relative path without query and fragment; anything else is `(other)`, blank is NULL."""
    t = squeeze(c) if max_bytes else c
    proto_rel = r"\A//[^/]*/" if max_bytes else r"\A\b\B"
    absolute = r"(?i)\Ahttps?://[^/]*"
    path = F.when(t.rlike(absolute), F.regexp_replace(t, absolute, "")).when(
        t.rlike(proto_rel), F.regexp_replace(t, r"\A//[^/]*", "")
    ).when(t.startswith("//") & F.lit(bool(max_bytes)), F.lit(None)).when(t.startswith("/"), t)
    clean = F.regexp_replace(path, r"(?s)[?#].*\z", "")
    clean = F.when(clean == "", F.lit("/")).otherwise(clean)
    if max_bytes:
        clean = cut_bytes(clean, max_bytes)
    return F.when(t == "", F.lit(None)).when(t.rlike(r"[\x00-\x1f]"), F.lit("(other)")).otherwise(
        F.coalesce(clean, F.when(t.isNotNull(), F.lit("(other)")))
    )


def cut_bytes(c: Column, n: int) -> Column:
    """At most n UTF-8 bytes, cut at a character boundary (characters have at most 4 bytes)."""
    sizes = F.transform(F.split(F.substring(c, 1, n), ""), lambda ch: F.octet_length(ch))
    fits = F.aggregate(
        sizes,
        F.struct(F.lit(0).alias("b"), F.lit(0).alias("k")),
        lambda a, s: F.struct(
            (a["b"] + s).alias("b"), F.when(a["b"] + s <= n, a["k"] + 1).otherwise(a["k"]).alias("k")
        ),
    )["k"]
    return F.when(F.octet_length(c) <= n, c).otherwise(F.left(c, fits))


def referrer_host(c: Column) -> Column:
    """Lower-case host of a referrer; NULL for blank, control characters or an `@`."""
    bare = F.regexp_replace(c, r"(?i)\A(https?:)?//", "")
    host = F.lower(F.regexp_extract(bare, r"\A([^/:]*)", 1))
    good = host.rlike(r"\A[a-z0-9.-]+\z") & host.contains(".")
    usable = (c != "") & ~c.rlike(r"[\x00-\x1f]") & ~c.contains("@")
    return F.when(usable & (host != ""), F.when(good, host).otherwise(F.lit("(other)")))


def referrer_at_ingest(c: Column) -> Column:
    """The stricter rule at the trust boundary: `@` and control characters become `(other)`."""
    t = squeeze(c)
    host = F.lower(F.regexp_extract(F.regexp_replace(t, r"\A(https?://|//)", ""), r"\A([^/?#:]*)", 1))
    good = host.rlike(r"\A[a-z0-9.-]+\z") & host.contains(".")
    bad = t.rlike(r"[\x00-\x1f\x7f]") | t.contains("@")
    return F.when(t == "", F.lit(None)).when(bad | ~good, F.lit("(other)")).otherwise(cut_bytes(host, 256))


def source_type(domain: Column, path: Column) -> Column:
    d = F.lower(domain)
    return (
        F.when(d.contains("reddit.com"), "reddit")
        .when(d.endswith("wikipedia.org"), "wikipedia")
        .when((d == "youtube.com") | d.endswith(".youtube.com") | (d == "youtu.be"), "youtube")
        .when(d.startswith("docs.") | path.startswith("/docs") | d.endswith(".readthedocs.io"), "docs")
        .otherwise("general_web")
    )


def confusable_pairs() -> tuple[str, str]:
    """Look-alike Cyrillic/Greek letters and full-width ASCII, and what they fold to, place by place."""
    wide = "".join(chr(0xFF10 + i) for i in range(10))
    wide += "".join(chr(0xFF41 + i) for i in range(26)) + "".join(chr(0xFF21 + i) for i in range(26))
    letters = "abcdefghijklmnopqrstuvwxyz"
    return C.CONFUSABLES_FROM + wide, C.CONFUSABLES_TO + "0123456789" + letters + letters


def fold_confusables(c: Column) -> Column:
    """Look-alike letters to Latin."""
    return F.translate(c, *confusable_pairs())


def normalize_domain(c: Column) -> Column:
    host = F.regexp_replace(squeeze(c), r"\A(https://)*(http://)*", "")
    host = F.lower(F.split_part(host, F.lit("/"), F.lit(1)))
    host = F.regexp_replace(F.regexp_replace(host, r"\Awww\.", ""), r"\.+\z", "")
    return fold_confusables(host)


def fold_name(c: Column) -> Column:
    return fold_confusables(F.lower(c))


def strip_name(c: Column) -> Column:
    """Letters, digits and single spaces of an already folded name."""
    kept = F.regexp_replace(c, r"[^\p{IsAlphabetic}\p{N}\s\p{Z}]", "")
    return squeeze(F.regexp_replace(kept, r"[\s\p{Z}]+", " "))


def name_similarity(a: Column, b: Column) -> Column:
    """100 same folded name, 90 one edit, 85 same without punctuation, 70 prefix, 0 otherwise."""
    na, nb = fold_name(a), fold_name(b)
    pa, pb = strip_name(na), strip_name(nb)
    return (
        F.when(na == nb, 100)
        .when(F.levenshtein(na, nb, 1) >= 0, 90)
        .when(pa == pb, 85)
        .when(pa.startswith(pb) | pb.startswith(pa), 70)
        .otherwise(0)
    )


# --- html --------------------------------------------------------------------------------------


def strip_tags(c: Column) -> Column:
    """Drop tags; each `<` and `>` becomes a space; an unclosed `<` swallows the rest."""
    return F.translate(F.regexp_replace(c, r"<[^>]*(>|\z)", "  "), ">", " ")


def collapse(c: Column) -> Column:
    """Decode the two entities the audit knows and collapse whitespace."""
    plain = F.replace(F.replace(c, F.lit("&amp;"), F.lit("&")), F.lit("&nbsp;"), F.lit(" "))
    return F.regexp_replace(F.regexp_replace(plain, r"(?U)\s+", " "), r"\A | \z", "")


def clean_text(html: Column) -> Column:
    return collapse(strip_tags(html))


def is_question(c: Column) -> Column:
    starts = F.lit(False)
    low = F.lower(c)
    for prefix in C.QUESTION_PREFIXES:
        starts = starts | low.startswith(prefix)
    return c.endswith("?") | starts


def contains_any(c: Column, needles: Sequence[str]) -> Column:
    out = F.lit(False)
    for needle in needles:
        out = out | c.contains(needle)
    return out


def is_crawlable(url: Column) -> Column:
    """False for static assets: by path prefix or by extension of the path."""
    path = F.lower(F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))
    keep = ~F.lit(False)
    for prefix in C.ASSET_PREFIXES:
        keep = keep & ~path.startswith(prefix)
    for ext in C.ASSET_EXTENSIONS:
        keep = keep & ~path.endswith(ext)
    return keep


# --- ip addresses ------------------------------------------------------------------------------

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}"


def let(value: Column, body) -> Column:
    """body(value) with `value` evaluated once: a large expression used many times stays one node."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _v4_hex(ip: Column) -> Column:
    part = lambda i: F.split_part(ip, F.lit("."), F.lit(i)).try_cast("bigint")
    return F.lpad(F.lower(F.hex(part(1) * 16777216 + part(2) * 65536 + part(3) * 256 + part(4))), 8, "0")


def _v6_groups(ip: Column) -> Column:
    """Eight 4-digit hex groups of an IPv6 address, or NULL."""
    no_groups = F.array().cast("array<string>")

    def side(halves: Column, i: int) -> Column:
        h = F.coalesce(F.get(halves, F.lit(i)), F.lit(""))
        return F.when(h == "", no_groups).otherwise(F.split(h, ":"))

    def checked(s: Column) -> Column:
        gap = F.array_repeat(F.lit("0"), F.greatest(8 - s["have"], F.lit(0)))
        shape = ((s["n"] == 1) & (s["have"] == 8)) | ((s["n"] == 2) & (s["have"] <= 7))
        return let(
            F.concat(s["left"], gap, s["right"]),
            lambda g: F.when(
                shape & F.forall(g, lambda x: x.rlike(r"\A[0-9a-f]{1,4}\z")), F.transform(g, lambda x: F.lpad(x, 4, "0"))
            ),
        )

    def halved(halves: Column) -> Column:
        left, right = side(halves, 0), side(halves, 1)
        return F.struct(left.alias("left"), right.alias("right"), F.size(halves).alias("n"), (F.size(left) + F.size(right)).alias("have"))

    low = F.lower(ip)
    tail = F.regexp_extract(low, rf":({_V4})\z", 1)
    tail_hex = _v4_hex(tail)
    as_hex = F.concat(F.regexp_replace(low, rf"{_V4}\z", ""), F.left(tail_hex, F.lit(4)), F.lit(":"), F.right(tail_hex, F.lit(4)))
    text = F.when(tail != "", as_hex).otherwise(low)
    return let(F.split(text, "::"), lambda h: let(halved(h), checked))


def ip_key(ip: Column) -> Column:
    """Order-preserving text form, `4:` + 8 or `6:` + 32 hex digits; NULL when not an address.

    The family prefix keeps the two families apart, so range checks are plain string comparisons.
    """
    return F.when(ip.rlike(rf"\A{_V4}\z"), F.concat(F.lit("4:"), _v4_hex(ip))).when(
        ip.contains(":"), F.concat(F.lit("6:"), F.array_join(_v6_groups(ip), ""))
    )


def truncate_ip(ip: Column) -> Column:
    """IPv4 without its last octet, IPv6 without its last 64 bits, `invalid` for anything else."""

    def network(groups: Column) -> Column:
        hexes = F.array_join(F.transform(F.slice(groups, 1, 4), lambda g: F.regexp_replace(g, r"\A0{1,3}", "")), ":")
        return F.concat(F.regexp_replace(hexes, r"(\A|:)0(:0)*\z", ""), F.lit("::"))

    return (
        F.when(ip.rlike(rf"\A{_V4}\z"), F.regexp_replace(ip, r"[0-9]+\z", "0"))
        .when(ip.contains(":"), F.coalesce(let(_v6_groups(ip), network), F.lit("invalid")))
        .otherwise(F.when(ip.isNotNull(), F.lit("invalid")))
    )


def hash_ip(ip: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), F.lit(":"), ip), 256)


def store_ip(df: DataFrame, mode: str, salt: str = "", col: str = "client_ip") -> DataFrame:
    """Replace the raw address by exactly one of three columns, by privacy mode (default hashed)."""
    if mode not in ("raw", "truncated", "hashed"):
        raise ValueError(f"unknown privacy mode {mode!r}; expected raw, truncated or hashed")
    ip = F.when(squeeze(F.col(col)) != "", squeeze(F.col(col)))
    none = F.lit(None).cast("string")
    return df.withColumns(
        {
            col: ip if mode == "raw" else none,
            "client_ip_truncated": truncate_ip(ip) if mode == "truncated" else none,
            "client_ip_hash": hash_ip(ip, salt) if mode == "hashed" else none,
            "privacy_mode": F.lit(mode),
        }
    )


def cidr_bounds(cidr: Column) -> tuple[Column, Column]:
    """First and last address of a CIDR block as ip_key text; NULL for a malformed block."""
    block = _cidr(cidr)
    return block["lo"], block["hi"]


def cidr_prefixes(cidr: Column) -> Column:
    """The beginnings of ip_key text that the block's addresses have and no others: one, or two to eight where it ends inside a digit."""
    return _cidr(cidr)["prefixes"]


def _cidr(cidr: Column) -> Column:

    def bounds(x: Column) -> Column:
        digits, whole, rest = x["digits"], F.floor(x["prefix"] / 4).cast("int"), x["prefix"] % 4
        nibble = F.conv(F.substring(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
        span = F.element_at(F.array(F.lit(16), F.lit(8), F.lit(4), F.lit(2)), rest + 1)
        low_n = (F.floor(nibble / span) * span).cast("int")
        mid = lambda v: F.when(whole < F.length(digits), F.lower(F.hex(v))).otherwise(F.lit(""))
        pad = lambda ch: F.repeat(F.lit(ch), F.greatest(F.length(digits) - whole - 1, F.lit(0)))
        head = F.concat(x["family"], F.left(digits, whole))
        ok = x["prefix"] <= F.length(digits) * 4
        return F.struct(
            F.when(ok, F.concat(head, mid(low_n), pad("0"))).alias("lo"),
            F.when(ok, F.concat(head, mid((low_n + span - 1).cast("int")), pad("f"))).alias("hi"),
            F.when(ok & (rest == 0), F.array(head))
            .when(ok, F.transform(F.sequence(low_n, low_n + span - 1), lambda v: F.concat(head, F.lower(F.hex(v))))).alias("prefixes"),
        )

    def parts(key: Column) -> Column:
        digits = F.substring(key, 3, 32)
        given = F.regexp_extract(cidr, r"/([0-9]{1,3})\z", 1).try_cast("int")
        return F.struct(F.left(key, F.lit(2)).alias("family"), digits.alias("digits"), F.coalesce(given, F.length(digits) * 4).alias("prefix"))

    return let(let(ip_key(F.split_part(cidr, F.lit("/"), F.lit(1))), parts), bounds)


def ip_in_cidr(ip: Column, cidr: Column) -> Column:
    lo, hi = cidr_bounds(cidr)
    return F.coalesce(ip_key(ip).between(lo, hi), F.lit(False))


# --- schedules, prices -------------------------------------------------------------------------


def run_cost(provider: Column) -> Column:
    """Blended price of one run; unknown providers cost 0, NULL stays NULL."""
    out = F.lit(None).cast("decimal(18,10)")
    zero = F.lit("0").cast("decimal(18,10)")
    for name, price in C.PROVIDER_PRICES.items():
        usd = F.lit(f"{C.TOKENS_PER_RUN * float(price) / 1e6:.10f}").cast("decimal(18,10)")
        out = F.when(F.lower(provider) == name, usd).otherwise(out)
    return F.coalesce(out, F.when(provider.isNotNull(), zero))


def ticks_per_day(expr: Column) -> Column:
    """Cadence text to ticks per day; NULL when unsupported."""
    t = F.lower(squeeze(expr))
    every = r"\Aevery\s+([0-9]*\.?[0-9]+)\s+(minutes?|hours?)\z"
    n = F.regexp_extract(t, every, 1).try_cast("double")
    unit = F.regexp_extract(t, every, 2)
    fields = F.split(t, r"\s+")

    def field(i: int, span: float) -> Column:
        f = F.get(fields, F.lit(i))
        step = F.regexp_extract(f, r"\A\*/([0-9]*\.?[0-9]+)\z", 1).try_cast("double")
        return (
            F.when(f == "*", F.lit(span))
            .when(step > 0, F.ceil(F.lit(span) / step).cast("double"))
            .when(f.rlike(r"\A\+?[0-9]+\z"), F.lit(1.0))
        )

    dow = F.get(fields, F.lit(4))
    per_day = field(0, 60.0) * field(1, 24.0)
    open_days = (F.get(fields, F.lit(2)) == "*") & (F.get(fields, F.lit(3)) == "*")
    cron = F.when(
        (F.size(fields) == 5) & open_days,
        F.when(dow == "*", per_day).when(dow.rlike(r"\A\+?[0-9]+\z"), per_day / 7.0),
    )
    return (
        F.when(t == "hourly", 24.0)
        .when(t == "daily", 1.0)
        .when(t == "weekly", F.lit(1.0) / 7.0)
        .when((n > 0) & unit.startswith("minute"), F.lit(1440.0) / n)
        .when((n > 0) & unit.startswith("hour"), F.lit(24.0) / n)
        .otherwise(cron)
    )


# --- SQL surface -------------------------------------------------------------------------------


def register_sql_functions(spark: SparkSession) -> None:
    """Scalar helpers callable from SQL text. They are SQL functions, so Catalyst inlines their bodies."""
    price = " ".join(
        f"WHEN '{name}' THEN {C.TOKENS_PER_RUN * float(p) / 1e6:.10f}" for name, p in C.PROVIDER_PRICES.items()
    )
    folds, squeezed = confusable_pairs(), "regexp_replace(raw, '(?U)^[[:space:]]+|[[:space:]]+$', '')".replace("[[:space:]]", "\\\\s")
    bots = " ".join(f"WHEN contains(lower(ua), '{needle}') THEN '{bot}'" for needle, bot in C.BOT_NEEDLES)
    bodies = {
        "run_cost_usd(provider STRING) RETURNS DECIMAL(18,10)": f"CAST(CASE WHEN provider IS NULL THEN NULL ELSE CASE lower(provider) {price} ELSE 0 END END AS DECIMAL(18,10))",
        "bot_identity(ua STRING) RETURNS STRING": f"CASE {bots} END",
        "citation_source_type(domain STRING, path STRING) RETURNS STRING": (
            "CASE WHEN contains(lower(domain), 'reddit.com') THEN 'reddit' "
            "WHEN endswith(lower(domain), 'wikipedia.org') THEN 'wikipedia' "
            "WHEN lower(domain) IN ('youtube.com', 'youtu.be') OR endswith(lower(domain), '.youtube.com') THEN 'youtube' "
            "WHEN startswith(lower(domain), 'docs.') OR startswith(path, '/docs') "
            "OR endswith(lower(domain), '.readthedocs.io') THEN 'docs' ELSE 'general_web' END"
        ),
        "plain_domain(raw STRING) RETURNS STRING": (
            f"translate(regexp_replace(regexp_replace(lower(split_part(regexp_replace({squeezed}, '^(https://)*(http://)*', ''), '/', 1)), "
            f"'^www[.]', ''), '[.]+$', ''), '{folds[0]}', '{folds[1]}')"
        ),
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
