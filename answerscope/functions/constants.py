"""Fixed values. They must equal the published behaviour for results to agree."""

# Sentiment lexicon.
POSITIVE_TERMS = ["accurate", "best", "fast", "good", "great", "leading", "recommended", "reliable", "robust", "strong"]
NEGATIVE_TERMS = ["bad", "buggy", "expensive", "fails", "limited", "poor", "slow", "unreliable", "weak", "worse"]
SENTIMENT_LANE = "deterministic_lexicon"
SENTIMENT_RADIUS = 160

# Claim constants.
CLAIM_KIND = "factual_statement"
CLAIM_CONFIDENCE = 80
CLAIM_LANE = "deterministic_sentence"

# Crawler user agents: needle -> bot id, first match wins.
BOT_NEEDLES = [
    ("oai-searchbot", "openai-oai-searchbot"),
    ("chatgpt-user", "openai-chatgpt-user"),
    ("gptbot", "openai-gptbot"),
    ("claudebot", "anthropic-claudebot"),
    ("perplexitybot", "perplexitybot"),
    ("google-extended", "google-extended"),
    ("googlebot", "googlebot"),
    ("ccbot", "common-crawl-ccbot"),
    ("bytespider", "bytedance-bytespider"),
    ("amazonbot", "amazonbot"),
]

# Seeded address ranges per bot.
BOT_RANGES = [
    ("openai-gptbot", "20.42.0.0/16"),
    ("openai-chatgpt-user", "20.42.0.0/16"),
    ("openai-oai-searchbot", "20.42.0.0/16"),
    ("anthropic-claudebot", "160.79.104.0/23"),
    ("perplexitybot", "34.117.0.0/16"),
    ("google-extended", "66.249.64.0/19"),
    ("googlebot", "66.249.64.0/19"),
    ("common-crawl-ccbot", "18.97.0.0/16"),
]

# Site event taxonomy.
SITE_EVENT_TYPES = [
    "page_view", "leaderboard_view", "brand_profile_view", "contribute_start", "contribute_step",
    "contribute_complete", "verify_start", "verify_complete", "verify_fail", "badge_embed_view",
]
CONTRIBUTE_STEPS = ["contribute_start", "contribute_step", "contribute_complete"]

# First-party providers, USD per million tokens, tokens assumed per run.
PROVIDER_PRICES = {
    "openai": "7.50", "anthropic": "9.00", "gemini": "5.25", "perplexity": "5.00",
    "grok": "7.00", "mistral": "4.00", "openrouter": "7.50",
}
TOKENS_PER_RUN = 2000
DAYS_PER_MONTH = 30.4375
MAX_TICKS_PER_HOUR = 12.0
MAX_TICKS_PER_DAY = 96.0

# Static assets are not pages.
ASSET_PREFIXES = ["/_next/", "/static/"]
ASSET_EXTENSIONS = [
    ".js", ".mjs", ".cjs", ".css", ".woff", ".woff2", ".ttf", ".eot", ".otf", ".png", ".jpg", ".jpeg", ".gif",
    ".svg", ".ico", ".webp", ".avif", ".webmanifest", ".zip", ".gz", ".tar", ".mp4", ".mp3", ".webm", ".pdf",
]

# Page audit markers.
AI_ROBOTS_MARKERS = ["noai", "noimageai", "google-extended", "gptbot", "ccbot", "anthropicbot", "perplexitybot"]
SCHEMA_MARKERS = ["application/ld+json", "schema.org"]
CANONICAL_MARKERS = ['rel="canonical"', "rel='canonical'"]
ANSWER_MARKERS = ['class="answer', "class='answer", 'id="answer', "id='answer", "summary", "tldr", "<ol", "<dl"]
NAMED_SOURCE_PHRASES = ["source:", "according to", "references", "bibliography", "cited by"]
SOURCE_CONTEXT_WORDS = ["source", "reference", "study", "report", "citation"]
QUESTION_PREFIXES = ["what ", "how ", "why ", "who ", "when ", "where ", "is ", "can ", "does "]

# Look-alike letters -> Latin. Position i of the first string folds to position i of the second.
CONFUSABLES_FROM = "АаВСсЕеНІіЈјКМΝΟοОоРрρТυХхΧχΥҮΖζ"
CONFUSABLES_TO = "aabcceehiijjkmnooooppptuxxxxyyzz"

# Recommendation thresholds.
DOCS_MIN_RUNS = 5
RANK_BAD = 3.0
COMPETITOR_DELTA = 2.0
DRIFT_DISTANCE = 0.4
COVERAGE_SHARE = 0.10
EXTRACTION_THRESHOLD = 0.6
MAX_SOURCE_IDS = 50
MAX_SUMMARY = 240

# Recommendation lifecycle: legal edges besides staying in place.
LIFECYCLE_EDGES = [
    ("generated", "surfaced"), ("generated", "stale"), ("surfaced", "acknowledged"), ("surfaced", "dismissed"),
    ("acknowledged", "acted"), ("acknowledged", "dismissed"), ("acted", "measured"),
]

# Trend kinds.
BUILTIN_TREND_KINDS = ["threshold_regression", "statistical_anomaly", "response_change"]

# Public benchmark density thresholds.
MIN_CONTRIBUTORS, MIN_CATEGORIES, MIN_DOMAINS_PER_CATEGORY, MIN_RUNS_PER_SEGMENT = 20, 20, 10, 100
K_FLOOR = 5

# Evidence texts of the page audit, compared as they stand.
EVIDENCE = {
    "schema": "found JSON-LD/schema.org marker",
    "canonical": "found rel=canonical",
    "site_name": "found og:site_name or title site separator",
    "llms_txt": "found /llms.txt (200)",
    "robots": "found AI-crawler meta robots directive",
    "answer": "found answer-like block or list structure",
    "sources": "found named-source phrase",
    "context": "found source-context label near page links",
}

# Patterns of urls and bare domains in answer texts.
URL = r"(?iU)\bhttps?://[a-z0-9][a-z0-9.\-]*[a-z0-9](?::\d+)?(?:/[^\s)\]]*)?"
BARE_DOMAIN = r"(?iU)\b(?:[a-z0-9](?:[a-z0-9\-]{0,61}[a-z0-9])?\.)+[a-z]{2,24}\b"
