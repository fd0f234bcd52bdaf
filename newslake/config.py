"""Defaults of the jobs. Every table below holds fixed values, stated as they must be for right results."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

#: The clock of every test and query; operators take it as an argument.
AS_OF = "2024-01-31 00:00:00"

# Category boosts.
CATEGORY_BOOSTS = {"ai": 1.25, "security": 1.15, "startups": 1.10, "programming": 1.05, "devtools": 1.05, "mobile": 1.00, "hardware": 0.95, "tech": 0.90, "other": 0.80}

# Source authority, 0 to 100, for ranking.
SOURCE_AUTHORITY = {
    "OpenAI Blog": 98, "Google AI Blog": 98, "Microsoft Research": 95, "MIT Technology Review": 95, "GitHub Blog": 95, "Anthropic Blog": 95, "DeepMind Blog": 95,
    "TechCrunch": 85, "The Verge": 82, "Ars Technica": 88, "Wired": 80, "Engadget": 75, "VentureBeat": 78,
    "Krebs on Security": 92, "Schneier on Security": 90, "Security Week": 80, "BleepingComputer": 78,
    "Hacker News": 70, "Reddit r/programming": 60, "DEV Community": 55, "Lobsters": 65, "GitHub Trending": 75,
}

# Source authority for the choice of a cluster's canonical article.
CANONICAL_AUTHORITY = {
    "OpenAI Blog": 100, "Google AI Blog": 100, "Microsoft Research": 98, "GitHub Blog": 95, "MIT Technology Review": 95, "Anthropic Blog": 95, "Ars Technica": 90, "TechCrunch": 88,
    "The Verge": 85, "Wired": 85, "VentureBeat": 80, "Krebs on Security": 95, "Schneier on Security": 92, "Hacker News": 70, "Reddit": 50, "DEV Community": 55, "GitHub Trending": 75,
}

# Keyword weights of the relevance signal.
KEYWORD_WEIGHTS = {
    **dict.fromkeys(["artificial intelligence", "machine learning", "ai", "llm", "gpt", "chatgpt", "large language model", "neural network", "deep learning", "openai", "anthropic", "gemini", "claude"], 3.0),
    **dict.fromkeys(["security", "vulnerability", "data breach", "ransomware", "cybersecurity", "zero-day", "encryption"], 2.5),
    **dict.fromkeys(["startup", "funding", "series a", "series b", "acquisition", "ipo", "unicorn", "ycombinator", "y combinator"], 2.0),
    **dict.fromkeys(["programming", "developer", "software", "open source", "api", "framework", "typescript", "rust", "python", "javascript", "golang", "kubernetes", "docker"], 1.5),
    **dict.fromkeys(["cloud", "aws", "azure", "google cloud", "saas", "infrastructure", "database", "blockchain", "crypto", "web3"], 1.0),
}

# Tech relevance keywords by weight, and terms that count against.
TECH_HIGH = (
    "artificial intelligence", "machine learning", "deep learning", "neural network", "gpt", "llm", "chatgpt", "claude", "gemini", "openai", "anthropic",
    "natural language processing", "nlp", "computer vision", "software", "programming", "developer", "coding", "algorithm", "api", "sdk", "framework", "library", "open source",
    "cloud computing", "aws", "azure", "google cloud", "kubernetes", "docker", "devops", "microservices", "serverless", "cybersecurity", "data breach", "ransomware", "encryption",
    "vulnerability", "zero-day", "malware", "phishing", "semiconductor", "processor", "gpu", "chip", "quantum computing", "tech startup", "silicon valley", "venture capital",
    "series a", "series b", "unicorn", "ipo tech",
)
TECH_MEDIUM = (
    "javascript", "typescript", "python", "rust", "golang", "java", "swift", "kotlin", "c++", "ruby", "php", "react", "vue", "angular", "nodejs", "django", "flask", "spring", "nextjs",
    "nuxt", "svelte", "mongodb", "postgresql", "mysql", "redis", "elasticsearch", "google", "microsoft", "apple", "amazon", "meta", "facebook", "nvidia", "intel", "amd", "tesla", "spacex",
    "twitter", "linkedin", "tiktok", "samsung", "huawei", "xiaomi", "bytedance", "alibaba", "netflix", "uber", "airbnb", "spotify", "snap", "zoom", "slack", "dropbox", "blockchain",
    "cryptocurrency", "bitcoin", "ethereum", "web3", "nft", "defi", "ios", "android", "mobile app", "smartphone", "iphone", "pixel", "galaxy", "technology", "tech news", "digital",
    "internet", "online", "app", "platform", "saas", "paas", "iaas", "gadget", "device", "update", "launch", "release", "feature", "upgrade", "software update",
)
TECH_LOW = (
    "innovation", "disrupt", "automation", "robotics", "drone", "virtual reality", "vr", "augmented reality", "ar", "metaverse", "data", "analytics", "big data", "iot", "smart device",
    "streaming", "gaming", "esports", "video game", "electric vehicle", "ev", "self-driving", "autonomous",
)
NON_TECH = (
    "sports", "football", "basketball", "baseball", "soccer", "celebrity", "entertainment", "gossip", "kardashian", "recipe", "cooking", "restaurant", "food review", "fashion", "beauty",
    "makeup", "skincare", "real estate", "mortgage", "housing market", "travel", "vacation", "tourism", "hotel", "weather forecast", "horoscope", "astrology", "politics", "election",
    "senate", "congress", "president",
)
# Sources whose articles count as tech.
TECH_SOURCES = ("hackernews", "github-trending", "techcrunch", "theverge", "arstechnica", "wired")

# Stop words and boosted terms of the term vectors.
STOP_WORDS = tuple(
    "the a an and or but in on at to for of with by from as is was are were been be have has had do does did will would could should may might must shall can need dare ought"
    " used it its this that these those i you he she we they what which who whom whose where when why how all each every both few more most other some such no nor not only own"
    " same so than too very just also now new says said according report reports reported".split()
)
BOOST_TERMS = tuple(
    "ai artificial intelligence machine learning neural gpt llm chatgpt openai anthropic google microsoft apple meta amazon nvidia startup funding series acquisition ipo security"
    " vulnerability breach hack crypto blockchain bitcoin ethereum programming developer software hardware chip processor gpu cloud api".split()
)
# Stop words of the title buckets (ingest, clustering) and of the keyword fingerprint.
BUCKET_STOPS = ("the", "a", "an", "is", "are", "was", "were", "this", "that")
CLUSTER_BUCKET_STOPS = (*BUCKET_STOPS, "new", "how", "why", "what", "when", "where", "who")
FINGERPRINT_STOPS = tuple(
    "the a an and or but in on at to for of with by from is are was were be been being have has had do does did will would could should may might must shall can this that"
    " these those it its they their them".split()
)

# Phrases taken out of page text, in this order, whatever their case.
BOILERPLATE = (
    "subscribe to our newsletter", "sign up for our newsletter", "follow us on (twitter|facebook|instagram|linkedin)", "share this article", "read more:", "related articles?:",
    "advertisement", "sponsored content", "click here to", "cookie(s)? policy", "privacy policy", "terms of (service|use)",
)
# Title keywords that become tags.
TAG_KEYWORDS = (
    "ai", "ml", "machine learning", "artificial intelligence", "gpt", "llm", "cloud", "aws", "azure", "gcp", "kubernetes", "docker", "devops", "javascript", "typescript", "python", "rust",
    "golang", "java", "react", "vue", "angular", "nodejs", "deno", "bun", "blockchain", "crypto", "web3", "nft", "defi", "cybersecurity", "security", "privacy", "encryption", "startup",
    "funding", "ipo", "acquisition", "merger", "apple", "google", "microsoft", "amazon", "meta", "nvidia", "tesla", "openai", "anthropic", "mistral", "gemini", "chatgpt", "claude", "mobile",
    "ios", "android", "app", "api", "sdk", "data", "database", "analytics", "big data", "quantum", "robotics", "automation", "iot", "edge computing",
)
# Category by keyword, in this order.
CATEGORY_KEYWORDS = {
    "ai": ("ai", "ml", "machine learning", "artificial intelligence", "gpt", "llm", "openai", "anthropic", "chatgpt", "claude", "gemini"),
    "programming": ("javascript", "typescript", "python", "rust", "golang", "java", "programming", "coding", "developer"),
    "cloud": ("cloud", "aws", "azure", "gcp", "kubernetes", "docker", "devops", "infrastructure"),
    "security": ("cybersecurity", "security", "privacy", "encryption", "hacking", "vulnerability"),
    "startups": ("startup", "funding", "ipo", "acquisition", "venture", "entrepreneur"),
    "mobile": ("mobile", "ios", "android", "app", "smartphone"),
    "blockchain": ("blockchain", "crypto", "web3", "nft", "defi", "bitcoin", "ethereum"),
    "hardware": ("hardware", "chip", "processor", "gpu", "nvidia", "amd", "intel", "quantum"),
    "opensource": ("github", "opensource", "open source", "linux"),
}
# Parts of image URLs that stand for no image.
PLACEHOLDER_IMAGES = ("placeholder", "default", "no-image", "empty", "1x1", "spacer")
# Title keywords and sources of the breaking-news score; keywords of the summary's closing sentence.
BREAKING_KEYWORDS = (
    "launches", "announces", "releases", "breakthrough", "acquired", "hacked", "breach", "vulnerability", "zero-day", "exploit", "ai", "gpt", "openai", "google", "apple", "microsoft",
    "meta", "outage", "down", "fails", "crashes",
)
BREAKING_SOURCES = ("OpenAI", "Google", "Microsoft", "Apple", "Meta")
SUMMARY_KEYWORDS = (
    "ai", "artificial intelligence", "machine learning", "startup", "security", "privacy", "cloud", "software", "hardware", "app", "developer", "programming", "data", "mobile", "web",
    "blockchain", "crypto", "robotics", "automation", "api", "open source",
)


# The category dimension as first loaded (slug, name, description, icon, colour, order).
CATEGORY_SEEDS = (
    ("ai", "AI", "Artificial Intelligence & Machine Learning", "smart_toy", "#8B5CF6", 1),
    ("startups", "Startups", "Startup news and funding rounds", "rocket_launch", "#F59E0B", 2),
    ("security", "Security", "Cybersecurity and privacy", "security", "#EF4444", 3),
    ("devtools", "DevTools", "Developer tools and frameworks", "code", "#10B981", 4),
    ("tech", "Tech", "General technology news", "devices", "#3B82F6", 5),
)
# Icon and colour of a category that ingest adds, with the defaults of any other.
CATEGORY_ICONS = {"ai": "🤖", "programming": "💻", "cloud": "☁️", "security": "🔒", "startups": "🚀", "mobile": "📱", "blockchain": "⛓️", "hardware": "🔧", "opensource": "🐙", "technology": "⚡"}
CATEGORY_COLORS = {
    "ai": "#8B5CF6", "programming": "#3B82F6", "cloud": "#06B6D4", "security": "#EF4444", "startups": "#F59E0B", "mobile": "#10B981", "blockchain": "#6366F1", "hardware": "#F97316",
    "opensource": "#22C55E", "technology": "#6B7280",
}
CATEGORY_DEFAULT = ("📰", "#6B7280", 99)
# Delivery channel by notification type, and send errors that make a token invalid.
CHANNELS = {"breaking_news": "breaking_news_channel", "daily_digest": "digest_channel", "topic_alert": "topic_alert_channel"}
CHANNEL_DEFAULT = "default_channel"
INVALID_TOKEN_ERRORS = ("messaging/invalid-registration-token", "messaging/registration-token-not-registered", "messaging/invalid-argument")
# Prices per input and output token by model.
MODEL_PRICES = {
    "gpt-4o-mini": (0.00015 / 1000, 0.0006 / 1000), "gpt-4o": (0.005 / 1000, 0.015 / 1000),
    "claude-3-haiku-20240307": (0.00025 / 1000, 0.00125 / 1000), "claude-3-5-sonnet-20241022": (0.003 / 1000, 0.015 / 1000),
}


@dataclass(frozen=True)
class Ranking:
    """Weights must add up to 1 within a thousandth."""

    source: float = 0.20
    keyword: float = 0.25
    recency: float = 0.25
    engagement: float = 0.20
    authority: float = 0.10
    half_life_hours: float = 12.0
    max_age_hours: float = 72.0
    boosts: dict[str, float] = field(default_factory=lambda: dict(CATEGORY_BOOSTS))
    authorities: dict[str, float] = field(default_factory=lambda: dict(SOURCE_AUTHORITY))
    keywords: dict[str, float] = field(default_factory=lambda: dict(KEYWORD_WEIGHTS))

    def __post_init__(self):
        total = self.source + self.keyword + self.recency + self.engagement + self.authority
        if abs(total - 1) > 0.001:
            raise ValueError(f"weights must add up to 1, not {total}")

    def merged(self, **changes) -> Ranking:
        return replace(self, **changes)


@dataclass(frozen=True)
class Clustering:
    exact: float = 0.95
    same_story: float = 0.80
    related: float = 0.60
    min_jaccard: float = 0.30
    window_hours: int = 72
    max_comparisons: int = 500
