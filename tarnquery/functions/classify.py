"""Keyword scorers and rule tables as column expressions. Keywords match as substrings; ties go to the first class."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnquery.functions.arrays import let
from tarnquery.functions.text import word_count

# Keywords of each class, primary and secondary.
WEIGHTED = {
    "AI & Machine Learning": (
        ("artificial intelligence", "machine learning", "deep learning", "neural network", "ai", "ml", "nlp", "computer vision", "predictive analytics", "automation", "chatbot", "algorithm", "data science", "big data", "analytics"),
        ("intelligent", "automated", "prediction", "model", "training data", "supervised learning", "unsupervised learning", "reinforcement learning", "tensorflow", "pytorch", "scikit-learn", "pandas", "numpy"),
    ),
    "SaaS & Business": (
        ("saas", "software as a service", "subscription", "recurring revenue", "business model", "startup", "scale", "growth hacking", "product management", "customer acquisition", "retention", "churn", "lifetime value"),
        ("b2b", "b2c", "enterprise", "freemium", "pricing strategy", "market fit", "user onboarding", "feature adoption", "metrics", "kpi", "dashboard", "analytics", "conversion funnel"),
    ),
    "Marketing & Sales": (
        ("marketing", "sales", "lead generation", "conversion", "funnel", "customer journey", "branding", "content marketing", "seo", "sem", "social media marketing", "email marketing", "crm", "pipeline"),
        ("campaign", "roi", "ctr", "cpc", "cpm", "attribution", "segmentation", "personalization", "a/b testing", "landing page", "call to action", "lead scoring", "nurturing", "qualification", "closing"),
    ),
    "Leadership & Management": (
        ("leadership", "management", "team building", "culture", "hiring", "performance management", "feedback", "coaching", "mentoring", "strategy", "decision making", "communication", "delegation"),
        ("employee engagement", "motivation", "productivity", "collaboration", "conflict resolution", "change management", "organizational", "remote work", "team dynamics", "goal setting", "accountability"),
    ),
    "Technology Trends": (
        ("technology", "innovation", "digital transformation", "cloud computing", "cybersecurity", "blockchain", "cryptocurrency", "iot", "api", "microservices", "devops", "agile", "scrum", "containerization"),
        ("emerging tech", "future trends", "disruption", "scalability", "infrastructure", "architecture", "integration", "deployment", "monitoring", "security", "compliance", "governance"),
    ),
    "Course Content": (
        ("course", "training", "certification", "learning", "education", "workshop", "masterclass", "tutorial", "lesson", "curriculum", "bootcamp", "program", "academy", "university", "degree"),
        ("skill development", "professional development", "upskilling", "reskilling", "online learning", "e-learning", "mooc", "instructor", "student", "assessment", "certificate", "diploma"),
    ),
}
FIRST_MATCH = {
    "AI & Machine Learning": ("ai", "artificial intelligence", "machine learning", "ml", "deep learning", "neural", "algorithm"),
    "SaaS & Business": ("saas", "software", "business", "startup", "revenue", "subscription", "growth"),
    "Marketing & Sales": ("marketing", "sales", "lead generation", "conversion", "branding", "seo", "social media"),
    "Leadership & Management": ("leadership", "management", "team", "culture", "hiring", "strategy", "communication"),
    "Technology Trends": ("technology", "innovation", "digital", "cloud", "cybersecurity", "blockchain", "iot"),
    "Course Content": ("course", "training", "certification", "learning", "education", "workshop", "tutorial"),
}
COUNTED = {
    "AI & Machine Learning": ("ai", "artificial intelligence", "machine learning", "deep learning", "neural network", "algorithm"),
    "SaaS & Business": ("saas", "software as a service", "business model", "startup", "revenue", "subscription"),
    "Marketing & Sales": ("marketing", "sales", "lead generation", "conversion", "branding", "seo"),
    "Leadership & Management": ("leadership", "management", "team building", "culture", "strategy"),
    "Technology Trends": ("technology", "innovation", "digital transformation", "cloud computing", "cybersecurity"),
    "Course Content": ("course", "training", "certification", "learning", "education", "workshop"),
}
CATEGORIES = (*WEIGHTED, "Other")
#: Classes of the driver's invented prose: syllables instead of subjects, so that every class occurs.
SYLLABLES = {
    "north": (("thing", "ation", "ough"), ("the", "and")),
    "middle": (("lich", "keit", "ung"), ("der", "die")),
    "south": (("ción", "mente", "eza"), ("que", "las")),
    "west": (("eau", "eux", "elle"), ("les", "dans")),
}
ERROR_CATEGORIES = (
    ("network", ("network", "connection", "timeout", "dns")), ("api", ("http", "api", "request", "response")), ("configuration", ("config", "setting", "parameter")),
    ("data_processing", ("data", "parse", "json", "xml")), ("storage", ("storage", "database", "file", "io")), ("authentication", ("auth", "permission", "credential")),
    ("rate_limiting", ("rate", "limit", "quota")), ("validation", ("validation", "value", "type")),
)
CATEGORY_SEVERITY = (("high", ("configuration", "authentication", "api", "storage")), ("medium", ("network", "rate_limiting")))
TYPE_SEVERITY = (("ConfigurationError", "critical"), ("APIError", "high"), ("ScrapingError", "medium"), ("ProcessingError", "medium"), ("StorageError", "high"), ("ValidationError", "low"))
RECOVERY_WORDS = (
    ("retry", ("rate limit", "quota", "too many requests")), ("retry", ("network", "connection", "timeout", "unreachable")),
    ("manual_intervention", ("unauthorized", "forbidden", "authentication")), ("skip", ("invalid", "malformed", "validation")),
)
TYPE_RECOVERY = (("ConfigurationError", "abort"), ("APIError", "retry"), ("ScrapingError", "retry"), ("ProcessingError", "fallback"), ("StorageError", "retry"), ("ValidationError", "skip"))
MESSAGE_PATTERNS = (("timeout", "timeout"), ("connection_issue", "connection"), ("rate_limiting", "rate limit"), ("authentication", "unauthorized"), ("resource_not_found", "not found"))
#: Retry policy by error type: most retries, first and longest delay in seconds.
RETRY_POLICIES = (("ScrapingError", 3, 2.0, 30.0), ("APIError", 5, 1.0, 60.0), ("ProcessingError", 2, 1.0, 10.0), ("StorageError", 3, 0.5, 5.0), ("ValidationError", 1, 0.1, 1.0), ("Exception", 2, 1.0, 10.0))


def hits(text: Column, words: Sequence[str]) -> Column:
    """How many of the words occur, as substrings, in lower case."""
    low = F.lower(text)
    return sum((low.contains(w).cast("int") for w in words), F.lit(0))


def has_any(text: Column, words: Sequence[str]) -> Column:
    return F.lower(text).rlike("|".join(words))


def best(scores: Mapping[str, Column]) -> Column:
    """struct(name, score) of the highest score, the first of equal ones."""
    rows = F.array(*[F.struct(s.cast("double").alias("score"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, s) in enumerate(scores.items())])
    return F.array_max(rows)


def weighted_class(text: Column, lexicon: Mapping = WEIGHTED, least: float = 0.2, other: str = "Other") -> Column:
    """struct(category, confidence): two for a primary and one for a secondary keyword, against lexicon and text size."""
    known = F.struct(F.lower(text).alias("low"), (word_count(text) * F.lit(0.01)).alias("n"))
    count = lambda low, words: sum((low.contains(w).cast("int") for w in words), F.lit(0))

    def top(x: Column) -> Column:
        return best({c: (count(x["low"], a) * 2 + count(x["low"], b)) / (F.lit(0.1 * (len(a) + len(b))) + x["n"]) for c, (a, b) in lexicon.items()})

    def told(top: Column) -> Column:
        sure = F.least(top["score"] / 10.0, F.lit(1.0))
        none = (top["score"] <= 0) | (F.coalesce(text, F.lit("")) == "")
        name = F.when(none | (sure < least), other).otherwise(top["name"])
        return F.struct(name.alias("category"), F.when(none, 0.1).otherwise(sure).alias("confidence"))

    # words and scores are bound, as they would be worked out for each class and use
    return let(let(known, top), told)


def counted_class(text: Column, lexicon: Mapping = COUNTED, default: str = "General") -> Column:
    top = best({c: hits(text, words) for c, words in lexicon.items()})
    return F.when((top["score"] > 0) & (text != ""), top["name"]).otherwise(default)


def first_class(text: Column, lexicon: Mapping = FIRST_MATCH, default: str = "Other") -> Column:
    out = F.lit(default)
    for name, words in reversed(list(lexicon.items())):
        out = F.when(has_any(text, words), name).otherwise(out)
    return out


def first_rule(text: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    out = F.lit(default)
    for name, words in reversed(rules):
        out = F.when(has_any(text, words), name).otherwise(out)
    return out


def lookup(key: Column, table: Sequence[tuple[str, str]], default: str) -> Column:
    out = F.lit(default)
    for k, v in reversed(table):
        out = F.when(key == k, v).otherwise(out)
    return out


def error_category(name: Column) -> Column:
    return first_rule(name, ERROR_CATEGORIES, "unknown")


def category_severity(category: Column) -> Column:
    return F.when(category.isin(*CATEGORY_SEVERITY[0][1]), "high").when(category.isin(*CATEGORY_SEVERITY[1][1]), "medium").otherwise("low")


def recovery_action(error_type: Column, message: Column) -> Column:
    return F.coalesce(F.nullif(first_rule(message, RECOVERY_WORDS, ""), F.lit("")), lookup(error_type, TYPE_RECOVERY, "retry"))
