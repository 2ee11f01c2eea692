"""Rule-based classification of questions and texts, as columns.

Words are runs of letters, digits and underscores in lower case. Hints are matched as
whole words; those of several words, or with hyphens, as words in a row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hints by kind of retrieval.
SEMANTIC = ("semantic", "similar", "similarity", "meaning", "summarize", "summary", "overview", "about")
RELATIONAL = ("relationship", "related", "connected", "connection", "graph", "node", "edge", "path", "traverse", "link", "network")
HYBRID = ("multi hop", "across", "combine")

# Words that make a question hard.
COMPLEX = (
    "compare", "versus", "tradeoff", "trade off", "pros", "cons", "architecture", "design", "scalability", "performance",
    "optimize", "migration", "security", "compliance", "explain", "reason", "strategy", "plan", "step by step",
)

# Marker words by language, in the order that settles ties.
MARKERS = {
    "en": ("the", "is", "are", "was", "were", "have", "has", "and", "or", "but", "for"),
    "es": ("el", "la", "los", "las", "es", "son", "está", "están", "y", "de", "que"),
    "fr": ("le", "la", "les", "est", "sont", "et", "de", "que", "pour", "avec"),
    "de": ("der", "die", "das", "ist", "sind", "und", "oder", "für", "mit", "von"),
    "pt": ("o", "a", "os", "as", "é", "são", "está", "e", "de", "que", "para"),
    "it": ("il", "la", "lo", "gli", "le", "è", "sono", "e", "di", "che", "per"),
    "nl": ("de", "het", "een", "is", "zijn", "en", "van", "voor", "met", "dat"),
}

# Character ranges by language of a script.
SCRIPTS = {
    "zh": "一-鿿",
    "ja": "぀-ゟ゠-ヿ",
    "ko": "가-힯",
    "ar": "؀-ۿ",
    "he": "֐-׿",
    "ru": "Ѐ-ӿ",
    "el": "Ͱ-Ͽ",
    "th": "฀-๿",
    "hi": "ऀ-ॿ",
}

# Patterns of questions about a whole corpus, and about one thing.
GLOBAL = (
    r"\b(what|which)\s+(are|is)\s+the\s+(main|primary|key|overall|central)\b",
    r"\b(main|primary|key|central|major)\s+(themes?|topics?|concepts?|ideas?)\b",
    r"\bwhat\s+themes?\b",
    r"\b(summarize|summary|overview|synopsis)\b",
    r"\b(give|provide)\s+(me\s+)?(a\s+)?(general\s+)?(overview|summary)\b",
    r"\bgeneral\s+(understanding|overview|summary)\b",
    r"\b(all|every|each)\s+.{0,20}?(types?|kinds?|categories?)\b",
    r"\bhow\s+(many|much)\s+.{0,30}?(total|overall|in\s+general)\b",
    r"\b(trends?|patterns?|tendencies?)\s+(in|across)\b",
    r"\b(overall|in\s+general|as\s+a\s+whole)\b",
    r"\btell\s+me\s+about\s+.{0,30}?(in\s+general|overall|as\s+a\s+whole)\b",
    r"\bcompare\s+.{0,30}?(across|between|among)\b",
)
LOCAL = (
    r"\bwhat\s+is\s+(\w+)\b",
    r"\bwhat\s+(does|did)\s+(\w+)\b",
    r"\bwho\s+(is|was|are|were)\s+",
    r"\bwhere\s+(is|was|does|did|are|were)\b",
    r"\bwhen\s+(did|was|is|does|are|were)\b",
    r"\bhow\s+(do|does|did)\s+(\w+)\b",
    r"\b(specific|particular|exact|precise)\b",
    r"\b(this|that|the)\s+(\w+)\s+(function|class|method|file|module)\b",
    r"\b(find|locate|get)\s+.{0,20}?(named|called|about|for)\b",
    r"\bdefine\s+(\w+)\b",
    r"\bdefinition\s+of\s+",
    r"\bfunction\s+(named|called)\b",
    r"\b(what|how)\s+.{0,10}?function\b",
)

# Words that are no terms.
STOPWORDS = (
    "about", "after", "also", "and", "are", "between", "can", "could", "does", "for", "from", "how", "into", "like", "more", "show",
    "that", "the", "their", "then", "there", "these", "those", "through", "what", "when", "where", "which", "with", "who", "why",
)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def hits(text: Column, hints: tuple[str, ...]) -> Column:
    """How many of the hints a text holds."""
    padded = F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))
    return sum((F.contains(padded, F.lit(f" {h} ")).cast("int") for h in hints), F.lit(0))


def strategy(text: Column) -> Column:
    """graph, vector or hybrid by the hints a question holds; vector without any."""
    semantic, relational, hybrid = (hits(text, h) > 0 for h in (SEMANTIC, RELATIONAL, HYBRID))
    return F.when((semantic & relational) | (hybrid & (semantic | relational)), "hybrid").when(relational, "graph").otherwise("vector")


def complexity(text: Column) -> Column:
    """simple, medium or complex by length and hints."""
    n = F.size(tokens(text))
    points = F.when(n > 60, 2).when(n > 25, 1).otherwise(0) + F.least(F.lit(3), hits(text, COMPLEX))
    return F.when(points >= 5, "complex").when(points <= 2, "simple").otherwise("medium")


def route(text: Column) -> tuple[Column, Column]:
    """(global, local or hybrid; confidence) by the share of corpus-wide patterns among those that match."""
    wide, narrow = (sum((text.rlike(f"(?i){p}").cast("int") for p in group), F.lit(0)) for group in (GLOBAL, LOCAL))
    share = F.try_divide(wide, wide + narrow)
    kind = F.when(share >= 0.7, "global").when(share <= 0.3, "local").otherwise("hybrid")
    sure = F.when(share >= 0.7, share).when(share <= 0.3, 1 - share)
    confidence = F.when(share.isNull(), F.lit(0.3)).when(sure.isNull(), F.lit(0.6)).otherwise(F.least(F.lit(0.9), F.lit(0.6) + sure * F.lit(0.3)))
    return kind, confidence


def language(text: Column) -> tuple[Column, Column]:
    """(language, confidence): most markers of five, the first of equals; en at 0.3 without any."""
    words = F.array_distinct(tokens(text))
    scores = [(lang, F.size(F.array_intersect(words, F.array(*map(F.lit, chosen))))) for lang, chosen in MARKERS.items()]
    best = F.greatest(*(s for _, s in scores))
    chosen = F.lit("en")
    for lang, score in reversed(scores):
        chosen = F.when(score == best, lang).otherwise(chosen)
    return F.when(best == 0, "en").otherwise(chosen), F.when(best == 0, F.lit(0.3)).otherwise(F.least(F.lit(1.0), best / F.lit(5.0)))


def script(text: Column) -> tuple[Column, Column]:
    """(language of the dominant script, confidence); null and 0 unless it has over three tenths of the letters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    counts = [(k, F.length(F.regexp_replace(text, f"[^{c}]", ""))) for k, c in SCRIPTS.items()]
    best = F.greatest(*(n for _, n in counts))
    chosen = F.lit(None).cast("string")
    for lang, n in reversed(counts):
        chosen = F.when(n == best, lang).otherwise(chosen)
    share = F.coalesce(F.try_divide(best, letters), F.lit(0.0))
    return F.when(share > 0.3, chosen), F.when(share > 0.3, F.least(F.lit(1.0), share * F.lit(1.5))).otherwise(F.lit(0.0))


def length_grade(chars: Column, low: int = 50, high: int = 2000) -> Column:
    """0.5 and half of how far a length is from ``low`` to ``high``."""
    within = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (chars - low) / F.lit(float(high - low))))
    return F.lit(0.5) + F.lit(0.5) * within
