"""Natural-language questions to structured filters, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns, words and labels that define the question grammar. Java's
# engine goes a call deeper with each turn of a repeated group, so that a line of thousands
# of words overflows the stack: groups repeat possessively (*+) where nothing after them
# could make them give words back, and the one where it could takes 200 words more at most.
AUTHOR = (r"(?i)(?:by|from|according to)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*+)", r"(?i)([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*+)'s\s+(?:book|paper|article|lecture)", r"(?i)([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,200})\s+(?:said|wrote|explains|discusses)")
TITLE = (r'"([^"]+)"', r"'([^']+)'", r"book\s+(?:titled|called|named)\s+([A-Z][^\s,\.]+(?:\s+[A-Z][^\s,\.]+)*+)", r"(?:in|from)\s+([A-Z][a-z]+\s+[A-Z][a-z]+)")
CHAPTER = (r"(?i)chapter\s+(\d+)", r"(?i)ch(?:ap)?\.?\s+(\d+)", r"(?i)(\d+)(?:st|nd|rd|th)\s+chapter")
# The dotted section's number stands in a group, as `first_of` reads group 1.
SECTION = (r"(?i)section\s+(\d+)", r"(?i)sec\.?\s+(\d+)", r"\d+\.(\d+)")
TIMES = (("today", r"\btoday\b"), ("yesterday", r"\byesterday\b"), ("last_week", r"\blast\s+week\b"), ("last_month", r"\blast\s+month\b"), ("this_week", r"\bthis\s+week\b"))
LANGUAGES = (("python", r"\b(?:python|\.py)\b"), ("javascript", r"\b(?:javascript|js|\.js)\b"), ("java", r"\b(?:java|\.java)\b"), ("cpp", r"\b(?:c\+\+|cpp|\.cpp)\b"), ("go", r"\b(?:golang|go|\.go)\b"))
TYPES = (("book", ("book", "chapter")), ("code", ("code", "implementation")), ("log", ("log", "error")), ("article", ("article", "paper")))
INTENTS = (
    ("content_search", ("what", "explain", "tell me", "describe", "how does", "why does", "information about", "details about")),
    ("navigation", ("find", "show", "locate", "where is", "get", "retrieve")),
    ("summary", ("summarize", "summary", "overview", "brief", "outline")),
    ("comparison", ("compare", "difference", "versus", "vs", "contrast", "similarity")),
    ("code_search", ("implementation", "function", "class", "method", "code for", "how to implement")),
    ("log_search", ("logs", "log file", "error log", "debugging", "trace")),
    ("listing", ("list", "show all", "all documents", "everything about")),
)
TOPIC_STOPS = ("what", "does", "say", "about", "the", "in", "chapter", "section", "find", "show", "me", "tell", "explain", "how", "why", "when", "where", "which", "who", "is", "are", "was", "were", "be", "been", "have", "has", "had", "do", "can", "could", "should", "would", "my", "documents", "document", "book", "article", "paper")
KEYWORD_STOPS = ("what", "does", "say", "about", "the", "and", "for", "are", "with", "from", "this", "that", "have", "find", "show")
TECHNICAL = ("quantum", "machine learning", "neural network", "data structure", "algorithm", "authentication")
ABOUT = r"\babout\s+([a-z\s]+?)(?:\s+in|\s+from|$)"


def first_of(q: Column, patterns) -> Column:
    """Group 1 of the first pattern, in order, that matches; trimmed."""
    return F.coalesce(*(F.when(F.rlike(q, F.lit(p)), F.trim(F.regexp_extract(q, p, 1))) for p in patterns))


def author(q: Column) -> Column:
    """The second and third pattern run only where what they end with stands at all: they try
    every word as a first name, which costs a long line's square."""
    low = F.lower(q)
    possible = (F.lit(True), F.contains(low, F.lit("'s")), F.rlike(low, F.lit("said|wrote|explains|discusses")))
    return F.coalesce(*(F.when(p, first_of(q, (x,))) for p, x in zip(possible, AUTHOR, strict=True)))


def title(q: Column) -> Column:
    return first_of(q, TITLE)


def chapter(q: Column) -> Column:
    """Null where the number is beyond an int: no chapter has it."""
    return first_of(q, CHAPTER).try_cast("int")


def section(q: Column) -> Column:
    return first_of(q, SECTION).try_cast("int")


def labelled(q: Column, labels) -> Column:
    low = F.lower(q)
    return F.coalesce(*(F.when(F.rlike(low, F.lit(p)), F.lit(k)) for k, p in labels))


def time_range(q: Column) -> Column:
    return labelled(q, TIMES)


def language(q: Column) -> Column:
    return labelled(q, LANGUAGES)


def doc_type(q: Column) -> Column:
    low = F.lower(q)
    return F.coalesce(*(F.when(reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words)), F.lit(k)) for k, words in TYPES))


def words_of(q: Column, stops: list[str]) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(q), F.lit(r"\b([a-z]{3,})\b"), 1), lambda w: ~w.isin(*stops))


def topic(q: Column) -> Column:
    low, words = F.lower(q), words_of(q, TOPIC_STOPS)
    quoted = F.when(F.rlike(q, F.lit(TITLE[0])), F.trim(F.regexp_extract(q, TITLE[0], 1)))
    about = F.when(F.rlike(low, F.lit(ABOUT)), F.trim(F.regexp_extract(low, ABOUT, 1)))
    technical = F.coalesce(*(F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in TECHNICAL))
    bigram = F.array_join(F.slice(words, 1, 2), " ")
    return F.when(F.size(words) > 0, F.coalesce(quoted, about, technical, bigram))


def keywords(q: Column) -> Column:
    return F.slice(words_of(q, KEYWORD_STOPS), 1, 10)


def intent(q: Column) -> Column:
    """The intent with most keywords in the question; the first declared of equals."""
    low = F.lower(q)
    scores = [F.struct(sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)).alias("s"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, words) in enumerate(INTENTS)]
    best = F.array_max(F.array(*scores))
    return F.when(best["s"] > 0, best["name"]).otherwise("content_search")


def confidence(author: Column, title: Column, chapter: Column, topic: Column, kind: Column) -> Column:
    found = lambda c: (c.isNotNull() & (c != "")).cast("int")
    total = F.lit(0.5) + 0.1 * (found(author) + found(title) + chapter.isNotNull().cast("int") + found(topic)) + 0.05 * found(kind)
    return F.least(total, F.lit(1.0))


ENTITIES = ("author", "title", "chapter", "section", "topic", "time_range", "doc_type", "language")


def parsed(df, q: str = "q"):
    """df with the whole parse of column q."""
    c = F.col(q)
    df = df.select("*", author(c).alias("author"), title(c).alias("title"), chapter(c).alias("chapter"), section(c).alias("section"), topic(c).alias("topic"), time_range(c).alias("time_range"), doc_type(c).alias("doc_type"), language(c).alias("language"), intent(c).alias("intent_type"), keywords(c).alias("keywords"))
    names = F.array(*(F.when(F.col(e).isNotNull() & (F.col(e) != (0 if e in ("chapter", "section") else "")), F.lit(e)) for e in ENTITIES))
    return df.select("*", F.round(confidence(*map(F.col, ("author", "title", "chapter", "topic", "doc_type"))), 6).alias("confidence"), F.filter(names, lambda x: x.isNotNull()).alias("entities"))


def formatted() -> Column:
    """The parse as text lines; needs parsed columns."""
    line = lambda head, c, falsy="": F.when(F.col(c).isNotNull() & (F.col(c) != falsy), F.concat(F.lit(f"  {head}: "), F.col(c).cast("string")))
    lines = [F.concat(F.lit("Query: "), F.col("q")), F.concat(F.lit("Intent: "), F.col("intent_type")), line("Author", "author"), line("Title", "title"), line("Chapter", "chapter", 0), line("Section", "section", 0), line("Topic", "topic"), line("Type", "doc_type"), line("Time", "time_range"), F.concat(F.lit("Confidence: "), F.format_number("confidence", 2))]
    return F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\n")
