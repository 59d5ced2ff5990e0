"""Queries of the question parser over all lines of documents, each asked in one of a list of forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.functions import questions as nl
from folioforge.plans.registry import dealt, dealt_sql, query

DDL = "id int, q string"
QUESTIONS = list(enumerate([
    "What does Feynman say about quantum mechanics in chapter 3",
    "find papers by Jane Doe about machine learning",
    "according to richard feynman light is both",
    "Knuth's book on sorting",
    "Dijkstra wrote about goto",
    'show me "The Art of Programming" section 2',
    "what's in 'Deep Work' and why",
    "the book titled Clean Code is where",
    "explain ideas in Structure Interpretation",
    "ch. 7 of the manual",
    "3rd chapter overview",
    "chapter 0 summary",
    "see 3.2 for details",
    "sec. 12 outline",
    "what happened today",
    "logs from yesterday",
    "errors last week in the catalog",
    "reports last month",
    "list all documents this week",
    "python function to sort",
    "c++ code for hashing",
    "go",
    "compare java versus javascript",
    "",
    "is it the",
    "neural network authentication algorithm data structure",
    "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda omicron",
    "information about error log debugging trace",
], 1))
V = dealt_sql(QUESTIONS, DDL, "q")


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_first(patterns) -> str:
    patterns = [p.replace(")*+", ")*") for p in patterns]  # DuckDB's engine neither has nor needs possessive groups
    return "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(q, {quoted(p)}) THEN trim(regexp_extract(q, {quoted(p)}, 1)) END" for p in patterns) + ")"


def sql_labels(labels) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(lower(q), {quoted(p)}) THEN '{k}' END" for k, p in labels) + ")"


def sql_words(stops) -> str:
    # whole words of a-z: \\b of DuckDB's patterns knows no letters beyond these
    return f"list_filter(regexp_extract_all(lower(q), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{3,}}') AND w NOT IN ({', '.join(quoted(s) for s in stops)}))"


def sql_any(words) -> str:
    return "(" + " OR ".join(f"contains(lower(q), {quoted(w)})" for w in words) + ")"


AUTHOR, TITLE = sql_first(nl.AUTHOR), sql_first(nl.TITLE)
CHAPTER, SECTION = (f"CAST({sql_first(p)} AS INTEGER)" for p in (nl.CHAPTER, nl.SECTION))
TOPIC = (
    f"CASE WHEN len({sql_words(nl.TOPIC_STOPS)}) > 0 THEN coalesce(CASE WHEN regexp_matches(q, {quoted(nl.TITLE[0])}) THEN trim(regexp_extract(q, {quoted(nl.TITLE[0])}, 1)) END, "
    f"CASE WHEN regexp_matches(lower(q), {quoted(nl.ABOUT)}) THEN trim(regexp_extract(lower(q), {quoted(nl.ABOUT)}, 1)) END, "
    + ", ".join(f"CASE WHEN contains(lower(q), '{w}') THEN '{w}' END" for w in nl.TECHNICAL)
    + f", array_to_string(({sql_words(nl.TOPIC_STOPS)})[1:2], ' ')) END"
)
KIND = "coalesce(" + ", ".join(f"CASE WHEN {sql_any(w)} THEN '{k}' END" for k, w in nl.TYPES) + ")"
SCORES = [(n, " + ".join(f"CAST(contains(lower(q), {quoted(w)}) AS INTEGER)" for w in ws)) for n, ws in nl.INTENTS]
BEST = "greatest(" + ", ".join(s for _, s in SCORES) + ")"
INTENT = f"CASE WHEN {BEST} = 0 THEN 'content_search' " + " ".join(f"WHEN {s} = {BEST} THEN '{n}'" for n, s in SCORES) + " END"
KEYWORDS = f"array_to_string(({sql_words(nl.KEYWORD_STOPS)})[1:10], ' ')"
PARSED = f"(SELECT id, q, {AUTHOR} AS author, {TITLE} AS title, {CHAPTER} AS chapter, {SECTION} AS section, {TOPIC} AS topic, {sql_labels(nl.TIMES)} AS time_range, {KIND} AS doc_type, {sql_labels(nl.LANGUAGES)} AS language, {INTENT} AS intent_type, {KEYWORDS} AS keywords FROM {V})"
CONFIDENCE = "least(1.0, 0.5 + 0.1 * (CAST(coalesce(author, '') <> '' AS INTEGER) + CAST(coalesce(title, '') <> '' AS INTEGER) + CAST(chapter IS NOT NULL AS INTEGER) + CAST(coalesce(topic, '') <> '' AS INTEGER)) + 0.05 * CAST(coalesce(doc_type, '') <> '' AS INTEGER))"
ENTITIES = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {e} IS NOT NULL AND {e} <> {0 if e in ('chapter', 'section') else repr('')} THEN '{e}' END" for e in nl.ENTITIES) + "], lambda x: x IS NOT NULL), ',')"


def parsed(t):
    return nl.parsed(dealt(t, QUESTIONS, DDL, "q").drop("form"))


for _name, _column in {"author": "author", "title": "title", "chapter": "chapter", "section": "section", "topic": "topic", "temporal": "time_range", "doc_type": "doc_type", "language": "language", "intent": "intent_type"}.items():

    @query(f"qp_{_name}", f"SELECT id, {_column} FROM {PARSED}")
    def _(t, column=_column):
        return parsed(t).select("id", column)


@query("qp_keywords", f"SELECT id, keywords FROM {PARSED}")
def _(t):
    return parsed(t).select("id", F.array_join("keywords", " ").alias("keywords"))


@query("qp_confidence", f"SELECT id, round({CONFIDENCE}, 6)::DOUBLE AS confidence FROM {PARSED}")
def _(t):
    return parsed(t).select("id", "confidence")


@query("qp_entities", f"SELECT id, {ENTITIES} AS entities FROM {PARSED}")
def _(t):
    return parsed(t).select("id", F.array_join("entities", ",").alias("entities"))


@query("qp_parse", f"SELECT *, round({CONFIDENCE}, 6)::DOUBLE AS confidence, {ENTITIES} AS entities FROM {PARSED}")
def _(t):
    return parsed(t).withColumn("keywords", F.array_join("keywords", " ")).withColumn("entities", F.array_join("entities", ","))


def _line(head: str, c: str, falsy: str = "''") -> str:
    return f"CASE WHEN {c} IS NOT NULL AND {c} <> {falsy} THEN '  {head}: ' || {c} END"


@query("qp_format", f"SELECT id, array_to_string(list_filter(['Query: ' || q, 'Intent: ' || intent_type, {_line('Author', 'author')}, {_line('Title', 'title')}, {_line('Chapter', 'chapter', '0')}, {_line('Section', 'section', '0')}, {_line('Topic', 'topic')}, {_line('Type', 'doc_type')}, {_line('Time', 'time_range')}, 'Confidence: ' || printf('%.2f', {CONFIDENCE}::DOUBLE)], lambda x: x IS NOT NULL), chr(10)) AS shown FROM {PARSED}")
def _(t):
    return parsed(t).select("id", nl.formatted().alias("shown"))
