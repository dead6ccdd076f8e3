"""Word-level text functions as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STOP_WORDS = ("the", "is", "a", "an", "and", "or", "in", "on", "at", "to", "for", "of", "with", "my", "i", "me", "do", "you", "what", "where", "how")
DETERMINERS = ("a", "an", "the", "my", "our", "your", "his", "her", "their", "its", "this", "that", "these", "those", "every", "each", "some", "any")
EDGE_PUNCTUATION = ".,!?;:\"'()[]{}"
PAST_CUES = ("lived", "worked", "was", "used to", "previously", "formerly", "before", "earlier", "last year")
FUTURE_CUES = ("will", "going to", "tomorrow", "next", "future")
TRANSITION_CUES = ("moved to", "moved", "changed to", "transferred to", "transferred", "now live", "now work", "relocated to", "relocated")
NEGATION_CUES = ("anymore", "no longer", "longer")
HISTORICAL_QUERY_CUES = ("before", "previously", "past", "history", "used to", "formerly", "lived in", "was", "earlier", "did i")
FUTURE_QUERY_CUES = ("will", "going to", "future", "next year", "tomorrow", "plan to", "planning", "plan", "plans", "planned", "intend", "intending")
INTENTS = (
    ("profile", ("my name is", "i am", "i'm")),
    ("preference", ("like", "love", "prefer", "favorite", "enjoy")),
    ("habit", ("every", "daily", "usually", "always", "often")),
    ("event", ("visited", "went", "bought", "moved", "travelled", "traveled")),
)
QUERY_CATEGORIES = (
    ("preference", ("preference", "preferences", "prefer", "prefers", "like", "likes", "favorite", "favorites", "enjoy", "enjoys", "love", "loves")),
    ("profile", ("where", "live", "lives", "work", "works", "name", "age", "profile", "born", "residence", "home")),
    ("event", ("happened", "recently", "event", "events", "visited", "yesterday", "last", "went")),
    ("habit", ("habit", "habits", "daily", "usually", "every", "always", "routine", "routines")),
)
CATEGORY_WORDS = {
    "profile": ("name", "who", "age", "live", "location"),
    "preference": ("like", "love", "prefer", "favorite", "enjoy"),
    "habit": ("daily", "every", "routine", "habit", "usually"),
    "event": ("today", "yesterday", "tomorrow", "last", "next"),
}
TEMPORAL_WORDS = ("today", "yesterday", "tomorrow", "last", "next")
TEMPORAL_EXPRESSIONS = (
    ("daily", ("every day", "daily")),
    ("weekly", ("every monday", "every tuesday", "every wednesday", "every thursday", "every friday", "every saturday", "every sunday")),
    ("relative", ("today", "yesterday", "tomorrow", "last week", "next week", "next month")),
    ("time_of_day", ("morning", "afternoon", "evening", "night")),
)
WORD = r"[a-z0-9]+(?:'[a-z]+)?"


def cue_pattern(cues: tuple[str, ...]) -> str:
    """One whole-word, case-blind pattern of all cues, longer ones first."""
    return r"(?i)\b(?:" + "|".join(re.escape(c).replace("\\ ", " ") for c in sorted(cues, key=len, reverse=True)) + r")\b"


def has_cue(text: Column, cues: tuple[str, ...]) -> Column:
    """Whether a cue stands in ``text`` as whole words; false for null."""
    return F.coalesce(text.rlike(cue_pattern(cues)), F.lit(False))


def fold(token: Column) -> Column:
    """Plural and possessive endings folded away."""
    t = F.when(token.endswith("'s"), F.regexp_replace(token, "'s$", "")).otherwise(token)
    ies = (F.length(t) > 4) & t.endswith("ies")
    s = (F.length(t) > 3) & t.endswith("s") & ~t.endswith("ss")
    return F.when(ies, F.regexp_replace(t, "ies$", "y")).when(s, F.regexp_replace(t, "s$", "")).otherwise(t)


def tokens(text: Column) -> Column:
    """Folded words of lower-cased text; empty for null."""
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)), fold)


def query_terms(query: Column) -> Column:
    """Words of more than one letter without stop words; all of them if nothing else is left."""
    words = F.filter(tokens(query), lambda t: F.length(t) > 1)
    content = F.filter(words, lambda t: ~t.isin(*STOP_WORDS))
    return F.when(F.size(content) > 0, content).otherwise(words)


def lexical_score(content_tokens: Column, query_tokens: Column, terms: Column) -> Column:
    """1 if the query's words stand in a row, else the part of its terms present; one of several is weak.

    The arrays come from :func:`tokens` and :func:`query_terms`; repeated terms count each time.
    """
    sep = F.lit("\u0001")
    joined = lambda a: F.concat(sep, F.array_join(a, "\u0001"), sep)
    row = F.instr(joined(content_tokens), joined(query_tokens)) > 0
    matched = F.size(F.filter(terms, lambda t: F.array_contains(content_tokens, t)))
    ratio = matched / F.size(terms)
    weak = (F.size(terms) > 1) & (matched == 1)
    empty = (F.size(content_tokens) == 0) | (F.size(query_tokens) == 0)
    return F.when(empty, 0.0).when(row, 1.0).when(F.size(terms) == 0, 0.0).when(weak, ratio * 0.15).otherwise(ratio)


def temporal_intent(query: Column) -> Column:
    """HISTORICAL before FUTURE before CURRENT."""
    return F.when(has_cue(query, HISTORICAL_QUERY_CUES), "HISTORICAL").when(has_cue(query, FUTURE_QUERY_CUES), "FUTURE").otherwise("CURRENT")


def intent(text: Column) -> Column:
    """Kind of statement by substrings: profile, preference, habit, event, else fact."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit("fact")
    for name, keys in reversed(INTENTS):
        hit = F.lit(False)
        for k in keys:
            hit = hit | low.contains(k)
        out = F.when(hit, name).otherwise(out)
    return out


def query_category(query: Column) -> Column:
    """The category that a query asks for, or null."""
    out = F.lit(None).cast("string")
    for name, cues in reversed(QUERY_CATEGORIES):
        out = F.when(has_cue(query, cues), name).otherwise(out)
    return out


def category_match(query: Column, category: Column) -> Column:
    """0.15 if the query has a word of the category, singular or with s."""
    out = F.lit(0.0)
    for name, cues in CATEGORY_WORDS.items():
        out = F.when((category == name) & has_cue(query, (*cues, *(c + "s" for c in cues))), 0.15).otherwise(out)
    return out


def temporal_match(query: Column, content: Column) -> Column:
    """0.15 for each temporal word in both texts."""
    out = F.lit(0.0)
    for w in TEMPORAL_WORDS:
        out = out + F.when(has_cue(query, (w,)) & has_cue(content, (w,)), 0.15).otherwise(0.0)
    return out


def temporal_expressions(text: Column) -> Column:
    """array<struct<category, value>>: the expressions found, in the order of the list."""
    low = F.lower(F.coalesce(text, F.lit("")))
    every = [F.struct(F.lit(c).alias("category"), F.regexp_extract(low, rf"\b{w}\b", 0).alias("value")) for c, ws in TEMPORAL_EXPRESSIONS for w in ws]
    return F.filter(F.array(*every), lambda e: e["value"] != "")


def entity_name(text: Column) -> Column:
    """Entity key: lower case, single spaces, no edge punctuation, leading determiners or final 's."""
    edge = re.escape(EDGE_PUNCTUATION).replace("'", "'")
    words = F.split(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")), r"\s+")
    words = F.transform(words, lambda w: F.regexp_replace(w, f"^[{edge}]+|[{edge}]+$", ""))
    words = F.filter(words, lambda w: w != "")
    kept = F.aggregate(words, F.array().cast("array<string>"), lambda acc, w: F.when((F.size(acc) == 0) & w.isin(*DETERMINERS), acc).otherwise(F.concat(acc, F.array(w))))
    return F.regexp_replace(F.array_join(kept, " "), "'s$", "")


def token_set(text: Column) -> Column:
    """Distinct words between white space without edge punctuation and stop words (all if none is left)."""
    words = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: F.regexp_replace(w, "^[.,!?\"']+|[.,!?\"']+$", ""))
    long = F.filter(words, lambda w: F.length(w) > 1)
    content = F.filter(long, lambda w: ~w.isin(*STOP_WORDS))
    return F.array_distinct(F.when(F.size(content) > 0, content).otherwise(long))


def raw_token_set(text: Column) -> Column:
    """Distinct words between white space, punctuation kept."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def fact_key(text: Column) -> Column:
    """Lower case without outer white space of any kind."""
    return F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
