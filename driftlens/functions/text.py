"""Lexical features of messages as column expressions. Null text counts as empty."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftlens.functions import lexicons as X


def words(text: Column) -> Column:
    """Words between white space of any kind."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def contains_any(text: Column, phrases: list[str]) -> Column:
    """Whether any phrase occurs, as a substring. A search for each phrase of a constant array: quicker than one pattern of all, and as small a plan."""
    return F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(text, p))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def matches(text: Column, pattern: str, dot_all: bool = True) -> Column:
    """A regular expression anywhere, ignoring case, with word characters of all scripts."""
    return text.rlike(("(?isU)" if dot_all else "(?iU)") + pattern)


def count_matches(text: Column, patterns: list[str]) -> Column:
    out = F.lit(0)
    for p in patterns:
        out = out + matches(text, p).cast("int")
    return out


def lexical_diversity(ws: Column, fold: bool = True) -> Column:
    kept = F.transform(ws, F.lower) if fold else ws
    return F.size(F.array_distinct(kept)) / F.greatest(F.size(ws), F.lit(1))


def question_ratio(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[?]")) / (F.regexp_count(text, F.lit(r"[.]")) + 1)


def topics(text: Column) -> Column:
    """Distinct words of a text that may be topics: no common words, more than two characters."""
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " ")
    stop = F.array(*[F.lit(w) for w in X.STOPWORDS])
    return F.array_distinct(F.filter(F.split(plain, r"(?U)\s+"), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w)))


def topic_words(ws: Column) -> Column:
    """Words that a profile may take for topics: letters only, more than four, in lower case; repeated words stay."""
    return F.transform(F.filter(ws, lambda w: (F.length(w) > 4) & w.rlike(r"^\p{L}+$")), F.lower)


def operation_risk(text: Column) -> Column:
    """critical, high or low, inferred from the words of a request; empty text is low."""
    t = F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))
    critical, high = F.lit(False), F.lit(False)
    for p in X.CRITICAL_OPS:
        critical = critical | matches(t, p)
    for p in X.HIGH_OPS:
        high = high | matches(t, p)
    return F.when(t == "", "low").when(critical, "critical").when(high, "high").otherwise("low")


def valid_risk(risk: Column) -> Column:
    r = F.lower(F.trim(risk))
    return F.when(r.isin("low", "medium", "high", "critical"), r)


def sql_regex(pattern: str) -> str:
    """The pattern for an engine without Unicode word boundaries: neighbours are matched as characters."""
    w = r"[^\p{L}\p{N}_]"
    out = pattern.replace("(?i)", "").replace(r"\b.*\b", f"{w}(.*{w})?")
    if out.startswith(r"\b"):
        out = f"(^|{w})" + out[2:]
    if out.endswith(r"\b"):
        out = out[:-2] + f"($|{w})"
    return out.replace("'", "''")
