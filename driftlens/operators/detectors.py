"""Detectors that look at a message alone, or at its author's rate: keyword rules and content hazards.

All are column expressions; the rate is counted by ``ordered.with_recent``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftlens.functions import lexicons as X
from driftlens.functions import text as T


def content_safety(text: Column, amplify: bool = True) -> dict[str, Column]:
    """``score`` (three places), ``is_anomaly``, ``categories`` (array) and ``category_scores`` (map) of a text.

    A category counts its weight times half, and a quarter more for each matching pattern, up to one. The
    largest counts, with a tenth more for each further category; high-risk operations add to it.
    """
    found = hazard_verdict(text, amplify)
    return {c: found[c] for c in ("score", "is_anomaly", "categories", "category_scores")}


def hazard_verdict(text: Column, amplify: bool = True) -> Column:
    """The same as one struct: to be made a column first where several of its fields are used."""
    counts = F.array(*[T.count_matches(text, patterns) for _, _, patterns in X.HAZARDS], T.count_matches(text, X.HIGH_RISK_OPS) if amplify else F.lit(0))
    return T.let(counts, _hazard)


def _hazard(counts: Column) -> Column:
    """The verdict on the numbers of matching patterns by category, and of high-risk operations last."""
    names = [n for n, *_ in X.HAZARDS]
    hits = [counts[i] for i in range(len(names))]
    scores = [F.when(n > 0, F.lit(weight) * F.least(F.lit(1.0), 0.5 + 0.25 * n)) for n, (_, weight, _) in zip(hits, X.HAZARDS, strict=True)]
    ops = counts[len(names)]
    best = F.coalesce(F.greatest(*scores), F.lit(0.0))
    k = sum(((n > 0).cast("int") for n in hits), F.lit(0))
    combined = F.when(k > 1, F.least(F.lit(1.0), best + 0.10 * (k - 1))).otherwise(best)
    final = F.when(ops > 0, F.least(F.lit(1.0), combined + 0.15 * ops)).otherwise(combined)
    alone = (ops > 0) & (hits[names.index("S2_account_abuse")] == 0)
    labels = [F.when(n > 0, F.lit(name)) for n, name in zip(hits, names, strict=True)] + [F.when(alone, F.lit("high_risk_operation"))]
    values = [*scores, F.when(alone, 0.15 * ops)]
    pairs = F.filter(F.array(*[F.struct(n.alias("key"), F.round(v, 3).alias("value")) for n, v in zip(labels, values, strict=True)]), lambda p: p["key"].isNotNull())
    return F.struct(final.alias("score"), (final > 0.50).alias("is_anomaly"), F.array_compact(F.array(*labels)).alias("categories"), F.map_from_entries(pairs).alias("category_scores"))


def rule_score(text: Column, recent: Column, threshold: int = 10, shortest: int = 10, longest: int = 500) -> dict[str, Column]:
    """``score`` and ``rules`` (array) of keywords, patterns, rate, length, capitals and punctuation."""
    found = rule_verdict(text, recent, threshold, shortest, longest)
    return {"score": found["score"], "rules": found["rules"]}


def rule_verdict(text: Column, recent: Column, threshold: int = 10, shortest: int = 10, longest: int = 500) -> Column:
    """The same as one struct."""
    return T.let(rule_signs(text), lambda s: rule_sum(s, recent, threshold, shortest, longest))


def rule_signs(text: Column) -> Column:
    """What the rules read off the text, as a struct of numbers and flags: all that has to move of a text."""
    words = F.array(*[F.lit(k) for k in X.RISK_KEYWORDS])
    n_words = T.let(F.lower(text), lambda low: F.size(F.filter(words, lambda k: F.contains(low, k))))
    hits = [text.rlike(("(?iU)" if p.startswith("(?i)") else "(?U)") + p.removeprefix("(?i)")) for p in X.RULE_PATTERNS]
    caps = (F.length(text) > 20) & text.rlike(r"\p{Lu}") & ~text.rlike(r"[\p{Ll}\p{Lt}]")
    return F.struct(n_words.alias("words"), F.length(text).alias("n"), F.regexp_count(text, F.lit(r"[!?.]")).alias("marks"), caps.alias("caps"), *[h.alias(f"p{i}") for i, h in enumerate(hits)])


def rule_sum(s: Column, recent: Column, threshold: int = 10, shortest: int = 10, longest: int = 500) -> Column:
    """The verdict on the signs of a text and the account's messages of the last minute."""
    parts = [(s["words"] > 0, F.least(s["words"] * 0.15, F.lit(0.4)), F.concat(F.lit("high_risk_keywords: "), s["words"].cast("string")))]
    parts += [(s[f"p{i}"], F.lit(0.25), F.lit("suspicious_pattern: " + p[:30])) for i, p in enumerate(X.RULE_PATTERNS)]
    parts += [
        (recent > threshold, F.lit(0.3), F.concat(F.lit("rate_limit_exceeded: "), recent.cast("string"), F.lit(" msg/min"))),
        (s["n"] < shortest, F.lit(0.1), F.concat(F.lit("message_too_short: "), s["n"].cast("string"), F.lit(" chars"))),
        (s["n"] > longest, F.lit(0.15), F.concat(F.lit("message_too_long: "), s["n"].cast("string"), F.lit(" chars"))),
        (s["caps"], F.lit(0.1), F.lit("all_caps_message")),
        (s["marks"] > 10, F.lit(0.1), F.concat(F.lit("excessive_punctuation: "), s["marks"].cast("string"))),
    ]
    total = sum((F.when(hit, v).otherwise(0.0) for hit, v, _ in parts), F.lit(0.0))
    return F.struct(F.least(total, F.lit(1.0)).alias("score"), F.array_compact(F.array(*[F.when(hit, name) for hit, _, name in parts])).alias("rules"))


# fixed values: texts of red flags and of mitigating factors, in their order
RED_FLAGS = [
    "Extreme semantic deviation from typical topics",
    "Critical operation requested without historical precedent",
    "Request involves suspicious external destinations",
    "Message contains prompt injection attempt",
    "Social engineering escalation pattern detected",
    "Bot-like timing pattern detected",
    "APT-style reconnaissance behavior detected",
    "Impossible velocity or location change detected",
    "Technical sophistication inconsistent with user history",
]
MITIGATING = [
    "User explicitly announced topic change",
    "Operation is low-risk information seeking",
    "User has established history of diverse topics",
    "User explicitly raised security concern",
    "Message is clarification or follow-up question",
    "Behavior consistent with user's exploration patterns",
]


def red_flags(c: dict[str, Column]) -> Column:
    """Ordered texts of suspicious indicators; the columns are named as in ``operators.scoring``."""
    hits = [
        c["semantic"] > 0.85,
        (c["risk"] == "critical") & ~c["p_sensitive"],
        c["says_destination"],
        c["says_injection"],
        (c["says_urgent"] & c["says_authority"]) | ((c["polite"] > 0.8) & c["risk"].isin("high", "critical")),
        c["temporal"] > 0.9,
        c["says_recon"] & (~c["typical"] | (c["n_history"] < 50)),
        c["since_h"] < 1.0,
        ~c["p_tech"] & (c["code"] | c["long_text"] | c["says_sophisticated"]),
    ]
    return F.array_compact(F.array(*[F.when(hit, F.lit(text)) for hit, text in zip(hits, RED_FLAGS, strict=True)]))


def mitigating(c: dict[str, Column]) -> Column:
    """Ordered texts of signs of legitimate use."""
    hits = [
        c["says_topic_change"],
        c["risk"] == "low",
        c["p_diversity"] > 0.6,
        c["says_security"],
        ((c["n_tokens"] < 30) & c["question"]) | c["says_clarify"],
        (c["p_diversity"] > 0.5) & (c["question"] | c["says_explore"]) & c["risk"].isin("low", "medium"),
    ]
    return F.array_compact(F.array(*[F.when(hit, F.lit(text)) for hit, text in zip(hits, MITIGATING, strict=True)]))
