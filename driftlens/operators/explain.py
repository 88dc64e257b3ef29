"""What scores are put down to: reasoning and contributing factors of each part, the rationale, and the result as one record.

All are column expressions over the columns of ``operators.scoring``. Texts are fixed values: results carry them.

Defined results: a part without a finding has its reassuring sentence and no factors. Numbers in texts have two decimals (the cosine
distance three), halves rounded up. Sentences are split at every full stop, those inside numbers too, as results have it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: reasoning of the semantic part by topic overlap, and its factors
SEMANTIC_BANDS = [
    (0.8, "Message topics are fully consistent with user's typical conversation themes.", None),
    (0.5, "Message explores a related but new sub-topic within familiar domains.", "New sub-topic within familiar domains"),
    (0.2, "Message discusses topics in a completely different domain from user's typical interests.", "Completely different domain from typical topics"),
]
SEMANTIC_ELSE = ("Message shows extreme deviation from all historical conversation patterns.", "Extreme topic deviation from all historical patterns")
SEMANTIC_MORE = {
    "mismatch": "Technical expertise inconsistent with history", "midway": "Abrupt mid-session topic change", "critical": "Critical operation with extreme semantic deviation",
}
# fixed values: parts of the linguistic and temporal scores, their factor and their sentence
LINGUISTIC = [
    ("l_length", "Message length deviates significantly from typical", "Message length is unusually different from user's typical pattern"),
    ("l_lexical", "Lexical diversity shift detected", "Vocabulary usage pattern differs from baseline"),
    ("l_formality", "Formality level mismatch", "Writing formality differs from typical style"),
    ("l_polite", "Politeness pattern change detected", "Politeness level shows unexpected shift"),
    ("l_language", "Language switching detected", "Message uses different language than typical"),
    ("l_technical", "Technical vocabulary inconsistency", "Technical language usage inconsistent with history"),
]
TEMPORAL = [
    ("t_hour", "Activity during unusual hours", "Message sent during atypical hours for this user"),
    ("t_velocity", "Impossible velocity detected", "Session timing suggests impossible location change"),
    ("t_duration", "Session duration anomaly", "Session duration exceeds typical patterns"),
    ("t_bot", "Bot-like timing pattern detected", "Inter-message timing suggests automated behavior"),
    ("t_frequency", "Session frequency anomaly", "Session frequency deviates from typical pattern"),
]
CALM = {"linguistic": "Linguistic patterns are consistent with user's typical writing style.", "temporal": "Temporal patterns are consistent with user's typical activity."}
# fixed values: reasoning of the learned parts
SEMANTIC_ML = [
    (0.8, "Message embedding shows extreme deviation from user's semantic centroid in embedding space.", "Semantic representation highly dissimilar to user profile"),
    (0.6, "Message embedding shows significant deviation from typical semantic patterns.", "Moderate semantic drift detected"),
    (0.3, "Message shows mild semantic deviation from user's typical topics.", None),
]
SEMANTIC_ML_CALM, SEMANTIC_ML_MIDWAY = "Message embedding is consistent with user's semantic profile.", "Mid-session semantic shift detected"
LINGUISTIC_ML = ["Linguistic features show extreme deviation (Mahalanobis distance: %.2f)", "Moderate linguistic drift detected (Mahalanobis distance: %.2f)", "Linguistic patterns are consistent with user profile", "Unexpected language detected"]
TEMPORAL_ML = ["Extreme temporal anomalies detected across multiple dimensions.", "Moderate temporal deviations from learned patterns.", "Temporal patterns consistent with user's learned behavior."]
# fixed values: sentences of the rationale
OPERATION = {
    "critical": "Operation is critical (%s) and requires heightened scrutiny.", "high": "Operation is high-risk (%s) and warrants careful monitoring.",
    "medium": "Operation is medium-risk (%s) with standard security controls.", "low": "Operation is low-risk (%s) with minimal security concerns.",
}
SUMMARY = ["Evaluation indicates high anomaly levels across multiple dimensions. ", "Evaluation shows moderate anomalies requiring attention. ", "Evaluation shows minimal anomalies with normal behavioral patterns. "]
SENSITIVE = ["Given the sensitive nature of the operation, enhanced security measures are recommended.", "Standard security protocols are sufficient for this operation."]
VERSION = "1.0"


def _chosen(*items: tuple[Column, Column | str]) -> Column:
    """The texts whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(t) if isinstance(t, str) else t) for c, t in items]))


def _parts(parts: list[tuple[str, str, str]], calm: str) -> tuple[Column, Column]:
    """(reasoning, factors) of a score that is a sum of parts."""
    factors = _chosen(*[(F.col(c) > 0, F.format_string(f"{factor} (%.2f)", F.round(c, 2))) for c, factor, _ in parts])
    said = _chosen(*[(F.col(c) > 0, sentence) for c, _, sentence in parts])
    return F.when(F.size(said) > 0, F.concat(F.array_join(said, ". "), F.lit("."))).otherwise(calm), factors


def by_rules(rows: DataFrame) -> DataFrame:
    """``<part>_reasoning`` and ``<part>_factors`` of the three rule parts."""
    o = F.col("o")
    reasoning, band = F.lit(SEMANTIC_ELSE[0]), F.lit(SEMANTIC_ELSE[1])
    for edge, sentence, factor in reversed(SEMANTIC_BANDS):
        reasoning, band = F.when(o >= edge, sentence).otherwise(reasoning), F.when(o >= edge, F.lit(factor)).otherwise(band)
    more = [(F.col("mismatch"), SEMANTIC_MORE["mismatch"]), ((F.col("seq") > 1) & (o < 0.3), SEMANTIC_MORE["midway"]), ((F.col("sem2") >= 0.85) & (F.col("risk") == "critical"), SEMANTIC_MORE["critical"])]
    out = {"semantic_reasoning": reasoning, "semantic_factors": _chosen((band.isNotNull(), band), *more)}
    for part, parts in (("linguistic", LINGUISTIC), ("temporal", TEMPORAL)):
        out[f"{part}_reasoning"], out[f"{part}_factors"] = _parts(parts, CALM[part])
    return rows.withColumns(out)


def z_values() -> Column:
    """How far each feature of the style lies from the profile's mean, in its deviations, by name."""
    spread = [("message_length", "n_tokens", "p_tokens", F.greatest(F.col("p_lex_std") * F.col("p_tokens"), F.lit(1.0)))]
    spread += [(n, c, f"p_{c}", F.greatest(F.col(f"p_{c}_std"), F.lit(0.01))) for n, c in (("lexical_diversity", "lex"), ("formality", "formality"), ("politeness", "polite"))]
    return F.array(*[F.struct(F.lit(n).alias("name"), ((F.col(x) - F.col(m)) / s).alias("z")) for n, x, m, s in spread])


def learned(rows: DataFrame) -> DataFrame:
    """``<part>_reasoning`` and ``<part>_factors`` of the learned parts, and ``style``, the z-values."""
    base, first = F.col("sem_ml0"), F.format_string("Cosine distance: %.3f", F.round(1 - F.col("cosine"), 3))
    reasoning, second = F.lit(SEMANTIC_ML_CALM), F.lit(None).cast("string")
    for edge, sentence, factor in reversed(SEMANTIC_ML):
        reasoning, second = F.when(base > edge, sentence).otherwise(reasoning), F.when(base > edge, F.lit(factor)).otherwise(second)
    rows = rows.withColumn("style", z_values())
    far = F.slice(F.filter("style", lambda s: F.abs(s["z"]) > 2.0), 1, 3)
    named = F.transform(far, lambda s: F.format_string("%s: %.2f standard deviations from mean", s["name"], F.round(F.abs(s["z"]), 2)))
    switched = _chosen((~F.col("known_language"), F.format_string("Language switch detected: %s not in primary languages", "language")))
    drift = 1 / (1 + F.exp(-0.5 * (F.col("distance") - 3.0)))  # before the language counts
    style = F.when(drift > 0.7, F.format_string(LINGUISTIC_ML[0], F.round("distance", 2))).when(drift > 0.4, F.format_string(LINGUISTIC_ML[1], F.round("distance", 2))).otherwise(LINGUISTIC_ML[2])
    t = F.col("temporal_ml")
    return rows.withColumns(
        {
            "semantic_reasoning": reasoning,
            "semantic_factors": _chosen((base > 0.3, first), (second.isNotNull(), second), ((F.col("seq") > 1) & (base > 0.5), SEMANTIC_ML_MIDWAY)),
            "linguistic_reasoning": F.concat(style, F.when(F.col("known_language"), ".").otherwise(f". {LINGUISTIC_ML[3]}.")),
            "linguistic_factors": F.concat(named, switched),
            "temporal_reasoning": F.when(t > 0.7, TEMPORAL_ML[0]).when(t > 0.4, TEMPORAL_ML[1]).otherwise(TEMPORAL_ML[2]),
        }
    )


def first_sentences(text: Column, n: int = 2) -> Column:
    """The first ``n`` sentences of a text."""
    kept = F.array_join(F.slice(F.filter(F.transform(F.split(text, r"\."), lambda s: F.trim(s)), lambda s: s != ""), 1, n), ". ")
    return F.when(kept == "", kept).otherwise(F.concat(kept, F.lit(".")))


def primary_factors() -> Column:
    """The two largest parts above 0.3 and the first red flag; empty for a message without either."""
    parts = [("Semantic anomaly", "semantic", 0), ("Linguistic anomaly", "linguistic", 1), ("Temporal anomaly", "temporal", 2)]
    ranked = F.array_sort(F.array(*[F.struct((-F.col(c)).alias("s"), F.lit(i).alias("i"), F.lit(n).alias("n")) for n, c, i in parts]))
    top = F.filter(F.slice(ranked, 1, 2), lambda x: -x["s"] > 0.3)
    return F.slice(F.concat(F.transform(top, lambda x: F.format_string("%s (score: %.2f)", x["n"], F.round(-x["s"], 2))), F.slice("red_flags", 1, 1)), 1, 3)


def operation_sentence() -> Column:
    out = F.format_string(OPERATION["low"], "operation")
    for risk in ("medium", "high", "critical"):
        out = F.when(F.col("risk") == risk, F.format_string(OPERATION[risk], "operation")).otherwise(out)
    return out


def summary() -> Column:
    mean = (F.col("semantic") + F.col("linguistic") + F.col("temporal")) / 3.0
    level = F.when(mean > 0.7, SUMMARY[0]).when(mean > 0.4, SUMMARY[1]).otherwise(SUMMARY[2])
    flags, mild = F.size("red_flags"), F.size("mitigating")
    counted = F.when(flags > 0, F.format_string("Detected %d red flag(s) including suspicious indicators. ", flags)).when(mild > 0, F.format_string("Identified %d mitigating factor(s) suggesting legitimate use. ", mild)).otherwise("")
    return F.concat(level, counted, F.when(F.col("risk").isin("critical", "high"), SENSITIVE[0]).otherwise(SENSITIVE[1]))


def rationale(rows: DataFrame) -> DataFrame:
    """``primary_factors``, the reasoning of the parts cut to two sentences, ``operation_risk_assessment`` and ``overall_summary``."""
    cut = {f"{p}_said": first_sentences(F.col(f"{p}_reasoning")) for p in ("semantic", "linguistic", "temporal")}
    return rows.withColumns({"primary_factors": primary_factors(), **cut, "operation_risk_assessment": operation_sentence(), "overall_summary": summary()})


def confidence_factors(rows: DataFrame) -> DataFrame:
    """The three flags that the confidence is made of."""
    clear = (F.col("n_typical_all") >= 3) & (F.col("p_lex_std") < 0.2) & (F.col("p_formality_std") < 0.2) & (F.col("n_hours") >= 3)
    signal = F.col("p_diversity").between(0.3, 0.8) & F.col("p_tokens").between(10, 500) & (F.col("p_frequency") >= 1)
    return rows.withColumns({"sufficient_history": F.col("n_history") >= 20, "clear_patterns": clear, "high_signal_quality": signal})


def extreme_only(score: Column) -> Column:
    """What alone would be flagged of a user without history."""
    return score > 0.85


def result(rows: DataFrame, stamped: bool = False, model: str | None = None) -> DataFrame:
    """``(id, result)``: the record of each evaluation, scores at three places. ``stamped`` adds an id of its own and the time, which no two runs share.

    ``model`` names the encoder of a learned evaluation.
    """
    cold = F.col("n_history") < 20
    meta = [F.col("mechanism").alias("detection_mechanism"), F.when(F.col("mechanism") != "composite_score", F.col("mechanism")).alias("applied_override_reason"), F.when(cold, True).alias("cold_start")]
    if model is not None:
        meta += [F.lit(True).alias("ml_based"), F.lit(model).alias("embedding_model")]
    if stamped:
        meta.append(F.uuid().alias("evaluation_id"))
    parts = ("semantic", "linguistic", "temporal")
    told = F.struct("primary_factors", *[F.col(f"{p}_said").alias(f"{p}_reasoning") for p in parts], "operation_risk_assessment", "overall_summary")
    fields = [
        F.lit(VERSION).alias("analysis_version"), *([F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp")] if stamped else []), F.col("account").alias("user_id"),
        F.round("score", 3).alias("anomaly_score"), F.struct(*[F.round(p, 3).alias(p) for p in parts]).alias("component_scores"), "risk_level", "confidence", told.alias("rationale"),
        "red_flags", F.col("mitigating").alias("mitigating_factors"), F.struct(*meta).alias("metadata"),
    ]
    return rows.select("id", F.struct(*fields).alias("result"))


def as_json(results: DataFrame) -> DataFrame:
    """``(id, json)`` of results."""
    return results.select("id", F.to_json("result").alias("json"))
