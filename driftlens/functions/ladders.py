"""Scoring ladders as SQL text over named columns: the same text is planned by Catalyst and by any other engine.

Numbers are written as doubles (0.8e0), since a bare 0.8 is a decimal in some engines.
"""

from __future__ import annotations

import re


def doubles(sql: str) -> str:
    return re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", sql)


#: Semantic score by topic overlap ``o``; then the additions, each capped at 1, in their order.
SEMANTIC_BASE = doubles(
    "CASE WHEN o >= 0.8 THEN (1.0 - o) * 0.2 WHEN o >= 0.5 THEN 0.3 + (0.8 - o) * 0.67 WHEN o >= 0.2 THEN 0.6 + (0.5 - o) * 0.67 ELSE 0.9 + (0.2 - o) * 0.5 END"
)
SEMANTIC_STEPS = [
    ("sem1", doubles("CASE WHEN mismatch THEN least(1.0, sem0 + 0.15) ELSE sem0 END")),
    ("sem2", doubles("CASE WHEN seq > 1 AND o < 0.3 THEN least(1.0, sem1 + 0.1) ELSE sem1 END")),
    ("semantic", doubles("greatest(0.0, least(1.0, CASE WHEN sem2 >= 0.85 AND risk = 'critical' THEN least(1.0, sem2 + 0.05) ELSE sem2 END))")),
]
OVERLAP = doubles("CASE WHEN n_typical = 0 THEN 0.5 WHEN n_topics = 0 THEN 0.0 ELSE 0.6 * n_both / n_either + 0.4 * n_both / n_typical END")
#: Parts of the linguistic score. The first divides by the spread of lexical diversity, as defined.
LINGUISTIC = {
    "l_length": doubles(
        "CASE WHEN p_lex_std = 0 THEN CASE WHEN abs(n_tokens - p_tokens) > 0.5 * p_tokens THEN 0.15 ELSE 0.0 END WHEN abs(n_tokens - p_tokens) / p_lex_std >= 3.0 THEN 0.15 ELSE 0.0 END"
    ),
    "l_lexical": doubles(
        "CASE WHEN abs(lex - p_lex) / lex_unit > 3.0 THEN 0.3 WHEN abs(lex - p_lex) / lex_unit > 2.0 THEN 0.2 WHEN abs(lex - p_lex) / lex_unit > 1.5 THEN 0.1 ELSE 0.0 END".replace(
            "lex_unit", "(CASE WHEN p_lex_std = 0 THEN 0.1 ELSE p_lex_std END)"
        )
    ),
    "l_formality": doubles("CASE WHEN abs(formality - p_formality) > 0.4 THEN 0.2 WHEN abs(formality - p_formality) > 0.3 THEN 0.15 WHEN abs(formality - p_formality) > 0.2 THEN 0.1 ELSE 0.0 END"),
    "l_polite": doubles("CASE WHEN polite - p_polite < -0.3 THEN 0.1 WHEN polite - p_polite > 0.3 THEN 0.15 ELSE 0.0 END"),
    "l_language": doubles("CASE WHEN known_language THEN 0.0 WHEN n_languages = 1 THEN 0.4 ELSE 0.2 END"),
    "l_technical": doubles("CASE WHEN technical AND NOT p_technical THEN 0.2 WHEN NOT technical AND p_technical THEN 0.05 ELSE 0.0 END"),
}
TEMPORAL = {
    "t_hour": doubles("CASE WHEN typical OR n_hours = 0 OR hour_known THEN 0.0 WHEN hour BETWEEN 3 AND 4 THEN 0.3 WHEN n_hours / 24.0 < 0.05 THEN 0.2 ELSE 0.1 END"),
    "t_velocity": doubles("CASE WHEN since_h < 0.5 THEN 0.6 WHEN since_h < 1.0 THEN 0.5 WHEN since_h < 2.0 THEN 0.4 ELSE 0.0 END"),
    "t_duration": doubles("CASE WHEN seq > p_per_session * 2 THEN CASE WHEN seq > p_per_session * 3 THEN 0.3 ELSE 0.1 END WHEN seq > 50 THEN 0.3 ELSE 0.0 END"),
    "t_bot": doubles("CASE WHEN gap < 2.0 THEN 0.3 WHEN gap < 5.0 THEN 0.25 WHEN p_gap > 0 AND abs(gap - p_gap) < 1.0 AND gap < 10.0 THEN 0.1 ELSE 0.0 END"),
    "t_frequency": doubles("CASE WHEN p_frequency = 0 THEN 0.0 WHEN since_h < 0.1 * (168.0 / p_frequency) THEN 0.3 WHEN since_h >= 4320 THEN 0.2 ELSE 0.0 END"),
}


def bounded_sum(parts: dict[str, str]) -> str:
    return doubles(f"greatest(0.0, least(1.0, {' + '.join(parts)}))")


HIGH_OVERRIDE = doubles(
    "CASE WHEN semantic > 0.85 AND risk = 'critical' THEN 'override_1' WHEN temporal > 0.9 THEN 'override_2' WHEN NOT p_sensitive AND risk = 'critical' THEN 'override_3' WHEN ato THEN 'override_4' END"
)
ENABLED_MEAN = doubles(
    "CASE WHEN use_semantic OR use_linguistic OR use_temporal THEN ((CASE WHEN use_semantic THEN semantic ELSE 0.0 END) + (CASE WHEN use_linguistic THEN linguistic ELSE 0.0 END) + (CASE WHEN use_temporal THEN temporal ELSE 0.0 END))"
    " / ((CASE WHEN use_semantic THEN 1 ELSE 0 END) + (CASE WHEN use_linguistic THEN 1 ELSE 0 END) + (CASE WHEN use_temporal THEN 1 ELSE 0 END)) ELSE 1.0 END"
)
NORMAL_OVERRIDE = doubles(f"(context_change OR (n_tokens < 50 AND formality < 0.4 AND question) OR {ENABLED_MEAN} < 0.15)")
WEIGHTED = doubles(
    "semantic * (CASE sensitivity WHEN 'low' THEN 0.5 WHEN 'maximum' THEN 0.35 ELSE 0.4 END) + linguistic * (CASE sensitivity WHEN 'low' THEN 0.3 WHEN 'high' THEN 0.3 ELSE 0.35 END)"
    " + temporal * (CASE sensitivity WHEN 'low' THEN 0.2 WHEN 'medium' THEN 0.25 ELSE 0.3 END)"
)
COMPOSITE = [
    ("high_override", f"CASE WHEN overrides THEN {HIGH_OVERRIDE} END"),
    ("weighted", WEIGHTED),
    ("mechanism", f"CASE WHEN high_override IS NOT NULL THEN high_override WHEN overrides AND {NORMAL_OVERRIDE} THEN 'normal_override' ELSE 'composite_score' END"),
    ("score", doubles("CASE WHEN high_override IS NOT NULL THEN 1.0 WHEN mechanism = 'normal_override' THEN least(0.15, weighted) ELSE greatest(0.0, least(1.0, weighted)) END")),
]
CONFIDENCE = doubles(
    "CASE WHEN n_history < 20 THEN 'low' WHEN n_history > 100 AND n_typical_all >= 3 AND p_lex_std < 0.2 AND p_formality_std < 0.2 AND n_hours >= 3 AND p_diversity BETWEEN 0.3 AND 0.8 AND p_tokens BETWEEN 10 AND 500 AND p_frequency >= 1 THEN 'high'"
    " WHEN n_history BETWEEN 20 AND 100 THEN 'medium' ELSE 'low' END"
)
RISK = [
    ("normal_below", doubles("CASE WHEN n_history < 20 THEN 0.35 WHEN confidence = 'low' THEN 0.25 + 0.1 WHEN confidence = 'high' THEN 0.25 - 0.05 ELSE 0.25 END")),
    ("suspicious_below", doubles("CASE WHEN n_history < 20 THEN 0.7 WHEN confidence = 'low' THEN 0.6 + 0.1 WHEN confidence = 'high' THEN 0.6 - 0.05 ELSE 0.6 END")),
    ("base_risk", "CASE WHEN score < normal_below THEN 'NORMAL' WHEN score < suspicious_below THEN 'SUSPICIOUS' ELSE 'HIGH_RISK' END"),
    (
        "risk_level",
        doubles("CASE WHEN risk = 'critical' AND base_risk = 'SUSPICIOUS' THEN 'HIGH_RISK' WHEN risk = 'critical' AND base_risk = 'NORMAL' AND score > 0.15 THEN 'SUSPICIOUS' WHEN risk = 'high' AND base_risk = 'SUSPICIOUS' AND score > 0.45 THEN 'HIGH_RISK' ELSE base_risk END"),
    ),
]
#: Learned variants.
MAHALANOBIS = doubles(
    "sqrt(power((n_tokens - p_tokens) / greatest(p_lex_std * p_tokens, 1.0), 2) + power((lex - p_lex) / greatest(p_lex_std, 0.01), 2) + power((formality - p_formality) / greatest(p_formality_std, 0.01), 2) + power((polite - p_polite) / greatest(p_polite_std, 0.01), 2))"
)
LINGUISTIC_ML = doubles("least(1.0, 1.0 / (1.0 + exp(-0.5 * (distance - 3.0))) + CASE WHEN known_language THEN 0.0 ELSE 0.3 END)")


def z_anomaly(z: str) -> str:
    return doubles(f"(1.0 / (1.0 + exp(-0.5 * ({z} - 2.0))))")


TEMPORAL_ML = [
    ("a_hour", doubles("CASE WHEN n_hours = 0 THEN 0.0 WHEN hour_p < 0.05 THEN CASE WHEN hour BETWEEN 3 AND 4 THEN 0.5 ELSE 0.3 END WHEN hour_p < 0.15 THEN 0.15 ELSE 0.0 END")),
    ("a_gap", doubles(f"CASE WHEN p_gap <= 0 THEN 0.0 ELSE {z_anomaly('abs(ln(greatest(gap, 0.1)) - ln(p_gap)) / 0.5')} END")),
    ("a_frequency", doubles(f"CASE WHEN p_frequency <= 0 THEN 0.0 ELSE 0.5 * {z_anomaly('abs(since_h - 168.0 / p_frequency) / (0.5 * (168.0 / p_frequency))')} END")),
    ("a_duration", doubles(f"CASE WHEN p_per_session <= 0 THEN 0.0 ELSE 0.3 * {z_anomaly('abs(seq - p_per_session) / (0.4 * p_per_session)')} END")),
    ("temporal_ml", doubles("greatest(0.0, least(1.0, 1.0 / (1.0 + exp(-(a_hour + a_gap + a_frequency + a_duration - 0.5)))))")),
]
SEMANTIC_ML = [
    ("sem_ml0", doubles("CASE WHEN risk = 'critical' THEN least(1.0, least(1.0, (1.0 - cosine) / 2.0) * 1.2) ELSE least(1.0, (1.0 - cosine) / 2.0) END")),
    ("semantic_ml", doubles("CASE WHEN seq > 1 AND sem_ml0 > 0.5 THEN least(1.0, sem_ml0 + 0.1) ELSE sem_ml0 END")),
]
