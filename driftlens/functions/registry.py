"""The scoring formulas as functions of SQL, so that ``spark.sql`` can use them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from driftlens.functions import ladders as L

_THREE = "semantic DOUBLE, linguistic DOUBLE, temporal DOUBLE"
#: name: (arguments, type, body)
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "topic_overlap": ("n_both INT, n_either INT, n_topics INT, n_typical INT", "DOUBLE", L.OVERLAP),
    "semantic_base": ("o DOUBLE", "DOUBLE", L.SEMANTIC_BASE),
    "weighted_score": (f"{_THREE}, sensitivity STRING", "DOUBLE", L.WEIGHTED),
    "high_override": ("semantic DOUBLE, temporal DOUBLE, risk STRING, p_sensitive BOOLEAN, ato BOOLEAN", "STRING", L.HIGH_OVERRIDE),
    "z_anomaly": ("z DOUBLE", "DOUBLE", L.z_anomaly("z")),
    "cosine_anomaly": ("cosine DOUBLE, risk STRING, seq INT", "DOUBLE", L.SEMANTIC_ML[1][1].replace("sem_ml0", f"({L.SEMANTIC_ML[0][1]})")),
    "style_anomaly": ("distance DOUBLE, known_language BOOLEAN", "DOUBLE", L.LINGUISTIC_ML),
}


def register(spark: SparkSession, prefix: str = "drift_") -> list[str]:
    """Makes the functions known to the session, under ``prefix`` and their names."""
    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({arguments}) RETURNS {kind} RETURN {body}")
    return [prefix + n for n in FUNCTIONS]
