"""Behavioural anomaly scoring of conversational messages, on Spark."""

from __future__ import annotations

import importlib

__version__ = "0.2.0"

#: What a user of the package needs by name, and where it is.
_WHERE = {
    "evaluate": "operators.scoring", "evaluate_learned": "operators.scoring", "explain": "operators.explain", "result": "operators.explain", "as_json": "operators.explain", "build": "operators.profiles",
    "quick_profiles": "operators.learners", "replay": "streaming.online", "live": "streaming.online", "ProfileStore": "sources.history", "read_history": "sources.history", "read_inputs": "sources.inputs",
    "read_profiles": "sources.inputs", "run": "operators.evaluation", "predictions": "operators.evaluation", "register": "functions.registry", "get_session": "session", "Model": "operators.forest",
}
#: Levels of risk and of confidence.
RISK_LEVELS = ("NORMAL", "SUSPICIOUS", "HIGH_RISK")
CONFIDENCE_LEVELS = ("low", "medium", "high")
#: Whether the learned evaluation can run: it needs no more than the rules do.
ML_AVAILABLE = True
__all__ = ["__version__", "RISK_LEVELS", "CONFIDENCE_LEVELS", "ML_AVAILABLE", *_WHERE]


def __getattr__(name: str) -> object:
    if name not in _WHERE:
        raise AttributeError(name)
    found = importlib.import_module(f"driftlens.{_WHERE[name]}")
    return found if name == "explain" else getattr(found, name)
