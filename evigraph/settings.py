"""Settings of the engine: a JSON document over defaults, checked values, and what an environment variable gives."""

from __future__ import annotations

import json
import math
import os
import tempfile
from pathlib import Path

from .operators.graph import LAYER_WEIGHTS

#: Edges a view keeps: per node, and per node of the whole (None: all).
PROFILES: dict[str, tuple[int | None, float | None]] = {"fast": (3, 4.0), "balanced": (6, 8.0), "full": (None, None)}

DEFAULTS = {
    "weights": dict(LAYER_WEIGHTS), "resolution": 1.0, "profile": "balanced",
    "property_threshold": 0.18, "method_threshold": 0.18, "top_k": 6,
    "match": {"least_title": 0.90, "least_overall": 0.89, "least_margin": 0.02, "bonus": 0.035, "query_max_chars": 350},
    "keywords": {"lexical_min": 0.12, "context_min": 0.72, "top_k": 7, "context_top_k": 4, "max_pairs": 220},
}


def load(path: str | Path | None) -> dict:
    """The defaults with the document's values over them, objects merged; a missing file gives the defaults."""

    def over(base: dict, new: dict) -> dict:
        return {k: over(base[k], new[k]) if isinstance(base.get(k), dict) and isinstance(new.get(k), dict) else new.get(k, base.get(k)) for k in {**base, **new}}

    if path is None or not Path(path).exists():
        return over(DEFAULTS, {})
    document = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(document, dict):
        raise ValueError("settings must be a JSON object")
    return over(DEFAULTS, document)


def _number(value, name: str, low: float, high: float) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        raise ValueError(f"{name} must be a number")
    try:
        x = float(value)
    except ValueError:
        raise ValueError(f"{name} must be a number") from None
    if not math.isfinite(x) or not low <= x <= high:
        raise ValueError(f"{name} must be from {low:g} to {high:g}")
    return round(x, 4)


def checked_network(weights: dict, resolution) -> dict:
    """Weights of all layers, from 0 to 5 and not all 0, and a resolution from .2 to 3; anything else is an error."""
    if not isinstance(weights, dict):
        raise ValueError("weights must be an object")
    if unknown := sorted(set(weights) - set(LAYER_WEIGHTS)):
        raise ValueError(f"unknown weight: {unknown[0]}")
    if missing := [k for k in LAYER_WEIGHTS if k not in weights]:
        raise ValueError(f"missing weight: {missing[0]}")
    own = {k: _number(weights[k], f"weight of {k}", 0.0, 5.0) for k in LAYER_WEIGHTS}
    if not any(own.values()):
        raise ValueError("one layer at least needs a weight above 0")
    return {"weights": own, "resolution": _number(resolution, "resolution", 0.2, 3.0)}


def network(settings: dict) -> dict:
    """The weights and the resolution to work with; values that are no finite numbers give way to the defaults."""

    def finite(x, default: float) -> float:
        return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) else default

    given = settings.get("weights") if isinstance(settings.get("weights"), dict) else {}
    return {"weights": {k: finite(given.get(k), v) for k, v in LAYER_WEIGHTS.items()}, "resolution": clamped(finite(settings.get("resolution"), 1.0), 0.2, 3.0)}


def clamped(x: float, low: float, high: float) -> float:
    return min(high, max(low, x))


def save_network(path: str | Path, weights: dict, resolution) -> dict:
    """Writes checked values into the settings document, whole or not at all."""
    path, own = Path(path), checked_network(weights, resolution)
    document = json.loads(path.read_text(encoding="utf-8")) if path.exists() else {}
    if not isinstance(document, dict):
        raise ValueError("settings must be a JSON object")
    document |= own
    handle, draft = tempfile.mkstemp(dir=path.parent, suffix=".tmp")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(json.dumps(document, ensure_ascii=False, indent=2) + "\n")
        os.replace(draft, path)
    finally:
        Path(draft).unlink(missing_ok=True)
    return own


def env_or(value, name: str, default=None):
    """The environment variable ``name`` if it is set and not blank, else the configured value, else the default."""
    given = os.environ.get(name, "").strip()
    return given or (value if value not in (None, "") else default)


def profile(name: str, nodes: int) -> tuple[int, int]:
    """(edges a node keeps, edges in all) of a view of ``nodes`` nodes."""
    k, factor = PROFILES[name]
    return (k if k is not None else 10**6, max(nodes - 1, math.ceil(factor * nodes)) if factor is not None else 10**9)
