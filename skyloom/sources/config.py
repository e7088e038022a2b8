"""Settings: nested mappings from JSON text or a dict, with environment variables laid over them."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from skyloom.operators.crossmatch import Catalog


def _value(text: str) -> Any:
    try:
        return json.loads(text)
    except ValueError:
        return text


def overlaid(config: dict, environ: Mapping[str, str], prefix: str) -> dict:
    """The settings with PREFIX__A__B=value as config["a"]["b"]."""
    out = json.loads(json.dumps(config))
    for name, text in sorted(environ.items()):
        head, *path = name.lower().split("__")
        if head == prefix.lower() and path:
            at = out
            for p in path[:-1]:
                at = at.setdefault(p, {})
            at[path[-1]] = _value(text)
    return out


def catalog_of(spec: Mapping[str, Any]) -> Catalog:
    """A catalogue's match settings; the three redshift settings come together or not at all."""
    if spec["radius"] <= 0:
        raise ValueError("a radius is positive")
    scaled = [spec.get(k) for k in ("distance_key", "distance_max", "distance_max_near")]
    if any(x is not None for x in scaled) and any(x is None for x in scaled):
        raise ValueError("distance_key, distance_max and distance_max_near go together")
    return Catalog(spec["catalog"], float(spec["radius"]), tuple(spec.get("projection", ())), *scaled, spec.get("max_results"))
