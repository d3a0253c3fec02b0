"""API keys of a judge: a JSON object in a file, or the environment."""

from __future__ import annotations

import json
import os
from pathlib import Path


def keys_path(path: str | None = None) -> Path:
    return Path(path or os.environ.get("API_KEYS_FILE") or "api_keys.json").expanduser()


def load_keys(path: str | None = None) -> dict[str, str]:
    """No file: no keys. Anything but a JSON object is an error."""
    place = keys_path(path)
    if not place.exists():
        return {}
    try:
        found = json.loads(place.read_text())
    except json.JSONDecodeError as e:
        raise ValueError(f"{place} is not JSON: {e}") from e
    if not isinstance(found, dict):
        raise ValueError(f"{place} holds no JSON object")
    return {str(k): str(v) for k, v in found.items()}


def get_key(provider: str, *, path: str | None = None) -> str | None:
    return load_keys(path).get(provider)
