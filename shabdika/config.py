"""Settings as a nested dict with dotted access, typed overrides and a stable hash."""

from __future__ import annotations

import hashlib
import json
from typing import Any


def coerce(text: str) -> Any:
    """The value a text states: true, false, null, a number, JSON, else the text."""
    try:
        return json.loads({"none": "null"}.get(text.lower(), text.lower() if text.lower() in ("true", "false", "null") else text))
    except ValueError:
        return text


class Config:
    def __init__(self, data: dict | None = None) -> None:
        self.data = json.loads(json.dumps(data or {}))

    def get(self, path: str, default: Any = None) -> Any:
        at: Any = self.data
        for p in path.split("."):
            if not isinstance(at, dict) or p not in at:
                return default
            at = at[p]
        return at

    def require(self, path: str) -> Any:
        v = self.get(path, self)
        if v is self:
            raise KeyError(path)
        return v

    def set(self, path: str, value: Any) -> "Config":
        *up, last = path.split(".")
        at = self.data
        for p in up:
            at = at.setdefault(p, {})
        at[last] = value
        return self

    def override(self, *pairs: str) -> "Config":
        """Apply "a.b=value" texts."""
        for p in pairs:
            k, _, v = p.partition("=")
            self.set(k, coerce(v))
        return self

    def hash(self) -> str:
        return hashlib.sha256(json.dumps(self.data, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:12]
