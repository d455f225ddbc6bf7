"""Typed access to a tokenizer.json: keys in camel or snake case, defaults for values of another type."""

from __future__ import annotations

import re
from typing import Any


def value(config: dict | None, key: str) -> Any:
    """The value under the key's camel-case spelling, which hides the snake-case one even if it is null."""
    if not isinstance(config, dict):
        return None
    camel = re.sub(r"_(.)", lambda m: m[1].upper(), key)
    return config[camel] if camel in config else config.get(key)


def _typed(kinds, reject=()):
    def get(config: dict | None, key: str, default=None):
        v = value(config, key)
        return v if isinstance(v, kinds) and not isinstance(v, reject) else default

    return get


text = _typed(str)
number = _typed((int, float), bool)
items = _typed(list)
section = _typed(dict)


def flag(config: dict | None, key: str, default: bool = False) -> bool:
    v = value(config, key)
    return bool(v) if isinstance(v, (bool, int, float)) else default
