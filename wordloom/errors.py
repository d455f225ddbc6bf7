"""Errors that are raised while a tokenizer is read and planned, before any job runs."""

from __future__ import annotations

INVALID_JSON = 100
MISSING_MODEL = 101
MISSING_VOCAB = 102
UNSUPPORTED_MODEL = 103
INVALID_REGEX = 104


class TokenizerError(ValueError):
    def __init__(self, code: int, message: str):
        super().__init__(f"[{code}] {message}")
        self.code = code
