"""Decoders: from a Column of tokens (array<string>) to a Column of text pieces (array<string>)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import byte_level_bytes, is_byte_level, replace_literal, unicode_pattern, utf8_or_empty
from ..sources import settings as s

Stage = Callable[[Column], Column]

#: Fixed value: what loses the space before it.
CLEANUP = "\\s(\\.|\\?|\\!|\\,|'\\s|n't|'m|'s|'ve|'re)"


def tidy(piece: Column) -> Column:
    return replace_literal(F.regexp_replace(piece, unicode_pattern(CLEANUP), "$1"), " do not", " don't")


def wordpiece(prefix: str = "##", cleanup: bool = False) -> Stage:
    def one(t: Column, k: Column) -> Column:
        # starts with a literal, so the cut is by its length
        rest = F.when(t.startswith(prefix), F.substr(t, F.lit(len(prefix) + 1))).otherwise(F.concat(F.lit(" "), t))
        piece = F.when(k == 0, t).otherwise(rest)
        return tidy(piece) if cleanup else piece

    return lambda tokens: F.transform(tokens, one)


def replace(config: dict) -> Stage:
    from .normalizers import replace as text_stage

    stage = text_stage(config)
    return lambda tokens: F.transform(tokens, stage)


def fuse(tokens: Column) -> Column:
    return F.array(F.array_join(tokens, ""))


def strip(content: str, start: int, stop: int) -> Stage:
    quoted = "".join(f"\\x{{{ord(c):X}}}" for c in content)

    def one(t: Column) -> Column:
        t = F.regexp_replace(t, f"^(?:{quoted}){{0,{max(0, start)}}}", "")
        return F.regexp_replace(t, f"(?:{quoted}){{0,{max(0, stop)}}}\\z", "")

    return (lambda tokens: F.transform(tokens, one)) if content else (lambda tokens: tokens)


def metaspace(replacement: str = "_", prefixed: bool = True) -> Stage:
    def one(t: Column, k: Column) -> Column:
        spaced = replace_literal(t, replacement, " ")
        return F.when(k == 0, replace_literal(t, replacement, "")).otherwise(spaced) if prefixed else spaced

    return lambda tokens: F.transform(tokens, one)


#: Noncharacters, which no text holds in a row: before the bytes of a token, before other tokens, and around these.
_BYTES, _OTHER, _CUT = "\ufdd2", "\ufdd5", "\ufdd0\ufdd1"


def _runs(tokens: Column, is_bytes: Callable[[Column], Column], to_hex: Callable[[Column], Column]) -> Column:
    """Neighbouring tokens of bytes become one text; others stay and end a run. Written in a row and cut again, so
    the work grows with the tokens and not with their square."""
    marked = F.transform(tokens, lambda t: F.when(is_bytes(t), F.concat(F.lit(_BYTES), to_hex(t))).otherwise(F.concat(F.lit(_CUT + _OTHER), t, F.lit(_CUT))))
    parts = F.filter(F.split(F.array_join(marked, ""), _CUT), lambda p: p != "")
    return F.transform(parts, lambda p: F.when(p.startswith(_BYTES), utf8_or_empty(F.unhex(F.replace(p, F.lit(_BYTES), F.lit(""))))).otherwise(F.substr(p, F.lit(2))))


def byte_level(tokens: Column) -> Column:
    return _runs(tokens, is_byte_level, lambda t: F.hex(byte_level_bytes(t)))


def byte_fallback(tokens: Column) -> Column:
    """<0xHH>; a second character that is no hexadecimal digit ends the number."""
    pattern = "^<0x([0-9A-Fa-f]).>\\z"

    def hexadecimal(t: Column) -> Column:
        return F.lpad(F.regexp_extract(t, "^<0x([0-9A-Fa-f]{1,2})", 1), 2, "0")

    return _runs(tokens, lambda t: t.rlike(pattern), hexadecimal)


def sequence(stages: list[Stage]) -> Stage:
    def run(tokens: Column) -> Column:
        for stage in stages:
            tokens = stage(tokens)
        return tokens

    return run


def build(config: dict | None) -> Stage | None:
    kind = s.text(config, "type")
    if kind == "WordPiece":
        prefix = s.text(config, "prefix")
        if prefix is None:
            raise ValueError("the WordPiece decoder has no prefix")
        return wordpiece(prefix, s.flag(config, "cleanup"))
    if kind == "Sequence":
        return sequence([x for x in map(build, s.items(config, "decoders", [])) if x])
    if kind == "Replace":
        return replace(config)
    if kind == "Strip":
        content = s.text(config, "content")
        if content is None:
            raise ValueError("the Strip decoder has no content")
        return strip(content, int(s.number(config, "start", 0)), int(s.number(config, "stop", 0)))
    if kind == "Metaspace":
        scheme = s.text(config, "prepend_scheme")
        return metaspace(s.text(config, "replacement", "_"), scheme != "never" if scheme is not None else s.flag(config, "add_prefix_space", True))
    return {"Fuse": fuse, "ByteLevel": byte_level, "ByteFallback": byte_fallback, **REGISTERED}.get(kind)


#: Stages of callers, by type.
REGISTERED: dict[str, Stage] = {}
