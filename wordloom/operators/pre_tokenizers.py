"""Pre-tokenizers: from a string Column to a Column of its words (array<string>)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import byte_level, find_all, replace_literal, unicode_pattern
from ..sources import settings as s
from .stage import Stage

#: Fixed value: Unicode punctuation and all ASCII symbols.
MARKS = "\\p{P}!-/:-@\\[-`{-~"
#: Fixed value: the pattern of byte-level models.
BYTE_LEVEL = "'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+"
#: Two noncharacters each, which no text holds, before and after a match.
CUT, END = "\ufdd0\ufdd1", "\ufdd3\ufdd4"


def bert(c: Column) -> Column:
    return find_all(c, f"[^\\s{MARKS}]+|[{MARKS}]")


def whitespace(c: Column) -> Column:
    return find_all(c, "\\S+")


def punctuation(c: Column) -> Column:
    return find_all(c, f"[^{MARKS}]+|[{MARKS}]+")


def digits(individual: bool = False):
    return lambda c: find_all(c, "[^\\d]+|\\d" if individual else "[^\\d]+|\\d+")


def metaspace(replacement: str = " ", written: str | None = None, scheme: str = "always", first: bool = True):
    """Spaces become ``written``; the text is cut before each ``replacement``."""
    written = replacement if written is None else written

    def run(c: Column) -> Column:
        c2 = replace_literal(c, " ", written)
        if scheme == "always" or (scheme == "first" and first):
            c2 = F.when(c2.startswith(replacement), c2).otherwise(F.concat(F.lit(written), c2))
        parts = F.split(replace_literal(c2, replacement, CUT + replacement), CUT)
        return F.when(c == "", F.array().cast("array<string>")).otherwise(_filled(parts))

    return run


def byte_level_words(add_prefix_space: bool = False, use_regex: bool = True):
    def spaced(c: Column) -> Column:
        return F.when(c.startswith(" "), c).otherwise(F.concat(F.lit(" "), c)) if add_prefix_space else c

    def run(c: Column) -> Column:
        if not use_regex:
            return F.array(byte_level(spaced(c)))
        return F.transform(find_all(c, BYTE_LEVEL), lambda w: byte_level(spaced(w)))

    return run


def _filled(parts: Column) -> Column:
    return F.filter(parts, lambda p: p != "")


def split_regex(pattern: str) -> Stage:
    """Matches and what lies between them; matches of nothing do not count. The pattern gets no group of its own, so its
    back-references keep their numbers."""

    def run(c: Column) -> Column:
        marked = F.regexp_replace(c, unicode_pattern(pattern), f"{CUT}$0{END}")
        return _filled(F.split(F.replace(marked, F.lit(CUT + END), F.lit("")), f"{CUT}|{END}"))

    return Stage(run)


def split_string(separator: str, invert: bool = False):
    """A literal separator and what lies between; ``invert`` drops the separators."""
    around = CUT if invert else CUT + separator + CUT

    def run(c: Column) -> Column:
        parts = _filled(F.split(replace_literal(c, separator, around), CUT))
        return F.when(c == "", F.array(c)).otherwise(parts)

    return run


def sequence(stages) -> Stage:
    stages = [Stage.of(x) for x in stages]

    def one(c: Column) -> Column:
        words = F.array(c)
        for stage in stages:
            words = F.flatten(stage.each(words))
        return words

    return Stage(one)


def build(config: dict | None, first: bool = True) -> Stage | None:
    """The stage of a configuration; None (the whole text is one word) for an unknown type."""
    found = _build(config, first)
    return None if found is None else Stage.of(found)


def _build(config: dict | None, first: bool):
    kind = s.text(config, "type")
    if kind == "Sequence":
        return sequence([x for x in (build(c, first) for c in s.items(config, "pretokenizers", [])) if x])
    if kind == "Metaspace":
        scheme = s.text(config, "prepend_scheme")
        if scheme is None:
            scheme = "always" if s.flag(config, "add_prefix_space", True) else "never"
        elif scheme not in ("first", "never"):
            scheme = "always"
        mark = s.text(config, "replacement", " ")
        return metaspace(mark, s.text(config, "str_rep", mark), scheme, first)
    if kind == "ByteLevel":
        return byte_level_words(s.flag(config, "add_prefix_space"), s.flag(config, "use_regex", True))
    if kind == "Split":
        pattern = s.section(config, "pattern") or {}
        if isinstance(pattern.get("Regex"), str) and pattern["Regex"]:
            return split_regex(pattern["Regex"])
        if isinstance(pattern.get("String"), str) and pattern["String"]:
            return split_string(pattern["String"], s.flag(config, "invert"))
        return F.array
    if kind == "Digits":
        return digits(s.flag(config, "individual_digits"))
    return {"BertPreTokenizer": bert, "Whitespace": whitespace, "WhitespaceSplit": whitespace, "Punctuation": punctuation, **REGISTERED}.get(kind)


#: Stages of callers, by type.
REGISTERED: dict[str, Callable[[Column], Column]] = {}
