"""Normalizers. ``build`` compiles a configuration into a function from a string Column to a string Column.

Where Spark has the function, the stage is an expression; Unicode normal forms and character maps have none and run
as Arrow UDFs, which rows of plain ASCII skip.
"""

from __future__ import annotations

import base64
import re
import struct as packing
import unicodedata
from collections.abc import Callable

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.text import replace_literal, unicode_pattern
from ..sources import settings as s
from .stage import Stage, chain, in_slices

#: The ideographs that get spaces around them.
CJK = "\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{20000}-\\x{2A6DF}\\x{2A700}-\\x{2B73F}\\x{2B740}-\\x{2B81F}\\x{2B820}-\\x{2CEAF}\\x{F900}-\\x{FAFF}\\x{2F800}-\\x{2FA1F}"
#: White space and line ends that Strip trims.
BLANK = "[\\p{Zs}\\t\\n-\\r\\x{85}\\x{2028}\\x{2029}]"
ASCII = "^[\\x00-\\x7F]*$"


def in_python(fn: Callable[[str], str], skip_ascii: bool = True) -> Stage:
    """A stage by Arrow UDFs; of rows of plain ASCII they get nulls only, if it leaves such texts as they are."""

    def texts_of(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else fn(t) for t in texts.to_pylist()], pa.string())

    def lists_of(rows: pa.Array) -> pa.Array:
        return pa.array([None if r is None else [None if t is None else fn(t) for t in r] for r in rows.to_pylist()], pa.list_(pa.string()))

    @F.arrow_udf(StringType())
    def run(texts: pa.Array) -> pa.Array:
        return in_slices(texts_of, texts)

    @F.arrow_udf(ArrayType(StringType()))
    def run_each(rows: pa.Array) -> pa.Array:
        return in_slices(lists_of, rows)

    if not skip_ascii:
        return Stage(run, run_each)
    return Stage(
        lambda c: F.coalesce(run(F.when(~c.rlike(ASCII), c)), c),
        lambda a: F.coalesce(run_each(F.when(~F.array_join(a, "").rlike(ASCII), a)), a),
    )


def _form(name: str) -> Stage:
    return in_python(lambda t: unicodedata.normalize(name, t))


nfd, nfc, nfkd, nfkc = map(_form, ("NFD", "NFC", "NFKD", "NFKC"))


def prepend(text: str):
    return lambda c: F.concat(F.lit(text), c)


def replace(config: dict):
    pattern, new = s.section(config, "pattern") or {}, s.text(config, "content")
    if new is None:
        return lambda c: c
    if isinstance(pattern.get("Regex"), str):
        return lambda c: F.regexp_replace(c, F.lit(unicode_pattern(pattern["Regex"])), F.lit(new))
    if isinstance(pattern.get("String"), str):
        return lambda c: replace_literal(c, pattern["String"], new)
    return lambda c: c


def strip(left: bool = True, right: bool = True):
    def run(c: Column) -> Column:
        c = F.regexp_replace(c, f"^{BLANK}+", "") if left else c
        return F.regexp_replace(c, f"{BLANK}+\\z", "") if right else c

    return run


def clean_text(c: Column) -> Column:
    """Drops control characters; tab and line ends become a space each."""
    c = F.regexp_replace(c, "[\\x00\\x{FFFD}\\p{Cc}\\p{Cf}&&[^\\t\\n\\r]]", "")
    return F.regexp_replace(c, "[\\t\\n\\r]", " ")


def space_ideographs(c: Column) -> Column:
    return F.regexp_replace(c, f"([{CJK}])", " $1 ")


strip_accents = chain([nfd, lambda c: F.regexp_replace(c, "\\p{Mn}", "")])


def bert(clean: bool = True, ideographs: bool = True, accents: bool | None = None, lower: bool = True) -> Stage:
    accents = lower if accents is None else accents
    steps = [fn for fn, on in ((clean_text, clean), (space_ideographs, ideographs), (strip_accents, accents), (F.lower, lower)) if on]
    return chain(steps)


class CharacterMap:
    """A compiled map from byte strings to replacements, unpacked from its double array."""

    def __init__(self, packed: bytes):
        (size,) = packing.unpack_from("<I", packed)
        self.units = packing.unpack_from(f"<{size // 4}I", packed, 4)
        self.blob = packed[4 + size // 4 * 4 :]

    @classmethod
    def read(cls, text: str | None) -> "CharacterMap | None":
        try:
            packed = base64.b64decode(text or "", validate=True)
            size = packing.unpack_from("<I", packed)[0] // 4
        except (ValueError, packing.error):
            return None
        return cls(packed) if size and 4 + 4 * size <= len(packed) else None

    def entries(self) -> dict[bytes, str]:
        """Every key that no other key begins, with its replacement: what a search for the shortest prefix finds."""
        out, todo = {}, [(b"", self._jump(0, self.units[0]))]
        while todo:
            key, at = todo.pop()
            for byte in range(1, 256):
                place = at ^ byte
                if place < len(self.units) and self.units[place] & 0x800000FF == byte:
                    unit = self.units[place]
                    below = self._jump(place, unit)
                    if unit & 0x100:
                        if below < len(self.units):
                            out[key + bytes([byte])] = self._text(self.units[below] & 0x7FFFFFFF)
                    else:
                        todo.append((key + bytes([byte]), below))
        return out

    @staticmethod
    def _jump(place: int, unit: int) -> int:
        wide = 8 if unit & 0x200 else 0
        return place ^ ((unit >> 10) << wide)

    def _text(self, at: int) -> str:
        end = self.blob.find(b"\x00", at)
        return self.blob[at : end if end >= 0 else len(self.blob)].decode("utf-8", "ignore")


#: Runs of text whose parts a worker remembers.
REMEMBERED = 50_000


def mapped(entries: dict[bytes, str]) -> Callable[[str], str]:
    """Replaces each grapheme under six bytes by its shortest known prefix, and else its characters one by one.

    Graphemes are looked for only where there may be more than a character: between two characters of ASCII one always
    ends, but for a line end of two. Runs with other characters are remembered.
    """
    longest = max(map(len, entries), default=0)

    def shortest(key: bytes) -> str | None:
        return next((entries[key[:k]] for k in range(1, min(len(key), longest) + 1) if key[:k] in entries), None)

    def slow(text: str) -> str:
        out = []
        for cluster in regex.findall(r"\X", text):
            key = cluster.encode("utf-8", "surrogatepass")
            whole = shortest(key) if len(key) < 6 else None
            if whole is not None:
                out.append(whole)
                continue
            for c in cluster:
                one = shortest(c.encode("utf-8", "surrogatepass"))
                out.append(c if one is None else one)
        return "".join(out)

    plain = "".join(c for c in map(chr, range(128)) if shortest(c.encode()) is not None)
    # a character of ASCII before, between and after others is looked at with them
    runs = r"[\x00-\x7f]?[^\x00-\x7f]+(?:[\x00-\x7f][^\x00-\x7f]+)*[\x00-\x7f]?"
    pattern = re.compile(runs + "".join(f"|{re.escape(c)}" for c in plain))
    known: dict[str, str] = {}

    def part(match: re.Match) -> str:
        found = match[0]
        new = known.get(found)
        if new is None:
            new = slow(found)
            if len(found) <= 64:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[found] = new
        return new

    def run(text: str) -> str:
        return slow(text) if "\r\n" in text else pattern.sub(part, text)

    return run


_TILDE = "\uff5e"


def _separators(c: Column) -> Column:
    c = F.regexp_replace(c, "[\\x01-\\x08\\x0B\\x0E-\\x1F\\x7F\\x{8F}\\x{9F}]", "")
    return F.regexp_replace(c, "[\\t\\n\\f\\r\\x{1680}\\x{200B}-\\x{200F}\\x{2028}\\x{2029}\\x{2581}\\x{FEFF}\\x{FFFD}]", " ")


#: What is done without a character map: controls go, separators become spaces, compatibility form but for the
#: full-width tilde.
unmapped = chain([_separators, in_python(lambda t: _TILDE.join(unicodedata.normalize("NFKC", p) for p in t.split(_TILDE)))])


def precompiled(config: dict) -> Stage:
    found = CharacterMap.read(s.text(config, "precompiled_charsmap"))
    if found is None:
        return unmapped
    return in_python(mapped(found.entries()), skip_ascii=False)


def build(config: dict | None) -> Stage | None:
    """The stage of a configuration; None (no change) for an unknown type."""
    found = _build(config)
    return None if found is None else Stage.of(found)


def _build(config: dict | None):
    kind = s.text(config, "type")
    if kind == "Sequence":
        return chain([x for x in map(build, s.items(config, "normalizers", [])) if x])
    if kind == "Prepend":
        return prepend(s.text(config, "prepend", ""))
    if kind == "Replace":
        return replace(config)
    if kind in ("Bert", "BertNormalizer"):
        lower = s.flag(config, "lowercase", True)
        return bert(s.flag(config, "clean_text", True), s.flag(config, "handle_chinese_chars", True), s.flag(config, "strip_accents", lower), lower)
    if kind == "Precompiled":
        return precompiled(config)
    if kind == "Strip":
        return strip(s.flag(config, "strip_left", True), s.flag(config, "strip_right", True))
    # StripAccents is a compatibility form here, not a removal of marks
    return {"Lowercase": F.lower, "NFD": nfd, "NFC": nfc, "NFKD": nfkd, "NFKC": nfkc, "StripAccents": nfkc, **REGISTERED}.get(kind)


#: Stages of callers, by type.
REGISTERED: dict[str, Callable[[Column], Column]] = {}
