"""String and byte functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes that byte-level models write as other characters (all but visible Latin-1), in order.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
_HIDDEN_CHARS = "".join(map(chr, _HIDDEN))
_STAND_INS = "".join(chr(256 + k) for k in range(len(_HIDDEN)))
#: Every character that stands for a byte, as a regular expression's class.
BYTE_CLASS = "[!-~\\u00A1-\\u00AC\\u00AE-\\u00FF\\u0100-\\u0143]"


def unicode_pattern(pattern: str) -> str:
    """The pattern with Unicode's classes of letters, digits and white space."""
    return "(?U)" + pattern


def find_all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(unicode_pattern(pattern)), F.lit(0))


def characters(c: Column) -> Column:
    """The code points of a string, each as a string."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ""))


def graphemes(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("\\X"), F.lit(0))


def join(parts: Column) -> Column:
    return F.array_join(parts, "")


def from_code_point(n: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32")


def replace_literal(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new)) if old else c


def byte_level(c: Column) -> Column:
    """Each byte of the UTF-8 form as one visible character."""
    return F.translate(F.decode(F.encode(c, "UTF-8"), "ISO-8859-1"), _HIDDEN_CHARS, _STAND_INS)


def is_byte_level(c: Column) -> Column:
    return c.rlike(f"^{BYTE_CLASS}*$")


def byte_level_bytes(c: Column) -> Column:
    """The bytes of a byte-level token."""
    # translate drops what is mapped to NUL, so its stand-in is replaced by itself
    return F.encode(F.translate(F.replace(c, F.lit(_STAND_INS[0]), F.lit("\x00")), _STAND_INS[1:], _HIDDEN_CHARS[1:]), "ISO-8859-1")


def utf8_or_empty(b: Column) -> Column:
    """The text of a byte string, empty if it is not UTF-8."""
    return F.coalesce(F.try_validate_utf8(b.cast("string")), F.lit(""))


def byte_pieces(c: Column) -> Column:
    """<0xHH> for each byte of the UTF-8 form."""
    return F.transform(F.regexp_extract_all(F.hex(F.encode(c, "UTF-8")), F.lit(".."), F.lit(0)), lambda h: F.concat(F.lit("<0x"), h, F.lit(">")))


def byte_character(b: int) -> str:
    """The character that stands for a byte."""
    return _STAND_INS[_HIDDEN.index(b)] if b in _HIDDEN else chr(b)


_BYTE_OF = {byte_character(b): b for b in range(256)}


def byte_token(token: str) -> bytes | str:
    """The bytes of a byte-level token; a token with another character stays as it is."""
    try:
        return bytes([_BYTE_OF[c] for c in token])
    except KeyError:
        return token
