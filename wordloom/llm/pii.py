"""Format-preserving pseudonyms for personal data.

Values are found by pattern and validated (check digits, calendar, address and numbering rules); each is then
replaced by a value of the same format through a keyed Feistel permutation of that format's domain. A
permutation is a bijection, so equal values stay equal across documents, different values stay
different, and the key holder can invert it. What fails validation is left as it is.

    email   letters and digits of the local part, each within its class; the domain stays
    ipv4    the address within its own block (private blocks, loopback, or public)
    phone   the national digits under the rules of the numbering plan; punctuation and country code stay
    card    all digits but the check digit, which is computed anew (Luhn)
    iban    the account part, each character within its class; check digits are computed anew
    ssn     area, group and serial number
    date    the day within its century; a part of one digit stays one, and a time behind a T stays
    secret  hexadecimal, base 64 or other characters of a quoted value behind a name such as token or password

A value is brought to one form first (separators removed, one case), so the same number written in two ways
stays linked.

Edge cases: null texts stay null and empty texts empty; a value that occurs again is replaced each time by the
same value; texts are scanned whole; all other columns, whatever their names, pass through unchanged; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from datetime import date
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import slices, small_batches, table

#: Only for tests and the registered query; callers pass their own secret.
DEMO_KEY = b"wordloom demonstration key"
ROUNDS = 8
KINDS = ("email", "ipv4", "phone", "card", "iban", "ssn", "date", "secret")


def feistel(x: int, n: int, key: bytes, tweak: str, inverse: bool = False) -> int:
    """The keyed permutation of range(n) at x: a balanced Feistel network with cycle walking."""
    if n < 2:
        return x
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    size = (half + 7) // 8

    def f(r: int, v: int) -> int:
        h = hashlib.blake2b(v.to_bytes(size, "big"), key=key[:64], digest_size=min(64, size + 8), person=b"%d" % r, salt=_salt(tweak, n))
        return int.from_bytes(h.digest(), "big") & mask

    if size + 8 > 64:
        raise ValueError("the domain is too large for one block")
    while True:
        left, right = x >> half, x & mask
        for r in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
            if inverse:
                left, right = right ^ f(r, left), left
            else:
                left, right = right, left ^ f(r, right)
        x = left << half | right
        if x < n:
            return x


@lru_cache(4096)
def _salt(tweak: str, n: int) -> bytes:
    return hashlib.blake2b(f"{tweak}:{n}".encode(), digest_size=16).digest()


def _mixed(chars: str, key: bytes, tweak: str, inverse: bool, hexadecimal: bool = False) -> str:
    """Permutes a string within the classes of its characters; others stay. Long strings go in blocks."""
    if hexadecimal:
        sets = ["0123456789abcdef" if c in "0123456789abcdef" else None for c in chars]
    else:
        sets = ["0123456789" if c in "0123456789" else "abcdefghijklmnopqrstuvwxyz" if "a" <= c <= "z" else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if "A" <= c <= "Z" else None for c in chars]
    out = list(chars)
    at = [k for k, s in enumerate(sets) if s]
    for part in range(0, len(at), 48):
        n = x = 0
        n = 1
        block = at[part : part + 48]
        for k in block:
            x = x * len(sets[k]) + sets[k].index(chars[k])
            n *= len(sets[k])
        shape = "".join("x" if hexadecimal else sets[k][0] for k in block)
        x = feistel(x, n, key, f"{tweak}:{part}:{shape}", inverse)
        for k in reversed(block):
            x, d = divmod(x, len(sets[k]))
            out[k] = sets[k][d]
    return "".join(out)


def luhn_digit(payload: str) -> str:
    total = 0
    for k, c in enumerate(reversed(payload)):
        d = int(c)
        total += d if k % 2 else d * 2 - 9 * (d > 4)
    return str(-total % 10)


def _put_back(shape: str, chars: str) -> str:
    """Characters in the places of a value's letters and digits."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def _digits(value: str) -> str:
    return "".join(c for c in value if c.isdigit())


def email(value: str, key: bytes, inverse: bool = False) -> str | None:
    local, _, domain = value.rpartition("@")
    new = _mixed(local.lower(), key, f"email:{domain.lower()}", inverse)
    return "".join(n.upper() if o.isupper() else n for o, n in zip(local, new, strict=True)) + "@" + domain


#: First address, and size in bits, of the blocks that are permuted within themselves.
_BLOCKS = ((0x0A000000, 24), (0xAC100000, 20), (0xC0A80000, 16), (0x7F000000, 24), (0x00000000, 24), (0xA9FE0000, 16))


def ipv4(value: str, key: bytes, inverse: bool = False) -> str | None:
    parts = value.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = 0
    for p in parts:
        x = x << 8 | int(p)
    block = next(((a, b) for a, b in _BLOCKS if x >> b == a >> b), None)
    if block:
        x = block[0] + feistel(x - block[0], 1 << block[1], key, f"ipv4:{block[0]}", inverse)
    else:
        while True:
            x = feistel(x, 1 << 32, key, "ipv4", inverse)
            if not any(x >> b == a >> b for a, b in _BLOCKS):
                break
    return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))


def phone(value: str, key: bytes, inverse: bool = False) -> str | None:
    d = _digits(value)
    international = value.startswith("+")
    north = (len(d) == 11 and d[0] == "1") or (len(d) == 10 and not international)
    if north and not (d[0] == "0" and "(" in value):
        lead, d = d[:-10], d[-10:]
        valid = lambda s: s[0] in "23456789" and s[3] in "23456789"
        assigned = valid(d)
        # a country code or an area code in brackets marks a phone number, assigned or not
        if not assigned and not international and "(" not in value:
            return None
        x = int(d)
        while True:
            x = feistel(x, 10**10, key, "phone:1", inverse)
            new = f"{x:010d}"
            if valid(new) == assigned and (new[0] == "0") == (d[0] == "0"):
                break
        return _put_back(value, lead + f"{x:010d}")
    if not international and "(" in value and 8 <= len(d) <= 12 and d.strip("0"):
        # a national number: its area code may begin with a trunk zero, which stays
        rest = d.lstrip("0")
        lead, low = d[: len(d) - len(rest)], 10 ** (len(rest) - 1)
        return _put_back(value, lead + str(low + feistel(int(rest) - low, 9 * low, key, f"phone:0:{len(lead)}:{len(rest)}", inverse)))
    if not international or not 8 <= len(d) <= 15 or d[0] == "0":
        return None
    lead, rest = d[:2], d[2:]
    return _put_back(value, lead + f"{feistel(int(rest), 10 ** len(rest), key, f'phone:{lead}:{len(rest)}', inverse):0{len(rest)}d}")


def card(value: str, key: bytes, inverse: bool = False) -> str | None:
    d = _digits(value)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or not d.strip("0"):
        return None
    n = len(d) - 1
    p = f"{feistel(int(d[:-1]), 10**n, key, f'card:{n}', inverse):0{n}d}"
    return _put_back(value, p + luhn_digit(p))


def iban(value: str, key: bytes, inverse: bool = False) -> str | None:
    s = "".join(c for c in value if c.isalnum()).upper()
    number = lambda t: int("".join(str(int(c, 36)) for c in t))
    if not 15 <= len(s) <= 34 or number(s[4:] + s[:4]) % 97 != 1:
        return None
    body = _mixed(s[4:], key, f"iban:{s[:2]}", inverse)
    return _put_back(value, s[:2] + f"{98 - number(body + s[:2] + '00') % 97:02d}" + body)


#: Letters and digits of the numbers of each country.
_IBAN_SIZES = {
    c: n
    for n, codes in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
    }.items()
    for c in codes.split()
}


def ssn(value: str, key: bytes, inverse: bool = False) -> str | None:
    valid = lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"
    d = _digits(value)
    if not valid(d):
        return None
    x = int(d)
    while True:
        x = feistel(x, 10**9, key, "ssn", inverse)
        if valid(f"{x:09d}"):
            return _put_back(value, f"{x:09d}")


def day(value: str, key: bytes, inverse: bool = False) -> str | None:
    a, sep, b, _, c = re.split(r"([-/.])", value)
    if len(a) == 4:
        y, m, d, order = a, b, c, "ymd"
    elif int(b) > 12:
        y, m, d, order = c, a, b, "mdy"
    else:
        y, m, d, order = c, b, a, "dmy"
    try:
        when = date(int(y), int(m), int(d))
    except ValueError:
        return None
    fits = lambda n: (len(m) == 2 or n.month < 10) and (len(d) == 2 or n.day < 10)
    first = date(when.year // 100 * 100 or 1, 1, 1)
    days = (date(min(9999, when.year // 100 * 100 + 99), 12, 31) - first).days + 1
    x = (when - first).days
    while True:
        x = feistel(x, days, key, f"date:{first.year}", inverse)
        new = date.fromordinal(first.toordinal() + x)
        # a day above 12 tells the order of day and month, so it has to stay above (or not)
        # and a part written with one digit has to have one digit again, so the permuted days are those of its form
        if (order == "ymd" or (new.day > 12) == (when.day > 12)) and fits(new):
            break
    parts = {"y": f"{new.year:04d}", "m": f"{new.month:0{len(m)}d}", "d": f"{new.day:0{len(d)}d}"}
    return sep.join(parts[k] for k in order)


def secret(value: str, key: bytes, inverse: bool = False) -> str | None:
    if re.fullmatch(r"[0-9a-fA-F]+", value):
        new = _mixed(value.lower(), key, "secret:hex", inverse, True)
        return new.upper() if value.upper() == value else new
    return _mixed(value, key, "secret", inverse)


_WORKERS = {"email": email, "ipv4": ipv4, "phone": phone, "card": card, "iban": iban, "ssn": ssn, "date": day, "secret": secret}

_FOUND = re.compile(
    r"""
      (?P<secret_name>\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key)["']?\s*[:=]\s*["'])(?P<secret>[^\s"']{6,})(?=["'])
    | (?<![\w.%+-])(?P<email>[\w.%+-]{1,64}@(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,24})(?![a-z0-9-]*@)
    | (?<![0-9.])(?P<ipv4>[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})(?![0-9]|\.[0-9])
    | (?<![\w/.-])(?P<date>(?:[0-9]{4}(?P<ds>[-/.])[0-9]{1,2}(?P=ds)[0-9]{1,2})|(?:[0-9]{1,2}(?P<dt>[-/.])[0-9]{1,2}(?P=dt)[0-9]{4}))(?:(?=T[0-9]{2}(?::?[0-9]{2}|(?![\w])))|(?![\w/-]|\.[0-9]))
    | (?<![\w-])(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![\w-])
    | (?<![\w])(?P<iban>[a-z]{2}[0-9]{2}(?:\ ?[a-z0-9]{4}){2,7}(?:\ ?[a-z0-9]{1,3})?)(?!\w)
    | (?<![\w.+-])(?P<card>[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![\w-]|\.[0-9])
    | (?<![\w.])(?P<phone>(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![\w-]|\.[0-9])
    """,
    re.VERBOSE | re.IGNORECASE,
)
_MAYBE = re.compile(r"[0-9@]|secret|token|passw|pwd|key", re.IGNORECASE)


class Pseudonymizer:
    """Replaces the values in a text; remembers recent values, since the same ones come back."""

    def __init__(self, key: bytes = DEMO_KEY, inverse: bool = False):
        self.key, self.inverse, self.known = hashlib.blake2b(key).digest(), inverse, {}

    def value(self, kind: str, found: str) -> str | None:
        at = (kind, found)
        if at not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[at] = _WORKERS[kind](found, self.key, self.inverse)
        return self.known[at]

    def iban(self, text: str, start: int, end: int) -> tuple[str | None, int]:
        """The new value and its end: the pattern may have taken words that follow the number, so the part of its
        country's length comes first, then the whole match, then its parts up to a blank, the longest first."""
        ends = [end] + [k for k in range(end - 1, start, -1) if text[k] == " "]
        size = _IBAN_SIZES.get(text[start : start + 2].upper())
        ends.sort(key=lambda k: k - start - text.count(" ", start, k) != size)
        return next(((new, k) for k in ends if (new := self.value("iban", text[start:k])) is not None), (None, end))

    def text(self, text: str | None) -> tuple[str | None, list[tuple[int, int, str]]]:
        """The new text, and (start, end, kind) of each value in the old one."""
        if not text or not _MAYBE.search(text):
            return text, []
        out, spans, done, at = [], [], 0, 0
        while m := _FOUND.search(text, at):
            kind = next(k for k in KINDS if m[k] is not None)
            start, end = m.span(kind)
            if kind == "iban":
                new, end = self.iban(text, start, end)
            else:
                new = self.value(kind, m[kind])
            if new is None:
                # it fails validation as this kind; another kind may still begin within it
                at = start + 1
                continue
            out += [text[done:start], new]
            spans.append((start, end, kind))
            done = at = end
        return "".join([*out, text[done:]]), spans


def pseudonymize(docs: DataFrame, key: bytes = DEMO_KEY, inverse: bool = False, spans: str | None = None, column: str = "text") -> DataFrame:
    """docs with the column rewritten; with ``spans``, also a column of that name: array<start, end, kind>."""
    at = docs.columns.index(column)
    schema = StructType(list(docs.schema.fields))
    if spans:
        span = StructType().add("start", "integer").add("end", "integer").add("kind", "string")
        schema = schema.add(spans, ArrayType(span))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches):
        p = Pseudonymizer(key, inverse)
        for b in slices(batches):
            done = [p.text(t) for t in b.column(at).to_pylist()]
            cols = list(b.columns)
            cols[at] = pa.array([t for t, _ in done], pa.string())
            names = list(b.schema.names)
            if spans:
                cols.append(pa.array([[{"start": s, "end": e, "kind": k} for s, e, k in x] for _, x in done], kind))
                names.append(spans)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, schema)


def _is(kind: str):
    return lambda k: k == kind


def op3_pii(spark, sf_dir) -> DataFrame:
    """Every document with its pseudonymised text and the number of values of each kind."""
    d = pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), spans="spans")
    kinds = F.transform("spans", lambda s: s["kind"])
    found = [F.size(F.filter(kinds, _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return d.select("doc_id", "text", F.size("spans").cast("long").alias("n_values"), *found)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts with pseudonyms; n_chars follows, in case a replaced value has another length."""
    small_batches(spark)
    d = pseudonymize(docs)
    return d.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)
