"""Small tokenizer definitions, made by rule, for the registered queries and the tests."""

from __future__ import annotations

import base64
import struct
from functools import lru_cache
from itertools import count

from ..functions.text import byte_character

ASCII = "".join(map(chr, range(33, 127)))
ACCENTED = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöüáúàôîûù"
#: Frequent letter groups of four European languages, in the order in which they merge.
GROUPS = (
    "th he in er an re on at en nd ti es or ea te st ar ou it ha sh is ed al to un de ch ie le ra co ment que eau aux tre ver"
    " sch ein ich und der die ing the and tion ent ble ion ado para ción gen lich keit ung oui est con"
).split()


#: What the compiled map of the queries replaces.
CHARACTER_MAP = {"é": "e", "ß": "ss", "ñ": "n", "①": "1", "▁": " ", "|": "/"}


def packed_map(entries: dict[bytes, str]) -> str:
    """A character map in its packed form: a double array over bytes, then the replacements."""
    blob, value = b"", {}
    for k, v in entries.items():
        value[k] = len(blob)
        blob += v.encode() + b"\x00"
    units = [0] * 4096
    used = {0}

    def place(prefix: bytes, at: int) -> None:
        below = sorted({k[len(prefix)] for k in entries if k.startswith(prefix) and len(k) > len(prefix)})
        need = below + ([0] if prefix in entries else [])
        # an offset whose children are all free
        base = next(b for b in count(1) if all((at ^ b ^ c) not in used and 0 < (at ^ b ^ c) < len(units) for c in need))
        spot = at ^ base
        units[at] |= base << 10 | (0x100 if prefix in entries else 0)
        used.update(spot ^ c for c in need)
        if prefix in entries:
            units[spot] = value[prefix] | 1 << 31
        for c in below:
            units[spot ^ c] = c
        for c in below:
            place(prefix + bytes([c]), spot ^ c)

    place(b"", 0)
    return base64.b64encode(struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + blob).decode()


@lru_cache(None)
def character_map() -> str:
    return packed_map({k.encode(): v for k, v in CHARACTER_MAP.items()})


@lru_cache(None)
def wordpiece() -> dict:
    tokens = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"]
    parts = [*ASCII, *"äöüßçéèêñóí", *GROUPS]
    tokens += list(dict.fromkeys([*parts, *("##" + p for p in parts)]))
    # no capital letters: the normalizer lowers them, and a few signs stay unknown
    vocab = [t for t in tokens if t not in ("|", "~", "^", "##|", "##~", "##^")]
    return {
        "model": {"type": "WordPiece", "vocab": {t: k for k, t in enumerate(vocab)}, "unk_token": "[UNK]"},
        "normalizer": {"type": "BertNormalizer", "strip_accents": False},
        "pre_tokenizer": {"type": "BertPreTokenizer"},
        "post_processor": {"type": "BertProcessing", "cls": ["[CLS]", 2], "sep": ["[SEP]", 3]},
        "decoder": {"type": "WordPiece", "prefix": "##", "cleanup": True},
        "added_tokens": [{"id": k, "content": t, "special": True} for k, t in enumerate(vocab[:5])],
    }


@lru_cache(None)
def unigram(byte_fallback: bool = False) -> dict:
    # scores are quarters, so sums are exact in single precision and ties are real
    pieces = [["<unk>", 0.0], ["▁", -2.5]]
    pieces += [[c, -6.0 - (k % 8) * 0.25] for k, c in enumerate([*ASCII[:60], *ASCII[61:], *"äöüßéèñó"])]
    pieces += [[g, -3.0 - len(g) * 0.5 - (k % 6) * 0.25] for k, g in enumerate(GROUPS)]
    pieces += [["▁" + g, -3.25 - len(g) * 0.25 - (k % 5) * 0.5] for k, g in enumerate(GROUPS[:30])]
    if byte_fallback:
        pieces += [[f"<0x{b:02X}>", -30.0] for b in range(256)]
    return {
        "model": {"type": "Unigram", "vocab": pieces, "unk_id": 0, "byte_fallback": byte_fallback},
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "Metaspace", "replacement": "▁", "prepend_scheme": "always"}]},
        "decoder": {"type": "Metaspace", "replacement": "▁", "prepend_scheme": "always"},
    }


@lru_cache(None)
def bpe(byte_fallback: bool = False, ignore_merges: bool = False) -> dict:
    letters = [*ASCII[:60], *ASCII[61:], *"äöüßéèñó"]
    merges: dict[tuple[str, str], None] = {}
    for g in GROUPS:
        for k in range(1, len(g)):
            merges[g[:k], g[k]] = None
    for a, b in (("th", "er"), ("er", "e"), ("in", "ti"), ("on", "on"), ("an", "an"), ("re", "st"), ("ed", "th")):
        merges[a, b] = None
    tokens = ["<unk>", *letters, *dict.fromkeys(a + b for a, b in merges)]
    if byte_fallback:
        tokens += [f"<0x{b:02X}>" for b in range(256)]
    if ignore_merges:
        tokens += ["thereof", "nothing", "tionable"]
    model = {"type": "BPE", "vocab": {t: k for k, t in enumerate(dict.fromkeys(tokens))}, "merges": [[a, b] for a, b in merges], "unk_token": "<unk>", "fuse_unk": True, "byte_fallback": byte_fallback, "ignore_merges": ignore_merges}
    return {"model": model, "pre_tokenizer": {"type": "WhitespaceSplit"}, "decoder": {"type": "Sequence", "decoders": [{"type": "ByteFallback"}, {"type": "Fuse"}]}}


@lru_cache(None)
def byte_bpe() -> dict:
    tokens = [byte_character(b) for b in range(256)]
    merges = [[a, b] for a, b in (("t", "h"), ("Ġ", "t"), ("Ġt", "h"), ("h", "e"), ("i", "n"), ("e", "r"), ("Ġ", "a"), ("n", "d"), ("th", "e"), ("Ã", "©"))]
    tokens = list(dict.fromkeys([*tokens, *("".join(m) for m in merges)]))
    return {
        "model": {"type": "BPE", "vocab": {t: k for k, t in enumerate(tokens)}, "merges": merges},
        "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False},
        "post_processor": {"type": "ByteLevel"},
        "decoder": {"type": "ByteLevel"},
    }
