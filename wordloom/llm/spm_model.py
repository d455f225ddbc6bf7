"""Reader of SentencePiece model files: the protobuf wire format, without generated classes."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

#: Where the public vocabularies are; callers may pass another path.
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"

NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE, WORD, CHAR = 1, 2, 3, 4


@dataclass
class SpmModel:
    """The parts of a model that encoding and decoding need."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    unk_id: int = 0
    byte_fallback: bool = False
    treat_whitespace_as_suffix: bool = False
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True


def _fields(data: bytes):
    """(field number, value) of a message; values are ints, floats (fixed32) or bytes."""
    at, end = 0, len(data)

    def varint(at):
        n = shift = 0
        while True:
            b = data[at]
            n |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return n, at

    while at < end:
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        elif kind == 5:
            value, at = struct.unpack("<f", data[at : at + 4])[0], at + 4
        else:
            raise ValueError(f"wire type {kind} is not part of a SentencePiece model")
        yield tag >> 3, value


def parse(data: bytes) -> SpmModel:
    m = SpmModel()
    for n, value in _fields(data):
        if n == 1:
            piece, score, kind = "", 0.0, NORMAL
            for k, v in _fields(value):
                if k == 1:
                    piece = v.decode()
                elif k == 2:
                    score = v
                elif k == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif n == 2:
            for k, v in _fields(value):
                if k == 3:
                    m.model_type = v
                elif k == 24:
                    m.treat_whitespace_as_suffix = bool(v)
                elif k == 35:
                    m.byte_fallback = bool(v)
                elif k == 40:
                    m.unk_id = v
        elif n == 3:
            for k, v in _fields(value):
                if k == 2:
                    m.charsmap = v
                elif k == 3:
                    m.add_dummy_prefix = bool(v)
                elif k == 4:
                    m.remove_extra_whitespaces = bool(v)
                elif k == 5:
                    m.escape_whitespaces = bool(v)
    return m


def load(path: str = DEFAULT_MODEL) -> SpmModel:
    with open(path, "rb") as f:
        return parse(f.read())
