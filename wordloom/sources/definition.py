"""Tokenizer definitions: tokenizer.json files, read on the driver into plan-time settings and small tables."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import errors
from ..errors import TokenizerError
from . import settings as s

#: Names that stand for a role, in order of precedence.
ROLES = {"pad": ("[PAD]", "<pad>"), "cls": ("[CLS]", "<s>"), "sep": ("[SEP]", "</s>"), "mask": ("[MASK]", "<mask>")}


@dataclass
class Definition:
    """All that a tokenizer.json says. ``vocab`` includes the added tokens."""

    kind: str
    vocab: dict[str, int]
    unk_token: str
    scores: list[float] = field(default_factory=list)
    pieces: list[str] = field(default_factory=list)
    unk_id: int = 0
    merges: list[tuple[str, str]] = field(default_factory=list)
    prefix: str = "##"
    max_chars: int = 100
    byte_fallback: bool = False
    fuse_unk: bool = False
    ignore_merges: bool = False
    model_unk: str | None = None
    model_vocab: dict[str, int] = field(default_factory=dict)
    added: list[dict] = field(default_factory=list)
    special: set[str] = field(default_factory=set)
    markers: list[str] = field(default_factory=list)
    normalizer: dict | None = None
    pre_tokenizer: dict | None = None
    post_processor: dict | None = None
    decoder: dict | None = None

    @classmethod
    def from_file(cls, path: str) -> "Definition":
        with open(path, "rb") as f:
            return cls.from_bytes(f.read())

    @classmethod
    def from_bytes(cls, data: bytes) -> "Definition":
        try:
            # a mark before the document goes, one inside a string stays; of equal keys the last one holds
            root = json.loads(data.decode("utf-8-sig"))
        except ValueError as e:
            raise TokenizerError(errors.INVALID_JSON, f"not JSON: {e}") from e
        if not isinstance(root, dict):
            raise TokenizerError(errors.INVALID_JSON, "the root is not an object")
        return cls.from_dict(root)

    @classmethod
    def from_dict(cls, root: dict) -> "Definition":
        model = s.section(root, "model")
        if model is None:
            raise TokenizerError(errors.MISSING_MODEL, "there is no model")
        kind = _kind(model)
        raw = model.get("vocab")
        if not isinstance(raw, list if kind == "Unigram" else dict) or not raw:
            raise TokenizerError(errors.MISSING_VOCAB, f"the {kind} model has no vocabulary")
        d = {"Unigram": _unigram, "BPE": _bpe, "WordPiece": _wordpiece}[kind](cls, model, raw)
        d.model_vocab = dict(d.vocab)
        _add_tokens(d, s.items(root, "added_tokens", []))
        for name in ("normalizer", "pre_tokenizer", "decoder", "post_processor"):
            config = s.section(root, name)
            _check_patterns(config, "preTokenizer" if name == "pre_tokenizer" else "postProcessor" if name == "post_processor" else name)
            setattr(d, name, config)
        return d

    def role(self, name: str) -> str | None:
        """The token of a role (pad, cls, sep, mask), if the vocabulary has one."""
        return next((t for t in ROLES[name] if t in self.vocab), None)

    def role_id(self, name: str) -> int:
        token = self.role(name)
        return -1 if token is None else self.vocab[token]

    @property
    def vocab_size(self) -> int:
        return len(self.vocab)

    @property
    def unk_token_id(self) -> int:
        return self.vocab.get(self.unk_token, -1)

    @property
    def tokens_by_id(self) -> dict[int, str]:
        """The token of each id; of several the smallest."""
        out: dict[int, str] = {}
        for t in sorted(self.vocab, reverse=True):
            out[self.vocab[t]] = t
        return out

    # tables for joins; their sizes are those of the vocabulary

    def vocab_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.vocab.items()), "token string, id int")

    def pieces_table(self, spark: SparkSession) -> DataFrame:
        """token, id, score of a unigram model; of equal pieces the last one holds."""
        import numpy as np

        last = {p: k for k, p in enumerate(self.pieces)}
        return spark.createDataFrame([(p, k, float(np.float32(self.scores[k]))) for p, k in sorted(last.items())], "token string, id int, score float")

    def merges_table(self, spark: SparkSession) -> DataFrame:
        rank = {pair: k for k, pair in enumerate(self.merges)}
        return spark.createDataFrame([(a, b, k) for (a, b), k in sorted(rank.items(), key=lambda x: x[1])], "left string, right string, rank int")


def _kind(model: dict) -> str:
    named, vocab, merges = s.text(model, "type"), model.get("vocab"), model.get("merges")
    if named in ("WordPiece", "Unigram", "BPE"):
        return named
    if named is None:
        for kind, fits in (("Unigram", isinstance(vocab, list)), ("BPE", isinstance(merges, list)), ("WordPiece", isinstance(vocab, dict))):
            if fits:
                return kind
    raise TokenizerError(errors.UNSUPPORTED_MODEL, f"model type {named!r} is not supported")


def _ids(raw: dict) -> dict[str, int]:
    return {k: int(v) for k, v in raw.items() if isinstance(v, (int, float)) and not isinstance(v, bool)}


def _unigram(cls, model: dict, raw: list) -> Definition:
    pieces, scores = [p for p, _ in raw], [float(v) for _, v in raw]
    unk = model.get("unk_id", model.get("unkId"))
    unk = int(unk) if isinstance(unk, (int, float)) and not isinstance(unk, bool) else 0
    name = pieces[unk] if 0 <= unk < len(pieces) else "<unk>"
    return cls("Unigram", {p: k for k, p in enumerate(pieces)}, name, scores=scores, pieces=pieces, unk_id=unk, byte_fallback=s.flag(model, "byte_fallback"))


def _bpe(cls, model: dict, raw: dict) -> Definition:
    unk = s.text(model, "unk_token")
    options = {k: s.flag(model, k) for k in ("byte_fallback", "fuse_unk", "ignore_merges")}
    return cls("BPE", _ids(raw), unk or "", merges=read_merges(model.get("merges")), model_unk=unk, **options)


def _wordpiece(cls, model: dict, raw: dict) -> Definition:
    most = s.number(model, "max_input_chars_per_word", 100)
    return cls("WordPiece", _ids(raw), s.text(model, "unk_token", "[UNK]"), prefix=s.text(model, "continuing_subword_prefix", "##"), max_chars=int(most))


def read_merges(raw) -> list[tuple[str, str]]:
    """Pairs, or strings cut at their first space; what is neither is left out and takes no rank."""
    out = []
    for m in raw if isinstance(raw, list) else ():
        if isinstance(m, str) and " " in m:
            a, _, b = m.partition(" ")
            out.append((a, b))
        elif isinstance(m, list) and len(m) == 2 and all(isinstance(x, str) for x in m):
            out.append((m[0], m[1]))
    return out


def _add_tokens(d: Definition, added: list) -> None:
    markers = []
    for t in added:
        content, number = (t.get("content"), t.get("id")) if isinstance(t, dict) else (None, None)
        if not isinstance(content, str) or not isinstance(number, (int, float)) or isinstance(number, bool):
            continue
        d.vocab[content] = int(number)
        d.added.append(t)
        if s.flag({"special": t.get("special")}, "special"):
            d.special.add(content)
        if not s.flag({"normalized": t.get("normalized")}, "normalized") and content:
            markers.append(content)
    # longest first, so that the longest of several markers at one place matches
    d.markers = sorted(dict.fromkeys(markers), key=lambda m: (-len(m.encode("utf-16-le")), m))


def _check_patterns(config, path: str) -> None:
    if isinstance(config, list):
        for k, v in enumerate(config):
            _check_patterns(v, f"{path}[{k}]")
    elif isinstance(config, dict):
        pattern = config.get("pattern")
        if isinstance(pattern, dict) and isinstance(pattern.get("Regex"), str):
            check_pattern(pattern["Regex"], path)
        for k, v in config.items():
            if isinstance(v, (dict, list)):
                _check_patterns(v, f"{path}.{k}" if isinstance(v, dict) else k)


def check_pattern(pattern: str, path: str) -> None:
    """Fails now, rather than in a task, if a pattern does not compile; asks Java where a session is up."""
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None and hasattr(spark, "_jvm"):
            spark._jvm.java.util.regex.Pattern.compile("(?U)" + pattern)
        else:
            regex.compile(pattern)
    except Exception as e:
        raise TokenizerError(errors.INVALID_REGEX, f"{path}: the pattern {pattern!r} does not compile: {str(e)[:200]}") from e


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        d = Definition.from_file(self.options["path"])
        special, added = d.special, {t["content"] for t in d.added}
        last = {p: k for k, p in enumerate(d.pieces)}
        for token, number in sorted(d.vocab.items()):
            yield token, number, float(d.scores[last[token]]) if token in last else None, token in added, token in special
        del partition


class TokenizerJson(DataSource):
    """``spark.read.format("tokenizer_json").load(path)``: the vocabulary with added and special tokens marked."""

    @classmethod
    def name(cls):
        return "tokenizer_json"

    def schema(self):
        return "token string, id int, score double, added boolean, special boolean"

    def reader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TokenizerJson)
