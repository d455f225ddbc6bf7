"""SentencePiece encoding and decoding on the tokenizers library.

The model file is parsed (``spm_model``) and rebuilt as a ``tokenizers.Tokenizer``: its character map and
white-space rules as the normaliser, the marker of a word's start, unigram scores or the merges that the scores
of a BPE model imply, and byte fallback. Batches are encoded and decoded with the library's threads.

If no piece of a BPE model has a marker or a line feed after another character, merges never cross a word's start or
a line feed, so a text's ids are those of its words in a row. Then a batch is cut into words, each distinct word is
encoded once and remembered, and the ids are put together by array operations. Texts with blanks in a row, and
all texts of other models, are encoded whole.

Parity. SentencePiece breaks ties between equally scored merges from the left, the merge table by rank. So every
word that is remembered, and every text that is encoded whole, is compared with the reference library, and the
reference's ids are kept where the two differ. Words are also decoded again to tell which texts come back.

Edge cases: null texts have null ids and null counts; empty texts have none; texts of any length are encoded
whole; special pieces in a text are ordinary characters; other columns are left out; an empty table gives an
empty result.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spm_model
from .common import slices, small_batches, table

MARK = "▁"
#: Words or texts that are encoded in one call: an encoding is far larger than its ids.
SLICE = 2048
#: Threads of a worker; each keeps memory of its own.
THREADS = 2
#: Words that a worker remembers.
WORDS = 1_000_000
#: The same in the pipeline, whose executors hold the memory of earlier stages too.
STAGE_WORDS = 200_000


def build(m: spm_model.SpmModel, normalise: bool = True):
    """The model as a tokenizers.Tokenizer; without normalisation for texts that have their markers already."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if m.model_type == spm_model.UNIGRAM:
        lowest = min((s for _, s, k in m.pieces if k == spm_model.NORMAL), default=0.0)
        scores = [(p, 0.0 if k == spm_model.USER_DEFINED else s if k == spm_model.NORMAL else lowest - 10.0) for p, s, k in m.pieces]
        t = Tokenizer(models.Unigram(scores, unk_id=m.unk_id, byte_fallback=m.byte_fallback))
    elif m.model_type == spm_model.BPE:
        ids = {p: n for n, (p, _, _) in enumerate(m.pieces)}
        t = Tokenizer(models.BPE(ids, merges(m), unk_token=m.pieces[m.unk_id][0], fuse_unk=True, byte_fallback=m.byte_fallback))
    else:
        raise ValueError("only unigram and BPE models are supported")
    steps = []
    if m.charsmap:
        steps.append(normalizers.Precompiled(m.charsmap))
    if m.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK if m.escape_whitespaces else " "))
    if m.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    if steps and normalise:
        t.normalizer = normalizers.Sequence(steps)
    if cuttable(m):
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    added = [AddedToken(p, normalized=False) for p, _, k in m.pieces if k == spm_model.USER_DEFINED]
    if added:
        t.add_tokens(added)
    back = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    if m.add_dummy_prefix:
        back.append(decoders.Strip(" ", 1, 0))
    t.decoder = decoders.Sequence(back)
    t.encode_special_tokens = True
    return t


def _overlaps(piece: str, k: int) -> bool:
    """Whether piece[:k] + piece[k:] may meet piece[:j] + piece[j:] over a shared middle, j = len(piece) - k."""
    return 0 < k < len(piece) and piece[k:] == piece[: len(piece) - k]


def merges(m: spm_model.SpmModel) -> list[tuple[str, str]]:
    """Every way to put a piece together from two others, the best scored piece first.

    Two ways of one piece compete where they share their middle; there the one that may lie to the left
    comes first, as the reference merges from the left.
    """
    score = {p: s for p, s, k in m.pieces if k == spm_model.NORMAL}
    rank = {p: n for n, (p, _, _) in enumerate(m.pieces)}
    found = []
    for piece, s in score.items():
        for k in range(1, len(piece)):
            if piece[:k] in score and piece[k:] in score:
                left, right = _overlaps(piece, k), _overlaps(piece, len(piece) - k)
                found.append((-s, rank[piece], right - left, k, piece[:k], piece[k:]))
    return [(a, b) for *_, a, b in sorted(found)]


def cuttable(m: spm_model.SpmModel) -> bool:
    inner = re.compile(f"[^{MARK}]{MARK}")
    return m.model_type == spm_model.BPE and not any(inner.search(p) or "\n" in p[1:] for p, _, k in m.pieces if k == spm_model.NORMAL)


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, data: bytes, threads: int = THREADS, words: int | None = None):
        import sentencepiece

        #: Words that are remembered; WORDS if None.
        self.limit = words
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        m = self.model = spm_model.parse(data)
        self.exact = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.whole = build(m)
        bytes_known = sum(kind == spm_model.BYTE for _, _, kind in m.pieces) == 256
        plain_spaces = m.escape_whitespaces and m.add_dummy_prefix and not m.remove_extra_whitespaces and not m.charsmap
        self.by_word = cuttable(m) and m.byte_fallback and bytes_known and plain_spaces
        #: Words come with their marker.
        self.bare = build(m, normalise=False) if self.by_word else None
        #: The characters of each piece; None for bytes that are no character.
        self.chars = [self._characters(p, kind) for p, _, kind in m.pieces]
        self._forget()

    @staticmethod
    def _characters(piece: str, kind: int) -> str | None:
        if kind == spm_model.BYTE:
            return chr(int(piece[3:5], 16)) if int(piece[3:5], 16) < 128 else None
        return piece if kind in (spm_model.NORMAL, spm_model.USER_DEFINED) else None

    def _forget(self) -> None:
        """No word is known: the words, the ids of all in a row, where each one's start, which come back, and which the reference cuts alike."""
        self.words = pa.array([], pa.string())
        self.ids, self.starts, self.lossless = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, bool)
        self.alike = np.zeros(0, bool)

    def _learn(self, words: list[str]) -> None:
        sizes, flat, kept, alike = [], [], [], []
        piece = self.chars.__getitem__
        for at in range(0, len(words), SLICE):
            own = [w if w[:1] == "\n" else MARK + w for w in words[at : at + SLICE]]
            ours = [e.ids for e in self.bare.encode_batch_fast(own, add_special_tokens=False)]
            # the reference puts a marker before its text, which is cut off again where there is none
            theirs = self.exact.encode([w if w[0] == "\n" else w[1:] for w in own])
            for o, x, y in zip(own, ours, theirs, strict=True):
                # a lone marker cannot be asked for: the reference makes nothing of an empty text
                if o[0] == "\n":
                    y = y[1:]
                alike.append(x == y or o == MARK)
                if not alike[-1]:
                    x = y
                chars = list(map(piece, x))
                kept.append("".join(chars) == o if None not in chars else self.decode([x]) == [o.removeprefix(MARK)])
                sizes.append(len(x))
                flat += x
        self.words = pa.concat_arrays([self.words, pa.array(words, pa.string())])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes, dtype=np.int64)])
        self.ids = np.concatenate([self.ids, np.array(flat, np.int32)])
        self.lossless = np.concatenate([self.lossless, np.array(kept, bool)])
        self.alike = np.concatenate([self.alike, np.array(alike, bool)])

    def is_plain(self, text: str) -> bool:
        """Whether every marker of the text is a single space between its words."""
        return self.by_word and MARK not in text and "  " not in text and text[:1] not in (" ", "\n") and " \n" not in text

    def _by_word(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of ids of each text, all ids in a row, which texts come back, and which have only words cut alike."""
        cut = pc.split_pattern(pa.array([t.replace("\n", " \n") for t in texts], pa.string()), " ")
        edges = cut.offsets.to_numpy().astype(np.int64)
        coded = cut.flatten().dictionary_encode()
        distinct, word = coded.dictionary, coded.indices.to_numpy()
        place = pc.index_in(distinct, value_set=self.words)
        if place.null_count:
            if len(self.words) + place.null_count > (self.limit or WORDS):
                self._forget()
            else:
                distinct_new = distinct.filter(place.is_null())
                self._learn(distinct_new.to_pylist())
            if not len(self.words):
                self._learn(distinct.to_pylist())
            place = pc.index_in(distinct, value_set=self.words)
        row = place.to_numpy()[word]
        size = (self.starts[1:] - self.starts[:-1])[row]
        ends = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids[np.repeat(self.starts[row] - ends[:-1], size) + np.arange(ends[-1])]
        lost = np.concatenate(([0], np.cumsum(~self.lossless[row])))
        other = np.concatenate(([0], np.cumsum(~self.alike[row])))
        return ends[edges[1:]] - ends[edges[:-1]], ids, lost[edges[1:]] == lost[edges[:-1]], other[edges[1:]] == other[edges[:-1]]

    def encode_array(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of ids of each text, all ids in a row, which texts the ids decode to, and for which the rebuilt model's
        own ids were the reference's; elsewhere the reference's were taken."""
        plain = np.array([bool(t) and self.is_plain(t) for t in texts], dtype=bool)
        sizes, back, same = np.zeros(len(texts), np.int64), np.ones(len(texts), bool), np.ones(len(texts), bool)
        at = np.flatnonzero(plain)
        flat = np.zeros(0, np.int32)
        if len(at):
            sizes[at], flat, back[at], same[at] = self._by_word([texts[k] for k in at])
        others = {}
        rest = np.flatnonzero(~plain)
        for part in (rest[k : k + 64] for k in range(0, len(rest), 64)):
            own = [texts[k] for k in part]
            ours = [e.ids for e in self.whole.encode_batch_fast(own, add_special_tokens=False)]
            theirs = self.exact.encode(own)
            same[part] = [x == y for x, y in zip(ours, theirs, strict=True)]
            ours = theirs
            for k, x, t in zip(part, ours, self.decode(ours), strict=True):
                others[k], sizes[k], back[k] = x, len(x), t == texts[k]
        if not others:
            return sizes, flat, back, same
        starts = np.concatenate(([0], np.cumsum(sizes)))
        out = np.zeros(starts[-1], np.int32)
        here = np.cumsum(sizes[at]) - sizes[at]
        out[np.repeat(starts[at] - here, sizes[at]) + np.arange(len(flat))] = flat
        for k, x in others.items():
            out[starts[k] : starts[k] + len(x)] = x
        return sizes, out, back, same

    def encode(self, texts: list[str]) -> list[list[int]]:
        sizes, ids, *_ = self.encode_array(texts)
        return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] if texts else []

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.whole.decode_batch(ids, skip_special_tokens=False)


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model_path: str = spm_model.DEFAULT_MODEL, verify: bool = False, words: int | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, ids array<int>; with ``verify`` also round_trip (the decoded ids are the text)
    and parity (the rebuilt model gave the ids itself; otherwise they are SentencePiece's, which differed).

    The model's bytes (a vocabulary, whose size does not depend on the documents) go with the tasks. A worker remembers as many
    ``words``.
    """
    data = _read(model_path)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        codec = Codec(data, words=words)
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            held = [k for k, t in enumerate(texts) if t is not None]
            counts, flat, back, alike = codec.encode_array([texts[k] for k in held])
            sizes = np.zeros(len(texts) + 1, dtype=np.int64)
            sizes[np.array(held, dtype=np.int64) + 1] = counts
            absent = pa.array([t is None for t in texts], pa.bool_())
            ids = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(flat), mask=absent)
            same: list = [None] * len(texts)
            parity: list = [None] * len(texts)
            for k, ok, like in zip(held, back.tolist(), alike.tolist(), strict=True):
                same[k], parity[k] = ok, like
            cols, names = [b.column(0), ids], ["doc_id", "ids"]
            if verify:
                cols += [pa.array(same, pa.bool_()), pa.array(parity, pa.bool_())]
                names += ["round_trip", "parity"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"doc_id {kind}, ids array<int>" + ", round_trip boolean, parity boolean" * verify
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(rows: DataFrame, model_path: str = spm_model.DEFAULT_MODEL) -> DataFrame:
    """rows(doc_id, ids) -> doc_id, text."""
    data = _read(model_path)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        codec = Codec(data)
        for b in slices(batches):
            ids = b.column(1).to_pylist()
            held = [k for k, x in enumerate(ids) if x is not None]
            texts: list = [None] * len(ids)
            for k, t in zip(held, codec.decode([ids[k] for k in held]), strict=True):
                texts[k] = t
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def op8_spm(spark, sf_dir) -> DataFrame:
    e = encode(table(spark, sf_dir, "documents"), verify=True)
    return e.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip", "parity")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the ids of every document, whether they decode to its text, and parity."""
    small_batches(spark)
    e = encode(docs, verify=True, words=STAGE_WORDS)
    return e.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip", "parity")
