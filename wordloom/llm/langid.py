"""Language identification by segmentation-marginalised unigrams.

Each language is a unigram distribution over the pieces of a fixed public vocabulary. The probability
of a word is the sum over all its segmentations into pieces, computed by the forward algorithm; a text's
score adds the logarithms over its words. The piece probabilities are fitted by expectation
maximisation (forward-backward) on word counts of a bounded sample of labelled documents:
all documents where a language has at most ``max_docs`` of them, else as many, chosen by a hash.

A word is a run of letters (with their marks), lower-cased, behind the marker of a word's start. A character that is no
piece falls back to its own unknown piece. A word is scored once for all its occurrences in a batch.

Edge cases: null texts and texts without a letter are ``und`` with score 0; without any labelled document
everything is ``und``; a null doc_id is not held out and not learned from; repeated rows get equal results;
long texts are used whole; a word of any length is scored whole, part by part in bounded memory, and learned from
in parts of ``LEARNED_PART`` letters; other columns are left out.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spm_model
from .common import slices, small_batches, table, written

#: Documents of a language that its model is fitted on.
MAX_DOCS = 2000
ITERATIONS = 3
#: Added to the expected count of each piece, so that none is impossible.
SMOOTHING = 0.05
#: Scored tokens of one generation that a worker keeps.
CACHE = 100_000
MARK = "▁"
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_EDGES = ".,;:!?()[]{}\"'#*$%&|<>-_=+0123456789"
#: Letters of a word that are scored at a time, and of a part by which a longer word is learned.
WORD_PART = 1024
LEARNED_PART = 256
#: Factor of the substrings' hash.
_BASE = np.uint64(0x9E3779B97F4A7C15)


class PieceVocabulary:
    """Pieces of letters by text, with one more id for all characters that are no piece."""

    def __init__(self, texts):
        kept = sorted({t for t in (x.lower() for x in texts) if t.removeprefix(MARK) and _LETTERS.fullmatch(t.removeprefix(MARK)) and MARK not in t[1:]})
        self.ids = {t: n for n, t in enumerate([*kept, MARK])}
        self.unknown = len(self.ids)
        self.size = self.unknown + 1
        self.longest = max(map(len, self.ids))
        #: Hash of every beginning of a piece, and the piece's id or -1: where a beginning is absent, no piece follows.
        beginnings = dict.fromkeys((t[:k] for t in self.ids for k in range(1, len(t))), -1) | self.ids
        hashes = {}
        for t, piece in beginnings.items():
            h = 0
            for c in t:
                h = (h * int(_BASE) + ord(c) + 1) % (1 << 64)
            hashes[h] = piece
        self.hashes = np.array(sorted(hashes), dtype=np.uint64)
        self.piece_at = np.array([hashes[h] for h in sorted(hashes)], dtype=np.int64)

    @classmethod
    def load(cls, path: str):
        return cls(p for p, _, kind in spm_model.load(path).pieces if kind == spm_model.NORMAL)

    def lattice(self, words: list[str]):
        """words of one length -> arrays (start, end, row, piece) by position; every single character has an arc.

        Substrings grow by one character at a time, all words at once; one that begins no piece stops.
        """
        n, count = len(words[0]), len(words)
        chars = np.array(words).view(np.uint32).reshape(count, n).T.astype(np.uint64).ravel()
        at = np.arange(n * count)
        h = np.zeros(n * count, dtype=np.uint64)
        arcs = {}
        for size in range(1, n + 1):
            fits = at < (n - size + 1) * count
            at = at[fits]
            h = h[fits] * _BASE + chars[at + (size - 1) * count] + np.uint64(1)
            slot = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            known = self.hashes[slot] == h
            piece = np.where(known, self.piece_at[slot], -1)
            if size == 1:
                piece[piece < 0] = self.unknown
            hit = piece >= 0
            place, found = at[hit], piece[hit]
            cut = np.searchsorted(place, np.arange(n - size + 2) * count)
            for start in range(n - size + 1):
                if cut[start] < cut[start + 1]:
                    part = slice(cut[start], cut[start + 1])
                    arcs[start, start + size] = (place[part] - start * count, found[part])
            at, h = at[known], h[known]
            if not len(at):
                break
        return [(start, end, *arcs[start, end]) for start, end in sorted(arcs)]


def forward(vocab: PieceVocabulary, probs: np.ndarray, words: list[str]) -> np.ndarray:
    """Log probability of each word (with its marker) in each language; probs[piece, language]."""
    out = np.empty((len(words), probs.shape[1]))
    where = {}
    for k, w in enumerate(words):
        where.setdefault(len(w), []).append(k)
    for n, rows_of in where.items():
        if n > 2 * WORD_PART:
            for k in rows_of:
                out[k] = forward_long(vocab, probs, words[k])
            continue
        for at in range(0, len(rows_of), 4096):
            part = rows_of[at : at + 4096]
            alpha = np.zeros((n + 1, len(part), probs.shape[1]))
            alpha[0] = 1.0
            scale = np.zeros((len(part), probs.shape[1]))
            done = 0
            # arcs come by start, so alpha[start] is complete when its arcs are used
            for start, end, rows, pieces in vocab.lattice([words[k] for k in part]):
                if start >= done + 24:  # keeps long words from underflowing
                    window = alpha[start : start + vocab.longest + 1]
                    top = np.maximum(window.max(axis=0), 1e-300)
                    window /= top
                    scale += np.log(top)
                    done = start
                alpha[end, rows] += alpha[start, rows] * probs[pieces]
            out[part] = np.log(np.maximum(alpha[n], 1e-300)) + scale
    return out


def forward_long(vocab: PieceVocabulary, probs: np.ndarray, word: str) -> np.ndarray:
    """The same for one word of any length, part by part: a part needs what is known at its start, as far as a piece reaches."""
    reach = vocab.longest
    carry, scale = np.zeros((reach + 1, probs.shape[1])), np.zeros(probs.shape[1])
    carry[0] = 1.0
    for at in range(0, len(word), WORD_PART):
        size = min(WORD_PART, len(word) - at)
        alpha = np.zeros((size + reach + 1, probs.shape[1]))
        alpha[: reach + 1] = carry
        done = 0
        for start, end, _, pieces in vocab.lattice([word[at : at + size + reach - 1]]):
            if start >= size:
                break
            if start >= done + 24:
                window = alpha[start : start + reach + 1]
                top = np.maximum(window.max(axis=0), 1e-300)
                window /= top
                scale += np.log(top)
                done = start
            alpha[end] += alpha[start] * probs[pieces[0]]
        carry = alpha[size : size + reach + 1]
        top = np.maximum(carry.max(axis=0), 1e-300)
        carry = carry / top
        scale += np.log(top)
    return np.log(np.maximum(carry[0], 1e-300)) + scale


def expected_counts(vocab: PieceVocabulary, probs: np.ndarray, words: list[str], times: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in words that occur ``times`` times; probs[piece] of one language."""
    total = np.zeros(vocab.size)
    where = {}
    for k, w in enumerate(words):
        where.setdefault(len(w), []).append(k)
    for n, rows_of in where.items():
        for at in range(0, len(rows_of), 4096):
            part = rows_of[at : at + 4096]
            arcs = vocab.lattice([words[k] for k in part])
            alpha, beta = np.zeros((n + 1, len(part))), np.zeros((n + 1, len(part)))
            alpha[0] = beta[n] = 1.0
            for start, end, rows, pieces in arcs:
                alpha[end, rows] += alpha[start, rows] * probs[pieces]
            for start, end, rows, pieces in reversed(arcs):
                beta[start, rows] += beta[end, rows] * probs[pieces]
            each = times[part] / np.maximum(alpha[n], 1e-300)
            for start, end, rows, pieces in arcs:
                np.add.at(total, pieces, alpha[start, rows] * probs[pieces] * beta[end, rows] * each[rows])
    return total


def words_of(text: str) -> list[str]:
    """The words of a text or token in lower case."""
    bare = text.strip(_EDGES)
    if bare.isalpha():
        return [MARK + bare]
    return [MARK + w for w in _LETTERS.findall(text)]


class LanguageModel:
    """Scores texts. Tokens (as cut by white space) are scored once and kept in two generations: what is
    used again survives, the rest makes room."""

    def __init__(self, vocab: PieceVocabulary, langs: list[str], probs: np.ndarray):
        self.vocab, self.langs, self.probs = vocab, langs, probs
        self.place: dict[str, int] = {}
        self.scores = np.zeros((0, len(langs)))
        self.old: tuple[dict[str, int], np.ndarray] = ({}, self.scores)

    def learn(self, tokens: set[str]) -> None:
        known, scores = self.old
        again = sorted(tokens & known.keys())
        fresh = sorted(tokens - known.keys())
        own = [words_of(t) for t in fresh]
        words = sorted({w for ws in own for w in ws})
        at = {w: k for k, w in enumerate(words)}
        by_word = np.vstack([forward(self.vocab, self.probs, words), np.zeros((1, len(self.langs)))])
        new = by_word[np.array([at[ws[0]] if ws else len(words) for ws in own], dtype=np.int64)]
        for k, ws in enumerate(own):
            for w in ws[1:]:
                new[k] += by_word[at[w]]
        old = scores[np.array([known[t] for t in again], dtype=np.int64)]
        self.place.update(zip(chain(again, fresh), range(len(self.scores), len(self.scores) + len(tokens)), strict=True))
        self.scores = np.vstack([self.scores, old, new])

    def predict(self, texts) -> list[tuple[str, float]]:
        """(language, posterior) of each text."""
        out = []
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        for at in range(0, len(texts), 500):
            if len(self.place) > CACHE:
                self.old = (self.place, self.scores)
                self.place, self.scores = {}, np.zeros((0, len(self.langs)))
            cut = [t.lower().split() if t else [] for t in texts[at : at + 500]]
            got = [list(map(self.place.get, ws)) for ws in cut]
            missing = {w for ws, g in zip(cut, got, strict=True) if None in g for w, x in zip(ws, g, strict=True) if x is None}
            if missing:
                self.learn(missing)
                get = self.place.__getitem__
                got = [list(map(get, ws)) if None in g else g for ws, g in zip(cut, got, strict=True)]
            for g in got:
                total = np.zeros(len(self.langs))
                for k in range(0, len(g), 1 << 16):
                    total += self.scores[np.array(g[k : k + (1 << 16)], dtype=np.int64)].sum(axis=0)
                if not total.any():  # every word of letters has a negative score
                    out.append(("und", 0.0))
                    continue
                best = int(total.argmax())
                out.append((self.langs[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def held_out(doc_id):
    """True for documents that no model learns from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, model_path: str = spm_model.DEFAULT_MODEL, max_docs: int = MAX_DOCS, iterations: int = ITERATIONS) -> LanguageModel:
    """docs(doc_id, text, lang) -> the models of all labels, from at most about max_docs documents each."""
    vocab = PieceVocabulary.load(model_path)
    train = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    # one row per language; languages are as many as the labels, not the documents
    sizes = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return LanguageModel(vocab, [], np.zeros((vocab.size, 0)))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, max_docs / sizes[k]))])
    unit = F.pmod(F.xxhash64(F.lit("langid"), F.col("doc_id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    sample = train.filter(unit < F.element_at(share, F.col("lang"))).select("lang", "text")

    def count(batches):
        for b in slices(batches, 500):
            seen: dict[str, Counter] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(w[k : k + LEARNED_PART] for t in text.lower().split() for w in words_of(t) for k in range(0, len(w), LEARNED_PART))
            rows = [(k, w, n) for k, c in seen.items() for w, n in c.items()]
            if rows:
                k, w, n = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(w, pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "times"])

    counts = sample.mapInArrow(count, "lang string, word string, times long").groupBy("lang", "word").agg(F.sum("times").alias("times"))
    counts = written(counts, "langid-words")
    uniform = np.full(vocab.size, 1.0 / vocab.size)
    probs = {k: uniform for k in langs}
    for _ in range(iterations):

        def expect(batches, probs=probs):
            # one sum per language and task, as large as the vocabulary
            sums: dict[str, np.ndarray] = {}
            held: dict[str, list] = {}

            def add(lang: str) -> None:
                w, n = zip(*held.pop(lang), strict=True)
                e = expected_counts(vocab, probs[lang], list(w), np.array(n, dtype=float))
                sums[lang] = sums.get(lang, 0.0) + e

            for b in slices(batches):
                for lang, w, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    held.setdefault(lang, []).append((w, n))
                for lang in [k for k, rows in held.items() if len(rows) >= 10_000]:
                    add(lang)
            for lang in list(held):
                add(lang)
            for lang, e in sums.items():
                used = np.flatnonzero(e)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used), pa.array(e[used])], names=["lang", "piece", "uses"])

        # summed as decimals, so that the order of the tasks changes nothing
        uses = counts.mapInArrow(expect, "lang string, piece long, uses double").groupBy("lang", "piece")
        got = {k: np.full(vocab.size, SMOOTHING) for k in langs}
        # languages times pieces of the vocabulary: a bound that does not grow with the documents
        for r in uses.agg(F.sum(F.col("uses").cast("decimal(28,6)")).alias("uses")).collect():
            got[r["lang"]][r["piece"]] += float(r["uses"])
        probs = {k: v / v.sum() for k, v in got.items()}
    return LanguageModel(vocab, langs, np.stack([probs[k] for k in langs], axis=1))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs(doc_id, text) -> doc_id, lang_pred, score."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in slices(batches, 500):
            p = model.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in p], pa.string()), pa.array([x for _, x in p], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def op10_langid(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def stage(spark, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """Pipeline stage: documents in no language, or in none with a posterior of ``least``, go."""
    small_batches(spark)
    model = fit(docs)

    def run(batches):
        for b in slices(batches, 500):
            keep = [lang != "und" and score >= least for lang, score in model.predict(b.column("text").to_pylist())]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
