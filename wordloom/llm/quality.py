"""Quality rules: a linear-chain conditional random field labels lines as content or boilerplate.

Each line with a word has binary features of its shape (length, symbols, capitals, punctuation, repetition,
letters). The field scores label sequences by features and by pairs of neighbouring labels; the Viterbi
algorithm finds the best sequence, and a document is kept if the share of its words in content lines is at least
the field's ``least_share``. Weights and share are fitted on at most about ``max_docs`` labelled documents, chosen by a
hash. Their labels are of documents, so the labels of lines are latent: they begin with the odds of each line's features
in good and bad documents, and then the field's own best sequences replace them, ``ROUNDS`` times, as far as the document's
label allows (a good document is content for the most part, a bad one is not content throughout). Good lines of bad documents
are thus content, and the field sees where labels change. The share is the one that tells good from bad documents best.

The base rules count words, characters, symbols, repeated lines and repeated eight-word windows of whole texts.

Edge cases: null and empty texts have no word and fail the base rules; without any labelled document every
line is content; repeated rows get equal results; labels that repeat a doc_id with different values
count once each; texts of any length are used whole; other columns are left out.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table

#: Labelled documents that the field is fitted on.
MAX_DOCS = 2000
#: The share of words in content lines from which a document is kept, where no labels tell it.
LEAST_SHARE = 0.5
#: How often the latent labels of lines are found anew.
ROUNDS = 3
WINDOW = 8
MIN_WORDS = 20
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
N_FEATURES = 24
#: Lines of one training sequence; longer documents give several.
CHUNK = 64

_MIX = np.random.default_rng(20240229).integers(1, 2**63, WINDOW, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of words which the text holds twice or more, the first one included."""
    n = len(words)
    if n <= window:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.uint64, count=n)
    m = n - window + 1
    h = np.zeros(m, dtype=np.uint64)
    for k in range(window):
        # odd factors, and the high bits brought down, tell windows apart
        h += (ids[k : k + m] + np.uint64(1)) * _MIX[k]
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    grid = np.lib.stride_tricks.sliding_window_view(ids, window)
    first, second = order[:-1][same], order[1:][same]
    twice = np.zeros(m, dtype=bool)
    if all((grid[first[a : a + 65536]] == grid[second[a : a + 65536]]).all() for a in range(0, len(first), 65536)):
        twice[first] = twice[second] = True
    else:  # two windows share a hash: count them themselves
        _, back, count = np.unique(grid, axis=0, return_inverse=True, return_counts=True)
        twice = count[back.reshape(-1)] > 1
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def line_features(line: str, words: list[bytes], repeated: bool) -> int:
    """The features of a line with a word, as bits."""
    n = len(words)
    symbols = sum(line.count(c) for c in SYMBOLS)
    size = len(line)
    bits = 1
    bits |= 2 if n <= 2 else 4 if n <= 5 else 8 if n <= 15 else 16 if n <= 60 else 32
    if symbols:
        bits |= 64 if symbols <= 0.1 * n else 128 if symbols < n else 256
    text = line.strip()
    if text.isupper():
        bits |= 1 << 9
    if text[-1:] in '.!?:;"”»)':
        bits |= 1 << 10
    if text[-2:] in ("!!", "??"):
        bits |= 1 << 11
    if text[:1].isupper():
        bits |= 1 << 12
    if n >= 6:
        share = len(set(words)) / n
        bits |= 1 << 13 if share < 0.3 else 1 << 14 if share < 0.6 else 1 << 15
    if repeated:
        bits |= 1 << 16
    mean = size / n
    bits |= 1 << 17 if mean < 3 else 1 << 18 if mean < 9 else 1 << 19 if mean < 16 else 1 << 20
    marks = line.count(",") + line.count(".") + line.count("!") + line.count("?")
    if marks > 0.5 * n:
        bits |= 1 << 21
    if line.count("|") > 0.2 * n:
        bits |= 1 << 22
    if line.count("!") > 0.3 * n:
        bits |= 1 << 23
    return bits


def measure(text: str | None) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; words and features of each line with a word."""
    if not text:
        return 0, 0, 0, 0, 0, [], []
    lines = text.split("\n")
    # bytes know ASCII white space only, which is just what separates words
    by_line = [x.split() for x in text.encode("utf-8", "surrogatepass").split(b"\n")]
    seen: set[str] = set()
    dup, sizes, features = 0, [], []
    for line, words in zip(lines, by_line, strict=True):
        if words:
            repeated = line in seen
            dup += repeated
            seen.add(line)
            sizes.append(len(words))
            features.append(line_features(line, words, repeated))
    flat = list(chain.from_iterable(by_line))
    chars = len(text) - sum(text.count(c) for c in SPACES)
    return len(flat), chars, sum(text.count(c) for c in SYMBOLS), dup, repeated_words(flat), sizes, features


class LineField:
    """The linear-chain field; label 1 is content. node[label, feature], pair[before, after], start[label]."""

    def __init__(self, node: np.ndarray, pair: np.ndarray, start: np.ndarray, least_share: float = LEAST_SHARE):
        self.node, self.pair, self.start, self.least_share = node, pair, start, least_share
        self.known: dict[int, tuple[float, float]] = {}

    @classmethod
    def blank(cls) -> "LineField":
        return cls(np.zeros((2, N_FEATURES)), np.zeros((2, 2)), np.zeros(2))

    def scores(self, bits: int) -> tuple[float, float]:
        if bits not in self.known:
            on = [k for k in range(N_FEATURES) if bits >> k & 1]
            self.known[bits] = (float(self.node[0, on].sum()), float(self.node[1, on].sum()))
        return self.known[bits]

    def viterbi(self, features: list[int]) -> list[int]:
        if not features:
            return []
        (p00, p01), (p10, p11) = self.pair.tolist()
        a, b = self.scores(features[0])
        s0, s1 = self.start[0] + a, self.start[1] + b
        back = []
        for bits in features[1:]:
            a, b = self.scores(bits)
            # ties go to content
            x, y = s0 + p00 > s1 + p10, s0 + p01 > s1 + p11
            s0, s1 = (s0 + p00 if x else s1 + p10) + a, (s0 + p01 if y else s1 + p11) + b
            back.append((0 if x else 1, 0 if y else 1))
        label = 0 if s0 > s1 else 1
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]

    def share(self, sizes: list[int], features: list[int]) -> tuple[float, int]:
        """Share of the words in content lines, and the number of these lines."""
        labels = self.viterbi(features)
        total = sum(sizes)
        return sum(n for n, y in zip(sizes, labels, strict=True) if y) / total if total else 0.0, sum(labels)

    @classmethod
    def trained(cls, sequences: list[list[int]], labels: list[list[int]], steps: int = 100, ridge: float = 1.0):
        """Maximum likelihood of labelled lines by Adam on forward-backward expectations."""
        parts = [(s[k : k + CHUNK], y[k : k + CHUNK]) for s, y in zip(sequences, labels, strict=True) for k in range(0, len(s), CHUNK)]
        if not parts:
            return cls.blank()
        n, width = len(parts), max(len(s) for s, _ in parts)
        x = np.zeros((n, width, N_FEATURES))
        live = np.zeros((n, width), dtype=bool)
        gold = np.zeros((n, width, 2))
        gold_pair = np.zeros((2, 2))
        for k, (s, y) in enumerate(parts):
            live[k, : len(s)] = True
            x[k, : len(s)] = (np.array(s)[:, None] >> np.arange(N_FEATURES)) & 1
            gold[k, np.arange(len(s)), y] = 1
            np.add.at(gold_pair, (y[:-1], y[1:]), 1)
        weight = np.zeros(2 * N_FEATURES + 4 + 2)
        m, v = np.zeros_like(weight), np.zeros_like(weight)
        pairs = live[:, 1:].sum()
        gold_start = gold[:, 0].sum(axis=0)
        for step in range(1, steps + 1):
            node, pair, start = weight[: 2 * N_FEATURES].reshape(2, -1), weight[-6:-2].reshape(2, 2), weight[-2:]
            e = x @ node.T
            alpha, beta = np.zeros((n, width, 2)), np.zeros((n, width, 2))
            alpha[:, 0] = start + e[:, 0]
            for t in range(1, width):
                alpha[:, t] = np.where(live[:, t, None], np.logaddexp(alpha[:, t - 1, :1] + pair[0], alpha[:, t - 1, 1:] + pair[1]) + e[:, t], alpha[:, t - 1])
            total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
            for t in range(width - 2, -1, -1):
                nxt = beta[:, t + 1] + e[:, t + 1]
                b = np.logaddexp(pair[:, 0] + nxt[:, :1], pair[:, 1] + nxt[:, 1:])
                beta[:, t] = np.where(live[:, t + 1, None], b, 0.0)
            p = np.exp(alpha + beta - total[:, None, None]) * live[:, :, None]
            joint = alpha[:, :-1, :, None] + pair + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]
            joint = (np.exp(np.minimum(joint, 0.0)) * live[:, 1:, None, None]).sum(axis=(0, 1))
            g_node = np.einsum("ntl,ntf->lf", gold - p, x)
            grad = np.concatenate([g_node.ravel(), (gold_pair - joint).ravel(), gold_start - p[:, 0].sum(axis=0)])
            grad = (grad - ridge * weight) / max(1, pairs + n)
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            weight = weight + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return cls(weight[: 2 * N_FEATURES].reshape(2, -1), weight[-6:-2].reshape(2, 2), weight[-2:])

    @classmethod
    def learned(cls, documents: list[tuple[int, list[int], list[int]]], rounds: int = ROUNDS):
        """From (quality, words of each line, features of each line) of documents; their lines have no labels."""
        if len({q for q, _, _ in documents}) < 2:
            return cls.blank()
        # odds of features, each line of a document weighing as its words do
        held = np.ones((2, N_FEATURES))
        words = np.full(2, 2.0)
        for q, sizes, features in documents:
            w = np.array(sizes) / sum(sizes)
            held[q] += w @ ((np.array(features)[:, None] >> np.arange(N_FEATURES)) & 1)
            words[q] += 1
        on, off = np.log(held / words[:, None]), np.log1p(-np.minimum(held / words[:, None], 1 - 1e-6))
        gain, base = (on - off)[1] - (on - off)[0], (off[1] - off[0]).sum()

        def odds(features: list[int]) -> np.ndarray:
            return ((np.array(features)[:, None] >> np.arange(N_FEATURES)) & 1) @ gain + base

        def allowed(q: int, sizes: list[int], labels: list[int], features: list[int]) -> list[int]:
            share = sum(n for n, y in zip(sizes, labels, strict=True) if y) / sum(sizes)
            if q and share < LEAST_SHARE:
                return [1] * len(labels)
            if not q and all(labels):
                worst = odds(features)
                return [int(w > worst.min()) for w in worst]
            return labels

        labels = [allowed(q, sizes, [int(o > 0) for o in odds(f)], f) for q, sizes, f in documents]
        for _ in range(rounds):
            field = cls.trained([f for _, _, f in documents], labels)
            labels = [allowed(q, sizes, field.viterbi(f), f) for q, sizes, f in documents]
        field.least_share = best_share([(q, field.share(sizes, f)[0]) for q, sizes, f in documents])
        return field


def best_share(shares: list[tuple[int, float]]) -> float:
    """The share that errs least on (quality, share) of documents, good and bad ones weighing alike; in the middle between two
    of the shares."""
    good, bad = (sorted(s for q, s in shares if q == k) for k in (1, 0))
    found = sorted({0.0, *good, *bad, 1.0})
    cuts = [(a + b) / 2 for a, b in zip(found, found[1:], strict=False)]
    lost = np.searchsorted(good, cuts, side="left") / len(good) + 1 - np.searchsorted(bad, cuts, side="left") / len(bad)
    return float(cuts[int(np.argmin(lost))])


def sampled(labels: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """The labelled documents that the field is fitted on: about max_docs at most, chosen by a hash."""
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality"))
    n = known.count()
    unit = F.pmod(F.xxhash64(F.lit("quality"), F.col("doc_id").cast("string")), F.lit(1 << 30))
    return known.filter(unit < int(min(1.0, max_docs / max(1, n)) * (1 << 30)))


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> LineField:
    """docs(doc_id, text), labels(doc_id, quality 0 or 1) -> the field."""

    def run(batches):
        for b in slices(batches):
            rows = [(d, q, *measure(t)[5:]) for d, q, t in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            kinds = [pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["doc_id", "quality", "sizes", "lines"])

    # the sample holds about max_docs rows at most, whatever the tables hold
    picked = docs.select("doc_id", "text").join(F.broadcast(sampled(labels, max_docs)), "doc_id").select(F.col("doc_id").cast("string"), "quality", "text")
    rows = picked.mapInArrow(run, "doc_id string, quality int, sizes array<int>, lines array<int>").collect()
    rows = sorted((r["doc_id"], r["quality"], r["sizes"], r["lines"]) for r in rows if r["lines"])
    return LineField.learned([r[1:] for r in rows])


def judge(docs: DataFrame, field: LineField, least_share: float | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, the counts, base_failed, kept, content_share and n_content_lines."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    least = field.least_share if least_share is None else least_share
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for b in slices(batches):
            out = []
            for t in b.column(1).to_pylist():
                *counts, sizes, features = measure(t)
                share, content = field.share(sizes, features)
                failed = counts[0] < MIN_WORDS or 100 * counts[4] > 30 * counts[0]
                out.append((*counts, failed, not failed and share >= least, share, content))
            cols = list(zip(*out, strict=True)) or [()] * 9
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", *names, "base_failed", "kept", "content_share", "n_content_lines"])

    schema = f"doc_id {kind}, " + ", ".join(f"{x} long" for x in names) + ", base_failed boolean, kept boolean, content_share double, n_content_lines long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op5_quality(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))
