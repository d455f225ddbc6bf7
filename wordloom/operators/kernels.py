"""Model kernels: from a word to its subword tokens.

Each model has two forms. The *Arrow* form runs in the rows' own tasks and remembers words, so nothing is shuffled;
it is what streams and very large tables use. The *join* form works on a table of distinct words with
joins and folds alone, without Python; it pays off where the words are few or are needed as a table.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.text import byte_pieces, characters
from ..sources.definition import Definition
from .stage import in_slices

#: Symbols up to which the join form merges a word by a fold; longer words take the Arrow form.
FOLD_SYMBOLS = 16
#: Symbols up to which the Arrow form looks for a word's best pair among all; longer words have a queue.
SHORT = 40


# --- plain functions, the body of the Arrow form ---


def wordpiece(d: Definition) -> Callable[[str], list[str]]:
    vocab, prefix, unknown, most = d.model_vocab, d.prefix, [d.unk_token], d.max_chars
    longest = max(map(len, vocab))

    def run(word: str) -> list[str]:
        if len(word) > most:
            return unknown
        out, at = [], 0
        while at < len(word):
            lead = prefix if at else ""
            ends = range(min(len(word), at + longest), at, -1)
            end = next((e for e in ends if lead + word[at:e] in vocab), None)
            if end is None:
                return unknown
            out.append(lead + word[at:end])
            at = end
        return out

    return run


def _fallback(text: str, vocab: dict[str, int]) -> list[str] | None:
    pieces = [f"<0x{b:02X}>" for b in text.encode("utf-8", "surrogatepass")]
    return pieces if all(p in vocab for p in pieces) else None


def unigram(d: Definition) -> Callable[[str], list[str]]:
    f32 = np.float32
    score = {p: f32(d.scores[k]) for p, k in d.model_vocab.items()}
    finite = min((f32(x) for x in d.scores), default=f32(0))
    unk_score = f32((finite if np.isfinite(finite) else f32(0)) - f32(10))
    longest = max(map(len, score))
    unknown_piece = d.unk_token if 0 <= d.unk_id < len(d.pieces) else None

    def run(word: str) -> list[str]:
        n = len(word)
        # best score up to each end, and where its last piece starts; of equal scores the longest last piece stays
        best: list = [f32(0)] + [None] * n
        since = [0] * (n + 1)
        for start in range(n):
            if best[start] is None:
                continue
            for end in range(start + 1, min(n, start + longest) + 1):
                own = score.get(word[start:end])
                if own is None:
                    if end > start + 1:
                        continue
                    own = unk_score
                total = f32(best[start] + own)
                if best[end] is None or total > best[end]:
                    best[end], since[end] = total, start
        cuts, at = [], n
        while at:
            cuts.append((since[at], at))
            at = since[at]
        out: list[str] = []
        run_of = ""
        for a, b in [*reversed(cuts), (n, n)]:
            piece = word[a:b]
            if a < b and (piece not in score or piece == unknown_piece):
                run_of += piece
                continue
            if run_of:
                out += (_fallback(run_of, d.model_vocab) if d.byte_fallback else None) or [d.unk_token]
                run_of = ""
            if a < b:
                out.append(piece)
        return out

    return run


def bpe_symbols(d: Definition) -> Callable[[str], list[str]]:
    """What merging starts from. A pending unknown is written before the next known character only: bytes of
    another character may come before it."""
    vocab = d.model_vocab
    unk = d.model_unk if d.model_unk and d.model_unk in vocab else None

    def run(word: str) -> list[str]:
        out, waiting = [], False
        for c in word:
            if c in vocab:
                if waiting:
                    out.append(unk)
                    waiting = False
                out.append(c)
            elif d.byte_fallback and (pieces := _fallback(c, vocab)):
                out += pieces
            elif unk is not None:
                if waiting and not d.fuse_unk:
                    out.append(unk)
                waiting = True
        return out + [unk] * waiting

    return run


def merging(d: Definition) -> Callable[[str], list[str]]:
    rank = {pair: k for k, pair in enumerate(d.merges)}
    none = len(d.merges)
    symbols = bpe_symbols(d)

    def run(word: str) -> list[str]:
        parts: list[str | None] = list(symbols(word))
        n = len(parts)
        if n <= SHORT:
            # the best of few pairs is found sooner by a look at all
            ranks = [rank.get(pair, none) for pair in zip(parts, parts[1:], strict=False)]
            while ranks and (best := min(ranks)) < none:
                k = ranks.index(best)
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
                del ranks[k]
                if k:
                    ranks[k - 1] = rank.get((parts[k - 1], parts[k]), none)
                if k < len(ranks):
                    ranks[k] = rank.get((parts[k], parts[k + 1]), none)
            return parts
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        queue = [(rank[pair], k, *pair) for k, pair in enumerate(zip(parts, parts[1:], strict=False)) if pair in rank]
        heapq.heapify(queue)
        while queue:
            _, k, left, right = heapq.heappop(queue)
            j = after[k]
            # entries of symbols that have changed since are stale
            if j >= n or parts[k] != left or parts[j] != right:
                continue
            parts[k], parts[j] = left + right, None
            after[k] = after[j]
            if after[j] < n:
                before[after[j]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < n and (r := rank.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(queue, (r, a, parts[a], parts[b]))
        return [p for p in parts if p is not None]

    return run


def bpe(d: Definition) -> Callable[[str], list[str]]:
    merged = merging(d)
    return lambda word: [word] if d.ignore_merges and word and word in d.model_vocab else merged(word)


def function(d: Definition) -> Callable[[str], list[str]]:
    return {"WordPiece": wordpiece, "Unigram": unigram, "BPE": bpe}[d.kind](d)


# --- join form: words(word) -> word, tokens ---


def _fold_longest(d: Definition) -> Callable[[Column], Column]:
    """Greedy walk over candidates (st, ln, token): at each place the longest, or the unknown token for the whole word."""

    def run(candidates: Column) -> Column:
        n = F.length("word")
        start = F.struct(F.lit(1).alias("pos"), F.array().cast("array<string>").alias("out"))
        by_place = F.array_sort(F.transform(candidates, lambda c: F.struct(c["st"].alias("st"), (-c["ln"]).alias("back"), c["token"].alias("token"))))

        def step(state: Column, c: Column) -> Column:
            grown = F.struct((c["st"] - c["back"]).alias("pos"), F.concat(state["out"], F.array(c["token"])).alias("out"))
            return F.when(c["st"] == state["pos"], grown).otherwise(state)

        whole = lambda s: F.when(s["pos"] == n + 1, s["out"]).otherwise(F.array(F.lit(d.unk_token)))
        walked = F.aggregate(by_place, start, step, whole)
        return F.when(n > d.max_chars, F.array(F.lit(d.unk_token))).otherwise(walked)

    return run


def _substrings(words: DataFrame, longest: int, most: int | None = None) -> DataFrame:
    """word -> word, st, ln, piece for its substrings of up to ``longest`` characters."""
    n = F.length("word")
    # outer forms and a filter on what they make: a filter on words would be put before they are made distinct, and they
    # would be read and dealt once more
    places = F.when((n > 0) & (n <= most) if most is not None else n > 0, F.sequence(F.lit(1), n))
    spans = words.select("word", F.explode_outer(places).alias("st"))
    spans = spans.select("word", "st", F.explode_outer(F.when(F.col("st").isNotNull(), F.sequence(F.lit(1), F.least(F.lit(longest), n - F.col("st") + 1)))).alias("ln"))
    spans = spans.filter(F.col("ln").isNotNull())
    return spans.withColumn("piece", F.substr("word", F.col("st"), F.col("ln")))


def join_wordpiece(words: DataFrame, d: Definition) -> DataFrame:
    spark = words.sparkSession
    vocab = spark.createDataFrame([(t,) for t in sorted(d.model_vocab)], "token string")
    spans = _substrings(words, max(map(len, d.model_vocab)), d.max_chars)
    token = F.when(F.col("st") > 1, F.concat(F.lit(d.prefix), F.col("piece"))).otherwise(F.col("piece"))
    known = spans.withColumn("token", token).join(F.broadcast(vocab), "token")
    # only the longest at a place can be taken
    known = known.groupBy("word", "st").agg(F.max(F.struct("ln", "token")).alias("c"))
    lists = known.groupBy("word").agg(F.collect_list(F.struct("st", F.col("c.ln").alias("ln"), F.col("c.token").alias("token"))).alias("cand"))
    cand = F.coalesce("cand", F.array().cast("array<struct<st:int,ln:int,token:string>>"))
    rows = words.join(lists, "word", "left")
    empty = F.array().cast("array<string>")
    return rows.select("word", F.when(F.col("word") == "", empty).otherwise(_fold_longest(d)(cand)).alias("tokens"))


def join_unigram(words: DataFrame, d: Definition) -> DataFrame:
    spark = words.sparkSession
    table = d.pieces_table(spark)
    least = min((np.float32(x) for x in d.scores), default=np.float32(0))
    unk_score = float(np.float32((least if np.isfinite(least) else np.float32(0)) - np.float32(10)))
    spans = _substrings(words, max(map(len, d.model_vocab)))
    joined = spans.join(F.broadcast(table), spans["piece"] == table["token"], "left").filter((F.col("ln") == 1) | F.col("id").isNotNull())
    arc = F.struct(
        (F.col("st") + F.col("ln")).alias("end"), "st", F.coalesce("score", F.lit(unk_score).cast("float")).alias("score"),
        "piece", (F.col("id").isNull() | (F.col("id") == d.unk_id)).alias("unk"),
    )
    lists = joined.groupBy("word").agg(F.array_sort(F.collect_list(arc)).alias("arcs"))
    place = "struct<s:float,pieces:array<struct<piece:string,unk:boolean>>>"
    # best[k]: the best path up to place k + 1; arcs come by end and start, so a later equal score does not win
    begin = F.array(F.struct(F.lit(0).cast("float").alias("s"), F.array().cast("array<struct<piece:string,unk:boolean>>").alias("pieces")).cast(place))

    def step(best: Column, a: Column) -> Column:
        before = F.element_at(best, a["st"])
        total = (before["s"] + a["score"]).cast("float")
        path = F.struct(total.alias("s"), F.concat(before["pieces"], F.array(F.struct(a["piece"].alias("piece"), a["unk"].alias("unk")))).alias("pieces")).cast(place)
        here = F.get(best, a["end"] - 1)
        return F.when(here.isNull(), F.concat(best, F.array(path))).when(total > here["s"], F.concat(F.slice(best, F.lit(1), a["end"] - 1), F.array(path))).otherwise(best)

    path = F.aggregate("arcs", begin, step, lambda best: F.element_at(best, -1)["pieces"])
    folded = lists.select("word", _fuse_unknown(path, d).alias("tokens"))
    empty = F.array().cast("array<string>")
    return words.join(folded, "word", "left").select("word", F.coalesce("tokens", empty).alias("tokens"))


def _fuse_unknown(path: Column, d: Definition) -> Column:
    """Neighbouring unknown pieces become one unknown token, or the bytes of their text if all are pieces."""
    known = F.array(*[F.lit(p) for p in sorted(d.model_vocab) if p.startswith("<0x")]).cast("array<string>")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("run"))

    def flushed(state: Column) -> Column:
        unknown = F.array(F.lit(d.unk_token))
        if d.byte_fallback:
            pieces = byte_pieces(state["run"])
            unknown = F.when(F.forall(pieces, lambda p: F.array_contains(known, p)), pieces).otherwise(unknown)
        return F.when(state["run"] == "", state["out"]).otherwise(F.concat(state["out"], unknown))

    def step(state: Column, p: Column) -> Column:
        longer = F.struct(state["out"].alias("out"), F.concat(state["run"], p["piece"]).alias("run"))
        ended = F.struct(F.concat(flushed(state), F.array(p["piece"])).alias("out"), F.lit("").alias("run"))
        return F.when(p["unk"], longer).otherwise(ended)

    return F.aggregate(path, start, step, flushed)


def join_symbols(words: DataFrame, d: Definition) -> DataFrame:
    """word -> word, symbols: what merging starts from, with one lookup per distinct character."""
    spark = words.sparkSession
    vocab = spark.createDataFrame([(t,) for t in sorted(d.model_vocab)], "token string")
    # as many as there are characters in use, so they can be sent to all
    chars = words.select(F.explode_outer(characters(F.col("word"))).alias("c")).filter(F.col("c").isNotNull()).distinct()
    known = chars.join(F.broadcast(vocab), chars["c"] == vocab["token"], "left").select("c", F.col("token").isNotNull().alias("known"))
    bytes_known = F.array(*[F.lit(p) for p in sorted(d.model_vocab) if p.startswith("<0x")]).cast("array<string>")
    pieces = byte_pieces(F.col("c"))
    fits = F.lit(d.byte_fallback) & F.forall(pieces, lambda p: F.array_contains(bytes_known, p))
    known = known.withColumn("bytes", F.when(fits, pieces))
    spread = words.select("word", F.posexplode_outer(characters(F.col("word"))).alias("k", "c")).join(F.broadcast(known), "c")
    lists = spread.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("k", "c", "known", "bytes"))).alias("cs"))
    has_unk = bool(d.model_unk) and d.model_unk in d.model_vocab
    unk = F.array(F.lit(d.model_unk or ""))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("waiting"))

    def step(s: Column, c: Column) -> Column:
        pending = F.when(s["waiting"], F.concat(s["out"], unk)).otherwise(s["out"])
        plain = F.struct(F.concat(pending, F.array(c["c"])).alias("out"), F.lit(False).alias("waiting"))
        by_bytes = F.struct(F.concat(s["out"], c["bytes"]).alias("out"), s["waiting"].alias("waiting"))
        unknown = F.struct((s["out"] if d.fuse_unk else pending).alias("out"), F.lit(True).alias("waiting")) if has_unk else s
        return F.when(c["known"], plain).when(c["bytes"].isNotNull(), by_bytes).otherwise(unknown)

    end = lambda s: F.when(s["waiting"], F.concat(s["out"], unk)).otherwise(s["out"])
    folded = lists.select("word", F.aggregate("cs", start, step, end).alias("symbols"))
    empty = F.array().cast("array<string>")
    return words.join(folded, "word", "left").select("word", F.coalesce("symbols", empty).alias("symbols"))


def join_bpe(words: DataFrame, d: Definition) -> DataFrame:
    """Merges as a fold over the places that a word's possible merges would join.

    Every possible merge joins symbols i..j and j..k whose texts are a pair of the table. The fold keeps the places
    that are still borders; each step drops the border of the best merge both of whose parts are whole now.
    """
    spark = words.sparkSession
    symbols = join_symbols(words, d)
    whole = F.array(*[F.lit(t) for t in []]).cast("array<string>")
    if d.ignore_merges:
        vocab = spark.createDataFrame([(t,) for t in sorted(d.model_vocab)], "own string")
        symbols = symbols.join(F.broadcast(vocab), symbols["word"] == vocab["own"], "left")
        whole = F.when(F.col("own").isNotNull(), F.array("word"))
    n = F.size("symbols")
    short = symbols.filter(n <= FOLD_SYMBOLS)
    longest = max((len(a) + len(b) for a, b in d.merges), default=0)
    # a symbol has a character at least, so no merge joins more symbols than the longest has characters
    ij = short.filter(n > 1).select("word", "symbols", F.explode(F.sequence(F.lit(1), n - 1)).alias("i"))
    ij = ij.select("word", "symbols", "i", F.explode(F.sequence(F.col("i") + 1, F.least(n, F.col("i") + max(1, longest - 1)))).alias("j"))
    ijk = ij.select("word", "symbols", "i", "j", F.explode(F.sequence(F.col("j") + 1, F.least(n + 1, F.greatest(F.col("j") + 1, F.col("i") + longest)))).alias("k"))
    text = lambda a, b: F.array_join(F.slice("symbols", F.col(a), F.col(b) - F.col(a)), "")
    pairs = ijk.select("word", "i", "j", "k", text("i", "j").alias("left"), text("j", "k").alias("right"))
    pairs = pairs.filter(F.length("left") + F.length("right") <= longest)
    found = pairs.join(F.broadcast(d.merges_table(spark)), ["left", "right"]).groupBy("word")
    found = found.agg(F.array_sort(F.collect_list(F.struct("rank", "i", "j", "k"))).alias("cand"))
    rows = short.join(found, "word", "left")

    def step(borders: Column, _: Column) -> Column:
        def possible(c: Column) -> Column:
            inner = F.filter(borders, lambda b: (b >= c["i"]) & (b <= c["k"]))
            return inner == F.array(c["i"], c["j"], c["k"])

        # no border is 0; what is named once is computed once
        return F.array_remove(borders, F.coalesce(F.get(F.filter("cand", possible), F.lit(0))["j"], F.lit(0)))

    first = F.sequence(F.lit(1), n + 1)
    borders = F.when(F.col("cand").isNull(), first).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n - 1, F.size("cand")))), first, step))
    cut = F.transform(F.slice(F.col("borders"), F.lit(1), F.size("borders") - 1), lambda b, k: F.array_join(F.slice("symbols", b, F.element_at("borders", k + 2) - b), ""))
    merged = F.when(n == 0, F.array().cast("array<string>")).otherwise(cut)
    folded = rows.withColumn("borders", borders).select("word", (F.coalesce(whole, merged) if d.ignore_merges else merged).alias("tokens"))
    fn = arrow_tokens(d)
    long_words = symbols.filter(n > FOLD_SYMBOLS).select("word", fn(F.array("word")).alias("tokens"))
    return folded.unionByName(long_words)


def join_tokens(words: DataFrame, d: Definition) -> DataFrame:
    """Distinct words(word) -> word, tokens."""
    return {"WordPiece": join_wordpiece, "Unigram": join_unigram, "BPE": join_bpe}[d.kind](words, d)


# --- Arrow form ---

#: Words, or pieces of words, that a worker remembers.
CACHE = 200_000
#: Kinds of characters that the cutting of words tells apart.
KINDS = 1024


class Numbers(dict):
    """Tokens, numbered as they come: those of the vocabulary, of the merges and of the markers, whatever the words."""

    def __missing__(self, token: str) -> int:
        self[token] = number = len(self)
        return number


def picked(sizes: np.ndarray, values: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each code stands for a list; sizes and values hold the lists one after the other. Bounds and values of the codes' lists."""
    starts = np.concatenate(([0], np.cumsum(sizes)))
    count = sizes[codes]
    ends = np.concatenate(([0], np.cumsum(count)))
    return ends, values[np.repeat(starts[codes] - ends[:-1], count) + np.arange(ends[-1])]


def remembered(fn: Callable[[str], list[str]], numbers: Numbers) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """From distinct words to the sizes of their lists of tokens and the tokens' numbers, one word at a time."""
    known: dict[str, list[int]] = {}

    def run(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for w in words.to_pylist():
            t = known.get(w)
            if t is None:
                if len(known) >= CACHE:
                    known.clear()
                t = known[w] = [numbers[x] for x in fn(w)]
            out.append(t)
        sizes = np.fromiter(map(len, out), dtype=np.int64, count=len(out))
        return sizes, np.fromiter(chain.from_iterable(out), dtype=np.int64, count=int(sizes.sum()))

    return run


def _joints(d: Definition) -> tuple[np.ndarray, np.ndarray]:
    """The kind of each code point, and for two kinds (first * KINDS + second) whether their characters must stay together.

    A merge joins two characters of the vocabulary only if one ends its left part and the other begins its right part.
    Others are of kind 0, which stays with what is beside it, since what they become depends on that. Characters may
    share a kind: then fewer places are cut, never a wrong one.
    """
    kind = np.zeros(0x110000, dtype=np.uint16)
    for k, c in enumerate(sorted(t for t in d.model_vocab if len(t) == 1)):
        kind[ord(c)] = 1 + k % (KINDS - 1)
    joint = np.zeros((KINDS, KINDS), dtype=bool)
    joint[0, :] = joint[:, 0] = True
    for a, b in d.merges:
        if a and b:
            joint[kind[ord(a[-1])], kind[ord(b[0])]] = True
    return kind, joint.ravel()


def in_pieces(d: Definition, numbers: Numbers) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """As ``remembered``, for BPE: all words are cut at once where no merge joins them, and only distinct pieces are merged.
    Merges of one piece do not touch another, so the pieces' tokens are the word's. New words are mostly of known pieces."""
    kind, joint = _joints(d)
    merged = remembered(merging(d), numbers)
    vocab = pa.array([t.encode("utf-8", "surrogatepass") for t in d.model_vocab], pa.binary()) if d.ignore_merges else None

    def run(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = words.cast(pa.string())
        raw = _bytes(words)
        if not len(raw):
            return np.zeros(len(words), dtype=np.int64), np.zeros(0, dtype=np.int64)
        points = np.frombuffer(str(raw, "utf-8").encode("utf-32-le"), dtype=np.uint32)
        lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False)
        bounds = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
        kinds = kind[points].astype(np.int32)
        first = np.ones(len(points) + 1, dtype=bool)
        first[1:-1] = ~joint[kinds[:-1] * KINDS + kinds[1:]]
        if vocab is not None:
            whole = pc.is_in(words.cast(pa.binary()), value_set=vocab).to_numpy(zero_copy_only=False) & (lengths > 0)
            first[:-1] &= ~np.repeat(whole, lengths)
        first[bounds] = True
        starts = np.flatnonzero(first)
        # the first byte of each character, and the end
        at = np.concatenate((np.flatnonzero((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80), [len(raw)])).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(at[starts]), raw).dictionary_encode()
        sizes, tokens = merged(pieces.dictionary)
        codes = pieces.indices.to_numpy(zero_copy_only=False)
        # of each word its first piece
        spans = np.searchsorted(starts, bounds)
        if vocab is not None and whole.any():
            own = words.filter(pa.array(whole)).to_pylist()
            codes = codes.copy()
            codes[spans[:-1][whole]] = len(sizes) + np.arange(len(own))
            sizes = np.concatenate((sizes, np.ones(len(own), dtype=np.int64)))
            tokens = np.concatenate((tokens, np.array([numbers[w] for w in own], dtype=np.int64)))
        ends, tokens = picked(sizes, tokens, codes)
        return np.diff(ends[spans]), tokens

    return run


def _bytes(words: pa.Array) -> pa.Buffer:
    """The words' bytes, one word after the other."""
    if not len(words):
        return pa.py_buffer(b"")
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)
    start, end = int(offsets[words.offset]), int(offsets[words.offset + len(words)])
    return words.buffers()[2].slice(start, end - start) if end > start else pa.py_buffer(b"")


def of_distinct(d: Definition, numbers: Numbers) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """From distinct words to the sizes of their lists of tokens and the tokens' numbers."""
    return in_pieces(d, numbers) if d.kind == "BPE" else remembered(function(d), numbers)


def arrow_tokens(d: Definition):
    """A UDF from the words of a row (array<string>) to its tokens in a row."""

    state: dict = {}

    def cut(words: pa.Array) -> pa.Array:
        fn, known = state["fn"], state["known"]
        out = []
        for row in words.to_pylist():
            if row is None:
                out.append(None)
                continue
            tokens: list[str] = []
            for w in row:
                t = known.get(w)
                if t is None:
                    if len(known) >= CACHE:
                        known.clear()
                    t = known[w] = fn(w)
                tokens += t
            out.append(tokens)
        return pa.array(out, pa.list_(pa.string()))

    @F.arrow_udf(ArrayType(StringType()))
    def run(words: pa.Array) -> pa.Array:
        if "fn" not in state:
            state["fn"], state["known"] = function(d), {}
        return in_slices(cut, words)

    return run


def prefixes(vocab: DataFrame, word: Column) -> DataFrame:
    """The tokens of vocab(token, ...) that a word begins with, shortest first."""
    return vocab.filter(word.startswith(F.col("token"))).orderBy(F.length("token"), "token")
