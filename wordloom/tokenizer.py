"""The tokenizer: a definition compiled into Columns and DataFrame plans."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from .functions.text import byte_token
from .operators import decoders, kernels, normalizers, post_processors, pre_tokenizers
from .operators.segment import segment
from .operators.stage import in_slices
from .sources.definition import Definition

NO_PADDING, PAD_TO_MAX = "none", "max_length"
NO_TRUNCATION, LONGEST = "none", "longest"
#: Between tokens that travel as one string.
_UNIT = "\x1f"


@dataclass(frozen=True)
class EncodeOptions:
    """How an encoding is cut and filled."""

    max_length: int = 0
    padding: str = NO_PADDING
    truncation: str = NO_TRUNCATION
    add_special_tokens: bool = True


class Tokenizer:
    """Column functions of one definition.

    The functions on Columns work row by row: no row leaves its task, so they fit streams and tables of any size.
    ``encode_by_join`` is the plan by distinct words.
    """

    def __init__(self, definition: Definition):
        self.definition = definition
        self.normalize = normalizers.build(definition.normalizer)
        self.pre_tokenize = pre_tokenizers.build(definition.pre_tokenizer)
        self.post_process = post_processors.build(definition.post_processor) or post_processors.plain
        self.decoder = decoders.build(definition.decoder)

    @classmethod
    def from_file(cls, path: str) -> "Tokenizer":
        return cls(Definition.from_file(path))

    @classmethod
    def from_bytes(cls, data: bytes) -> "Tokenizer":
        return cls(Definition.from_bytes(data))

    @classmethod
    def from_dict(cls, root: dict) -> "Tokenizer":
        return cls(Definition.from_dict(root))

    # --- words: texts cut into segments, normalized and pre-tokenized ---

    def words(self, c: Column) -> Column:
        """array<struct<words, is_added>> of a text, one for each segment."""
        segs = segment(c, self.definition.markers)
        pieces = F.transform(segs, lambda s: s["piece"])
        if self._native():
            # no lambda within a lambda may use the outer one's variable: Spark does not evaluate UDFs of such arrays
            return F.transform(segs, lambda s: F.struct(self._cut(s["piece"], s["is_added"]).alias("words"), s["is_added"].alias("is_added")))
        normal = self.normalize.each(pieces) if self.normalize else pieces
        if self.pre_tokenize is None:
            cut = F.transform(normal, F.array)
        else:
            cut = self.pre_tokenize.each(normal) if self.definition.markers or self.pre_tokenize.native else F.array(self.pre_tokenize(F.get(normal, F.lit(0))))
        # markers stay as they are, and an empty text has no word
        kept = F.zip_with(segs, cut, lambda s, w: F.when(s["is_added"], F.array(s["piece"])).when(s["piece"] == "", F.array().cast("array<string>")).otherwise(w))
        return F.zip_with(segs, kept, lambda s, w: F.struct(w.alias("words"), s["is_added"].alias("is_added")))

    def _native(self) -> bool:
        """Whether all stages before the kernel are expressions."""
        return all(stage is None or stage.native for stage in (self.normalize, self.pre_tokenize))

    def _cut(self, piece: Column, is_added: Column) -> Column:
        own = self.normalize(piece) if self.normalize else piece
        words = self.pre_tokenize(own) if self.pre_tokenize else F.array(own)
        return F.when(is_added, F.array(piece)).when(piece == "", F.array().cast("array<string>")).otherwise(words)

    def word_rows(self, df: DataFrame, text: str = "text", keys: tuple[str, ...] = ()) -> DataFrame:
        """df -> keys, word_pos, word, is_added: a row for each word; word_pos orders the words of a text."""
        segs = df.select(*keys, F.posexplode(segment(F.col(text), self.definition.markers)).alias("seg_pos", "s"))
        cut = self._cut(F.col("s.piece"), F.col("s.is_added"))
        rows = segs.select(*keys, "seg_pos", "s.is_added", F.posexplode(cut).alias("p", "word"))
        return rows.select(*keys, (F.col("seg_pos").cast("long") * (1 << 32) + F.col("p")).alias("word_pos"), "word", "is_added")

    # --- encoding ---

    def tokenize(self, c: Column, add_special_tokens: bool = True) -> Column:
        """array<string>: the tokens of a text; null for null."""
        words = self.words(c)
        return F.when(c.isNull(), F.lit(None)).otherwise(self.post_process(_kernel(self.definition)(words), None, add_special_tokens))

    def ids_of(self, tokens: Column) -> Column:
        return _lookup(self.definition)(tokens)

    def encode(self, c: Column, add_special_tokens: bool = True) -> Column:
        """array<int>: the ids of a text; -1 for what has none."""
        return self.ids_of(self.tokenize(c, add_special_tokens))

    def encode_as_encoding(self, c: Column, options: EncodeOptions = EncodeOptions()) -> Column:
        """struct<ids, tokens, attention_mask, token_type_ids>."""
        return self.encoding(self.tokenize(c, options.add_special_tokens), options)

    def encoding(self, tokens: Column, options: EncodeOptions = EncodeOptions()) -> Column:
        if options.truncation == LONGEST and options.max_length > 0:
            tokens = F.slice(tokens, 1, options.max_length)
        ids, n = self.ids_of(tokens), F.size(tokens)
        missing = F.lit(0)
        pad = self.definition.role("pad")
        if options.padding == PAD_TO_MAX and pad is not None and self.definition.role_id("pad") >= 0:
            missing = F.greatest(F.lit(0), F.lit(options.max_length) - n)
        fill = lambda a, v: F.concat(a, F.array_repeat(F.lit(v), missing))
        encoding = F.struct(
            fill(ids, self.definition.role_id("pad")).alias("ids"),
            fill(tokens, pad or "").alias("tokens"),
            fill(F.array_repeat(F.lit(1), n), 0).alias("attention_mask"),
            fill(F.array_repeat(F.lit(0), n), 0).alias("token_type_ids"),
        )
        return F.when(tokens.isNull(), F.lit(None)).otherwise(encoding)

    def tokens_by_join(self, df: DataFrame, key: str, text: str = "text") -> DataFrame:
        """df(key, text) -> key, tokens (without special tokens around them), by distinct words and without Python
        where the stages allow. Texts without a word have no row."""
        words = kernels.join_tokens(self.word_rows(df, text).filter(~F.col("is_added") & F.col("word").isNotNull()).select("word").distinct(), self.definition)
        # tokens travel as one string, but for those that hold the separator, and lists without a token
        plain = (F.size("tokens") > 0) & ~F.array_join("tokens", "").contains(_UNIT)
        words = words.select("word", F.lit(False).alias("is_added"), F.when(~plain, F.col("tokens")).alias("tokens"), F.when(plain, F.array_join("tokens", _UNIT)).alias("joined"))
        both = self._words_of_texts(df, key, text).join(words, ["word", "is_added"], "left")
        part = F.struct("at", F.when(F.col("is_added"), F.array("word")).otherwise(F.col("tokens")).alias("tokens"), "joined")
        lists = both.groupBy(key).agg(F.collect_list(part).alias("parts"))
        tokens = lambda p: F.coalesce(p["tokens"], F.split(p["joined"], _UNIT))
        spread = F.flatten(F.transform("parts", lambda p: F.arrays_zip(p["at"].alias("at"), F.array_repeat(tokens(p), F.size(p["at"])).alias("tokens"))))
        return lists.select(key, F.flatten(F.transform(F.array_sort(spread), lambda p: p["tokens"])).alias("tokens"))

    def _words_of_texts(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """df -> key, word, is_added, at: a row for each distinct word of a text, with its places. Words are sorted within
        their row, so that only distinct ones are moved."""
        segs = self.words(F.col(text))
        if self.definition.markers:
            zipped = F.flatten(F.transform(segs, lambda s: F.arrays_zip(s["words"].alias("word"), F.array_repeat(s["is_added"], F.size(s["words"])).alias("is_added"))))
            units = F.transform(zipped, lambda x, k: F.struct(x["word"].alias("word"), x["is_added"].alias("is_added"), k.alias("at")))
        else:
            units = F.transform(F.get(segs, F.lit(0))["words"], lambda w, k: F.struct(w.alias("word"), F.lit(False).alias("is_added"), k.alias("at")))
        rows = df.select(key, F.array_sort(units).alias("units"))
        n, what = F.size("units"), lambda k: F.struct(F.get("units", k)["word"], F.get("units", k)["is_added"])
        starts = F.filter(F.sequence(F.lit(1), n), lambda k: (k == 1) | (what(k - 2) != what(k - 1)))
        rows = rows.select(key, "units", F.when(n > 0, starts).alias("starts"))

        def run(start: Column, k: Column) -> Column:
            first, end = F.get("units", start - 1), F.coalesce(F.get("starts", k + 1), n + 1)
            return F.struct(first["word"].alias("word"), first["is_added"].alias("is_added"), F.slice("units", start, end - start)["at"].alias("at"))

        # the outer form is not computed once more for a filter
        runs = rows.select(key, F.explode_outer(F.transform("starts", run)).alias("r"))
        return runs.select(key, "r.word", "r.is_added", "r.at").filter(F.col("word").isNotNull())

    def encode_by_join(self, df: DataFrame, key: str, text: str = "text", add_special_tokens: bool = True) -> DataFrame:
        """df(key, text) -> key, tokens, ids; a row for each row of df, and null for null texts."""
        found = self.tokens_by_join(df.filter(F.col(text).isNotNull()), key, text)
        tokens = F.coalesce("tokens", F.array().cast("array<string>"))
        out = df.select(key, F.col(text).isNull().alias("absent")).join(found, key, "left")
        out = out.select(key, F.when(~F.col("absent"), self.post_process(tokens, None, add_special_tokens)).alias("tokens"))
        return out.withColumn("ids", self.ids_of(F.col("tokens")))

    # --- decoding ---

    def decode(self, ids: Column, skip_special_tokens: bool = True) -> Column:
        """The text of an array of ids; unknown ids are left out."""
        if self.decoder is decoders.byte_level:
            return _byte_texts(self.definition, skip_special_tokens)(ids)
        return F.array_join(self.decode_tokens(_tokens(self.definition, skip_special_tokens)(ids)), "")

    def decode_tokens(self, tokens: Column) -> Column:
        return self.decoder(tokens) if self.decoder else tokens

    def decode_by_join(self, df: DataFrame, key: str, ids: str = "ids", skip_special_tokens: bool = True) -> DataFrame:
        """df(key, ids) -> key, text, by joins with the vocabulary; a row for each key with an id that is known."""
        d = self.definition
        rows = [(i, t, t in d.special) for i, t in sorted(d.tokens_by_id.items())]
        vocab = df.sparkSession.createDataFrame(rows, "id int, token string, special boolean")
        vocab = vocab.filter("NOT special") if skip_special_tokens else vocab
        # the outer form, since the planner filters what the other one explodes first and computes ids twice for it; the
        # vocabulary has a hint, as the planner knows neither side's size and may send all ids to the driver
        spread = df.select(key, F.posexplode_outer(ids).alias("pos", "id")).join(F.broadcast(vocab), "id")
        lists = spread.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("ts"))
        return lists.select(key, F.array_join(self.decode_tokens(F.transform("ts", lambda t: t["token"])), "").alias("text"))

    # --- lookups and properties ---

    def id_for_token(self, token: str) -> int | None:
        return self.definition.vocab.get(token)

    def token_for_id(self, number: int) -> str | None:
        return self.definition.tokens_by_id.get(number)

    def vocab_table(self, spark: SparkSession) -> DataFrame:
        return self.definition.vocab_table(spark)

    @property
    def vocab_size(self) -> int:
        return self.definition.vocab_size

    def register(self, spark: SparkSession, name: str) -> None:
        """SQL functions ``<name>_word_tokens`` of the words of a text, ``<name>_ids`` of tokens, and ``<name>_tokens`` of ids.

        The stages before and after them are expressions, which SQL functions cannot hold: ``tokenize``, ``encode`` and ``decode``
        are for Columns, and a view on them for SQL. ``<name>_tokenize`` is the older name of the first.
        """
        for kind in ("tokenize", "word_tokens"):
            spark.udf.register(f"{name}_{kind}", kernels.arrow_tokens(self.definition))
        spark.udf.register(f"{name}_ids", _lookup(self.definition))
        spark.udf.register(f"{name}_tokens", _tokens(self.definition, True))


def _kernel(d: Definition):
    """A UDF from array<struct<words, is_added>> to tokens. A slice's distinct words are cut once, and a worker remembers them;
    the tokens of all words are then gathered by number."""
    state: dict = {}

    def tokens_of(segments: pa.Array) -> pa.Array:
        numbers = state["numbers"]
        rows, parts = _offsets(segments)
        lists, added = parts.field("words"), parts.field("is_added")
        spans, words = _offsets(lists)
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        sizes, tokens = state["cut"](coded.dictionary)
        marked = np.repeat(added.to_numpy(zero_copy_only=False).astype(bool), np.diff(spans))
        if marked.any():
            # an added token is its own token, whatever the model makes of it as a word
            which, places = np.unique(codes[marked], return_inverse=True)
            own = [numbers[w] for w in coded.dictionary.take(pa.array(which)).to_pylist()]
            codes = codes.copy()
            codes[marked] = len(sizes) + places
            sizes = np.concatenate((sizes, np.ones(len(own), dtype=np.int64)))
            tokens = np.concatenate((tokens, np.array(own, dtype=np.int64)))
        ends, tokens = kernels.picked(sizes, tokens, codes)
        return _lists(segments, ends[spans[rows]], pa.array(list(numbers), pa.string()).take(pa.array(tokens)))

    @F.arrow_udf(ArrayType(StringType()))
    def run(segments: pa.Array) -> pa.Array:
        if "cut" not in state:
            state["numbers"] = kernels.Numbers()
            state["cut"] = kernels.of_distinct(d, state["numbers"])
        return in_slices(tokens_of, segments)

    return run


def _offsets(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets and values of an array of lists, beginning at 0; null lists are empty."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), lists.flatten()


def _gathered(rows: pa.Array, bounds: np.ndarray, codes: np.ndarray, lists: list[list], kind: pa.DataType) -> pa.Array:
    """One list a row: bounds cut the codes into rows, and each code stands for one of the lists. Null rows stay null."""
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    values = pa.array([x for one in lists for x in one], kind)
    ends, places = kernels.picked(sizes, np.arange(len(values)), codes)
    return _lists(rows, ends[bounds], values.take(pa.array(places)))


def _lists(rows: pa.Array, offsets: np.ndarray, values: pa.Array) -> pa.Array:
    mask = rows.is_null() if rows.null_count else None
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values, mask=mask)


def _lookup(d: Definition):
    """A UDF from tokens to ids: the unknown token's id for those without, or else -1."""
    vocab, default = d.vocab, d.unk_token_id

    def ids_of(tokens: pa.Array) -> pa.Array:
        offsets, values = _offsets(tokens)
        coded = values.dictionary_encode()
        ids = np.array([vocab.get(t, default) for t in coded.dictionary.to_pylist()] + [default], dtype=np.int32)
        codes = coded.indices.fill_null(len(ids) - 1).to_numpy(zero_copy_only=False)
        return _lists(tokens, offsets, pa.array(ids[codes], pa.int32()))

    @F.arrow_udf(ArrayType(IntegerType()))
    def run(tokens: pa.Array) -> pa.Array:
        return in_slices(ids_of, tokens)

    return run


def _known(rows: pa.Array, by_id: dict) -> tuple[np.ndarray, np.ndarray, list]:
    """Of arrays of ids: the bounds of the rows among the known ids, their codes, and what each code stands for."""
    offsets, values = _offsets(rows)
    coded = values.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    there = np.array([i in by_id for i in distinct] + [False], dtype=bool)
    codes = coded.indices.fill_null(len(distinct)).to_numpy(zero_copy_only=False)
    held = there[codes]
    bounds = np.concatenate(([0], np.cumsum(held)))[offsets]
    return bounds, codes[held], [by_id.get(i) for i in distinct]


def _tokens(d: Definition, skip_special: bool):
    """A UDF from ids to tokens; unknown ids are left out."""
    by_id = {i: t for i, t in d.tokens_by_id.items() if not (skip_special and t in d.special)}

    def tokens_of(ids: pa.Array) -> pa.Array:
        bounds, codes, tokens = _known(ids, by_id)
        return _gathered(ids, bounds, codes, [[t] if t is not None else [] for t in tokens], pa.string())

    @F.arrow_udf(ArrayType(StringType()))
    def run(ids: pa.Array) -> pa.Array:
        return in_slices(tokens_of, ids)

    return run


def _byte_texts(d: Definition, skip_special: bool):
    """A UDF from ids to the text of a byte-level model: neighbouring tokens of bytes are one text, empty if it is not UTF-8;
    other tokens are texts of their own."""
    by_id = {i: byte_token(t) for i, t in d.tokens_by_id.items() if not (skip_special and t in d.special)}

    def text(parts: list) -> str:
        out = []
        for is_bytes, run in groupby(parts, lambda p: isinstance(p, bytes)):
            if not is_bytes:
                out += run
                continue
            try:
                out.append(b"".join(run).decode("utf-8"))
            except UnicodeDecodeError:
                pass
        return "".join(out)

    def texts_of(ids: pa.Array) -> pa.Array:
        bounds, codes, parts = _known(ids, by_id)
        lacks = ids.is_null().to_pylist()
        plain = all(isinstance(p, bytes) for p in parts if p is not None)
        codes = codes.tolist()
        out = []
        for k, absent in enumerate(lacks):
            own = [parts[c] for c in codes[bounds[k] : bounds[k + 1]]]
            if absent:
                out.append(None)
                continue
            if plain:
                try:
                    out.append(b"".join(own).decode("utf-8"))
                except UnicodeDecodeError:
                    out.append("")
                continue
            out.append(text(own))
        return pa.array(out, pa.string())

    @F.arrow_udf(StringType())
    def run(ids: pa.Array) -> pa.Array:
        return in_slices(texts_of, ids)

    return run
