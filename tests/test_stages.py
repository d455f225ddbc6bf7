"""Vectors of single stages."""

# Short inputs and the results that a tokenizer of this format must give for them.
import unicodedata

import pytest
from pyspark.sql import functions as F

from wordloom.functions import text as T
from wordloom.operators import decoders, normalizers, post_processors, pre_tokenizers
from wordloom.operators.segment import segment
from wordloom.plans import fixtures


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("out")).first()["out"]


NORMAL = [
    ({"type": "Lowercase"}, "Ωmega", "ωmega"),
    ({"type": "Lowercase"}, "Häagen-Dazs", "häagen-dazs"),
    ({"type": "Prepend", "prepend": "▁"}, "", "▁"),
    ({"type": "BertNormalizer", "strip_accents": False}, "Häagen\tDazs", "häagen dazs"),
    ({"type": "BertNormalizer", "strip_accents": False}, "你好!", " 你  好 !"),
    ({"type": "BertNormalizer"}, "François", "francois"),
    ({"type": "BertNormalizer", "strip_accents": None, "lowercase": False}, "François\x00�​", "François"),
    ({"type": "Precompiled"}, "™g", "TMg"),
    ({"type": "Precompiled"}, "full-width～tilde", "full-width～tilde"),
    ({"type": "Precompiled", "precompiled_charsmap": "not base64"}, "a\u0001 b", "a b"),
    ({"type": "Strip"}, "\t\nHello\t\n", "Hello"),
    ({"type": "Strip", "strip_left": False}, "  hello  ", "  hello"),
    ({"type": "Strip", "strip_right": False}, "  hello  ", "hello  "),
    ({"type": "Strip", "strip_left": False, "strip_right": False}, "  hello  ", "  hello  "),
    ({"type": "Strip"}, "   ", ""),
    ({"type": "StripAccents"}, "ﬁé", "fié"),
    ({"type": "Replace", "pattern": {"String": " "}, "content": "▁"}, "a ́b", "a▁́b"),
    ({"type": "Replace", "pattern": {"String": " "}}, "a b", "a b"),
    ({"type": "Replace", "pattern": {"Regex": "(\\d)x"}, "content": "$1"}, "1x2x", "12"),
    ({"type": "Sequence", "normalizers": [{"type": "Unknown"}, {"type": "NFKC"}, {"type": "Lowercase"}]}, "Ａ", "a"),
]


@pytest.mark.parametrize(("config", "text", "want"), NORMAL)
def test_normalizers(spark, config, text, want):
    assert one(spark, normalizers.build(config)(F.col("x")), x=text) == want


@pytest.mark.parametrize("form", ["NFC", "NFD", "NFKC", "NFKD"])
def test_forms(spark, form):
    for text in ("é é ﬁ ① 한", "plain", ""):
        assert one(spark, normalizers.build({"type": form})(F.col("x")), x=text) == unicodedata.normalize(form, text)


def test_unknown_types_are_skipped():
    assert normalizers.build({"type": "Nmt"}) is None and normalizers.build(None) is None
    assert pre_tokenizers.build({"type": "UnicodeScripts"}) is None
    assert post_processors.build({"type": "None"}) is None and decoders.build({"type": "CTC"}) is None


def test_character_map(spark):
    entries = {"é".encode(): "e", "▁".encode(): " ", b"ab": "X", "①".encode(): "1"}
    assert normalizers.CharacterMap.read(fixtures.packed_map(entries)).entries() == entries
    stage = normalizers.build({"type": "Precompiled", "precompiled_charsmap": fixtures.packed_map(entries)})
    # a cluster takes its shortest known prefix, mark and all; longer clusters go character by character
    assert one(spark, stage(F.col("x")), x="é①ab▁́z") == "e1ab z"
    assert one(spark, stage(F.col("x")), x="▁́́́") == " ́́́"


SPLIT = [
    ({"type": "Whitespace"}, "   Hey,    friend,    what's up?  ", ["Hey,", "friend,", "what's", "up?"]),
    ({"type": "Punctuation"}, "Hey friend!     How are you?!?", ["Hey friend", "!", "     How are you", "?!?"]),
    ({"type": "BertPreTokenizer"}, "Hey friend!     How are you?!?", ["Hey", "friend", "!", "How", "are", "you", "?", "!", "?"]),
    ({"type": "Sequence", "pretokenizers": [{"type": "Whitespace"}, {"type": "Punctuation"}]}, "Hey friend!", ["Hey", "friend", "!"]),
    ({"type": "ByteLevel"}, "Hey friend!     How are you?!?", ["Hey", "Ġfriend", "!", "ĠĠĠĠ", "ĠHow", "Ġare", "Ġyou", "?!?"]),
    ({"type": "ByteLevel", "add_prefix_space": True}, "Hey friend!", ["ĠHey", "Ġfriend", "Ġ!"]),
    ({"type": "ByteLevel", "use_regex": False}, "Hey friend!", ["HeyĠfriend!"]),
    ({"type": "ByteLevel", "use_regex": False}, "", [""]),
    ({"type": "Metaspace", "replacement": "▁"}, "Hello world", ["▁Hello", "▁world"]),
    ({"type": "Metaspace", "replacement": "▁"}, "▁Hello", ["▁Hello"]),
    ({"type": "Metaspace", "replacement": "▁"}, "", []),
    ({"type": "Metaspace", "replacement": "▁", "prepend_scheme": "never"}, "Hello world", ["Hello", "▁world"]),
    ({"type": "Metaspace", "replacement": "▁", "add_prefix_space": False}, "Hello", ["Hello"]),
    ({"type": "Metaspace", "replacement": "▁", "prepend_scheme": "first"}, "Hello", ["▁Hello"]),
    ({"type": "Split", "pattern": {"String": " "}}, "Hey friend!", ["Hey", " ", "friend!"]),
    ({"type": "Split", "pattern": {"String": " "}, "invert": True}, "Hey friend!", ["Hey", "friend!"]),
    ({"type": "Split", "pattern": {"String": " "}}, "", [""]),
    ({"type": "Split", "pattern": {"Regex": "\\s"}}, "Hey  you", ["Hey", " ", " ", "you"]),
    ({"type": "Split", "pattern": {"Regex": "\\s"}}, "", []),
    ({"type": "Split", "pattern": {"Regex": "x*"}}, "axxb", ["a", "xx", "b"]),
    ({"type": "Split", "pattern": {"Regex": "(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\\r\\n\\p{L}\\p{N}]?\\p{L}+|\\p{N}{1,3}| ?[^\\s\\p{L}\\p{N}]+[\\r\\n]*|\\s*[\\r\\n]+|\\s+(?!\\S)|\\s+"}}, "Hey friend!     How are you?!?", ["Hey", " friend", "!", "    ", " How", " are", " you", "?!?"]),
    ({"type": "Split"}, "a b", ["a b"]),
    ({"type": "Digits"}, "1 12 123! 1234abc", ["1", " ", "12", " ", "123", "! ", "1234", "abc"]),
    ({"type": "Digits", "individual_digits": True}, "1 12 123!", ["1", " ", "1", "2", " ", "1", "2", "3", "!"]),
]


@pytest.mark.parametrize(("config", "text", "want"), SPLIT)
def test_pre_tokenizers(spark, config, text, want):
    assert one(spark, pre_tokenizers.build(config)(F.col("x")), x=text) == want


def test_first_section_flag(spark):
    stage = pre_tokenizers.build({"type": "Metaspace", "replacement": "▁", "prepend_scheme": "first"}, first=False)
    assert one(spark, stage(F.col("x")), x="Hello world") == ["Hello", "▁world"]


def test_segments(spark):
    got = one(spark, segment(F.col("x"), ["<s>long", "<s>"]), x="a<s>b<s>long<s>")
    assert [(r["piece"], r["is_added"]) for r in got] == [("a", False), ("<s>", True), ("b", False), ("<s>long", True), ("<s>", True)]
    assert one(spark, segment(F.col("x"), ["[a]"]), x="")[0]["piece"] == ""


def item(kind, name):
    return {kind: {"id": name, "type_id": 0}}


POST = [
    ({"type": "TemplateProcessing", "single": [item("SpecialToken", "[C]"), item("Sequence", "A")], "pair": [item("Sequence", "A"), item("SpecialToken", "[S]"), item("Sequence", "B")]}, ["a"], None, True, ["[C]", "a"]),
    ({"type": "TemplateProcessing", "single": [item("SpecialToken", "[C]"), item("Sequence", "A")], "pair": [item("Sequence", "A"), item("SpecialToken", "[S]"), item("Sequence", "B")]}, ["a"], ["b"], False, ["a", "b"]),
    ({"type": "BertProcessing", "cls": ["[CLS]", 0], "sep": ["[SEP]", 1]}, ["a", "b"], ["c", "d"], True, ["[CLS]", "a", "b", "[SEP]", "c", "d", "[SEP]"]),
    ({"type": "BertProcessing", "cls": ["[CLS]", 0], "sep": ["[SEP]", 1]}, ["a"], [], True, ["[CLS]", "a", "[SEP]"]),
    ({"type": "BertProcessing", "cls": ["[CLS]", 0], "sep": ["[SEP]", 1]}, ["a"], ["c"], False, ["a", "c"]),
    ({"type": "RobertaProcessing", "cls": ["<s>", 0], "sep": ["</s>", 1]}, ["  a  ", " b", "   ", " "], ["c"], True, ["<s>", " a ", " b", "", " ", "</s>", "</s>", "c", "</s>"]),
    ({"type": "RobertaProcessing", "cls": ["<s>", 0], "sep": ["</s>", 1], "add_prefix_space": False}, ["  a  "], None, True, ["<s>", "a", "</s>"]),
    ({"type": "RobertaProcessing", "cls": ["<s>", 0], "sep": ["</s>", 1], "trim_offset": False}, ["  a  "], None, True, ["<s>", "  a  ", "</s>"]),
    ({"type": "RobertaProcessing", "cls": ["<s>", 0], "sep": ["</s>", 1]}, ["  a  "], ["b"], False, ["  a  ", "b"]),
    ({"type": "Sequence", "processors": [{"type": "ByteLevel"}, {"type": "BertProcessing", "cls": ["[CLS]", 0], "sep": ["[SEP]", 1]}]}, ["a"], ["b"], True, ["[CLS]", "a", "b", "[SEP]"]),
]


@pytest.mark.parametrize(("config", "tokens", "pair", "special", "want"), POST)
def test_post_processors(spark, config, tokens, pair, special, want):
    column = post_processors.build(config)(F.col("a"), None if pair is None else F.col("b"), special)
    assert one(spark, column, a=tokens, b=pair or []) == want


DECODE = [
    ({"type": "WordPiece", "prefix": "##", "cleanup": True}, ["who", "do", "##n't", "does", "n't", "can't"], "who don't doesn't can't"),
    ({"type": "WordPiece", "prefix": "##"}, ["##a", "b", "##c", "!"], "##a bc !"),
    ({"type": "Replace", "pattern": {"String": "_"}, "content": " "}, ["a_b", "_c"], "a b c"),
    ({"type": "Fuse"}, [], ""),
    ({"type": "Strip", "content": "_", "start": 1, "stop": 1}, ["__a__", "b"], "_a_b"),
    ({"type": "Strip", "content": ".$", "start": 2}, [".$.$.$a"], ".$a"),
    ({"type": "Metaspace", "replacement": "▁", "prepend_scheme": "always"}, ["▁Hey▁", "▁you"], "Hey you"),
    ({"type": "Metaspace", "replacement": "▁", "prepend_scheme": "never"}, ["▁Hey", "▁you"], " Hey you"),
    ({"type": "Metaspace"}, ["_Hey", "_you"], "Hey you"),
    ({"type": "ByteLevel"}, ["Ġh", "Ã©", "你", "Ã", "Ā"], " hé你"),
    ({"type": "ByteLevel"}, ["aĀb"], "a\x00b"),
    ({"type": "ByteFallback"}, ["<0xC3>", "<0xA9>", "x", "<0xC3>", "y", "<0xZZ>"], "éxy<0xZZ>"),
    ({"type": "Sequence", "decoders": [{"type": "Replace", "pattern": {"String": "▁"}, "content": " "}, {"type": "ByteFallback"}, {"type": "Fuse"}, {"type": "Strip", "content": " ", "start": 1}]}, ["▁a", "<0x21>"], "a!"),
]


@pytest.mark.parametrize(("config", "tokens", "want"), DECODE)
def test_decoders(spark, config, tokens, want):
    assert one(spark, F.array_join(decoders.build(config)(F.col("x")), ""), x=tokens) == want


def test_byte_table(spark):
    chars = [T.byte_character(b) for b in range(256)]
    assert len(set(chars)) == 256 and all(c.isprintable() and not c.isspace() for c in chars)
    text = "".join(map(chr, range(1, 0x250))) + "你🦜"
    encoded = one(spark, T.byte_level(F.col("x")), x=text)
    assert encoded == "".join(T.byte_character(b) for b in text.encode())
    assert one(spark, T.byte_level_bytes(F.col("x")), x=encoded) == text.encode()


def test_text_functions(spark):
    assert one(spark, T.characters(F.col("x")), x="") == []
    assert one(spark, T.characters(F.col("x")), x="a🦜") == ["a", "🦜"]
    assert one(spark, T.graphemes(F.col("x")), x="éa") == ["é", "a"]
    assert one(spark, T.byte_pieces(F.col("x")), x="é") == ["<0xC3>", "<0xA9>"]
    assert one(spark, T.from_code_point(F.ascii("x")), x="🦜") == "🦜"


def test_registered_stage(spark):
    normalizers.REGISTERED["Shout"] = F.upper
    try:
        assert one(spark, normalizers.build({"type": "Shout"})(F.col("x")), x="a") == "A"
    finally:
        del normalizers.REGISTERED["Shout"]


@pytest.mark.parametrize(
    "pattern,text,words",
    [
        (r"(a|b)\1", "xaabby", ["x", "aa", "bb", "y"]),
        ("(?=x)", "axbx", ["axbx"]),
        (r"\Qa.b\E", "xa.bya-b", ["x", "a.b", "ya-b"]),
        ("x*", "axxb", ["a", "xx", "b"]),
        (r"\b", "one two", ["one two"]),
        ("(?<=a)(b)?", "abac", ["a", "b", "ac"]),
        (r"\s", "", []),
    ],
)
def test_split_patterns(spark, pattern, text, words):
    stage = pre_tokenizers.build({"type": "Split", "pattern": {"Regex": pattern}})
    assert one(spark, stage(F.col("t")), t=text) == words
    # beside added tokens, as the stage of a sequence
    nested = pre_tokenizers.build({"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": pattern}}, {"type": "Split", "pattern": {"Regex": "z*"}}]})
    assert one(spark, nested.each(F.col("a")), a=[text, text]) == [words, words]


def test_byte_run_marks_in_tokens(spark):
    stage = decoders.build({"type": "ByteLevel"})
    assert one(spark, stage(F.col("a")), a=["Ã", "©", "\ufdd2C3A9", "a"]) == ["é", "\ufdd2C3A9", "a"]


def test_character_map_looks_for_graphemes_only_where_they_may_be(monkeypatch):
    import random

    import regex

    entries = {k.encode(): v for k, v in {"é": "e", "ß": "ss", "|": "/", "e": "E", "e\u0301": "x", "①": "1", "\r": "R", "\n": "N", "가": "ga", "\u0600": "p"}.items()}

    def plainly(text):
        shortest = lambda key: next((entries[key[:k]] for k in range(1, len(key) + 1) if key[:k] in entries), None)
        out = []
        for cluster in regex.findall(r"\X", text):
            whole = shortest(cluster.encode()) if len(cluster.encode()) < 6 else None
            out += [whole] if whole is not None else [c if (one := shortest(c.encode())) is None else one for c in cluster]
        return "".join(out)

    run, draw = normalizers.mapped(entries), random.Random(1)
    letters = ["e", "a", " ", "|", "\u0301", "é", "ß", "\r", "\n", "①", "가", "ᄀ", "ᅡ", "\u0600", "🇩", "🇪", "👩", "\u200d", "\x00", "x"]
    for _ in range(5000):
        text = "".join(draw.choices(letters, k=draw.randrange(9)))
        assert run(text) == plainly(text), text
    seen, find = [], regex.findall
    monkeypatch.setattr(normalizers.regex, "findall", lambda p, t: seen.append(len(t)) or find(p, t))
    text = "plain taxt " * 1000 + "é!" + " plain" * 1000
    assert run(text) == text.replace("e", "E").replace("é", "e") and sum(seen) < 100


def test_slices_bound_what_a_udf_holds():
    import pyarrow as pa

    from wordloom.operators import stage

    rows = pa.array([["x" * (k % 97)] * (k % 300) if k % 7 else None for k in range(3000)], pa.list_(pa.string()))
    seen = []
    out = stage.in_slices(lambda part: seen.append(part.nbytes) or part, rows)
    assert out.equals(rows) and len(seen) > 1 and max(seen) <= stage.SLICE
    assert stage.in_slices(lambda part: part, rows.slice(0, 0)).equals(rows.slice(0, 0))
    assert stage.in_slices(lambda part: part, pa.array(["x" * stage.SLICE, "y" * stage.SLICE])).to_pylist() == ["x" * stage.SLICE, "y" * stage.SLICE]
