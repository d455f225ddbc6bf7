"""Definitions, kernels and the facade."""

# Short inputs and the results that a tokenizer of this format must give for them.

import itertools
import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wordloom import errors
from wordloom.errors import TokenizerError
from wordloom.operators import kernels
from wordloom.plans import fixtures
from wordloom.sources.definition import Definition, read_merges, register
from wordloom.streaming import encode as streaming
from wordloom.tokenizer import LONGEST, PAD_TO_MAX, EncodeOptions, Tokenizer, _kernel


def bpe(vocab, merges=(), **more):
    return {"model": {"type": "BPE", "vocab": {t: k for k, t in enumerate(vocab)}, "merges": [list(m) for m in merges], **more}}


@pytest.mark.parametrize(
    ("data", "code"),
    [
        (b"[1]", errors.INVALID_JSON),
        (b"{", errors.INVALID_JSON),
        (b"{}", errors.MISSING_MODEL),
        (b'{"model": {"type": "WordPiece", "vocab": {}}}', errors.MISSING_VOCAB),
        (b'{"model": {"type": "Unigram", "vocab": {"a": 1}}}', errors.MISSING_VOCAB),
        (b'{"model": {"type": "WordLevel", "vocab": {"a": 1}}}', errors.UNSUPPORTED_MODEL),
        (b'{"model": {}}', errors.UNSUPPORTED_MODEL),
    ],
)
def test_errors(data, code):
    with pytest.raises(TokenizerError) as e:
        Definition.from_bytes(data)
    assert e.value.code == code


@pytest.mark.parametrize("pattern", ["(unclosed", "*", "(?<"])
def test_bad_patterns(spark, pattern):
    split = {"type": "Split", "pattern": {"Regex": pattern}}
    for key, config, path in (("pre_tokenizer", split, "preTokenizer"), ("pre_tokenizer", {"type": "Sequence", "pretokenizers": [{"type": "Digits"}, split]}, "pretokenizers[1]"), ("decoder", {**split, "type": "Replace"}, "decoder"), ("normalizer", split, "normalizer")):
        with pytest.raises(TokenizerError, match=path.replace("[", r"\[").replace("]", r"\]")) as e:
            Definition.from_dict({**bpe("ab"), key: config})
        assert e.value.code == errors.INVALID_REGEX
    Definition.from_dict({**bpe("ab"), "pre_tokenizer": {"type": "Split", "pattern": {"Regex": "\\s+"}}})


def test_model_kinds():
    assert Definition.from_dict({"model": {"vocab": [["a", 0.5]]}}).kind == "Unigram"
    assert Definition.from_dict({"model": {"vocab": {"a": 1}, "merges": []}}).kind == "BPE"
    assert Definition.from_dict({"model": {"vocab": {"a": 1}}}).kind == "WordPiece"


def test_json_keeps_marks_in_strings(spark):
    mark = "﻿"
    data = b"\xef\xbb\xbf" + json.dumps(bpe(["a", "#", mark + "#", mark], [(mark, "#")])).encode()
    tok = Tokenizer.from_bytes(data)
    rows = spark.createDataFrame([("#",), (mark + "#",), (mark,)], "x string").select(tok.encode(F.col("x")).alias("ids")).collect()
    assert [r["ids"] for r in rows] == [[1], [2], [3]]
    assert Definition.from_bytes(b'{"model": {"vocab": {"a": 1, "a": 7}}}').vocab == {"a": 7}


def test_camel_case_hides_snake_case():
    d = Definition.from_dict({"model": {"type": "BPE", "vocab": {"a": 0}, "unkToken": None, "unk_token": "a", "byteFallback": True}})
    assert d.unk_token == "" and d.byte_fallback


def test_merges_and_added_tokens():
    assert read_merges([["a", "b"], "a b c", "ab", 5, ["a"]]) == [("a", "b"), ("a", "b c")]
    root = {**bpe("ab"), "added_tokens": [{"content": "<x>", "id": 9, "special": True}, {"content": "<xy>", "id": 10}, {"content": "n", "id": 11, "normalized": True}, {"content": "bad"}]}
    d = Definition.from_dict(root)
    assert d.markers == ["<xy>", "<x>"] and d.special == {"<x>"} and d.vocab["n"] == 11 and d.vocab_size == 5


def test_roles_and_lookups():
    tok = Tokenizer.from_dict(fixtures.wordpiece())
    d = tok.definition
    assert (d.role("pad"), d.role_id("cls"), d.role_id("mask")) == ("[PAD]", 2, 4)
    assert tok.token_for_id(3) == "[SEP]" and tok.id_for_token("nowhere") is None
    assert Definition.from_dict(bpe(["<s>", "a"])).role("cls") == "<s>"
    assert Definition.from_dict({"model": {"vocab": {"b": 1, "a": 1}}}).tokens_by_id == {1: "a"}


def test_wordpiece_vectors():
    d = Definition.from_dict({"model": {"type": "WordPiece", "vocab": {"play": 0, "##ing": 1, "##er": 2, "playing": 3, "[UNK]": 100}}})
    fn = kernels.function(d)
    assert fn("player") == ["play", "##er"] and fn("playing") == ["playing"] and fn("xplay") == ["[UNK]"]
    assert fn("a" * 200) == ["[UNK]"] and fn("") == []
    other = {"model": {"type": "WordPiece", "vocab": {"play": 0, "@@er": 2}, "unk_token": "<unk>", "continuing_subword_prefix": "@@", "max_input_chars_per_word": 8}}
    fn = kernels.function(Definition.from_dict(other))
    assert fn("player") == ["play", "@@er"] and fn("x") == ["<unk>"] and fn("playerplayer") == ["<unk>"]


def test_bpe_vectors():
    run = lambda w, *a, **k: kernels.function(Definition.from_dict(bpe(*a, **k)))(w)
    assert run("▁a🦜b", ["▁", "a", "b", "▁a", "▁ab"], [("▁", "a"), ("▁a", "b")]) == ["▁ab"]  # unknown characters vanish without an unknown token
    bytes_but_one = ["<unk>", "a", *(f"<0x{b:02X}>" for b in range(256) if b != 0xF0)]
    assert run("🦜ꙮ🦜", bytes_but_one, byte_fallback=True, unk_token="<unk>", fuse_unk=True) == ["<0xEA>", "<0x99>", "<0xAE>", "<unk>"]
    assert run("xy", ["<unk>", "a"], unk_token="<unk>", fuse_unk=True) == ["<unk>"]
    assert run("xy", ["<unk>", "a"], unk_token="<unk>") == ["<unk>", "<unk>"]
    assert run("ab", ["a", "b"], [("a", "b")]) == ["ab"]  # a merged piece need not be in the vocabulary
    assert run("abc", ["a", "b", "c", "abc"], ignore_merges=True) == ["abc"]
    assert run("aaa", ["a", "aa"], [("a", "a")]) == ["aa", "a"]


def test_unigram_vectors():
    run = lambda w, vocab, **k: kernels.function(Definition.from_dict({"model": {"type": "Unigram", "vocab": vocab, **k}}))(w)
    assert run("ab", [["<unk>", 0], ["a", -1], ["b", -1], ["ab", -2]]) == ["ab"]  # of equal scores the longest last piece
    assert run("axyb", [["<unk>", 0], ["a", -1], ["b", -1]]) == ["a", "<unk>", "b"]
    byte_vocab = [["<unk>", 0], ["a", -1], ["<0xC3>", -5], ["<0xA9>", -5]]
    assert run("aéa", byte_vocab, byte_fallback=True) == ["a", "<0xC3>", "<0xA9>", "a"]
    assert run("aüa", byte_vocab, byte_fallback=True) == ["a", "<unk>", "a"]
    assert run("", [["<unk>", 0]]) == []


def brute_unigram(d, word):
    """The best of all ways to cut a word."""
    import numpy as np

    score = {p: np.float32(s) for p, s in zip(d.pieces, d.scores, strict=True)}
    unk = np.float32(min(score.values()) - np.float32(10))
    best = None
    for cuts in itertools.product((0, 1), repeat=len(word) - 1):
        edges = [0, *(k + 1 for k, c in enumerate(cuts) if c), len(word)]
        parts = [word[a:b] for a, b in itertools.pairwise(edges)]
        if all(p in score or len(p) == 1 for p in parts):
            total = np.float32(0)
            for p in parts:
                total = np.float32(total + score.get(p, unk))
            # ties: compare the lengths of the pieces from the end, longer first
            key = (total, [len(p) for p in reversed(parts)])
            if best is None or key > best[0]:
                best = key, parts
    out = []
    for p in best[1]:
        if p in score:
            out.append(p)
        elif not out or out[-1] is not None:
            out.append(None)
    return [d.unk_token if p is None else p for p in out]


def brute_bpe(d, word):
    parts = kernels.bpe_symbols(d)(word)
    rank = {m: k for k, m in enumerate(d.merges)}
    while True:
        found = [(rank[p], k) for k, p in enumerate(itertools.pairwise(parts)) if p in rank]
        if not found:
            return parts
        _, k = min(found)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_kernels_against_brute_force(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("theinronadsx~é") for _ in range(rng.randint(1, 9))) for _ in range(300)})
    table = spark.createDataFrame([(w,) for w in [*words, "", "theintherein" * 3]], "word string")
    for config, brute in ((fixtures.unigram(), brute_unigram), (fixtures.bpe(), brute_bpe), (fixtures.bpe(True), brute_bpe), (fixtures.wordpiece(), None)):
        d = Definition.from_dict(config)
        fn = kernels.function(d)
        if brute:
            assert [fn(w) for w in words] == [brute(d, w) for w in words]
        got = {r["word"]: r["tokens"] for r in kernels.join_tokens(table, d).collect()}
        assert got == {w: fn(w) for w in got} and len(got) == len(words) + 2


def test_encoding_options(spark):
    tok = Tokenizer.from_dict(fixtures.wordpiece())
    x = spark.createDataFrame([("the ~ in",), ("",), (None,)], "x string")
    run = lambda o: [r["e"] for r in x.select(tok.encode_as_encoding(F.col("x"), o).alias("e")).collect()]
    full, empty, null = run(EncodeOptions())
    assert full["tokens"] == ["[CLS]", "the", "[UNK]", "in", "[SEP]"] and empty["ids"] == [2, 3] and null is None
    assert full["ids"][:1] == [2] and full["attention_mask"] == [1] * 5 and full["token_type_ids"] == [0] * 5
    assert run(EncodeOptions(add_special_tokens=False))[0]["tokens"] == ["the", "[UNK]", "in"]
    padded = run(EncodeOptions(max_length=7, padding=PAD_TO_MAX))[0]
    assert padded["tokens"][-2:] == ["[PAD]"] * 2 and padded["attention_mask"] == [1] * 5 + [0] * 2
    assert run(EncodeOptions(max_length=2, truncation=LONGEST))[0]["tokens"] == ["[CLS]", "the"]
    bare = Tokenizer.from_dict(bpe("ab"))
    e = spark.createDataFrame([("ab",)], "x string").select(bare.encode_as_encoding(F.col("x"), EncodeOptions(max_length=9, padding=PAD_TO_MAX)).alias("e")).first()["e"]
    assert e["ids"] == [0, 1]  # nothing to pad with


def test_added_tokens_and_decoding(spark):
    root = {**fixtures.bpe(True), "added_tokens": [{"content": "<|end|>", "id": 999, "special": True}]}
    tok = Tokenizer.from_dict(root)
    x = spark.createDataFrame([("the<|end|>é🦜 in",)], "x string")
    ids = x.select(tok.encode(F.col("x")).alias("ids"))
    assert 999 in ids.first()["ids"]
    assert ids.select(tok.decode(F.col("ids")).alias("t")).first()["t"] == "theé🦜in"
    assert ids.select(tok.decode(F.col("ids"), False).alias("t")).first()["t"] == "the<|end|>é🦜in"
    unknown = spark.createDataFrame([([1, 123456],)], "ids array<int>")
    assert unknown.select(tok.decode(F.col("ids")).alias("t")).first()["t"] == tok.token_for_id(1)


def test_ids_without_unknown_token(spark):
    tok = Tokenizer.from_dict(bpe("ab", [("a", "b")]))
    assert spark.createDataFrame([("ab",)], "x string").select(tok.encode(F.col("x")).alias("i")).first()["i"] == [-1]


def test_join_and_arrow_plans_agree(spark):
    rows = [(1, "the in there"), (2, ""), (3, None), (4, "[MASK] the é日 therein "), (5, "the in there")]
    x = spark.createDataFrame(rows, "id int, text string")
    for config in (fixtures.wordpiece(), fixtures.unigram(), fixtures.bpe(True)):
        tok = Tokenizer.from_dict(config)
        a = {r["id"]: (r["t"], r["i"]) for r in x.select("id", tok.tokenize(F.col("text")).alias("t"), tok.encode(F.col("text")).alias("i")).collect()}
        b = {r["id"]: (r["tokens"], r["ids"]) for r in tok.encode_by_join(x, "id").collect()}
        assert a == b


def test_normalizer_as_udf(spark):
    root = {**fixtures.bpe(), "normalizer": {"type": "NFKC"}}
    x = spark.createDataFrame([(1, "ﬁn the")], "id int, text string")
    tok = Tokenizer.from_dict(root)
    assert x.select(tok.tokenize(F.col("text")).alias("t")).first()["t"] == tok.encode_by_join(x, "id").first()["tokens"]
    marked = Tokenizer.from_dict({**root, "added_tokens": [{"content": "<x>", "id": 999}]})
    y = spark.createDataFrame([(1, "in<x>ﬁ ﬀ"), (2, ""), (3, None), (4, "<x><x>"), (5, "in")], "id int, text string")
    want = {1: ["in", "<x>", "f", "i", "f", "f"], 2: [], 3: None, 4: ["<x>", "<x>"], 5: ["in"]}
    assert {r["id"]: r["tokens"] for r in marked.encode_by_join(y, "id").collect()} == want
    assert {r["id"]: r["t"] for r in y.select("id", marked.tokenize(F.col("text")).alias("t")).collect()} == want


def test_patterns_that_match_nothing(spark):
    y = spark.createDataFrame([(1, "thexxin<x>th"), (2, ""), (3, None)], "id int, text string")
    for more in ({}, {"normalizer": {"type": "NFKC"}}):
        root = {**fixtures.bpe(), "pre_tokenizer": {"type": "Split", "pattern": {"Regex": "x*"}}, "added_tokens": [{"content": "<x>", "id": 999}], **more}
        tok = Tokenizer.from_dict(root)
        want = {1: ["the", "x", "x", "in", "<x>", "th"], 2: [], 3: None}
        assert {r["id"]: r["t"] for r in y.select("id", tok.tokenize(F.col("text")).alias("t")).collect()} == want
        assert {r["id"]: r["tokens"] for r in tok.encode_by_join(y, "id").collect()} == want


def test_data_source_and_sql_functions(spark, tmp_path):
    path = tmp_path / "tokenizer.json"
    path.write_text(json.dumps(fixtures.wordpiece()))
    register(spark)
    t = spark.read.format("tokenizer_json").load(str(path))
    tok = Tokenizer.from_file(str(path))
    assert t.count() == tok.vocab_size and t.filter("special").count() == 5
    tok.register(spark, "wp")
    assert spark.sql("SELECT wp_ids(wp_tokenize(array('the', 'therein'))) AS x").first()["x"]


def test_streams(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([(1, "the in", "2024-01-01 00:10:00"), (2, "there", "2024-01-01 02:00:00")], "id int, text string, at string").selectExpr("id", "text", "timestamp(at) AS at").write.parquet(folder)
    tok = Tokenizer.from_dict(fixtures.wordpiece())
    source = lambda: spark.readStream.schema("id int, text string, at timestamp").parquet(folder)
    out = streaming.run_once(streaming.encode_stream(source(), tok))
    assert out.count() == 2 and out.filter("id = 1").first()["encoding"]["tokens"] == ["[CLS]", "the", "in", "[SEP]"]
    counts = streaming.run_once(streaming.windowed_tokens(source(), tok, "at"))
    assert set(counts.columns) == {"window", "n_rows", "n_tokens"}


def test_prefixes(spark):
    vocab = spark.createDataFrame([("cat",), ("carp",), ("car",)], "token string")
    assert [r["token"] for r in kernels.prefixes(vocab, F.lit("carpooling")).collect()] == ["car", "carp"]


def test_decode_by_join_sends_the_vocabulary_and_cuts_once(spark):
    # the planner took the exploded ids for the smaller side, and computed them once more to filter rows
    tok = Tokenizer.from_dict(fixtures.wordpiece())
    x = spark.range(3).select(F.col("id").alias("doc_id"), F.element_at(F.array(F.lit("the in"), F.lit(""), F.lit(None)), F.col("id").cast("int") + 1).alias("text"))
    out = tok.decode_by_join(x.select("doc_id", tok.encode(F.col("text")).alias("ids")), "doc_id")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan and plan.count("ArrowEvalPython [") == 2
    assert [tuple(r) for r in out.collect()] == [(0, "the in")]


def test_join_plan_moves_each_word_of_a_text_once(spark):
    config = {**bpe(["<unk>", "a", "b", "ab", "\x1f", "<x>"], [["a", "b"]], unk_token="<unk>"), "pre_tokenizer": {"type": "Split", "pattern": {"String": " "}, "invert": True}}
    for added in ([], [{"id": 5, "content": "<x>", "special": True}]):
        tok = Tokenizer.from_dict({**config, "added_tokens": added})
        x = spark.createDataFrame([(1, "ab a ab <x> a\x1fb ab <x>"), (2, ""), (3, None), (4, "ab")], "id int, text string")
        rows = [(r["id"], r["word"], r["is_added"], r["at"]) for r in tok._words_of_texts(x, "id", "text").collect()]
        assert len(rows) == len({r[:3] for r in rows}) == 5 and (1, "ab", False, [0, 2, 5]) in rows
        want = {r["id"]: r["t"] for r in x.select("id", tok.tokenize(F.col("text"), False).alias("t")).collect()}
        assert {r["id"]: r["tokens"] for r in tok.encode_by_join(x, "id", add_special_tokens=False).collect()} == want


def test_join_plan_sends_the_vocabulary_to_the_words(spark):
    words = spark.createDataFrame([("there",), ("",)], "word string").distinct()
    for config in (fixtures.wordpiece(), fixtures.unigram(), fixtures.bpe(True, True)):
        plan = kernels.join_tokens(words, Definition.from_dict(config))._jdf.queryExecution().executedPlan().toString()
        # before, substrings and characters of all words were dealt by their text
        assert not any(f"hashpartitioning({by}#" in plan for by in ("token", "piece", "left")) and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("ignore_merges", [False, True])
def test_new_words_of_known_pieces_are_not_merged_again(monkeypatch, ignore_merges):
    definition = Definition.from_dict(fixtures.bpe(True, ignore_merges))
    plain, start, seen = kernels.bpe(definition), kernels.bpe_symbols(definition), []
    monkeypatch.setattr(kernels, "bpe_symbols", lambda d: lambda word: seen.append(word) or start(word))
    words = [f"nothing{k}ther{k}é中" for k in range(3000)] + ["thereof", "nothing", "", "中", "tionable"]
    rows = [[{"words": words, "is_added": False}], None, [], [{"words": ["thereof"], "is_added": True}, {"words": ["notionable"], "is_added": False}]]
    kind = pa.list_(pa.struct([("words", pa.list_(pa.string())), ("is_added", pa.bool_())]))
    got = _kernel(definition).func(pa.array(rows, kind)).to_pylist()
    assert got == [[t for w in words for t in plain(w)], None, [], ["thereof", *plain("notionable")]]
    assert len(seen) < len(words) / 4
