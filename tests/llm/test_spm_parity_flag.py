"""A wrongly rebuilt model is seen: parity is false where the reference's ids replace its own."""

import sentencepiece

from wordloom.llm import spm, spm_model

TEXTS = ["plain words here", "two  blanks in a row", "", "plain again"]


def test_parity_of_the_right_model(spark):
    rows = spark.createDataFrame([*enumerate(TEXTS), (9, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["parity"] for r in spm.encode(rows, verify=True).collect()}
    assert got == {0: True, 1: True, 2: True, 3: True, 9: None}


def test_parity_of_a_wrong_model():
    data = open(spm_model.DEFAULT_MODEL, "rb").read()
    codec, exact = spm.Codec(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    m = spm_model.parse(data)
    k = next(i for i, (p, _, _) in enumerate(m.pieces) if p == "▁words")
    # the rebuilt model has another piece in the place of this one
    m.pieces[k] = ("▁qzqzqz", *m.pieces[k][1:])
    codec.bare, codec.whole = spm.build(m, normalise=False), spm.build(m)
    sizes, ids, _, same = codec.encode_array([*TEXTS, "two  words"])
    assert same.tolist() == [False, True, True, True, False]
    assert ids.tolist() == [i for t in [*TEXTS, "two  words"] for i in exact.encode(t)]
