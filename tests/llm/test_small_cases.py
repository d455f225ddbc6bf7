"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import math

import pytest
from pyspark.sql import functions as F

from wordloom.llm import ann, langid, licenses, mixing, pii, quality, simhash, spm, warc, wrappers

LONG = "wort und worte " * 40_000
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, size string, h int, kept_id int, target int, count int, word int"


def docs(spark, rows):
    """Documents with further columns that the operators use for themselves."""
    full = [(d, t, lang, s, None if t is None else len(t), "x", "y", 1, 2, 3, 4, 5) for d, t, lang, s in rows]
    return spark.createDataFrame(full, DOCS)


TEXT = "This is a plain english text with enough words that every rule can look at it and keep the document as it is."
ROWS = [(1, TEXT, "en", "a"), (1, TEXT, "en", "a"), (2, None, None, None), (3, "", "en", "b"), (None, "x", "en", "b"), (5, LONG, "de", "a"), (6, " \n\t", None, "c"), (7, "12 !! 34", "en", "a")]


@pytest.fixture(scope="module")
def some(spark):
    return docs(spark, ROWS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


def test_langid(spark, some, none):
    got = langid.predict(some, langid.fit(some)).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got}
    assert all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 for k in (2, 3, 6, 7))
    # doc_id 5 is held out, so English is all there is to learn
    assert by[5]["lang_pred"] == "en" and 0 <= by[5]["score"] <= 1
    assert langid.predict(none, langid.fit(none)).collect() == []
    assert {r["lang_pred"] for r in langid.predict(some, langid.fit(none)).collect()} == {"und"}
    kept = langid.stage(spark, some, "")
    assert kept.columns == some.columns and sorted(r["doc_id"] for r in kept.filter("doc_id IS NOT NULL").collect()) == [1, 1, 5]
    assert langid.stage(spark, none, "").collect() == []


def test_simhash(spark, some, none):
    got = {r["doc_id"]: r for r in simhash.groups(some).collect()}
    assert len(simhash.groups(some).collect()) == len(ROWS)
    assert got[2]["fp"] == got[3]["fp"] == got[6]["fp"] == 0
    assert got[2]["component_id"] == got[3]["component_id"] == got[6]["component_id"] == 2 and got[1]["component_id"] == 1
    assert simhash.groups(none).collect() == []
    kept = simhash.stage(spark, some, "")
    assert kept.columns == some.columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 2, 5, 7, None]
    assert simhash.stage(spark, none, "").collect() == []


@pytest.mark.parametrize("ids", [(7, 7, 7, 7), (None,) * 4, (1, 1, None, None)])
def test_stage_goes_by_row(spark, ids):
    words = ["alpha beta gamma delta epsilon zeta", "one two three four five six", "red green blue white black pink", "north south east west up down"]
    df = docs(spark, [(i, t, "en", "a") for i, t in zip(ids, words, strict=True)]).repartition(3)
    assert sorted(r["text"] for r in simhash.stage(spark, df, "").collect()) == sorted(words)
    twice = df.unionByName(df).unionByName(df.withColumn("doc_id", F.lit(None).cast("long")).withColumn("lang", F.lit("zz")))
    got = simhash.stage(spark, twice, "").collect()
    assert sorted(r["text"] for r in got) == sorted(words) and {r["lang"] for r in got} == {"en"} and got[0].__fields__ == df.columns
    assert sorted(map(repr, got)) == sorted(map(repr, simhash.stage(spark, twice.repartition(2), "").collect()))


def test_pii(spark, some, none):
    out = pii.pseudonymize(some, spans="found")
    assert out.count() == len(ROWS) and out.filter("text IS NULL").count() == 1
    assert sorted(r["text"] or "" for r in out.collect()) == sorted(t or "" for _, t, _, _ in ROWS)
    assert pii.stage(spark, some, "").columns == some.columns and pii.stage(spark, none, "").collect() == []


def test_mixing(spark, some, none):
    got = mixing.mix(some).collect()
    assert len(got) == len(ROWS) and all(0 <= r["copies"] <= 2 for r in got)
    assert {r["source"]: r["size"] for r in got}[None] == 0
    assert mixing.mix(none).collect() == []
    out = mixing.stage(spark, some, "")
    assert out.columns == some.columns and mixing.stage(spark, none, "").collect() == []


@pytest.mark.parametrize("ids", [lambda k: 7, lambda k: None, lambda k: k // 30, lambda k: k])
@pytest.mark.parametrize("text", [lambda k: "one two three four five six seven eight nine ten", lambda k: " ".join([f"w{k}"] * (k % 17 + 1)), lambda k: " ".join(["x"] * (k % 3))])
def test_mixing_takes_row_by_row(spark, ids, text):
    import duckdb

    rows = [(ids(k), text(k), "en", s) for s, n in (("a", 100), ("b", 10), ("c", 200), (None, 15)) for k in range(n)]
    df = docs(spark, rows).repartition(3)
    got = df.transform(mixing.mix).collect()
    taken, target, largest = {}, {}, {}
    for r in got:
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * r["copies"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
        target[r["source"]] = r["target"]
        assert 0 <= r["copies"] <= 2
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in target)
    # equal rows are interchangeable, so the SQL gives the same rows
    documents = df.toArrow()  # noqa: F841
    theirs = duckdb.sql(mixing.ORACLE).fetchall()
    ours = [(r["doc_id"], r["size"], r["source_size"], r["target"], r["size"] * r["copies"]) for r in got]
    assert sorted(map(repr, ours)) == sorted(map(repr, theirs))
    # the stage gives each row as often as that, with its other columns
    out = mixing.stage(spark, df, "").groupBy("source").agg(F.sum(F.regexp_count("text", F.lit("[a-z0-9]+"))).alias("n"), F.min("kept_id").alias("k")).collect()
    assert {r["source"]: r["n"] for r in out} == {s: n for s, n in taken.items()} and {r["k"] for r in out} == {2}


def test_mixing_of_nothing(spark):
    only_empty = docs(spark, [(1, None, "en", "a"), (2, "", "en", None)])
    assert {r["target"] for r in mixing.mix(only_empty).collect()} == {0.0}


def test_spm(spark, some, none):
    got = {r["doc_id"]: r for r in spm.encode(some, verify=True).collect()}
    assert got[2]["ids"] is None and got[3]["ids"] == [] and got[5]["round_trip"] and len(got[5]["ids"]) > 80_000
    assert spm.encode(none).collect() == [] and spm.stage(spark, none, "").collect() == []


def test_quality(spark, some, none):
    labels = spark.createDataFrame([(1, 1), (5, 0), (1, 1), (None, 1), (7, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.judge(some, quality.fit(some, labels)).collect()}
    assert got[2]["n_words"] == 0 and got[2]["base_failed"] and not got[2]["kept"]
    assert got[5]["n_words"] == 120_000 and got[5]["base_failed"] and got[1]["n_words"] == 23
    empty = labels.limit(0)
    assert {r["doc_id"]: r for r in quality.judge(some, quality.fit(some, empty)).collect()}[1]["kept"]
    assert quality.judge(none, quality.fit(none, labels)).collect() == []


def test_licenses(spark, none):
    files = spark.createDataFrame(
        [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c.txt", "code"), (3, None, "All rights reserved."), (4, "a/b/d.txt", None), (5, "z/e", LONG + "\nLicensed under CC BY-NC 4.0.\n"), (6, "top", ""), (2, "a/b/c.txt", "code"), (7, "a/b/LICENSE", "Licensed under CC BY-NC 4.0."), (8, "a/x/y", "no")],
        "doc_id int, path string, text string",
    ).withColumn("license", F.lit("clash")).withColumn("best", F.lit(1)).withColumn("dir", F.lit(2))
    got = {r["doc_id"]: r for r in licenses.scan(files).collect()}
    assert licenses.scan(files).count() == 9
    assert (got[1]["license"], got[1]["license_file"]) == ("MIT", True) and got[2]["inherited"] == "CC-BY-NC-4.0" and got[2]["inherited_from"] == "a/b"
    assert got[3]["license"] == "LicenseRef-all-rights-reserved" and got[4]["inherited"] == "CC-BY-NC-4.0"
    assert (got[5]["license"], got[5]["license_file"]) == ("CC-BY-NC-4.0", False) and got[6]["inherited"] is None
    assert (got[8]["inherited"], got[8]["inherited_from"]) == ("MIT", "a")
    assert licenses.scan(files.limit(0)).collect() == []


def test_root_license(spark):
    files = spark.createDataFrame([(1, "LICENSE", "Released under the MIT License."), (2, "a/b", "x"), (3, "c", "x")], "doc_id int, path string, text string")
    assert {r["inherited"] for r in licenses.scan(files).filter("doc_id > 1").collect()} == {"MIT"}


def test_warc(spark, monkeypatch):
    big = "é" * 600
    pages = spark.createDataFrame([(1, "http://a/1 \r\nX: y", big), (2, None, big), (2, "u", big), (3, "u", None), (4, "u", ""), (None, "u", big), (5, "u", "s" * 999), (6, "u", "s" * 999), (7, "u", LONG)], "page_id long, url string, html string")
    pages = pages.withColumn("payload_digest", F.lit("clash")).withColumn("refers_to", F.lit(1))
    path = warc.scratch(spark, "small")
    warc.write_archive(warc.mark(pages), path)
    got = warc.join_revisits(warc.read_archive(spark, path)).collect()
    assert len(got) == 9
    kinds = sorted((r["record_id"].rsplit(":", 1)[0] + ">", r["record_type"], r["payload_bytes"], r["refers_to"] is not None) for r in got)
    assert all(r["record_id"].endswith(f":{r['payload_digest']}>") for r in got)
    page = lambda k: f"<urn:wordloom:page:{k}>"
    assert (page(1), "revisit", 1200, True) in kinds and kinds.count((page(2), "response", 1200, False)) == 2
    assert (page(""), "revisit", 1200, True) in kinds and (page(3), "response", 0, False) in kinds and (page(6), "response", 999, False) in kinds
    assert {r["url"] for r in got if r["record_id"].startswith(page(1)[:-1] + ":")} == {"http://a/1%20%0D%0AX:%20y"}
    monkeypatch.setattr(warc, "LARGE_BYTES", 1100)
    path = warc.scratch(spark, "large")
    warc.write_archive(warc.mark(pages), path, 600_000)
    again = warc.join_revisits(warc.read_archive(spark, path)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    path = warc.scratch(spark, "none")
    warc.write_archive(warc.mark(pages.limit(0)), path)
    assert warc.read_archive(spark, path).collect() == []


def test_wrappers(spark):
    page = "<html><body><nav>menu</nav><article><h1>T</h1><p>one</p></article></body></html>"
    pages = spark.createDataFrame([(1, "http://a.com/x", page), (1, "http://a.com/x", page), (2, "http://a.com/y", None), (3, None, ""), (4, "not a url", "plain &amp; text"), (5, "http://b.com", f"<article>{LONG}</article>"), (None, "http://b.com", "<article><p>x")], "page_id long, url string, html string")
    pages = pages.withColumn("host", F.lit("clash")).withColumn("main", F.lit(1)).withColumn("text", F.lit("t"))
    got = wrappers.extract(pages).collect()
    assert len(got) == 7
    by = {r["page_id"]: r for r in got}
    assert by[1]["text"] == "T one" and by[2]["text"] == "" and by[3]["n_chars"] == 0 and by[4]["text"] == "plain & text"
    assert by[5]["text"] == LONG.strip() and by[None]["text"] == "x"
    assert wrappers.extract(pages.limit(0)).collect() == []


def test_ann(spark):
    e = [float(k) for k in range(4)]
    # 20 comes twice: each row is a query, and a candidate of the other one; 5 has another length than most
    rows = [(20, [1.0, 0.0, 0.0, 0.0]), (20, [1.0, 0.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0, 0.0]), (1, [0.5, 9.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0, 0.0]), (4, None), (5, [0.0] * 4), (6, [1.0, None, 0.0, 0.0]), (7, [math.nan, 1.0, 0.0, 0.0]), (8, [math.inf, 1.0, 0.0, 0.0]), (9, [1.0]), (60, [2.0]), (100, [1.0, 2.0]), (None, e), (40, [-1.0, 0.5, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("block", F.lit(1)).withColumn("score", F.lit(1)).withColumn("number", F.lit(1))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(v, F.col("vec_id") % 20 == 0).collect())
    of_20 = [(20, 1, 2, 2.0), (20, 2, 1, 1.0), (20, 3, 20, 1.0), (20, 4, 1, 0.5), (20, 5, 40, -1.0)]
    assert got == sorted(of_20 * 2) + [(40, 1, 1, 4.0), (40, 2, 1, -1.0), (40, 3, 20, -1.0), (40, 4, 20, -1.0), (40, 5, 2, -2.0), (60, 1, 9, 2.0)]
    assert ann.search(v.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_ann_of_a_hot_id(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 16)
    rows = [(1, [float(k), 1.0]) for k in range(60)] + [(20, [1.0, 0.0]), (3, [58.5, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["rank"], r["vec_id"], r["score"]) for r in ann.search(v, F.col("vec_id") % 20 == 0, k=3).orderBy("rank").collect()]
    assert got == [(1, 1, 59.0), (2, 3, 58.5), (3, 1, 58.0)]
