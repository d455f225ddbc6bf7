"""A corpus pipeline of five stages: language, near duplicates, personal data, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's docs. All but the last return the columns of documents.

Edge cases: null and empty texts are in no language, so the first stage drops them; rows that share a doc_id, or have none, are
documents of their own in every stage, but of rows with one text the second keeps one; a null source is a source like any other; an empty
table, or one of nulls only, gives no rows; further columns pass through the first four stages, except that the mix refuses names
that begin with mix_.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from wordloom.llm import common, langid, mixing, pii, simhash, spm

STAGES = [
    ("language", langid.stage),
    ("near_duplicates", simhash.stage),
    ("personal_data", pii.stage),
    ("mix", mixing.stage),
    ("encode", spm.stage),
]

#: Fingerprints, keyed permutations and pieces are beyond SQL; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
