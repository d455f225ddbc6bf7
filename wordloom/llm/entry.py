"""Queries of the subpackage's operators and their SQL; the entry script adds the pipeline's."""

from __future__ import annotations

from . import ann, langid, licenses, mixing, pii, quality, simhash, spm, warc, wrappers


def queries():
    return {
        "op1_wrappers": wrappers.op1_wrappers,
        "op2_warc": warc.op2_warc,
        "op3_pii": pii.op3_pii,
        "op4_ann": ann.op4_ann,
        "op5_quality": quality.op5_quality,
        "op6_mix": mixing.op6_mix,
        "op7_simhash": simhash.op7_simhash,
        "op8_spm": spm.op8_spm,
        "op9_licenses": licenses.op9_licenses,
        "op10_langid": langid.op10_langid,
    }


def oracle_sql():
    return {"op2_warc": warc.ORACLE, "op6_mix": mixing.ORACLE, "op9_licenses": licenses.ORACLE}
