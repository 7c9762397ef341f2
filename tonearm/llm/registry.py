"""Queries of the training-data operators and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from . import alignment, annsearch, decontamination, langid, lmscore, minhash, mixing, quality, secrets, sentencepieces, suffixdedup, vecdedup, yinyang


def queries() -> dict:
    return {
        "op1_secrets": secrets.query,
        "op2_sentencepiece": sentencepieces.query,
        "op3_vecdedup": vecdedup.query,
        "op4_lmscore": lmscore.query,
        "op5_langid": langid.query,
        "op6_suffixdedup": suffixdedup.query,
        "op7_ann": annsearch.query,
        "op8_minhash": minhash.query,
        "pipeline": corpus_pipeline.run,
        "op9_quality": quality.query,
        "op10_mixing": mixing.query,
        "op11_yinyang": yinyang.query,
        "op12_alignment": alignment.query,
        "op13_decontamination": decontamination.query,
    }


def oracle_sql() -> dict[str, str]:
    sql = {"op10_mixing": mixing.ORACLE_SQL, "op11_yinyang": yinyang.ORACLE_SQL, "op13_decontamination": decontamination.ORACLE_SQL}
    if corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return sql
