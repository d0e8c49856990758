"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat_format, decontaminate, exact_dedup, language_id, license_scan, line_dedup, mixing, pii, simhash_vptree, warc


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "pipeline": _pipeline,
        "op1_mix_sources": mixing.op1_mix_sources,
        "op2_license_scan": license_scan.op2_license_scan,
        "op3_chat_format": chat_format.op3_chat_format,
        "op4_simhash_vptree": simhash_vptree.op4_simhash_vptree,
        "op5_language_id": language_id.op5_language_id,
        "op6_decontaminate": decontaminate.op6_decontaminate,
        "op7_warc": warc.op7_warc,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_pii_pseudonyms": pii.op9_pii_pseudonyms,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    }


def oracle_sql() -> dict:
    return {
        "op3_chat_format": chat_format.ORACLE,
        "op6_decontaminate": decontaminate.ORACLE,
        "op7_warc": warc.ORACLE,
        "op8_line_dedup": line_dedup.ORACLE,
        "op10_exact_dedup": exact_dedup.ORACLE,
    }
