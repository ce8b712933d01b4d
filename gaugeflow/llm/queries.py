"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from . import brown_lm, decontaminate, exact_dedup, html_text, manifest, mixing, quality, secrets, sharding, simhash, suffix_dedup, warc, whitening


def queries():
    return {
        "op1_simhash_dedup": simhash.op1_simhash_dedup,
        "op2_quality": quality.op2_quality,
        "op3_sharding": sharding.op3_sharding,
        "op4_secrets": secrets.op4_secrets,
        "op5_exact_dedup": exact_dedup.op5_exact_dedup,
        "op6_html_text": html_text.op6_html_text,
        "op7_decontamination": decontaminate.op7_decontamination,
        "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
        "op9_lm_scoring": brown_lm.op9_lm_scoring,
        "op10_mixing": mixing.op10_mixing,
        "op11_warc": warc.op11_warc,
        "op12_whitening": whitening.op12_whitening,
        "op13_manifest": manifest.op13_manifest,
    }


def oracle_sql():
    return {"op4_secrets": secrets.SQL, "op5_exact_dedup": exact_dedup.SQL, "op11_warc": warc.SQL, "op13_manifest": manifest.SQL}
