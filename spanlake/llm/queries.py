"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, decontam, langid, lm, packing, quality, simhash, token_counts, toxicity, warc

QUERIES = {
    f.__name__: f
    for f in (
        token_counts.op1_separator_scan,
        toxicity.op2_tfidf_neighbours,
        chat.op3_chat_formatting,
        quality.op4_robust_outliers,
        langid.op5_bigru,
        decontam.op6_wu_manber,
        warc.op7_seekable_warc,
        packing.op8_best_fit_packing,
        lm.op9_pseudo_likelihood,
        simhash.op10_simhash,
    )
}

ORACLE_SQL = {
    "op6_wu_manber": decontam.ORACLE,
    "op7_seekable_warc": warc.ORACLE,
}
