"""The registered queries of this package and their DuckDB statements."""

from __future__ import annotations

from . import codes, decontaminate, language, minhash, packing, pages, phrases, pieces, pii, quality, tokenfiles, toxicity, urls

QUERIES = {
    "op1_minhash_dedup": minhash.query,
    "op2_url_filters": urls.query,
    "op3_decontamination": decontaminate.query,
    "op10_pii": pii.query,
    "op4_language_id": language.query,
    "op5_toxicity": toxicity.query,
    "op6_sentencepiece": pieces.query,
    "op7_token_files": tokenfiles.query,
    "op8_html_extraction": pages.query,
    "op9_quality_rules": quality.query,
    "op11_phrase_collocations": phrases.query,
    "op12_packing": packing.query,
    "op13_vector_codes": codes.query,
}

ORACLE_SQL: dict[str, str] = {
    "op2_url_filters": urls.ORACLE_SQL,
    "op1_minhash_dedup": minhash.ORACLE_SQL,
    "op3_decontamination": decontaminate.ORACLE_SQL,
    "op9_quality_rules": quality.ORACLE_SQL,
    "op11_phrase_collocations": phrases.ORACLE_SQL,
    "op13_vector_codes": codes.ORACLE_SQL,
}
