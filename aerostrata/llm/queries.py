"""Registered queries of the corpus operators and the DuckDB counterparts of those that SQL can express."""

from aerostrata.llm import chat_format, decontaminate, licenses, runs, spelling
from aerostrata.llm.ann import op4_nearest_vectors
from aerostrata.llm.html_text import op5_html_text
from aerostrata.llm.langid import op6_language_id
from aerostrata.llm.mixing import op11_mix_sources
from aerostrata.llm.packing import op1_token_packing
from aerostrata.llm.secrets import op9_secret_scan
from aerostrata.llm.sentencepiece_bpe import op2_sentencepiece
from aerostrata.llm.simhash import op10_simhash_dedup

QUERIES = {
    "op1_token_packing": op1_token_packing,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_nearest_vectors": op4_nearest_vectors,
    "op5_html_text": op5_html_text,
    "op6_language_id": op6_language_id,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_chat_format": chat_format.op8_chat_format,
    "op9_secret_scan": op9_secret_scan,
    "op10_simhash_dedup": op10_simhash_dedup,
    "op11_mix_sources": op11_mix_sources,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_periodic_runs": runs.op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op3_decontaminate": decontaminate.ORACLE,
    "op7_license_scan": licenses.ORACLE,
    "op8_chat_format": chat_format.ORACLE,
    "op12_spelling_variants": spelling.ORACLE,
    "op13_periodic_runs": runs.ORACLE,
}
