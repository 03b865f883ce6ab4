"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from quadrille.llm import bpe, exact_dedup, fill_middle, html_text, language_id, licenses, packing, prefix_trie, quality, secrets, simhash, toxicity, warc


def queries() -> dict:
    return {
        "op1_secret_scan": secrets.op1_secret_scan,
        "op2_bpe": bpe.op2_bpe,
        "op3_quality": quality.op3_quality,
        "op4_html_text": html_text.op4_html_text,
        "op5_simhash": simhash.op5_simhash,
        "op6_language_id": language_id.op6_language_id,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_warc": warc.op8_warc,
        "op9_packing": packing.op9_packing,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_fill_middle": fill_middle.op11_fill_middle,
        "op12_prefix_trie": prefix_trie.op12_prefix_trie,
        "op13_licenses": licenses.op13_licenses,
    }


def oracle_sql() -> dict:
    return {
        "op1_secret_scan": secrets.OP1_SQL,
        "op7_exact_dedup": exact_dedup.OP7_SQL,
        "op11_fill_middle": fill_middle.OP11_SQL,
        "op12_prefix_trie": prefix_trie.OP12_SQL,
    }
