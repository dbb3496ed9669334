"""Queries of this subpackage and their SQL, as __spark_entry__ adds them."""

from __future__ import annotations

from larder.llm import bpe, codebooks, embed_dedup, html_blocks, langid, license_scan, line_dedup, negatives, packing, quality, simhash, topk, url_filter


def queries():
    return {
        "op1_language_id": langid.op1_language_id,
        "op2_topk": topk.op2_topk,
        "op3_packing": packing.op3_packing,
        "op4_license_scan": license_scan.op4_license_scan,
        "op5_url_filter": url_filter.op5_url_filter,
        "op6_line_dedup": line_dedup.op6_line_dedup,
        "op7_html_text": html_blocks.op7_html_text,
        "op8_embed_dedup": embed_dedup.op8_embed_dedup,
        "op9_bpe": bpe.op9_bpe,
        "op10_simhash": simhash.op10_simhash,
        "op11_quality": quality.op11_quality,
        "op12_vector_codes": codebooks.op12_vector_codes,
        "op13_hard_negatives": negatives.op13_hard_negatives,
    }


def oracle_sql():
    return {
        "op2_topk": topk.OP2_SQL,
        "op4_license_scan": license_scan.OP4_SQL,
        "op5_url_filter": url_filter.OP5_SQL,
        "op6_line_dedup": line_dedup.OP6_SQL,
        "op8_embed_dedup": embed_dedup.OP8_SQL,
        "op11_quality": quality.OP11_SQL,
        "op12_vector_codes": codebooks.OP12_SQL,
        "op13_hard_negatives": negatives.OP13_SQL,
    }
