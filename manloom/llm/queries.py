"""The queries of this subpackage, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, exact_dedup, filter_audit, html_main, line_dedup, mixing, packing, quality, secret_scan, simhash, topk, toxicity, vector_codes


def queries() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_topk": topk.op2_topk,
        "op3_quality": quality.op3_quality,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_html": html_main.op5_html,
        "op6_secrets": secret_scan.op6_secrets,
        "op7_mixing": mixing.op7_mixing,
        "op8_bpe": bpe.op8_bpe,
        "op9_simhash": simhash.op9_simhash,
        "op10_line_dedup": line_dedup.op10_line_dedup,
        "op11_packing": packing.op11_packing,
        "op12_filter_audit": filter_audit.op12_filter_audit,
        "op13_vector_codes": vector_codes.op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.OP1_SQL,
        "op2_topk": topk.OP2_SQL,
        "op12_filter_audit": filter_audit.OP12_SQL,
        "op13_vector_codes": vector_codes.OP13_SQL,
    }
