"""The queries of this package: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from . import bpe, embed_dedup, fill_middle, filter_audit, html_text, mixing, pii, quality, secret_scan, sharding, simhash, token_counts, token_files

QUERIES = {
    "op1_byte_bpe": bpe.op1_byte_bpe,
    "op2_sharding": sharding.op2_sharding,
    "op3_mixing": mixing.op3_mixing,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_quality": quality.op5_quality,
    "op6_pii": pii.op6_pii,
    "op7_html_text": html_text.op7_html_text,
    "op8_embedding_dedup": embed_dedup.op8_embedding_dedup,
    "op9_token_files": token_files.op9_token_files,
    "op10_simhash": simhash.op10_simhash,
    "op11_fill_middle": fill_middle.op11_fill_middle,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_secret_scan": secret_scan.op13_secret_scan,
}

ORACLE_SQL = {"op3_mixing": mixing.OP3_SQL, "op8_embedding_dedup": embed_dedup.OP8_SQL, "op11_fill_middle": fill_middle.OP11_SQL, "op12_filter_audit": filter_audit.OP12_SQL}
