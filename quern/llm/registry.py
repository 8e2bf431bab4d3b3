"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from quern.llm import embedding_dedup, filter_audit, html_extraction, importance, language_id, line_dedup, media, mixing, ngram_join, packing, token_counts, token_files, warc

QUERIES = {
    "op1_pack_documents": packing.op1_pack_documents,
    "op2_token_files": token_files.op2_token_files,
    "op3_embedding_dedup": embedding_dedup.op3_embedding_dedup,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_warc_pages": warc.op5_warc_pages,
    "op6_png_media": media.op6_png_media,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_language_id": language_id.op10_language_id,
    "op11_importance_resampling": importance.op11_importance_resampling,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_html_extraction": html_extraction.op13_html_extraction,
}
SQL = {
    "op3_embedding_dedup": embedding_dedup.OP3_SQL,
    "op4_line_dedup": line_dedup.OP4_SQL,
    "op5_warc_pages": warc.OP5_SQL,
    "op9_mix_sources": mixing.OP9_SQL,
    "op11_importance_resampling": importance.OP11_SQL,
    "op12_filter_audit": filter_audit.OP12_SQL,
    "op13_html_extraction": html_extraction.OP13_SQL,
}
