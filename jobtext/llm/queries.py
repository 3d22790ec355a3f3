"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from jobtext.llm import audit, bpe, centroids, chunks, linededup, mainhtml, mixing, packing, quality, secrets, simhash, suffixes, urlfilter

QUERIES = {
    "op1_secret_scan": secrets.op1_query,
    "op2_fingerprints": chunks.op2_query,
    "op3_quality_rules": quality.op3_query,
    "op4_simhash_dedup": simhash.op4_query,
    "op5_packing": packing.op5_query,
    "op6_suffix_dedup": suffixes.op6_query,
    "op7_url_filter": urlfilter.op7_query,
    "op8_byte_bpe": bpe.op8_query,
    "op9_main_text": mainhtml.op9_query,
    "op10_line_dedup": linededup.op10_query,
    "op11_source_mix": mixing.op11_query,
    "op12_filter_audit": audit.op12_query,
    "op13_centroids": centroids.op13_query,
}

ORACLE: dict[str, str] = {
    "op3_quality_rules": quality.OP3_SQL,
    "op7_url_filter": urlfilter.OP7_SQL,
    "op12_filter_audit": audit.OP12_SQL,
    "op13_centroids": centroids.OP13_SQL,
}
