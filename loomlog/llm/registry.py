"""Queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import bpe, collocations, embedding_dedup, license_scan, line_dedup, merkle, packing, quality, simhash, spotsigs, suffix_dedup, toxicity, url_filter

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_embedding_dedup": embedding_dedup.op3_embedding_dedup,
    "op4_spotsigs": spotsigs.op4_spotsigs,
    "op5_packing": packing.op5_packing,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_quality": quality.op7_quality,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_merkle": merkle.op12_merkle,
    "op13_collocations": collocations.op13_collocations,
}
ORACLES = {"op6_url_filter": url_filter.oracle(), "op8_license_scan": license_scan.oracle(), "op12_merkle": merkle.oracle(), "op13_collocations": collocations.oracle()}
