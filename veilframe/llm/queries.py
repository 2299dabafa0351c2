"""The subpackage's queries and their SQL."""

from __future__ import annotations

from importlib import import_module

#: (module, function) in the order of the operators.
NAMED = [
    ("op01_language", "op1_hyperdimensional"),
    ("op03_exact", "op3_content_sort"),
    ("op02_suffix", "op2_suffix_array"),
    ("op04_decontaminate", "op4_minhash_containment"),
    ("op05_packing", "op5_best_two_fit"),
    ("op06_zip_warc", "op6_zip_warc"),
    ("op07_toxicity", "op7_noisy_or"),
    ("op08_planes", "op8_plane_files"),
    ("op09_pseudo", "op9_masked_pseudo_likelihood"),
    ("op10_jaccard", "op10_count_rtree"),
    ("op11_fingerprint", "op11_multiset_hash"),
    ("op12_audit", "op12_bitmap_audit"),
    ("op13_spelling", "op13_range_reporting"),
]


def _modules():
    return [(f, import_module(f"{__package__}.{m}")) for m, f in NAMED]


def queries() -> dict:
    return {f: getattr(m, f) for f, m in _modules()}


def oracle_sql() -> dict[str, str]:
    return {f: m.ORACLE for f, m in _modules() if hasattr(m, "ORACLE")}
