"""Queries of this subpackage and the DuckDB SQL that checks them."""

from __future__ import annotations

from plurality.llm import bpe, collocations, divergence, html_text, language, lattice, line_quality, mixing, packing, quotes, secrets, simhash, suffix_dedup


def queries() -> dict:
    return {
        "op10_suffix_family": suffix_dedup.op10_suffix_family,
        "op11_pcy_collocations": collocations.op11_pcy_collocations,
        "op12_systolic_divergence": divergence.op12_systolic_divergence,
        "op13_hilbert_packing": packing.op13_hilbert_packing,
        "op1_randomness_secrets": secrets.op1_randomness_secrets,
        "op2_quotation_linking": quotes.op2_quotation_linking,
        "op3_e8_lattice": lattice.op3_e8_lattice,
        "op4_duckdb_bpe": bpe.op4_duckdb_bpe,
        "op5_segmentation_language": language.op5_segmentation_language,
        "op6_line_frequency_quality": line_quality.op6_line_frequency_quality,
        "op7_weighted_fair_mix": mixing.op7_weighted_fair_mix,
        "op8_simhash_pigeonhole": simhash.op8_simhash_pigeonhole,
        "op9_composite_text_density": html_text.op9_composite_text_density,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op10_suffix_family": suffix_dedup.ORACLE,
        "op11_pcy_collocations": collocations.ORACLE,
        "op12_systolic_divergence": divergence.ORACLE,
        "op2_quotation_linking": quotes.ORACLE,
        "op6_line_frequency_quality": line_quality.ORACLE,
        "op7_weighted_fair_mix": mixing.ORACLE,
    }
