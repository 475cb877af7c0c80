"""Queries of this subpackage and their SQL, as ``__spark_entry__.py`` registers them."""

from __future__ import annotations

from . import collocations, decontaminate, fertility, near_duplicates, pieces, preference, private_data, quality, runs, sharding, simhash, token_counts, token_files


def queries() -> dict:
    return {
        "op1_ngram_jaccard": near_duplicates.op1_ngram_jaccard,
        "op2_tokeniser_fertility": fertility.op2_tokeniser_fertility,
        "op3_preference_format": preference.op3_preference_format,
        "op4_token_files": token_files.op4_token_files,
        "op5_private_data": private_data.op5_private_data,
        "op6_viterbi_counts": token_counts.op6_viterbi_counts,
        "op7_piece_codec": pieces.op7_piece_codec,
        "op8_histogram_sort": sharding.op8_histogram_sort,
        "op9_neighbour_quality": quality.op9_neighbour_quality,
        "op10_string_tiling": decontaminate.op10_string_tiling,
        "op11_collocations": collocations.op11_collocations,
        "op12_simhash": simhash.op12_simhash,
        "op13_periodic_runs": runs.op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_preference_format": preference.OP3_SQL, "op11_collocations": collocations.OP11_SQL}
