"""The queries of this package and the SQL that DuckDB can hold them against."""

from __future__ import annotations


def queries() -> dict:
    from lectern.llm import chat, codes, html_text, mixing, neighbours, ngram_join, ogg, packing, pattern_packing, pii, quality, simple8b, turns

    return {
        "op1_snapshot_collapse": chat.op1_snapshot_collapse,
        "op2_flat_blocks": html_text.op2_flat_blocks,
        "op3_bounded_packing": packing.op3_bounded_packing,
        "op4_disclosure_sanitise": pii.op4_disclosure_sanitise,
        "op5_nn_descent": neighbours.op5_nn_descent,
        "op6_hierarchical_mixing": mixing.op6_hierarchical_mixing,
        "op7_neighbour_voting": quality.op7_neighbour_voting,
        "op10_chosen_path": ngram_join.op10_chosen_path,
        "op9_ogg_media": ogg.op9_ogg_media,
        "op8_token_binary": simple8b.op8_token_binary,
        "op11_pattern_packing": pattern_packing.op11_pattern_packing,
        "op12_yinyang_codes": codes.op12_yinyang_codes,
        "op13_turn_repair": turns.op13_turn_repair,
    }


def oracle_sql() -> dict[str, str]:
    from lectern.llm import chat, html_text, mixing

    return {
        "op1_snapshot_collapse": chat.ORACLE,
        "op2_flat_blocks": html_text.ORACLE,
        "op6_hierarchical_mixing": mixing.ORACLE,
    }
