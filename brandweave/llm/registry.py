"""Queries of the corpus operators by name, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from brandweave.llm import html, jaccard, language_model, licenses, media, merkle, mixing, neighbours, packing, pii, quality, ranked_search, substrings

QUERIES = {
    "op9_jaccard": jaccard.op9_jaccard,
    "op5_neighbours": neighbours.op5_neighbours,
    "op3_html": html.op3_html,
    "op2_pii": pii.op2_pii,
    "op4_quality": quality.op4_quality,
    "op7_language_model": language_model.op7_language_model,
    "op1_media": media.op1_media,
    "op6_mixing": mixing.op6_mixing,
    "op10_licenses": licenses.op10_licenses,
    "op8_packing": packing.op8_packing,
    "op11_substrings": substrings.op11_substrings,
    "op12_merkle": merkle.op12_merkle,
    "op13_ranked_search": ranked_search.op13_ranked_search,
}
ORACLES: dict[str, str] = {
    "op6_mixing": mixing.OP6_SQL,
    "op9_jaccard": jaccard.OP9_SQL,
    "op11_substrings": substrings.OP11_SQL,
    "op12_merkle": merkle.OP12_SQL,
    "op13_ranked_search": ranked_search.OP13_SQL,
}
