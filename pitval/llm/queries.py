"""Registered queries of this subpackage.

SQL can express the phrases. It cannot express the other methods (SimHash bits, automata,
sampled segmentations, learned partitions, hashed language models, tokenizers, ordered
rules); ``tests/llm`` holds them against brute-force versions.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, chat, html, language, licenses, lines, neighbours, packing, phrases, pieces, quality, simhash, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity.op1,
    "op2_best_fit_packing": packing.op2,
    "op3_language": language.op3,
    "op4_neighbours": neighbours.op4,
    "op5_quality": quality.op5,
    "op6_main_text": html.op6,
    "op7_sampled_pieces": pieces.op7,
    "op8_line_dedup": lines.op8,
    "op9_chat_windows": chat.op9,
    "op10_simhash": simhash.op10,
    "op11_alignment": align.op11,
    "op12_phrases": phrases.op12,
    "op13_licenses": licenses.op13,
}
SQL: dict[str, str] = {"op12_phrases": phrases.OP12_SQL}
