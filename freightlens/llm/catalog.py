"""Registered queries of the training-data operators, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, licenses, mixing, near_dedup, packing, pii, quality, resampling, secrets, substrings, toxicity, tries, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_subword_bag": toxicity.op1_subword_bag,
    "op2_warc": warc.op2_warc,
    "op3_automaton": secrets.op3_automaton,
    "op4_prob_minhash": near_dedup.op4_prob_minhash,
    "op5_splitting_tree": mixing.op5_splitting_tree,
    "op6_bootstrapped": pii.op6_bootstrapped,
    "op7_fertility": quality.op7_fertility,
    "op8_prefix_join": decontaminate.op8_prefix_join,
    "op9_sentence_rules": licenses.op9_sentence_rules,
    "op10_gear_chunks": substrings.op10_gear_chunks,
    "op11_histogram_fit": packing.op11_histogram_fit,
    "op12_interned_grams": resampling.op12_interned_grams,
    "op13_burst_trie": tries.op13_burst_trie,
}

SQL: dict[str, str] = {"op2_warc": warc.SQL, "op8_prefix_join": decontaminate.SQL,
                       "op12_interned_grams": resampling.SQL, "op13_burst_trie": tries.SQL}
