"""The queries of this subpackage."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logmill.llm import (
    ball_tree,
    class_lm,
    language_id,
    link_trust,
    merkle,
    mixing,
    prefix_trie,
    sentencepiece_bpe,
    simhash,
    surrogates,
    token_files,
    warc,
    winnowing,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": language_id.op1_language_id,
        "op2_surrogates": surrogates.op2_surrogates,
        "op3_link_trust": link_trust.op3_link_trust,
        "op4_decontamination": winnowing.op4_decontamination,
        "op5_warc": warc.op5_warc,
        "op6_ball_tree": ball_tree.op6_ball_tree,
        "op7_sentencepiece": sentencepiece_bpe.op7_sentencepiece,
        "op8_token_files": token_files.op8_token_files,
        "op9_simhash": simhash.op9_simhash,
        "op10_class_lm": class_lm.op10_class_lm,
        "op11_merkle": merkle.op11_merkle,
        "op12_mixing": mixing.op12_mixing,
        "op13_prefix_trie": prefix_trie.op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    """SQL where it can say the whole of a result. Classifiers (1), keyed surrogates (2), ranks
    of a graph (3), merges (7, 8), XXH64 fingerprints (9) and clustering (10) are tested
    against brute force, the libraries and round trips instead."""
    return {
        "op4_decontamination": winnowing.OP4_SQL,
        "op5_warc": warc.OP5_SQL,
        "op6_ball_tree": ball_tree.OP6_SQL,
        "op11_merkle": merkle.OP11_SQL,
        "op12_mixing": mixing.OP12_SQL,
        "op13_prefix_trie": prefix_trie.OP13_SQL,
    }
