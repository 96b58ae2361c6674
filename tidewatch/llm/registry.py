"""Queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import blocknames, gumbel, kneser, licenses, minhash, packing, quality, secrets, sharding, simhash, topk, trie, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixture_packing": packing.op1_mixture_packing,
        "op2_label_propagation": sharding.op2_label_propagation,
        "op3_factorisation_machine": quality.op3_factorisation_machine,
        "op4_secret_links": secrets.op4_secret_links,
        "op5_simhash": simhash.op5_simhash,
        "op6_segment_search": topk.op6_segment_search,
        "op7_gumbel_pieces": gumbel.op7_gumbel_pieces,
        "op8_block_naming": blocknames.op8_block_naming,
        "op9_license_alignment": licenses.op9_license_alignment,
        "op10_kneser_ney": kneser.op10_kneser_ney,
        "op11_whitening": whitening.op11_whitening,
        "op12_conversation_trie": trie.op12_conversation_trie,
        "op13_circulant_minhash": minhash.op13_circulant_minhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_segment_search": topk.OP6_SQL, "op8_block_naming": blocknames.OP8_SQL}
