"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audio, bloomlm, chat, fingerprint, mixing, neardup, packing, pagediff, quality, urlfilter

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def vocabulary() -> str:
    """The ranks of byte_bpe_50k, with the ids of byte_bpe_50k.json."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mpeg_audio": lambda s, d: audio.text_digests(_table(s, d, "documents")),
        "op2_page_differencing": lambda s, d: pagediff.extracted(_table(s, d, "pages")),
        "op3_quality_ftrl": lambda s, d: quality.quality_scores(_table(s, d, "documents"), _table(s, d, "labels")),
        "op4_one_permutation_minhash": lambda s, d: fingerprint.edited_fingerprints(_table(s, d, "documents")),
        "op5_shortest_pack_first": lambda s, d: packing.pack(_table(s, d, "documents"), vocabulary()),
        "op6_url_trees": lambda s, d: urlfilter.verdicts(_table(s, d, "pages"), RULES),
        "op7_fast_similarity_sketch": lambda s, d: neardup.components(_table(s, d, "documents"), words=3, percent=85),
        "op8_weighted_mixing": lambda s, d: mixing.mix(_table(s, d, "documents")),
        "op9_bloom_lm": lambda s, d: bloomlm.scores(_table(s, d, "documents")),
        "op10_chat_round_trip": lambda s, d: chat.conversation_digests(chat.with_conflict(_table(s, d, "conversations"))),
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_weighted_mixing": mixing.SQL, "op10_chat_round_trip": chat.SQL}
