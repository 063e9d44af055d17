"""Queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, centroids, chat, decontam, langid, license_scan, ngram_join, pii, quality, sharding, sp_codec, token_counts, toxicity
from .common import documents
from .oracles import ORACLES

#: Where the public SentencePiece model lies; TOKENIZER_MODEL overrides it.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def model_path() -> str:
    return os.environ.get("TOKENIZER_MODEL", MODEL)


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": lambda s, d: pii.pii_spans(documents(s, d)),
        "op2_language_id": lambda s, d: langid.languages(documents(s, d)),
        "op3_decontamination": lambda s, d: decontam.contamination(documents(s, d), _table(s, d, "benchmark")),
        "op4_quality": lambda s, d: quality.outliers(documents(s, d)),
        "op5_license_scan": lambda s, d: license_scan.license_labels(documents(s, d)),
        "op6_sharding": lambda s, d: sharding.shards(documents(s, d)),
        "op7_ngram_jaccard_join": lambda s, d: ngram_join.similarity_components(documents(s, d)).drop("class_id"),
        "op8_chat_format": lambda s, d: chat.chat_digest(_table(s, d, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat.probe(s))),
        "op9_sentencepiece": lambda s, d: sp_codec.encoding_digest(documents(s, d), model_path()),
        "op10_toxicity": lambda s, d: toxicity.toxicity(documents(s, d), _table(s, d, "labels")),
        "op11_token_counts": lambda s, d: token_counts.token_counts(documents(s, d), vocabulary("piece_bpe_32k.model")),
        "op12_alignment": lambda s, d: alignment.alignment(documents(s, d), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")),
        "op13_centroids": lambda s, d: centroids.clusters(_table(s, d, "embeddings")),
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
