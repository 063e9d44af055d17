"""The corpus pipeline: documents through five stages, each written as Parquet and read again by the next.

Documents that toxicity rejects go; of each group of near duplicates one stays; contaminated documents go; personal
data in what is left is replaced by its kind; and the texts are encoded. A stage's decisions hold for all later ones,
and each works on all that its predecessor kept. All stages but the last return the columns of documents; the last returns
doc_id, ids, n_tokens and round_trip, which is true where decoding gives the text back and the sentencepiece library gives the same ids.

Null texts are kept as they are by all stages but the last, which encodes them as empty. Repeated rows are near duplicates of each
other, of which one stays; an empty table gives no rows. Extra columns go along, up to the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import decontam, ngram_join, pii, sp_codec, toxicity
from tallyforge.llm.common import documents, shared_dir
from tallyforge.llm.queries import model_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact_stage(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sp_codec.encoded(docs, model_path())


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("sentencepiece", encoding_stage),
]

#: Toxicity is a learned model and encoding a tokenizer: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents."""
    docs = documents(spark, sf_dir)
    at = f"{shared_dir(spark)}/tallyforge-pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{at}/{i}-{name}")
        docs = spark.read.parquet(path)
    return docs
