"""Token counts through a cache of digests.

A text is normalised as far as its count can't change (null is empty; where a SentencePiece model writes spaces as U+2581, so does
the text), and its SHA-256 is its key. Counts are kept in a Parquet folder under the digest of the tokenizer's version:
its file, its library and the library's version. Keys of the documents are gathered without their texts and met with the stored
counts; only texts of keys that are missing are brought together, one of each, encoded, and appended. Every count that is
given out has been read from the cache.

Null and empty texts have 0 bytes and 0 tokens. Repeated rows and copies each give a row and are encoded once. A very long text is
encoded whole, alone in its batch. Columns beside doc_id and text aren't read, so that their names can't clash; an empty
table gives no rows. Rows that two runs append at the same time are equal and count once.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stored, text_slices

CACHE = "content binary, n_tokens long, tokenizer string"
MARK = "▁"

#: At most this many missing keys are broadcast, to filter texts before they are shuffled (about 60 MB).
FEW = 500_000


class Tokenizer:
    """A tokenizer file (.model: sentencepiece, .json: tokenizers) with the digest of its version and what its counts ignore."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.data = f.read()
        self.pieces = path.endswith(".model")
        library = __import__("sentencepiece" if self.pieces else "tokenizers")
        self.digest = hashlib.sha256(b"\n".join([library.__name__.encode(), library.__version__.encode(), self.data])).hexdigest()
        self.marks_spaces = False
        if self.pieces:
            from .sp_codec import Proto

            self.marks_spaces = Proto(self.data).escape

    def normal(self, text: Column) -> Column:
        """The text as far as its count depends on it."""
        text = F.coalesce(text, F.lit(""))
        return F.replace(text, F.lit(MARK), F.lit(" ")) if self.marks_spaces else text


def counter(data: bytes, pieces: bool) -> Callable[[list[str]], list[int]]:
    """Counts of texts without begin, end or added special tokens, truncation or padding."""
    if pieces:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_proto=data)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    whole = tokenizers.Tokenizer.from_buffer(data)
    whole.no_truncation()
    whole.no_padding()
    return lambda texts: [len(x) for x in whole.encode_batch_fast(texts, add_special_tokens=False)]


def encoded(texts: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """content, n_tokens of texts (content, text)."""
    data, pieces = tokenizer.data, tokenizer.pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(data, pieces)
        for part in text_slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("content"), pa.array(count(part.column("text").to_pylist()), pa.int64())], names=["content", "n_tokens"])

    return texts.select("content", "text").mapInArrow(run, "content binary, n_tokens long")


def cached(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """content, n_tokens: what the cache holds for a tokenizer's digest; none where it isn't there yet."""
    try:
        rows = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], CACHE)
    return rows.where(F.col("tokenizer") == tokenizer).groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))


def appended(docs: DataFrame, keys: DataFrame, tokenizer: Tokenizer, cache: str) -> int:
    """Encodes what the cache lacks of keys (content), the texts being those of docs (content, text), and appends it; how many."""
    spark = docs.sparkSession
    missing = stored(keys.select("content").join(cached(spark, cache, tokenizer.digest), "content", "left_anti"), "missing")
    n = missing.count()
    if n:
        # one text of each key: within a task before the shuffle, then over all
        one = lambda rows: rows.groupBy("content").agg(F.first("text").alias("text"))
        texts = one(docs.join(F.broadcast(missing), "content", "left_semi")) if n <= FEW else one(docs).join(missing, "content", "left_semi")
        encoded(texts, tokenizer).withColumn("tokenizer", F.lit(tokenizer.digest)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    return n


def token_counts(docs: DataFrame, path: str, limit: int = 4096, cache: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than limit) of every row of docs (doc_id, text).

    cache: a folder that outlives the run and serves later ones; without it the run has one of its own.
    """
    spark, tokenizer = docs.sparkSession, Tokenizer(path)
    cache = cache or f"{shared_dir(spark)}/tallyforge-token-cache-{uuid.uuid4().hex}"
    text = tokenizer.normal(F.col("text"))
    keyed = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("content"))
    keyed = stored(keyed, "keyed")
    keys = stored(keyed.groupBy("content").agg(F.count("*").alias("copies")), "keys")
    appended(docs.select(F.unhex(F.sha2(text, 256)).alias("content"), text.alias("text")), keys, tokenizer, cache)

    # a key with over a thousandth of all rows is not shuffled; there are fewer than a thousand of them
    rows = keys.agg(F.sum("copies").alias("rows_"))
    known = cached(spark, cache, tokenizer.digest)
    hot = keys.join(F.broadcast(rows)).where("copies * 1000 > rows_").select("content")
    hot = F.broadcast(known.join(F.broadcast(hot), "content"))
    common = keyed.join(hot, "content")
    others = keyed.join(hot, "content", "left_anti").join(known, "content")
    return common.unionByName(others).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
