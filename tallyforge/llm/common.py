"""Helpers that the operators share: scratch tables, extra columns, hashed words of Arrow text."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Byte classes of the contracts' words, over UTF-8 bytes.
WHITE = bytes([0x20, *range(0x09, 0x0E)])
NOT_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one set here where all run in one process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        at = "/tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Queries planned inside delete their shuffle files as they end, instead of when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stored(df: DataFrame, what: str, rows: int | None = None, per_task: int = 200_000) -> DataFrame:
    """df written as Parquet in the shared folder and read back, which cuts its lineage.

    rows: about how many rows its last stage handles, if known; then no more tasks and files are made than these need.
    Unlike localCheckpoint the table outlives executors; unlike checkpoint() readers prune its columns.
    The folder is temporary by its name and is left to the cluster's cleaning of spark.checkpoint.dir,
    since results that are not computed yet read from it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyforge-{what}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(8, rows // per_task))
    with shuffles_released(spark):
        df.select("*").write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the folder of a table that stored() made, when nothing that is still to be computed reads it."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tallyforge-" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body uses it (even inside lambdas)."""
    return F.transform(F.array(value), body)[0]


def crc_of_id(col: str | Column) -> Column:
    """crc32 of a doc_id written as text."""
    return F.crc32(F.col(col).cast("string") if isinstance(col, str) else col.cast("string"))


def held_out(col: str | Column = "doc_id") -> Column:
    """The rows that no label may be learned from."""
    return F.coalesce(crc_of_id(col) % 4 == 2, F.lit(False))


def spaced_words(text: Column) -> Column:
    """The non-empty pieces between spaces, without regular expressions or lambdas."""
    return F.array_remove(F.split(text, " "), "")


def white_words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text that isn't null."""
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return spaced_words(text)


def alnum_words(text: Column) -> Column:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the ASCII-lower-cased text, which isn't null."""
    gaps = "".join(chr(c) for c in NOT_ALNUM if not 65 <= c <= 90)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return spaced_words(F.translate(text, gaps + upper, " " * len(gaps) + upper.lower()))


def text_slices(batches: Iterator[pa.RecordBatch], most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about most_bytes of text (a longer text stands alone)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of strings; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shifts and odd multipliers), so that sums and polynomials spread over all bits."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of a slice of texts, as runs of bytes that are not in `separators`.

    data, offsets: the bytes (A-Z lower-cased if lower) and where each text starts; start, end: of each word,
    in data; first: the index of each text's first word, and one past the last.
    """

    def __init__(self, column: pa.Array, separators: bytes, lower: bool = True) -> None:
        raw, self.offsets = utf8(column)
        table = np.arange(256, dtype=np.uint8)
        if lower:
            table[65:91] += 32
        inside = np.ones(256, bool)
        inside[list(separators)] = False
        self.data = table[raw]
        word = inside[self.data]
        edge = self.offsets[(self.offsets > 0) & (self.offsets < len(raw))]
        before = np.zeros(len(raw), bool)
        before[1:] = word[:-1]
        before[edge] = False
        self.start = np.flatnonzero(word & ~before)
        after = np.zeros(len(raw), bool)
        after[:-1] = word[1:]
        after[edge - 1] = False
        self.end = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.start, self.offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, block: int = 1 << 18) -> np.ndarray:
        """A 64-bit hash of each word's bytes: a polynomial with an odd base, mixed with the length."""
        out = np.empty(len(self.start), np.uint64)
        for at in range(0, len(out), block):
            start, end = self.start[at : at + block], self.end[at : at + block]
            size = end - start
            ends = np.cumsum(size)
            where = np.arange(ends[-1]) - np.repeat(ends - size, size)
            with np.errstate(over="ignore"):
                power = np.cumprod(np.full(int(size.max()), 0x9E3779B97F4A7C15, np.uint64))
                terms = (self.data[where + np.repeat(start, size)].astype(np.uint64) + np.uint64(1)) * power[where]
                out[at : at + block] = mixed(np.add.reduceat(terms, ends - size) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        return out


def hash_words(words: list[bytes]) -> np.ndarray:
    """The hashes that Words gives to these words."""
    if not words:
        return np.zeros(0, np.uint64)
    out = np.empty(len(words), np.uint64)
    with np.errstate(over="ignore"):
        for i, w in enumerate(words):
            power = np.cumprod(np.full(len(w), 0x9E3779B97F4A7C15, np.uint64))
            terms = (np.frombuffer(w, np.uint8).astype(np.uint64) + np.uint64(1)) * power
            out[i] = terms.sum(dtype=np.uint64) + np.uint64(len(w)) * np.uint64(0xD6E8FEB86659FD93)
    return mixed(out)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
