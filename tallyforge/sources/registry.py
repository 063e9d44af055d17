"""All readers of package files under one evidence schema, in order of precedence, and a data source that lists and reads a tree.

A reader names the files that it reads by a pattern over their paths, and how their rows become evidence. inventory() unites the rows
of any set of readers as they are; first_by_precedence() leaves one row a purl. The data source `inventory_tree` gives reader, path, size
and text of the files that some of the readers it is given want, so that those of others are neither planned nor opened. It takes
no filters from Spark: a plan that uses one frame under two filters, as a union over readers does, would push both into the same scan.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.keys import package_purl
from ..operators.merge import first_seen
from . import locks, text

EVIDENCE = {
    "reader": "string", "rank": "int", "path": "string", "ord": "bigint", "ecosystem": "string", "name": "string", "version": "string", "purl": "string", "tier": "string", "source_type": "string", "is_dev": "boolean", "depends": "array<string>",
}


@dataclass(frozen=True)
class Reader:
    """pattern: of the paths that it reads; read: rows of files (path, text); names: columns of EVIDENCE by their expression over these rows."""

    name: str
    ecosystem: str
    pattern: str
    read: Callable[[DataFrame], DataFrame]
    names: tuple[tuple[str, str], ...] = ()
    tier: str = "source"
    vendor: str | None = None


#: In order of precedence: what is installed counts before what is locked, and that before what is asked for.
READERS = (
    Reader("dpkg", "deb", r"(^|/)var/lib/dpkg/status$", text.dpkg, tier="deployed", vendor="debian"),
    Reader("apk", "apk", r"(^|/)lib/apk/db/installed$", text.apk, tier="deployed"),
    Reader("poetry", "pypi", r"(^|/)poetry\.lock$", locks.poetry_lock),
    Reader("pipfile", "pypi", r"(^|/)Pipfile\.lock$", text.pipfile_lock),
    Reader("requirements", "pypi", r"(^|/)requirements[^/]*\.txt$", text.requirements),
    Reader("package-lock", "npm", r"(^|/)package-lock\.json$", text.package_lock),
    Reader("pnpm", "npm", r"(^|/)pnpm-lock\.yaml$", locks.pnpm_lock),
    Reader("package-json", "npm", r"^(?!.*node_modules/).*(^|/)package\.json$", locks.package_json, (("version", "null"),), tier="design"),
    Reader("go.sum", "golang", r"(^|/)go\.sum$", lambda df: text.go_sum(df).where("kind = 'module'"), (("name", "module"),)),
    Reader("cargo", "cargo", r"(^|/)Cargo\.lock$", locks.cargo_lock),
    Reader("gemfile", "gem", r"(^|/)Gemfile\.lock$", text.gemfile_lock),
)


def evidence(rows: DataFrame, reader: Reader, rank: int) -> DataFrame:
    """rows of a reader under EVIDENCE; columns that they lack are null. Also how rows that no file reader gave (of executables, say) join the others."""
    named = dict(reader.names)
    have = {*rows.columns, *named}
    own = lambda c: F.expr(named[c]) if c in named else F.col(c)
    value: dict[str, Column] = {c: own(c) if c in have else F.lit(None) for c in EVIDENCE}
    arch = own("arch") if "arch" in have else None
    value |= {"reader": F.lit(reader.name), "rank": F.lit(rank), "ecosystem": F.lit(reader.ecosystem)}
    value["tier"] = F.coalesce(own("tier"), F.lit(reader.tier)) if "tier" in have else F.lit(reader.tier)
    if "purl" not in have:
        own_purl = F.when(value["version"].isNotNull() | F.lit(reader.ecosystem == "pypi"), package_purl(F.lit(reader.ecosystem), value["name"], value["version"], arch=arch, vendor=F.lit(reader.vendor)))
        # behind a generator, as a filter on purls would else make each a second time
        rows, value["purl"] = rows.select("*", F.explode(F.array(own_purl)).alias("purl")), F.col("purl")
    return rows.select(*(value[c].cast(kind).alias(c) for c, kind in EVIDENCE.items()))


def reader_of(path: Column, readers: tuple[Reader, ...] = READERS) -> Column:
    """The first reader that wants a path, or null."""
    return F.coalesce(*(F.when(path.rlike(r.pattern), F.lit(r.name)) for r in readers))


def united(tables: list[DataFrame]) -> DataFrame:
    """Tables of evidence, all rows."""
    out = None
    for table in tables:
        own = table.select(*(F.col(c).cast(kind).alias(c) for c, kind in EVIDENCE.items()))
        out = own if out is None else out.unionByName(own)
    return out


def inventory(files: DataFrame, readers: tuple[Reader, ...] = READERS, *more: DataFrame) -> DataFrame:
    """EVIDENCE of files (path, text), and of more tables of evidence: all rows, none merged. A file goes to the first reader that wants it."""
    files = files.select("path", "text", reader_of(F.col("path"), readers).alias("reader"))
    return united([*(evidence(r.read(files.where(F.col("reader") == r.name).select("path", "text")), r, i) for i, r in enumerate(readers)), *more])


def tree_inventory(spark: SparkSession, root: str, readers: tuple[Reader, ...] = READERS, *more: DataFrame) -> DataFrame:
    """inventory() of the files under root, each reader with a scan that lists and opens its own files only."""
    return united([*(evidence(r.read(tree(spark, root, readers, only=r.name).select("path", "text")), r, i) for i, r in enumerate(readers)), *more])


def first_by_precedence(rows: DataFrame) -> DataFrame:
    """One row a purl: the first by rank, path and place. Rows without a purl stay as they are."""
    return counted_by_precedence(rows).drop("n_rows").unionByName(rows.where("purl is null"))


def counted_by_precedence(rows: DataFrame) -> DataFrame:
    """One row a purl as in first_by_precedence(), and n_rows, how many rows it had, in one pass over rows. Those without a purl are left out."""
    return first_seen(rows.where("purl is not null"), ["purl"], "rank", "path", "ord", count="n_rows")


# ---- the data source


@dataclass
class Files(InputPartition):
    """Some files of a tree: reader, path below the root, size."""

    files: list[tuple[str, str, int]]


def file_system(root: str):
    """The file system of a path or URI, and the path there."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(root if re.match(r"^[a-z0-9]+:/", root) else f"file://{root}")


class TreeReader(DataSourceReader):
    def __init__(self, root: str, patterns: list[list[str]], only: str | None, part_bytes: int, part_files: int, most_bytes: int | None, parts: int) -> None:
        self.root, self.patterns, self.only, self.part_bytes, self.part_files, self.most_bytes, self.parts = root, patterns, only, part_bytes, part_files, most_bytes, parts

    def partitions(self) -> list[Files]:
        """The listing, cut into runs of files of about part_bytes, or of less but 1 MB for `parts` of them; larger files than most_bytes are left out where it is given."""
        from pyarrow.fs import FileSelector, FileType

        fs, base = file_system(self.root)
        readers = [(n, re.compile(p)) for n, p in self.patterns]
        found = []
        for info in sorted(fs.get_file_info(FileSelector(base, recursive=True)), key=lambda i: i.path):
            path = info.path[len(base) :].lstrip("/")
            name = next((n for n, p in readers if p.search(path)), None) if info.type == FileType.File else None
            if name is None or self.most_bytes is not None and info.size > self.most_bytes or self.only not in (None, name):
                continue
            found.append((name, path, info.size))
        enough = min(self.part_bytes, max(sum(f[2] for f in found) // self.parts, 1 << 20))
        out, run, size = [], [], 0
        for file in found:
            run.append(file)
            size += file[2]
            if size >= enough or len(run) >= self.part_files:
                out.append(Files(run))
                run, size = [], 0
        return [*out, Files(run)] if run or not out else out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(self.root)
        for name, path, size in partition.files:
            with fs.open_input_stream(f"{base}/{path}") as f:
                body = f.read().decode("utf-8", "replace")
            yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in ((name, pa.string()), (path, pa.string()), (size, pa.int64()), (body, pa.string()))], names=["reader", "path", "size", "text"])


class TreeSource(DataSource):
    """spark.read.format("inventory_tree").load(root): options readers (JSON pairs of name and pattern), only (one of them), part_bytes, part_files, most_bytes and parts."""

    @classmethod
    def name(cls) -> str:
        return "inventory_tree"

    def schema(self) -> str:
        return "reader string, path string, size bigint, text string"

    def reader(self, schema) -> TreeReader:
        number = lambda k, default: int(x) if (x := self.options.get(k, default)) is not None else None
        return TreeReader(self.options["path"].rstrip("/"), json.loads(self.options["readers"]), self.options.get("only"), number("part_bytes", 32 << 20), number("part_files", 2000), number("most_bytes", None), number("parts", 1))


def tree(spark: SparkSession, root: str, readers: tuple[Reader, ...] = READERS, only: str | None = None, **options: int) -> DataFrame:
    """reader, path, size, text of the files under root that some reader wants, or that go to the one that is named."""
    spark.dataSource.register(TreeSource)
    patterns = json.dumps([(r.name, r.pattern) for r in readers])
    options = {"parts": spark.sparkContext.defaultParallelism, **options}
    frame = spark.read.format("inventory_tree").option("readers", patterns).options(**{k: str(v) for k, v in options.items()})
    return (frame.option("only", only) if only else frame).load(root)


def write_tree(files: DataFrame, root: str) -> int:
    """Writes files (path, text) below root, a file each; how many."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(root)
        for batch in batches:
            for path, body in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                fs.create_dir(f"{base}/{path}".rpartition("/")[0], recursive=True)
                with fs.open_output_stream(f"{base}/{path}") as f:
                    f.write(body.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    return files.select("path", "text").mapInArrow(write, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
