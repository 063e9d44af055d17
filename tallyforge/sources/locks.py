"""Readers of lock files and package metadata in JSON, TOML, YAML and plain text, over (path, text) rows.

Each takes whole files as rows and explodes them where they are read. Null or malformed files give no rows, but lock file
versions that are not supported raise an error, as a wrong inventory would be worse.
"""

from __future__ import annotations

import json
import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.types import STRING
from ..functions.wire import requirement_name
from ..operators.lineage import spread
from .text import _lines

NO_TEXTS = "array<string>"


def _toml(text: str | None) -> str | None:
    try:
        return None if text is None else json.dumps(tomllib.loads(text), default=str)
    except tomllib.TOMLDecodeError:
        return None


@F.pandas_udf(STRING)
def toml_json(text: pd.Series) -> pd.Series:
    """TOML as JSON; null for what isn't TOML."""
    return text.map(_toml, na_action="ignore")


def _none() -> Column:
    return F.array().cast(NO_TEXTS)


def poetry_lock(df: DataFrame, include_dev: bool = False) -> DataFrame:
    """path, name, version, is_dev, depends of poetry.lock: dev by category, else by groups without main."""
    one = "struct<name:string,version:string,category:string,groups:array<string>,dependencies:map<string,string>>"
    doc = F.from_json(toml_json("text"), f"package array<{one}>")
    rows = df.select("path", F.explode(doc["package"]).alias("p")).where(F.col("p.name").isNotNull() & F.col("p.version").isNotNull())
    dev = F.when(F.col("p.category").isNotNull(), F.col("p.category") == "dev").when(F.size("p.groups") > 0, ~F.array_contains("p.groups", "main")).otherwise(F.lit(False))
    out = rows.select("path", F.col("p.name").alias("name"), F.col("p.version").alias("version"), dev.alias("is_dev"), F.coalesce(F.array_sort(F.map_keys("p.dependencies")), _none()).alias("depends"))
    return out if include_dev else out.where(~F.col("is_dev"))


def pieces(df: DataFrame) -> DataFrame:
    """path, part, piece: TOML files (path, text) cut before each line that begins with [[package]], dealt over the cores."""
    return spread(df.where("text is not null").select("path", F.posexplode(F.split("text", r"(?m)^(?=\[\[package\]\])")).alias("part", "piece")), "path", "part")


def cargo_lock(df: DataFrame) -> DataFrame:
    """path, ord, name, version, source_type (registry, git, path), checksum, depends of Cargo.lock 3 and 4.

    Older versions raise an error; packages without a source are the workspace's own and give no rows. A file is parsed a package at
    a time; where that might not give what the whole file does (a piece that isn't TOML, two packages in one, a key in two pieces),
    the file is parsed as a whole.
    """
    one = "struct<name:string,version:string,source:string,checksum:string,dependencies:array<string>>"
    form = f"version int, package array<{one}>"
    read = pieces(df).select("path", "part", toml_json("piece").alias("json")).withColumns({"doc": F.from_json("json", form), "keys": F.json_object_keys("json")})
    others = F.array_except("keys", F.when(F.col("part") > 0, F.array(F.lit("package"))).otherwise(F.array().cast(NO_TEXTS)))
    file = Window.partitionBy("path")
    alone = F.max("part").over(file) == 0
    # version stands in the first piece; other keys may stand in one of the pieces each
    each = F.col("json").isNotNull() & F.when(F.col("part") > 0, F.size("doc.package") == 1).otherwise(~F.array_contains("keys", "package") | alone)
    judged = read.withColumn("others", others).withColumns({
        "sound": F.bool_and(F.coalesce(each, F.lit(False))).over(file) & (F.coalesce(F.sum(F.size("others")).over(file), F.lit(0)) == F.size(F.array_distinct(F.flatten(F.collect_list(F.when(F.size("others") > 0, F.col("others"))).over(file))))),
        "version": F.max(F.when(F.col("part") == 0, F.col("doc.version"))).over(file),
    })
    whole = df.join(judged.where("not sound").select("path").distinct(), "path", "left_semi").select("path", F.from_json(toml_json("text"), form).alias("doc")).where("doc is not null and doc.package is not null")
    rows = judged.where("sound and doc.package is not null").select("path", "version", F.greatest(F.col("part") - 1, F.lit(0)).alias("at"), F.col("doc.package").alias("package"))
    rows = rows.unionByName(whole.select("path", F.col("doc.version").alias("version"), F.lit(0).alias("at"), F.col("doc.package").alias("package")))
    version = F.coalesce("version", F.lit(1))
    packages = F.when(version < 3, F.raise_error(F.concat(F.lit("lock file version is not supported: "), version.cast("string"))).cast(f"array<{one}>")).otherwise(F.col("package"))
    rows = rows.select("path", "at", F.posexplode(packages).alias("ord", "p")).withColumn("ord", F.col("at") + F.col("ord")).where(F.col("p.source").isNotNull())
    kind = F.when(F.startswith("p.source", F.lit("git+")), "git").when(F.startswith("p.source", F.lit("path+")), "path").otherwise("registry")
    return rows.select("path", "ord", F.col("p.name").alias("name"), F.col("p.version").alias("version"), kind.alias("source_type"), F.col("p.checksum").alias("checksum"), F.coalesce(F.transform("p.dependencies", lambda d: F.substring_index(d, " ", 1)), _none()).alias("depends"))


def cargo_edges(df: DataFrame) -> DataFrame:
    """path, src, dst (name@version): dependencies of Cargo.lock met with the packages listed, the first version of a name."""
    rows = cargo_lock(df)
    index = rows.groupBy("path", "name").agg(F.min_by("version", "ord").alias("to_version"))
    needs = rows.select("path", F.concat_ws("@", "name", "version").alias("src"), F.explode("depends").alias("name"))
    return needs.join(index, ["path", "name"]).select("path", "src", F.concat_ws("@", "name", "to_version").alias("dst")).where("src <> dst").distinct()


def pnpm_lock(df: DataFrame, include_dev: bool = False) -> DataFrame:
    """path, ord, name, version, is_dev, integrity, depends of the packages of pnpm-lock.yaml; peers are cut from versions."""
    by = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda x: F.last(x, ignorenulls=True).over(by)
    rows = _lines(df).where(F.trim("line") != "")
    rows = rows.withColumn("section", last(F.when(F.col("line").rlike("^[^ #]"), F.regexp_extract("line", "^([A-Za-z]+):", 1)))).where("section = 'packages'")
    key = F.regexp_replace(F.regexp_extract("line", r"^  ([^ ].*):\s*(?:\{\})?$", 1), "^['\"]?/?|['\"]$", "")
    rows = rows.withColumn("own", last(F.when(F.col("line").rlike("^  [^ ]"), F.struct("line_no", key.alias("key"))))).where("own.key <> ''")
    rows = rows.withColumn("part", last(F.when(F.col("line").rlike("^ {2,4}[^ ]"), F.regexp_extract("line", r"^    ([A-Za-z]+):", 1))))
    need = F.when((F.col("part") == "dependencies") & F.col("line").rlike("^ {6}[^ ]"), F.regexp_extract("line", r"^ {6}['\"]?(@?[^'\":]+)", 1))
    each = rows.groupBy("path", "own").agg(
        F.bool_or(F.col("line").rlike(r"^    dev:\s*true")).alias("is_dev"),
        F.max(F.nullif(F.regexp_extract("line", r"integrity:\s*([^,}\s]+)", 1), F.lit(""))).alias("integrity"),
        F.array_sort(F.collect_set(need)).alias("depends"),
    )
    plain = F.regexp_replace("own.key", r"\(.*$", "")
    form = r"^(@?[^@]+)[@/]([^@/_]+).*$"
    out = each.select("path", F.col("own.line_no").alias("ord"), F.regexp_extract(plain, form, 1).alias("name"), F.regexp_extract(plain, form, 2).alias("version"), "is_dev", "integrity", "depends")
    out = out.where("name <> ''")
    return out if include_dev else out.where("not is_dev")


def integrity(x: Column) -> Column:
    """algorithm and hex value of `sha512-<base64>`; null for other forms."""
    form = r"^(sha1|sha256|sha384|sha512)-([A-Za-z0-9+/]+=*)$"
    return F.when(x.rlike(form), F.struct(F.regexp_extract(x, form, 1).alias("alg"), F.lower(F.hex(F.unbase64(F.regexp_extract(x, form, 2)))).alias("value")))


def package_json(df: DataFrame, include_dev: bool = False) -> DataFrame:
    """path, name, range_spec, is_dev, tier (design): what a package.json asks for."""
    doc = F.from_json("text", "dependencies map<string,string>, devDependencies map<string,string>")
    each = lambda key, dev: df.select("path", F.explode(doc[key]).alias("name", "range_spec"), F.lit(dev).alias("is_dev"))
    out = each("dependencies", False)
    out = out.unionByName(each("devDependencies", True)) if include_dev else out
    return out.withColumn("tier", F.lit("design"))


def node_modules(df: DataFrame, image: bool = False) -> DataFrame:
    """path, name, version, author, license, npm_role of installed packages: package.json right below a (scoped) module folder.

    npm's own bundled tree is left out, or marked `internal` in images.
    """
    rows = df.where(F.col("path").rlike(r"(^|/)node_modules/(@[^/@]+/)?[^/@.][^/]*/package\.json$"))
    doc = F.from_json("text", "name string, version string, license string, author string")
    inside = F.col("path").rlike(r"(^|/)node_modules/npm/node_modules/")
    rows = rows.select("path", doc.alias("d"), F.when(inside, "internal").alias("npm_role")).where("d.name is not null and d.version is not null")
    rows = rows if image else rows.where("npm_role is null")
    author = F.when(F.startswith("d.author", F.lit("{")), F.get_json_object("d.author", "$.name")).otherwise(F.trim(F.regexp_replace("d.author", r"\s*[<(].*$", "")))
    return rows.select("path", F.col("d.name").alias("name"), F.col("d.version").alias("version"), F.nullif(author, F.lit("")).alias("author"), F.col("d.license").alias("license"), "npm_role")


def npm_tiers(package_locks: DataFrame, pnpm_locks: DataFrame, installed: DataFrame, asked: DataFrame) -> DataFrame:
    """root, tier, name, version: of each root the rows of the first reader that found any."""
    from ..operators.merge import first_tier

    root = {"package-lock": r"/?[^/]*$", "pnpm": r"/?[^/]*$", "installed": r"/?node_modules/.*$", "package.json": r"/?[^/]*$"}
    parts = []
    for tier, ((kind, cut), rows) in enumerate(zip(root.items(), (package_locks, pnpm_locks, installed, asked), strict=True), 1):
        version = F.col("version") if "version" in rows.columns else F.lit(None).cast("string")
        parts.append(rows.select(F.regexp_replace("path", cut, "").alias("root"), F.lit(tier).alias("tier"), F.lit(kind).alias("reader"), "name", version.alias("version")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return first_tier(out, "root", "tier")


def metadata(df: DataFrame) -> DataFrame:
    """path and the headers of Python METADATA: all lines up to the first empty one, folded lines joined, names repeated.

    name, version, license_expression, license, classifiers, depends, author.
    """
    head = F.regexp_replace(F.substring_index(F.replace(F.col("text"), F.lit("\r"), F.lit("")), "\n\n", 1), r"\n[ \t]+", " ")
    named = F.filter(F.split(head, "\n"), lambda x: F.instr(x, ":") > 0)
    pairs = F.transform(named, lambda x: F.struct(F.lower(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    # behind a generator, so that the headers are cut once and not again for each field that is taken of them
    df = df.select("path", F.explode(F.array(pairs)).alias("headers"))
    every = lambda k: F.transform(F.filter("headers", lambda x: x["k"] == k), lambda x: x["v"])
    first = lambda k: F.nullif(F.get(every(k), 0), F.lit(""))
    depends = F.array_distinct(F.array_compact(F.transform(every("requires-dist"), requirement_name)))
    author = F.coalesce(first("author"), first("author-email"), first("maintainer"))
    out = df.select("path", first("name").alias("name"), first("version").alias("version"), first("license-expression").alias("license_expression"), first("license").alias("license"), every("classifier").alias("classifiers"), depends.alias("depends"), author.alias("author"))
    return out.where("name is not null and version is not null")


def gemspec(df: DataFrame) -> DataFrame:
    """path, name, version, authors, licenses of gemspec files, by their assignments."""
    value = lambda k: F.nullif(F.regexp_extract("text", rf"\.{k}\s*=\s*['\"]([^'\"]+)['\"]", 1), F.lit(""))
    many = lambda k: F.regexp_extract_all(F.regexp_extract("text", rf"\.{k}\s*=\s*(\[[^\]]*\]|['\"][^'\"]*['\"])", 1), F.lit(r"['\"]([^'\"]+)['\"]"), 1)
    version = F.coalesce(value("version"), F.nullif(F.regexp_extract("text", r"\.version\s*=\s*Gem::Version\.new\(?\s*['\"]([^'\"]+)", 1), F.lit("")))
    out = df.select("path", value("name").alias("name"), version.alias("version"), many("authors?").alias("authors"), many("licenses?").alias("licenses"))
    return out.where("name is not null and version is not null")


def go_imports(df: DataFrame) -> DataFrame:
    """path, module path of every import of Go sources, single or in blocks; test files are left out."""
    code = F.regexp_replace("text", r"(?m)//.*$", "")
    blocks = F.array_join(F.regexp_extract_all(code, F.lit(r"(?m)^import\s*\(([^)]*)\)"), 1), "\n")
    single = F.regexp_extract_all(code, F.lit(r'(?m)^import\s+(?:[\w.]+\s+)?"([^"]+)"'), 1)
    inside = F.regexp_extract_all(blocks, F.lit(r'"([^"]+)"'), 1)
    return df.where(~F.endswith("path", F.lit("_test.go")) & F.endswith("path", F.lit(".go"))).select("path", F.explode(F.array_distinct(F.concat(single, inside))).alias("import"))


def jar_dependencies(df: DataFrame) -> DataFrame:
    """path, ord, group, artifact, version, classifier, license of META-INF/DEPENDENCIES: `group:artifact:jar[:classifier]:version`.

    The licence is on the next line that isn't blank, if that begins with `License:`.
    """
    by = Window.partitionBy("path").orderBy("line_no")
    rows = _lines(df).where(F.trim("line") != "").withColumn("next", F.trim(F.lead("line").over(by)))
    form = r"\b([A-Za-z0-9_.-]+):([A-Za-z0-9_.-]+):jar:(?:([A-Za-z0-9_.-]+):)?([A-Za-z0-9_.+-]+)\s*$"
    part = lambda k: F.regexp_extract("line", form, k)
    own = F.when(F.startswith("next", F.lit("License:")), F.trim(F.regexp_replace("next", r"^License:\s*|\s*\(.*$", "")))
    return rows.where(F.col("line").rlike(form)).select("path", F.col("line_no").alias("ord"), part(1).alias("group"), part(2).alias("artifact"), part(4).alias("version"), F.nullif(part(3), F.lit("")).alias("classifier"), F.nullif(own, F.lit("")).alias("license"))


def properties(df: DataFrame) -> DataFrame:
    """path, properties (map): key=value lines; # and ! begin comments, the last of repeated keys counts."""
    lines = F.filter(F.transform(F.split(F.col("text"), r"\r?\n"), lambda z: F.trim(z)), lambda x: x.rlike("^[^#!=][^=]*="))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^=]*=", "")).alias("v")))
    once = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["k"] == x["k"]))
    return df.select("path", F.map_from_entries(once).alias("properties"))


def mapping_rows(df: DataFrame) -> DataFrame:
    """id, label, three locations and their classes of the rows of a markdown table whose first cell is an id like C12b."""
    cells = F.transform(F.split("line", r"(?<!\\)\|"), lambda z: F.trim(z))
    rows = _lines(df).withColumn("c", cells).where(F.get("c", 1).rlike("^[A-H][0-9]+[a-z]?$") & (F.size("c") >= 6))
    kind = lambda k: F.when(F.get("c", k).rlike("^omitted — "), "omitted").when(F.get("c", k).rlike("^defer( — |until )|^defer until "), "deferred").otherwise("present")
    return rows.select("path", F.col("line_no").alias("ord"), F.get("c", 1).alias("id"), F.get("c", 2).alias("label"), *(F.get("c", k).alias(f"at_{n}") for n, k in (("cdx", 3), ("spdx2", 4), ("spdx3", 5))), *(kind(k).alias(f"class_{n}") for n, k in (("cdx", 3), ("spdx2", 4), ("spdx3", 5))))
