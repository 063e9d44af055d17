"""Readers of package databases and lock files that are text or JSON, over (path, text) rows.

files() reads whole files; each reader takes such a DataFrame and explodes it into rows, so that a table of many thousand
files is parsed where it is read. Files whose text is null or malformed give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Suffixes of package archives that a walk looks for.
ARTIFACTS = (".deb", ".udeb", ".crate", ".whl", ".tar.gz", ".tgz", ".tar.bz2", ".tar.xz", ".jar", ".war", ".aar", ".gem", ".zip", ".egg")


def files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path and text of the files under root whose names match."""
    read = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    return read.text(root).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def walk(spark: SparkSession, root: str, *, suffixes: tuple[str, ...] = ARTIFACTS, most_bytes: int = 256 << 20, since: str | None = None) -> DataFrame:
    """path, size, mtime, sha256 of files with one of the suffixes (any case), up to a size, changed since."""
    out = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= most_bytes)
    if since:
        out = out.where(F.col("modificationTime") >= F.lit(since).cast("timestamp"))
    if suffixes:
        out = out.where(F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"))
    return out.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("sha256"))


def project_roots(listing: DataFrame, markers: tuple[str, ...], *, most_depth: int = 6, skip: tuple[str, ...] = (), distinct: bool = True) -> DataFrame:
    """root: folders of listing (path) that hold a marker file, at most most_depth folders deep, none named in skip."""
    parts = F.split("path", "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    kept = listing.where(F.element_at(parts, -1).isin(*markers) & (F.size(folders) - 1 <= most_depth) & ~F.arrays_overlap(folders, F.array(*map(F.lit, skip)).cast("array<string>")))
    out = kept.select(F.array_join(folders, "/").alias("root"))
    return out.distinct() if distinct else out


def first_text(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """key, text: of the first table where it has a text, else of the second."""
    a, b = first.select(key, F.col("text").alias("a_")), second.select(key, F.col("text").alias("b_"))
    return a.join(b, key, "full").select(key, F.coalesce("a_", "b_").alias("text"))


def _lines(df: DataFrame) -> DataFrame:
    return df.select("path", F.posexplode(F.split(F.replace(F.col("text"), F.lit("\r"), F.lit("")), "\n")).alias("line_no", "line"))


def stanzas(df: DataFrame, sep: str = ":") -> DataFrame:
    """path, stanza, fields (map): blank-line separated blocks of `Name: value`; folded lines join the line before."""
    blocks = df.select("path", F.posexplode(F.split(F.replace(F.col("text"), F.lit("\r"), F.lit("")), r"\n[ \t]*\n+")).alias("stanza", "block"))
    lines = F.filter(F.split(F.regexp_replace("block", r"\n[ \t]+", " "), "\n"), lambda x: F.instr(x, sep) > 0)
    pair = lambda x: F.struct(F.trim(F.substring_index(x, sep, 1)).alias("k"), F.trim(F.regexp_replace(x, f"^[^{sep}]*{sep}", "")).alias("v"))
    # lines and fields each behind a generator, as they would else be made again for each field that is taken of them
    seen = blocks.select("path", "stanza", F.explode(F.array(F.transform(lines, pair))).alias("seen"))
    names = F.transform("seen", lambda x: x["k"])
    # the last of repeated names counts
    once = F.filter("seen", lambda x, i: ~F.exists(F.slice("seen", i + 2, F.size("seen")), lambda y: y["k"] == x["k"]))
    once = F.when(F.size(F.array_distinct(names)) == F.size(names), F.col("seen")).otherwise(once)
    return seen.where(F.size("seen") > 0).select("path", "stanza", F.explode(F.array(F.map_from_entries(once))).alias("fields"))


def dpkg_depends(x: Column) -> Column:
    """Names of a Depends field: all alternatives, without versions and architectures."""
    names = F.transform(F.split(x, r"[,|]"), lambda p: F.regexp_replace(F.trim(F.regexp_replace(p, r"\(.*?\)", "")), r":[a-z0-9-]+$", ""))
    return F.filter(names, lambda n: n != "")


def dpkg(df: DataFrame) -> DataFrame:
    """Installed packages of a dpkg status file: path, ord, name, version, arch, maintainer, depends."""
    f = lambda k: F.try_element_at("fields", F.lit(k))
    rows = stanzas(df).where(F.contains(F.coalesce(f("Status"), F.lit("")), F.lit("install ok installed")) & f("Package").isNotNull() & f("Version").isNotNull())
    return rows.select("path", F.col("stanza").alias("ord"), f("Package").alias("name"), f("Version").alias("version"), f("Architecture").alias("arch"), f("Maintainer").alias("maintainer"), F.coalesce(dpkg_depends(f("Depends")), F.array().cast("array<string>")).alias("depends"))


def apk_depends(x: Column) -> Column:
    """Names of a D: field: no conflicts, paths or typed entries, cut at a version operator."""
    kept = F.filter(F.split(x, r"\s+"), lambda p: (p != "") & ~p.rlike(r"^[!/]") & ~F.contains(p, F.lit(":")))
    return F.transform(kept, lambda p: F.regexp_extract(p, r"^[^<>=~]+", 0))


def apk(df: DataFrame) -> DataFrame:
    """Packages of an apk installed file: path, ord, name, version, arch, maintainer, license, depends."""
    f = lambda k: F.try_element_at("fields", F.lit(k))
    rows = stanzas(df).where(f("P").isNotNull() & f("V").isNotNull())
    return rows.select("path", F.col("stanza").alias("ord"), f("P").alias("name"), f("V").alias("version"), f("A").alias("arch"), f("m").alias("maintainer"), f("L").alias("license"), F.coalesce(apk_depends(f("D")), F.array().cast("array<string>")).alias("depends"))


def go_sum(df: DataFrame) -> DataFrame:
    """path, ord, module, version, kind (module or gomod), sha256 of the h1 hashes."""
    parts = F.split("line", r"\s+")
    rows = _lines(df).where(F.size(parts) >= 3)
    mod = F.endswith(F.get(parts, 1), F.lit("/go.mod"))
    return rows.select("path", F.col("line_no").alias("ord"), F.get(parts, 0).alias("module"), F.regexp_replace(F.get(parts, 1), "/go.mod$", "").alias("version"), F.when(mod, "gomod").otherwise("module").alias("kind"), F.lower(F.hex(F.unbase64(F.regexp_replace(F.get(parts, 2), "^h1:", "")))).alias("sha256"))


def requirements(df: DataFrame) -> DataFrame:
    """path, ord, name, version (of == pins), range_spec, source_type, hashes, tier of requirements lines; options are skipped.

    A requirement from git, a URL or a local path has that source type; names come from #egg= or from before @. Those
    without a pin and without such a source are of tier design.
    """
    joined = df.withColumn("text", F.regexp_replace("text", r"\\\r?\n", " "))
    line = F.trim(F.regexp_replace("line", r"(^|\s)#.*$", ""))
    rows = _lines(joined).withColumn("line", line).where((F.col("line") != "") & ~F.startswith("line", F.lit("-")))
    spec = F.trim(F.regexp_replace(F.regexp_replace("line", r"\s--hash=\S+", ""), r"\s*;.*$", ""))
    rows = rows.withColumn("spec", spec)
    named_at = F.col("spec").rlike(r"^[A-Za-z0-9._-]+(\[[^\]]*\])?\s*@\s")
    target = F.when(named_at, F.regexp_extract("spec", r"@\s+(\S+)", 1)).otherwise(F.col("spec"))
    source = F.when(target.rlike(r"^(git|hg|svn|bzr)\+"), "git").when(target.rlike("^(https?|ftp)://"), "url").when(target.rlike(r"^(file:|\.{0,2}/)"), "local")
    rows = rows.withColumn("source_type", source).where(F.col("source_type").isNotNull() | F.col("spec").rlike(r"^[A-Za-z0-9]"))
    egg = F.regexp_extract("line", r"#egg=([A-Za-z0-9._-]+)", 1)
    plain = F.regexp_extract("spec", r"^[A-Za-z0-9._-]+", 0)
    name = F.when(named_at | F.col("source_type").isNull(), plain).otherwise(F.nullif(egg, F.lit("")))
    free = F.col("source_type").isNull()
    pin = F.when(free, F.nullif(F.regexp_extract("spec", r"^[^=<>!~]+===?\s*([^\s,*]+)$", 1), F.lit("")))
    spec_of = F.when(free, F.nullif(F.trim(F.regexp_extract("spec", r"[=<>!~].*$", 0)), F.lit("")))
    hashes = F.array_distinct(F.regexp_extract_all("line", F.lit(r"--hash=(sha(?:256|512|1):[0-9a-f]+)"), 1))
    return rows.select("path", F.col("line_no").alias("ord"), name.alias("name"), pin.alias("version"), spec_of.alias("range_spec"), "source_type", hashes.alias("hashes"), F.when(free & pin.isNull(), "design").otherwise("source").alias("tier"))


def gemfile_lock(df: DataFrame) -> DataFrame:
    """path, ord, section, name, version, depends: indent 4 starts a gem, indent 6 names one it needs."""
    by = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = _lines(df).withColumn("section", F.last(F.when(F.col("line").rlike("^[A-Z]"), F.col("line")), ignorenulls=True).over(by))
    rows = rows.withColumn("spec", F.last(F.when(F.col("line").rlike("^    [^ ]"), F.struct("line_no", "line")).otherwise(F.when(F.col("line").rlike("^ {0,3}[^ ]"), F.struct(F.lit(-1).alias("line_no"), F.lit("").alias("line")))), ignorenulls=True).over(by))
    needs = F.when(F.col("line").rlike("^ {6,}[^ ]"), F.regexp_extract("line", r"^ +([^ (!]+)", 1))
    each = rows.where("spec.line_no >= 0").groupBy("path", "section", F.col("spec.line_no").alias("ord"), F.col("spec.line").alias("spec")).agg(F.array_sort(F.collect_list(F.when(needs.isNotNull(), F.struct("line_no", needs.alias("name"))))).alias("d"))
    return each.where(F.col("section").isin("GEM", "GIT", "PATH")).select("path", "ord", "section", F.regexp_extract("spec", r"^ +([^ (]+)", 1).alias("name"), F.regexp_extract("spec", r"\(([^)]+)\)", 1).alias("version"), F.transform("d", lambda x: x["name"]).alias("depends"))


def package_lock(df: DataFrame, include_dev: bool = False) -> DataFrame:
    """path, key, name, version, is_dev, license, sha (hex of the integrity), depends of package-lock.json v2 and v3.

    Version 1 files raise an error; the root and links are skipped, and dev and optional ones unless asked for.
    """
    one = "struct<version:string,name:string,dev:boolean,optional:boolean,link:boolean,integrity:string,license:string,dependencies:map<string,string>>"
    doc = F.from_json("text", f"lockfileVersion int, packages map<string,{one}>")
    rows = df.select("path", doc.alias("doc")).where("doc.lockfileVersion is not null")
    packages = F.when(F.col("doc.lockfileVersion") < 2, F.raise_error(F.lit("lockfile version 1 is not supported")).cast(f"map<string,{one}>")).otherwise(F.col("doc.packages"))
    rows = rows.select("path", F.explode(packages).alias("key", "p")).where((F.col("key") != "") & ~F.coalesce("p.link", F.lit(False)))
    if not include_dev:
        rows = rows.where(~F.coalesce("p.dev", F.lit(False)) & ~F.coalesce("p.optional", F.lit(False)))
    sha = F.lower(F.hex(F.unbase64(F.nullif(F.regexp_extract("p.integrity", "^sha[0-9]+-(.*)$", 1), F.lit("")))))
    return rows.select("path", "key", F.coalesce("p.name", F.regexp_extract("key", r"(?:.*node_modules/|^)(.+)$", 1)).alias("name"), F.col("p.version").alias("version"), F.coalesce("p.dev", F.lit(False)).alias("is_dev"), F.col("p.license").alias("license"), sha.alias("sha"), F.coalesce(F.array_sort(F.map_keys("p.dependencies")), F.array().cast("array<string>")).alias("depends"))


def os_release(df: DataFrame) -> DataFrame:
    """path, id, version_id, codename."""
    own = lambda k: F.nullif(F.regexp_extract("text", rf'(?m)^{k}="?([^"\n]*)"?$', 1), F.lit(""))
    return df.select("path", own("ID").alias("id"), own("VERSION_ID").alias("version_id"), F.coalesce(own("VERSION_CODENAME"), own("UBUNTU_CODENAME")).alias("codename"))


def pipfile_lock(df: DataFrame) -> DataFrame:
    """path, name, version (of == pins, else null), is_dev of Pipfile.lock; a package in both groups gives two rows."""
    group = "map<string,struct<version:string>>"
    doc = F.from_json("text", f"`default` {group}, develop {group}")
    each = lambda key, dev: df.select("path", F.explode(doc[key]).alias("name", "p"), F.lit(dev).alias("is_dev"))
    rows = each("default", False).unionByName(each("develop", True))
    return rows.select("path", "name", F.nullif(F.regexp_extract("p.version", r"^==\s*(\S+)$", 1), F.lit("")).alias("version"), "is_dev")


def go_mod(df: DataFrame) -> DataFrame:
    """path, ord, kind (module, require, replace, exclude), module, version, new_module, new_version, indirect of go.mod.

    A directive stands on its own line or opens a block in brackets; the last two names are those of replacements.
    """
    by = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    code = F.regexp_replace("line", r"//.*$|^\s+|\s+(//.*)?$", "")
    rows = _lines(df).select("path", "line_no", code.alias("code"), F.col("line").rlike(r"//\s*indirect").alias("indirect"))
    opened = F.regexp_extract("code", r"^(\w+)\s*\($", 1)
    block = F.when(opened != "", opened).when(F.col("code") == ")", F.lit(""))
    rows = rows.withColumn("block", F.coalesce(F.last(block, ignorenulls=True).over(by), F.lit(""))).where(~F.col("code").rlike(r"^\)$|\($|^$"))
    alone = F.col("block") == ""
    kind = F.when(alone, F.regexp_extract("code", r"^\w+", 0)).otherwise(F.col("block"))
    rows = rows.select("path", "line_no", "indirect", kind.alias("kind"), F.when(alone, F.regexp_replace("code", r"^\w+\s+", "")).otherwise(F.col("code")).alias("rest"))
    sides = F.split("rest", r"\s*=>\s*")
    name = lambda side, i: F.get(F.split(F.get(sides, side), r"\s+"), i)
    return rows.where(F.col("kind").isin("module", "require", "replace", "exclude")).select("path", F.col("line_no").alias("ord"), "kind", name(0, 0).alias("module"), name(0, 1).alias("version"), name(1, 0).alias("new_module"), name(1, 1).alias("new_version"), "indirect")
