"""Queries of the readers: files are written from the part table, one a brand, and read back; the SQL states their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from ..operators import graph
from ..sources import locks, text
from .inventory import query, table
from .scalars import P, case, cat, parts, sql_case

#: The stable name of a part's package, and the one that its dependency names: the part before it of the same brand, if any.
N = "nm || '-' || k"


def written(rows: DataFrame, line: Column, head: str = "", tail: str = "", suffix: str = "", sep: str = "") -> DataFrame:
    """path and text of a file a brand: the lines of its parts in order of k between head and tail."""
    each = rows.groupBy("b").agg(F.sort_array(F.collect_list(F.struct("k", line.alias("line")))).alias("all"))
    body = F.array_join(F.transform("all", lambda x: x["line"]), sep)
    return each.select(F.concat(F.lit("/b"), "b", F.lit(suffix)).alias("path"), F.concat(F.lit(head), body, F.lit(tail)).alias("text"))


def package(*extra: str) -> Column:
    return cat("nm", "-", "k", *extra)


@query(f"{P} SELECT '/b' || b AS path, {N} AS name, '1:' || v || '+x' AS version, 'amd64' AS arch, 'Me <' || nm || '@x.io>' AS maintainer, CASE WHEN k % 2 = 0 THEN 'libc6|a' || b || '|c' ELSE '' END AS depends FROM p WHERE k % 3 <> 1")
def dpkg_reader(spark, d):
    status = F.when(F.col("k") % 3 == 1, "deinstall ok config-files").otherwise("install ok installed")
    depends = F.when(F.col("k") % 2 == 0, cat("Depends: libc6 (>= 2.3), a", "b", ":any | c\n")).otherwise("")
    line = F.concat(package().substr(F.lit(0), F.lit(0)), F.lit("Package: "), package(), F.lit("\nStatus: "), status, cat("\nMaintainer: Me <", "nm", "@x.io>\nArchitecture: amd64\nVersion: 1:", "v", "+x\n"), depends, F.lit("Description: short\n long: text\n .\n\n"))
    rows = text.dpkg(written(parts(spark, d), line))
    return rows.select("path", "name", "version", "arch", "maintainer", F.array_join("depends", "|").alias("depends"))


@query(f"{P} SELECT '/b' || b AS path, {N} AS name, v || '-r0' AS version, 'MIT' AS license, 'musl|x' || b AS depends FROM p WHERE k % 4 <> 3")
def apk_reader(spark, d):
    line = F.concat(F.lit("C:Q1\nP:"), package(), F.when(F.col("k") % 4 != 3, cat("\nV:", "v", "-r0")).otherwise(""), cat("\nA:x86_64\nL:MIT\nD:musl>=1.2 !bad so:libc.so.6 /bin/sh x", "b", "~2\nF:usr\nR:file\n\n"))
    return text.apk(written(parts(spark, d), line)).select("path", "name", "version", "license", F.array_join("depends", "|").alias("depends"))


@query(f"{P} SELECT '/b' || b AS path, 'm.io/' || {N} AS module, 'v' || v AS version, x.kind, sha256(nm || x.kind) AS sha256 FROM p, (VALUES ('module'), ('gomod')) x(kind)")
def go_sum_reader(spark, d):
    h1 = lambda kind: F.base64(F.unhex(F.sha2(F.concat("nm", F.lit(kind)), 256)))
    line = F.concat(F.lit("m.io/"), package(), cat(" v", "v", " h1:"), h1("module"), F.lit("\nm.io/"), package(), cat(" v", "v", "/go.mod h1:"), h1("gomod"), F.lit("\n"))
    return text.go_sum(written(parts(spark, d), line)).select("path", "module", "version", "kind", "sha256")


@query(f"{P} SELECT '/b' || b AS path, {sql_case("'require'", "'require'", "'replace'", "'exclude'")} AS kind, 'm.io/' || {N} AS module, 'v' || v AS version, {sql_case('NULL', 'NULL', "'n.io/' || nm", 'NULL')} AS new_module, k % 4 = 1 AS indirect FROM p UNION ALL SELECT DISTINCT '/b' || b, 'module', 'm.io/own' || b, NULL, NULL, FALSE FROM p")
def go_mod_reader(spark, d):
    own = F.concat(F.lit("m.io/"), package(), cat(" v", "v"))
    line = case(F.concat(F.lit("require "), own, F.lit("\n")), F.concat(F.lit("require (\n\t"), own, F.lit(" // indirect\n)\n")), F.concat(F.lit("replace "), own, cat(" => n.io/", "nm", " v9\n")), F.concat(F.lit("exclude (\n  "), own, F.lit("\n)\n")))
    files = written(parts(spark, d), line, head="go 1.22\n").withColumn("text", F.concat(F.lit("module m.io/own"), F.regexp_extract("path", "[0-9]+", 0), F.lit("\n"), "text"))
    return text.go_mod(files).select("path", "kind", "module", "version", "new_module", "indirect")


@query(f"{P} SELECT '/b' || b AS path, {sql_case(N, N, N, 'nm', N, 'NULL')} AS name, {sql_case('v', 'NULL', 'NULL', 'NULL', 'NULL', 'NULL')} AS version, {sql_case("'=='  || v", "'>=' || v || ', <9'", 'NULL', 'NULL', 'NULL', 'NULL')} AS range_spec, {sql_case('NULL', 'NULL', 'NULL', "'git'", "'url'", "'local'")} AS source_type, {sql_case("'sha256:' || sha256(nm)", "''", "''", "''", "''", "''")} AS hashes, {sql_case("'source'", "'design'", "'design'", "'source'", "'source'", "'source'")} AS tier FROM p")
def requirements_reader(spark, d):
    line = case(
        F.concat(package(), cat("==", "v", " \\\n   --hash=sha256:"), F.sha2("nm", 256), F.lit(" --hash=sha256:"), F.sha2("nm", 256), F.lit("\n")), F.concat(package(), cat(">=", "v", ", <9 ; python_version > '3'  # why\n")), F.concat(package(), F.lit("\n# none\n-r other.txt\n")),
        cat("git+https://x.io/", "nm", ".git@main#egg=", "nm", "\n"), F.concat(package(), cat(" @ https://x.io/", "nm", ".whl\n")), cat("./vendored/", "nm", "\n"),
    )
    rows = text.requirements(written(parts(spark, d), line))
    return rows.select("path", "name", "version", "range_spec", "source_type", F.array_join("hashes", "|").alias("hashes"), "tier")


@query(f"{P} SELECT '/b' || b AS path, {sql_case("'GEM'", "'GEM'", "'GIT'")} AS section, {N} AS name, v AS version, CASE k % 3 WHEN 0 THEN 'x' || b || '|y' ELSE '' END AS depends FROM p")
def gemfile_reader(spark, d):
    section = case(F.lit("GEM"), F.lit("GEM"), F.lit("GIT"))
    line = F.concat(section, F.lit("\n  remote: https://x.io\n  specs:\n    "), package(), cat(" (", "v", ")\n"), F.when(F.col("k") % 3 == 0, cat("      x", "b", " (~> 2)\n      y!\n")).otherwise(""), F.lit("\nPLATFORMS\n  ruby\n\n"))
    return text.gemfile_lock(written(parts(spark, d), line)).select("path", "section", "name", "version", F.array_join("depends", "|").alias("depends"))


@query(f"{P} SELECT '/b' || b AS path, CASE WHEN k % 2 = 0 THEN '@s/' ELSE '' END || {N} AS name, v AS version, 'MIT' AS license, sha256(nm) AS sha, 'a|b' || b AS depends FROM p WHERE k % 5 < 3")
def package_lock_reader(spark, d):
    name = F.concat(F.when(F.col("k") % 2 == 0, "@s/").otherwise(""), package())
    flag = case(F.lit(""), F.lit(""), F.lit(""), F.lit(', "dev": true'), F.lit(', "link": true'))
    line = F.concat(F.lit('"node_modules/x/node_modules/'), name, cat('": {"version": "', "v", '", "license": "MIT", "integrity": "sha256-'), F.base64(F.unhex(F.sha2("nm", 256))), cat('", "dependencies": {"b', "b", '": "1", "a": "2"}'), flag, F.lit("}"))
    files = written(parts(spark, d), line, head='{"lockfileVersion": 3, "packages": {"": {"name": "root"}, ', tail="}}", sep=", ")
    return text.package_lock(files).select("path", "name", "version", "license", "sha", F.array_join("depends", "|").alias("depends"))


@query(f"{P} SELECT '/b' || b AS path, {N} AS name, CASE WHEN k % 3 <> 2 THEN v END AS version, k % 2 = 1 AS is_dev FROM p")
def pipfile_reader(spark, d):
    line = F.concat(F.lit('{"'), F.when(F.col("k") % 2 == 1, "develop").otherwise("default"), F.lit('": {"'), package(), F.lit('": {'), F.when(F.col("k") % 3 != 2, cat('"version": "==', "v", '"')).otherwise(F.lit('"git": "x"')), F.lit("}}}"))
    files = parts(spark, d).select(F.concat(F.lit("/b"), "b").alias("path"), line.alias("text"))
    return text.pipfile_lock(files)


@query("SELECT s_suppkey, CASE s_suppkey % 2 WHEN 0 THEN 'debian' ELSE 'ubuntu' END AS id, CAST(s_nationkey AS VARCHAR) AS version_id, CASE s_suppkey % 3 WHEN 0 THEN 'bookworm' WHEN 1 THEN 'jammy' END AS codename FROM supplier")
def os_release_reader(spark, d):
    key = F.col("s_suppkey")
    body = F.concat(F.lit('PRETTY_NAME="x"\nID='), F.when(key % 2 == 0, "debian").otherwise('"ubuntu"'), F.lit('\nVERSION_ID="'), F.col("s_nationkey").cast("string"), F.when(key % 3 == 0, '"\nVERSION_CODENAME=bookworm\nUBUNTU_CODENAME=no\n').when(key % 3 == 1, '"\nUBUNTU_CODENAME=jammy\n').otherwise('"\n'))
    etc = table(spark, d, "supplier").select(key.cast("string").alias("root"), F.when(key % 4 != 0, body).alias("text"))
    lib = table(spark, d, "supplier").select(key.cast("string").alias("root"), F.when(key % 4 == 0, body).otherwise("ID=wrong\n").alias("text"))
    return text.os_release(text.first_text(etc, lib, "root").withColumnRenamed("root", "path")).select(F.col("path").cast("bigint").alias("s_suppkey"), "id", "version_id", "codename")


_TOML = f"{P} SELECT '/b' || b AS path, {N} AS name, v AS version, "


@query(_TOML + "'a|b' || b AS depends FROM p WHERE k % 4 <> 1")
def poetry_reader(spark, d):
    dev = case(F.lit(""), F.lit('category = "dev"\n'), F.lit('groups = ["main", "dev"]\n'), F.lit('category = "main"\ngroups = ["dev"]\n'))
    line = F.concat(F.lit('[[package]]\nname = "'), package(), cat('"\nversion = "', "v", '"\n'), dev, cat('[package.dependencies]\nb', "b", ' = "*"\na = ">=1"\n\n'))
    return locks.poetry_lock(written(parts(spark, d), line, tail='[metadata]\nlock-version = "2.0"\n')).select("path", "name", "version", F.array_join("depends", "|").alias("depends"))


def _cargo(spark, d) -> DataFrame:
    source = case(F.lit('source = "registry+https://x"\n'), F.lit('source = "git+https://x#1"\n'), F.lit(""), F.lit('source = "registry+https://x"\n'))
    needs = F.concat(F.lit('dependencies = ["'), F.col("nm"), F.lit('-0 1.0", "own'), F.col("b"), F.lit('"]\n'))
    line = F.concat(F.lit('[[package]]\nname = "'), F.when(F.col("k") % 4 == 3, cat("own", "b")).otherwise(package()), cat('"\nversion = "', "v", '"\n'), source, F.lit('checksum = "'), F.sha2("nm", 256), F.lit('"\n'), needs, F.lit("\n"))
    return written(parts(spark, d), line, head="version = 3\n\n")


@query(f"{P} SELECT '/b' || b AS path, CASE WHEN k % 4 = 3 THEN 'own' || b ELSE {N} END AS name, v AS version, CASE WHEN k % 4 = 1 THEN 'git' ELSE 'registry' END AS source_type, sha256(nm) AS checksum, nm || '-0|own' || b AS depends FROM p WHERE k % 4 <> 2")
def cargo_reader(spark, d):
    return locks.cargo_lock(_cargo(spark, d)).select("path", "name", "version", "source_type", "checksum", F.array_join("depends", "|").alias("depends"))


@query(f"""{P}, c AS (SELECT b, k, v, CASE WHEN k % 4 = 3 THEN 'own' || b ELSE {N} END AS name, nm FROM p WHERE k % 4 <> 2),
i AS (SELECT b, name, arg_min(v, k) AS v FROM c GROUP BY ALL),
e AS (SELECT b, name || '@' || v AS src, unnest([nm || '-0', 'own' || b]) AS need FROM c)
SELECT DISTINCT '/b' || e.b AS path, src, i.name || '@' || i.v AS dst FROM e JOIN i ON i.b = e.b AND i.name = need WHERE src <> i.name || '@' || i.v""")
def cargo_edge_join(spark, d):
    return locks.cargo_edges(_cargo(spark, d))


@query(_TOML + "k % 3 = 1 AS is_dev, lower(sha256(nm)) AS sha, CASE WHEN k % 2 = 0 THEN '@s/x|y' || b ELSE '' END AS depends FROM p")
def pnpm_reader(spark, d):
    key = case(F.concat(F.lit("/"), package(), cat("@", "v", "(react@18.0.0)")), F.concat(F.lit("'"), package(), cat("@", "v", "'")))
    line = F.concat(F.lit("  "), key, F.lit(":\n    resolution: {integrity: sha256-"), F.base64(F.unhex(F.sha2("nm", 256))), F.lit("}\n    engines: {node: '>=4'}\n"), F.when(F.col("k") % 2 == 0, cat("    dependencies:\n      '@s/x': 1.0.0\n      y", "b", ": 2.0.0\n")).otherwise(""), F.when(F.col("k") % 3 == 1, "    dev: true\n\n").otherwise("    dev: false\n\n"))
    rows = locks.pnpm_lock(written(parts(spark, d), line, head="lockfileVersion: '6.0'\n\nsettings:\n  x: true\n\npackages:\n\n"), include_dev=True)
    return rows.select("path", "name", "version", "is_dev", locks.integrity(F.col("integrity"))["value"].alias("sha"), F.array_join("depends", "|").alias("depends"))


@query(f"{P} SELECT k, {sql_case("'sha256'", "'sha1'", 'NULL')} AS alg, {sql_case('sha256(nm)', "lower(sha1(nm))", 'NULL')} AS value FROM p")
def integrity_decode(spark, d):
    b64 = lambda x: F.base64(F.unhex(x))
    x = case(F.concat(F.lit("sha256-"), b64(F.sha2("nm", 256))), F.concat(F.lit("sha1-"), b64(F.sha1("nm"))), F.lit("md5-AAAA"))
    e = locks.integrity(x)
    return parts(spark, d).select("k", e["alg"].alias("alg"), e["value"].alias("value"))


@query(f"{P} SELECT '/b' || b || '/package.json' AS path, {N} AS name, '^' || v AS range_spec, k % 2 = 1 AS is_dev, 'design' AS tier FROM p")
def package_json_reader(spark, d):
    files = parts(spark, d).select(F.concat(F.lit("/b"), "b", F.lit("/package.json")).alias("path"), F.concat(F.lit('{"name": "x", "'), F.when(F.col("k") % 2 == 1, "devDependencies").otherwise("dependencies"), F.lit('": {"'), package(), cat('": "^', "v", '"}}')).alias("text"))
    return locks.package_json(files, include_dev=True)


def _modules(spark, d) -> DataFrame:
    at = case(F.lit("/node_modules/"), F.lit("/node_modules/x/node_modules/@s/"), F.lit("/node_modules/npm/node_modules/"), F.lit("/node_modules/x/lib/"))
    author = case(F.lit('"Me <me@x.io> (https://x.io)"'), F.lit('{"name": "Me", "email": "x"}'), F.lit('"Me"'))
    return parts(spark, d).select("k", F.concat(F.lit("/b"), F.col("b"), at, package(), F.lit("/package.json")).alias("path"), F.concat(F.lit('{"name": "'), package(), cat('", "version": "', "v", '", "license": "MIT", "author": '), author, F.lit("}")).alias("text"))


@query(f"{P} SELECT {N} AS name, v AS version, 'Me' AS author, 'MIT' AS license, CASE WHEN k % 4 = 2 THEN 'internal' END AS npm_role FROM p WHERE k % 4 <> 3")
def node_modules_walk(spark, d):
    return locks.node_modules(_modules(spark, d), image=True).drop("path")


@query(f"""{P}, r AS (SELECT b, k, {N} AS name, v, 1 + (CAST(b AS INT) % 4) AS lowest, 1 + k % 4 AS tier FROM p),
t AS (SELECT *, min(tier) FILTER (WHERE tier >= lowest) OVER (PARTITION BY b) AS low FROM r)
SELECT '/b' || b AS root, CAST(tier AS INT) AS tier, name, CASE WHEN tier < 4 THEN v END AS version FROM t WHERE tier = low""")
def npm_reader(spark, d):
    """The four readers of npm projects; a brand's first tier that has rows counts. Brands lack tiers below 1 + b % 4."""
    rows = parts(spark, d).withColumn("tier", 1 + F.col("k") % 4).where(F.col("tier") >= 1 + F.col("b").cast("int") % 4)
    own = lambda t: rows.where(F.col("tier") == t)
    lock = written(own(1), F.concat(F.lit('"node_modules/'), package(), cat('": {"version": "', "v", '"}')), head='{"lockfileVersion": 2, "packages": {', tail="}}", suffix="/package-lock.json", sep=",")
    pnpm = written(own(2), F.concat(F.lit("  /"), package(), cat("@", "v", ":\n    dev: false\n")), head="packages:\n", suffix="/pnpm-lock.yaml")
    installed = own(3).select(F.concat(F.lit("/b"), "b", F.lit("/node_modules/"), package(), F.lit("/package.json")).alias("path"), F.concat(F.lit('{"name": "'), package(), cat('", "version": "', "v", '"}')).alias("text"))
    asked = written(own(4), F.concat(F.lit('"'), package(), cat('": "^', "v", '"')), head='{"dependencies": {', tail="}}", suffix="/package.json", sep=",")
    out = locks.npm_tiers(text.package_lock(lock), locks.pnpm_lock(pnpm), locks.node_modules(installed), locks.package_json(asked))
    return out.select("root", F.col("tier").cast("int").alias("tier"), "name", "version")


@query(f"{P} SELECT {N} AS name, v AS version, CASE WHEN k % 2 = 0 THEN 'MIT' END AS license_expression, 'Me' AS author, 'dep-' || b || '|other' AS depends, 2 AS n_classifiers FROM p")
def dist_info_reader(spark, d):
    line = F.concat(F.lit("Metadata-Version: 2.1\nName: "), package(), cat("\nVersion: ", "v", "\n"), F.when(F.col("k") % 2 == 0, "License-Expression: MIT\n").otherwise(""), cat("Author: Me\nClassifier: Topic :: x\nClassifier: License :: OSI Approved ::\n MIT License\nRequires-Dist: dep-", "b", " (>=1)\nRequires-Dist: other[x]~=2\nRequires-Dist: dev ; extra == 'dev'\n\nName: not this\nRequires-Dist: nor this\n"))
    rows = locks.metadata(parts(spark, d).select(F.col("k").cast("string").alias("path"), line.alias("text")))
    return rows.select("name", "version", "license_expression", "author", F.array_join("depends", "|").alias("depends"), F.size("classifiers").alias("n_classifiers"))


@query(f"{P} SELECT {N} AS name, v AS version, 'Me|You' AS authors, 'MIT' AS licenses FROM p")
def gemspec_reader(spark, d):
    line = F.concat(F.lit('Gem::Specification.new do |s|\n  s.name = "'), package(), F.when(F.col("k") % 2 == 0, cat('"\n  s.version = "', "v", '"\n')).otherwise(cat('"\n  s.version = Gem::Version.new("', "v", '")\n')), F.lit("  s.authors = ['Me', \"You\"]\n  s.license = 'MIT'\nend\n"))
    rows = locks.gemspec(parts(spark, d).select(F.col("k").cast("string").alias("path"), line.alias("text")))
    return rows.select("name", "version", F.array_join("authors", "|").alias("authors"), F.array_join("licenses", "|").alias("licenses"))


def _go_files(spark, d) -> DataFrame:
    line = case(cat('package main\n\nimport (\n\t"fmt"\n\tx "m.io/o', "b", "/", "nm", '/deep" // why\n)\n'), cat('package main\nimport "m.io/o', "b", "/", "nm", '"\n'), cat('package main\nimport "m.io/test"\n'))
    return parts(spark, d).select(F.concat(F.lit("/src/"), package(), case(F.lit(".go"), F.lit(".go"), F.lit("_test.go"))).alias("path"), line.alias("text"))


@query(f"{P} SELECT '/src/' || {N} || '.go' AS path, unnest(CASE k % 3 WHEN 0 THEN ['fmt', 'm.io/o' || b || '/' || nm || '/deep'] ELSE ['m.io/o' || b || '/' || nm] END) AS import FROM p WHERE k % 3 <> 2")
def go_import_extraction(spark, d):
    return locks.go_imports(_go_files(spark, d))


@query(f"""{P}, m AS (SELECT DISTINCT 'm.io/o' || b AS module FROM p UNION SELECT DISTINCT 'm.io/o' || b || '/' || nm FROM p WHERE k % 2 = 0),
i AS (SELECT '/src/' || {N} || '.go' AS path, 'm.io/o' || b || '/' || nm || CASE k % 3 WHEN 0 THEN '/deep' ELSE '' END AS import FROM p WHERE k % 3 <> 2)
SELECT path, import, arg_max(module, length(module)) AS module FROM i JOIN m ON import = module OR starts_with(import, module || '/') GROUP BY 1, 2""")
def go_import_modules(spark, d):
    p = parts(spark, d)
    modules = p.select(cat("m.io/o", "b").alias("module")).unionByName(p.where("k % 2 = 0").select(cat("m.io/o", "b", "/", "nm").alias("module")))
    return graph.longest_prefix(locks.go_imports(_go_files(spark, d)), "import", modules, "module").where("module is not null")


@query(f"{P} SELECT '/b' || b AS path, 'org.o' || b AS \"group\", {N} AS artifact, v AS version, CASE WHEN k % 2 = 0 THEN 'Apache License' END AS license FROM p")
def jar_dependency_list(spark, d):
    line = F.concat(cat("  - Name (https://x) org.o", "b", ":"), package(), F.when(F.col("k") % 3 == 0, ":jar:tests:").otherwise(":jar:"), F.col("v"), F.when(F.col("k") % 2 == 0, "\n\n    License: Apache License  (https://y)\n").otherwise("\n    no licence\n"))
    return locks.jar_dependencies(written(parts(spark, d), line, head="// -----\n// Transitive dependencies\n// -----\n")).select("path", "group", "artifact", "version", "license")


@query(f"{P} SELECT k, 'org.o' || b AS \"group\", {N} AS artifact, v AS version FROM p")
def pom_properties_reader(spark, d):
    line = F.concat(F.lit("#Created by x\nversion=old\r\n groupId = "), cat("org.o", "b", "\nartifactId="), package(), cat("\nversion=", "v", "\nurl=a=b\n"))
    x = locks.properties(parts(spark, d).select(F.col("k").cast("string").alias("path"), line.alias("text")))
    own = lambda key: F.try_element_at("properties", F.lit(key))
    return x.select(F.col("path").cast("bigint").alias("k"), own("groupId").alias("group"), own("artifactId").alias("artifact"), own("version").alias("version"))


@query(f"{P} SELECT {sql_case("'A'", "'H'")} || k || 'b' AS id, nm AS label, {sql_case("'omitted'", "'deferred'", "'present'")} AS class_cdx, 'present' AS class_spdx2 FROM p")
def mapping_table(spark, d):
    where = case(F.lit("omitted — no place"), F.lit("defer until later"), F.lit("`components[]`"))
    line = F.concat(F.lit("| "), case(F.lit("A"), F.lit("H")), cat("k", "b | ", "nm", " | "), where, F.lit(" | packages | graph | why |\n"))
    files = written(parts(spark, d), line, head="# Title\n\n| id | label | cdx | spdx | spdx3 | note |\n|-|-|-|-|-|-|\n| Z1 | not a row | | | | |\n")
    return locks.mapping_rows(files).select("id", "label", "class_cdx", "class_spdx2")


@query("SELECT split_part(url, '/', 3) AS root, count(*) AS n FROM pages WHERE len(string_split(url, '/')) - 4 <= 2 AND url NOT LIKE '%/vendor/%' GROUP BY 1")
def project_roots(spark, d):
    """Project roots at most two folders below a host, by a marker file that each page stands for."""
    paths = table(spark, d, "pages").select(F.regexp_replace("url", "^[a-z]+://", "/").alias("path"))
    found = text.project_roots(paths.withColumn("path", F.concat("path", F.lit("/go.mod"))).withColumn("path", F.regexp_replace("path", r"/[^/]*/go\.mod$", "/go.mod")), ("go.mod",), most_depth=3, skip=("vendor",), distinct=False)
    return found.groupBy(F.split("root", "/")[1].alias("root")).agg(F.count("*").alias("n"))
