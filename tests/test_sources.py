import base64

import pytest

from tallyforge.functions import keys
from tallyforge.operators import graph, merge
from tallyforge.sources import text


def one(spark, body):
    return spark.createDataFrame([("f", body)], "path string, text string")


def test_dpkg_and_apk(spark):
    body = "Package: a\nStatus: install ok installed\nVersion: 1:2.0\nArchitecture: all\nDepends: libc6 (>= 2.3), x:any | y\nDescription: long\n more\n\nPackage: gone\nStatus: deinstall ok config-files\nVersion: 1\n"
    rows = text.dpkg(one(spark, body)).collect()
    assert [(r.name, r.version, r.depends) for r in rows] == [("a", "1:2.0", ["libc6", "x", "y"])]
    rows = text.apk(one(spark, "P:musl\nV:1.2\nA:x86_64\nD:!bad so:libc.so busybox>=1 /bin/sh\nL:MIT\n\nP:noversion\n")).collect()
    assert [(r.name, r.license, r.depends) for r in rows] == [("musl", "MIT", ["busybox"])]


def test_lock_files(spark):
    h = base64.b64encode(b"\1" * 32).decode()
    rows = text.go_sum(one(spark, f"m.io/x v1.0.0 h1:{h}\nm.io/x v1.0.0/go.mod h1:{h}\n")).collect()
    assert [(r.module, r.version, r.kind, r.sha256) for r in rows] == [("m.io/x", "v1.0.0", k, "01" * 32) for k in ("module", "gomod")]
    rows = text.requirements(one(spark, "# c\n-r other.txt\nfoo==1.0 \\\n  --hash=sha256:ab --hash=sha256:ab\nbar>=2 ; python_version > '3'\nbaz\n")).collect()
    assert [(r.name, r.version, r.range_spec, r.hashes) for r in rows] == [("foo", "1.0", "==1.0", ["sha256:ab"]), ("bar", None, ">=2", []), ("baz", None, None, [])]
    body = "GEM\n  remote: https://x\n  specs:\n    a (1.0)\n      b (~> 2)\n    b (2.1)\n\nPLATFORMS\n  ruby\n"
    rows = text.gemfile_lock(one(spark, body)).orderBy("ord").collect()
    assert [(r.name, r.version, r.depends) for r in rows] == [("a", "1.0", ["b"]), ("b", "2.1", [])]
    lock = '{"lockfileVersion": 3, "packages": {"": {}, "node_modules/@s/x": {"version": "1.0.0", "dependencies": {"y": "1"}}, "node_modules/d": {"version": "2", "dev": true}}}'
    rows = text.package_lock(one(spark, lock)).collect()
    assert [(r.name, r.version, r.depends) for r in rows] == [("@s/x", "1.0.0", ["y"])]
    with pytest.raises(Exception, match="version 1"):
        text.package_lock(one(spark, '{"lockfileVersion": 1, "packages": {}}')).collect()
    r = text.os_release(one(spark, 'ID=debian\nVERSION_ID="12"\nVERSION_CODENAME=bookworm\n')).first()
    assert (r.id, r.version_id, r.codename) == ("debian", "12", "bookworm")


def test_merge_rules(spark):
    rows = spark.createDataFrame([("g", 1, 0.9, "analyzed", None, True), ("g", 2, 0.5, "design", "transitive", False), ("n", 1, 0.5, None, None, False), ("n", 2, 0.4, "source", "git", True)], "k string, ord int, conf double, sbom_tier string, source_type string, has_sha256 boolean")
    from pyspark.sql import functions as F

    got = {r.k: (r.sbom_tier, r.source_type, r.provenance) for r in merge.merged_tier(rows.withColumn("ecosystem", F.lit("npm")), ["k"], "conf", "ord").collect()}
    assert got == {"g": ("deployed", None, ["maven-cache-bfs"]), "n": ("source", "git", [])}


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 1)], "src long, dst long")
    got = graph.closure(edges, spark.createDataFrame([(1,)], "node long")).collect()
    assert sorted((r.node, r.level) for r in got) == [(1, 0), (2, 1), (3, 2)]


def test_keys(spark):
    paths = ["/crates/serde/serde-1.0.1.crate", "/@scope/pkg/-/pkg-2.0.0.tgz", "/left-pad/-/left-pad-1.3.0.tgz", "/github.com/a/b/@v/v1.2.3.zip", "/packages/ab/cd/My-Pkg-1.0.tar.gz", "/none"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [r[0] for r in df.select(keys.url_key(df.p)).collect()]
    assert got == ["pkg:cargo/serde@1.0.1", "pkg:npm/%40scope/pkg@2.0.0", "pkg:npm/left-pad@1.3.0", "pkg:golang/github.com/a/b@v1.2.3", "pkg:pypi/my_pkg@1.0", None]


def test_pipfile_lock_and_go_mod(spark):
    body = '{"_meta": {}, "default": {"a": {"version": "==1.0"}, "b": {"git": "x"}}, "develop": {"c": {"version": "==2"}}}'
    rows = text.pipfile_lock(one(spark, body)).orderBy("name").collect()
    assert [(r.name, r.version, r.is_dev) for r in rows] == [("a", "1.0", False), ("b", None, False), ("c", "2", True)]
    assert text.pipfile_lock(one(spark, None)).count() == 0
    body = "module m.io/own\n\ngo 1.22\n\nrequire (\n\ta.io/x v1.0.0\n\tb.io/y v2.0.0 // indirect\n)\nrequire c.io/z v0.1.0\nreplace a.io/x => ../x\nreplace (\n\tb.io/y v2.0.0 => d.io/y v2.1.0\n)\nexclude c.io/z v0.0.9\n"
    rows = text.go_mod(one(spark, body)).orderBy("ord").collect()
    assert [tuple(r)[2:] for r in rows] == [
        ("module", "m.io/own", None, None, None, False),
        ("require", "a.io/x", "v1.0.0", None, None, False),
        ("require", "b.io/y", "v2.0.0", None, None, True),
        ("require", "c.io/z", "v0.1.0", None, None, False),
        ("replace", "a.io/x", None, "../x", None, False),
        ("replace", "b.io/y", "v2.0.0", "d.io/y", "v2.1.0", False),
        ("exclude", "c.io/z", "v0.0.9", None, None, False),
    ]
    assert text.go_mod(one(spark, None)).count() == 0
