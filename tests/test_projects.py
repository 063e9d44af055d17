"""Scanned projects: subjects, ancestors, models that are made once, paths through links, layers with hard links."""

import io
import json
import posixpath
import random
import re
import tarfile

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import claims, graph, jars, maven, snapshots
from tallyforge.plans import projects
from tallyforge.sources import binary, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def shared(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))


COORDS = "jar string, at int, group string, artifact string, version string"


def test_subjects_and_what_stays(spark):
    coords = spark.createDataFrame([("/a/x.jar", 0, "g", "x", "1"), ("/a/x.jar", 1, "g", "inner", "1"), ("/b/y.jar", 0, "g", "other", "1"), ("/c/target/z-2.jar", 0, "g", "z", "2"), ("/d/x.jar", 0, "g", "x", "1"), ("/e/z-2.jar", 0, "g", "z", "2")], COORDS)
    about = spark.createDataFrame([("/a/x.jar", True, None), ("/c/target/z-2.jar", False, None), ("/d/x.jar", None, "Main-Class: \n")], "jar string, claimed boolean, manifest string")
    rows = jars.judged(coords, about)
    assert {(r.jar, r.artifact): r.reason for r in rows.collect() if r.reason} == {("/c/target/z-2.jar", "z"): "maven-target-dir-heuristic"}
    assert jars.subject(rows).head().artifact == "z"
    # equal coordinates count once, whichever jar holds them; z stays through the jar elsewhere
    assert sorted((r.jar, r.artifact, r.parent) for r in jars.components(rows).collect()) == [("/a/x.jar", "inner", "pkg:maven/g/x@1"), ("/a/x.jar", "x", None), ("/b/y.jar", "other", None), ("/e/z-2.jar", "z", None)]
    assert jars.subject(jars.judged(coords.limit(0), about)).count() == 0
    # the target's name counts for claimed jars too
    assert {r.reason for r in jars.judged(coords, about, "X").where("artifact = 'x'").collect()} == {"target-name-match"}


def test_main_class(spark):
    texts = ["Main-Class: a.B", "x: 1\r\nMAIN-CLASS:a\r\n", "Main-Class:  \n", " Main-Class: a", "x" * 70000 + "\nMain-Class: a", None, ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", jars.has_main_class(F.col("t")).alias("x")).collect()
    assert [r.x for r in sorted(rows)] == [True, True, False, False, False, False, False]


def test_ancestors_in_two_jars_and_namespaces(spark):
    coords = spark.createDataFrame([("/m.jar", 0, "org.own", "m", "1"), ("/n.jar", 0, "com.far", "n", "1"), ("/none.jar", 0, "a", "zz", "1")], COORDS)
    listed = [(j, i, g, a, None, "1", None) for j in ("/m.jar", "/n.jar", "/none.jar") for i, (g, a) in enumerate((("org.own.sub", "plain-util"), ("org.own", "m"), ("org.own", "m"), ("com.far", "shaded-Json")))]
    ancestors = spark.createDataFrame(listed, "jar string, ord int, group string, artifact string, classifier string, version string, license string")
    classes = spark.createDataFrame([(j, p) for j in ("/m.jar", "/n.jar", "/none.jar") for p in ("org/own/sub/A.class", "x/json/B.class", "x/util/C.class")], "jar string, path string")
    found = {(r.jar, r.purl, r.parent) for r in jars.shade_ancestors(ancestors, coords, classes).collect()}
    assert found == {
        ("/m.jar", "pkg:maven/com.far/shaded-Json@1", "pkg:maven/org.own/m@1"), ("/n.jar", "pkg:maven/com.far/shaded-Json@1", "pkg:maven/com.far/n@1"),
        ("/n.jar", "pkg:maven/org.own.sub/plain-util@1", "pkg:maven/com.far/n@1"), ("/n.jar", "pkg:maven/org.own/m@1", "pkg:maven/com.far/n@1"),
    }


def pom(spark, *rows):
    """poms of (name, parent, managed [(artifact, version)], imports [name], needs [(artifact, version)])."""
    kind = "struct<group:string,artifact:string,version:string,scope:string,kind:string>"
    schema = f"pom string, parent string, properties map<string,string>, managed array<{kind}>, depends array<{kind}>"
    key = lambda x: x and f"g:{x}:1"
    return spark.createDataFrame([(key(n), key(up), {}, [("g", a, v, None, None) for a, v in managed] + [("g", i, "1", "import", "pom") for i in imports], [("g", a, v, None, None) for a, v in needs]) for n, up, managed, imports, needs in rows], schema)


def test_ancestors_double_and_circles_end(spark):
    chain = [(f"p{i}", f"p{i + 1}", [], [], []) for i in range(37)]
    rows = {(r.pom, r.ancestor): r.distance for r in maven.ancestors(pom(spark, *chain, ("a", "b", [], [], []), ("b", "c", [], [], []), ("c", "b", [], [], []), ("d", "d", [], [], []))).collect()}
    assert {k: v for k, v in rows.items() if k[0][2] == "p"} == {(f"g:p{i}:1", f"g:p{j}:1"): j - i for i in range(37) for j in range(i, 37)}
    assert {(k[0][2], k[1][2]): v for k, v in rows.items() if k[0][2] != "p"} == {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 2, ("b", "b"): 0, ("b", "c"): 1, ("c", "c"): 0, ("c", "b"): 1, ("d", "d"): 0}


def test_best_import_is_the_first_in_depth(spark):
    # a imports x and y; x imports y, so that what y manages counts as y's, but x's own entries come first, and lists may import each other
    poms = pom(spark, ("a", None, [], ["x", "z", "y"], []), ("x", None, [("m", "x")], ["y"], []), ("y", None, [("m", "y"), ("n", "y")], ["x"], []), ("z", None, [("n", "z"), ("o", "z")], [], []))
    got = {(r.pom[2], r.artifact): r.version for r in maven.effective_versions(poms).collect()}
    assert {k: v for k, v in got.items() if k[0] == "a"} == {("a", "m"): "x", ("a", "n"): "y", ("a", "o"): "z"}
    assert got["y", "m"] == "y" and got["x", "n"] == "y"


def test_models_are_made_once(spark):
    models = maven.Models(projects.needed_poms(spark, SF))
    one, two = (spark.createDataFrame([(f"g:a{k}:1",) for k in ks], "pom string") for ks in ((0, 1), (1, 2, 3)))
    models.load(one)
    models.load(two)
    models.load(one.unionByName(two))
    # the parent with the first, a list for each
    assert models.made == [3, 2, 2, 2] and models.done.count() == models.done.distinct().count() == sum(models.made) == models.own.count()


@pytest.mark.parametrize("declared", [False, True])
def test_closure_goes_through_what_it_does_not_emit(spark, declared):
    poms = pom(spark, ("a", None, [], [], [("b", "1"), ("gone", "1")]), ("b", None, [], [], [("c", "1"), ("a", "1"), ("none", None)]), ("c", None, [], [], [])).withColumn("in_tree", F.col("pom") != "g:b:1")
    seeds = spark.createDataFrame([("g:a:1",), ("g:a:1",), (None,)], "pom string")
    rows = {r.pom[2:-2]: (r.level, r.known, r.emitted, list(r.depends)) for r in maven.transitive(poms, seeds, declared=declared).collect()}
    assert rows == {"a": (0, True, True, ["b", "gone"]), "b": (1, True, False, ["a", "c"]), "gone": (1, False, declared, []), "c": (2, True, True, [])}
    on_disk = spark.createDataFrame([("g:a:1",), ("g:c:2",)], "pom string")
    assert {r.pom for r in maven.transitive(poms, seeds, on_disk=on_disk, declared=declared).where("emitted and known").collect()} == {"g:a:1"}
    assert maven.transitive(poms, seeds.limit(0)).count() == 0


def resolved(path, links):
    """A path as a file system resolves it, or None."""
    todo, at, hops = [x for x in path.split("/") if x not in ("", ".")], [], 0
    while todo:
        x = todo.pop(0)
        if x == "..":
            at = at[:-1]
        elif "/" + "/".join([*at, x]) in links:
            hops += 1
            if hops > 40:
                return None
            to = links["/" + "/".join([*at, x])]
            at = [] if to.startswith("/") else at
            todo = [y for y in to.split("/") if y not in ("", ".")] + todo
        else:
            at.append(x)
    return "/" + "/".join(at)


def test_canonical_paths(spark):
    rng = random.Random(4)
    links = {"/lib": "usr/lib", "/a": "b/../c", "/b": "/c/d", "/c/d": "../e/f", "/e/f": "/lib/./g", "/usr/lib/g": "..", "/l1": "l2", "/l2": "l1/x", "/up": "../../..", "/self": "self"}
    words = ["lib", "a", "b", "c", "d", "e", "f", "g", "..", ".", "", "usr", "l1", "up", "self", "x"]
    paths = {"/" + "/".join(rng.choice(words) for _ in range(rng.randint(0, 5))) for _ in range(300)}
    found = {r.path: r.canonical for r in claims.canonical(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame(list(links.items()), "path string, target string")).collect()}
    assert found == {p: resolved(p, links) for p in paths}
    assert found[posixpath.join("/", "lib")] == "/usr/lib" if "/lib" in paths else True


def test_claims_without_inodes_or_paths(spark):
    files = spark.createDataFrame([("/x", None, None), ("/y", 1, 5), (None, 1, 6)], "path string, device long, inode long")
    held = spark.createDataFrame([(None, 1, 6), ("/z", None, None)], "path string, device long, inode long")
    links = spark.createDataFrame([], "path string, target string")
    assert {r.path: r.claimed_by for r in claims.with_claims(files, held, links).collect()} == {"/x": None, "/y": None, None: "inode"}
    assert claims.unclaimed_files(files, held, links).count() == 2


def brute_overlay(entries):
    """Layer by layer, a tree of path to (content), links applied last; links to links of a layer whatever their order."""
    tree, layers = {}, sorted({e[0] for e in entries})
    for n in layers:
        own = [e for e in entries if e[0] == n]
        for _, path, kind, _ in own:
            if kind in ("whiteout", "opaque"):
                tree = {p: c for p, c in tree.items() if not (p.startswith(path + "/") or (kind == "whiteout" and p == path))}
        for _, path, kind, _ in own:
            if kind == "file":
                tree[path] = (n, path, n)
        links = {path: target for _, path, kind, target in own if kind == "hardlink"}
        before = {p: c for p, c in tree.items() if p not in links}
        tree = dict(before)
        for path in links:
            at, met = path, set()
            while at in links and at not in met:
                met.add(at)
                at = links[at]
            if at not in links and at in before:
                tree[path] = (n, *before[at][1:])
    return {(p, *c) for p, c in tree.items()}


def test_overlays_equal_a_walk_over_layers(spark):
    rng = random.Random(8)
    schema = "layer int, path string, kind string, target string"
    for _ in range(4):
        names = [f"{a}{b}" for a in ("d/", "e/", "") for b in "abcd"]
        entries, met = [], set()
        for n in range(4):
            for _ in range(12):
                kind, path = rng.choice(["file", "file", "hardlink", "hardlink", "whiteout", "opaque"]), rng.choice(names)
                path = rng.choice(["d", "e", path]) if kind in ("whiteout", "opaque") else path
                if (n, path, kind) not in met:
                    met.add((n, path, kind))
                    entries.append((n, path, kind, rng.choice(names) if kind == "hardlink" else None))
        got = {(r.path, r.layer, r.from_path, r.from_layer) for r in graph.linked_overlay(spark.createDataFrame(entries, schema)).collect()}
        assert got == brute_overlay(entries)
    assert graph.linked_overlay(spark.createDataFrame([], schema)).count() == 0


def test_image_with_hard_links(spark):
    def tar(*entries):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as t:
            for path, body, to in entries:
                info = tarfile.TarInfo(path)
                info.type, info.linkname, info.size = (tarfile.LNKTYPE, to, 0) if to else (tarfile.REGTYPE, "", len(body))
                t.addfile(info, io.BytesIO(body or b""))
        return out.getvalue()

    low = tar(("bin/first", None, "./bin/real"), ("bin/real", b"1", None), ("bin/evil", None, "../x"))
    high = tar(("bin/.wh.real", b"", None), ("bin/late", None, "bin/first"))
    image = tar(("a", low, None), ("b", high, None), ("manifest.json", json.dumps([{"Layers": ["a", "b"]}]).encode(), None))
    e = binary.image_entries(spark.createDataFrame([("i", bytearray(image))], "path string, content binary"))
    shown = graph.linked_overlay(e)
    files = e.where("kind = 'file'").select(F.col("path").alias("from_path"), F.col("layer").alias("from_layer"), F.col("content").cast("string").alias("content"))
    assert {(r.path, r.layer, r.content) for r in shown.join(files, ["from_path", "from_layer"]).collect()} == {("bin/first", 0, "1"), ("bin/late", 1, "1")}


def test_tree_source_prunes_by_reader(spark, tmp_path):
    files = projects.mixed_tree(spark, SF)
    n = registry.write_tree(files, str(tmp_path / "tree"))
    assert n == files.count()
    tree = registry.tree(spark, str(tmp_path / "tree"), part_files=1)
    wanted = files.where("path not like '%README.md'").select(F.regexp_replace("path", "^/", "").alias("path"), "text")
    assert sorted((r.path, r.text) for r in tree.collect()) == sorted((r.path, r.text) for r in wanted.collect())
    go = registry.tree(spark, str(tmp_path / "tree"), only="go.sum", part_files=1)
    some = wanted.where("path like '%go.sum'").count()
    # a partition a file, and only those of the reader
    assert go.rdd.getNumPartitions() == some == go.count() < tree.rdd.getNumPartitions() == wanted.count()
    # filters are Spark's own, also where a plan uses a frame twice
    assert tree.where("reader = 'dpkg'").unionByName(tree.where("reader = 'gemfile'")).groupBy("reader").count().count() == 2
    assert registry.tree(spark, str(tmp_path / "tree"), most_bytes=-1).count() == 0


def test_mixed_tree_holds_all_parts_and_large_files_are_listed(spark, tmp_path):
    lines = [x.text for x in projects.mixed_tree(spark, SF).where("path not like '%README.md'").collect()]
    parts = projects.parts(spark, SF).select("k", projects.package().alias("name")).collect()
    found = re.findall(r"(?:Package: |m\.io/|^    |^)([a-z-]+-\d+)(?= |==|$)", "\n".join(lines), re.M)
    assert sorted(found) == sorted([p.name for p in parts] + [p.name for p in parts if p.k % 8 == 1])
    with open(tmp_path / "requirements.txt", "wb") as f:
        f.truncate((64 << 20) + 1)
    options = {"path": str(tmp_path), "readers": json.dumps([(r.name, r.pattern) for r in registry.READERS])}
    listed = lambda **more: [f for p in registry.TreeSource(options | more).reader(None).partitions() for f in p.files]
    assert listed() == [("requirements", "requirements.txt", (64 << 20) + 1)] and listed(most_bytes="10") == []


def test_more_evidence_joins_the_readers(spark):
    files = spark.createDataFrame([("a/requirements.txt", "One_Two==1\nfree>=2\n"), ("a/package.json", '{"dependencies": {"x": "^1"}}'), ("a/other.txt", "z")], "path string, text string")
    binaries = registry.evidence(spark.createDataFrame([("bin/x", "one-two", "1"), ("bin/y", "y", "2")], "path string, name string, version string"), registry.Reader("binary", "pypi", "", lambda df: df, tier="analyzed"), 99)
    rows = registry.inventory(files, registry.READERS, binaries)
    assert rows.columns == list(registry.EVIDENCE) and rows.count() == 5
    best = {(r.purl or r.name): (r.reader, r.tier) for r in registry.first_by_precedence(rows).collect()}
    assert best == {"pkg:pypi/one-two@1": ("requirements", "source"), "pkg:pypi/free": ("requirements", "design"), "x": ("package-json", "design"), "pkg:pypi/y@2": ("binary", "analyzed")}


def test_lookups_leave_the_snapshot_where_it_lies(spark):
    snapshot = projects.index_snapshot(spark, SF, buckets=4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        files = projects.parts(spark, SF).select("k", F.sha2(projects.package(), 256).alias("sha256"))
        plan = snapshots.by_hash(files, snapshot)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joined = plan[plan.index("SortMergeJoin") :]
    # one exchange below the join, that of the files; the snapshot is scanned by buckets
    assert joined.count("Exchange hashpartitioning(sha256") == 1 and "SelectedBucketsCount: 4 out of 4" in joined
    odd = spark.createDataFrame([(1, None), (2, "zz"), (3, "")], "k int, sha256 string")
    assert snapshots.by_hash(odd, snapshot).count() == 0
