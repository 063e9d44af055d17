"""What keeps queries within their limits on larger tables: work dealt over cores, nothing that grows in broadcasts or in one row."""

import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import documents, graph, maven, parity
from tallyforge.plans import binaries, projects
from tallyforge.plans import documents as plans
from tallyforge.plans.scalars import parts
from tallyforge.sources import binary, locks, registry, text

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def shared(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))


def planned(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_parts_are_dealt_over_cores(spark):
    assert parts(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_images_of_a_batch_come_in_one_frame(spark):
    images = [("1", binaries.make_image("a", 1)), ("bad", b"x"), ("2", binaries.make_image("b", 2))]
    rows = binary.image_entries(spark.createDataFrame(images, "path string, content binary").coalesce(1)).where("kind = 'file'").collect()
    assert sorted((r.image, r.layer, r.path, bytes(r.content)) for r in rows if r.path.startswith("opt/") and r.path != "opt/old") == [("1", 0, "opt/a", b"3"), ("1", 1, "opt/a", b"a"), ("2", 0, "opt/b", b"3"), ("2", 1, "opt/b", b"b")]


def test_images_are_gone_before_the_next(spark, monkeypatch):
    taken = []
    images = (taken.append(k) or (str(k), binaries.make_image(f"n{k}", k)) for k in range(3000))
    assert next(binary.entry_batches(images)).num_rows == 10_000 and len(taken) == 1250
    assert sum(b.num_rows for b in binary.entry_batches(images)) == 8 * 1750 and len(taken) == 3000
    # neither JVM nor a batch between it and Python ever holds one
    kind, plans_of = type(spark.range(1)), []
    plain = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda df, *a, **k: (plans_of.append(planned(df)), plain(df, *a, **k))[1])
    binaries.binary_identities(spark, SF)  # its module then holds what can't be sent to workers
    assert binaries.image_overlay(spark, SF).count() == 400
    (plan,) = plans_of
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan and "MapInPandas" not in plan


def test_plain_archives_are_read_as_tarfile_reads_them(monkeypatch):
    def tar(entries, form):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w", format=form) as t:
            for path, kind, linked, body in entries:
                info = tarfile.TarInfo(path)
                info.type, info.linkname, info.size = kind, linked, len(body)
                t.addfile(info, io.BytesIO(body))
        return out.getvalue()

    plain = [("./d/", tarfile.DIRTYPE, "", b""), ("./d/x", tarfile.REGTYPE, "", b"1" * 600), ("y", tarfile.LNKTYPE, "./d/x", b""), ("z", tarfile.SYMTYPE, "y", b""), ("d/.wh.q", tarfile.REGTYPE, "", b""), ("../up", tarfile.REGTYPE, "", b"2")]
    other = [("n" * 150, tarfile.REGTYPE, "", b"3"), ("\u00e9", tarfile.REGTYPE, "", b"4"), ("old/", tarfile.AREGTYPE, "", b""), ("pipe", tarfile.FIFOTYPE, "", b"")]
    images = []
    for form in (tarfile.GNU_FORMAT, tarfile.PAX_FORMAT):
        for layer in (plain, *([x] for x in other), [*plain, *other], []):
            images.append(tar([("manifest.json", tarfile.REGTYPE, "", b'[{"Layers": ["l"]}]'), ("l", tarfile.REGTYPE, "", tar(layer, form))], form))
    images += [bytes([*images[0][:at], 1, *images[0][at + 1 :]]) for at in (100, 124, 150, 156, 345, 600, 1024, 1536, 2000)] + [images[0][:n] for n in (0, 100, 512, 1536, 3000, 4600)]
    found = [binary._entries("i", x) for x in images]
    assert len(found[0]) == 5 and len(found[5]) == 9
    monkeypatch.setattr(binary, "_plain_members", lambda *_: None)
    assert [binary._entries("i", x) for x in images] == found


def test_overlays_are_not_broadcast_by_estimates(spark):
    assert "Broadcast" not in planned(projects.layer_hard_links(spark, SF))
    assert "Broadcast" not in planned(binaries.image_overlay(spark, SF))


def test_transitive_walk_makes_models_in_one_load(spark):
    made = []

    class Counted(maven.Models):
        def load(self, wanted=None):
            made.append(wanted)
            super().load(wanted)

    plain, maven.Models = maven.Models, Counted
    try:
        out = projects.transitive_closure(spark, SF)
    finally:
        maven.Models = plain
    assert made == [None] and "Broadcast" not in planned(out)


def test_closure_of_edges_with_copies_and_circles(spark):
    edges = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (3, 1), (1, 3), (8, 9)], "src long, dst long")
    found = graph.closure(edges, spark.createDataFrame([(1,)], "node long"))
    assert {(r.node, r.level) for r in found.collect()} == {(1, 0), (2, 1), (3, 1)}


def test_closure_moves_only_small_frontiers_and_few_tasks(spark, monkeypatch):
    edges = spark.range(24).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    seeds, plans_of = spark.range(1).select(F.col("id").alias("node")), []
    kind = type(edges)
    plain = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda df, *a, **k: (plans_of.append(planned(df)), plain(df, *a, **k))[1])

    def walked():
        plans_of.clear()
        found = graph.closure(edges, seeds)
        # the tasks of a level, and of what reads the result, don't add up over levels
        assert found.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        levels = [p for p in plans_of if "LeftAnti" in p]
        assert len(levels) == 25 and all("Coalesce" in p for p in levels)
        assert {(r.node, r.level) for r in found.collect()} == {(k, k) for k in range(25)}
        return levels

    assert all("BroadcastHashJoin" in p for p in walked())
    monkeypatch.setattr(graph, "FEW", 0)
    assert not any("Broadcast" in p for p in walked())


def test_facts_of_volumes_are_those_of_whole_documents(spark, monkeypatch):
    read = lambda: {tuple(r) for r in parity.facts(emitted).collect()}
    emitted = plans.emitted(spark, SF, *documents.SERIALIZERS)
    whole = read()
    monkeypatch.setattr(documents, "VOLUME", 3)
    emitted = plans.emitted(spark, SF, *documents.SERIALIZERS).checkpoint()
    assert emitted.groupBy("target", "format").count().agg(F.max("count")).head()[0] > 2 and emitted.select("target", "file").distinct().count() == emitted.count()
    assert read() == whole


def test_openvex_is_not_cut_in_volumes(spark, monkeypatch):
    monkeypatch.setattr(documents, "VOLUME", 3)
    rows = [("t", f"pkg:gem/a{i}@1", ["CVE-1", "CVE-2"] if i % 2 else ["CVE-1"]) for i in range(10)] + [("none", "pkg:gem/b@1", None)]
    out = documents.openvex(spark.createDataFrame(rows, "target string, purl string, advisories array<string>"), made_at=plans.MADE_AT)
    assert out.columns == ["target", "document"]
    (one,) = out.collect()
    found = {s["vulnerability"]["name"]: [p["@id"] for p in s["products"]] for s in json.loads(one.document)["statements"]}
    assert one.target == "t" and found == {a: [p for _, p, of in rows if a in (of or [])] for a in ("CVE-1", "CVE-2")}


def test_lock_file_is_read_by_packages(spark):
    one = lambda k, more="": f'[[package]]\nname = "n{k}"\nversion = "{k}"\nsource = "registry+x"\n{more}\n'
    head = "version = 3\n\n"
    files = {
        "plain": head + one(1) + one(2), "text": head + one(1, 'note = """\n[[package]]\n"""') + one(2), "bad": head + one(1) + "x = = 1\n" + one(2), "twice": head + one(1, "[m]\na = 1") + one(2, "[m]\na = 2"),
        "tail": head + one(1) + one(2, "[m]\na = 1"), "indented": head + one(1) + " " + one(2), "both": head + "package = []\n" + one(1), "empty": head,
    }
    rows = locks.cargo_lock(spark.createDataFrame(list(files.items()), "path string, text string")).collect()
    both = [(0, "n1"), (1, "n2")]
    found = {p: sorted((r.ord, r.name) for r in rows if r.path == p) for p in files}
    assert found == {"plain": both, "text": both, "bad": [], "twice": [], "tail": both, "indented": both, "both": [], "empty": []}
    # the parser gets a package at a time
    assert locks.pieces(spark.createDataFrame([("plain", files["plain"])], "path string, text string")).count() == 3


def test_copyright_texts_are_not_broadcast_by_estimates(spark):
    from tallyforge.plans import inventory

    assert "Broadcast" not in planned(inventory.queries()["copyright_join"](spark, SF))


def test_poms_are_parsed_once(spark):
    from tallyforge.plans import chains

    poms = chains._poms(spark, SF).where("pom is not null")
    assert poms._jdf.queryExecution().optimizedPlan().toString().count("from_xml") == 1


def test_process_tree_is_not_broadcast_by_estimates(spark):
    from tallyforge.plans import chains

    assert "Broadcast" not in planned(chains.process_tree(spark, SF))
    assert chains.process_tree(spark, SF).count() == 200


def test_package_databases_are_bounded(spark, monkeypatch):
    read = lambda: sorted(tuple(r) for r in binaries.rpm_database_reader(spark, SF).collect())
    whole = read()
    monkeypatch.setattr(binaries, "DATABASE_KEYS", 50)
    most = parts(spark, SF).groupBy("b", F.floor(F.col("k") / 50)).count().agg(F.max("count")).head()[0]
    assert binaries._database(spark, SF).agg(F.max(F.length("content"))).head()[0] < 20_000 * (most + 1)
    assert binaries._database(spark, SF).count() > 25 and read() == whole


def test_a_batch_of_events_reads_its_state_once():
    from tallyforge.streaming import connections

    calls = []

    class Kept:
        value = None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

        def clear(self):
            self.value = None

    class Handle:
        def getValueState(self, *_):
            return Kept()

        def registerTimer(self, at):
            calls.append(at)

        def deleteTimer(self, at):
            calls.append(-at)

    a = connections.Assembler(1000)
    a.init(Handle())
    event = lambda ms, kind="write": [ms * 1000, ms, kind, 1, False, None, None, None, None, None, False]
    assert not [*a.advance((1,), 0, [event(20), event(10)])] and calls == ["get", 11, "update"]
    calls.clear()
    # a timer that is still to come before the next event stays
    assert not [*a.advance((1,), 5, [event(30)])] and calls == ["get", "update"]
    calls.clear()
    assert not [*a.advance((1,), 25, [])] and calls == ["get", 31, "update"]
    found = [*a.advance((1,), 2000, [])]
    assert [(r.started, r.ended, r.events) for r in found] == [(10_000, 30_000, 3)] and a.kept.value is None


def test_metadata_headers_are_cut_once(spark):
    files = {
        "plain": "NAME: a\r\nVersion: 1:2\r\nname: b\r\nLicense\r\nAuthor:\r\nAuthor-Email: me\r\nClassifier: x ::\r\n  y\r\nRequires-Dist: P>1\r\nRequires-Dist: q; extra == 'dev'\r\n\r\nLicense: MIT\r\n",
        "colon": "Name\nVersion: 1\n", "late": "\n\nName: a\nVersion: 1\n", "none": None,
    }
    rows = locks.metadata(spark.createDataFrame(list(files.items()), "path string, text string"))
    assert [tuple(r) for r in rows.collect()] == [("plain", "a", "1:2", None, None, ["x :: y"], ["P"], "me")]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("replace(text") == 1


def test_tree_is_read_as_often_as_its_rows_are(spark, tmp_path):
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("inventory_tree")
    out = projects.tree_inventory(spark, SF)
    assert scans(out) == scans(registry.tree_inventory(spark, str(tmp_path))) > 0
    assert sorted(r.n_rows for r in out.select("n_rows").collect()) == [1] * 175 + [2] * 25


def test_stanzas_are_cut_once(spark):
    files = {"a": "Package: x\nStatus: install ok installed\nVersion: 1\nVersion: 2\n\nno fields\n\nPackage: y\nStatus: install ok installed\nVersion: 3\n", "none": None}
    rows = text.dpkg(spark.createDataFrame(list(files.items()), "path string, text string"))
    assert sorted((r.path, r.ord, r.name, r.version) for r in rows.collect()) == [("a", 0, "x", "2"), ("a", 2, "y", "3")]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(block") == 1


def test_tree_is_dealt_over_cores(tmp_path):
    for i in range(8):
        (tmp_path / f"{i}").mkdir()
        (tmp_path / f"{i}" / "go.sum").write_text("x" * (1 << 20))
    patterns = [[r.name, r.pattern] for r in registry.READERS]
    cut = lambda parts: [len(p.files) for p in registry.TreeReader(str(tmp_path), patterns, "go.sum", 32 << 20, 2000, 64 << 20, parts).partitions()]
    assert cut(1) == [8] and cut(4) == [2] * 4 and cut(100) == [1] * 8
