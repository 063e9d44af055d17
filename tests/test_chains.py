"""What the queries of chains and documents can't show: streams, plans of outputs, patches that fail, exit codes."""

import json

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import documents, parity, verify
from tallyforge.streaming import connections

EVENTS = "conn_id long, ts timestamp, ord long, kind string, size long, payload string, tls boolean"
GET = "GET /{} HTTP/1.1\r\nHost: h{}\r\n\r\n"


def rows():
    """Connections that are opened twice, asked twice, written without an open, read without one, and closed."""
    seconds = iter(range(1000))
    at = lambda: f"2024-01-01 00:{(s := next(seconds)) // 60:02d}:{s % 60:02d}"
    own = [
        (1, "open", 0, None), (1, "write", 10, GET.format("a", 1)), (1, "read", 5, "HTTP/1.1 200 OK\r\n\r\n"), (1, "write", 11, GET.format("b", 2)), (1, "close", 0, None),
        (2, "read", 9, "lost"), (2, "write", 7, "to pypi.org"), (2, "read", 3, None), (3, "open", 0, None), (3, "write", 1, GET.format("dropped", 3)), (3, "open", 0, None), (3, "write", 2, "x"), (4, "close", 0, None), (5, "write", 4, GET.format("c", 5)), (6, "open", 0, None), (6, "read", 8, None),
    ]
    # of the first connection one read is encrypted, the next request of it is not; the others are plain, or encrypted without a request
    return [(c, at(), i, kind, size, payload, (c, kind) in ((1, "read"), (6, "read"), (5, "open"))) for i, (c, kind, size, payload) in enumerate(own)]


WANT = {(1, "https", "/a", "h1", 200, 10, 5), (1, "http", "/b", "h2", None, 11, 0), (2, "tcp", None, "pypi.org", None, 7, 3), (3, "tcp", None, None, None, 2, 0), (5, "http", "/c", "h5", None, 4, 0), (6, "tcp", None, None, None, 0, 8)}


def frame(spark, own):
    return spark.createDataFrame(own, EVENTS.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp"))


def brief(df):
    return {(r.conn_id, r.protocol, r.path, r.host, r.status, r.bytes_sent, r.bytes_received) for r in df.collect()}


def test_batch_assembly(spark):
    assert brief(connections.assembled(frame(spark, rows()))) == WANT
    assert connections.assembled(frame(spark, rows()).limit(0)).count() == 0


def test_stream_assembly_and_losses(spark, tmp_path):
    """Batches out of order within the delay give the batch's rows; an event that comes too late is dropped and counted."""
    own = rows()
    at = "2024-01-01 {:02d}:00:00"
    end = [(9, at.format(5), 90, "close", 0, None, False)], [(9, at.format(9), 91, "close", 0, None, False)]
    late = [(1, "2024-01-01 00:00:01", 92, "write", 1000, None, False), (1, at.format(9), 93, "close", 0, None, False)]
    for part in (own[1::3], own[2::3], own[0::3], *end, late):
        frame(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    events = spark.readStream.schema(frame(spark, own).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").observe("events", F.count("*").alias("n"), F.sum("size").alias("bytes"))
    losses = connections.drained(connections.assembled_stream(events), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert brief(spark.read.parquet(f"{tmp_path}/out")) == WANT
    n = len(own) + len(end) + len(late)
    assert (losses.rows, losses.late, losses.seen["n"]) == (n, 1, n) and losses.batches >= 6
    assert losses.seen["bytes"] == sum(r[4] for r in [*own, *late])


def test_idle_connections_end(spark, tmp_path):
    own = [(1, "2024-01-01 00:00:00", 0, "write", 1, None, False), (1, "2024-01-01 00:20:00", 1, "write", 2, None, False), (2, "2024-01-01 03:00:00", 2, "close", 0, None, False), (2, "2024-01-01 04:00:00", 3, "close", 0, None, False)]
    for part in ([own[1], own[0]], own[2:3], own[3:]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = connections.assembled_stream(spark.readStream.schema(frame(spark, own).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    connections.drained(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert sorted((r.conn_id, r.bytes_sent, r.events) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, 1, 1), (1, 2, 1)]


def test_planned_outputs():
    assert documents.planned([]) == {"cyclonedx-json": "inventory.cdx.json"}
    assert documents.planned(["spdx-2.3-json,cyclonedx-json", "spdx-3-json-experimental"], ["spdx-3-json=x.json"]) == {"spdx-2.3-json": "inventory.spdx.json", "cyclonedx-json": "inventory.cdx.json", "spdx-3-json": "x.json"}
    for formats, outputs in ((["nothing"], []), (["spdx-2.3-json", "spdx-3-json"], ["a.json"]), (["spdx-2.3-json", "spdx-3-json"], ["spdx-2.3-json=a", "spdx-3-json=a"]), ([], ["spdx-2.3-json=a"])):
        with pytest.raises(ValueError):
            documents.planned(formats, outputs)


@pytest.mark.parametrize("patch", ['[{"op": "test", "path": "/a", "value": 2}]', '[{"op": "remove", "path": "/b"}]', '[{"op": "replace", "path": "/b", "value": 1}]', '[{"op": "add", "path": "a", "value": 1}]', '[{"op": "move", "from": "/a", "path": "/a/b"}]', '[{"op": "add", "path": "/l/9", "value": 1}]'])
def test_patches_that_fail(patch):
    with pytest.raises(ValueError):
        verify.apply_patch('{"a": 1, "l": []}', patch)


def test_patch_provenance():
    out = json.loads(verify.apply_patch('{"a": {"x/y": 1}}', '[{"op": "replace", "path": "/a/x~1y", "value": [1]}, {"op": "add", "path": "/a/x~1y/-", "value": 2}]', "who"))
    assert out == {"a": {"x/y": [1, 2]}, "metadata": {"properties": [{"name": "sbom:enrichment-patch", "value": "who"}]}}


def test_exit_codes(spark):
    found = spark.createDataFrame([(t, f, "A1", "x") for t in "ab" for f in ("cyclonedx-json", "spdx-2.3-json", "spdx-3-json")] + [("b", "cyclonedx-json", "A2", "x")], "target string, format string, row_id string, value string")
    assert {r.target: r.exit_code for r in parity.exit_code(parity.report(found)).collect()} == {"a": 0, "b": 1}
