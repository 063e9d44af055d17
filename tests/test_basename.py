"""Files that connections and paths name."""

from pyspark.sql import functions as F

from tallyforge.functions import keys
from tallyforge.operators import merge


def test_with_file(spark):
    connections = spark.createDataFrame([(1, "/pool/a_1.deb"), (2, "/x/none.whl"), (3, "/x/b.whl"), (4, "/x/"), (5, None)], "conn int, path string")
    files = spark.createDataFrame([("/tmp/a_1.deb", None, 1), ("/var/a_1.deb", "h2", 2), ("/opt/a_1.deb", "h3", 3), ("/z/a_1.deb", None, 4), ("/q/b.whl", None, 5), ("", "h6", 6)], "path string, hash string, ord int")
    got = {r.conn: (r.hash, r.file_path) for r in merge.with_file(connections, files).collect()}
    assert got == {1: ("h3", "/tmp/a_1.deb"), 2: (None, None), 3: (None, None), 4: (None, None), 5: (None, None)}


def test_npm_paths(spark):
    want = {
        "/p/node_modules/.pnpm/tool@4.17.2/node_modules/tool/index.js": "pkg:npm/tool@4.17.2",
        "/p/node_modules/.pnpm/@kinds+core@20.11.5/x.ts": "pkg:npm/%40kinds/core@20.11.5",
        "/home/u/.npm/tmp/two-part-18.2.0-rc.1.tgz": "pkg:npm/two-part@18.2.0-rc.1",
        "/p/node_modules/tool/index.js": None,
    }
    rows = spark.createDataFrame([(x,) for x in want], "path string").select("path", keys.path_key(F.col("path")).alias("key")).collect()
    assert {r.path: r.key for r in rows} == want
