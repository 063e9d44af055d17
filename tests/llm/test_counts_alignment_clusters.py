"""Token counts, alignment and centroids against brute force, and on odd rows."""

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import alignment, centroids, token_counts
from tallyforge.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string"
TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "tab\t x\n y \n\n z", "été 東京 タワー 𝒳🙂", "<s> </s> <unk> <|endoftext|> <0x41>", "a ▁b", "▁", "café  x", "one two", "one two",
    "x" * 3000, "ab" * 2000 + " " + "zq7" * 500, "don't we'll 123456 12,5 --- ###", "​　 a\x00b", "line one\n  indented\n\n\tline\r\nend ", "日本語" * 50, "a\u3000 \u3000b\u2028 c\x85 \x1cd \u00a0e", "a\n \nb  c\t ", "\ta b",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None if i == 3 else i, t, "en") for i, t in enumerate(TEXTS)] + [(14, "one two", "en")]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("content", "n_tokens", "copies", "block", "key", "place", "n", "best", "groups", "tokenizer"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def multiset(df, *names):
    return collections.Counter(tuple(r[n] for n in names) for r in df.collect())


def pieces():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))


def bytelevel():
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    out.encode_special_tokens = True
    return out


# ---- op11


@pytest.mark.parametrize("source", ["odd", "sample"])
def test_counts_are_the_librarys(spark, odd, source):
    docs = odd if source == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    sp = pieces()
    want = collections.Counter((r.doc_id, len((r.text or "").encode()), n := len(sp.encode(r.text or "")), n > 4096) for r in docs.select("doc_id", "text").collect())
    assert multiset(token_counts.token_counts(docs, vocabulary("piece_bpe_32k.model")), "doc_id", "n_bytes", "n_tokens", "over_limit") == want


def test_counts_of_a_json_tokenizer(odd):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = collections.Counter((r.doc_id, len(own.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.select("doc_id", "text").collect())
    assert multiset(token_counts.token_counts(odd, vocabulary("byte_bpe_50k.json")), "doc_id", "n_tokens") == want


def test_cache_encodes_only_what_is_missing(spark, odd, tmp_path):
    model = vocabulary("piece_bpe_32k.model")
    cache, tokenizer = str(tmp_path / "cache"), token_counts.Tokenizer(model)
    first = multiset(token_counts.token_counts(odd.where("doc_id < 10"), model, cache=cache), "doc_id", "n_tokens")
    held = token_counts.cached(spark, cache, tokenizer.digest)
    before = held.count()
    # null, empty and equal texts share one entry
    assert before == len({t or "" for i, t in enumerate(TEXTS) if i < 10 and i != 3})
    docs = odd.select("doc_id", F.unhex(F.sha2(tokenizer.normal(F.col("text")), 256)).alias("content"), tokenizer.normal(F.col("text")).alias("text"))
    keys = docs.groupBy("content").agg(F.count("*").alias("copies"))
    new = token_counts.appended(docs, keys, tokenizer, cache)
    assert new == keys.count() - before and token_counts.appended(docs, keys, tokenizer, cache) == 0
    assert spark.read.parquet(cache).count() == before + new
    # what is stored is what is given out
    spark.read.parquet(cache).withColumn("n_tokens", F.col("n_tokens") + 1000).write.partitionBy("tokenizer").parquet(other := str(tmp_path / "other"))
    again = multiset(token_counts.token_counts(odd.where("doc_id < 10"), model, cache=other), "doc_id", "n_tokens")
    assert again == collections.Counter({(i, n + 1000): k for (i, n), k in first.items()})
    assert token_counts.cached(spark, cache, "another version").count() == 0


def test_marked_and_spaced_texts_share_a_key(spark):
    docs = spark.createDataFrame([(1, "a ▁b"), (2, "a  b")], "doc_id long, text string")
    rows = token_counts.token_counts(docs, vocabulary("piece_bpe_32k.model")).orderBy("doc_id").collect()
    assert [r.n_tokens for r in rows] == [len(pieces().encode(t)) for t in ("a ▁b", "a  b")] and rows[0].n_bytes == 6


def test_hot_text_and_empty_table(spark, none):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    rows = token_counts.token_counts(docs, vocabulary("piece_bpe_32k.model")).collect()
    sp = pieces()
    assert len(rows) == 3000 and all(r.n_tokens == len(sp.encode("the same" if r.doc_id % 3 == 0 else f"text {r.doc_id}")) for r in rows)
    assert token_counts.token_counts(none, vocabulary("piece_bpe_32k.model")).collect() == []


def test_over_limit_is_strict(spark):
    n = len(pieces().encode("a b c"))
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert [token_counts.token_counts(docs, vocabulary("piece_bpe_32k.model"), limit=x).head().over_limit for x in (n - 1, n)] == [True, False]


# ---- op12


def brute_alignment(texts):
    """Rows of the contract from cumulative byte offsets of whole encodings."""
    sp, own = pieces(), bytelevel()
    from tokenizers import decoders

    level = decoders.ByteLevel()
    shown = {}
    for b in range(256):
        for c in map(chr, range(0x21, 0x180)):
            if level.decode([c]) == chr(b) if b < 128 else False:
                shown[c] = b
    # bytes above 127 by the vocabulary's own single-byte order: those that print as themselves, then the rest
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    for b in printable:
        shown[chr(b)] = b
    for i, b in enumerate(b for b in range(256) if b not in printable):
        assert shown.get(chr(256 + i), b) == b
        shown[chr(256 + i)] = b
    rows, held = [], collections.Counter()
    for text in texts:
        if not text:
            rows.append(None)
            continue
        a, b = own.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
        of_a = [bytes(shown[c] for c in own.id_to_token(i)) for i in a]
        of_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, sp.id_to_piece(i)) for i in b)]
        whole = (" " + text).encode()
        if b"".join(of_a) != whole or b"".join(of_b) != whole:
            rows.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in of_a]), np.cumsum([len(x) for x in of_b])
        cuts = sorted(set(ends_a) & set(ends_b))
        groups = [tuple(list(ids[np.searchsorted(ends, lo, "right") : np.searchsorted(ends, hi, "right")]) for ids, ends in ((a, ends_a), (b, ends_b))) for lo, hi in zip([0, *cuts], cuts)]
        links = collections.Counter((x, y) for g, h in groups for x in g for y in h)
        held.update(links.keys())
        rows.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups).encode()).hexdigest()))
    most = collections.defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for row in rows:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, g, links, sha = row
            out.append((a, b, g, sum(links.values()), sum(m for k, m in links.items() if held[k] == most[k[0]]), sum(m * held[k] for k, m in links.items()), sha))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def the_alignment(docs, **how):
    return alignment.alignment(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), **how)


@pytest.mark.parametrize("block_bytes", [1, 4 << 20])
def test_alignment_equals_brute_force_on_odd_rows(odd, block_bytes):
    texts = odd.select("doc_id", "text").collect()
    want = collections.Counter((r.doc_id, *row) for r, row in zip(texts, brute_alignment([r.text for r in texts]), strict=True))
    assert multiset(the_alignment(odd.repartition(3), block_bytes=block_bytes), "doc_id", *COLUMNS) == want


def test_alignment_equals_brute_force_on_the_sample(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = docs.collect()
    want = collections.Counter((r.doc_id, *row) for r, row in zip(texts, brute_alignment([r.text for r in texts]), strict=True))
    assert multiset(the_alignment(docs, block_bytes=100_000), "doc_id", *COLUMNS) == want


def test_groups_are_written_out(odd, none):
    rows = {r.doc_id: r.groups for r in alignment.aligned(odd, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")).collect()}
    a, b = bytelevel().encode(" one two").ids, pieces().encode("one two")
    assert rows[14] == f"{a[0]}|{b[0]};{a[1]}|{b[1]}" and rows[0] == rows[1] == rows[11] == ""
    assert the_alignment(none).collect() == []


def test_transducer_memoises_and_rejects():
    t = alignment.Transducer([b"ab", b"c", b"a"], [b"a", b"bc", b"x"])
    assert t.groups([0, 1], [0, 1]) == [(2, 2)] and t.groups([2, 2], [0, 0]) == [(1, 1), (2, 2)]
    known = len(t.memo)
    assert known
    assert t.groups([0, 1], [0, 1]) == [(2, 2)] and len(t.memo) == known
    assert t.groups([0], [0]) is None and t.groups([2], [2]) is None and t.groups([], [0]) is None and t.groups([], []) == []
    small = alignment.Transducer([b"ab", b"c", b"a"], [b"a", b"bc", b"x"], most=1)
    assert small.groups([0, 1], [0, 1]) == small.groups([0, 1], [0, 1]) == [(2, 2)] and len(small.states) < len(t.states)


# ---- op13


def brute_clusters(rows, k=8, rounds=10):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return collections.Counter()
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r))
    cs = [v for _, v in order[:k]]
    nearest = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        own = collections.defaultdict(list)
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        cs = [[sum(x) // len(own[j]) for x in zip(*own[j])] if own[j] else c for j, c in enumerate(cs)]
    found = [(i, *nearest(v)) for i, v in kept]
    of = collections.Counter()
    for _, d, j in found:
        of[j] += d
    return collections.Counter((i, j, d, of[j], sum(of.values()), hashlib.sha256(",".join(map(str, cs[j])).encode()).hexdigest()) for i, d, j in found)


WHAT = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def test_clusters_equal_plain_rounds(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert multiset(centroids.clusters(rows), *WHAT) == brute_clusters([(r.vec_id, r.embedding) for r in rows.collect()])


def test_clusters_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=64).astype(np.float32)]) for i in range(40)]
    rows += [(7, rows[7][1]), (40, None), (41, []), (42, [1.0] * 63), (43, [1.0] * 65), (44, [None] + [1.0] * 63), (45, [float("nan")] + [1.0] * 63), (46, [float("inf")] + [1.0] * 63), (47, [0.0] * 64), (48, [0.0] * 64), (49, [-0.0004] * 64)]
    schema = "vec_id long, embedding array<float>"
    df = spark.createDataFrame(rows, schema).withColumns({"owner": F.lit("clash"), "e": F.lit(1), "cluster": F.lit(2)})
    assert multiset(centroids.clusters(df.repartition(3)), *WHAT) == brute_clusters(rows)
    for few in ([], rows[40:44], rows[:3], [(1, [0.5] * 64)] * 20):
        assert multiset(centroids.clusters(spark.createDataFrame(few, schema)), *WHAT) == brute_clusters(few)


def test_steps_over_changes_equal_whole_steps():
    """Random centroids of which some move, with many ties."""
    rng = np.random.default_rng(1)
    for _ in range(200):
        x, old = rng.integers(-2, 3, (50, 2)), rng.integers(-2, 3, (5, 2))
        whole = lambda c: (lambda d: (d.argmin(axis=1), d.min(axis=1)))(((x[:, None] - c[None]) ** 2).sum(axis=2))  # noqa: B023, E731
        owner, distance = whole(old)
        changed = rng.random(5) < 0.4
        new = np.where(changed[:, None], rng.integers(-2, 3, (5, 2)), old)
        found = centroids.nearest(x, new, owner, distance, changed)
        assert all((a == b).all() for a, b in zip(found, whole(new), strict=True))


# ---- op9: unigram models, written by hand


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(n, value):
    return varint(n << 3) + varint(value) if isinstance(value, int) else varint(n << 3 | 2) + varint(len(value)) + value


def model(pieces, kind, fallback, prefix, squeeze):
    """A model file of pieces (text, score, kind of piece)."""
    import struct

    rows = b"".join(field(1, field(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + field(3, k)) for p, s, k in pieces)
    return rows + field(2, field(3, kind) + field(35, int(fallback))) + field(3, field(3, int(prefix)) + field(4, int(squeeze)) + field(5, 1))


UNIGRAMS = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
WORDS = [("▁", -3.0, 1), ("▁apple", -4.0, 1), ("▁ban", -4.5, 1), ("ana", -4.2, 1), ("fox", -5.0, 1), ("▁fox", -4.4, 1), ("▁▁", -6.0, 1), *((c, -8.0 - i / 9, 1) for i, c in enumerate("abcdefghijklmnopqrstuvwxyz<>0145/s"[:-1]))]
BYTES = [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]


@pytest.mark.parametrize("fallback", [False, True])
@pytest.mark.parametrize("prefix", [False, True])
@pytest.mark.parametrize("squeeze", [False, True])
def test_unigram_ids_are_sentencepieces(fallback, prefix, squeeze):
    import pyarrow as pa
    from sentencepiece import SentencePieceProcessor

    from tallyforge.llm import sp_codec

    data = model([*UNIGRAMS, *(BYTES if fallback else []), *WORDS], 1, fallback, prefix, squeeze)
    own = SentencePieceProcessor(model_proto=data)
    texts = [t or "" for t in TEXTS if t != "x" * 3000] + ["apple banana fox", "fox", " apple  fox ", "<s> </s> <0x41> <unk>", "日本apple", "ÄÖ fox ß", "  ", "applefox banana"]
    codec = sp_codec.Codec(data, parity=True)
    ids, ends, fine = codec.encode(pa.array(texts, pa.string()))
    for t, s, e, ok in zip(texts, [0, *ends[:-1]], ends, fine, strict=True):
        assert ids[s:e].tolist() == own.encode(t), t
        # what the library decodes to itself does so here
        assert not ok or own.decode(own.encode(t)) == t
    assert fine[texts.index("apple banana fox")] and (not fallback or fine[texts.index("ÄÖ fox ß")])


def test_wrong_ids_are_no_round_trip():
    import pyarrow as pa

    from tallyforge.llm import sp_codec

    data = model([*UNIGRAMS, *WORDS], 1, False, True, False)
    codec = sp_codec.Codec(data, parity=True)
    codec.check = type("Other", (), {"encode": staticmethod(lambda t: [0])})
    assert not codec.encode(pa.array(["apple banana fox"]))[2].any()


# ---- op3: items without an id


def test_items_without_an_id(spark):
    from tallyforge.llm import decontam

    line = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, line), (2, "other words"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([("b", line), (None, line), (None, line + " more"), ("a", "w1 w2"), ("c", None)], "item_id string, text string")
    rows = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.contamination(docs, items).collect()}
    assert rows[1] == (20, 3, hashlib.sha256(b"a,b").hexdigest(), True) and rows[2][:2] == rows[3][:2] == (0, 0)
