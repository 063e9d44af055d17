"""SentencePiece encoding and decoding on the tokenizers library.

The model file is a protobuf message; its pieces, scores, kinds and normaliser settings are read here field by
field. From them a tokenizer of the tokenizers library is rebuilt: the normaliser (character map, dummy prefix, the metaspace
marker for spaces), a unigram model from the scores or, for BPE models, merges ranked by score, byte fallback, and the
decoder. Texts are cut before each run of markers that follows another character wherever no piece of the vocabulary
crosses such a place; then each distinct chunk of a batch is encoded once, in multithreaded batches, and ids of a text are gathered.

Null texts encode as empty ones. Equal rows each give a row. Extra columns aren't read.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import text_slices

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: varints as int, the other kinds as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        size = varint() if size is None else size
        yield tag >> 3, data[at : at + size]
        at += size


class Proto:
    """What encoding needs of a model: pieces (text, score, kind), type, byte fallback and normaliser settings."""

    def __init__(self, data: bytes) -> None:
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback, self.unknown = 1, False, 0
        self.charsmap, self.dummy_prefix, self.squeeze, self.escape = b"", True, True, True
        for n, value in fields(data):
            if n == 1:
                own = dict(fields(value))
                self.pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
            elif n == 2:
                own = dict(fields(value))
                self.kind, self.byte_fallback, self.unknown = own.get(3, 1), bool(own.get(35, 0)), own.get(40, 0)
            elif n == 3:
                own = dict(fields(value))
                self.charsmap = own.get(2, b"")
                self.dummy_prefix, self.squeeze, self.escape = (bool(own.get(k, 1)) for k in (3, 4, 5))

    def can_cut(self) -> bool:
        """No piece has a marker after another character, so that no merge or piece crosses such a place."""
        return self.escape and not any(MARK in p.lstrip(MARK) for p, _, k in self.pieces if k in (NORMAL, USER))


def merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """The pairs of pieces whose union is a piece, best score first; equal scores by ids of the parts."""
    ids = {p: i for i, (p, _, k) in enumerate(pieces) if k in (NORMAL, USER)}
    found = []
    for p, score, k in pieces:
        if k == NORMAL:
            for cut in range(1, len(p)):
                a, b = p[:cut], p[cut:]
                if a in ids and b in ids:
                    found.append((-score, ids[a], ids[b], a, b))
    return [(a, b) for *_, a, b in sorted(found)]


def build(proto: Proto, prefix: bool = False):
    """The tokenizers.Tokenizer that encodes as the model does; prefix: it puts the dummy prefix before what is left of a text after normalising.

    A unigram model matches normal pieces only; the others are named so that no text holds them, and bytes() spells unknown ones.
    """
    from tokenizers import Tokenizer, decoders, models, normalizers

    if proto.kind == 1:
        model = models.Unigram([(p, s) if k in (NORMAL, USER) else (f"\ufdd0{i}", 0.0) for i, (p, s, k) in enumerate(proto.pieces)], proto.unknown, False)
    else:
        vocabulary = {p: i for i, (p, _, _) in enumerate(proto.pieces)}
        model = models.BPE(vocabulary, merges(proto.pieces), unk_token=proto.pieces[proto.unknown][0], fuse_unk=True, byte_fallback=proto.byte_fallback)
    out = Tokenizer(model)
    steps = [normalizers.Precompiled(proto.charsmap)] if proto.charsmap else []
    if proto.squeeze:
        from tokenizers import Regex

        steps += [normalizers.Replace(Regex(r"\A +"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if proto.escape:
        steps.append(normalizers.Replace(" ", MARK))
    if prefix and proto.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if proto.escape else " "))
    if proto.squeeze:
        # a text's own markers count as spaces at its end, but not elsewhere
        steps.append(normalizers.Replace(Regex(rf"{MARK if proto.escape else ' '}+\z"), ""))
    if steps:
        out.normalizer = normalizers.Sequence(steps)
    parts = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    if proto.dummy_prefix:
        parts.append(decoders.Strip(" ", 1, 0))
    out.decoder = decoders.Sequence(parts)
    return out


class Codec:
    """Encoding and decoding of batches with one model."""

    def __init__(self, model: bytes, threads: int = 2, parity: bool = False) -> None:
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        self.proto = Proto(model)
        self.cut = self.proto.can_cut() and self.proto.dummy_prefix and not self.proto.squeeze and not self.proto.charsmap
        # texts that are cut have the prefix put before them here, others by the normaliser
        self.tokenizer = build(self.proto, prefix=not self.cut)
        self.unigram = self.proto.kind == 1
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(self.proto.pieces) if k == BYTE}
        self.marked = np.fromiter((p.startswith(MARK) for p, _, _ in self.proto.pieces), bool, len(self.proto.pieces))
        self.check = None
        if parity:
            import sentencepiece

            self.check = sentencepiece.SentencePieceProcessor(model_proto=model)

    def _batches(self, texts: list[str]) -> Iterator[list[str]]:
        """About 256 KB of texts at a time: an encoding takes many times its text's size."""
        at = size = 0
        for i, t in enumerate(texts):
            size += len(t) + 16
            if size > 1 << 18 or i + 1 == len(texts):
                yield texts[at : i + 1]
                at, size = i + 1, 0

    def ids(self, texts: list[str]) -> list[list[int]]:
        """The ids of texts, which begin with the prefix if they are cut."""
        if not (self.unigram and self.proto.byte_fallback):
            return [e.ids for batch in self._batches(texts) for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]
        # the fast way leaves the text of unknown pieces out
        found = (e for batch in self._batches(texts) for e in self.tokenizer.encode_batch(batch, add_special_tokens=False))
        return [self.spelled(e.ids, e.tokens) if self.proto.unknown in e.ids else e.ids for e in found]

    def spelled(self, ids: list[int], tokens: list[str]) -> list[int]:
        """ids with the bytes of unknown pieces, whose text is their token, in place of these."""
        return [x for i, t in zip(ids, tokens, strict=True) for x in ([self.byte_ids.get(b, i) for b in t.encode()] if i == self.proto.unknown else [i])]

    def text(self, ids: list[int]) -> str:
        """The text of a unigram model's ids; control pieces and unknown ones have none."""
        out = b"".join(bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, _, k in map(self.proto.pieces.__getitem__, ids) if k in (BYTE, NORMAL, USER)).decode("utf-8", "replace")
        return out.removeprefix(" ") if self.proto.dummy_prefix else out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return list(map(self.text, ids)) if self.unigram else self.tokenizer.decode_batch(ids, skip_special_tokens=True)

    def holds(self, text: str, ids: list[int]) -> bool:
        """Whether ids decode to the text, and are the sentencepiece library's, if that was given."""
        return self.decode([ids])[0] == text and (self.check is None or self.check.encode(text) == ids)

    def chunk_ids(self, chunks: list[str], group: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, their number per chunk, whether decoding and the sentencepiece library, if given, agree).

        A chunk is what follows a space, up to the next. Chunks that begin with an ordinary character are encoded
        joined in groups, whose ids fall apart at the pieces that begin with the marker; others one by one.
        """
        plain = np.fromiter((c != "" and c[0] not in (" ", MARK) and MARK not in c for c in chunks), bool, len(chunks))
        order = np.flatnonzero(plain)
        groups = [order[i : i + group] for i in range(0, len(order), group)] + [np.array([i]) for i in np.flatnonzero(~plain)]
        texts = [" ".join([chunks[i] for i in g]) for g in groups]
        own = self.ids([" " + t for t in texts])
        heads = [np.flatnonzero(self.marked[x]) if len(g) > 1 else np.zeros(1, np.int64) for g, x in ((g, np.array(x, np.int32)) for g, x in zip(groups, own, strict=True))]
        if any(len(h) != len(g) for h, g in zip(heads, groups, strict=True)):
            raise ValueError("a chunk's ids do not begin with one marked piece")
        good = np.fromiter((a == b for a, b in zip(self.decode(own), texts, strict=True)), bool, len(texts))
        if self.check is not None:
            good &= np.fromiter((self.check.encode(t) == x for t, x in zip(texts, own, strict=True)), bool, len(texts))
        sizes, fine = np.zeros(len(chunks), np.int64), np.ones(len(chunks), bool)
        for g, x, h, ok in zip(groups, own, heads, good, strict=True):
            sizes[g] = np.diff(np.append(h, len(x)))
            # one chunk of a group may fail alone
            fine[g] = ok or (len(g) > 1 and [self.holds(chunks[i], x[a:b]) for i, a, b in zip(g, h, [*h[1:], len(x)], strict=True)])
        placed = np.concatenate(groups) if groups else np.zeros(0, np.int64)
        flat = np.fromiter((i for x in own for i in x), np.int32, int(sizes.sum()))
        return _gathered(flat, np.cumsum(sizes[placed]) - sizes[placed], sizes[placed], np.argsort(placed)), sizes, fine

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each text ends, whether each text decodes to itself at parity)."""
        column = pc.fill_null(column.cast(pa.string()), "")
        texts = None
        if not self.cut:
            texts = column.to_pylist()
            own = self.ids(texts)
            fine = [a == b for a, b in zip(self.decode(own), texts, strict=True)]
            if self.check is not None:
                fine = [f and self.check.encode(t) == x for f, t, x in zip(fine, texts, own, strict=True)]
            return np.fromiter((i for x in own for i in x), np.int32), np.cumsum([len(x) for x in own], dtype=np.int64), np.array(fine, bool)
        odd = pc.or_(pc.match_substring_regex(column, "^ |  | $"), pc.equal(column, "")).to_numpy(zero_copy_only=False)
        even = pc.split_pattern(column.filter(pa.array(~odd)), " ")
        rest = pa.array([[c[1:] for c in chunked(" " + t)] if t else [] for t in column.filter(pa.array(odd)).to_pylist()], pa.list_(pa.string()))
        place = np.empty(len(column), np.int64)
        place[np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])] = np.arange(len(column))
        lists = pa.concat_arrays([even, rest]).take(pa.array(place))
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        coded = lists.flatten().dictionary_encode()
        flat, sizes, fine = self.chunk_ids(coded.dictionary.to_pylist())
        at = coded.indices.to_numpy(zero_copy_only=False)
        ids = _gathered(flat, np.cumsum(sizes) - sizes, sizes, at)
        ends = np.concatenate([[0], np.cumsum(counts)])
        token_ends = np.concatenate([[0], np.cumsum(sizes[at])])[ends]
        wrong = np.concatenate([[0], np.cumsum(~fine[at])])[ends]
        return ids, token_ends[1:], np.diff(wrong) == 0


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The runs of flat (start and size each) in this order, one after another."""
    if not len(order):
        return flat[:0]
    n = sizes[order]
    ends = np.cumsum(n)
    return flat[np.arange(ends[-1]) + np.repeat(starts[order] - (ends - n), n)]


def chunked(text: str) -> list[str]:
    """The text cut before every run of spaces that follows another character."""
    words = text.split(" ")
    out, lead = [], ""
    for i, w in enumerate(words):
        if i:
            lead += " "
        if w:
            out.append(lead + w)
            lead = ""
    if lead:
        out.append(lead)
    return out


def model_bytes(path: str) -> bytes:
    """The model file, read on the driver; it goes to the executors with the tasks (about half a megabyte)."""
    with open(path, "rb") as f:
        return f.read()


def _run(docs: DataFrame, model: str, threads: int, parity: bool, tail, kinds: str) -> DataFrame:
    data = docs.sparkSession.sparkContext.broadcast(model_bytes(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(data.value, threads, parity)
        for batch in text_slices(batches, 3 << 20):
            ids, ends, fine = codec.encode(batch.column("text"))
            yield tail(batch.column("doc_id"), ids, np.concatenate([[0], ends]), fine)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {kinds}")


def encoded(docs: DataFrame, model: str, threads: int = 2, parity: bool = True) -> DataFrame:
    """doc_id, ids (array of int), n_tokens, round_trip (decoding gives the text back; also the sentencepiece library's ids, if parity is asked for)."""

    def tail(doc_id, ids, ends, fine):
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
        return pa.RecordBatch.from_arrays([doc_id, lists, pa.array(np.diff(ends)), pa.array(fine)], names=["doc_id", "ids", "n_tokens", "round_trip"])

    return _run(docs, model, threads, parity, tail, "ids array<int>, n_tokens long, round_trip boolean")


def encoding_digest(docs: DataFrame, model: str, threads: int = 2, parity: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit numbers), round_trip: also at parity if asked for."""
    import hashlib

    def tail(doc_id, ids, ends, fine):
        raw = ids.astype("<i4").tobytes()
        sha = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(ends, ends[1:], strict=False)]
        return pa.RecordBatch.from_arrays([doc_id, pa.array(np.diff(ends)), pa.array(sha, pa.string()), pa.array(fine)], names=["doc_id", "n_tokens", "ids_sha256", "round_trip"])

    return _run(docs, model, threads, parity, tail, "n_tokens long, ids_sha256 string, round_trip boolean")


def decoded(tokens: DataFrame, model: str, threads: int = 2) -> DataFrame:
    """doc_id and text of the rows of encoded(); null ids give null."""
    data = tokens.sparkSession.sparkContext.broadcast(model_bytes(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(data.value, threads)
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                ids = part.column(1).to_pylist()
                texts = [None if x is None else t for x, t in zip(ids, codec.decode([x or [] for x in ids]), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, text string")
