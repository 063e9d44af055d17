"""Alignment of two tokenizers over the bytes of a text.

Both write space+text: a byte-level BPE of the tokenizers library (A) and a SentencePiece model that puts a space first (B). A transducer
reads the two token sequences: its state is the side that leads and the bytes that the other side has yet to match;
the side behind reads its next token, and when nothing is left unmatched, a group closes. Steps are memoised by
state and token. Neither tokenizer joins bytes across a place where a space follows a character that isn't white, so texts are
cut there, and each distinct piece of a block of texts is encoded and aligned once.

How often a pair of ids is linked is a number of the whole corpus. Each block of texts (about `block_bytes`) gives its distinct
pairs with the number of its rows that hold them; these are added up over all blocks, and the sums return to the block's rows
in one cogroup by block. A block is bounded, whatever the texts; one that is a single very long text stands alone.

Null and empty texts, and texts whose tokens do not write space+text (such as those that hold U+2581), have no tokens. Repeated
rows each count as a document; null and equal ids don't matter. An empty table gives no rows. Equal counts of an A id's partners are
all best. Columns beside doc_id and text aren't read, so that their names can't clash.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import accumulate, chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_slices
from .sp_codec import MARK, _gathered

#: A place where neither tokenizer joins: before spaces that follow what isn't white space and are followed by more text.
CUT = re.compile(r"(?<=\S)(?= +[^ ])")

#: What makes a text odd: a space at an end, or one after white space. In others every space is such a place.
ODD = r"^ | $|[\s\x0b\x1c-\x1f\x{85}\p{Z}] "

#: What a state says: neither side is ahead, A is, or B is.
EVEN, A_LEADS, B_LEADS = 0, 1, 2


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1 ones stand for themselves, the others follow from U+0100."""
    shown = {b for a, z in (("!", "~"), ("¡", "¬"), ("®", "ÿ")) for b in range(ord(a), ord(z) + 1)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TokenBytes(dict):
    """The bytes of ids, looked up once each."""

    def __init__(self, of: Callable[[int], bytes]) -> None:
        self.of = of

    def __missing__(self, token: int) -> bytes:
        self[token] = out = self.of(token)
        return out


class Transducer:
    """Groups of two token sequences; side_a and side_b give the bytes of ids.

    States are numbered (side that leads, unmatched bytes); 0 is the even one. A leads after its token was read in the even state. Steps
    are kept by state and token; beyond `most` states all are forgotten between two calls.
    """

    def __init__(self, side_a, side_b, most: int = 1 << 18) -> None:
        self.side_a, self.side_b, self.most = side_a, side_b, most
        self.forget()

    def forget(self) -> None:
        self.states, self.leads = [(EVEN, b"")], [EVEN]
        self.numbers = {(EVEN, b""): 0}
        self.memo: dict[int, int] = {}

    def step(self, state: int, token: int) -> int:
        """The state after the side that is behind has read a token; -1 where the bytes differ."""
        lead, left = self.states[state]
        read = (self.side_b if lead == A_LEADS else self.side_a)[token]
        if lead == EVEN:
            found = (A_LEADS, read)
        elif left.startswith(read):
            rest = left[len(read) :]
            found = (lead if rest else EVEN, rest)
        else:
            found = (A_LEADS + B_LEADS - lead, read[len(left) :]) if read.startswith(left) else None
        out = -1 if found is None else self.numbers.setdefault(found, len(self.states))
        if out == len(self.states):
            self.states.append(found)
            self.leads.append(found[0])
        self.memo[state << 32 | token] = out
        return out

    def groups(self, a: list[int], b: list[int]) -> list[tuple[int, int]] | None:
        """Where each group ends in a and in b; None where the two write different bytes."""
        if len(self.states) > self.most:
            self.forget()
        memo, leads, ends = self.memo, self.leads, []
        i = j = state = 0
        n_a, n_b = len(a), len(b)
        while True:
            if leads[state] == A_LEADS:
                if j == n_b:
                    return None
                token = b[j]
                j += 1
            elif i < n_a:
                token = a[i]
                i += 1
            else:
                return ends if state == 0 and j == n_b else None
            try:
                state = memo[state << 32 | token]
            except KeyError:
                state = self.step(state, token)
            if state < 0:
                return None
            if state == 0:
                ends.append((i, j))


class Aligner:
    """Both tokenizers, and for blocks of texts their pieces, encoded and aligned."""

    def __init__(self, a: bytes, b: bytes, most: int = 200_000) -> None:
        self.kept: dict[str, tuple] = {}
        self.most = most  # pieces that are kept, about 80 MB
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers
        from sentencepiece import SentencePieceProcessor

        self.a, self.b = tokenizers.Tokenizer.from_buffer(a), SentencePieceProcessor(model_proto=b)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        alphabet = byte_alphabet()

        def of_b(i: int) -> bytes:
            p = self.b.id_to_piece(i)
            return bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode()

        # special tokens are not written, so that all characters of an id stand for bytes
        self.side_a = TokenBytes(lambda i: bytes(map(alphabet.__getitem__, self.a.id_to_token(i))))
        self.transducer = Transducer(self.side_a, TokenBytes(of_b))
        vocabulary = self.a.get_vocab()
        self.size_a = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.size_a[i] = len(token)

    def written(self, ids: list[int]) -> bytes:
        return b"".join(map(self.side_a.__getitem__, ids))

    def encoded_a(self, pieces: list[str], together: int = 256) -> list[list[int] | None]:
        """A ids of space+piece, None where they write other bytes. Pieces that don't end in white space are encoded some at a time, as no
        token crosses the space between them; the ids fall apart where the bytes of the pieces end."""
        out: list[list[int] | None] = [None] * len(pieces)
        runs, alone = [], [i for i, p in enumerate(pieces) if p[-1].isspace()]
        open_ended = [i for i, p in enumerate(pieces) if not p[-1].isspace()]
        runs = [open_ended[i : i + together] for i in range(0, len(open_ended), together)]
        texts = ["".join([f" {pieces[i]}" for i in run]) for run in runs]
        for run, text, e in zip(runs, texts, self.a.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = e.ids
            ends, wanted = np.cumsum(self.size_a[ids]), np.cumsum([1 + len(pieces[i].encode()) for i in run])
            at = np.searchsorted(ends, wanted)
            if self.written(ids) == text.encode() and (ends[at] == wanted).all():
                start = 0
                for i, to in zip(run, (at + 1).tolist(), strict=True):
                    out[i] = ids[start:to]
                    start = to
            else:
                alone += run
        for i, e in zip(alone, self.a.encode_batch_fast([f" {pieces[i]}" for i in alone], add_special_tokens=False), strict=True):
            out[i] = e.ids if self.written(e.ids) == f" {pieces[i]}".encode() else None
        return out

    def pieces(self, pieces: list[str]) -> Pieces:
        """pieces, which stand behind a space, encoded and aligned. The first that come, which are the common ones, are kept for later blocks."""
        new = [p for p in pieces if p not in self.kept]
        of_a, of_b = self.encoded_a(new), self.b.encode(new, num_threads=1)
        groups = self.transducer.groups
        made = {p: packed(a, b, None if a is None else groups(a, b)) for p, a, b in zip(new, of_a, of_b, strict=True)}
        found = [self.kept.get(p) or made[p] for p in pieces]
        for p in islice(new, max(0, self.most - len(self.kept))):
            if len(p) < 64:
                self.kept[p] = made[p]
        return Pieces(found)

    def block(self, column: pa.Array) -> Block:
        column = pc.fill_null(column.cast(pa.string()), "")
        odd = pc.or_(pc.match_substring_regex(column, ODD), pc.equal(column, "")).to_numpy(zero_copy_only=False)
        even = pc.split_pattern(column.filter(pa.array(~odd)), " ")
        rest = pa.array([[p[1:] for p in CUT.split(" " + t)] if t else [] for t in column.filter(pa.array(odd)).to_pylist()], pa.list_(pa.string()))
        place = np.empty(len(column), np.int64)
        place[np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])] = np.arange(len(column))
        lists = pa.concat_arrays([even, rest]).take(pa.array(place))
        coded = lists.flatten().dictionary_encode()
        return Block(self.pieces(coded.dictionary.to_pylist()), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))


def packed(a: list[int] | None, b: list[int], ends: list[tuple[int, int]] | None) -> tuple[bytes, bytes, bytes] | tuple[()]:
    """A ids, B ids and group ends of a piece as 32-bit numbers; empty where the sides don't write it."""
    return () if ends is None else (array("I", a).tobytes(), array("I", b).tobytes(), array("I", chain.from_iterable(ends)).tobytes())


def flat(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parts), np.uint32).astype(np.int64)


def ranks(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of runs of these sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class Pieces:
    """Encoded and aligned pieces: a, b are the ids of all one after another, groups the A and B tokens of each group.

    fine: whether both sides write the piece; the others have no tokens here. n: A tokens, B tokens and groups of each piece.
    """

    def __init__(self, found: list[tuple[bytes, bytes, bytes] | tuple[()]]) -> None:
        self.fine = np.fromiter(map(bool, found), bool, len(found))
        kept = found if self.fine.all() else [f or (b"", b"", b"") for f in found]
        sides = [[f[k] for f in kept] for k in range(3)]
        self.a, self.b, upto = map(flat, sides)
        upto = upto.reshape(-1, 2)
        self.n = np.stack([np.fromiter(map(len, x), np.int64, len(x)) for x in sides], axis=1) // np.array([4, 4, 8])
        self.groups = np.diff(upto, axis=0, prepend=0)
        first = np.cumsum(self.n[:, 2]) - self.n[:, 2]
        first = first[self.n[:, 2] > 0]
        self.groups[first] = upto[first]

    def pairs(self, many: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, links, keys of each piece): pairs of ids that share a group, as a << 32 | b, with how many links each has.

        Groups of more than `many` links are counted by distinct ids, as in long runs of one character; a key may come more than once.
        """
        piece = np.repeat(np.arange(len(self.n)), self.n[:, 2])
        n_a, n_b = self.groups.T
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        sizes = np.where(n_a * n_b <= many, n_a * n_b, 0)
        g, r = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), ranks(sizes).astype(np.int32)
        width = np.maximum(n_b, 1).astype(np.int32)[g]
        keys = self.a[first_a[g] + r // width] << 32
        keys |= self.b[first_b[g] + r % width]
        count = np.bincount(piece, sizes, len(self.n)).astype(np.int64)
        large = np.flatnonzero(n_a * n_b > many)
        if not len(large):
            return keys, np.ones(len(keys), np.int64), count
        owners, keys, links = [piece[g]], [keys], [np.ones(len(g), np.int64)]
        for i in large:
            ours, m = np.unique(self.a[first_a[i] : first_a[i] + n_a[i]], return_counts=True)
            theirs, n = np.unique(self.b[first_b[i] : first_b[i] + n_b[i]], return_counts=True)
            keys.append((ours[:, None] << 32 | theirs).ravel())
            links.append((m[:, None] * n).ravel())
            owners.append(np.full(len(keys[-1]), piece[i]))
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(keys)[order], np.concatenate(links)[order], np.bincount(owner, minlength=len(self.n))

    def texts(self) -> list[bytes]:
        """Each piece's groups as `a1,a2|b1;a3|b2;`."""
        sizes = self.groups.sum(axis=1)
        first = np.cumsum(sizes) - sizes
        ids, mark = np.empty(sizes.sum(), np.int64), np.full(sizes.sum(), ord(","), np.uint8)
        n_a, n_b = self.groups.T
        ids[np.repeat(first, n_a) + ranks(n_a)] = self.a
        ids[np.repeat(first + n_a, n_b) + ranks(n_b)] = self.b
        mark[first + n_a - 1], mark[first + sizes - 1] = ord("|"), ord(";")
        digits = np.ones(len(ids), np.int64)
        for k in range(1, 10):
            digits += ids >= 10**k
        ends = np.cumsum(digits + 1)
        out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
        for k in range(int(digits.max(initial=0))):
            has = digits > k
            out[ends[has] - 2 - k] = 48 + ids[has] // 10**k % 10
        out[ends - 1] = mark
        whole, stops = out.tobytes(), np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(self.n[:, 0] + self.n[:, 1])])].tolist()
        return [whole[i:j] for i, j in zip(stops, stops[1:], strict=False)]


class Block:
    """The rows of a block: of each its numbers, its groups and its pairs.

    at: the piece of each place in all texts; sizes: places of each text.
    """

    def __init__(self, pieces: Pieces, at: np.ndarray, sizes: np.ndarray) -> None:
        rows = len(sizes)
        row = np.repeat(np.arange(rows), sizes)
        good = np.ones(rows, bool)
        good[row[~pieces.fine[at]]] = False
        keep = good[row]
        self.pieces, self.at = pieces, at[keep]
        row = row[keep]
        self.sizes = np.where(good, sizes, 0)
        #: A tokens, B tokens and groups of each row
        self.numbers = np.array([np.bincount(row, pieces.n[self.at, k], rows).astype(np.int64) for k in range(3)])
        keys, links, n = pieces.pairs()
        #: distinct pairs, and for each row the places of its own among them with their links
        self.keys, place = np.unique(keys, return_inverse=True)
        starts = np.cumsum(n) - n
        width = max(len(self.keys), 1)
        each = np.repeat(row, n[self.at]) * width + _gathered(place, starts, n, self.at)
        found, where = np.unique(each, return_inverse=True)
        self.links = np.zeros(len(found), np.int64)
        np.add.at(self.links, where, _gathered(links, starts, n, self.at))
        self.places = found % width
        self.ends = np.searchsorted(found, np.arange(rows + 1) * width)
        self.holders = np.bincount(self.places, minlength=len(self.keys)) if len(self.keys) else np.zeros(0, np.int64)

    def groups(self) -> Iterator[bytes]:
        """The groups of each row; empty without tokens."""
        texts = self.pieces.texts()
        for to, size in zip(accumulate(self.sizes.tolist()), self.sizes.tolist(), strict=True):
            yield b"".join([texts[i] for i in self.at[to - size : to].tolist()])[:-1]


def _aligned(docs: DataFrame, a: str, b: str, block_bytes: int) -> Iterator[tuple]:
    files = []
    for path in (a, b):
        with open(path, "rb") as f:
            files.append(f.read())
    files = docs.sparkSession.sparkContext.broadcast(files)  # two vocabulary files, some megabytes

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, Block]]:
        aligner = Aligner(*files.value)
        task = TaskContext.get().partitionId() << 32
        n = 0
        for batch in batches:
            for part in text_slices([batch], block_bytes):
                yield task + n, part, aligner.block(part.column("text"))
                n += 1

    return blocks


def aligned(docs: DataFrame, a: str, b: str, block_bytes: int = 3 << 20) -> DataFrame:
    """doc_id, groups: of every row of docs (doc_id, text) its groups as `a1,a2|b1;a3|b2,b3`, ids in order; empty without tokens."""
    blocks = _aligned(docs, a, b, block_bytes)

    def run(batches):
        for _, part, block in blocks(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([g.decode() for g in block.groups()], pa.string())], names=["doc_id", "groups"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, groups string")


_ROW = "n_a long, n_b long, n_groups long, groups_sha256 string, places array<int>, links array<long>, keys array<long>, holders array<int>"


def linked_rows(docs: DataFrame, a: str, b: str, block_bytes: int) -> DataFrame:
    """block, doc_id, numbers, digest and pairs of every row; the block's first row also has its distinct pairs (keys) with the
    number of rows that hold them."""
    blocks = _aligned(docs, a, b, block_bytes)

    def run(batches):
        for n, part, block in blocks(batches):
            rows = part.num_rows
            first = lambda x, kind: pa.array([x] + [None] * (rows - 1), pa.list_(kind))
            of_row = lambda x, kind: pa.ListArray.from_arrays(pa.array(block.ends, pa.int32()), pa.array(x, kind))
            sha = [hashlib.sha256(g).hexdigest() if g else "" for g in block.groups()]
            columns = [pa.array(np.full(rows, n)), part.column("doc_id"), *map(pa.array, block.numbers), pa.array(sha, pa.string()), of_row(block.places, pa.int32()), of_row(block.links, pa.int64()), first(block.keys, pa.int64()), first(block.holders, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "doc_id", *(c.split()[0] for c in _ROW.split(", "))])

    return docs.select("doc_id", "text").mapInArrow(run, f"block long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_ROW}")


def pair_counts(rows: DataFrame) -> DataFrame:
    """key, n, best: how many rows of linked_rows() hold a pair, and whether its A id has no pair with more."""
    held = rows.where("keys is not null").select(F.inline(F.arrays_zip("keys", "holders"))).groupBy(F.col("keys").alias("key")).agg(F.sum("holders").alias("n"))
    of_a = F.shiftright("key", 32)
    # one row for each id of A's vocabulary
    most = held.groupBy(of_a.alias("of_a_")).agg(F.max("n").alias("most_"))
    return held.join(F.broadcast(most), of_a == F.col("of_a_")).select("key", "n", (F.col("n") == F.col("most_")).alias("best"))


def alignment(docs: DataFrame, a: str, b: str, block_bytes: int = 3 << 20) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs (doc_id, text)."""
    rows = stored(linked_rows(docs, a, b, block_bytes), "aligned")
    counts = pair_counts(rows)
    asked = rows.where("keys is not null").select("block", F.posexplode("keys").alias("place", "key"))
    told = asked.join(counts, "key").select(F.col("block").alias("of_block"), "place", "n", "best")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def answer(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        n, best = np.zeros(theirs.num_rows, np.int64), np.zeros(theirs.num_rows, bool)
        at = theirs.column("place").to_numpy()
        n[at], best[at] = theirs.column("n").to_numpy(), theirs.column("best").to_numpy()
        lists = ours.column("places").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(sizes)), sizes)
        places, links = lists.flatten().to_numpy(), ours.column("links").combine_chunks().flatten().to_numpy()
        sums = [links, links * best[places], links * n[places]]
        totals = []
        for x in sums:
            out = np.zeros(len(sizes), np.int64)
            np.add.at(out, row, x)
            totals.append(pa.array(out))
        return pa.table([*(ours.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")), *totals, ours.column("groups_sha256")], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    ours = rows.select("block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "places", "links")
    return ours.groupBy("block").cogroup(told.groupBy("of_block")).applyInArrow(answer, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
