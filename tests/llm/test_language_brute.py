"""The language models against Kneser-Ney over dictionaries, and pairs of large groups against counting by occurrences."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import alignment, langid


def code(gram):
    """A gram as it is stored: its last character in the low 16 bits."""
    return sum(ord(c) << 16 * i for i, c in enumerate(reversed(gram)))


def word_grams(text):
    """The 4-grams of each character of a word and of the blank behind it, the history padded with blanks."""
    return [f"   {w} "[i : i + 4] for w in re.findall("[a-z]+", text.lower()) for i in range(len(w) + 1)]


class Dictionaries:
    """Interpolated Kneser-Ney of one language from counts of 4-grams."""

    def __init__(self, counts):
        self.levels = {4: counts}
        for k in (3, 2, 1):
            self.levels[k] = collections.Counter(g[1:] for g in self.levels[k + 1])
        self.discount, self.by = {}, {}
        for k, level in self.levels.items():
            once, twice = (sum(n == m for n in level.values()) for m in (1, 2))
            self.discount[k] = min(once / (once + 2 * twice), 0.95) if once and twice else 0.5
            self.by[k] = collections.defaultdict(list)
            for g, n in level.items():
                self.by[k][g[:-1]].append(n)

    def p(self, gram):
        k, d = len(gram), self.discount[len(gram)]
        below = self.p(gram[1:]) if k > 1 else 1 / (len(self.levels[1]) + 1)
        own = self.by[k].get(gram[:-1])
        return below if not own else (max(self.levels[k].get(gram, 0) - d, 0) + d * len(own) * below) / sum(own)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    letters = {"x": "abcde", "y": "cdefgh"}
    return [(i, " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(1, 6))) for _ in range(12)), lang) for i in range(160) for lang in [rng.choice("xy")]]


def test_limits_and_temperature_come_from_all_labelled_rows(spark):
    rng = random.Random(8)
    rows = [(i, " ".join("".join(rng.choice("abcde" if i % 2 else "cdefgh") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 9))), "xy"[i % 2]) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.trained(docs)
    temperature, limits = langid.calibrated(model, docs, 200)
    own = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    assert len(own) > 2500
    ce, n = model.of_texts(pa.array([r[1] for r in own]), langid.letter_table())
    at = np.array([model.languages.index(r[2]) for r in own])
    assert limits == pytest.approx([np.quantile(ce[at == i, i], 0.999) + 0.05 for i in (0, 1)], abs=langid.STEP)
    z = -ce * np.minimum(n, 200)[:, None]
    assert temperature == min(langid.TEMPERATURES, key=lambda t: -np.log(np.maximum(langid._softmax(z / t)[np.arange(len(own)), at], 1e-12)).mean())


def learned(corpus):
    out = {}
    for lang in "xy":
        out[lang] = Dictionaries(collections.Counter(g for i, t, own in corpus if own == lang and zlib.crc32(str(i).encode()) % 4 != 2 for g in word_grams(t)))
    return out


def test_probabilities_equal_dictionaries_and_sum_to_one(corpus):
    own = learned(corpus)
    model = langid.Model(pd.DataFrame([(lang, code(g), n) for lang, d in own.items() for g, n in d.levels[4].items()], columns=["lang", "gram", "n"]))
    grams = ["".join(g) for g in itertools.product("ab cz", repeat=4)]
    found = model.scores(np.array([code(g) for g in grams], np.uint64))
    for i, lang in enumerate(model.languages):
        want = [math.log(own[lang].p(g)) for g in grams]
        assert np.allclose(found[:, i], want, atol=1e-4)
        # over all characters that were seen, and one that wasn't
        for history in ("   ", "  a", "abc", "zzz", " cd"):
            seen = [*own[lang].levels[1], "z"]
            assert abs(sum(own[lang].p(history + c) for c in seen) - 1) < 1e-9
            assert abs(np.exp(model.scores(np.array([code(history + c) for c in seen], np.uint64))[:, i]).sum() - 1) < 1e-3


def test_predictions_equal_dictionaries(spark, corpus):
    own = learned(corpus)
    docs = spark.createDataFrame(corpus, "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in langid.languages(docs).collect()}
    for i, text, _ in corpus:
        grams = word_grams(text)
        entropy = {lang: -sum(math.log(d.p(g)) for g in grams) / len(grams) for lang, d in own.items()}
        best = min(sorted(entropy), key=entropy.get)
        assert rows[i].lang_pred == best and abs(rows[i].cross_entropy * math.log(2) - entropy[best]) < 1e-3


def test_long_texts_ties_and_rejection(spark, corpus):
    more = [(1000, "abcde " * 20000, None), (1001, "qqq", None), (1002, None, "x"), (1003, "12 34", "x"), (1004, "zzzz qqqq " * 50, None)]
    rows = {r.doc_id: r for r in langid.languages(spark.createDataFrame([*corpus, *more], "doc_id long, text string, lang string")).collect()}
    short = langid.languages(spark.createDataFrame([*corpus, (1000, "abcde " * 40, None)], "doc_id long, text string, lang string")).where("doc_id = 1000").head()
    # length counts up to a limit in the score, not in the prediction
    assert rows[1000].lang_pred == "x" and abs(rows[1000].score - short.score) < 1e-6
    assert rows[1002].lang_pred == rows[1003].lang_pred == "und" and rows[1002].score == rows[1003].score == 0
    assert rows[1004].rejected and rows[1002].rejected
    # of the rows that the limits come from nearly none is rejected
    assert sum(rows[i].rejected for i, *_ in corpus if not rows[i].held_out) < 0.1 * len(corpus)
    # two languages that learned the same: the first in the alphabet
    same = [(i, "abc abd", lang) for i, lang in enumerate(("b", "a") * 8)]
    held = [i for i, *_ in same if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held
    twice = spark.createDataFrame([r for i, t, _ in same if i not in held for r in ((i, t, "a"), (i, t, "b"))] + [(h, "abc", None) for h in held], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.languages(twice).where(F.col("held_out")).collect()} == {"a"}


def test_pairs_of_large_groups():
    rng = np.random.default_rng(3)
    a, b = ([rng.integers(0, 5, n).tolist() for n in sizes] for sizes in ((7, 3, 9), (5, 4, 8)))
    ends = [[(4, 2), (7, 5)], None, [(9, 8)]]
    pieces = alignment.Pieces([alignment.packed(*x) for x in zip(a, b, ends)])
    want = collections.Counter()
    for i, e in enumerate(ends):
        for (x0, y0), (x, y) in zip([(0, 0), *(e or [])], e or []):
            want.update((i, p << 32 | q) for p in a[i][x0:x] for q in b[i][y0:y])
    for many in (0, 8, 4096):
        keys, links, n = pieces.pairs(many)
        got = collections.Counter()
        for owner, k, m in zip(np.repeat(np.arange(3), n).tolist(), keys.tolist(), links.tolist(), strict=True):
            got[owner, k] += m
        assert got == want
    assert [t.decode() for t in pieces.texts()][1] == "" and pieces.texts()[2].decode().count(";") == 1
