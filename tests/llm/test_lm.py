"""The backoff automaton against its formula: scores, sums to one, states that do not depend on how texts are cut."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from spanforge.llm import lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
END = "\n"


def texts(seed=4, n=70):
    rng = random.Random(seed)
    say = lambda: " ".join(rng.choice(["the", "cat", "sat", "on", "a", "mat", "Dog", "né", "and", f"w{rng.randrange(40)}"]) for _ in range(rng.randint(0, 25)))
    rows = {i: say() for i in range(n)}
    return rows | {n: None, n + 1: "", n + 2: " \t", n + 3: "the cat sat on the mat " * 60}


class Model:
    """Counts and the formula, with K solved from the same sums by the definition."""

    def __init__(self, rows, state=lm.STATE):
        fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        self.tok = {i: [*WORD.findall(fold(t)), END] for i, t in rows.items()}
        self.c = Counter(), Counter(), Counter()
        for i, t in self.tok.items():
            if zlib.crc32(str(i).encode()) % 5 != 1:
                for k in range(3):
                    self.c[k].update(tuple(t[j : j + k + 1]) for j in range(len(t) - k))
        self.n, self.v, self.state = sum(self.c[0].values()), len(self.c[0]), state
        bins = lambda counts: [(len(x), sum(x)) for b in range(1, 40) if (x := [c for c in counts if math.frexp(c)[1] == b])]
        self.k2 = lm.prior(bins([c for g, c in self.c[0].items() if g != (END,)]), sum(c == 1 for c in self.c[1].values()))
        self.k3 = lm.prior(bins([c for g, c in self.c[1].items() if g[1] != END and c >= state]), sum(c == 1 for g, c in self.c[2].items() if self.c[1][g[:2]] >= state))

    def p(self, h, w):
        if not h:
            return (self.c[0][(w,)] + 0.5) / (self.n + 0.5 * (self.v + 1))
        less = self.p(h[1:], w)
        n = self.c[len(h) - 1][h]
        if n < (self.state if len(h) == 2 else 1):
            return less
        k = self.k2 if len(h) == 1 else self.k3
        return (self.c[len(h)][(*h, w)] + k * less) / (n + k)

    def score(self, i):
        t = self.tok[i]
        return sum(math.log10(self.p(tuple(t[max(0, j - 2) : j]), w)) for j, w in enumerate(t))


@pytest.mark.parametrize(("block_bytes", "bits"), [(1 << 20, 8), (900, 8), (600, 2)])
def test_scores_equal_the_formula(spark, block_bytes, bits):
    rows = texts()
    m = Model(rows)
    docs = spark.createDataFrame([(i, t, "clash", True) for i, t in rows.items()], "doc_id long, text string, id string, train boolean")
    got = lm.score(docs, block_bytes=block_bytes, digit_bits=bits).collect()
    assert len(got) == len(rows)
    for r in got:
        t = m.tok[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(m.c[0][(w,)] > 0 for w in t), m.n)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert r.base_score == pytest.approx(sum(math.log10(m.p((), w)) for w in t))
        assert r.score == pytest.approx(m.score(r.doc_id))


def test_probabilities_sum_to_one():
    m = Model(texts())
    unseen = 1 + 0.5 * 0  # one word stands for all that training lacks
    for h in [(), ("the",), ("cat", "sat"), ("the", "cat"), ("zzz",), ("zzz", "the"), ("on", "zzz")]:
        assert sum(m.p(h, w) for (w,) in m.c[0]) + unseen * m.p(h, "never seen") == pytest.approx(1)


def test_history_helps_on_texts_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = lm.score(docs).filter("held_out").selectExpr("sum(score) AS s", "sum(base_score) AS b").first()
    assert r.s > r.b


def test_rows_without_id_or_text(spark):
    docs = spark.createDataFrame([(None, "a b a b"), (None, "a b a b"), (1, None)], "doc_id long, text string")
    got = sorted((r.n_tokens, r.held_out) for r in lm.score(docs).collect())
    assert got == [(1, False), (5, False), (5, False)]
    assert lm.score(docs.limit(0)).count() == 0


def test_stretches_give_what_whole_texts_give():
    rng = np.random.default_rng(7)
    counts = np.array([1, 900, 3, 40, 2])
    word = rng.integers(1, 9, int(counts.sum()))
    word[np.cumsum(counts) - 1] = 0
    pairs, c2 = np.unique(np.stack([word[:-1], word[1:]]), axis=1, return_counts=True)
    c1 = np.bincount(word, minlength=9)
    t = {}
    for a, b, c in zip(word, word[1:], word[2:]):
        if a and b:
            t[a, b, c] = t.get((a, b, c), 0) + 1
    number = {(a, b): i for i, (a, b) in enumerate(pairs.T.tolist())}
    triples = [np.array(x) for x in zip(*((number[a, b], c, n) for (a, b, c), n in t.items()))]
    m = lm.Automaton(c1, c1 / c1.sum(), 0, pairs[0], pairs[1], c2, tuple(triples), 0.7, 1.3, 3)
    whole = m.walk(word, counts, 10_000)
    for stretch in (1, 2, 3, 7, 256):
        assert np.allclose(m.walk(word, counts, stretch), whole)
    state, total = 0, []
    for w in word[1:901]:
        s, p = m.step(np.array([state]), np.array([w]))
        state = int(s[0])
        total.append(p[0])
    assert np.allclose(total, whole[1:901])
