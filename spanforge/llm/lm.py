"""Language-model scoring by a weighted backoff automaton over trigram counts of the whole corpus.

States are the root, one for each word seen in training, and one for each pair of words seen there
STATE times or more.  A state has an arc for every word that followed it in training and a failure
arc to the state without its first word.  An arc on ``w`` from history ``h`` weighs

    log10 ((c(hw) + K P(w | h')) / (c(h) + K)),

the failure arc of ``h`` weighs log10 (K / (c(h) + K)), and the root has an arc for every word,
P(w) = (c+0.5)/(N+0.5(V+1)); so the weights along the arcs taken make P(w | h), which sums to one
over all words.  An arc leads to the longest state that the words read so far end with.  K of pairs
and of triples is such that histories leave as much to shorter ones as the corpus has n-grams seen
once (Good and Turing's estimate of what was not seen).  Texts are read from left to right: each
step looks for the arc of the state carried along, follows failure arcs until one has it, and adds
up the weights.  Many texts are read in lockstep; of a long one, stretches that begin two words
early, as two words lead from the root to the right state.

The automaton grows with the corpus and is never in one place.  Documents go to blocks of bounded
size by a hash of id and text; a block asks a tree of counters (``tally``) for the totals of the
words and pairs that its texts have, then of the triples whose history is a state, and builds the
part of the automaton that its texts can reach.  Words are known by hashes of 62 bits, pairs and
triples of 54.

Defined results: null and empty texts are the end token alone; repeated rows count and score each;
a null id belongs to training; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tally import BITS, UP, Tree, totals, unpack
from .textnp import Words, column, mix, raw, slices

#: Occurrences from which a pair of words is a state.
STATE = 4
#: Bytes of text in a block, about.
BLOCK_BYTES = 8 << 20
#: Tokens of a stretch that is read in lockstep with others.
STRETCH = 256
#: The token that ends every text.
END = np.uint64(0x5DEECE66D1234567)
#: Classes of keys, in bits 8 and 9; bits 0 to 7 are kept for words alone, as only their counts must be exact at any size.
WORD, PAIR, TRIPLE, LAST = 0, 1, 2, 3
_CLASS = np.uint64(3 << 8)
_LOW = np.uint64(255)


def _tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every token, number of tokens by row); every row ends with END."""
    hashes, counts = [], []
    for batch in slices(table.select(["text"]).to_batches(), "text", 1 << 20):
        w = Words(*raw(column(batch, "text")))
        hashes.append(np.insert(w.hash, w.first[1:], END))
        counts.append(np.diff(w.first) + 1)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(counts)


def _key(h: np.ndarray, kind: int) -> np.ndarray:
    out = (h & ~_CLASS) | np.uint64(kind << 8)
    return out if kind == WORD else out & ~_LOW


def _is(keys: np.ndarray, kind: int) -> np.ndarray:
    return (keys & _CLASS) == np.uint64(kind << 8)


class Grams:
    """Keys of the words, pairs and triples of a block's tokens; ``nth`` is the place of a token in its text."""

    def __init__(self, table: pa.Table):
        self.tokens, self.counts = _tokens(table)
        n = len(self.tokens)
        self.train = np.repeat(table.column("train").to_numpy().astype(bool), self.counts) if table.num_rows else np.zeros(0, bool)
        first = np.cumsum(self.counts) - self.counts
        self.nth = np.arange(n) - np.repeat(first, self.counts)
        pair, triple = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        pair[1:] = mix(mix(self.tokens[:-1]) + self.tokens[1:])
        triple[2:] = mix(mix(pair[1:-1]) + self.tokens[2:] + np.uint64(1))
        self.word, self.triple = _key(self.tokens, WORD), _key(triple, TRIPLE)
        self.pair = np.where(self.tokens == END, _key(pair, LAST), _key(pair, PAIR))

    def distinct(self, keys: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sorted distinct keys, how often each occurs in training texts of the block)."""
        u, of = np.unique(keys[keep], return_inverse=True)
        return u, np.bincount(of, self.train[keep], len(u)).astype(np.int64)

    def short(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct words and pairs; ``word_at`` and ``pair_at`` say which of them each token is and ends."""
        has = self.nth >= 1
        u, of = np.unique(np.concatenate([self.word, self.pair[has]]), return_inverse=True)
        self.word_at, self.pair_at = of[: len(has)], np.zeros(len(has), np.int64)
        self.pair_at[has] = of[len(has) :]
        return u, np.bincount(of, np.concatenate([self.train, self.train[has]]), len(u)).astype(np.int64)

    def long(self, n: np.ndarray, state: int) -> np.ndarray:
        """Whether a token ends a triple whose first two words are a state, from the totals of ``short``."""
        out = self.nth >= 2
        before = np.zeros(len(out), np.int64)
        before[2:][out[2:]] = n[self.pair_at[1:-1][out[2:]]]
        return out & (before >= state)


def _digits(notes: pa.Table, kind: int) -> tuple[list[int], list[bytes]]:
    rows = [(d, c) for k, d, c in zip(notes.column("kind").to_pylist(), notes.column("digit").to_pylist(), notes.column("counts").to_pylist(), strict=True) if k == kind]
    return [d for d, _ in rows], [c for _, c in rows]


_NOTE = "block long, kind int, digit int, counts binary, stats array<struct<name:string,bin:int,n:long,total:long>>"
_STAT = "name string, bin int, n long, total long"


def _send_short(tree: Tree):
    """To the tree a block is two children: twice its number sends words, the next pairs, which travel in fewer bytes."""

    def send(key: tuple, texts: pa.Table) -> pa.Table:
        u, n = Grams(texts).short()
        block, word = 2 * key[0].as_py(), _is(u, WORD)
        return pa.concat_tables([tree.block_rows(block, u[word], n[word]), tree.block_rows(block + 1, u[~word], n[~word])])

    return send


def _short_totals(tree: Tree, u: np.ndarray, notes: pa.Table) -> np.ndarray:
    """Totals of a block's words and pairs."""
    word, out = _is(u, WORD), np.zeros(len(u), np.int64)
    out[word] = tree.block_totals(u[word], *_digits(notes, 0))
    out[~word] = tree.block_totals(u[~word], *_digits(notes, 1))
    return out


def _send_long(tree: Tree, long_tree: Tree, state: int):
    def send(key: tuple, texts: pa.Table, notes: pa.Table) -> pa.Table:
        g = Grams(texts)
        u, _ = g.short()
        keep = g.long(_short_totals(tree, u, notes), state)
        return long_tree.block_rows(key[0].as_py(), *g.distinct(g.triple, keep))

    return send


def _stats(tree: Tree, state: int):
    """Of the n-grams of a node: number and sum of counts by class and by size of count, and how many were seen once."""
    end = _key(np.array([END]), WORD)[0]

    def stats(key: tuple, table: pa.Table) -> pa.Table:
        flat = np.concatenate([tree.full(k) for k in table.column("keys").to_pylist()])
        counts = np.concatenate([unpack(c, len(tree.full(k))) for c, k in zip(table.column("counts").to_pylist(), table.column("keys").to_pylist(), strict=True)])
        u, of = np.unique(flat, return_inverse=True)
        n = np.bincount(of, counts, len(u)).astype(np.int64)
        size = np.frexp(n.astype(float))[1]
        rows = []
        for name, which in (("end", u == end), ("word", _is(u, WORD) & (u != end)), ("state", _is(u, PAIR) & (n >= state)), ("pair once", (_is(u, PAIR) | _is(u, LAST)) & (n == 1)), ("triple once", _is(u, TRIPLE) & (n == 1))):
            which &= n > 0
            for b in np.unique(size[which]).tolist():
                hit = which & (size == b)
                rows.append({"name": name, "bin": b, "n": int(hit.sum()), "total": int(n[hit].sum())})
        return pa.Table.from_pylist(rows, pa.schema([("name", pa.string()), ("bin", pa.int32()), ("n", pa.int64()), ("total", pa.int64())]))

    return stats


def prior(sizes: list[tuple[int, int]], once: int) -> float:
    """K for which histories, given as (number, sum of counts) of some sizes, leave ``once`` tokens to shorter ones.

    By bisection between a thousandth and a thousand; without histories it does not matter.
    """
    n = np.array([s[0] for s in sizes], float)
    c = np.array([s[1] for s in sizes], float) / np.maximum(n, 1)
    lo, hi = 1e-3, 1e3
    for _ in range(60):
        k = (lo * hi) ** 0.5
        if float((n * c * k / (c + k)).sum()) < once:
            lo = k
        else:
            hi = k
    return (lo * hi) ** 0.5


class Automaton:
    """States with sorted arcs and failure arcs; words are numbers from 0, state 0 is the root.

    ``c1`` are counts of words, of which ``end`` ends texts, ``p1`` their probabilities; pairs (u, v) and triples (pair, w) come
    with their counts.  ``k2`` and ``k3`` are the weights of what pairs and triples leave to shorter histories.
    """

    def __init__(self, c1: np.ndarray, p1: np.ndarray, end: int, u: np.ndarray, v: np.ndarray, c2: np.ndarray, triples: tuple[np.ndarray, np.ndarray, np.ndarray], k2: float, k3: float, state: int = STATE):
        words = self.words = len(c1)
        self.root = np.log10(p1)
        has = c1 > 0
        has[end] = False
        word_state = np.where(has, np.cumsum(has), 0)
        base = int(has.sum()) + 1
        deep = (c2 >= state) & (v != end)
        pair_state = np.where(deep, base - 1 + np.cumsum(deep), word_state[v] if len(v) else 0)
        self.root_to = word_state
        states = base + int(deep.sum())
        self.fail = np.zeros(states, np.int64)
        self.fail_w = np.zeros(states)
        self.fail_w[word_state[has]] = np.log10(k2 / (c1[has] + k2))
        self.fail[pair_state[deep]] = word_state[v[deep]]
        self.fail_w[pair_state[deep]] = np.log10(k3 / (c2[deep] + k3))
        seen = (c2 > 0) & has[u] if len(u) else np.zeros(0, bool)
        p2 = (c2 + k2 * p1[v]) / (c1[u] + k2) if len(u) else np.zeros(0)
        key2, to2, w2 = word_state[u[seen]] * words + v[seen], pair_state[seen], np.log10(p2[seen]) if seen.any() else np.zeros(0)
        pair, last, c3 = triples
        follows = (c3 > 0) & deep[pair] if len(pair) else np.zeros(0, bool)
        pair, last, c3 = pair[follows], last[follows], c3[follows]
        # P(w | v) and the state of (v, w) of a triple (u, v, w) are those of its second pair
        order = np.argsort(u * words + v, kind="stable")
        second = order[np.searchsorted((u * words + v)[order], v[pair] * words + last)] if len(pair) else np.zeros(0, np.int64)
        key3, to3 = pair_state[pair] * words + last, pair_state[second]
        w3 = np.log10((c3 + k3 * p2[second]) / (c2[pair] + k3)) if len(pair) else np.zeros(0)
        key = np.concatenate([key2, key3]).astype(np.int64)
        by = np.argsort(key, kind="stable")
        self.key = np.append(key[by], np.iinfo(np.int64).max)
        self.to = np.append(np.concatenate([to2, to3])[by], 0).astype(np.int64)
        self.weight = np.append(np.concatenate([w2, w3])[by], 0.0)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next state, log10 probability) of reading one word in each state."""
        state, out, to = state.copy(), np.zeros(len(word)), np.zeros(len(word), np.int64)
        open_ = np.flatnonzero(state > 0)
        while len(open_):
            want = state[open_] * self.words + word[open_]
            at = np.searchsorted(self.key, want)
            hit = self.key[at] == want
            done, arc = open_[hit], at[hit]
            out[done] += self.weight[arc]
            to[done] = self.to[arc]
            state[done] = -1
            open_ = open_[~hit]
            out[open_] += self.fail_w[state[open_]]
            state[open_] = self.fail[state[open_]]
            open_ = open_[state[open_] > 0]
        rest = np.flatnonzero(state == 0)
        out[rest] += self.root[word[rest]]
        to[rest] = self.root_to[word[rest]]
        return to, out

    def walk(self, word: np.ndarray, counts: np.ndarray, stretch: int = STRETCH) -> np.ndarray:
        """Log10 probability of every token of texts laid end to end, each read from the root."""
        out = np.zeros(len(word))
        pieces = -(-counts // stretch)
        text = np.repeat(np.arange(len(counts)), pieces)
        begin = (np.cumsum(counts) - counts)[text]
        start = begin + (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * stretch
        stop = np.minimum(start + stretch, begin + counts[text])
        at = np.maximum(begin, start - 2)  # two words lead to the state
        order = np.argsort(at - stop, kind="stable")  # longest first, so that those still read are a prefix
        at, start, stop = at[order], start[order], stop[order]
        state = np.zeros(len(at), np.int64)
        left = stop - at
        alive = len(at)
        while alive:
            state[:alive], p = self.step(state[:alive], word[at[:alive]])
            mine = at[:alive] >= start[:alive]
            out[at[:alive][mine]] = p[mine]
            at[:alive] += 1
            left[:alive] -= 1
            while alive and left[alive - 1] <= 0:
                alive = int(np.searchsorted(-left[:alive], 0, "left"))
        return out


def _scorer(tree: Tree, long_tree: Tree, state: int, id_type: pa.DataType):
    def score(key: tuple, texts: pa.Table, notes: pa.Table) -> pa.Table:
        g = Grams(texts)
        u, _ = g.short()
        n = _short_totals(tree, u, notes)
        keep = g.long(n, state)
        t, _ = g.distinct(g.triple, keep)
        n3 = long_tree.block_totals(t, *_digits(notes, 2)) if len(t) else np.zeros(0, np.int64)
        found = [s for k, s in zip(notes.column("kind").to_pylist(), notes.column("stats").to_pylist(), strict=True) if k == 3 for s in s or []]
        of = lambda name: [(s["n"], s["total"]) for s in sorted(found, key=lambda s: s["bin"]) if s["name"] == name]
        once = lambda name: sum(x for x, _ in of(name))
        total, distinct = (sum(x[i] for name in ("word", "end") for x in of(name)) for i in (1, 0))
        k2, k3 = prior(of("word"), once("pair once")), prior(of("state"), once("triple once"))
        is_word = _is(u, WORD)
        words, pairs, c1, c2 = u[is_word], u[~is_word], n[is_word], n[~is_word]
        p1 = (c1 + 0.5) / (total + 0.5 * (distinct + 1))
        word_of = (np.cumsum(is_word) - 1)[g.word_at]
        has = np.flatnonzero(g.nth >= 1)
        pair_of = np.zeros(len(g.tokens), np.int64)
        pair_of[has] = (np.cumsum(~is_word) - 1)[g.pair_at[has]]
        first, second = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        first[pair_of[has]], second[pair_of[has]] = word_of[has - 1], word_of[has]
        ends = np.flatnonzero(keep)
        triple_of = np.searchsorted(t, g.triple[ends])
        pair, last = np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)
        pair[triple_of], last[triple_of] = pair_of[ends - 1], word_of[ends]
        end = int(np.searchsorted(words, _key(np.array([END]), WORD)[0]))
        g.pair = g.triple = g.word = g.nth = g.train = g.word_at = g.pair_at = u = n = pairs = pair_of = keep = t = triple_of = ends = has = None  # the automaton needs the room
        if len(g.counts):
            p = Automaton(c1, p1, end, first, second, c2, (pair, last, n3), k2, k3, state).walk(word_of, g.counts)
        else:
            p = np.zeros(0)
        begin = np.cumsum(g.counts) - g.counts
        sum_by = lambda x: np.add.reduceat(x, begin) if len(begin) else np.zeros(0)
        return pa.table({
            "id": texts.column("id").cast(id_type), "held_out": pa.array(~texts.column("train").to_numpy().astype(bool)), "n_tokens": pa.array(g.counts.astype(np.int64)),
            "n_known": pa.array(sum_by((c1[word_of] > 0).astype(np.int64)).astype(np.int64)), "train_tokens": pa.array(np.full(len(g.counts), total, np.int64)),
            "base_score": pa.array(sum_by(np.log10(p1)[word_of])), "score": pa.array(sum_by(p)),
        })

    return score


def _note(df: DataFrame, kind: int | None) -> DataFrame:
    have = {"digit": F.lit(None), "counts": F.lit(None), "stats": F.lit(None)} | {c: F.col(c) for c in df.columns}
    types = {"digit": "int", "counts": "binary", "stats": _NOTE.split("stats ")[1]}
    return df.select(F.col("block").cast("long").alias("block"), (F.col("kind") if kind is None else F.lit(kind)).alias("kind"), *[have[c].cast(k).alias(c) for c, k in types.items()])


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 1, block_bytes: int = BLOCK_BYTES, digit_bits: int = BITS, state: int = STATE) -> DataFrame:
    """Per row: id, ``held_out`` (crc32 of the id's text modulo ``folds`` is ``held_out``), ``n_tokens``,
    ``n_known``, ``train_tokens``, ``base_score`` (words on their own) and ``score`` (the automaton's)."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), text.alias("text"))
    total = rows.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    blocks = max(1, -(-((total[0] or 0) + 64 * total[1]) // block_bytes))
    tree, long_tree = Tree.over(2 * blocks, most=digit_bits), Tree.over(blocks, most=digit_bits)
    fold = F.crc32(F.col("id").cast("string").cast("binary")) % folds
    rows = rows.select("id", "text", F.coalesce(fold != held_out, F.lit(True)).alias("train"), F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).alias("block"))
    texts = rows.repartition(blocks, "block").groupBy("block")
    back, top = totals(tree, texts.applyInArrow(_send_short(tree), UP))
    # the kind of a note: 0 words, 1 pairs, 2 triples, 3 sums over the corpus
    short = _note(back.select(F.expr("grp div 2").alias("block"), F.expr("cast(grp % 2 as int)").alias("kind"), "digit", "counts"), None)
    back, long_top = totals(long_tree, texts.cogroup(short.groupBy("block")).applyInArrow(_send_long(tree, long_tree, state), UP))
    long_ = _note(back.select(F.col("grp").alias("block"), "digit", "counts"), 2)
    parts = [t.groupBy("path", "grp").applyInArrow(_stats(tree, state), _STAT) for t in (top, long_top)]
    sums = parts[0].unionByName(parts[1]).groupBy("name", "bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    stats = sums.agg(F.collect_list(F.struct("name", "bin", "n", "total")).alias("stats"))  # some two hundred sums
    each = _note(spark.range(blocks).select(F.col("id").alias("block")).join(F.broadcast(stats)), 3)  # one row
    kind = docs.schema[id_col].dataType
    out = texts.cogroup(short.unionByName(long_).unionByName(each).groupBy("block")).applyInArrow(
        _scorer(tree, long_tree, state, to_arrow_type(kind)), f"id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return out.withColumnRenamed("id", id_col)
