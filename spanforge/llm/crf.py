"""Personal data by regular base rules and a linear-chain conditional random field.

The base rules find e-mail addresses, dotted quads, card and phone numbers.  A CRF over word-shape
features, trained on a small labelled table by maximising the conditional likelihood, labels every
word; Viterbi runs in numpy over all sequences of a slice at once.  Words whose emission for
"outside" beats every other label by more than any two transitions can gain are certainly outside,
so sequences are cut there: the best path is the same, and only short stretches are left to decode.
CRF spans are added where no base span lies.  Rows are handled one by one: no shuffle.

Defined results: a null text is an empty one; an empty text has no spans; very long texts take time
in proportion to their length (no pattern is tried again inside a run that it failed on).
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textnp import Words, column, raw, slices

LABELS = ("o", "email", "ip", "card", "phone", "secret", "iban", "ssn")
BASE = ("email", "ip", "card", "phone")

_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    """Whether a string of ASCII digits passes the Luhn check."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base rules, leftmost and non-overlapping per kind, sorted."""
    out = []
    at = text.find("@")
    last = 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, 0, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)
    if _DIGIT.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                    out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


# --- features -------------------------------------------------------------------------------
_CLASS = np.full(256, 7, np.uint8)
for _c in range(256):
    if 48 <= _c < 58:
        _CLASS[_c] = 0
    elif 97 <= _c < 123 or _c >= 128:
        _CLASS[_c] = 2 if not 97 <= _c < 103 else 1
    elif 65 <= _c < 91:
        _CLASS[_c] = 3
for _k, _v in {"@": 4, ".": 5, "-": 6, "+": 6, "(": 6, ")": 6}.items():
    _CLASS[ord(_k)] = _v
#: Sizes of the feature families: make-up, length by digits, dots and dashes by digits, make-up of both neighbours.
SIZES = (256, 64, 64, 256, 256)
N_FEATURES = sum(SIZES)


def features(w: Words) -> np.ndarray:
    """For each word five feature numbers: its make-up, counts, and the make-up of its neighbours in the text."""
    n = len(w.start)
    if not n:
        return np.zeros((0, 5), np.int32)
    code = _CLASS[w.data]
    counts = np.empty((8, n), np.int32)
    for k in range(8):
        total = np.zeros(len(code) + 1, np.int32)
        np.cumsum(code == k, out=total[1:])
        counts[k] = total[w.end] - total[w.start]
    digit, hexa, lower, upper, at, dot, dash, other = counts
    length = (w.end - w.start).astype(np.int32)
    make = ((digit > 0) | (hexa > 0) << 1 | (lower > 0) << 2 | (upper > 0) << 3 | (at > 0) << 4 | (dot > 0) << 5 | (dash > 0) << 6 | (other > 0) << 7).astype(np.int32)
    size = np.searchsorted([3, 5, 8, 12, 16, 24, 32], length, "right").astype(np.int32)
    many = np.searchsorted([1, 2, 4, 7, 9, 10, 14], digit, "right").astype(np.int32)
    marks = np.minimum(dot, 3) + 4 * (np.minimum(dash, 1) + 0)
    out = np.empty((n, 5), np.int32)
    out[:, 0] = make
    out[:, 1] = 256 + size * 8 + many
    out[:, 2] = 320 + marks * 8 + many
    before, after = np.zeros(n, np.int32), np.zeros(n, np.int32)
    before[1:] = np.where(w.doc[1:] == w.doc[:-1], make[:-1], 0)
    after[:-1] = np.where(w.doc[1:] == w.doc[:-1], make[1:], 0)
    out[:, 3] = 384 + before
    out[:, 4] = 640 + after
    return out


# --- training -------------------------------------------------------------------------------
def training_table(n: int = 600, seed: int = 5) -> list[tuple[list[str], list[str]]]:
    """A small labelled table: sequences of words, each word with a label."""
    rng = random.Random(seed)
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve él ñó ung ät".split()
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def marks() -> str:
        """A run of any one mark, as texts from the web have behind words."""
        return rng.choice("!?;:,.#*&%$|~=+_)]}>") * rng.randint(1, 4)

    def word() -> str:
        w = "".join(rng.choice(syllables) for _ in range(rng.randint(1, 6)))
        if rng.random() < 0.15:
            w = w.capitalize()
        elif rng.random() < 0.05:
            w = w.upper()
        return w + (marks() if rng.random() < 0.3 else rng.choice(["", "", "", ",", ".", "!"]))

    def plain() -> list[str]:
        kind = rng.random()
        if kind < 0.8:
            return [word()]
        return [rng.choice([digits(rng.randint(1, 4)), f"{digits(2)}.{digits(2)}", f"{digits(2)}/{digits(2)}/20{digits(2)}", f"20{digits(2)}-{digits(2)}-{digits(2)}", f"{digits(1)},{digits(3)},{digits(3)}", f"v{digits(1)}.{digits(1)}.{digits(1)}", f"{digits(2)}%", f"${digits(3)}", word() + digits(2), "=", "-", f"{word()}-{word()}", f"{digits(2)}:{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(1)}", f"{digits(1)}.{digits(1)}", f"{digits(1)}.{digits(1)}.", f"{digits(1)}.", digits(1) + marks(), f"{digits(2)}.{digits(1)},", f"{digits(3)}.", "(" + word() + ")", f"@{word()}", f"https://{word()}.com/{word()}"])]

    def datum() -> tuple[list[str], str]:
        end = marks() if rng.random() < 0.3 else rng.choice(["", "", ".", ","])
        name = lambda: "".join(rng.choice(syllables[:20]) for _ in range(2))
        kind = rng.choice(LABELS[1:])
        if kind == "email":
            return [f"{name()}{rng.choice(['.', '_', ''])}{digits(rng.randint(0, 3))}@{name()}{digits(rng.randint(0, 1))}.{rng.choice(['com', 'org', 'example.com', 'co.uk'])}{end}"], kind
        if kind == "ip":
            return [".".join(str(rng.randint(0, 255)) for _ in range(4)) + end], kind
        if kind == "card":
            d = digits(16)
            return ([d + end] if rng.random() < 0.5 else rng.choice([[d[:4], d[4:8], d[8:12], d[12:] + end], [f"{d[:4]}-{d[4:8]}-{d[8:12]}-{d[12:]}{end}"]])), kind
        if kind == "phone":
            a, b, c = digits(3), digits(3), digits(4)
            return rng.choice([["+1", f"({a})", f"{b}-{c}{end}"], [f"({a})", f"{b}-{c}{end}"], [f"{a}-{b}-{c}{end}"], [f"+{digits(2)}", a, b, c + end], [f"+{digits(1)}-{a}-{b}-{c}{end}"], [f"+{digits(11)}{end}"]]), kind
        if kind == "ssn":
            return [f"{digits(3)}-{digits(2)}-{digits(4)}{end}"], kind
        if kind == "iban":
            return [rng.choice(["DE", "FR", "ES", "GB"]) + digits(rng.choice([18, 20, 22, 24])) + end], kind
        k = rng.choice([32, 40, 40, 64])
        key = "".join(rng.choice("0123456789abcdef") for _ in range(k))
        return [rng.choice([f'"{key}"', key, f'"{key}"', f"AKIA{''.join(rng.choice('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') for _ in range(16))}", "sk-" + "".join(rng.choice("abcdefghijkABCDEFGHIJK0123456789") for _ in range(32))]) + end], "secret"

    out = []
    for _ in range(n):
        words: list[str] = []
        labels: list[str] = []
        for _ in range(rng.randint(1, 3)):
            for _ in range(rng.randint(0, 4)):
                got = plain()
                words += got
                labels += ["o"] * len(got)
            if rng.random() < 0.6:
                got, kind = datum()
                if kind == "secret" and rng.random() < 0.6:
                    words += ["token", "="]
                    labels += ["o", "o"]
                words += got
                labels += [kind] * len(got)
        out.append((words or ["the"], labels or ["o"]))
    return out


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


def _pack(table: list[tuple[list[str], list[str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    text = [" ".join(words) for words, _ in table]
    w = Words(*raw(pa.array(text)), fold=False)
    f, count = features(w), np.diff(w.first)
    x = np.zeros((len(table), int(count.max()), 5), np.int32)
    y = np.zeros(x.shape[:2], np.int32)
    for i, (_, labels) in enumerate(table):
        x[i, : count[i]] = f[w.first[i] : w.first[i + 1]]
        y[i, : count[i]] = [LABELS.index(k) for k in labels]
    return x, y, count


def train(table: list[tuple[list[str], list[str]]], rounds: int = 80, l2: float = 0.02, rate: float = 0.15) -> tuple[np.ndarray, np.ndarray]:
    """(emission weights, transition weights) by full-batch Adam on the penalised log likelihood."""
    x, y, count = _pack(table)
    n, t = y.shape
    k = len(LABELS)
    live = np.arange(t)[None, :] < count[:, None]
    params = np.zeros(N_FEATURES * k + k * k)
    m, v = np.zeros_like(params), np.zeros_like(params)
    flat = x[live]
    gold = np.zeros((N_FEATURES, k))
    for j in range(5):
        np.add.at(gold, (flat[:, j], y[live]), 1)
    gold_t = np.zeros((k, k))
    both = live[:, 1:]
    np.add.at(gold_t, (y[:, :-1][both], y[:, 1:][both]), 1)
    for step in range(1, rounds + 1):
        w, tr = params[: N_FEATURES * k].reshape(-1, k), params[N_FEATURES * k :].reshape(k, k)
        e = w[x].sum(2)
        alpha, beta = np.empty((n, t, k)), np.zeros((n, t, k))
        alpha[:, 0] = e[:, 0]
        for i in range(1, t):
            nxt = _logsumexp(alpha[:, i - 1, :, None] + tr[None], 1) + e[:, i]
            alpha[:, i] = np.where(live[:, i, None], nxt, alpha[:, i - 1])
        for i in range(t - 2, -1, -1):
            prev = _logsumexp(tr[None] + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
            beta[:, i] = np.where(live[:, i + 1, None], prev, 0)
        z = _logsumexp(alpha[:, -1], 1)
        node = np.exp(alpha + beta - z[:, None, None])
        grad_w = gold.copy()
        for j in range(5):
            np.add.at(grad_w, flat[:, j], -node[live])
        edge = np.exp(alpha[:, :-1, :, None] + tr[None, None] + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])
        grad = np.concatenate([grad_w.ravel(), (gold_t - edge[both].sum(0)).ravel()]) - l2 * params
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return params[: N_FEATURES * k].reshape(-1, k).copy(), params[N_FEATURES * k :].reshape(k, k).copy()


@cache
def model() -> tuple[np.ndarray, np.ndarray]:
    """The model of ``training_table``; the same in every process."""
    return train(training_table())


# --- decoding -------------------------------------------------------------------------------
def viterbi(e: np.ndarray, tr: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Best labels of sequences laid end to end; ``first`` has their starts and the total."""
    lens = np.diff(first)
    out = np.zeros(len(e), np.int64)
    if not len(e):
        return out
    order = np.argsort(-lens, kind="stable")
    begin, lens = first[:-1][order], lens[order]
    longest = int(lens[0])
    alive = np.searchsorted(-lens, -np.arange(1, longest + 1), "right")  # sequences of at least so many words
    score = e[begin[: alive[0]]].copy()
    back = np.zeros((len(e), e.shape[1]), np.int8)
    final = score.copy()
    for i in range(1, longest):
        a = alive[i]
        s = score[:a, :, None] + tr[None]
        at = begin[:a] + i
        back[at] = s.argmax(1)
        score = s.max(1) + e[at]
        final[:a] = score
    label = final.argmax(1)
    for i in range(longest - 1, -1, -1):
        a = alive[i]
        at = begin[:a] + i
        # a sequence whose last word this is starts from its final label
        out[at] = label[:a]
        if i:
            label[:a] = back[at, label[:a]]
    return out


def decode(w: Words, weights: np.ndarray, tr: np.ndarray) -> np.ndarray:
    """Label of every word.  Sequences are cut at words that are certainly outside."""
    f = features(w)
    e = weights[f[:, 0]]
    for j in range(1, 5):
        e = e + weights[f[:, j]]
    n = len(e)
    out = np.zeros(n, np.int64)
    if not n:
        return out
    gain = 2 * (tr.max() - tr.min())
    open_ = ~(e[:, 0] - e[:, 1:].max(1) > gain)
    if not open_.any():
        return out
    # keep each open word and, for their transitions, the certain words at both sides
    keep = open_.copy()
    same = w.doc[1:] == w.doc[:-1]
    keep[:-1] |= open_[1:] & same
    keep[1:] |= open_[:-1] & same
    at = np.flatnonzero(keep)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (w.doc[at[1:]] != w.doc[at[:-1]])
    first = np.append(np.flatnonzero(new), len(at))
    out[at] = viterbi(e[at], tr, first)
    return out


_TRIM = frozenset(b"\"'.,;:!?#*$%&|<>=[]{}")


def crf_spans(w: Words, weights: np.ndarray, tr: np.ndarray) -> list[tuple[int, int, str, int]]:
    """(row, start byte, kind, end byte) of runs of equally labelled words, punctuation at the edges trimmed."""
    label = decode(w, weights, tr)
    at = np.flatnonzero(label)
    out = []
    i = 0
    while i < len(at):
        j = i
        while j + 1 < len(at) and at[j + 1] == at[j] + 1 and label[at[j + 1]] == label[at[i]] and w.doc[at[j + 1]] == w.doc[at[i]]:
            j += 1
        a, b = int(w.start[at[i]]), int(w.end[at[j]])
        while a < b and w.data[a] in _TRIM:
            a += 1
        while b > a and w.data[b - 1] in _TRIM:
            b -= 1
        if b > a:
            row = int(w.doc[at[i]])
            out.append((row, a - int(w.offsets[row]), LABELS[label[at[i]]], b - int(w.offsets[row])))
        i = j + 1
    return out


def find(arr: pa.Array, weights: np.ndarray, tr: np.ndarray) -> Iterator[tuple[str, list[tuple[int, int, int]], list[tuple[int, str, int]]]]:
    """For each text: (text, base spans, all spans as (start, kind, end)), in code points."""
    data, offsets = raw(arr)
    w = Words(data, offsets, fold=False)
    more: dict[int, list[tuple[int, str, int]]] = {}
    for row, a, kind, b in crf_spans(w, weights, tr):
        more.setdefault(row, []).append((a, kind, b))
    rank = {k: i for i, k in enumerate(LABELS[1:])}
    for row, text in enumerate(arr.to_pylist()):
        base = base_spans(text)
        spans = [(a, BASE[k], b) for a, k, b in base]
        if row in more:
            body = data[offsets[row] : offsets[row + 1]]
            points = np.zeros(len(body) + 1, np.int64)
            np.cumsum((body & 0xC0) != 0x80, out=points[1:])
            for a, kind, b in more[row]:
                p, q = int(points[a]), int(points[b])
                if not any(x < q and p < y for x, _, y in base):
                    spans.append((p, kind, q))
            spans.sort(key=lambda s: (s[0], rank[s[1]], s[2]))
        yield text, base, spans


def _spell(spans) -> str:
    return ",".join([f"{k}:{a}:{b}" for a, k, b in spans])


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts of base spans by kind, ``base_sha256`` and ``spans`` (``kind:start:end``, comma-joined)."""
    weights, tr = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            counts = np.zeros((batch.num_rows, 4), np.int64)
            digest, spans = [], []
            for i, (_, base, every) in enumerate(find(column(batch, "text"), weights, tr)):
                for _, k, _ in base:
                    counts[i, k] += 1
                digest.append(hashlib.sha256(_spell((a, BASE[k], b) for a, k, b in base).encode()).hexdigest())
                spans.append(_spell(every))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[:, k]) for k in range(4)), pa.array(digest, pa.string()), pa.array(spans, pa.string())], ["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    return out.withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of its text replaced by ``<KIND>``; overlapping spans become one, named by the first.

    A null text stays null; all other columns stay as they are.
    """
    weights, tr = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 1 << 20):
            at = batch.schema.get_field_index(text_col)
            out: list[str | None] = []
            for text, _, spans in find(column(batch, text_col), weights, tr):
                parts, end = [], 0
                for a, kind, b in spans:
                    if a >= end:
                        parts += [text[end:a], f"<{kind.upper()}>"]
                    end = max(end, b)
                out.append("".join([*parts, text[end:]]) if parts else text)
            null = batch.column(at).is_null().to_pylist()
            arrays = [*batch.columns]
            arrays[at] = pa.array([None if gone else t for t, gone in zip(out, null, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
