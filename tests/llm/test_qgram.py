"""Decontamination against edit distances by brute force, and places of repeated items."""

import random

import numpy as np
import pytest

from spanforge.llm import qgram


def fewest_edits(item, text):
    """Least edit distance of the item to any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(rng, text, n):
    t = list(text)
    for _ in range(n):
        p, kind = rng.randrange(len(t)), rng.random()
        if kind < 0.4:
            t[p] = rng.choice("abcdefgh ")
        elif kind < 0.7:
            del t[p]
        else:
            t.insert(p, rng.choice("abcdefgh "))
    return "".join(t)


def test_documents_found_are_those_within_the_budget(spark):
    rng = random.Random(11)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))
    items = {i: say(rng.randint(4, 18)) for i in range(12)}
    docs = {}
    for d in range(60):
        item = items[d % 12]
        docs[d] = f"{say(rng.randint(0, 12))} {edited(rng, item, rng.randint(0, len(item) // 6))} {say(rng.randint(0, 12))}".upper() if d % 5 else say(30)
    want = {}
    for d, t in docs.items():
        for i, item in items.items():
            m = len(item)
            k, e = min(int(m * qgram.EDIT_RATE), (m - 8) // 8), fewest_edits(item, t.lower())
            if e <= k:
                want[d, i] = e
    x = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = qgram.search(x, b).collect()
    got = {}
    for r in found:
        got[r.doc_id, r.item_id] = min(r.edits, got.get((r.doc_id, r.item_id), 99))
    assert len(want) > 20 and got == want
    for r in found:
        assert fewest_edits(items[r.item_id], docs[r.doc_id].lower()[r.start : r.end]) == r.edits
    assert {r.doc_id for r in qgram.clean(x, b).collect()} == set(docs) - {d for d, _ in want}


@pytest.mark.parametrize("text", ["ab ab ab ab ab ab ab ab ab ab ab ab", "ab ab ab ab ab ab ab ab ab ab"])
def test_all_places_of_an_item(text):
    item = np.frombuffer(b"ab ab ab ab ab", np.uint8)
    whole = np.frombuffer(f"{text}, then {text}".encode(), np.uint8)
    got = qgram.occurrences(item, whole, -2, len(whole), 0)
    assert [bytes(whole[a:b]) for _, a, b in got] == [bytes(item)] * len(got) and len(got) == 2 * ((len(text) + 1) // 15)
    assert all(x[2] <= y[1] for x, y in zip(got, got[1:]))
    assert qgram.literal(b"aa", b"aaaa baa") == [(0, 0, 2), (0, 2, 4), (0, 6, 8)]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "some benchmark passage of words here", 1), (None, None, 1), (3, "", 1), (4, "x" * 1_500_000 + " some benchmark passage of words here", 1)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(7, "Some benchmark\tpassage of words here"), (None, "x"), (8, None), (7, "Some benchmark\tpassage of words here")], "item_id long, text string")
    assert sorted((-1 if r[0] is None else r[0], r.start) for r in qgram.search(docs.drop("item_id"), bench).collect()) == [(-1, 0), (4, 1_500_001)]
    assert {r.doc_id for r in qgram.clean(docs, bench).collect()} == {None, 3} and qgram.clean(docs, bench).columns == docs.columns
    assert qgram.search(docs.drop("item_id").limit(0), bench).count() == 0 and qgram.clean(docs, bench.limit(0)).count() == 4
