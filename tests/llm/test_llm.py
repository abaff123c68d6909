"""Corpus operators on small tables with nulls, empty texts, repeated rows, ties and extra columns, against brute force."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from spanforge.llm import bpe, bwt, crf, html, lm, near, qgram, quality, rules, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 97} and{i % 31}" for i in range(600))
TEXTS = {
    0: "The quick brown fox jumps over the lazy dog and runs into the deep dark forest before the night comes over all of us.",
    1: "The quick brown fox jumps over the lazy dog and runs into the deep dark forest before the night comes over all of us.",
    2: None, 3: "", 4: "  \t\n ", 5: "one", 6: "one two", 7: LONG, 8: LONG.replace("word50", "other"), 9: "ONE", 10: "x\ny\nx\n" * 20,
    11: "mail a.b@example.com, call +1 (743) 555-3824 or 10.0.0.255 with 4111 1111 1111 1111 now é 😀 c@d.org",
    12: "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa  b", 13: "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", 14: "!!! ### $$$ %%% &&& " * 12,
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t), "clash") for i, t in TEXTS.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string").cache()


def fold(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_rules(docs):
    got = {r.doc_id: r for r in rules.report(docs, sample_rows=5).collect()}
    for i, t in TEXTS.items():
        w = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = {p for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover))
        g = got[i]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w))
        assert not (g.base_failed and g.kept)
    kept = rules.keep(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, g in got.items() if g.kept}


def test_rule_order_follows_rejection_per_cost(docs):
    seen = {"min_words": (1.0, 0.5), "symbols": (0.1, 0.2), "word_length": (1.0, 0.0), "repeated_words": (9.0, 0.9), "repeated_lines": (1.0, 0.1)}
    assert [r.name for r in rules.plan(docs, known=seen).order] == ["symbols", "min_words", "repeated_lines", "repeated_words", "word_length"]


def test_bpe_equals_tiktoken_and_round_trips(docs):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in bpe.digests(docs, path, P.PATTERN).collect():
        t = TEXTS[r.doc_id] or ""
        ids = enc.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(t.encode()))
    codec = bpe.Codec(bpe.read_ranks(path), P.PATTERN)
    for word in (b"a" * 300, "straße".encode() * 40, bytes(range(33, 120)) * 3):
        assert (codec._long(word), word) == ([int(x) for x in codec._query([word])[0][0].split(b",")], codec._query([word])[0][1])
    back = bpe.decode(bpe.encode(docs, path, P.PATTERN), path, P.PATTERN).collect()
    assert all(bytes(r.bytes).decode() == (r.text or "") for r in back)


def test_sharding(spark, docs):
    many = docs.unionAll(docs.filter("doc_id = 7")).unionAll(docs.filter("doc_id = 7"))
    got = sharding.assign(many, limit=9000).collect()
    assert len(got) == len(TEXTS) + 2
    sums = Counter()
    for r in got:
        sums[r.shard] += r.n_bytes
    assert all(sums[r.shard] == r.shard_bytes and (r.shard_bytes <= 9000) != r.oversized for r in got)
    shards = sorted({r.shard.split("+")[0] for r in got if "+" not in r.shard})
    assert not any(b.startswith(a) for a, b in zip(shards, shards[1:]))
    assert sharding.assign(docs.limit(0)).count() == 0


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(0, "JUMPS over the lazy\ndog and runs into the deep dark forest"), (1, None), (2, ""), (3, "jumps ovr the lazy dog and runs into teh deep dark forest"), (4, "nowhere to be found in any of these texts at all"), (5, "Fox")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in qgram.search(docs, bench).collect()}
    assert set(got) == {(d, i) for d in (0, 1) for i in (0, 3, 5)}
    assert got[0, 0].edits == 0 and TEXTS[0][got[0, 0].start : got[0, 0].end].startswith("jumps over") and 0 < got[0, 3].edits <= 4
    assert {r.doc_id for r in qgram.clean(docs, bench).collect()} == set(TEXTS) - {0, 1}
    assert qgram.search(docs, bench.limit(0)).count() == 0
    blocks = {(r.doc_id, r.item_id) for r in qgram.search(docs, bench, block_bytes=60).collect()}
    assert blocks == set(got)


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, k, percent):
    sets_ = {}
    for i, t in TEXTS.items():
        w = WORD.findall(fold(t))
        sets_[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in TEXTS}
    for a in sorted(TEXTS):
        for b in sorted(TEXTS):
            if a < b and sets_[a] and sets_[b] and 100 * len(sets_[a] & sets_[b]) >= percent * len(sets_[a] | sets_[b]):
                x, y = sorted((root[a], root[b]))
                root = {i: x if r == y else r for i, r in root.items()}
    for r in near.classes(docs, k=k, percent=percent).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets_[r.doc_id]), root[r.doc_id], root[r.doc_id] == r.doc_id)
    assert {r.doc_id for r in near.keep_first(docs, k=k, percent=percent).collect()} == {i for i in TEXTS if root[i] == i}


def test_rows_that_share_an_id_but_not_the_text(spark):
    words = lambda tag, n=60: " ".join(f"{tag}{j}" for j in range(n))
    rows = [
        (1, words("a"), "x"), (2, words("b"), "x"), (2, words("b") + " more", "x"),  # two near texts under one id: one stays
        (5, words("a") + " end", "x"), (5, words("c"), "x"),  # one text repeats document 1, the other is unique
        (6, words("c") + " end", "x"),  # linked with the second text of 5, not with its first
        (7, words("d"), "q"), (7, words("d"), "p"), (8, None, "x"), (8, "", "x"), (8, "", "x"), (None, words("a"), "x"), (None, words("a"), "x"),
    ]
    t = spark.createDataFrame(rows, "doc_id long, text string, extra string")
    want = [r for i, r in enumerate(rows) if i in (0, 4, 7, 8, 9, 11, 12)]
    for parts in (1, 5):
        got = [tuple(r) for r in near.keep_first(t.repartition(parts)).collect()]
        twins = [r for r in got if r[0] == 2]
        assert len(twins) == 1 and twins[0] in rows
        assert sorted((r for r in got if r[0] != 2), key=str) == sorted(want, key=str)
        again = twins if parts == 1 else again
        assert twins == again
    by = {(r.doc_id, r.component_id) for r in near.classes(t).collect()}
    assert by == {(1, 1), (2, 2), (5, 1), (5, 5), (6, 5), (7, 7), (8, 8), (None, None)}


@pytest.mark.parametrize("percent, bands", [(85, 16), (80, 23)])
def test_bands_follow_the_threshold(docs, percent, bands):
    x = percent / 100
    r = near.prepare(docs.filter("doc_id = 0"), "doc_id", "text", 5, near.how_many(x)).first()
    assert len(r.bands) == near.how_many(x) == bands and (1 - x**near.ROWS) ** len(r.bands) <= 7.5e-6
    # sets at the threshold, from simulated samples: near.bands misses far fewer than 16 bands at 0.8 do (2.2e-4)
    rng = np.random.default_rng(5)
    a = rng.integers(1, 1 << 62, (100_000, near.SAMPLES)).astype(np.uint64)
    b = np.where(rng.random(a.shape) < x, a, a + np.uint64(1))
    assert (~(near.bands(a, bands) == near.bands(b, bands)).any(1)).sum() <= 5


def test_personal_data(docs):
    got = {r.doc_id: r for r in crf.report(docs).collect()}
    r = got[11]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (2, 1, 1, 1)
    t = TEXTS[11]
    for kind, value in (("email", "a.b@example.com"), ("phone", "+1 (743) 555-3824"), ("ip", "10.0.0.255"), ("card", "4111 1111 1111 1111"), ("email", "c@d.org")):
        assert f"{kind}:{t.index(value)}:{t.index(value) + len(value)}" in r.spans.split(",")
    assert all(x.spans == "" and x.base_sha256 == hashlib.sha256(b"").hexdigest() for i, x in got.items() if i in (0, 2, 3, 4, 7))
    clean = {x.doc_id: x.text for x in crf.redact(docs).collect()}
    assert clean[2] is None and clean[0] == TEXTS[0] and clean[11].startswith("mail <EMAIL>, call <PHONE> or <IP> with <CARD> now é 😀 <EMAIL>")


def test_crf_held_out_accuracy():
    weights, tr = crf.model()
    hit = every = 0
    from spanforge.llm.textnp import Words, raw
    import pyarrow as pa

    for words, labels in crf.training_table(200, seed=99):
        y = crf.decode(Words(*raw(pa.array([" ".join(words)])), fold=False), weights, tr)
        hit += sum(crf.LABELS[a] == b for a, b in zip(y, labels, strict=True))
        every += len(labels)
    assert hit / every > 0.95


def test_viterbi_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    tr = rng.normal(size=(3, 3))
    first = np.array([0, 4, 5, 8])
    e = rng.normal(size=(8, 3))
    got = crf.viterbi(e, tr, first)
    for a, b in zip(first[:-1], first[1:]):
        score = lambda y: sum(e[a + i, k] for i, k in enumerate(y)) + sum(tr[p, q] for p, q in zip(y, y[1:]))  # noqa: E731, B023
        assert tuple(got[a:b]) == max(product(range(3), repeat=int(b - a)), key=score)


def test_suffix_dedup(docs):
    seen, want = {}, {}
    for i in sorted(TEXTS):
        b = (TEXTS[i] or "").encode()
        gone = np.zeros(len(b), bool)
        own = [b[k : k + 50] for k in range(len(b) - 49)]
        for k, g in enumerate(own):
            if g in seen:
                gone[k : k + 50] = True
        for g in own:
            seen.setdefault(g, i)
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        want[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    for r in bwt.dedup(docs, block_bytes=3000).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]


def test_merge_of_transforms_orders_suffixes():
    rng = np.random.default_rng(3)
    shards = [np.append(rng.integers(1, 4, 200), 0).astype(np.uint16) for _ in range(4)]
    place, interval = bwt.merge(shards, 8)
    text = np.concatenate(shards)
    whole = [(tuple(text[p : p + 8]), g) for p, g in zip(place, interval) if 0 not in text[p : p + 8] and p + 8 <= len(text)]
    assert [w for w, _ in whole] == sorted(w for w, _ in whole)
    assert len({w for w, _ in whole}) == len({g for _, g in whole})


def test_html(spark):
    body = " ".join(f"word{i}" for i in range(60))
    page = f"<html><head><title>t</title></head><body><nav><ul><li><a href=x>menu</a></ul></nav><article><h1>Head</h1><p>{body} &amp; <b>bo</b>ld<div class=ad>buy now</div><p>x < y</p></article><div class='comments'><p>{'bad ' * 40}</p></div><footer>f</footer>"
    rows = spark.createDataFrame([(0, "u", page, 1), (1, None, None, 1), (2, "u", "", 1), (3, "u", "<p", 1)], "page_id long, url string, html string, extra int")
    got = {r.page_id: r.text for r in html.extract(rows).collect()}
    assert got == {0: f"Head {body} & bold x < y", 1: "", 2: "", 3: ""}


def test_quality(spark, docs):
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (7, 1, 0), (8, 1, 1), (14, 0, 0), (10, 0, 0), (10, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == len(TEXTS) and all(0 <= r.quality <= 1 for r in got.values())
    assert got[0].quality > got[14].quality
    assert all(r.kept for r in quality.classify(docs, labels.limit(0)).collect())
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert quality.pseudo(None, 0, None, 0.5) == 10.0


def test_empty_tables(docs):
    none = docs.limit(0)
    for f in (rules.report, lm.score, near.classes, crf.report, bwt.dedup):
        assert f(none).count() == 0


def test_pipeline_stages_keep_columns(spark, docs, tmp_path):
    import corpus_pipeline

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "nothing of the kind occurs here at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    one = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in one} == {0, 7}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_pipeline_rows_equal_brute_force(spark, tmp_path):
    import tiktoken

    import corpus_pipeline

    def kept_by_rules(t):
        w = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = {p for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        chars = sum(map(len, w))
        symbols = len(re.findall(r"[#*$%&|<>]", t or ""))
        return len(w) >= 20 and 100 * len(cover) <= 30 * len(w) and 2 * len(w) <= chars <= 25 * len(w) and 2 * symbols <= len(w) and 2 * (len(lines) - len(set(lines))) <= len(lines)

    def shingles(t):
        w = WORD.findall(fold(t))
        return {tuple(w[j : j + 5]) for j in range(len(w) - 4)}

    private = {"a.b@example.com": "<EMAIL>", "+1 (743) 555-3824": "<PHONE>", "10.0.0.255": "<IP>", "4111 1111 1111 1111": "<CARD>"}
    item = "seven green boats were pulled over the frozen river by patient old horses"
    tail = " Write to a.b@example.com, call +1 (743) 555-3824, or look at 10.0.0.255 with 4111 1111 1111 1111 at hand 😀 é."
    texts = TEXTS | {20: TEXTS[0] + tail, 21: LONG.replace("word", "wall") + tail, 22: LONG.replace("word", "tree") + " Seven green BOATS were\npulled over the frozen river by patient old horses."}
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = {i: t for i, t in texts.items() if kept_by_rules(t)}
    root = {i: i for i in left}
    for a in sorted(left):
        for b in sorted(left):
            x, y = shingles(left[a]), shingles(left[b])
            if a < b and 100 * len(x & y) >= 80 * len(x | y):
                lo, hi = sorted((root[a], root[b]))
                root = {i: lo if r == hi else r for i, r in root.items()}
    left = {i: t for i, t in left.items() if root[i] == i and item not in " ".join(fold(t).split())}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {}
    for i, t in left.items():
        for value, mark in private.items():
            t = t.replace(value, mark)
        ids = enc.encode_ordinary(t)
        want[i] = (len(ids), sha(",".join(map(str, ids)).encode()), sha(t.encode()))
    assert {0, 20, 21} <= set(want) and 22 not in want
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == want
