"""Sharding, near duplicates and site posteriors against their definitions, with hot keys, repeated rows and null ids."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spanforge.llm import near, quality, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_written_shards_hold_every_row_once(spark, tmp_path):
    rows = [(i, "x" * (37 * i % 300), i % 3) for i in range(60)] + [(7, "y" * 90, k) for k in range(6)] + [(None, "z" * 50, 1), (None, "z" * 50, 1), (8, None, 5), (9, "w" * 2000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    sharding.write_shards(docs, str(tmp_path / "out"), limit=400)
    back = spark.read.parquet(str(tmp_path / "out"))
    key = lambda r: str(r)
    assert sorted([(r.doc_id, r.text, r.shard) for r in back.collect()], key=key) == sorted(rows, key=key)
    size = back.groupBy("_shard").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("n"), F.count("*").alias("rows")).collect()
    assert all(r.n <= 400 or r.rows == 1 for r in size)


def shingles(t, k):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_classes(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    where = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    shared = Counter((a, b) for ids in where.values() for n, a in enumerate(ids) for b in ids[n + 1 :])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = 0
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            links += 1
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}, links


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_of_a_whole_table(spark, k, percent):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    rng = random.Random(k)
    for i, t in rows[:300:20]:  # a hot group of near copies of each of some texts, besides those of the table
        w = (t or "").split()
        for c in range(12):
            v = list(w)
            for _ in range(max(1, len(v) // 80)):
                if v:
                    v[rng.randrange(len(v))] = f"new{rng.randrange(9)}"
            rows.append((100_000 + 100 * i + c, " ".join(v)))
    want, links = brute_classes(rows, k, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.classes(spark.createDataFrame(rows, "doc_id long, text string"), k=k, percent=percent).collect()}
    assert links > 300 and got == want


def test_blocks_of_large_buckets_see_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near, "_SCAN", 7)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(40):
        w = list(base)
        for p in rng.sample(range(120), rng.randint(0, 6)):
            w[p] = f"v{rng.randrange(3)}"
        rows.append((i, " ".join(w)))
    want, _ = brute_classes(rows, 3, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.classes(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=85).collect()}
    assert got == want


@pytest.mark.parametrize("most", [100_000, 0])
def test_site_posteriors_follow_the_formula(spark, monkeypatch, most):
    monkeypatch.setattr(quality, "MAX_SITES", most)
    rng = random.Random(6)
    words = {1: ["kind", "clear", "river", "garden", "letter"], 0: ["xx", "$$$", "buy", "zzz", "###"]}
    rows = [(i, " ".join(rng.choice(words[rng.random() < (0.9 if i % 3 else 0.2)]) for _ in range(20)), "hot" if i % 3 else f"s{i % 5}", "en" if i % 2 else "de") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 90
    n, s = Counter(), Counter()
    for r in got:
        for site in ((), (r.host,), (r.host, r.path)):
            n[site] += 1
            s[site] += r.doc_score
    m = min(0.999, max(0.001, s[()] / n[()]))
    hosts, paths = [k for k in n if len(k) == 1], [k for k in n if len(k) == 2]
    a = quality.pseudo(90, len(hosts), sum(n[h] * (s[h] / n[h] - m) ** 2 for h in hosts), m)
    host = {h: (s[h] + a * m) / (n[h] + a) for h in hosts}
    b = quality.pseudo(90, len(paths), sum(n[p] * (s[p] / n[p] - host[p[:1]]) ** 2 for p in paths), m)
    for r in got:
        p = (r.host, r.path)
        assert r.host_score == pytest.approx(host[p[:1]]) and r.path_score == pytest.approx((s[p] + b * host[p[:1]]) / (n[p] + b))
        prior = min(0.999, max(0.001, (s[p] - r.doc_score + b * host[p[:1]]) / (n[p] - 1 + b)))
        logit = math.log(r.doc_score / (1 - r.doc_score)) + math.log(prior / (1 - prior)) - math.log(m / (1 - m))
        assert r.quality == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-6)
