import random

import pytest
from pyspark.sql import functions as F

from spanforge.functions import labels as L
from spanforge.functions import spans as S
from spanforge.operators import intervals as I
from spanforge.operators import scoring as Q
from spanforge.operators import sequential as seq
from spanforge.sources import files
from spanforge.streaming import detect


def frame(spark, rows, schema="doc_id long, start int, end int, label string, confidence double, layer_rank int, seq int"):
    return spark.createDataFrame(rows, schema)


def test_offsets_count_code_points(spark):
    docs = spark.createDataFrame([(0, "a@b.co 😀é x.y@z.org"), (1, "none"), (2, None)], "doc_id long, text string")
    got = S.spans(docs, [S.EMAIL]).orderBy("seq").collect()
    assert [(r.start, r.end, r.value) for r in got] == [(0, 6, "a@b.co"), (10, 19, "x.y@z.org")]


@pytest.mark.parametrize("text, name, value", [
    ("31.12.2024 99.99.9999", "numeric_date", ["31.12.2024"]), ("at 2024-01-31T10:00", "numeric_date", ["2024-01-31T10:00"]), ("00:12:45", "numeric_date", []),
    ("7722-4455-8811", "grouped_id", ["7722-4455-8811"]), ("last Friday, 3 weeks ago", "en_date", ["last Friday", "3 weeks ago"]), ("ИНН: 123456789012", "inn", ["123456789012"]),
    ("Анна Петровна пришла", "patronymic", ["Петровна"]), ("Кирпич", "patronymic", []), ("12 марта", "ru_date", ["12 марта"]), ("под новый год", "ru_date", []), ("see t.me/abc @name", "handle", ["t.me/abc", "@name"]),
    ("третьего февраля", "ru_date", ["третьего февраля"]), ("two weeks ago", "en_date", ["two weeks ago"]), ("1234\t5678\t9012", "grouped_id", ["1234\t5678\t9012"]), ("+7 (912) 345-67-89", "phone_ru", ["+7 (912) 345-67-89"]),
])
def test_detectors(spark, text, name, value):
    docs = spark.createDataFrame([(0, text)], "doc_id long, text string")
    got = S.spans(docs, [S.DETECTORS[name]]).orderBy("seq").collect()
    assert [r.value for r in got] == value and all(text[r.start : r.end] == r.value for r in got)


def test_ages(spark):
    texts = {0: "мне сорок один", 1: "ему 7 лет назад", 2: "возраст: уже 33", 3: "сорок пять лет мужику", 4: "двадцать лет вместе", 5: "дал ей один проект", 6: "мне 34 года", 7: "возраст 50 лет женщине"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = S.first_of_each(S.spans(docs, S.AGES)).collect()
    assert sorted((r.doc_id, r.value) for r in got) == [(0, "сорок один"), (1, "7"), (2, "33"), (3, "сорок пять"), (6, "34"), (7, "50")]
    assert all(texts[r.doc_id][r.start : r.end] == r.value for r in got)


def test_one_scan_of_the_documents(spark):
    from spanforge.plans import catalog

    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")
    for name in ("coverage_relaxed", "entity_recall", "worst_case_leak", "fleiss_kappa", "macro_metrics", "nonpii_preservation"):
        assert scans(catalog.queries()[name](spark, "/root/testdata/sf0.001")) <= 2, name


def test_merge_rules(spark):
    touch = frame(spark, [(0, 0, 5, "A", 1.0, 0, 0), (0, 3, 9, "B", 1.0, 0, 1), (0, 9, 12, "C", 1.0, 0, 2)])
    assert sorted((r.start, r.end) for r in I.masks(touch, ["doc_id"]).collect()) == [(0, 9), (9, 12)]
    long_ = frame(spark, [(0, 0, 4, "A", 1.0, 0, 0), (0, 2, 9, "B", 1.0, 0, 1)])
    r = I.longest_label(long_, ["doc_id"], "label").first()
    assert (r.start, r.end, r.canon, r.canons) == (0, 9, "B", ["A", "B"])
    conf = frame(spark, [(0, 0, 4, "A", 0.85, 0, 0), (0, 2, 5, "B", 0.9, 0, 1), (0, 3, 6, "C", 0.88, 0, 2)])
    assert I.confident_label(conf, ["doc_id"]).first().label == "C"


def test_masks_are_disjoint_and_cover_the_same_characters(spark):
    rng = random.Random(2)
    rows = [(d, s, s + rng.randint(1, 9), "A", 1.0, 0, i) for d in range(40) for i, s in enumerate(rng.sample(range(60), 8))]
    got = I.masks(frame(spark, rows), ["doc_id"]).collect()
    for d in range(40):
        m = sorted((r.start, r.end) for r in got if r.doc_id == d)
        assert all(a[1] <= b[0] for a, b in zip(m, m[1:]))
        assert {c for a, b in m for c in range(a, b)} == {c for r in rows if r[0] == d for c in range(r[1], r[2])}


def test_containment_and_redaction(spark):
    gold = frame(spark, [(0, 0, 10, "A", 1.0, 0, 0)])
    for end, n in ((8, 1), (7, 0)):
        assert I.semi(gold, frame(spark, [(0, 0, end, "A", 1.0, 0, 0)]), ["doc_id"], "contain").count() == n
    docs = spark.createDataFrame([(0, "hello bob!"), (1, "x")], "doc_id long, text string")
    out = dict(I.redact(docs, frame(spark, [(0, 6, 9, "PERSON", 1.0, 0, 0)])).collect())
    assert out == {0: "hello <PERSON>!", 1: "x"}


def test_auc_equals_pairs(spark):
    rng = random.Random(4)
    rows = [(rng.random() < 0.4, rng.randint(0, 6)) for _ in range(80)]
    pos, neg = [s for t, s in rows if t], [s for t, s in rows if not t]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert Q.auc(spark.createDataFrame(rows, "t boolean, s long"), "t", "s").first().auc == pytest.approx(want)
    assert Q.auc(spark.createDataFrame([(True, 1)], "t boolean, s long"), "t", "s").first().auc == 0.5


def brute_pairs(rows, k, cap):
    """All pairs of one source and every k-th of different sources, in order of ids."""
    pairs = [(a, b) for i, a in enumerate(sorted(rows)) for b in sorted(rows)[i + 1 :]]
    same = [(a[0], b[0], -abs(a[2] - b[2])) for a, b in pairs if a[1] == b[1]]
    return same, [(a[0], b[0], -abs(a[2] - b[2])) for a, b in pairs if a[1] != b[1]][::k][:cap]


@pytest.mark.parametrize("case", ["mixed", "hot first", "few others", "one source", "many sources"])
def test_linkability_takes_all_documents(spark, tmp_path, case):
    from spanforge.plans import catalog

    rng = random.Random(case)
    source = {"mixed": lambda i: f"s{rng.randrange(3)}", "hot first": lambda i: "hot" if i < 90 else f"s{i % 4}", "few others": lambda i: "s1" if i in (117, 119) else "s0", "one source": lambda i: "s0", "many sources": lambda i: f"s{i}"}[case]
    rows = [(7 * i - 30, source(i), rng.choice([0, 3, 400, 499, 500, 501, 900, 1400])) for i in range(120)]
    spark.createDataFrame([(i, "x" * n, "en", c) for i, c, n in rows], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    same, other = brute_pairs(rows, 5, 40)
    got = catalog.stride_sample(spark, str(tmp_path)).collect()
    assert sorted((r.a, r.b, r.same) for r in got) == sorted([(a, b, True) for a, b, _ in same] + [(a, b, False) for a, b, _ in other])
    r = catalog.confusion_metrics(spark, str(tmp_path)).first()
    called = [sum(x > -500 for *_, x in p) for p in (same, other)]
    assert (r.tp, r.fp, r.fn, r.tn) == (called[0], called[1], len(same) - called[0], len(other) - called[1])
    r = catalog.roc_auc(spark, str(tmp_path)).first()
    wins = sum((x > y) + 0.5 * (x == y) for *_, x in same for *_, y in other)
    assert (r.n_pos, r.n_neg) == (len(same), len(other)) and r.auc == pytest.approx(wins / (len(same) * len(other)) if same and other else 0.5)


def test_sampled_pairs_hold_at_any_size(spark, monkeypatch):
    monkeypatch.setattr(Q, "_BLOCK", 16)
    rng = random.Random(8)
    for k, cap in ((1, 3), (2, 4), (3, 2)):
        for hot in (0.3, 0.8, 0.97):
            rows = [(i, "s0" if rng.random() < hot else f"s{rng.randrange(1, 4)}", 0) for i in range(70)]
            same, other = brute_pairs(rows, k, cap)
            got = Q.stride_pairs(spark.createDataFrame(rows, "id long, g string, n long"), "g", "id", k, cap).collect()
            assert sorted((r.a, r.b, r.same) for r in got) == sorted([(a, b, True) for a, b, _ in same] + [(a, b, False) for a, b, _ in other])


def test_pairs_of_a_group_meet_as_blocks(spark, monkeypatch):
    """What is shuffled for all pairs of a large group is a row a block and meeting, not each key once a block."""
    monkeypatch.setattr(Q, "_BLOCK", 16)
    # 1000 keys of one group, 100 of none, a key of both and one twice; the last has no key
    rows = [(3 * i - 700, "hot") for i in range(1000)] + [(3 * i, None) for i in range(100)] + [(1, "hot"), (1, None), (2, "hot"), (2, "hot"), (None, "hot")]
    store = spark.sparkContext._jsc.sc().statusStore()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway

    def written():
        stages = store.stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (stages.apply(i) for i in range(stages.size()))}

    units = spark.createDataFrame(rows, "id long, g string")
    before = written()
    got = sorted((r.a, r.b) for r in Q.same_pairs(units, "g", "id").collect())
    assert got == sorted((a, b) for a, g in rows for b, h in rows if a is not None and b is not None and a < b and g == h)
    assert sum(n for k, n in written().items() if k not in before) < 10 * len(rows)  # 63 blocks meet 63


def test_bootstrap_resamples_2000_times(spark, tmp_path):
    from spanforge.plans import catalog

    text = ["a@b.co and 10.0.0.1", "4111 1111 1111 1111", "call (743) 555-3824", "+1 743 555 3824 x@y.zw", "none", "deadbeefcafe" * 3, "1.2.3.4, 4.3.2.1, q@r.st, 4111-1111-1111-1111"]
    rows = [(i, text[i * i % 11 % 7], "en", f"s{i % 3}") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    count = {}
    for r in catalog._caught(spark, str(tmp_path)).collect():
        c, n = count.get(r.doc_id, (0, 0))
        count[r.doc_id] = (c + r.covered, n + 1)
    k = [count[i] for i in sorted(count)]
    assert 0 < sum(c for c, _ in k) < sum(n for _, n in k)
    xs = []
    for it in range(2000):
        got = [k[(it * 7919 + d * 104729 + 20260601) * 48271 % 2147483647 * 16807 % 2147483647 % len(k)] for d in range(len(k))]
        xs.append(sum(c for c, _ in got) / sum(n for _, n in got))
    xs.sort()
    r = catalog.bootstrap_recall(spark, str(tmp_path)).first()
    assert (r.lo, r.hi) == (xs[50], xs[1949]) and r.mean == pytest.approx(sum(xs) / 2000)


def test_kappa_and_tier(spark):
    same = spark.createDataFrame([("A", "A", 5)], "a string, b string, n long")
    assert Q.kappa(same, "a", "b", "n").first().kappa == 1.0
    row = spark.range(1).select(*[L.tier(*[F.lit(float(v)) for v in x]).alias(str(i)) for i, x in enumerate([(1, 0, 0, 0), (0, 2, 0, 0), (0, 0, 0.4, 0), (0, 0, 0, 0.6), (0, 0, 0, 0)])]).first()
    assert list(row) == ["RED", "AMBER", "AMBER", "AMBER", "GREEN"]


def test_asof_is_inclusive(spark):
    e = spark.createDataFrame([(0, 1, "a"), (0, 5, "b")], "k long, t long, v string")
    p = spark.createDataFrame([(0, 0), (0, 1), (0, 4), (0, 5)], "k long, t long")
    assert {r.t: r.v for r in I.last_at_or_before(e, p, ["k"], "t", "v").collect()} == {0: None, 1: "a", 4: "a", 5: "b"}


def test_frontmatter(spark):
    block = "---\nclient_id: C-17 # x\nname: \"Ann Lee\"\nclient: Q\n  Therapist: 'O Hara' \npatient:\ndate: 1\n---\nbody name: No"
    docs = spark.createDataFrame([(0, block), (1, "x\n" + block), (2, "\ufeff" + block.replace("\n", "\r\n")), (3, None), (4, "---\nname: open")], "doc_id long, text string")
    got = seq.frontmatter(docs).orderBy("doc_id", "start").collect()
    want = [("C-17", "ID"), ("Ann Lee", "PERSON"), ("O Hara", "PERSON")]
    assert [(r.doc_id, r.value, r.label) for r in got] == [(i, *w) for i in (0, 2) for w in want]
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(text[r.doc_id][r.start : r.end] == r.value for r in got)


def test_chunks_against_the_definition():
    rng = random.Random(3)
    seps = ("\n\n", "\n", ". ", "? ", "! ")
    for _ in range(300):
        text = "".join(rng.choice("ab.?! \n") for _ in range(rng.randint(0, 60)))
        size, n = rng.randint(1, 20), len(text)
        overlap = rng.randrange(size)
        want, start = [], 0
        while start < n:
            end = min(start + size, n)
            if end < n:
                end = next((at + len(s) for s in seps if (at := text.rfind(s, start + max(1, size // 3), end)) >= 0), end)
            want.append((start, end))
            start = n if end >= n else max(end - overlap, start + 1)
        assert list(seq.chunks(text, size, overlap)) == want
    with pytest.raises(ValueError):
        list(seq.chunks("a", 3, 3))


def test_chunk_rows_and_rebased_spans(spark):
    docs = spark.createDataFrame([(0, "a" * 9 + "\n" + "b" * 9), (1, None), (2, "")], "doc_id long, text string")
    c = seq.chunk_spans(docs, 12, 3)
    assert sorted(map(tuple, c.collect())) == [(0, 0, 0, 10), (0, 1, 7, 19)]
    found = spark.createDataFrame([(0, 0, 8, 10, "X"), (0, 1, 1, 3, "X"), (0, 1, 5, 99, "X")], "doc_id long, chunk long, start long, end long, label string")
    got = seq.rebase(c, found, docs.selectExpr("doc_id", "length(text) AS n"))
    assert [(r.start, r.end, r.label, r.chunk) for r in got.collect()] == [(8, 10, "X", 0)]


def test_names(spark):
    a = spark.createDataFrame([(x, y) for x, y in [("тимур", "тимура"), ("анна", "анной"), ("аня", "ани"), ("вера", "верой"), ("лебедев", "лебедева"), ("иван", "иванович"), ("роман", "романтик"), ("ян", "ян")]], "a string, b string")
    def brute(x, y):
        n = min(len(x), len(y))
        p = next((i for i in range(n) if x[i] != y[i]), n)
        return x == y or n >= 4 and p >= n - 2 and len(x) - p <= 3 and len(y) - p <= 3
    got = a.select("a", "b", seq.same_name(F.col("a"), F.col("b")).alias("same")).collect()
    assert all(r.same == brute(r.a, r.b) for r in got) and {r.same for r in got} == {True, False}
    text = "Тимура видели. Timur звонил, вера в тимур и Верой, лебедев ждал Лебедева."
    docs = spark.createDataFrame([(0, text), (1, text)], "doc_id long, text string")
    persons = spark.createDataFrame([(0, "Тимур Лебедев"), (0, "Вера")], "doc_id long, value string")
    got = seq.propagate(docs, persons).orderBy("start").collect()
    assert [r.value for r in got] == ["Тимура", "Timur", "тимур", "Верой", "лебедев", "Лебедева"]


def test_one_to_one_matching(spark):
    cols = "doc_id long, start int, end int, canon string"
    gold = spark.createDataFrame([(0, 0, 5, "A"), (0, 6, 9, "B"), (2, 0, 3, "A"), (3, 0, 4, "A"), (3, 2, 6, "A")], cols)
    pred = spark.createDataFrame([(0, 0, 5, "A"), (0, 6, 8, "C"), (1, 0, 1, "A"), (3, 1, 5, "A"), (3, 3, 9, "A"), (3, 20, 22, "Z")], cols)
    got = {r.doc_id: (r.correct, r.partial, r.wrong_type, r.fp, r.fn) for r in seq.greedy_counts(gold, pred).collect()}
    assert got == {0: (1, 0, 1, 1, 1), 1: (0, 0, 0, 1, 0), 2: (0, 0, 0, 0, 1), 3: (2, 2, 0, 1, 0)}
    got = {r.doc_id: tuple(r)[1:] for r in seq.greedy_counts(gold, pred, relaxed=False, types={"A", "B"}).collect()}
    assert got == {0: (1, 0, 0, 0, 1), 1: (0, 0, 0, 1, 0), 2: (0, 0, 0, 0, 1), 3: (0, 0, 0, 2, 2)}


def test_nested_and_structured_spans(spark):
    rows = [(0, 0, 5, "e", "PERSON"), (0, 2, 4, "e", "PERSON"), (0, 3, 6, "f", "PERSON"), (0, 4, 7, "e", "PERSON"), (1, 0, 20, "m", "EMAIL"), (1, 2, 5, "p", "PERSON"), (1, 25, 28, "p", "PERSON"), (1, 3, 9, "x", "ID")]
    found = spark.createDataFrame(rows, "doc_id long, start int, end int, entity_id string, type string")
    kept = seq.drop_nested(found)
    assert sorted((r.doc_id, r.start, r.end) for r in kept.collect()) == [(0, 0, 5), (0, 3, 6), (0, 4, 7), (1, 0, 20), (1, 2, 5), (1, 3, 9), (1, 25, 28)]
    assert sorted((r.start, r.end) for r in seq.drop_inside(kept).filter("doc_id = 1").collect()) == [(0, 20), (3, 9), (25, 28)]


def test_first_array(spark):
    x = spark.createDataFrame([('no [x [1, 2] [3]',), ("none",), (None,), ('a ["]", {"b": [1]}] c',), ("[1, [2]",)], "t string")
    assert [r.a for r in x.select(seq.first_array(F.col("t")).alias("a")).collect()] == ["[1, 2]", None, None, '["]", {"b": [1]}]', "[2]"]


def test_sources_and_stream(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"doc_id": "d", "text": "hi bob", "spans": [{"start": 3, "end": 6, "type": "private_person"}]}\n')
    r = files.read_gold(spark, str(tmp_path / "g.jsonl")).first()
    assert (r.canon, r.identifier_class, r.harm, r.entity_id) == ("PERSON", "direct", "medium", "d:3")
    spark.createDataFrame([(0, "a@b.co")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    q = detect.start(detect.read(spark, str(tmp_path / "in"), "doc_id long, text string"), [S.EMAIL], str(tmp_path / "out"), str(tmp_path / "c"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_manifest_names_both_sides(spark, tmp_path):
    from spanforge.plans import catalog

    spark.createDataFrame([(i, "x", "en", "s0") for i in range(7)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in (1, 2, 2, 5, 90, 91, 92)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert tuple(catalog.manifest_validation(spark, str(tmp_path)).first()) == (4, 3)


def test_every_oracle_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 50
