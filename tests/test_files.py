"""Sources, sinks and the command line on small folders."""

import json

import pytest
from pyspark.sql import functions as F

from spanforge import cli
from spanforge.functions import spans as S
from spanforge.sources import files
from spanforge.sources.stage import shared_folder


def docs(spark, n=4):
    return spark.createDataFrame([(f"d{i}", f"mail a{i}@b.co now" if i else None) for i in range(n)], "doc_id string, text string")


def test_cache_and_its_manifest(spark, tmp_path):
    d = docs(spark)
    files.write_cache(S.spans(d, [S.EMAIL]), d, str(tmp_path), "en", "mail")
    got = files.load_cache(spark, str(tmp_path), "en", "mail", d)
    assert sorted((r.doc_id, r.start, r.end, r.type) for r in got.filter("start IS NOT NULL").collect()) == [(f"d{i}", 5, 12, "EMAIL") for i in (1, 2, 3)]
    with pytest.warns(UserWarning, match="documents differ"):
        assert files.load_cache(spark, str(tmp_path), "en", "mail", d.filter("doc_id != 'd1'")) is None
    assert files.load_cache(spark, str(tmp_path), "en", "mail", d.filter("doc_id != 'd1'"), cover=True).filter("start IS NOT NULL").count() == 2
    with pytest.warns(UserWarning, match="changed"):
        assert files.load_cache(spark, str(tmp_path), "en", "mail", d.withColumn("text", F.upper("text"))) is None
    assert files.load_cache(spark, str(tmp_path), "en", "none", d) is None
    m = spark.read.json(f"{tmp_path}/en.mail.manifest").first()
    assert (m.n_docs, m.n_spans, m.invalid_spans, m.doc_ids) == (4, 3, 0, ["d0", "d1", "d2", "d3"])
    bad = S.spans(d, [S.EMAIL]).withColumn("end", F.lit(999))
    files.write_cache(bad, d, str(tmp_path), "en", "bad")
    with pytest.warns(UserWarning, match="invalid"):
        assert files.load_cache(spark, str(tmp_path), "en", "bad", d) is None


def test_resumable_reads_keep_the_last_row(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"doc_id": "a", "spans": []}\n\n{"doc_id": "a", "spans": [{"start": 1, "end": 2, "type": "X", "source": "s"}]}\n{"doc_id": "b", "spans": []}\n')
    got = {r.doc_id: len(r.spans) for r in files.read_resumable(spark, str(tmp_path / "c.jsonl")).collect()}
    assert got == {"a": 1, "b": 0}
    for bad in ('{"doc_id": "a", "spans": [}', '{"spans": []}'):
        (tmp_path / "d.jsonl").write_text(bad + "\n")
        with pytest.raises(Exception):  # noqa: B017
            files.read_resumable(spark, str(tmp_path / "d.jsonl")).collect()


def test_resume_asks_only_for_what_is_new(spark, tmp_path):
    asked = []

    def detect(todo):
        asked.append(sorted(r.doc_id for r in todo.collect()))
        return todo.select("doc_id", F.length("text").alias("n"))

    for n in (2, 4):
        assert files.resume(docs(spark, n), str(tmp_path / "v"), detect, ["doc_id"]).count() == n
    assert asked == [["d0", "d1"], ["d2", "d3"]]


def test_lists_labels_and_small_files(spark, tmp_path, monkeypatch):
    (tmp_path / "a.md").write_text("x\r\ny")
    (tmp_path / "b.txt").write_bytes(b"\xff")
    got = files.read_list(spark, [str(tmp_path / n) for n in ("a.md", "none.md", "b.txt")]).orderBy("doc").collect()
    assert [(r.doc, r.text, r.error) for r in got] == [("doc-000", "x\r\ny", None), ("doc-001", None, "FileNotFoundError"), ("doc-002", None, "UnicodeDecodeError")]
    assert files.read_flat(spark, str(tmp_path)).count() == 2
    (tmp_path / "labels.ann.json").write_text(json.dumps({"d1": [{"start": 0, "end": 3, "type": "PERSON", "note": "QUESTION"}], "d2": []}))
    assert [tuple(r) for r in files.read_labels(spark, str(tmp_path)).collect()] == [("d1", "ann", 0, 0, 3, "PERSON", "QUESTION")]
    assert files.read_one(spark, str(tmp_path / "a.md")).first().text == "x\r\ny"
    assert files.resolve(str(tmp_path / "no"), str(tmp_path / "a.md")).endswith("a.md") and files.resolve("no", optional=True) is None
    with pytest.raises(FileNotFoundError):
        files.resolve("no")
    assert files.prompt(default="d") == "d" and files.prompt(str(tmp_path / "a.md")).startswith("x")
    monkeypatch.setenv("ANONYMIZE_PROMPT", str(tmp_path / "a.md"))
    assert files.prompt(default="d").startswith("x")
    with pytest.raises(ValueError):
        files.free_name("Regex")
    assert files.free_name("mine") == "mine" and files.active({"a": str(tmp_path / "a.md"), "b": "no"}).keys() == {"a"}


def test_results_gold_and_encryption(spark, tmp_path):
    d = docs(spark, 2)
    files.write_json(files.nest_gold(d, S.spans(d, [S.EMAIL]).select("doc_id", "start", "end", F.col("label").alias("type"))), str(tmp_path / "g"))
    assert [(r.doc_id, r.start, r.canon) for r in files.read_gold(spark, str(tmp_path / "g")).collect()] == [("d1", 5, "EMAIL")]
    (tmp_path / "r.json").write_text(json.dumps({"a": {"f1": 0.5}}, indent=2))
    assert files.read_results(spark, str(tmp_path / "r.json")).first().a.f1 == 0.5
    assert files.markdown(spark.createDataFrame([("a", 0.5, None)], "x string, y double, z int")) == "| x | y | z |\n| --- | --- | --- |\n| a | 0.500 |  |\n"
    key = "0123456789abcdef"
    hidden = files.encrypt(d, "text", key)
    assert {r.text for r in files.decrypt(hidden, "text", key).collect()} == {r.text for r in d.collect()} and "mail" not in str(hidden.filter("text IS NOT NULL").first().text)


def test_redact_and_stats(spark, tmp_path, capsys):
    src, out = tmp_path / "in", tmp_path / "out"
    (src / "sub").mkdir(parents=True)
    (src / "one.md").write_text("---\nclient_id: marina\n---\nАнна Сергеевна, a@b.co, 15.01.2024. Сергеевной довольны; https://x.org/ab@b.co")
    (src / "sub" / "two.md").write_text("nothing here\n")
    assert cli.main(["redact", str(src), "--out", str(out)]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"redacted": 2, "errors": 0, "manifest": "manifest.json"}
    assert (out / "one.green.md").read_text() == "---\nclient_id: <ID>\n---\nАнна <PERSON>, <EMAIL>, <DATE>. <PERSON> довольны; <URL>"
    assert (out / "two.green.md").read_text() == "nothing here\n"
    m = (out / "manifest.json").read_text()
    assert "marina" not in m and "one" not in m and {f["spans"] == 0 for f in json.loads(m)["files"]} == {True, False}
    assert cli.main(["stats", str(src)]) == 0
    s = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert s["files"] == 2 and s["by_type"]["ID"] == 1 and 0 < s["redaction_rate"] < 1
    assert cli.main(["redact", str(src), "--out", str(out), "--pseudonyms"]) == 0
    assert "[Алексей]" in (out / "one.green.md").read_text()
    with pytest.raises(ValueError):
        cli.main(["stats", str(src), "--layers", "ollama"])


def test_a_cluster_needs_a_shared_folder(spark):
    assert shared_folder(spark)
