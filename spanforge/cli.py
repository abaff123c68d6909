"""Command line: redact a folder of texts, or count what would be redacted.

    python -m spanforge.cli redact IN --out OUT [--layers regex,...] [--pseudonyms]
    python -m spanforge.cli stats IN
    python -m spanforge.cli datasets

Neither prints nor keeps any text but the redacted one.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import labels as L
from .functions.spans import REGEX_LAYER, spans
from .operators import builders as B
from .operators import intervals as I
from .operators import sequential as E
from .sources import files
from .sources.stage import stage


def found(docs: DataFrame, layers: list[str]) -> DataFrame:
    """Spans of the layers: patterns, the metadata block, and forms of the names they found.

    ``opf`` is another name of ``regex``; layers that need a model are extensions, which are not here.
    """
    names = {"regex" if n == "opf" else n for n in layers}
    if names - {"regex"}:
        raise ValueError(f"no such layer: {sorted(names - {'regex'})}")
    cols = ["doc_id", "start", "end", "label", "value", "source", "confidence", "layer_rank", "seq"]
    direct = spans(docs, REGEX_LAYER).select(*cols)
    extra = lambda df, rank, source, conf: df.select("doc_id", "start", "end", "label", "value", F.lit(source).alias("source"), F.lit(conf).alias("confidence"), F.lit(rank).alias("layer_rank"), F.col("start").alias("seq"))
    direct = stage(direct.unionByName(extra(E.frontmatter(docs), 98, "regex", 1.0)))
    names_ = direct.filter("label = 'PERSON'").select("doc_id", "value")
    return direct.unionByName(extra(E.propagate(docs, names_).withColumn("label", F.lit("PERSON")), 99, "propagate", 0.8))


def masks(hits: DataFrame) -> DataFrame:
    """Merged intervals with the publishable label of their longest span, the first in layer order of equal ones."""
    m = I.masks(hits, ["doc_id"]).alias("m")
    x = m.join(hits.alias("s"), I.on_keys("m", "s", ["doc_id"]) & I.overlaps("m", "s"))
    best = F.max_by(L.safe(F.col("s.label")), F.struct(F.col("s.end") - F.col("s.start"), -F.col("s.layer_rank"), -F.col("s.seq")))
    return x.groupBy("m.doc_id", "m.start", "m.end").agg(best.alias("label"))


def redact(spark: SparkSession, folder: str, out: str, layers: list[str], use_pseudonyms: bool = False) -> dict:
    """Write ``<base>.green.md`` of every text and a manifest without any of their content; returns the counts."""
    docs = stage(files.read_texts(spark, folder).select("doc_id", "text"))
    hits = stage(found(docs, layers))
    m = stage(masks(hits))
    shown = m
    if use_pseudonyms:
        value = m.join(docs, "doc_id").select("doc_id", "start", "end", "label", F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")).alias("value"))
        names = B.pseudonyms(value, ["doc_id"])
        shown = value.withColumn("value", F.trim("value")).join(names, ["doc_id", "value"]).select("doc_id", "start", "end", F.col("pseudonym").alias("label"))
    texts = I.redact(docs, shown, marks=("", "") if use_pseudonyms else ("<", ">"))
    files.write_texts(texts.select("doc_id", F.col("redacted").alias("text")), out)
    listing = files.manifest(hits, m, docs).orderBy("doc_id").drop("doc_id")
    rows = [r.asDict() for r in listing.collect()]  # one small row a file, as the manifest is one file
    for i, r in enumerate(rows):
        r["doc"] = f"doc-{i:03d}"
    with open(f"{out}/manifest.json", "w", encoding="utf-8") as f:
        json.dump({"layers": layers, "files": rows}, f, ensure_ascii=False, indent=2)
    return {"redacted": len(rows), "errors": 0, "manifest": "manifest.json"}


def stats(spark: SparkSession, folder: str, layers: list[str]) -> dict:
    """Counts and the masked share over all texts of a folder; nothing is written."""
    docs = stage(files.read_texts(spark, folder).select("doc_id", "text"))
    hits = stage(found(docs, layers))
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    masked = I.masks(hits, ["doc_id"]).agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("m")).first().m
    by = {r.label: r.n for r in hits.groupBy(L.safe(F.col("label")).alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a closed list of labels
    return {"files": size.n, "total_chars": size.chars, "by_type": by, "masked": masked, "redaction_rate": round(masked / size.chars, 4) if size.chars else 0.0}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="spanforge")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("redact", "stats"):
        s = sub.add_parser(name)
        s.add_argument("input")
        s.add_argument("--layers", default="regex")
        if name == "redact":
            s.add_argument("--out", required=True)
            s.add_argument("--pseudonyms", action="store_true")
    sub.add_parser("datasets").add_argument("folder", nargs="?", default=".")
    a = p.parse_args(argv)
    if a.command == "datasets":
        print(json.dumps(sorted(files.active({n: f"{a.folder}/{n}.parquet" for n in ("documents", "pages", "benchmark", "labels", "conversations")}))))
        return 0
    spark = SparkSession.builder.getOrCreate()
    layers = a.layers.split(",")
    print(json.dumps(redact(spark, a.input, a.out, layers, a.pseudonyms) if a.command == "redact" else stats(spark, a.input, layers), ensure_ascii=False))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
