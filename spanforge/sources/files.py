"""Sources and sinks: gold JSON lines, detector caches with manifests, text folders, redacted output, the run log."""

from __future__ import annotations

import os
import sys
import uuid
import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import canon, safe

SPAN = "start INT, `end` INT, type STRING, value STRING, identifier_class STRING, entity_id STRING, harm STRING, speaker_turn_id INT, speaker STRING"
GOLD = f"doc_id STRING, lang STRING, client STRING, session INT, split STRING, text STRING, source STRING, spans ARRAY<STRUCT<{SPAN.replace(' INT', ': INT').replace(' STRING', ': STRING')}>>"
CACHE = "doc_id STRING, spans ARRAY<STRUCT<start: INT, `end`: INT, type: STRING, source: STRING>>"
MANIFEST = "dataset STRING, detector STRING, n_docs INT, n_spans INT, invalid_spans INT, doc_ids ARRAY<STRING>, docs_sha STRING, code_sha STRING, model STRING, seconds DOUBLE"


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold spans, one row each, with defaults for what a series leaves out."""
    docs = spark.read.schema(GOLD).option("mode", "FAILFAST").json(path)
    s = docs.select("doc_id", "lang", "client", "split", "text", F.posexplode("spans").alias("seq", "s")).select("*", "s.*").drop("s")
    return s.withColumns({
        "canon": canon(F.col("type")), "identifier_class": F.coalesce("identifier_class", F.lit("direct")), "harm": F.coalesce("harm", F.lit("medium")),
        "entity_id": F.coalesce("entity_id", F.concat_ws(":", "doc_id", F.col("start").cast("string"))),
    })


def resolve(*paths: str, optional: bool = False) -> str | None:
    """The first path that exists; where none does, None if ``optional``, else ``FileNotFoundError``."""
    found = next((p for p in paths if os.path.exists(p)), None)
    if found is None and not optional:
        raise FileNotFoundError(f"none of {paths}")
    return found


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Spans of a detector cache as it is; a document without spans has one row of nulls."""
    return spark.read.schema(CACHE).option("mode", "FAILFAST").json(path).select("doc_id", F.posexplode_outer("spans").alias("seq", "s")).select("doc_id", "seq", "s.*")


def read_resumable(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, spans) of a cache that was written in several runs: the last row of an id wins.

    Blank lines are skipped; a corrupt line or one without an id fails the read.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("at")).filter("trim(value) != ''")
    rows = lines.select("f", "at", F.from_json("value", CACHE, {"mode": "FAILFAST"}).alias("r"))
    rows = rows.select("f", "at", F.when(F.col("r.doc_id").isNull(), F.raise_error(F.lit("a cache line has no doc_id"))).otherwise(F.col("r.doc_id")).alias("doc_id"), "r.spans")
    return rows.groupBy("doc_id").agg(F.max_by("spans", F.struct("f", "at")).alias("spans"))


def text_hash(docs: DataFrame) -> str:
    """A fingerprint of the texts of a set of documents: hashes by id, by bucket of ids, then of the buckets."""
    one = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(4096)).alias("b"), F.struct(F.col("doc_id").cast("string").alias("i"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).alias("x"))
    joined = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["h"]), ""), 256)
    buckets = one.groupBy("b").agg(joined("x").alias("h"))
    return buckets.agg(F.substring(joined(F.struct("b", "h")), 1, 12).alias("sha")).first().sha


def load_cache(spark: SparkSession, folder: str, dataset: str, detector: str, docs: DataFrame, cover: bool = False) -> DataFrame | None:
    """The spans of a cache whose manifest vouches for it, else None with a warning.

    The manifest must report no invalid spans and name the same documents as ``docs`` (with ``cover``:
    name these among others), and its text hash, where it has one, must be that of ``docs`` (with
    ``cover`` it may be that of a larger set, so it is then only noted).
    """
    path, at = f"{folder}/{dataset}.{detector}", f"{dataset}/{detector}"
    if not os.path.exists(path):
        return None
    if not os.path.exists(f"{path}.manifest"):
        warnings.warn(f"{at}: no manifest, the cache cannot be validated", stacklevel=2)
        return read_cache(spark, path)
    m = spark.read.schema(MANIFEST).json(f"{path}.manifest")
    head = m.select("invalid_spans", "docs_sha").first()
    if head.invalid_spans:
        warnings.warn(f"{at}: the manifest reports {head.invalid_spans} invalid spans", stacklevel=2)
        return None
    named, ids = m.select(F.explode("doc_ids").alias("doc_id")).distinct(), docs.select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
    lacking = ids.join(named, "doc_id", "left_anti").limit(1).count()
    extra = 0 if cover else named.join(ids, "doc_id", "left_anti").limit(1).count()
    if lacking or extra:
        warnings.warn(f"{at}: the documents differ from those of the cache", stacklevel=2)
        return None
    if not head.docs_sha:
        warnings.warn(f"{at}: the manifest has no text hash, only ids were validated", stacklevel=2)
    elif not cover and head.docs_sha != text_hash(docs):
        warnings.warn(f"{at}: texts have changed since the cache was written", stacklevel=2)
        return None
    cache = read_cache(spark, path)
    return cache.join(ids, "doc_id", "left_semi") if cover else cache


def write_cache(spans: DataFrame, docs: DataFrame, folder: str, dataset: str, detector: str, model: str = "", seconds: float = 0.0) -> None:
    """Write a cache, one row a document, and then its manifest, so that a cache without one is unfinished."""
    span = F.struct("start", "end", F.col("label").alias("type"), "source")
    by = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    rows = docs.select("doc_id", F.length("text").alias("n")).join(by, "doc_id", "left").select(F.col("doc_id").cast("string").alias("doc_id"), "n", F.coalesce("spans", F.array().cast(by.schema["spans"].dataType)).alias("spans"))
    path = f"{folder}/{dataset}.{detector}"
    rows.select("doc_id", "spans").write.mode("overwrite").json(path)
    bad = F.size(F.filter("spans", lambda s: (s["start"] < 0) | (s["start"] >= s["end"]) | (s["end"] > F.col("n"))))
    m = rows.agg(F.count(F.lit(1)).cast("int").alias("n_docs"), F.sum(F.size("spans")).cast("int").alias("n_spans"), F.sum(bad).cast("int").alias("invalid_spans"), F.array_sort(F.collect_list("doc_id")).alias("doc_ids"))
    m.select(F.lit(dataset).alias("dataset"), F.lit(detector).alias("detector"), "*", F.lit(text_hash(docs)).alias("docs_sha"), F.lit(model).alias("model"), F.lit(seconds).alias("seconds")).write.mode("overwrite").json(f"{path}.manifest")


def resume(docs: DataFrame, path: str, detect: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """Rows of ``detect`` for all documents (or pairs) by ``keys``, those already in ``path`` read from there.

    New rows are appended once computed, so a run that is broken off is taken up where it stopped.
    """
    spark = docs.sparkSession
    todo = docs.join(spark.read.parquet(path).select(*keys), keys, "left_anti") if os.path.exists(path) else docs
    detect(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(docs.select(*keys), keys, "left_semi")


def read_list(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(doc, text, error) of listed files; a file that cannot be read has the class of its error and no text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, path in zip(b["doc"], b["path"], strict=True):
                try:
                    with open(path, encoding="utf-8", newline="") as f:
                        rows.append((doc, f.read(), None))
                except (OSError, ValueError) as e:
                    rows.append((doc, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["doc", "text", "error"])

    return spark.createDataFrame([(f"doc-{i:03d}", p) for i, p in enumerate(paths)], "doc string, path string").mapInPandas(run, "doc string, text string, error string")


def read_flat(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text) of the ``*.txt`` and ``*.md`` files of a folder, without its subfolders."""
    x = spark.read.option("pathGlobFilter", "*.{txt,md}").text(folder, wholetext=True)
    return x.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def read_one(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(doc_id, text) of one file, or of standard input where there is none."""
    if path is None:
        return spark.createDataFrame([("-", sys.stdin.read())], "doc_id string, text string")
    with open(path, encoding="utf-8", newline="") as f:
        return spark.createDataFrame([(path, f.read())], "doc_id string, text string")


def read_labels(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, annotator, seq, start, end, type, note) of the files ``labels.<annotator>.json``, each an object of lists by document."""
    span = "array<struct<start:int,end:int,type:string,note:string>>"
    x = spark.read.option("pathGlobFilter", "labels.*.json").text(folder, wholetext=True)
    x = x.select(F.regexp_extract("_metadata.file_name", r"^labels\.(.*)\.json$", 1).alias("annotator"), F.explode(F.from_json("value", f"map<string,{span}>")).alias("doc_id", "s"))
    return x.select("doc_id", "annotator", F.posexplode("s").alias("seq", "x")).select("doc_id", "annotator", "seq", "x.*")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """Results of a scorer, gold documents, drafts: one JSON object a row."""
    df.write.mode("overwrite").json(path)


def nest_gold(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Gold documents with their spans as a list in order of place, as ``read_gold`` takes them."""
    cols = [c for c in spans.columns if c != "doc_id"]
    by = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", *[c for c in cols if c not in ("start", "end")]))).alias("spans"))
    return docs.join(by, "doc_id", "left").withColumn("spans", F.coalesce("spans", F.array().cast(by.schema["spans"].dataType)))


def markdown(df: DataFrame, digits: int = 3) -> str:
    """A small result as a Markdown table."""
    show = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else "" if v is None else str(v)
    rows = [df.columns, ["---"] * len(df.columns), *[[show(v) for v in r] for r in df.collect()]]
    return "".join("| " + " | ".join(r) + " |\n" for r in rows)


def encrypt(df: DataFrame, column: str, key: str) -> DataFrame:
    """``column`` encrypted with AES-GCM under a key of 16, 24 or 32 bytes, in base64."""
    return df.withColumn(column, F.base64(F.call_function("aes_encrypt", F.col(column), F.lit(key.encode()), F.lit("GCM"))))


def decrypt(df: DataFrame, column: str, key: str) -> DataFrame:
    return df.withColumn(column, F.call_function("aes_decrypt", F.unbase64(column), F.lit(key.encode()), F.lit("GCM")).cast("string"))


def prompt(path: str | None = None, variable: str = "ANONYMIZE_PROMPT", default: str = "") -> str:
    """A prompt template: of a file, else of the file that an environment variable names, else the default."""
    name = path or os.environ.get(variable)
    if not name:
        return default
    with open(name, encoding="utf-8") as f:
        return f.read()


# Names of layers that a new detector must not take.
RESERVED = ("regex", "natasha", "ollama", "opf", "presidio", "philter", "scrubadub")


def free_name(name: str) -> str:
    """``name`` if a new detector may have it, else ``ValueError``."""
    if name.lower() in RESERVED:
        raise ValueError(f"{name} is reserved")
    return name


def active(datasets: dict[str, str]) -> dict[str, str]:
    """Those datasets whose gold file is there."""
    return {k: v for k, v in datasets.items() if os.path.exists(v)}


def read_texts(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """(doc_id, text) of the files of a folder and its subfolders."""
    x = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    return x.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def manifest(spans: DataFrame, masks: DataFrame, texts: DataFrame) -> DataFrame:
    """Per document: characters, spans, masked share and counts of masks by publishable label; no text of any span.

    ``masks`` are the merged intervals with the label they are redacted by.
    """
    raw = spans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("spans"))
    by = masks.groupBy("doc_id", safe(F.col("label")).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("size"))
    by = by.groupBy("doc_id").agg(F.sum("size").alias("size"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("by_type"))
    x = texts.select("doc_id", F.length("text").alias("chars")).join(raw, "doc_id", "left").join(by, "doc_id", "left")
    rate = F.when(F.col("chars") > 0, F.round(F.coalesce("size", F.lit(0)) / F.col("chars"), 4)).otherwise(0.0)
    return x.select("doc_id", "chars", F.coalesce("spans", F.lit(0)).alias("spans"), F.coalesce("size", F.lit(0)).alias("masked"), "by_type", rate.alias("redaction_rate"))


def write_texts(docs: DataFrame, folder: str, suffix: str = ".green.md") -> None:
    """One file for each (doc_id, text) in a folder that all executors share, named by the base of the id.

    A file is written aside and renamed, so a task that is run again replaces it whole.
    """
    os.makedirs(folder, exist_ok=True)

    def run(rows: Iterator[Row]) -> None:
        for r in rows:
            base = os.path.splitext(os.path.basename(str(r.doc_id)))[0]
            aside = f"{folder}/.{base}{suffix}.{uuid.uuid4().hex}"
            with open(aside, "w", encoding="utf-8", newline="") as f:
                f.write(r.text or "")
            os.replace(aside, f"{folder}/{base}{suffix}")

    docs.select("doc_id", "text").foreachPartition(run)


def append_run(record: DataFrame, path: str) -> None:
    record.withColumn("ts", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")).write.mode("append").json(path)
