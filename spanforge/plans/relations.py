"""The relations all queries share: documents, gold spans, detector spans, combinations, masks.

The test tables hold no gold spans, so strict patterns stand for gold and looser ones for
detectors.  That exercises the algebra, not the quality of detection.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.spans import CARD, DOTTED_QUAD, EMAIL, PHONE, SECRET, Detector, spans
from ..operators import intervals as I
from ..sources.stage import stage

GOLD = [EMAIL, PHONE, CARD, DOTTED_QUAD, SECRET]
LAYERS = [
    Detector("mail", "PRIVATE_EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "mail", 0.9, holds="@"),
    Detector("phone", "PHONE", r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}", "phone", 0.8, holds="("),
    Detector("digits", "ID", r"[0-9.]{7,}", "digits", 0.85),
]
#: Combination -> its layers in order; the last one is the default.
COMBOS = {"mail": ["mail"], "phone": ["phone"], "digits": ["digits"], "mail+phone": ["mail", "phone"], "mail+phone+digits": ["mail", "phone", "digits"]}
DEFAULT = "mail+phone+digits"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.col("source").alias("client"))


#: Texts with what the test tables lack, under negative ids, so that every detector finds something.
SAMPLES = {
    -1: "Карта 1234 5678 9012 3456, полис\t7722-4455-8811; дата 15.01.2024 или 3/4/99, 1984-08-08T00:00 и 99.99.9999.",
    -2: "СНИЛС 123-456-789 01, паспорт 4510\t123456, ИНН: 7707083893, ИНН клиента 500100732259, код 7707083893.",
    -3: "Она пришла в прошлый вторник, 3 дня тому назад, третьего февраля, 12 декабря и до Нового года; сегодня нет.",
    -4: "We met last Tuesday, two weeks ago, on the 19th of the month, March 3rd, 2024, 12 December and December/48.",
    -5: "Пишите: t.me/ivan_p. или @marina.k, https://vk.com/id77; почта a@b.ru; звоните +7 (912) 345-67-89 или 8 912 345 67 89.",
    -6: "Тимур Маратович и Анна Сергеевна купили Кирпич. Мне сорок один, ему 7 лет назад, возраст: 33. Сорок пять лет мужику.",
    -7: "---\nclient_id: marina  # код\nname: \"Анна Петрова\"\ntherapist: Т\ndate: 2024-01-15\n---\n**00:00:04 Т:** Здравствуйте.\n**00:09** \n К: Да, see www.example.org/a?b=1.",
    -8: "Тимура видели. Timur звонил, вера в тимур и Верой, лебедев ждал Лебедева.",
}


def samples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SAMPLES.items()), "doc_id long, text string")


def with_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) of all documents and of the samples."""
    return documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text").unionByName(samples(spark))


_shared: ContextVar[dict | None] = ContextVar("shared", default=None)


@contextmanager
def sharing() -> Iterator[None]:
    """Inside, the spans of a table are found once and written out, and all relations read them from there."""
    token = _shared.set({})
    try:
        yield
    finally:
        _shared.reset(token)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the gold patterns and of all layers, from one scan of the documents."""
    memo = _shared.get()
    if memo is not None and sf_dir in memo:
        return memo[sf_dir]
    out = spans(documents(spark, sf_dir), [*GOLD, *LAYERS], keep=("client", "lang")).withColumn("canon", L.canon(F.col("label")))
    if memo is not None:
        out = memo[sf_dir] = stage(out)
    return out


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = found(spark, sf_dir).filter(F.col("layer_rank") < len(GOLD))
    return g.withColumns({"entity_id": F.lower("value"), "identifier_class": L.identifier_class(F.col("canon"))})


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = found(spark, sf_dir).filter(F.col("layer_rank") >= len(GOLD))
    return p.withColumn("layer_rank", F.col("layer_rank") - len(GOLD))


def combos(spark: SparkSession) -> DataFrame:
    rows = [(c, d, i, c == DEFAULT) for c, ds in COMBOS.items() for i, d in enumerate(ds)]
    return spark.createDataFrame(rows, "combo string, detector string, rank int, is_default boolean")


def by_combo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every combination; no span is dropped before merging."""
    return preds(spark, sf_dir).join(F.broadcast(combos(spark)), "detector").drop("layer_rank").withColumnRenamed("rank", "layer_rank")


def default_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.longest_label(preds(spark, sf_dir), ["doc_id"])
