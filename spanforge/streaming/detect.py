"""Detection over a landing folder: every document is handled as it comes, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.spans import Detector, spans


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The stream of Parquet files that arrive in ``path``."""
    return spark.readStream.schema(schema).parquet(path)


def start(docs: DataFrame, detectors: list[Detector], out: str, checkpoint: str):
    """Write the spans of each batch to its own folder of ``out``; a batch that is run again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        spans(batch, detectors).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
