"""Cutting lineage in storage that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.stage import shared_folder


def ensure(spark: SparkSession) -> None:
    """See that a checkpoint folder is set; on a cluster without one this raises ``RuntimeError``."""
    shared_folder(spark)


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` as a reliable checkpoint."""
    ensure(df.sparkSession)
    return df.checkpoint(eager)
