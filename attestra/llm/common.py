"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.labels import answerability_label, group_id, label, language_label, split_label
from ..operators.ranking import fill_cores
from ..operators.ranking import hash_place as rank_in_group
from ..operators.ranking import hash_sample, spread
from ..session import shared_dir, written

__all__ = ["answerability_label", "fill_cores", "group_id", "hash_sample", "label", "language_label", "rank_in_group", "shared_dir", "split_label", "spread", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
