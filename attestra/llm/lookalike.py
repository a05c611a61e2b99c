"""Problem 2: rows that show the same text but hold different characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .canon import add_canonical
from .common import table, written

FIELDS = ("question", "gold_answer")


def field_texts(df: DataFrame, key: str = "row_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(key, field_name, raw_text), one row per field with text; NULL and empty texts are left out."""
    parts = [F.struct(F.lit(f).alias("field_name"), F.col(f).alias("raw_text")) for f in fields]
    return df.select(key, F.explode(F.array(*parts)).alias("x")).select(key, "x.*").where(F.trim("raw_text") != "")


def canonical_forms(df: DataFrame, key: str = "row_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(key, field_name, raw_text, canonical, visible_form) of every text. NULL and empty texts give no row; very long texts are taken whole."""
    return add_canonical(field_texts(df, key, fields), "raw_text")


def same_look_pairs(df: DataFrame, key: str = "row_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(key_a < key_b, field_name): pairs of rows whose field looks the same and is not the same string.

    Rows are bucketed by what a reader sees, the consistent form without the folding of case. Buckets with one spelling are
    dropped by a map-side-combined min/max before any pair is formed; rows of a bucket meet by equi-join only where the
    spelling differs. Exact repetitions of one spelling make no pair, an empty table gives no row.
    """
    forms = canonical_forms(df, key, fields).select(
        key, "field_name", F.md5("visible_form").alias("look"), F.md5("raw_text").alias("spelling")
    )
    forms = written(forms)  # read four times below
    several = forms.groupBy("field_name", "look").agg(F.min("spelling").alias("lo"), F.max("spelling").alias("hi")).where("lo <> hi").select("field_name", "look")
    rows = forms.join(several, ["field_name", "look"])
    # copies of one spelling stay one row on the side that is spread, so that a hot spelling is not repeated there
    spellings = rows.groupBy("field_name", "look", "spelling").agg(F.count("*").alias("n"))
    other = spellings.join(spellings.select("field_name", "look", F.col("spelling").alias("spelling_b")), ["field_name", "look"]).where("spelling < spelling_b").select("field_name", "spelling", "spelling_b", "look")
    a = rows.select(F.col(key).alias("a"), "field_name", "look", "spelling")
    b = rows.select(F.col(key).alias("b"), "field_name", "look", F.col("spelling").alias("spelling_b"))
    pairs = other.join(a, ["field_name", "look", "spelling"]).join(b, ["field_name", "look", "spelling_b"])
    return pairs.select(F.least("a", "b").alias(f"{key}_a"), F.greatest("a", "b").alias(f"{key}_b"), "field_name")


def same_look_classes(df: DataFrame, key: str = "row_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(key, field_name, look, n_links): every text that another row shows in other characters, its class, and the number of such rows. Nothing is expanded into pairs."""
    forms = written(canonical_forms(df, key, fields).select(key, "field_name", F.md5("visible_form").alias("look"), F.md5("raw_text").alias("spelling")))
    each = forms.groupBy("field_name", "look", "spelling").agg(F.count("*").alias("_same"))
    several = each.groupBy("field_name", "look").agg(F.sum("_same").alias("_all"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    links = each.join(several, ["field_name", "look"]).select("field_name", "look", "spelling", (F.col("_all") - F.col("_same")).alias("n_links"))
    return forms.join(links, ["field_name", "look", "spelling"]).select(key, "field_name", "look", "n_links")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_look_pairs(table(spark, sf_dir, "questions"))


def p2_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in its consistent form."""
    return canonical_forms(table(spark, sf_dir, "questions")).select("row_id", "field_name", "canonical")


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_look_classes(table(spark, sf_dir, "questions"))


QUERIES = {"p2_found": p2_found, "p2_classes": p2_classes, "p2_canonical": p2_canonical}
SQL: dict[str, str] = {}
