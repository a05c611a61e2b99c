"""Files in and out: document folders, JSON lines, annotation logs, review sheets, caches, models, manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators.confidence import check_model

QUESTION = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("qid", "parallel_id", "language", "script", "domain", "question", "answerability", "question_type", "gold_answer")],
    T.StructField("gold_chunk_ids", T.ArrayType(T.StringType())), T.StructField("should_abstain", T.BooleanType()), T.StructField("provenance", T.StringType()),
    T.StructField("qc", T.StructType([T.StructField("human_reviewed", T.BooleanType()), T.StructField("roundtrip_similarity", T.DoubleType()), T.StructField("entities_preserved", T.BooleanType())])),
    T.StructField("split", T.StringType()), T.StructField("dataset_version", T.StringType()), T.StructField("evidence_languages", T.ArrayType(T.StringType())),
])
EVENT = T.StructType([
    T.StructField("seq", T.LongType()), *[T.StructField(n, T.StringType()) for n in ("event_type", "item_id", "qid", "language", "question", "claim")], T.StructField("evidence", T.ArrayType(T.StringType())),
    *[T.StructField(n, T.StringType()) for n in ("system_name", "label", "source", "annotator")], T.StructField("confidence", T.DoubleType()), T.StructField("note", T.StringType()), T.StructField("event_time", T.StringType()),
])
MAX_FILE_BYTES = 2_000_000


def documents(spark: SparkSession, root: str, glob: str = "*.{md,txt}", max_file_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(doc_id, path, language, text, sha256) of the text files below root; the first folder names the language.

    Line ends become \\n and a byte order mark goes before the text is hashed; doc_id is 'path@first 12 digits of the
    hash'. Larger files and files that hold a NUL are left out (see rejected_documents). One file is one row.
    """
    rows = _files(spark, root, glob).where((F.col("length") <= max_file_bytes) & ~F.contains("content", F.lit(b"\x00")))
    text = F.regexp_replace(F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", ""), "\r\n?", "\n")
    rows = rows.select("path", text.alias("text")).withColumn("sha256", F.sha2("text", 256))
    return rows.select(F.concat("path", F.lit("@"), F.substring("sha256", 1, 12)).alias("doc_id"), "path", F.split("path", "/")[0].alias("language"), "text", "sha256")


def rejected_documents(spark: SparkSession, root: str, glob: str = "*.{md,txt}", max_file_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(path, reason) of the files that documents() leaves out."""
    reason = F.when(F.col("length") > max_file_bytes, "too large").when(F.contains("content", F.lit(b"\x00")), "not text")
    return _files(spark, root, glob).select("path", reason.alias("reason")).where("reason IS NOT NULL")


def _files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    base = root.split("://")[-1].rstrip("/")
    return rows.withColumn("path", F.regexp_replace("path", rf"^.*\Q{base}\E/", ""))


def file_manifest(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, sha256, bytes) of every file below root."""
    return _files(spark, root, glob).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a JSON lines file; blank lines are skipped, lines that do not parse come out as they are."""
    marked = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    ok = F.col("r").isNotNull() & F.col("r._corrupt_record").isNull()
    return parsed.where(ok).select("r.*").drop("_corrupt_record"), parsed.where(~ok).select(F.col("value").alias("line"))


def questions(spark: SparkSession, path: str) -> DataFrame:
    """The questions of a JSON lines file; a line that does not parse is an error when the rows are read."""
    return spark.read.schema(QUESTION).option("mode", "FAILFAST").json(path)


def annotation_log(spark: SparkSession, path: str) -> DataFrame:
    """The events of an append-only log; lines that do not parse are left out."""
    return json_lines(spark, path, EVENT)[0]


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def write_json(df: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines sorted over all files by the given columns."""
    df.orderBy(*order).write.mode("overwrite").json(path)


def write_review_sheet(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def read_review_sheet(spark: SparkSession, path: str, key: str = "item_id") -> DataFrame:
    """(key, mark, score): correct 1, partial 0.5, incorrect 0; another mark fails the read, a blank one is no mark."""
    rows = spark.read.option("header", True).csv(path).where(F.trim("mark") != "")
    m = F.lower(F.trim("mark"))
    score = F.when(m == "correct", 1.0).when(m == "partial", 0.5).when(m == "incorrect", 0.0).otherwise(F.raise_error(F.concat(F.lit("invalid mark: "), m)).cast("double"))
    return rows.select(key, m.alias("mark"), score.alias("score"))


def cache_keys(requests: DataFrame, columns: list[str]) -> DataFrame:
    """requests with `key`, the content address of the given columns, and the shard that it lies in."""
    key = X.fingerprint(*[F.col(c) for c in sorted(columns)])
    return requests.withColumn("key", key).withColumn("shard", F.substring("key", 1, 2))


def cache_store(responses: DataFrame, path: str) -> None:
    """Appends (key, shard, response) rows, in folders by shard."""
    responses.select("key", "response", "shard").write.mode("append").partitionBy("shard").parquet(path)


def cache_lookup(requests: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(hits with their response, misses); of several stored responses of a key one counts."""
    stored = requests.sparkSession.read.schema("key string, response string, shard string").parquet(path)
    one = stored.groupBy("shard", "key").agg(F.min("response").alias("response"))
    return requests.join(one, ["shard", "key"]), requests.join(one, ["shard", "key"], "left_anti")


def cache_statistics(spark: SparkSession, path: str) -> DataFrame:
    """(shard, entries, bytes) of a cache."""
    stored = spark.read.schema("key string, response string, shard string").parquet(path)
    return stored.groupBy("shard").agg(F.count_distinct("key").alias("entries"), F.sum(F.octet_length("response")).alias("bytes"))


def save_model(spark: SparkSession, model: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(model, sort_keys=True),)], "model string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str, known: list[str]) -> dict:
    """A saved model, one row; refused if it names unknown features."""
    return check_model(json.loads(spark.read.text(path).first()[0]), known)


def write_experiment(records: DataFrame, path: str, config: dict) -> None:
    """records, their manifest (configuration, row count and a hash that does not depend on the order of rows)."""
    records.write.mode("overwrite").parquet(f"{path}/records")
    spark = records.sparkSession
    kept = spark.read.parquet(f"{path}/records")
    facts = kept.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(F.xxhash64(*kept.columns)), F.lit(0)).alias("checksum"))
    facts.withColumn("config", F.lit(json.dumps(config, sort_keys=True))).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def complete_evidence(items: DataFrame, corpus: DataFrame, key: str = "item_id", ids: str = "evidence") -> DataFrame:
    """(key, passages) with every cited chunk's text in order; an id that the corpus lacks fails the job, as a packet must be complete."""
    rows = items.select(key, F.posexplode(ids).alias("place", "chunk_id")).join(corpus.select("chunk_id", "text"), "chunk_id", "left")
    text = F.when(F.col("text").isNull(), F.raise_error(F.concat(F.lit("chunk not in corpus: "), F.col("chunk_id"))).cast("string")).otherwise(F.col("text"))
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", text.alias("text")))), lambda x: x["text"]).alias("passages"))
