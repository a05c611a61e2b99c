"""What a session needs before the library's Arrow and pandas functions run in its workers."""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers that see this folder import the package (elsewhere ship it with --py-files). Safe to call again."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


_FOLDERS: dict[str, tuple[SparkSession, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, in one folder for each application.

    Where that setting is missing a local session takes /tmp; on a cluster, where /tmp is another folder on each machine, it
    is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        base = "file:///tmp"
    home = f"{base.rstrip('/')}/attestra-{spark.sparkContext.applicationId}"
    if home not in _FOLDERS:
        if not _FOLDERS:
            atexit.register(release)
        _FOLDERS[home] = (spark, home)
    return f"{home}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder: cuts the lineage, survives the loss of an executor, is computed once. The tables go with release()."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Deletes the tables that written() made, once no result that reads them is needed any more; also done as Python ends."""
    while _FOLDERS:
        spark, home = _FOLDERS.popitem()[1]
        try:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(home)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session is over already: its folder is left to whoever clears the shared one
            continue


def local_session(name: str = "attestra", cores: str = "8", partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    conf = {
        "spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": os.environ.get("ATTESTRA_DRIVER_MEMORY", "6g"), "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.showConsoleProgress": "false",
    }
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)
