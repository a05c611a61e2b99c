"""Distributed places and running totals, safe against a group that holds a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df hash-partitioned by keys into as many parts as shuffles have. Before heavy expressions over small rows: a given number of parts is not coalesced by AQE, and joins and groupings by the same keys reuse it."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def fill_cores(scan: DataFrame) -> DataFrame:
    """A table scan dealt out anew where its files make fewer parts than there are cores (a few small files before heavy expressions). Larger tables have parts enough and are left as they are, so no text is moved at scale."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def hash_sample(df: DataFrame, order: Column, n: int) -> DataFrame:
    """About n rows (all of them if there are fewer): those whose hash (BIGINT, of a unique key) lies in the lowest n-th part of its range.

    The choice does not depend on partitions, and what a task passes on is its share of n; a global top-n would send n rows of every task to the driver.
    """
    total = df.count()
    if total <= n:
        return df
    span = int((n / total) * 2**63)
    return df.where(order.bitwiseAND(F.lit(2**63 - 1)) < F.lit(span))


def hash_place(df: DataFrame, keys: list[str], order: Column, place: str, tie: list[str]) -> DataFrame:
    """df with the place of each row in its group, from 0, in the order of a hash (BIGINT), ties by the columns `tie`.

    Rows are counted by (group, leading ten bits of the hash), the counts summed to an offset per bucket, and only the rows of one bucket
    sorted together. NULL keys form a group.
    """
    df = df.withColumn("_order", order).withColumn("_bucket", F.shiftright("_order", 54))
    names = [f"_k{i}" for i in range(len(keys))]
    counts = df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("_bucket").alias("_b")).agg(F.count("*").alias("_n"))
    before = W.partitionBy(*names).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(*names, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)] + [F.col("_bucket") == F.col("_b")]
    inner = F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy("_order", *tie))
    return df.join(counts, same).withColumn(place, F.col("_offset") + inner - 1).drop("_order", "_bucket", "_offset", "_b", *names)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, place: str = "place") -> DataFrame:
    """The first k rows of each group with their place from 0. row_number() <= k plans a group limit before the shuffle, so a hot group is cut map-side."""
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= k)
    return ranked.withColumn(place, F.col("_rank") - 1).drop("_rank")


def _below(value: Column, bounds: list, first: int = 0) -> Column:
    """How many of the sorted bounds lie below a value, 0 for NULL: a search by halves."""
    if not bounds:
        return F.lit(first)
    mid = len(bounds) // 2
    return F.when(value > F.lit(bounds[mid]), _below(value, bounds[mid + 1 :], first + mid + 1)).otherwise(_below(value, bounds[:mid], first))


def running_total(df: DataFrame, order: str, value: str, total: str, by: list[str] | None = None, parts: int = 64) -> DataFrame:
    """df with the sum of `value` over all rows (of a group, if `by` is given) up to each row in the order of a column of numbers; equal numbers have one total.

    Rows are dealt to parts by fixed bounds on the number, some quantiles of it, so that a row's part follows from its value
    alone and is the same whenever it is computed. Sums by group and part give each part its offset; no task sees all rows,
    nor all of a group that spreads over the range. NULL is the lowest number and NULL values add nothing.
    """
    keys = [f"_k{i}" for i in range(len(by or []))]
    quantiles = df.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 20 * parts)).first()[0] or []
    rows = df.withColumns({k: F.col(b) for k, b in zip(keys, by or [])}).withColumn("_part", _below(F.col(order), sorted(set(quantiles))))
    sums = rows.groupBy(*keys, "_part").agg(F.sum(value).alias("_s"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("_part").alias("_p"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"))
    same = [F.col("_part") == F.col("_p"), *[F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]]
    inside = F.coalesce(F.sum(value).over(W.partitionBy(*keys, "_part").orderBy(order)), F.lit(0))
    return rows.join(sums, same).withColumn(total, F.col("_off") + inside).drop("_part", "_p", "_off", *keys, *[f"{k}_" for k in keys])


def nearest_ranks(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by.., one column per share): the smallest value that at least the share of a group's rows do not exceed, NULLs aside.

    Values are counted first and their counts summed up part by part, so that no task holds the values of a group.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    steps = running_total(counts, value, "_c", "_upto", by)
    names = [f"_g{i}" for i in range(len(by))]
    sizes = counts.groupBy(*[F.col(b).alias(n) for b, n in zip(by, names)]).agg(F.sum("_c").alias("_n"))
    both = steps.join(sizes, [F.col(b).eqNullSafe(F.col(n)) for b, n in zip(by, names)]) if by else steps.join(F.broadcast(sizes))
    return both.groupBy(*by).agg(*[F.min(F.when(F.col("_upto") >= F.ceil(F.col("_n") * s), F.col(value))).alias(n) for n, s in shares.items()])
