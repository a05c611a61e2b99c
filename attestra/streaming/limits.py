"""Sessions, sliding windows and budgets over event tables and streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.ranking import spread
from ..session import written


def timed(events: DataFrame, ts: str = "ts") -> DataFrame:
    """events with a zoned timestamp, which watermarks need."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """(user, session_start, session_end, n): a session ends when nothing follows within the gap. Works on batches and, behind a watermark, on streams.

    A batch is first cut into the sessions inside each hour, then those of a user are joined where less than the gap lies
    between them; so no task sorts all events of a user, only his few sessions by hour.
    """
    rows = events.where(F.col(ts).isNotNull())
    if events.isStreaming:
        by = rows.groupBy(user, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("n"))
        return by.select(user, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")
    pause = F.expr(f"INTERVAL {gap}")

    def joined(spans: DataFrame, *keys: str) -> DataFrame:
        order = W.partitionBy(*keys).orderBy("_a", "_z")
        new = F.coalesce(F.col("_a") >= F.lag("_z").over(order) + pause, F.lit(True)).cast("int")
        numbered = spans.withColumn("_new", new).withColumn("_no", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
        return numbered.groupBy(*keys, "_no").agg(F.min("_a").alias("_a"), F.max("_z").alias("_z"), F.sum("_n").alias("_n")).drop("_no")

    hours = joined(rows.select(user, F.date_trunc("hour", F.col(ts)).alias("_hour"), F.col(ts).alias("_a"), F.col(ts).alias("_z"), F.lit(1).alias("_n")), user, "_hour")
    return joined(hours.drop("_hour"), user).select(user, F.col("_a").alias("session_start"), (F.col("_z") + pause).alias("session_end"), F.col("_n").alias("n"))


def sliding_counts(events: DataFrame, key: str = "user_id", ts: str = "ts", seconds: int = 60, value: str | None = None) -> DataFrame:
    """events with the number (and the sum of a value) of the key's events in the last seconds, the event itself included.

    Time is cut into slots of that length. An event is counted in its own slot and, without its other columns, in the next
    one, so a task sorts two slots of a key and never all of its events. Events without a time count each other.
    """
    width = seconds * 1_000_000
    rows = events.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("_slot", F.floor(F.col("_t") / width))
    thin = [key, "_t", *([value] if value else [])]
    before = rows.where("_t IS NOT NULL").select(*dict.fromkeys(thin), (F.col("_slot") + 1).alias("_slot"), F.lit(True).alias("_before"))
    both = rows.withColumn("_before", F.lit(False)).unionByName(before, allowMissingColumns=True)
    w = W.partitionBy(key, "_slot").orderBy("_t").rangeBetween(-width, 0)
    out = both.withColumn("in_window", F.count("*").over(w))
    out = out.withColumn("sum_in_window", F.sum(value).over(w)) if value else out
    return out.where("NOT _before").drop("_t", "_slot", "_before")


def within_limits(events: DataFrame, per_minute: int, amount_per_minute: float, per_day: int, key: str, value: str, ts: str = "ts", tie: str = "event_id", margin: float = 0.95) -> DataFrame:
    """events with `minute_ok`, `amount_ok` and `day_ok`: whether a key's requests and their amount of the last minute, and its requests of the UTC day, stay within the limits less a margin."""
    least = lambda n: int(n * margin)
    rows = sliding_counts(events, key, ts, 60, value)
    rows = daily_places(rows, ts, tie, key)
    return rows.select(*events.columns, (F.col("in_window") <= least(per_minute)).alias("minute_ok"), (F.col("sum_in_window") <= F.lit(float(least(amount_per_minute)))).alias("amount_ok"), (F.col("place") <= least(per_day)).alias("day_ok"))


def daily_places(events: DataFrame, ts: str = "ts", tie: str = "event_id", key: str | None = None) -> DataFrame:
    """events with their place in the UTC day (of a key, if one is given), counted from 1: the minutes of a day are counted first, so that no task sorts a whole day."""
    keys = [key] if key else []
    rows = events.withColumn("day", F.to_date(ts)).withColumn("_slot", F.date_trunc("minute", F.col(ts)))
    counts = rows.groupBy(*[F.col(k).alias("_key") for k in keys], F.col("day").alias("_day"), F.col("_slot").alias("_s")).agg(F.count("*").alias("_n"))
    before = W.partitionBy("_day", *["_key" for _ in keys]).orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(*["_key" for _ in keys], "_day", "_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    place = F.row_number().over(W.partitionBy(*keys, "day", "_slot").orderBy(ts, tie))
    same = (F.col("day") == F.col("_day")) & (F.col("_slot") == F.col("_s"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col("_key"))
    return rows.join(counts, same).withColumn("place", F.col("_off") + place).drop("_slot", "_day", "_s", "_off", "_key")


def request_metrics(events: DataFrame, by: str = "event_type", value: str = "value") -> DataFrame:
    """(by, n, total, mean); names that are not given count as other."""
    return events.groupBy(F.coalesce(by, F.lit("other")).alias(by)).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"), F.round(F.avg(value), 6).alias("mean"))


def admitted(events: DataFrame, limit: int, seconds: int, key: str = "user_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """events with `admitted`: a request passes if fewer than `limit` admitted ones of its key lie in the last seconds.

    Refused requests use nothing up, so this is a scan in time order and no window. A key's times are cut wherever a whole
    slot of that length is empty, as nothing before it matters then; the pieces are scanned in sorted partitions with the
    last admissions as the only state, and no key is ever gathered. Events without a time are refused.
    """
    micros, width = F.unix_micros(F.col(ts).cast("timestamp")), seconds * 1_000_000
    kinds = dict(events.dtypes)
    rows = events.where(F.col(ts).isNotNull()).select(key, tie, micros.alias("_t")).withColumn("_slot", F.floor(F.col("_t") / width))
    slots = rows.groupBy(F.col(key).alias("_k"), F.col("_slot").alias("_s")).agg(F.count("*").alias("_n"))
    by = W.partitionBy("_k").orderBy("_s")
    slots = slots.withColumn("_new", (F.col("_s") - F.lag("_s", 1, -2).over(by) > 1).cast("int"))
    slots = slots.withColumn("_piece", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0))).select("_k", "_s", "_piece")
    pieces = rows.join(slots, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_slot") == F.col("_s"))).select(key, "_piece", tie, "_t")
    dealt = spread(pieces, key, "_piece").sortWithinPartitions(key, "_piece", "_t", tie)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last = None, []
        for pdf in batches:
            yes = []
            for k, p, t in zip(pdf[key].tolist(), pdf["_piece"].tolist(), pdf["_t"].tolist()):
                if (k, p) != at:
                    at, last = (k, p), []
                last = [x for x in last if x > t - width]
                yes.append(len(last) < limit)
                if yes[-1]:
                    last.append(t)
            yield pd.DataFrame({tie: pdf[tie], "_yes": yes})

    found = dealt.mapInPandas(run, f"{tie} {kinds[tie]}, _yes boolean")
    return events.join(found, tie, "left").withColumn("admitted", F.coalesce("_yes", F.lit(False))).drop("_yes")


def admitted_with_budget(events: DataFrame, limit: int, seconds: int, per_day: int, key: str = "user_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """events with `admitted` as in admitted(), where all keys share a budget of `per_day` admissions in a UTC day; a refused request uses neither up.

    Once the budget of a day is spent, the rest of the day is refused. Where that is depends on the key windows alone, and
    those on the days before only through their last seconds: the admissions are found without the budget, each day is cut
    at its last one that the budget covers, and what the cuts change is found again until no cut moves. Each round settles
    at least one more day that runs out, and a day is one small row; usually the second round changes nothing.
    """
    rows = written(events.withColumn("_day", F.to_date(ts)))
    cuts = None
    while True:
        cut = F.struct(F.col(ts).alias("t"), F.col(tie).alias("e"))
        within = rows if cuts is None else rows.join(F.broadcast(cuts), "_day", "left").where(F.col("_last").isNull() | (cut <= F.col("_last"))).drop("_last")
        passed = written(admitted(within, limit, seconds, key, ts, tie))
        placed = daily_places(passed.where("admitted").select(F.col(ts), F.col(tie)), ts, tie)
        new = written(placed.where(F.col("place") == per_day).select(F.col("day").alias("_day"), cut.alias("_last")))
        if cuts is not None and new.exceptAll(cuts).isEmpty() and cuts.exceptAll(new).isEmpty():
            break
        cuts = new
    return events.join(passed.where("admitted").select(tie, F.lit(True).alias("_yes")), tie, "left").withColumn("admitted", F.coalesce("_yes", F.lit(False))).drop("_yes")


def stream(spark: SparkSession, folder: str, schema, glob: str | None = None) -> DataFrame:
    """A stream over the Parquet files of a folder."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(folder)


def run_available(df: DataFrame, mode: str, checkpoint: str, sink: str) -> None:
    """Runs a stream over what is there now into a Parquet sink (append) or a replaced table (complete), and waits for it."""
    writer = df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint)
    if mode == "append":
        writer.format("parquet").option("path", sink).start().awaitTermination()
    else:
        writer.foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(sink)).start().awaitTermination()


def closed_sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """The streaming form of sessions(): a session comes out once the watermark has passed its end."""
    return sessions(timed(events, ts).withWatermark(ts, late), user, ts, gap)


def admitted_stream(events: DataFrame, limit: int, seconds: int, key: str = "user_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The streaming form of admitted(): (key, tie, admitted), with a key's last admissions as its state, which the checkpoint keeps over restarts.

    The requests of a key that one trigger reads are sorted in memory; maxFilesPerTrigger bounds them.
    """
    out = f"{key} {dict(events.dtypes)[key]}, {tie} {dict(events.dtypes)[tie]}, admitted boolean"

    def run(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values([ts, tie])
        verdicts = []
        for t in rows[ts].astype("datetime64[us]").astype("int64"):
            last = [x for x in last if x > t - seconds * 1_000_000]
            verdicts.append(len(last) < limit)
            if verdicts[-1]:
                last.append(int(t))
        state.update((last,))
        yield pd.DataFrame({key: k[0], tie: rows[tie], "admitted": verdicts})

    return events.where(F.col(ts).isNotNull()).select(key, tie, ts).groupBy(key).applyInPandasWithState(run, out, "last array<bigint>", "append", "NoTimeout")
