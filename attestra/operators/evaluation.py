"""Metrics of systems: classification, retrieval, abstention, intervals, gates."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import written
from .confidence import BINS, bins, expected_error
from .ranking import nearest_ranks

RESAMPLES, SEED = 2000, 42
SHARD = 20_000  # distinct values that one task draws from


def rate(hits: Column, of: Column) -> Column:
    """hits / of, 0 where there is nothing to count."""
    return F.when(of > 0, hits / of).otherwise(0.0)


def confusion(pairs: DataFrame, gold: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """(by.., gold, pred, n) of the rows where both are given."""
    return pairs.where(F.col(gold).isNotNull() & F.col(pred).isNotNull()).groupBy(*(by or []), F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def classification(counts: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support, accuracy, macro_f1) for every label that is gold or predicted, from confusion counts."""
    as_label = F.explode(F.array(F.struct(F.col("gold").alias("label"), F.col("n").alias("g"), F.lit(0).alias("p")), F.struct(F.col("pred").alias("label"), F.lit(0).alias("g"), F.col("n").alias("p"))))
    both = counts.select(as_label.alias("x"), F.lit(0).alias("t")).select("x.*", "t")
    hits = counts.where("gold = pred").select(F.col("gold").alias("label"), F.lit(0).alias("g"), F.lit(0).alias("p"), F.col("n").alias("t"))
    each = both.unionByName(hits).groupBy("label").agg(F.sum("g").alias("support"), F.sum("p").alias("predicted"), F.sum("t").alias("hits"))
    p, r = rate(F.col("hits"), F.col("predicted")), rate(F.col("hits"), F.col("support"))
    each = each.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))
    every = W.partitionBy()  # a handful of labels
    return each.withColumn("macro_f1", F.avg("f1").over(every)).withColumn("accuracy", rate(F.sum("hits").over(every), F.sum("support").over(every))).drop("predicted", "hits")


def kappa(counts: DataFrame, by: list[str], labels: list[str]) -> DataFrame:
    """(by.., n, agreement, kappa) over the given labels, from confusion counts; chance agreement of 1 gives 1."""
    rows = counts.where(F.col("gold").isin(labels) & F.col("pred").isin(labels))
    n = F.sum("n")
    marg = [F.sum(F.when(F.col(side) == x, F.col("n")).otherwise(0)) for x in labels for side in ("gold", "pred")]
    pe = sum((marg[2 * i] / n) * (marg[2 * i + 1] / n) for i in range(len(labels)))
    po = F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)) / n
    return rows.groupBy(*by).agg(n.alias("n"), po.alias("agreement"), F.when(pe >= 1, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def retrieval_quality(rows: DataFrame, by: list[str], key: str, retrieved: str, gold: str, k: int = 5) -> DataFrame:
    """(by.., n, recall, ndcg, mrr, empty_rate): means over rows with gold ids; rows without count in n and empty_rate is the share without any result.

    Each row is judged inside itself by array functions: no row is multiplied, nothing is joined.
    """
    got, want = F.slice(F.coalesce(F.col(retrieved), F.array().cast("array<string>")), 1, k), F.array_distinct(F.coalesce(F.col(gold), F.array().cast("array<string>")))
    place = F.filter(F.transform(got, lambda c, i: F.when(F.array_contains(want, c), i)), lambda i: i.isNotNull())
    dcg = F.aggregate(place, F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 2))
    ideal = F.aggregate(F.sequence(F.lit(0), F.least(F.size(want), F.lit(k)) - 1), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 2))
    one = rows.select(*by, key, (F.size(want) > 0).alias("judged"), (F.size(got) == 0).alias("empty"), (F.size(F.array_intersect(got, want)) / F.greatest(F.size(want), F.lit(1))).alias("recall"), F.when(F.size(want) > 0, dcg / ideal).alias("ndcg"), F.when(F.size(place) > 0, 1 / (F.element_at(place, 1) + 1)).otherwise(0.0).alias("rr"))
    mean = lambda c: F.coalesce(F.avg(F.when(F.col("judged"), F.col(c))), F.lit(0.0))
    return one.groupBy(*by).agg(F.count("*").alias("n"), mean("recall").alias("recall"), mean("ndcg").alias("ndcg"), mean("rr").alias("mrr"), F.avg(F.col("empty").cast("double")).alias("empty_rate"))


def abstention(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by.., n, rate, precision, recall, over_abstention) from abstained and should_abstain; NULL in either leaves the row out."""
    a, s = F.col("abstained"), F.col("should_abstain")
    tp, fp, said, should = F.count_if(a & s), F.count_if(a & ~s), F.count_if(a), F.count_if(s)
    n = F.count("*")
    return rows.where(a.isNotNull() & s.isNotNull()).groupBy(*by).agg(
        n.alias("n"), rate(said, n).alias("abstention_rate"), rate(tp, said).alias("abstention_precision"), rate(tp, should).alias("abstention_recall"), rate(fp, n - should).alias("over_abstention_rate")
    )


def holm(tests: DataFrame, p: str = "p", by: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """tests with `rank`, `limit` and `significant` by the step-down rule: the first p above its limit stops all that follow."""
    part = W.partitionBy(*(by or []))
    names = [c for c in tests.columns if c != p]
    ordered = part.orderBy(p, *names)
    rows = tests.withColumn("rank", F.row_number().over(ordered)).withColumn("limit", F.lit(alpha) / (F.count("*").over(part) - F.col("rank") + 1))
    ok = F.min((F.col(p) <= F.col("limit")).cast("int")).over(ordered.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("significant", ok == 1)


def gaps(values: DataFrame, by: list[str], group: str, value: str, reference: str, higher_is_better: bool = True) -> DataFrame:
    """values with `gap` to the reference group, relative to it and negative where worse; a reference of 0 gives 0."""
    ref = values.where(F.col(group) == reference).select(*by, F.col(value).alias("_ref"))
    sign = 1 if higher_is_better else -1
    gap = F.when(F.coalesce(F.col("_ref"), F.lit(0.0)) == 0, 0.0).otherwise(sign * (F.col(value) - F.col("_ref")) / F.abs(F.col("_ref")))
    return values.join(ref, by, "left").withColumn("gap", gap).drop("_ref")


def resampled(rows: DataFrame, by: list[str], columns: list[Column], resamples: int = RESAMPLES, seed: int = SEED, shard: int = SHARD, expand: Callable[[np.ndarray], np.ndarray] | None = None, width: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((_key, i, s0, s1, ..), (_key, by.., n)): the sums of the columns over each bootstrap resample of a group's rows, and the groups.

    `expand` may turn the matrix of values (row x column) into another one of `width` columns whose sums are wanted instead.

    Rows of equal values are counted first. A resample of n rows is one multinomial draw over a group's distinct values, as if
    rows were drawn one by one. A group of more than `shard` values is cut by a hash into 2^levels pieces; which share of a
    resample falls to a piece is drawn by halves down a binary tree with a seed for each node, so that all pieces agree
    without meeting, and the result is the same multinomial draw. No task sees more than a piece.
    """
    vs, sums = [f"_v{i}" for i in range(len(columns))], [f"s{i}" for i in range(width or len(columns))]
    named = rows.select(F.to_json(F.struct(*[F.col(b) for b in by])).alias("_key"), *by, *[c.cast("double").alias(v) for c, v in zip(columns, vs)]).dropna(subset=vs)
    counted = written(named.groupBy("_key", *by, *vs).agg(F.count("*").alias("_c")))
    groups = counted.groupBy("_key", *by).agg(F.sum("_c").alias("n"))
    large = counted.groupBy("_key").agg(F.count("*").alias("_d")).where(F.col("_d") > shard).select("_key", F.ceil(F.log2(F.col("_d") / shard)).cast("int").alias("_levels"))
    dealt = counted.select("_key", *vs, "_c").join(large, "_key", "left").fillna(0, ["_levels"])
    dealt = dealt.withColumn("_shard", F.pmod(F.xxhash64(*vs), F.expr("shiftleft(1L, _levels)")))
    pieces = dealt.groupBy("_key", "_shard", "_levels").agg(F.sum("_c").alias("_n"))
    # rows that hang below each node of a group's tree, and below the left child of each node on the way to a piece
    nodes = pieces.withColumn("_l", F.explode(F.expr("sequence(0, _levels)"))).groupBy("_key", "_l", F.expr("shiftright(_shard, _levels - _l)").alias("_node")).agg(F.sum("_n").alias("_m"))
    lefts = nodes.where("_node % 2 = 0").select("_key", (F.col("_l") - 1).alias("_l"), F.shiftright("_node", 1).alias("_node"), F.col("_m").alias("_left"))
    way = pieces.withColumn("_l", F.explode_outer(F.expr("CASE WHEN _levels > 0 THEN sequence(0, _levels - 1) END"))).withColumn("_node", F.expr("shiftright(_shard, _levels - _l)"))
    way = way.join(nodes, ["_key", "_l", "_node"], "left").join(lefts, ["_key", "_l", "_node"], "left")
    step = F.struct(F.col("_l").alias("l"), (F.coalesce("_left", F.lit(0)) / F.col("_m")).alias("p"))
    way = way.groupBy("_key", "_shard", "_levels").agg(F.array_sort(F.collect_list(F.when(F.col("_l").isNotNull(), step))).alias("_way"))
    way = way.join(groups.select("_key", "n"), "_key").select("_key", "_shard", "n", "_levels", F.transform("_way", lambda x: x["p"]).alias("_way"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(vs)
        key, piece, levels, way_ = pdf["_key"].iloc[0], int(pdf["_shard"].iloc[0]), int(pdf["_levels"].iloc[0]), pdf["_way"].iloc[0]
        start = [seed, zlib.crc32(key.encode())]
        n = np.full(resamples, int(pdf["n"].iloc[0]), dtype=np.int64)
        for level, p in enumerate(way_):
            node = piece >> (levels - level)
            left = np.random.default_rng([*start, level, node]).binomial(n, p)
            n = n - left if (piece >> (levels - level - 1)) & 1 else left
        v, c = pdf[vs].to_numpy(float), pdf["_c"].to_numpy(float)
        v = v if expand is None else expand(v)
        rng = np.random.default_rng([*start, levels, piece])
        size = max(1, 2_000_000 // len(c))
        drawn = np.concatenate([rng.multinomial(n[i : i + size], c / c.sum()) @ v for i in range(0, resamples, size)])
        return pd.DataFrame({"_key": key, "i": np.arange(resamples), **{x: drawn[:, k] for k, x in enumerate(sums)}})

    drawn = dealt.drop("_levels").join(way, ["_key", "_shard"]).groupBy("_key", "_shard").applyInPandas(run, f"_key string, i int, {', '.join(f'{x} double' for x in sums)}")
    return drawn.groupBy("_key", "i").agg(*[F.sum(x).alias(x) for x in sums]), groups


def interval(drawn: DataFrame, groups: DataFrame, by: list[str], statistic: Column, resamples: int = RESAMPLES, alpha: float = 0.05) -> DataFrame:
    """(by.., n, low, high, p_value) of a statistic of each resample: its percentiles, and twice the smaller share of resamples on one side of 0."""
    each = drawn.join(groups.select("_key", "n"), "_key").select("_key", statistic.alias("x"))
    got = each.groupBy("_key").agg(F.array_sort(F.collect_list("x")).alias("x"), F.count_if(F.col("x") <= 0).alias("below"), F.count_if(F.col("x") >= 0).alias("above"))
    low, high = int(alpha / 2 * resamples) + 1, min(resamples - 1, int((1 - alpha / 2) * resamples)) + 1
    tail = F.least(F.lit(1.0), 2 * F.least((F.col("below") + 1) / (resamples + 1), (F.col("above") + 1) / (resamples + 1)))
    return groups.join(got, "_key").select(*by, "n", F.element_at("x", low).alias("low"), F.element_at("x", high).alias("high"), tail.alias("p_value"))


def bootstrap_mean(rows: DataFrame, by: list[str], value: str, resamples: int = RESAMPLES, alpha: float = 0.05, seed: int = SEED, shard: int = SHARD) -> DataFrame:
    """(by.., n, mean, low, high, p_value): percentile interval of the mean of a group's rows, NULLs left out."""
    drawn, groups = resampled(rows, by, [F.col(value)], resamples, seed, shard)
    names = [f"_g{i}" for i in range(len(by))]
    means = rows.where(F.col(value).isNotNull()).groupBy(*[F.col(b).alias(n) for b, n in zip(by, names)]).agg(F.avg(F.col(value).cast("double")).alias("mean"))
    out = interval(drawn, groups, by, F.col("s0") / F.col("n"), resamples, alpha)
    return out.join(means, [F.col(b).eqNullSafe(F.col(n)) for b, n in zip(by, names)]).select(*by, "n", "mean", "low", "high", "p_value")


def calibration_interval(scored: DataFrame, by: list[str], p: str = "p", y: str = "y", n: int = BINS, resamples: int = RESAMPLES, alpha: float = 0.05, seed: int = SEED) -> DataFrame:
    """(by.., n, ece, low, high): the expected calibration error with the percentile interval of its bootstrap."""

    def gaps_by_bin(v: np.ndarray) -> np.ndarray:
        gap = v[:, 0] - v[:, 1]
        return np.stack([np.where(((v[:, 0] > lo) if i else (v[:, 0] >= lo)) & (v[:, 0] <= hi), gap, 0.0) for i, lo, hi in bins(n)], 1)

    drawn, groups = resampled(scored, by, [F.col(p), F.col(y)], resamples, seed, expand=gaps_by_bin, width=n)
    error = sum((F.abs(F.col(f"s{i}")) for i in range(n)), F.lit(0.0)) / F.col("n")
    got = interval(drawn, groups, by, error, resamples, alpha).drop("p_value", "n")
    names = [f"_g{i}" for i in range(len(by))]
    point = expected_error(scored, by, p, y, n).select(*[F.col(b).alias(x) for b, x in zip(by, names)], "n", "ece")
    return got.join(point, [F.col(b).eqNullSafe(F.col(x)) for b, x in zip(by, names)]).select(*by, "n", "ece", "low", "high")


def paired(rows: DataFrame, key: list[str], system: str, value: str, base: str, order: str) -> DataFrame:
    """(system, key.., difference) of each system to the base on the same key; of several runs the last counts."""
    latest = rows.where(F.col(value).isNotNull()).groupBy(system, *key).agg(F.max_by(F.col(value).cast("double"), order).alias("v"))
    b = latest.where(F.col(system) == base).select(*key, F.col("v").alias("_b"))
    return latest.where(F.col(system) != base).join(b, key).select(system, *key, (F.col("v") - F.col("_b")).alias("difference"))


def experiment(records: DataFrame, by: list[str]) -> DataFrame:
    """(by.., n, failures, all_failed, answered, ...) of runs; failed runs count in n and failures only."""
    ok = F.col("error_text").isNull()
    answered = ok & ~F.coalesce(F.col("abstained"), F.lit(False))
    mean = lambda cond, c: F.avg(F.when(cond, F.col(c)))
    a, r = F.coalesce(F.sum(F.when(ok, F.col("correction_attempts"))), F.lit(0)), F.coalesce(F.sum(F.when(ok, F.col("correction_regressions"))), F.lit(0))
    n_ok = F.count_if(ok)
    return records.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(~ok).alias("failures"), (n_ok == 0).alias("all_failed"), F.count_if(answered).alias("answered"),
        F.round(mean(answered, "hallucination_rate"), 6).alias("answered_hallucination_rate"), F.round(mean(ok, "confidence"), 6).alias("mean_confidence"),
        F.round(rate(F.count_if(ok & F.col("abstained")), n_ok), 6).alias("abstention_rate"), F.round(rate(r, a), 6).alias("regression_rate"), F.round(mean(ok, "latency_ms"), 3).alias("mean_latency_ms"),
    )


def grouping_sets(records: DataFrame) -> DataFrame:
    """The behaviour of runs by two groupings at once, answerability and (system, language), in one pass."""
    rows = records.selectExpr("answerability", "system_name", "language", "error_text IS NULL AS ok", "coalesce(abstained, false) AS abstained", "n_claims", "supported", "contradicted", "latency_ms", "coalesce(should_abstain, false) AS should_abstain")
    sets = rows.groupingSets([["answerability"], ["system_name", "language"]], "answerability", "system_name", "language")
    ok, rel = F.col("ok"), F.col("ok") & ~F.col("abstained") & (F.col("n_claims") > 0)
    return sets.agg(
        F.count("*").alias("runs"), F.count_if(~ok).alias("errors"), F.round(rate(F.count_if(ok & ~F.col("should_abstain") & ~F.col("abstained")), F.count_if(ok & ~F.col("should_abstain"))), 6).alias("answered_when_answerable"),
        F.round(rate(F.count_if(ok & F.col("should_abstain") & F.col("abstained")), F.count_if(ok & F.col("should_abstain"))), 6).alias("abstained_when_unanswerable"),
        F.round(rate(F.count_if(rel & (F.col("supported") == F.col("n_claims"))), F.count_if(rel)), 6).alias("released_all_supported"),
        F.round(rate(F.count_if(rel & (F.col("contradicted") > 0)), F.count_if(rel)), 6).alias("released_contradicted"), F.round(F.avg(F.when(ok, F.col("latency_ms"))), 3).alias("mean_latency_ms"),
    )


def correction_effect(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by.., n, before, after, relative_reduction, improvement_rate, regression_rate, net_improvement, relevance_retention) of corrections.

    pairs: (by.., before, after, regressed, relevance_before, relevance_after) with the hallucination rate before and after;
    rows without either rate are left out. Relevance that nobody measured, or of 0 before, counts as kept.
    """
    rows = pairs.where(F.col("before").isNotNull() & F.col("after").isNotNull())
    b, a, n = F.avg("before"), F.avg("after"), F.count("*")
    better, worse = F.count_if(F.col("after") < F.col("before")) / n, F.count_if(F.coalesce("regressed", F.lit(False))) / n
    kept = F.coalesce(F.when(F.avg("relevance_before") != 0, F.avg("relevance_after") / F.avg("relevance_before")), F.lit(1.0))
    return rows.groupBy(*by).agg(
        n.alias("n"), b.alias("before"), a.alias("after"), F.when(b != 0, (b - a) / b).otherwise(0.0).alias("relative_reduction"), better.alias("improvement_rate"), worse.alias("regression_rate"),
        (better - worse).alias("net_improvement"), kept.alias("relevance_retention"),
    )


def gates(reviews: DataFrame, by: str, least_reviewed: int = 50, least_answered: int = 20) -> DataFrame:
    """(by, the nine gates, passed) of reviewed answers: counts, both kinds of question, unsupported answers, abstention, calibration, latency.

    reviews: (by, abstained, should_abstain, fully_supported, calibrated, confidence, latency_ms, baseline_latency_ms). A gate
    whose measure no row gives is not passed. The latency gate is on the nearest-rank 95th percentile of each row's own ratio.
    """
    ab, sh, fs = F.col("abstained"), F.col("should_abstain"), F.col("fully_supported")
    said = F.count_if(~ab)
    base = reviews.groupBy(by).agg(
        (F.count("*") >= least_reviewed).alias("enough_reviewed"), (said >= least_answered).alias("enough_answered"), ((F.count_if(sh) > 0) & (F.count_if(~sh) > 0)).alias("both_kinds"),
        F.coalesce(F.when(said > 0, F.count_if(~ab & ~fs) / said) <= 0.05, F.lit(False)).alias("unsupported_ok"), (rate(F.count_if(ab & ~sh), F.count_if(~sh)) <= 0.20).alias("over_abstention_ok"),
        (rate(F.count_if(ab & sh), F.count_if(sh)) >= 0.90).alias("recall_ok"), ((said > 0) & (F.count_if(~ab & ~F.coalesce("calibrated", F.lit(False))) == 0)).alias("calibrated_ok"),
    )
    errors = expected_error(reviews.where(~ab).withColumn("_y", fs.cast("int")), [by], "confidence", "_y").select(F.col(by).alias("_e"), "ece")
    ratios = nearest_ranks(reviews.withColumn("_ratio", F.col("latency_ms") / F.col("baseline_latency_ms")), [by], "_ratio", {"_p95": 0.95}).withColumnRenamed(by, "_r")
    out = base.join(errors, F.col(by).eqNullSafe(F.col("_e")), "left").join(ratios, F.col(by).eqNullSafe(F.col("_r")), "left")
    out = out.withColumn("ece_ok", F.coalesce(F.col("ece") <= 0.10, F.lit(False))).withColumn("latency_ok", F.coalesce(F.col("_p95") <= 2.0, F.lit(False)))
    names = ["enough_reviewed", "enough_answered", "both_kinds", "unsupported_ok", "over_abstention_ok", "recall_ok", "calibrated_ok", "ece_ok", "latency_ok"]
    return out.select(by, *names, F.forall(F.array(*names), lambda x: x).alias("passed"))


def marks(mark: Column) -> Column:
    """correct 1, partial 0.5, incorrect 0; anything else NULL."""
    m = F.lower(F.trim(mark))
    return F.when(m == "correct", 1.0).when(m == "partial", 0.5).when(m == "incorrect", 0.0)
