"""From signals to a confidence, and how well it is calibrated."""

from __future__ import annotations

import math

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..session import written
from .ranking import running_total

BINS = 10
FIT_ROWS = 100_000  # bound of the rows that the logistic model is fitted on


def heuristic(supported: Column, margin: Column, top: Column, consistency: Column, reliable: Column, contradicted: Column) -> Column:
    """Weighted evidence in [0, 1]; a missing signal adds nothing, an unreliable consistency gives way to the supported share."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    s4 = F.when(F.coalesce(reliable, F.lit(False)), z(consistency)).otherwise(z(supported))
    raw = 0.55 * z(supported) + 0.20 * z(margin) + 0.15 * F.least(F.lit(1.0), 2 * z(top)) + 0.10 * s4 - 0.35 * z(contradicted)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def band(score: Column) -> Column:
    return F.when(score >= L.BANDS[0], "HIGH").when(score >= L.BANDS[1], "MEDIUM").otherwise("LOW")


def bins(n: int = BINS) -> list[tuple[int, float, float]]:
    return [(i, i / n, (i + 1) / n) for i in range(n)]


def in_bin(p: Column, n: int = BINS) -> Column:
    """Number of the bin lo < p <= hi that holds p (0 in the first), NULL outside [0, 1]. Compared with the literal edges: ceil(p * n) drifts."""
    out = F
    for i, lo, hi in bins(n):
        out = out.when((p > lo) & (p <= hi) if i else (p >= lo) & (p <= hi), i)
    return out.otherwise(F.lit(None).cast("int"))


def reliability(scored: DataFrame, p: str = "p", y: str = "y", n: int = BINS) -> DataFrame:
    """(bin, lo, hi, n, mean_p, accuracy) of all bins; empty ones hold zeros. Rows with NULL p or y do not count."""
    spark = scored.sparkSession
    each = scored.where(F.col(p).isNotNull() & F.col(y).isNotNull()).withColumn("bin", in_bin(F.col(p), n)).where("bin IS NOT NULL")
    got = each.groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("accuracy"))
    return spark.createDataFrame(bins(n), "bin int, lo double, hi double").join(got, "bin", "left").fillna(0)


def expected_error(scored: DataFrame, by: list[str], p: str = "p", y: str = "y", n: int = BINS) -> DataFrame:
    """(by.., n, ece, brier): expected calibration error; a p outside [0, 1] counts in n and in no bin."""
    rows = scored.where(F.col(p).isNotNull() & F.col(y).isNotNull()).withColumn("bin", in_bin(F.col(p), n))
    yy = F.col(y).cast("double")
    each = rows.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(yy).alias("accuracy"), F.sum((F.col(p) - yy) ** 2).alias("sq"))
    gap = F.sum(F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("mean_p") - F.col("accuracy"))))
    return each.groupBy(*by).agg(F.sum("n").alias("n"), (F.coalesce(gap, F.lit(0.0)) / F.sum("n")).alias("ece"), (F.sum("sq") / F.sum("n")).alias("brier"))


def adaptive_error(scored: DataFrame, p: str = "p", y: str = "y", n: int = BINS) -> DataFrame:
    """One row (n, groups, ace): error over groups of about equal size that never part equal scores.

    Equal scores are collapsed first; a group ends at the first score with which it holds n / bins rows. The ends are
    found one after the other, at most `bins` small aggregations over the collapsed scores.
    """
    rows = scored.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    ties = rows.groupBy(F.col(p).alias("p")).agg(F.count("*").alias("c"), F.sum(F.col(y).cast("double")).alias("s"))
    steps = written(running_total(written(ties), "p", "c", "upto"))
    total = steps.agg(F.sum("c")).first()[0] or 0
    ends, at = [], 0
    while total and at < total:
        nxt = steps.where(F.col("upto") >= at + total / n).agg(F.min("upto")).first()[0]
        if nxt is None or nxt >= total:
            break
        ends.append(int(nxt))
        at = nxt
    group = F.lit(0)
    for e in ends:
        group = group + (F.col("upto") > e).cast("int")
    each = steps.groupBy(group.alias("g")).agg(F.sum("c").alias("c"), F.sum(F.col("p") * F.col("c")).alias("sp"), F.sum("s").alias("s"))
    gap = F.sum(F.abs(F.col("sp") - F.col("s")))
    return each.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("groups"), F.coalesce(gap / F.sum("c"), F.lit(0.0)).alias("ace"))


def temperature_grid(scored: DataFrame, p: str = "p", y: str = "y", steps: int = 200) -> DataFrame:
    """(t, nll) for t = 0.025 .. 5. Each task adds up the loss of its rows at all temperatures, so one row per task and temperature is shuffled."""
    ts = np.arange(1, steps + 1) * 5 / steps

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loss, n = np.zeros(steps), 0
        for pdf in batches:
            n += len(pdf)
            for a in range(0, len(pdf), 2000):
                q = pdf["q"].to_numpy(float)[a : a + 2000].clip(1e-6, 1 - 1e-6)
                one = pdf["y"].to_numpy(float)[a : a + 2000, None]
                z = (1 / (1 + np.exp(-np.log(q / (1 - q))[:, None] / ts))).clip(1e-9, 1 - 1e-9)
                loss -= (one * np.log(z) + (1 - one) * np.log(1 - z)).sum(0)
        yield pd.DataFrame({"t": ts, "loss": loss, "n": n})

    rows = scored.where(F.col(p).isNotNull() & F.col(y).isNotNull()).select(F.col(p).cast("double").alias("q"), F.col(y).cast("double").alias("y"))
    sums = rows.mapInPandas(run, "t double, loss double, n long").groupBy("t").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n"))
    return sums.where("n > 0").select("t", (F.col("loss") / F.col("n")).alias("nll"))


def best_temperature(grid: DataFrame) -> DataFrame:
    """The row (t, nll) with the least loss, the smallest t of several (losses equal to 9 places)."""
    return grid.agg(F.min(F.struct(F.round("nll", 9).alias("nll"), F.col("t"))).alias("m")).select("m.t", "m.nll")


SIGNALS = (  # the features of a checked answer in their fixed order
    "s1_top_score", "s1_score_margin", "s1_mean_score", "s1_n_chunks", "s2_supported_ratio", "s2_contradicted_ratio", "s2_unverifiable_ratio", "s2_mean_margin", "s2_min_margin", "s2_n_claims",
    "s3_mean_logprob", "s3_perplexity", "s4_self_consistency", "s4_dispersion", "s4_n_samples", "s4_reliable", "answer_tokens",
)


def feature_row(given: dict[str, Column]) -> list[Column]:
    """The features in their fixed order as doubles; one that is not given is NULL, which is not 0."""
    odd = sorted(set(given) - set(SIGNALS))
    if odd:
        raise ValueError(f"unknown features: {odd}")
    return [given.get(n, F.lit(None)).cast("double").alias(n) for n in SIGNALS]


def fit_logistic(rows: DataFrame, features: list[str], label: str, epochs: int = 400, rate: float = 0.1, l2: float = 0.01, limit: int = FIT_ROWS) -> dict:
    """Weights of a logistic model on standardised features by full-batch descent from zero, the bias unpenalised.

    Fitted on about `limit` rows at most, a seeded sample of those with every feature present.
    Features that no row has are left out by the caller; NULL in a feature drops the row.
    """
    kept = rows.select(*[F.col(f).cast("double") for f in features], F.col(label).cast("double").alias("_y")).dropna()
    total = kept.count()
    m = (kept.sample(False, limit / total, 7) if total > limit else kept).toPandas().to_numpy(float)
    if not len(m):
        raise ValueError("no complete rows")
    x, y = m[:, :-1], m[:, -1]
    mean, dev = x.mean(0), x.std(0)
    dev[dev == 0] = 1.0
    x = (x - mean) / dev
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(epochs):
        gap = 1 / (1 + np.exp(-(x @ w + b))) - y
        w -= rate * (x.T @ gap / len(y) + l2 * w)
        b -= rate * gap.mean()
    return {"features": features, "weights": w.tolist(), "bias": float(b), "mean": mean.tolist(), "std": dev.tolist(), "temperature": 1.0, "rows": len(y)}


def model_score(model: dict, fallback: Column) -> Column:
    """The fitted score at the model's temperature, the fallback where a fitted feature is missing."""
    z = F.lit(model["bias"])
    for f, w, m, s in zip(model["features"], model["weights"], model["mean"], model["std"]):
        z = z + w * (F.col(f) - m) / s
    present = F.lit(True)
    for f in model["features"]:
        present = present & F.col(f).isNotNull()
    return F.when(present, 1 / (1 + F.exp(-z / max(1e-6, model["temperature"])))).otherwise(fallback)


def check_model(model: dict, known: list[str]) -> dict:
    """The model, refused if it names a feature that is not known or a number that is not finite."""
    odd = sorted(set(model["features"]) - set(known))
    if odd:
        raise ValueError(f"unknown features: {odd}")
    if not all(math.isfinite(v) for k in ("weights", "mean", "std") for v in model[k]):
        raise ValueError("numbers must be finite")
    return model


def review_problems(reviews: DataFrame, known: list[str], least: int = 20) -> DataFrame:
    """(problem, n): what forbids fitting on reviewed rows; empty if nothing does.

    reviews: (qid, parallel_id, question, language, split, human_reviewed, reviewer, fully_supported, features MAP).
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    keyed = reviews.withColumn("_q", F.regexp_replace(F.trim(F.lower("question")), r"\s+", " "))
    own = {
        "split": ~F.coalesce(F.col("split").isin("train", "dev"), F.lit(False)), "review not attributed": ~F.coalesce("human_reviewed", F.lit(False)) | blank("reviewer"), "key missing": blank("qid") | blank("parallel_id") | blank("question"),
        "label missing": F.col("fully_supported").isNull(), "unknown or missing features": F.col("features").isNull() | (F.size("features") == 0) | (F.size(F.array_except(F.map_keys("features"), F.array(*[F.lit(k) for k in known]))) > 0),
        "feature not finite": F.exists(F.map_values("features"), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))),
    }
    flags = keyed.select(F.explode_outer(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in own.items()]))).alias("problem"))
    out = flags.where("problem IS NOT NULL").groupBy("problem").agg(F.count("*").alias("n"))
    for k, name in (("qid", "qid twice"), ("parallel_id", "parallel_id twice"), ("_q", "question twice")):
        again = keyed.where(F.col(k).isNotNull()).groupBy(k).agg(F.count("*").alias("c")).where("c > 1").agg(F.lit(name).alias("problem"), F.count("*").alias("n"))
        out = out.unionByName(again.where("n > 0"))
    for split in ("train", "dev"):
        rows = keyed.where(F.col("split") == split).agg(F.count("*").alias("n"), F.count_distinct("fully_supported").alias("labels"))
        out = out.unionByName(rows.where(F.col("n") < least).select(F.lit(f"too few {split} rows").alias("problem"), "n"))
        out = out.unionByName(rows.where("labels < 2").select(F.lit(f"one label only in {split}").alias("problem"), "n"))
    return out


def fit_reviews(reviews: DataFrame, known: list[str]) -> tuple[dict, dict]:
    """(model, report): fitted on the train rows, its temperature set on the dev rows; refused if review_problems() finds any."""
    problems = review_problems(reviews, known).collect()
    if problems:
        raise ValueError("; ".join(sorted(f"{p.problem} ({p.n})" for p in problems)))
    flat = reviews.select("split", F.col("fully_supported").cast("int").alias("y"), *[F.col("features")[k].alias(k) for k in known])
    train, dev = flat.where("split = 'train'"), flat.where("split = 'dev'")
    counts = train.agg(F.count("*").alias("_n"), *[F.count(k).alias(k) for k in known]).first()
    names = [k for k in known if counts[k] == counts["_n"]]  # present in every row
    model = fit_logistic(train, names, "y")
    raw = dev.select(model_score(model, F.lit(None).cast("double")).alias("p"), "y")
    if raw.where("p IS NULL").count():
        raise ValueError("dev rows lack fitted features")
    model["temperature"] = best_temperature(temperature_grid(raw)).first().t
    scored = dev.select(model_score(model, F.lit(None).cast("double")).alias("p"), "y", F.lit("dev").alias("part"))
    errors = expected_error(scored, ["part"]).first()
    order = sorted(zip(names, model["weights"]), key=lambda x: (-abs(x[1]), x[0]))
    return model, {"train": counts["_n"], "dev": errors.n, "ece": errors.ece, "brier": errors.brier, "adaptive": adaptive_error(scored).first().ace, "importance": order}
