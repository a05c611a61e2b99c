"""Bounded correction of answers: decision, pruning, acceptance of a candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

ABSTAIN_BELOW, WEAK_RETRIEVAL, PRUNE_SHARE, ITERATIONS = 0.30, 0.15, 0.5, 2


def decide(n: Column, supported: Column, contradicted: Column, unverifiable: Column, score: Column, band: Column, top: Column, exhausted: Column) -> Column:
    """What to do with a checked answer, as one ordered choice."""
    top = F.coalesce(top, F.lit(0.0))
    return (
        F.when(n == 0, "ACCEPT")
        .when((contradicted == 0) & (unverifiable == 0) & (band != "LOW"), "ACCEPT")
        .when((contradicted > 0) & (top >= WEAK_RETRIEVAL) & ~exhausted, "REGENERATE")
        .when((unverifiable > 0) & (top < WEAK_RETRIEVAL) & ~exhausted, "RE_RETRIEVE")
        .when((score < ABSTAIN_BELOW) | (supported == 0), "ABSTAIN")
        .when(exhausted, "ABSTAIN")
        .when((contradicted + unverifiable) / n <= PRUNE_SHARE, "PRUNE")
        .when(contradicted > 0, "REGENERATE")
        .otherwise("ABSTAIN")
    )


def profile(supported: Column, contradicted: Column, unverifiable: Column) -> Column:
    """Smaller is better: fewer contradicted, then fewer unverifiable, then more supported claims."""
    return F.struct(contradicted.alias("c"), unverifiable.alias("u"), (-supported).alias("s"))


def accepts(before: Column, after: Column, supported_before: Column, supported_after: Column, total_after: Column) -> tuple[Column, Column]:
    """(accepted, regressed) of a candidate by its profile."""
    return (total_after > 0) & (after < before) & (supported_after >= supported_before), before < after


def prune(answer: Column, claims: Column) -> Column:
    """An answer without its flagged claims.

    claims: array<struct<claim, start, end, flagged>>. If a flagged claim has no place in the text and some claim is
    supported, the answer is put together from the supported claims; else the flagged spans are cut, the last first.
    """
    flagged, kept = F.filter(claims, lambda c: c["flagged"]), F.filter(claims, lambda c: ~c["flagged"])
    lost = F.exists(flagged, lambda c: c["start"].isNull()) & (F.size(kept) > 0)
    rebuilt = F.array_join(F.transform(kept, lambda c: X.as_sentence(c["claim"])), " ")
    spans = F.transform(F.array_sort(F.transform(F.filter(flagged, lambda c: c["start"].isNotNull()), lambda c: F.struct((-c["start"]).alias("k"), c["end"].alias("end")))), lambda c: c)
    cut = F.aggregate(spans, F.trim(answer), lambda t, s: F.concat(F.substring(t, F.lit(1), -s["k"]), F.substring(t, s["end"] + 1, F.length(t))))
    return F.when(F.size(flagged) == 0, answer).when(lost, rebuilt).otherwise(X.tidy(cut))


def tracker(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by.., attempts, regressions, runs_corrected, regression_rate) from counters of runs; no attempts give a rate of 0."""
    a, r = F.coalesce(F.sum("correction_attempts"), F.lit(0)), F.coalesce(F.sum("correction_regressions"), F.lit(0))
    return rows.groupBy(*by).agg(a.alias("attempts"), r.alias("regressions"), F.count_if(F.col("correction_attempts") > 0).alias("runs_corrected"), F.when(a > 0, r / a).otherwise(0.0).alias("regression_rate"))


def effects(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """(by.., attempts, improved, regressed, unchanged, improvement_rate, regression_rate) of corrections.

    outcomes: (by.., action, accepted, regressed). Accepting and abstaining are no corrections; a regressed one counts as
    that even if it was accepted.
    """
    rows = outcomes.where(~F.coalesce(F.col("action").isin("ACCEPT", "ABSTAIN"), F.lit(False)))
    worse, better, n = F.coalesce("regressed", F.lit(False)), F.coalesce("accepted", F.lit(False)), F.count("*")
    improved, regressed = F.count_if(better & ~worse), F.count_if(worse)
    return rows.groupBy(*by).agg(n.alias("attempts"), improved.alias("improved"), regressed.alias("regressed"), (n - improved - regressed).alias("unchanged"), (improved / n).alias("improvement_rate"), (regressed / n).alias("regression_rate"))


def rounds(candidates: DataFrame, key: str, limit: int = ITERATIONS) -> DataFrame:
    """The last accepted candidate of each answer after at most `limit` rounds.

    candidates: (key, round, supported, contradicted, unverifiable, ..); round 0 is the draft. A round is taken over only
    if it is better than what is kept and loses no supported claim, so a worse one is rolled back. The rounds of one
    answer are few and fold inside its row.
    """
    one = F.struct("round", F.col("supported").alias("s"), F.col("contradicted").alias("c"), F.col("unverifiable").alias("u"))
    by = candidates.where(F.col("round") <= limit).groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("r"))

    def step(kept: Column, x: Column) -> Column:
        ok, _ = accepts(profile(kept["s"], kept["c"], kept["u"]), profile(x["s"], x["c"], x["u"]), kept["s"], x["s"], x["s"] + x["c"] + x["u"])
        return F.when(ok, x).otherwise(kept)

    best = F.aggregate(F.slice("r", F.lit(2), F.greatest(F.size("r") - 1, F.lit(0))), F.element_at("r", 1), step)
    out = by.select(key, best.alias("b"), F.size("r").alias("n_rounds"))
    return out.select(key, F.col("b.round").alias("kept_round"), F.col("b.s").alias("supported"), F.col("b.c").alias("contradicted"), F.col("b.u").alias("unverifiable"), "n_rounds")
