"""Problem 1: a sample whose category shares follow a plan, with a minimum for small categories."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import answerability_label, label, language_label, rank_in_group, spread, table

FIELD_LABELS = {"answerability": answerability_label, "question_type": label, "language": language_label}
SEP, WITHIN = "#", ","
STARTS = 20  # random starts that are tried while floors are missed


def plans(targets: DataFrame) -> DataFrame:
    """The target rows with each category in its plain spelling (column `category_key`)."""
    key = F.lit(None).cast("string")
    for field, fn in FIELD_LABELS.items():
        key = F.when(F.col("field_name") == field, fn(F.col("category"))).otherwise(key)
    return targets.withColumn("category_key", key)


def signatures(questions: DataFrame, targets: DataFrame) -> DataFrame:
    """(plan_id, qid, signature): for each distinct qid of a plan's dataset_version the planned categories it bears, by field.

    A qid delivered several times bears every category that one of its rows names. Labels outside the plan, NULL
    included, bear nothing. Rows without qid or version belong to no plan.
    """
    cats = [F.collect_set(F.when(F.col("field_name") == f, F.col("category_key"))).alias(f"_cats_{f}") for f in FIELD_LABELS]
    by_version = plans(targets).groupBy("plan_id", "dataset_version").agg(*cats)
    rows = questions.where("qid IS NOT NULL").select("dataset_version", "qid", *[fn(F.col(f)).alias(f) for f, fn in FIELD_LABELS.items()])
    planned = rows.join(by_version, "dataset_version")
    borne = [F.concat_ws(WITHIN, F.sort_array(F.collect_set(F.when(F.array_contains(f"_cats_{f}", F.col(f)), F.col(f))))).alias(f) for f in FIELD_LABELS]
    return planned.groupBy("plan_id", "qid").agg(*borne).select("plan_id", "qid", F.concat_ws(SEP, *FIELD_LABELS).alias("signature"))


LARGE = 10**9  # from here on numpy draws no hypergeometric numbers


def _random_draw(rng: np.random.Generator, available: np.ndarray, size: int) -> np.ndarray:
    """`size` records drawn at random, by signature: hypergeometric, or beyond LARGE records multinomial, cut at what there is and drawn again for the rest."""
    if available.sum() < LARGE:
        return rng.multivariate_hypergeometric(available, size, method="marginals")
    taken = np.zeros_like(available)
    while (left := size - int(taken.sum())) > 0:
        room = available - taken
        taken = np.minimum(taken + rng.multinomial(left, room / room.sum()), available)
    return taken


def _start(rng: np.random.Generator, available: np.ndarray, member: np.ndarray, floor: np.ndarray, size: int) -> np.ndarray:
    """A random start that holds the floors as far as taking the signature that helps most floors each time can; the rest is drawn at random."""
    taken = np.zeros_like(available)
    while (left := size - int(taken.sum())) > 0:
        short = np.maximum(floor - taken @ member, 0)
        helps = (member @ (short > 0)) * (taken < available)
        if not helps.any():
            break
        j = rng.choice(np.flatnonzero(helps == helps.max()))
        taken[j] += min(left, int(available[j] - taken[j]), int(short[(member[j] > 0) & (short > 0)].min()))
    return taken + _random_draw(rng, available - taken, size - int(taken.sum()))


def _repair(taken: np.ndarray, available: np.ndarray, member: np.ndarray, want: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Exchanges of one signature for another, always the one that lowers the cost most, until none does. A record that a floor lacks costs more than all deviations of an exchange."""
    heavy = 2 * member.shape[1] + 1
    cost = lambda have: heavy * np.maximum(floor - have, 0) + np.abs(have - want)
    while True:
        have = taken @ member
        plus, minus = cost(have + 1) - cost(have), cost(have - 1) - cost(have)
        step = (member @ minus)[:, None] + (member @ plus)[None, :] - (member * (plus + minus)) @ member.T
        step[(taken == 0)[:, None] | (taken >= available)[None, :]] = 0
        out, into = np.unravel_index(np.argmin(step), step.shape)
        if step[out, into] > -1e-9:
            return taken
        # as many at once as leave every category on its side of its target and floor
        d = member[into] - member[out]
        ahead = np.stack([want - have, floor - have]) * d
        ahead = ahead[:, d != 0]
        k = max(1, int(min(taken[out], available[into] - taken[into], *(int(x) for x in ahead[ahead >= 1]))))
        taken = taken.copy()
        taken[out] -= k
        taken[into] += k


def swap_repair(available: np.ndarray, member: np.ndarray, want: np.ndarray, floor: np.ndarray, size: int, seed: int, starts: int = STARTS) -> np.ndarray:
    """How many records to draw of each signature.

    available: records by signature; member: signature x category, 0/1; want, floor: target count and minimum by category.
    From a random start that holds the floors where it can, signature counts are exchanged, always by the pair that lowers
    first what the floors lack and then the sum of |drawn - want| most, until no exchange lowers it. Where a floor that the
    supply allows is still missed, other starts are tried, up to `starts`; the best is kept.
    """
    rng = np.random.default_rng(seed)
    size = int(min(size, available.sum()))
    floor = np.minimum(floor, available @ member)
    best, least = None, None
    for _ in range(starts):
        taken = _repair(_start(rng, available, member, floor, size), available, member, want, floor)
        have = taken @ member
        missed = (int(np.maximum(floor - have, 0).sum()), float(np.abs(have - want).sum()))
        if least is None or missed < least:
            best, least = taken, missed
        if not least[0]:
            break
    return best


def _solve(key: tuple, counts: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
    if not len(counts) or not len(plan):
        return pd.DataFrame({"plan_id": np.zeros(0, np.int64), "signature": np.zeros(0, object), "available": np.zeros(0, np.int64), "taken": np.zeros(0, np.int64)})
    counts = counts.sort_values("signature")
    cats = sorted({(f, c) for f, c in zip(plan["field_name"], plan["category_key"]) if isinstance(c, str)})
    borne = [{(f, c) for f, part in zip(FIELD_LABELS, s.split(SEP)) for c in part.split(WITHIN)} for s in counts["signature"]]
    member = np.array([[c in b for c in cats] for b in borne], dtype=np.int64).reshape(len(counts), len(cats))
    size = int(plan["sample_size"].max())
    by = plan.dropna(subset=["category_key"]).groupby(["field_name", "category_key"]).agg({"target_share": "max", "min_rows": "max"}).reindex(cats)
    available = counts["n"].to_numpy(np.int64)
    want, floor = by["target_share"].fillna(0).to_numpy(float) * size, by["min_rows"].fillna(0).to_numpy(np.int64)
    taken = swap_repair(available, member, want, floor, size, seed=int(key[0]) & 0x7FFFFFFF)
    return pd.DataFrame({"plan_id": key[0], "signature": counts["signature"], "available": available, "taken": taken})


def allocation(sigs: DataFrame, targets: DataFrame) -> DataFrame:
    """(plan_id, signature, available, taken). What a plan's task sees is one row per signature, bounded by the plan's categories."""
    counts = sigs.groupBy("plan_id", "signature").agg(F.count("*").alias("n"))
    plan = plans(targets).select(F.col("plan_id").alias("plan"), "sample_size", "field_name", "category_key", F.col("target_share").cast("double").alias("target_share"), "min_rows")
    # dealt by plan before the tasks start, so that AQE does not put all plans into one
    return spread(counts, "plan_id").groupBy("plan_id").cogroup(spread(plan, "plan").groupBy("plan")).applyInPandas(_solve, "plan_id long, signature string, available long, taken long")


def draw(questions: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """(plan_id, qid) of the sample: of each signature the allotted number of qids, in the order of a seeded hash.

    Each qid comes at most once for a plan. Where a plan asks for more qids than its version has, all are drawn.
    """
    sigs = signatures(questions, targets)
    ranked = rank_in_group(sigs, ["plan_id", "signature"], F.xxhash64(F.lit(seed), "plan_id", "qid"), "place", ["qid"])
    return ranked.join(allocation(sigs, targets), ["plan_id", "signature"]).where("place < taken").select("plan_id", "qid")


def report(questions: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per row of sample_targets: supply, number drawn, whether target and minimum can be met by the supply alone, and whether the draw meets them.

    The draw meets a target if it is off by less than one record. A minimum that can be met alone may be missed in the draw
    only where the plan's minima together ask for more than its size allows, or no start and exchange found the way.
    Empty questions give a supply of 0 everywhere; an empty plan gives no row. NULL target_share or min_rows ask for nothing.
    """
    plan = plans(targets)
    alloc = allocation(signatures(questions, targets), targets)
    fields = F.array(*[F.struct(F.lit(f).alias("field_name"), F.split(F.split("signature", SEP)[i], WITHIN).alias("cats")) for i, f in enumerate(FIELD_LABELS)])
    long = alloc.select("plan_id", "available", "taken", F.explode(fields).alias("x")).select("plan_id", "available", "taken", "x.field_name", F.explode("x.cats").alias("category_key"))
    have = long.where("category_key <> ''").groupBy("plan_id", "field_name", "category_key").agg(F.sum("available").alias("supply"), F.sum("taken").alias("drawn"))
    wanted = F.coalesce(F.col("target_share") * F.col("sample_size"), F.lit(0.0))
    out = plan.join(have, ["plan_id", "field_name", "category_key"], "left").fillna(0, ["supply", "drawn"])
    return out.select(
        "plan_id", "field_name", "category", "target_share", wanted.alias("target_rows"), "min_rows", "supply", "drawn",
        (F.col("supply") + 1e-6 >= wanted).alias("target_can_be_met"), (F.col("supply") >= F.coalesce("min_rows", F.lit(0))).alias("minimum_can_be_met"),
        (F.abs(F.col("drawn") - wanted) < 1).alias("target_met"), (F.col("drawn") >= F.coalesce("min_rows", F.lit(0))).alias("minimum_met"),
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report(table(spark, sf_dir, "questions"), table(spark, sf_dir, "sample_targets"))
    return out.where("NOT target_can_be_met OR NOT minimum_can_be_met").select("plan_id", "field_name", "category").distinct()


def p1_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draw(table(spark, sf_dir, "questions"), table(spark, sf_dir, "sample_targets"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "questions"), table(spark, sf_dir, "sample_targets"))


QUERIES = {"p1_found": p1_found, "p1_sample": p1_sample, "p1_report": p1_report}

_LABELS = """
WITH t AS (SELECT row_id, qid, dataset_version, nfc_normalize(translate(answerability, 'ＡＢＣＤａｂｃｄ　', 'ABCDabcd ')) a, question_type q, language l FROM questions WHERE qid IS NOT NULL),
n AS (SELECT dataset_version, qid, upper(regexp_replace(lower(trim(a)), '^class[\\s_-]+', '')) answerability,
  nullif(regexp_replace(lower(trim(q)), '[\\s_-]+', '_', 'g'), '') question_type, nullif(split_part(regexp_replace(lower(trim(l)), '[\\s_-]+', '_', 'g'), '_', 1), '') language FROM t),
s AS (SELECT dataset_version, 'answerability' field_name, answerability category, count(DISTINCT qid) supply FROM n GROUP BY ALL
  UNION ALL SELECT dataset_version, 'question_type', question_type, count(DISTINCT qid) FROM n GROUP BY ALL
  UNION ALL SELECT dataset_version, 'language', language, count(DISTINCT qid) FROM n GROUP BY ALL)
"""
SQL = {
    "p1_found": _LABELS + """SELECT DISTINCT p.plan_id, p.field_name, p.category FROM sample_targets p LEFT JOIN s USING (dataset_version, field_name, category)
WHERE coalesce(s.supply, 0) + 1e-6 < p.target_share * p.sample_size OR coalesce(s.supply, 0) < p.min_rows""",
}
