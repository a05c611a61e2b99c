"""Annotation logs, question sets and evidence views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as B
from ..functions import lexicon as L
from ..functions import text as X
from .ranking import hash_place

VERDICTS = ["SUPPORTED", "CONTRADICTED", "UNVERIFIABLE"]
REQUIRED = ("qid", "parallel_id", "language", "domain", "question", "answerability", "question_type", "split", "provenance")


def latest_labels(events: DataFrame) -> DataFrame:
    """(item_id, llm, human, adjudicated): the last label of each source by seq; labels in any case, others left out."""
    label = F.upper(F.trim("label"))
    rows = events.where((F.col("event_type") == "annotation") & label.isin(VERDICTS) & F.col("item_id").isNotNull())
    pick = lambda s: F.max_by(label, F.when(F.col("source") == s, F.col("seq"))).alias(s)
    return rows.groupBy("item_id").agg(pick("llm"), pick("human"), pick("adjudicated"))


def final_labels(events: DataFrame) -> DataFrame:
    """(item_id, label, label_source, llm_label) of every item: adjudicated before human before llm; items without any label have NULL."""
    items = events.where((F.col("event_type") == "item") & F.col("item_id").isNotNull()).select("item_id").distinct()
    got = items.join(latest_labels(events), "item_id", "left")
    source = F.when(F.col("adjudicated").isNotNull(), "adjudicated").when(F.col("human").isNotNull(), "human").when(F.col("llm").isNotNull(), "llm")
    return got.select("item_id", F.coalesce("adjudicated", "human", "llm").alias("label"), source.alias("label_source"), F.col("llm").alias("llm_label"))


def disagreements(events: DataFrame) -> DataFrame:
    """Items whose human label differs from the llm's and that nobody has adjudicated."""
    return latest_labels(events).where("llm <> human AND adjudicated IS NULL").select("item_id", "llm", "human")


def needs_human(events: DataFrame) -> DataFrame:
    """Items that have neither a human nor an adjudicated label."""
    return final_labels(events).where("label_source IS NULL OR label_source = 'llm'").select("item_id")


def stratified(items: DataFrame, key: str, strata: list[str], share: float = 0.3, least: int = 5, seed: int = 42) -> DataFrame:
    """(key, strata..): of each stratum min(n, max(least, share of n half to even)) rows, in the order of a seeded hash. A hot stratum is ranked by parts."""
    sixty = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}#"), F.col(key).cast("string"))), 1, 15), 16, 10).cast("long")
    order = (sixty - F.lit(2**59)) * 16  # over the whole range of a BIGINT
    placed = hash_place(items, strata, order, "place", [key])
    n = items.groupBy(*[F.col(s).alias(f"_{s}") for s in strata]).agg(F.count("*").alias("_n"))
    both = placed.join(n, [F.col(s).eqNullSafe(F.col(f"_{s}")) for s in strata])
    return both.where(F.col("place") < F.greatest(F.lit(least), F.rint(share * F.col("_n")))).select(key, *strata)


def question_issues(questions: DataFrame, chunk_ids: DataFrame | None = None) -> DataFrame:
    """(row_id, issue): what is wrong with a row of a question set on its own, and against the rows of its qid and the corpus."""
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    missing = F.concat_ws(",", *[F.when(blank(c), F.lit(c)) for c in REQUIRED])
    cls, lang, split = F.col("answerability"), F.col("language"), F.col("split")
    gold = F.coalesce("gold_chunk_ids", F.array().cast("array<string>"))
    complete = missing == ""
    abstain = cls.isin("C", "D")
    rules = [
        (~complete, F.concat(F.lit("missing "), missing)),
        (complete & ~lang.isin("en", "hi", "ta"), F.lit("unknown language")),
        (complete & ~cls.isin("A", "B", "C", "D"), F.lit("unknown answerability")),
        (complete & ~split.isin("train", "dev", "test"), F.lit("unknown split")),
        (complete & ~F.col("provenance").isin("human_authored", "mt_verified", "mt_raw"), F.lit("unknown provenance")),
        (complete & ~F.coalesce("script", F.lit("native")).isin("native", "roman"), F.lit("unknown script")),
        (complete & (F.col("script") == "roman") & (lang == "en"), F.lit("english cannot be romanised")),
        (complete & F.col("should_abstain").isNotNull() & (F.col("should_abstain") != abstain), F.lit("should_abstain contradicts answerability")),
        (complete & cls.isin("A", "B") & (F.size(gold) == 0), F.lit("answerable without gold chunks")),
        (complete & (cls == "C") & (F.size(gold) > 0), F.lit("out of scope with gold chunks")),
        (complete & cls.isin("A", "B") & blank("gold_answer"), F.lit("no gold answer")),
        (complete & (F.col("provenance") == "mt_raw") & (split == "test"), F.lit("unverified translation in test")),
        (complete & (F.col("provenance") != "human_authored") & ~F.coalesce(F.col("qc.human_reviewed"), F.lit(False)), F.lit("translation without review")),
        (complete & blank("dataset_version"), F.lit("no dataset version")),
    ]
    own = questions.select("row_id", F.explode(F.array_compact(F.array(*[F.when(c, m) for c, m in rules]))).alias("issue"))
    counts = questions.where(complete).groupBy("qid").agg(F.min("row_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = questions.where(complete).select("row_id", "qid").join(counts, "qid").where("row_id > first").select("row_id", F.lit("duplicate qid").alias("issue"))
    out = own.unionByName(again)
    return out if chunk_ids is None else out.unionByName(dangling_gold(questions, chunk_ids).select("row_id", F.lit("gold chunk not in corpus").alias("issue")).distinct())


def dangling_gold(questions: DataFrame, chunk_ids: DataFrame) -> DataFrame:
    """(row_id, chunk_id) of gold ids that the corpus lacks."""
    named = questions.select("row_id", F.explode("gold_chunk_ids").alias("chunk_id"))
    return named.join(chunk_ids.select("chunk_id").distinct(), "chunk_id", "left_anti").select("row_id", "chunk_id").distinct()


def group_issues(questions: DataFrame) -> DataFrame:
    """(parallel_id, issue) of groups of one question in several languages: torn splits, differing classes, doubled or missing native rows."""
    rows = questions.select(
        B.group_id(F.col("parallel_id"), F.col("qid")).alias("parallel_id"), B.split_label(F.col("split")).alias("split"), B.answerability_label(F.col("answerability")).alias("cls"),
        B.label(F.col("question_type")).alias("kind"), F.col("domain"), B.language_label(F.col("language")).alias("lang"), (F.coalesce("script", F.lit("native")) == "native").alias("native"), "qid",
    ).where("parallel_id IS NOT NULL")
    # per language first, so that a hot group is counted map-side
    agg = rows.groupBy("parallel_id").agg(
        *[F.count_distinct(c).alias(f"n_{c}") for c in ("split", "cls", "kind", "domain")],
        *[F.count_distinct(F.when(F.col("native") & (F.col("lang") == x), F.col("qid"))).alias(f"native_{x}") for x in ("en", "hi", "ta")],
    )
    doubled = (F.col("native_en") > 1) | (F.col("native_hi") > 1) | (F.col("native_ta") > 1)
    absent = F.concat_ws(",", *[F.when(F.col(f"native_{x}") == 0, F.lit(x)) for x in ("en", "hi", "ta")])
    issues = [(F.col("n_split") > 1, F.lit("split differs")), (F.col("n_cls") > 1, F.lit("answerability differs")), (F.col("n_kind") > 1, F.lit("question_type differs")), (F.col("n_domain") > 1, F.lit("domain differs")), (doubled, F.lit("several native rows of a language")), (absent != "", F.concat(F.lit("no native row for "), absent))]
    return agg.select("parallel_id", F.explode(F.array_compact(F.array(*[F.when(c, m) for c, m in issues]))).alias("issue"))


def balance(rows: DataFrame, value: Column, plan: dict[str, float], tolerance: float = 0.10) -> DataFrame:
    """(category, planned, share, off_plan) of every planned category."""
    spark = rows.sparkSession
    counts = rows.select(value.alias("category")).where("category IS NOT NULL").groupBy("category").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    want = spark.createDataFrame(list(plan.items()), "category string, planned double")
    out = want.join(counts, "category", "left").join(F.broadcast(total)).fillna(0, ["n"])
    share = F.when(F.coalesce("_all", F.lit(0)) > 0, F.col("n") / F.col("_all")).otherwise(0.0)
    return out.select("category", "planned", F.round(share, 6).alias("share"), (F.abs(share - F.col("planned")) > tolerance).alias("off_plan"))


def leaks_between(train: DataFrame, dev: DataFrame, keys: list[str]) -> DataFrame:
    """(key_name, n): rows of dev that share a key with train, for each key."""
    out = None
    for k in keys:
        n = dev.where(F.col(k).isNotNull()).join(train.select(k).distinct(), k, "left_semi").agg(F.lit(k).alias("key_name"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


def anchors(answer: Column, claims: Column) -> Column:
    """Where claims stand in an answer: array<struct<start, end, claim_no>> from 0, in text order.

    Case and a closing mark aside; a claim below six characters, one that does not occur, and one that would overlap an
    earlier claim's place have none. If lower case changes the length of the answer, nobody has.
    """
    low = F.lower(answer)
    found = F.transform(claims, lambda c, i: _at(low, c, i))
    free = F.aggregate(
        F.filter(found, lambda f: (f["len"] >= 6) & (f["start"] >= 0)), F.array().cast("array<struct<start:int,end:int,claim_no:int>>"),
        lambda acc, f: F.when(F.exists(acc, lambda r: (f["start"] < r["end"]) & (f["start"] + f["len"] > r["start"])), acc).otherwise(
            F.concat(acc, F.array(F.struct(f["start"].cast("int").alias("start"), (f["start"] + f["len"]).cast("int").alias("end"), f["no"].cast("int").alias("claim_no"))))),
    )
    return F.when(F.length(low) == F.length(answer), F.array_sort(free)).otherwise(F.array().cast("array<struct<start:int,end:int,claim_no:int>>"))


def needle(claim: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(claim), r"[.।!?]+$", ""))


def _at(low: Column, claim: Column, i: Column) -> Column:
    n = needle(claim)
    return F.struct((F.call_function("instr", low, n) - 1).alias("start"), F.length(n).alias("len"), i.alias("no"))


def evidence_words(text: Column) -> Column:
    """Words with a digit, or of three letters and more that are no stop-word; marks belong to words."""
    stop = F.array(*[F.lit(w) for w in L.EVIDENCE_STOP])
    ws = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{M}\p{N}]+)"), 1)
    return F.filter(ws, lambda w: w.rlike(r"\p{N}") | ((F.length(w) >= 3) & ~F.array_contains(stop, w)))


def evidence_difference(pairs: DataFrame, passage: str, claim: str) -> DataFrame:
    """pairs with `x`, struct(sentence, hits, extra): the passage's sentence with most words of the claim (repeats count, the first of several), and its numbers and negations that the claim lacks; NULL if no sentence shares a word."""
    word = F.lit(r"([\p{L}\p{M}\p{N}]+)")
    rows = pairs.withColumn("_mine", F.array_distinct(evidence_words(F.col(claim)))).withColumn("_said", F.regexp_extract_all(F.lower(claim), word, 1))
    rows = rows.withColumn("_parts", F.filter(F.split(passage, r"(?<=[.!?।॥])\s+"), lambda s: F.trim(s) != ""))
    ranked = F.transform("_parts", lambda s, i: F.struct(F.size(F.filter(evidence_words(s), lambda w: F.array_contains("_mine", w))).alias("hits"), (-i).alias("at")))
    rows = rows.withColumn("_best", F.array_max(ranked)).withColumn("_sentence", F.element_at("_parts", 1 - F.col("_best.at")))
    neg = F.array(*[F.lit(n) for n in L.EVIDENCE_NEGATIONS])
    odd = F.filter(F.regexp_extract_all(F.lower("_sentence"), word, 1), lambda w: (w.rlike(r"^\p{N}+$") | F.array_contains(neg, w)) & ~F.array_contains("_said", w))
    x = F.when(F.col("_best.hits") > 0, F.struct(F.col("_sentence").alias("sentence"), F.col("_best.hits").alias("hits"), F.array_distinct(odd).alias("extra")))
    return rows.withColumn("x", x).drop("_mine", "_said", "_parts", "_best", "_sentence")


def outcome(audit: Column, abstained: Column, n_claims: Column, flagged: Column) -> Column:
    """The five headings of a checked answer."""
    return F.when(audit & (flagged > 0), "audit_flagged").when(audit, "audit_clear").when(abstained, "withheld").when((n_claims > 0) & (flagged == 0), "supported").otherwise("needs_review")


def secret_findings(texts: DataFrame, key: str, text: str) -> DataFrame:
    return texts.select(key, X.secrets(F.col(text)).alias("patterns")).where(F.size("patterns") > 0)


def proposed_labels(items: DataFrame) -> DataFrame:
    """(item_id, label, confidence) from a judge's replies: items (item_id, evidence, reply, reply_confidence).

    Without evidence an item is UNVERIFIABLE for certain; a reply without exactly one known label is UNVERIFIABLE with confidence 0.
    """
    named = F.array_distinct(F.regexp_extract_all(F.upper(F.coalesce("reply", F.lit(""))), F.lit(r"\b(SUPPORTED|CONTRADICTED|UNVERIFIABLE)\b"), 1))
    empty = F.coalesce(F.size("evidence"), F.lit(0)) <= 0
    label = F.when(empty | (F.size(named) != 1), "UNVERIFIABLE").otherwise(F.element_at(named, 1))
    sure = F.when(empty, 1.0).when(F.size(named) != 1, 0.0).otherwise(F.coalesce("reply_confidence", F.lit(0.0)))
    return items.select("item_id", label.alias("label"), sure.alias("confidence"))


def check_judge(judge: str, system: str) -> None:
    """Refuses a judge that is the judged system's own provider or model."""
    if judge and judge == system:
        raise ValueError(f"{judge} would label its own output")


def group_head(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """All rows of the n groups that appear first in the order of a column."""
    first = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.min(order).alias("_o")).orderBy("_o", group).limit(n).select(group)
    return rows.join(F.broadcast(first), group, "left_semi")


def expected_behaviour(answerability: Column, evidence_languages: Column, document_language: Column) -> Column:
    """answer, partial or abstain of a question against documents of one language; by class where its evidence languages are not given."""
    able = F.when(evidence_languages.isNull(), answerability.isin("A", "B")).otherwise(F.array_contains(evidence_languages, document_language))
    return F.when(~F.coalesce(able, F.lit(False)), "abstain").when(answerability == "B", "partial").otherwise("answer")


def run_failures(abstained: Column, should_abstain: Column, n_claims: Column, supported: Column, contradicted: Column, cited: Column, retrieved: Column) -> Column:
    """What is wrong with a run, as an array of rule names."""
    rules = [
        (should_abstain & ~abstained, "unanswerable_question_answered"), (~should_abstain & abstained, "answerable_question_not_answered"), (~abstained & (n_claims > 0) & (supported < n_claims), "answer_not_fully_supported"),
        (~abstained & (contradicted > 0), "contradiction_released"), (~abstained & (F.size(F.array_except(cited, retrieved)) > 0), "gold_evidence_not_retrieved"), (F.size(retrieved) <= 0, "nothing_retrieved"),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in rules]))
