"""Answers into atomic claims, claims against evidence, verdicts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X

MAX_CHUNKS, MAX_CLAIMS = 5, 50  # what the checker looks at unless it is told otherwise


def decompose(answer: Column, language: Column) -> Column:
    """Claims of an answer as an array: its sentences, split at connectives where every part says something.

    Answers below 12 characters and abstentions have none; NULL gives an empty array.
    """
    usable = (F.length(answer) >= 12) & ~F.exists(F.array(*[F.lit(m) for m in L.ABSTAIN_MARKERS]), lambda m: F.upper(answer).contains(m))
    said = lambda c: (F.length(F.trim(c)) >= 8) & c.rlike(r"[\p{L}\p{N}]")

    def parts(s: Column) -> Column:
        cut = X.per_language(language, {k: F.split(s, p) for k, p in L.CONNECTIVES.items()}, F.array(s))
        cut = F.transform(cut, lambda p: F.trim(p))
        return F.when((F.size(cut) > 1) & F.forall(cut, said), cut).otherwise(F.array(s))

    claims = F.filter(F.flatten(F.transform(X.sentences(X.normalize(answer)), parts)), said)
    return F.coalesce(F.when(usable, claims), F.array().cast("array<string>"))


def claim_spans(df: DataFrame, answer: str, claims: str, spans: str = "spans") -> DataFrame:
    """df with the place of each claim in the trimmed answer, searched from the end of the one before; NULL where it does not stand there."""

    @F.pandas_udf("array<struct<start: int, end: int>>")
    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, lists in batches:
            out = []
            for t, cs in zip(texts, lists):
                at, row = 0, []
                t = (t or "").strip()
                for c in cs if cs is not None else []:
                    p = t.find(c, at)
                    row.append((p, p + len(c)) if p >= 0 else None)
                    at = p + len(c) if p >= 0 else at
                out.append(row)
            yield pd.Series(out)

    return df.withColumn(spans, find(answer, claims))


def inflated(claims: Column, answer: Column) -> Column:
    total = F.aggregate(claims, F.lit(0), lambda s, c: s + F.length(c))
    return total > F.greatest(F.lit(60), 2 * F.length(answer))


def claim_rows(answers: DataFrame, key: str, answer: str, language: str) -> DataFrame:
    """(key, language, claim_ord, claim)."""
    rows = answers.select(key, F.col(language).alias("language"), decompose(F.col(answer), F.col(language)).alias("c"))
    # the outer form, as Catalyst would repeat the whole decomposition in a filter before the inner one
    return rows.select(key, "language", F.posexplode_outer("c").alias("claim_ord", "claim")).where("claim IS NOT NULL")


def stop_class(language: Column) -> Column:
    """The language as far as terms depend on it: its code where it has stop-words, else ''."""
    return F.when(language.isin(*L.STOP_WORDS), language).otherwise("")


def evidence_sentences(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, stop_class, sentences): what the keyword check needs of each chunk, for each class of a claim's language, computed once per chunk and not per pair."""
    low = F.lower(F.col(text))
    parts = F.filter(F.split(low, r"(?<=[.!?।॥])\s+"), lambda s: F.trim(s) != "")
    rows = chunks.where(F.length(F.trim(text)) > 0).select(key, low.alias("_low"), parts.alias("_parts"))
    rows = rows.select(key, F.when(F.size("_parts") <= 1, F.array("_low")).otherwise(F.col("_parts")).alias("_parts"))
    rows = rows.withColumn("_own", F.transform("_parts", lambda s: F.struct(hashes(X.overlap_words(s)).alias("words"), hashes(numbers(s)).alias("numbers"), negated(s).alias("negated"))))
    rows = rows.withColumn("stop_class", F.explode(F.array(*[F.lit(c) for c in (*L.STOP_WORDS, "")])))
    topics = F.transform("_parts", lambda s: hashes(F.array_distinct(X.tokens(s, F.col("stop_class")))))
    rows = rows.withColumn("_topics", topics)
    one = lambda s, t: F.struct(s["words"].alias("words"), s["numbers"].alias("numbers"), s["negated"].alias("negated"), t.alias("topics"))
    return rows.select(key, "stop_class", F.zip_with("_own", "_topics", one).alias("sentences"))


def hashes(words: Column) -> Column:
    """64-bit hashes of words: pairs carry and intersect these instead of strings."""
    return F.transform(words, lambda w: F.xxhash64(w))


def numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({L.NUMBER})"), 1))


def negated(text: Column) -> Column:
    """Whether one of the negations stands anywhere in the text, inside words too."""
    return F.exists(F.array(*[F.lit(n) for n in L.NEGATIONS]), lambda n: text.contains(n))


def with_scores(pairs: DataFrame) -> DataFrame:
    """pairs with `s`, struct(entailment, contradiction, neutral) of `claim_parts` against a chunk's `sentences`, judged on the sentence that shares most words with the claim (the first of several)."""
    c = F.col("claim_parts")
    ranked = F.transform("sentences", lambda s, i: F.struct(X.share_of(s["words"], c["words"]).alias("overlap"), (-i).alias("at")))
    rows = pairs.withColumn("_best", F.array_max(ranked))
    rows = rows.withColumn("_focus", F.element_at("sentences", 1 - F.col("_best.at"))).drop("sentences")
    focus, overlap = F.col("_focus"), F.col("_best.overlap")
    odd_number = (F.size(c["numbers"]) > 0) & (F.size(focus["numbers"]) > 0) & (F.size(F.array_except(c["numbers"], focus["numbers"])) > 0)
    topical = F.greatest(X.share_of(focus["topics"], c["topics"]), overlap) >= 0.3
    flipped = (overlap >= 0.5) & (focus["negated"] != c["negated"])
    triple = lambda e, x, n: F.struct(F.lit(e).alias("entailment"), F.lit(x).alias("contradiction"), F.lit(n).alias("neutral"))
    scores = F.when((odd_number & topical) | flipped, triple(0.05, 0.85, 0.10)).when(overlap >= 0.6, triple(0.85, 0.05, 0.10)).when(overlap >= 0.3, triple(0.45, 0.10, 0.45)).otherwise(triple(0.10, 0.05, 0.85))
    return rows.withColumn("s", scores).drop("_best", "_focus")


def verdict(scores: Column, language: Column) -> Column:
    """CONTRADICTED before SUPPORTED before UNVERIFIABLE, by the thresholds of the language."""
    e = X.per_language(language, {k: F.lit(v[0]) for k, v in L.THRESHOLDS.items()}, F.lit(L.OTHER_THRESHOLDS[0]))
    c = X.per_language(language, {k: F.lit(v[1]) for k, v in L.THRESHOLDS.items()}, F.lit(L.OTHER_THRESHOLDS[1]))
    return F.when(scores["contradiction"] >= c, "CONTRADICTED").when(scores["entailment"] >= e, "SUPPORTED").otherwise("UNVERIFIABLE")


def verify(claims: DataFrame, evidence: DataFrame, sentences: DataFrame, key: str, policy: str = "support", max_chunks: int = MAX_CHUNKS, max_claims: int = MAX_CLAIMS) -> DataFrame:
    """(key, language, claim_ord, claim, verdict, entailment, contradiction, neutral, citations).

    claims: (key, language, claim_ord, claim); evidence: (key, place, chunk_id), of which the first max_chunks count;
    sentences: see evidence_sentences. A claim without evidence, or beyond max_claims, is UNVERIFIABLE with (0, 0, 1).
    policy 'contradiction': any contradiction wins; 'support': any support wins, then any contradiction. Citations are the
    chunks of the winning verdict in the order of their place. Claims meet their answer's chunks by equi-join.
    """
    if policy not in ("support", "contradiction"):
        raise ValueError(policy)
    low = F.lower("claim")
    parts = F.struct(hashes(X.overlap_words(low)).alias("words"), hashes(F.array_distinct(X.tokens(low, F.col("language")))).alias("topics"), hashes(numbers(low)).alias("numbers"), negated(low).alias("negated"))
    made = claims.where(F.col("claim_ord") < max_claims).select(key, "claim_ord", "language", stop_class(F.col("language")).alias("stop_class"), parts.alias("claim_parts"))
    pairs = made.join(evidence.where(F.col("place") < max_chunks), key).join(sentences, ["chunk_id", "stop_class"])
    scored = with_scores(pairs).withColumn("v", verdict(F.col("s"), F.col("language")))
    own = F.when(F.col("v") == "SUPPORTED", F.col("s.entailment")).when(F.col("v") == "CONTRADICTED", F.col("s.contradiction")).otherwise(F.col("s.neutral"))
    pick = lambda v: F.max_by("s", F.when(F.col("v") == v, F.struct(own.alias("p"), (-F.col("place")).alias("at"))))
    cited = lambda v: F.transform(F.array_sort(F.collect_list(F.when(F.col("v") == v, F.struct("place", "chunk_id")))), lambda x: x["chunk_id"])
    by = scored.groupBy(key, "claim_ord").agg(
        F.max(F.col("v") == "SUPPORTED").alias("any_s"), F.max(F.col("v") == "CONTRADICTED").alias("any_c"),
        *[pick(v).alias(f"p_{v[0]}") for v in ("SUPPORTED", "CONTRADICTED", "UNVERIFIABLE")], *[cited(v).alias(f"c_{v[0]}") for v in ("SUPPORTED", "CONTRADICTED")],
    )
    order = (("any_c", "CONTRADICTED"), ("any_s", "SUPPORTED")) if policy == "contradiction" else (("any_s", "SUPPORTED"), ("any_c", "CONTRADICTED"))
    final = F.when(F.col(order[0][0]), order[0][1]).when(F.col(order[1][0]), order[1][1]).otherwise("UNVERIFIABLE")
    out = claims.join(by, [key, "claim_ord"], "left").withColumn("verdict", final)
    p = F.when(F.col("verdict") == "SUPPORTED", F.col("p_S")).when(F.col("verdict") == "CONTRADICTED", F.col("p_C")).otherwise(F.col("p_U"))
    cites = F.when(F.col("verdict") == "SUPPORTED", F.col("c_S")).when(F.col("verdict") == "CONTRADICTED", F.col("c_C")).otherwise(F.array().cast("array<string>"))
    return out.select(
        key, "language", "claim_ord", "claim", "verdict", F.coalesce(p["entailment"], F.lit(0.0)).alias("entailment"), F.coalesce(p["contradiction"], F.lit(0.0)).alias("contradiction"),
        F.coalesce(p["neutral"], F.lit(1.0)).alias("neutral"), F.coalesce(cites, F.array().cast("array<string>")).alias("citations"),
    )


def detection(verdicts: DataFrame, key: str) -> DataFrame:
    """(key, n_claims, supported, contradicted, unverifiable, the three ratios, mean and least margin) of each answer with claims."""
    three = F.sort_array(F.array("entailment", "contradiction", "neutral"), asc=False)
    rows = verdicts.withColumn("margin", three[0] - three[1])
    n = F.count("*")
    counts = {v.lower(): F.count_if(F.col("verdict") == v) for v in ("SUPPORTED", "CONTRADICTED", "UNVERIFIABLE")}
    return rows.groupBy(key).agg(n.alias("n_claims"), *[c.alias(k) for k, c in counts.items()], *[(c / n).alias(f"{k}_ratio") for k, c in counts.items()], F.avg("margin").alias("mean_margin"), F.min("margin").alias("min_margin"))


def normalised_scores(e: Column, c: Column, n: Column) -> Column:
    """The three scores divided by their sum; (0, 0, 1) where it is not positive."""
    total = e + c + n
    make = lambda a, b, d: F.struct(a.alias("entailment"), b.alias("contradiction"), d.alias("neutral"))
    return F.when(total > 0, make(e / total, c / total, n / total)).otherwise(make(F.lit(0.0), F.lit(0.0), F.lit(1.0)))


def batch_labels(reply: Column, n: int, labels: list[str] | None = None) -> Column:
    """The labels of a numbered reply '1: ENTAILMENT' .. as an array. NULL unless every line is one and each of 1..n stands there exactly once: a reply that cannot be read whole is not used at all."""
    pattern = L.REPLY_LINE.format(labels="|".join(labels or L.PREMISE_LABELS))
    text = F.regexp_replace(F.regexp_replace(reply, r"^\s+|\s+$", ""), "^`+|`+$", "")
    lines = F.filter(F.split(text, r"\r\n|[\n\r\u0085\u2028\u2029]"), lambda x: F.trim(x) != "")
    pairs = F.array_sort(F.transform(lines, lambda x: F.struct(F.regexp_extract(x, pattern, 1).try_cast("int").alias("i"), F.upper(F.regexp_extract(x, pattern, 2)).alias("l"))))
    ok = F.forall(lines, lambda x: x.rlike(pattern)) & (F.size(lines) == n) & (F.transform(pairs, lambda p: p["i"]) == F.sequence(F.lit(1), F.lit(n)))
    return F.when(F.coalesce(ok, F.lit(False)), F.transform(pairs, lambda p: p["l"]))


def claim_lines(reply: Column, answer: Column, most: int = 20) -> Column:
    """Claims of a decomposer's reply, one a line, list marks stripped; an empty array if it says there are none.

    NULL, which asks for the rule-based decomposition instead: no usable line, `most` or more claims, or claims that
    together are far longer than the answer.
    """
    lines = F.transform(F.split(reply, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, L.LIST_MARK, "")))
    kept = F.filter(lines, lambda c: (F.length(c) >= 8) & c.rlike(r"[\p{L}\p{N}]"))
    none = F.upper(reply).contains(L.ABSTAIN_MARKERS[1])
    return F.when(none, F.array().cast("array<string>")).when((F.size(kept) == 0) | (F.size(kept) >= most) | inflated(kept, answer), None).otherwise(kept)


def whole_answer(answer: Column) -> Column:
    """The answer as its single claim, with its span; blank answers have none."""
    one = F.struct(answer.alias("claim"), F.lit(0).alias("start"), F.length(answer).alias("end"))
    return F.when(F.length(F.trim(answer)) > 0, F.array(one)).otherwise(F.array().cast("array<struct<claim:string,start:int,end:int>>"))


def label_scores(label: Column, sure: float = 0.90) -> Column:
    """The three scores of a judge's hard label: `sure` for it and the rest shared; an unknown or missing label is neutral for certain."""
    rest = (1 - sure) / 2
    pick = lambda v: F.when(F.upper(F.trim(label)) == v, F.lit(sure)).otherwise(F.lit(rest))
    known = F.upper(F.trim(label)).isin("SUPPORTED", "CONTRADICTED", "UNVERIFIABLE")
    none = F.struct(F.lit(0.0).alias("entailment"), F.lit(0.0).alias("contradiction"), F.lit(1.0).alias("neutral"))
    return F.when(known, F.struct(pick("SUPPORTED").alias("entailment"), pick("CONTRADICTED").alias("contradiction"), pick("UNVERIFIABLE").alias("neutral"))).otherwise(none)


def answer_gate(n_claims: Column, supported: Column, has_evidence: Column, whole: Column, coverage: Column, own_case: Column) -> Column:
    """struct(extra_claim, partial, personal_case): the check of a whole answer after its claims.

    Only answers with evidence whose claims are all supported are checked. `whole` is the verdict on the answer as one
    claim, `coverage` a judge's FULL or PARTIAL, `own_case` whether the question needs the asker's own records; NULL where
    nobody judged. An answer that is not supported as a whole and not merely partial gets its own verdict as a further claim.
    """
    due = has_evidence & (n_claims > 0) & (supported == n_claims)
    part, own = F.coalesce(coverage == "PARTIAL", F.lit(False)), F.coalesce(own_case, F.lit(False))
    held = whole == "SUPPORTED"
    partial = due & part & ((held & ~own) | (whole == "UNVERIFIABLE"))
    extra = F.when(due & ~held & ~partial, whole)
    return F.struct(extra.alias("extra_claim"), partial.alias("partial"), (due & held & own).alias("personal_case"))
