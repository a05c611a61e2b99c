"""Operators against hand-computed cases and independent Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.operators import chunking, claims, confidence, correction, evaluation, ranking, retrieval, review


# ---- chunking

def test_chunks_lose_nothing_and_follow_the_sizes(spark):
    random.seed(3)
    texts = [" ".join(f"Sentence {i} of {k} has {'word ' * random.randint(1, 60)}end." for i in range(random.randint(1, 30))) for k in range(6)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)] + [(90, None, "en"), (91, "  ", None), (92, "Hi.", None)], "doc_id long, text string, lang string")
    got = {}
    for r in chunking.chunk_documents(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == {0, 1, 2, 3, 4, 5, 92}
    for i, t in enumerate(texts):
        rows = sorted(got[i], key=lambda r: r.chunk_index)
        assert [r.chunk_index for r in rows] == list(range(rows[0].n_chunks))
        joined = " ".join(r.text for r in rows)
        assert all(s.strip() in joined for s in t.split("end.") if s.strip())
        assert all(r.est_tokens == max(1, round(len(r.text) * 0.28)) for r in rows)


def plain_pack(sentences, rate, target, overlap, least):
    """Step by step, as the sizes are described."""
    size = lambda s: max(1, round(len(s) * rate))
    out, cur, tot = [], [], 0
    for s in sentences:
        if cur and tot + size(s) > target:
            out.append(cur)
            keep, tot = [], 0
            for k in cur[::-1]:
                if tot + size(k) > overlap:
                    break
                keep.insert(0, k)
                tot += size(k)
            cur = keep
        cur = [*cur, s]
        tot += size(s)
    out.append(cur)
    texts = [" ".join(o) for o in out]
    i = 0
    while i < len(texts) and len(texts) > 1:
        if size(texts[i]) < least:
            j = i + 1 if i + 1 < len(texts) else i - 1
            a, b = sorted((i, j))
            texts[a : b + 1] = [texts[a] + " " + texts[b]]
            i = a
        else:
            i += 1
    return texts


@pytest.mark.parametrize("seed", range(12))
def test_pack_matches_a_step_by_step_version(seed):
    rng = random.Random(seed)
    sentences = ["x" * rng.choice([3, 20, 90, 150, 400, 900]) for _ in range(rng.randint(1, 25))]
    sizes = chunking.Chunking()
    assert chunking.pack(sentences, 0.28, sizes) == plain_pack(sentences, 0.28, sizes.target, sizes.overlap, sizes.least)


def test_chunking_guards():
    with pytest.raises(ValueError):
        chunking.Chunking(target=10, overlap=20)


# ---- retrieval

CHUNKS = [("e1", "Claims must be submitted within 30 days after the discharge date.", "en"), ("e2", "Policy PX-4471 covers outpatient dental treatment up to Rs. 25,000.", "en"), ("e3", "Rejected claims may be appealed within 60 days.", "en"), ("h1", "दावा 30 दिन में जमा करें।", "hi")]


def test_bm25_matches_the_formula(spark):
    from attestra.functions import text as X

    post = retrieval.postings(spark.createDataFrame(CHUNKS, "chunk_id string, text string, language string"))
    q = spark.createDataFrame([(1, "en", "appeal claims")], "query_id int, language string, q string").withColumn("terms", X.tokens(F.col("q"), F.col("language"))).drop("q")
    got = retrieval.bm25_top(q, post, 5).orderBy("place").collect()
    rows = {(r.chunk_id, r.term): (r.tf, r.length) for r in post.where("language = 'en'").collect()}
    n, avg = 3, np.mean([next(v[1] for (c, _), v in rows.items() if c == k) for k in ("e1", "e2", "e3")])
    want = {}
    for term in {"appeal", "claims", "claim"}:
        df = sum(t == term for _, t in rows)
        if df:
            idf = math.log((n - df + 0.5) / (df + 0.5) + 1)
            for (c, t), (tf, ln) in rows.items():
                if t == term:
                    want[c] = want.get(c, 0) + idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * ln / avg))
    assert [(r.chunk_id, pytest.approx(r.score, abs=1e-7)) for r in got] == sorted(want.items(), key=lambda x: -x[1])


def test_fusion_ties_keep_first_appearance_and_top_is_one(spark):
    rows = [("q", 0, 0, "a"), ("q", 0, 1, "b"), ("q", 1, 0, "a"), ("q", 1, 1, "c"), ("p", 0, 0, "z")]
    got = retrieval.fuse(spark.createDataFrame(rows, "query_id string, list_no int, place int, chunk_id string")).collect()
    by = {(r.query_id, r.place): (r.chunk_id, r.fused) for r in got}
    assert by["q", 0] == ("a", 1.0) and by["p", 0] == ("z", 1.0) and (by["q", 1][0], by["q", 2][0]) == ("b", "c")


def test_dense_search_equals_brute_force_in_blocks(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(99, None)], "vec_id long, embedding array<double>")
    q = df.where("vec_id % 7 = 0").withColumnRenamed("vec_id", "query_id")
    got = {(r.query_id, r.place): (r.vec_id, r.score) for r in retrieval.dense_top(q, df.repartition(5), 3, None, block=4).collect()}
    for i in range(0, 60, 7):
        s = np.round(v @ v[i], 6)
        best = sorted(range(60), key=lambda k: (-s[k], k))[:3]
        assert [got[i, p][0] for p in range(3)] == best


def test_vectors_that_do_not_fit_are_refused(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "vec_id long, embedding array<double>")
    for bad in (df, spark.createDataFrame([(1, [1.0, float("nan")])], "vec_id long, embedding array<double>")):
        with pytest.raises(Exception, match="vectors"):
            retrieval.dense_top(df.where("vec_id = 1").withColumnRenamed("vec_id", "query_id"), bad).collect()


def test_hybrid_drops_the_weight_of_an_empty_list(spark):
    lex = spark.createDataFrame([("q", "a", 0, 3.0), ("q", "b", 1, 2.0), ("only", "c", 0, 1.0)], "query_id string, chunk_id string, place int, score double")
    vec = spark.createDataFrame([("q", "b", 0, 0.9)], "query_id string, chunk_id string, place int, score double")
    got = {(r.query_id, r.place): (r.chunk_id, round(r.fused, 6), r.dense, r.lexical) for r in retrieval.hybrid(lex, vec, weights=(2.0, 1.0)).collect()}
    assert got["only", 0] == ("c", 1.0, 0.0, 1.0) and got["q", 0] == ("b", round((2 / 61 + 1 / 62) / (3 / 61), 6), 0.9, 2.0) and got["q", 1][0] == "a"
    with pytest.raises(Exception, match="index of en"):
        retrieval.same_language(spark.createDataFrame([("x", "hi")], "chunk_id string, language string"), "en").collect()


def test_rerank_and_signals(spark):
    ranked = spark.createDataFrame([("q", "a", 0.9, 0), ("q", "b", 0.5, 1), ("q", "c", 0.4, 2)], "query_id string, chunk_id string, fused double, place int")
    again = retrieval.rerank(ranked, spark.createDataFrame([("q", "c", 0.95)], "query_id string, chunk_id string, rerank double"))
    assert [r.chunk_id for r in again.orderBy("place").collect()] == ["c", "a", "b"]
    s = retrieval.signals(ranked, score="fused").first()
    assert (s.s1_top_score, s.s1_n_chunks) == (0.9, 3) and s.s1_score_margin == pytest.approx(0.4)


# ---- claims

FIXTURES = [
    ("F01", "en", ["Claims are rejected if submitted more than 30 days after the discharge date.", "Rejected claims may be appealed within 60 days."], "Claims are rejected if not submitted within 15 days of the discharge date.", "CONTRADICTED"),
    ("F03", "en", ["Rejected claims may be appealed within 60 days of the rejection notice."], "Rejected claims may be appealed within 60 days of the rejection notice.", "SUPPORTED"),
    ("F04", "en", [], "Dental cover is available up to Rs. 25,000 every year.", "UNVERIFIABLE"),
    ("F05", "en", ["Maternity benefits are not available during the first policy year."], "Maternity benefits are available during the first policy year.", "CONTRADICTED"),
    ("F06", "hi", ["अस्पताल से छुट्टी के 30 दिन के भीतर दावा जमा करना होगा।"], "अस्पताल से छुट्टी के 15 दिन के भीतर दावा जमा करना होगा।", "CONTRADICTED"),
    ("F07", "ta", ["வெளியேற்றம் நடந்த 30 நாட்களுக்குள் கோரிக்கை சமர்ப்பிக்க வேண்டும்."], "வெளியேற்றம் நடந்த 15 நாட்களுக்குள் கோரிக்கை சமர்ப்பிக்க வேண்டும்.", "CONTRADICTED"),
]


def test_planted_defects_are_found(spark):
    answers = spark.createDataFrame([(f, lang, a) for f, lang, _, a, _ in FIXTURES], "id string, language string, answer string")
    chunks = [(f"{f}-{i}", c) for f, _, ctx, _, _ in FIXTURES for i, c in enumerate(ctx)]
    shown = spark.createDataFrame([(f, i, f"{f}-{i}") for f, _, ctx, _, _ in FIXTURES for i in range(len(ctx))], "id string, place int, chunk_id string")
    told = claims.evidence_sentences(spark.createDataFrame(chunks, "chunk_id string, text string"))
    got = claims.verify(claims.claim_rows(answers, "id", "answer", "language"), shown, told, "id").collect()
    by = {}
    for r in got:
        by.setdefault(r.id, set()).add(r.verdict)
        assert r.entailment + r.contradiction + r.neutral == pytest.approx(1)
    for f, _, _, _, v in FIXTURES:
        assert v in by[f], f
    assert by["F04"] == {"UNVERIFIABLE"} and "CONTRADICTED" not in by["F03"]


def test_conflict_policy_and_claim_cap(spark):
    said = spark.createDataFrame([("a", "en", 0, "The limit is 30 days for every member.")] + [("b", "en", i, "The limit is 30 days for every member.") for i in range(52)], "id string, language string, claim_ord int, claim string")
    shown = spark.createDataFrame([(k, 0, "yes") for k in "ab"] + [("a", 1, "no")], "id string, place int, chunk_id string")
    told = claims.evidence_sentences(spark.createDataFrame([("yes", "The limit is 30 days for every member."), ("no", "The limit is 15 days for every member.")], "chunk_id string, text string"))
    by = {p: {(r.id, r.claim_ord): r for r in claims.verify(said, shown, told, "id", p).collect()} for p in ("support", "contradiction")}
    assert by["support"]["a", 0].verdict == "SUPPORTED" and by["support"]["a", 0].citations == ["yes"]
    assert by["contradiction"]["a", 0].verdict == "CONTRADICTED" and by["contradiction"]["a", 0].citations == ["no"]
    assert [by["support"]["b", i].verdict for i in (49, 50, 51)] == ["SUPPORTED", "UNVERIFIABLE", "UNVERIFIABLE"]


def test_decompose(spark):
    rows = [("en", "You get 5 books at a time, and magazines are not included."), ("en", "Rice and dal are served."), ("en", "INSUFFICIENT_EVIDENCE for this"), ("en", "short"), ("en", None)]
    got = [list(r.c) for r in spark.createDataFrame(rows, "l string, a string").select(claims.decompose(F.col("a"), F.col("l")).alias("c")).collect()]
    assert got == [["You get 5 books at a time,", "magazines are not included."], ["Rice and dal are served."], [], [], []]


def test_batch_labels(spark):
    both = ["ENTAILMENT", "NEUTRAL"]
    cases = [("1: entailment\n2: neutral", both), ("2. NEUTRAL\n1. ENTAILMENT\n", both), ("```\n[1]: **Entailment** it is\n\n 2) neutral\n```", both), ("`1 - ENTAILMENT\r\n[2]: **NEUTRAL`", both), ("1: ENTAILMENT", None), ("1: ENTAILMENT\n1: NEUTRAL", None),
             ("1: ENTAILMENT\n3: NEUTRAL", None), ("Here they are:\n1: ENTAILMENT\n2: NEUTRAL", None), ("1: ENTAILMENT\n2: NEUTRALLY", None), ("nonsense", None), ("", None), (None, None), ("99999999999: NEUTRAL\n2: NEUTRAL", None)]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(cases)], "i int, r string")
    got = {r.i: r.x and list(r.x) for r in df.select("i", claims.batch_labels(F.col("r"), 2).alias("x")).collect()}
    assert got == {i: w for i, (_, w) in enumerate(cases)}
    assert spark.createDataFrame([("1: supported",)], "r string").select(claims.batch_labels(F.col("r"), 1, review.VERDICTS).alias("x")).first().x == ["SUPPORTED"]


def test_spans_follow_a_cursor(spark):
    df = spark.createDataFrame([("same here. same here.", ["same here.", "same here.", "gone"])], "a string, c array<string>")
    r = claims.claim_spans(df, "a", "c").first()
    assert [s and (s.start, s.end) for s in r.spans] == [(0, 10), (11, 21), None]


# ---- confidence

def test_calibration_against_plain_python(spark):
    rng = random.Random(7)
    rows = [(round(rng.random(), 2), int(rng.random() < 0.6)) for _ in range(400)] + [(0.0, 1), (1.0, 1)]
    df = spark.createDataFrame([("a", *r) for r in rows], "g string, p double, y int")
    bins = [[] for _ in range(10)]
    for p, y in rows:
        k = next(i for i in range(10) if (p > i / 10 or i == 0) and p <= (i + 1) / 10)
        bins[k].append((p, y))
    ece = sum(len(b) / len(rows) * abs(np.mean([p for p, _ in b]) - np.mean([y for _, y in b])) for b in bins if b)
    got = confidence.expected_error(df, ["g"]).first()
    assert got.ece == pytest.approx(ece) and got.brier == pytest.approx(np.mean([(p - y) ** 2 for p, y in rows]))
    groups, cur, s = [], [], sorted(rows, key=lambda r: r[0])
    for i, r in enumerate(s):
        cur.append(r)
        if len(cur) >= len(s) / 10 and i + 1 < len(s) and s[i + 1][0] != r[0]:
            groups.append(cur)
            cur = []
    groups += [cur] if cur else []
    ace = sum(len(g) / len(s) * abs(np.mean([p for p, _ in g]) - np.mean([y for _, y in g])) for g in groups)
    r = confidence.adaptive_error(df).first()
    assert (r.groups, r.n) == (len(groups), len(s)) and r.ace == pytest.approx(ace)
    empty = df.where("false")
    assert confidence.adaptive_error(empty).first().ace == 0.0 and confidence.reliability(empty).count() == 10


def test_temperature_picks_the_least_loss(spark):
    rows = [(0.9, 1), (0.9, 0), (0.2, 0), (0.6, 1), (0.6, 0)]
    got = confidence.best_temperature(confidence.temperature_grid(spark.createDataFrame(rows, "p double, y int"))).first()

    def nll(t):
        z = [1 / (1 + math.exp(-math.log(p / (1 - p)) / t)) for p, _ in rows]
        return -np.mean([math.log(max(1e-9, min(1 - 1e-9, q if y else 1 - q))) for q, (_, y) in zip(z, rows)])

    ts = [i * 5 / 200 for i in range(1, 201)]
    assert got.t == pytest.approx(min(ts, key=lambda t: (round(nll(t), 9), t)))


def test_logistic_fit_against_loops(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 2))
    y = (x[:, 0] - x[:, 1] > 0).astype(float)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)] + [(None, 1.0, 1.0)], "a double, b double, y double")
    m = confidence.fit_logistic(df, ["a", "b"], "y")
    z = (x - x.mean(0)) / x.std(0)
    w, b = [0.0, 0.0], 0.0
    for _ in range(400):
        p = [1 / (1 + math.exp(-(w[0] * r[0] + w[1] * r[1] + b))) for r in z]
        g = [sum((pi - yi) * r[k] for pi, yi, r in zip(p, y, z)) / len(y) + 0.01 * w[k] for k in (0, 1)]
        gb = sum(pi - yi for pi, yi in zip(p, y)) / len(y)
        w, b = [w[k] - 0.1 * g[k] for k in (0, 1)], b - 0.1 * gb
    assert m["weights"] == pytest.approx(w, abs=1e-9) and m["bias"] == pytest.approx(b, abs=1e-9) and m["rows"] == 40
    s = df.select(confidence.model_score(m, F.lit(0.5)).alias("p")).collect()
    assert s[-1].p == 0.5
    with pytest.raises(ValueError):
        confidence.check_model(m, ["a"])


def test_heuristic_and_band(spark):
    r = spark.range(1).select(confidence.heuristic(F.lit(1.0), F.lit(0.75), F.lit(1.0), F.lit(None), F.lit(False), F.lit(0.0)).alias("s"), confidence.band(F.lit(0.45)).alias("b")).first()
    assert r.s == pytest.approx(0.55 + 0.15 + 0.15 + 0.1) and r.b == "MEDIUM"


# ---- correction

@pytest.mark.parametrize("n,s,c,u,score,band,top,done,want", [
    (0, 0, 0, 0, 0.0, "LOW", 0.0, False, "ACCEPT"), (2, 2, 0, 0, 0.9, "HIGH", 1.0, False, "ACCEPT"), (2, 1, 1, 0, 0.5, "MEDIUM", 1.0, False, "REGENERATE"), (2, 1, 0, 1, 0.5, "MEDIUM", 0.1, False, "RE_RETRIEVE"),
    (2, 1, 0, 1, 0.2, "LOW", 1.0, False, "ABSTAIN"), (2, 1, 0, 1, 0.5, "MEDIUM", 1.0, True, "ABSTAIN"), (2, 1, 0, 1, 0.5, "MEDIUM", 1.0, False, "PRUNE"), (3, 1, 0, 2, 0.5, "MEDIUM", 1.0, False, "ABSTAIN"), (1, 1, 0, 0, 0.4, "LOW", 1.0, False, "PRUNE"),
])
def test_decisions(spark, n, s, c, u, score, band, top, done, want):
    x = correction.decide(*[F.lit(v) for v in (n, s, c, u, score, band, top, done)])
    assert spark.range(1).select(x.alias("x")).first().x == want


def test_prune_and_rounds(spark):
    parts = "array<struct<claim:string,start:int,end:int,flagged:boolean>>"
    text = "Keep this one. Drop this one, and keep the rest."
    rows = [(text, [("Keep this one.", 0, 14, False), ("Drop this one,", 15, 29, True)]), (text, [("Keep this one", None, None, False), ("lost", None, None, True)]), (text, [("Keep this one.", 0, 14, False)])]
    got = [r.x for r in spark.createDataFrame(rows, f"a string, c {parts}").select(correction.prune(F.col("a"), F.col("c")).alias("x")).collect()]
    assert got == ["Keep this one. and keep the rest.", "Keep this one.", text]
    cand = spark.createDataFrame([("a", 0, 1, 1, 0), ("a", 1, 1, 2, 0), ("a", 2, 2, 0, 0), ("a", 3, 9, 0, 0), ("b", 0, 2, 1, 0), ("b", 1, 1, 0, 0)], "k string, round int, supported int, contradicted int, unverifiable int")
    kept = {r.k: (r.kept_round, r.supported) for r in correction.rounds(cand, "k").collect()}
    assert kept == {"a": (2, 2), "b": (0, 2)}


# ---- evaluation

def test_classification_hand_case(spark):
    df = spark.createDataFrame([("S", "S"), ("S", "S"), ("S", "C"), ("C", "C")], "g string, p string")
    by = {r.label: r for r in evaluation.classification(evaluation.confusion(df, "g", "p")).collect()}
    assert (by["S"].precision, by["C"].precision) == (1.0, 0.5) and by["S"].recall == pytest.approx(2 / 3) and by["S"].f1 == pytest.approx(0.8) and by["C"].f1 == pytest.approx(2 / 3) and by["S"].accuracy == 0.75


def test_holm_hand_cases(spark):
    sig = lambda rows: {r.name for r in evaluation.holm(spark.createDataFrame(rows, "name string, p double")).where("significant").collect()}
    assert sig([("a", 0.001), ("b", 0.9), ("c", 0.8)]) == {"a"} and sig([(str(i), 0.04) for i in range(6)]) == set()


def test_retrieval_quality_hand_case(spark):
    rows = [("s", 1, ["x", "a", "b"], ["a", "c"]), ("s", 2, [], ["a"]), ("s", 3, ["z"], []), ("s", 4, None, None)]
    r = evaluation.retrieval_quality(spark.createDataFrame(rows, "s string, k int, got array<string>, gold array<string>"), ["s"], "k", "got", "gold").first()
    ndcg = (1 / math.log2(3)) / (1 + 1 / math.log2(3))
    assert (r.n, r.recall, r.mrr, r.empty_rate) == (4, 0.25, 0.25, 0.5) and r.ndcg == pytest.approx(ndcg / 2)


def test_abstention_kappa_percentile_gap(spark):
    rows = [("a", True, True), ("a", True, False), ("a", False, True), ("a", False, False), ("a", None, True)]
    r = evaluation.abstention(spark.createDataFrame(rows, "g string, abstained boolean, should_abstain boolean"), ["g"]).first()
    assert (r.n, r.abstention_rate, r.abstention_precision, r.abstention_recall, r.over_abstention_rate) == (4, 0.5, 0.5, 0.5, 0.5)
    c = spark.createDataFrame([("k", "A", "A", 20), ("k", "A", "B", 5), ("k", "B", "A", 10), ("k", "B", "B", 15)], "g string, gold string, pred string, n long")
    assert evaluation.kappa(c, ["g"], ["A", "B"]).first().kappa == pytest.approx(0.4)
    assert evaluation.kappa(spark.createDataFrame([("k", "A", "A", 3)], "g string, gold string, pred string, n long"), ["g"], ["A", "B"]).first().kappa == 1.0
    x = spark.createDataFrame([(4.0,), (2.0,), (3.0,), (1.0,)], "x double")
    assert ranking.nearest_ranks(x, [], "x", {"a": 0.5, "b": 0.95}).first() == (2.0, 4.0)
    v = spark.createDataFrame([("en", 0.5), ("hi", 0.4)], "l string, v double").withColumn("s", F.lit("s"))
    assert {r.l: r.gap for r in evaluation.gaps(v, ["s"], "l", "v", "en").collect()} == {"en": 0.0, "hi": pytest.approx(-0.2)}


def test_bootstrap_interval_covers_and_repeats(spark):
    rows = [("a", 0.9)] * 30 + [("b", 0.1 * (i % 10)) for i in range(300)] + [("b", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    one, two = ({r.g: r for r in evaluation.bootstrap_mean(df.repartition(n), ["g"], "v").collect()} for n in (1, 7))
    assert one["a"].low == pytest.approx(0.9) and one["a"].high == pytest.approx(0.9) and one["b"].n == 300
    assert one["b"].low < one["b"]["mean"] < one["b"].high and one["b"].low == two["b"].low
    se = np.std([0.1 * (i % 10) for i in range(300)]) / math.sqrt(300)
    assert one["b"].high - one["b"].low == pytest.approx(2 * 1.96 * se, rel=0.1)


def test_bootstrap_of_a_hot_group_in_pieces(spark):
    """A group with most rows, all of them different, drawn in 16 pieces: the interval is that of drawing rows one by one."""
    rng = np.random.default_rng(3)
    v = rng.exponential(size=8000)
    df = spark.createDataFrame([("hot", float(x)) for x in v] + [("cold", float(x)) for x in v[:50]], "g string, v double")
    got = {r.g: r for r in evaluation.bootstrap_mean(df, ["g"], "v", shard=500).collect()}
    means = np.sort([rng.choice(v, len(v)).mean() for _ in range(2000)])
    assert got["hot"].n == 8000 and got["hot"]["mean"] == pytest.approx(v.mean())
    assert got["hot"].low == pytest.approx(means[50], abs=0.006) and got["hot"].high == pytest.approx(means[1950], abs=0.006) and got["cold"].n == 50
    drawn, groups = evaluation.resampled(df, ["g"], [F.lit(1.0), F.col("v")], shard=500)
    sizes = drawn.join(groups.select("_key", "n"), "_key").selectExpr("s0 = n AS same").distinct().collect()
    assert [r.same for r in sizes] == [True]  # every resample has as many rows as the group


def test_calibration_interval_against_drawing_rows(spark):
    rng = np.random.default_rng(5)
    p = rng.random(200).round(2)
    y = (rng.random(200) < p).astype(int)

    def ece(p, y):
        k = np.ceil(p * 10 - 1e-9).clip(1)
        return sum(abs((p[k == b] - y[k == b]).sum()) for b in range(1, 11)) / len(p)

    got = evaluation.calibration_interval(spark.createDataFrame([("a", float(a), int(b)) for a, b in zip(p, y)], "g string, p double, y int"), ["g"]).first()
    stats = np.sort([ece(p[i], y[i]) for i in (rng.integers(0, 200, 200) for _ in range(2000))])
    assert got.n == 200 and got.ece == pytest.approx(ece(p, y)) and got.low == pytest.approx(stats[50], abs=0.012) and got.high == pytest.approx(stats[1950], abs=0.012)
    assert evaluation.calibration_interval(spark.createDataFrame([], "g string, p double, y int"), ["g"]).count() == 0


def test_gates_one_by_one(spark):
    good = [("en", i < 12, i < 12, True, True, 0.95, 150.0, 100.0) for i in range(60)]
    spoil = {
        "enough_reviewed": lambda r: r[11:], "enough_answered": lambda r: [x[:1] + (True,) + x[2:] if i >= 30 else x for i, x in enumerate(r)], "both_kinds": lambda r: [x[:2] + (False,) + x[3:] for x in r], "unsupported_ok": lambda r: [x[:3] + (i % 10 != 0 or x[1],) + x[4:] for i, x in enumerate(r)],
        "over_abstention_ok": lambda r: [x[:1] + (i < 24,) + x[2:] for i, x in enumerate(r)], "recall_ok": lambda r: [x[:1] + (i < 9,) + x[2:] for i, x in enumerate(r)], "calibrated_ok": lambda r: r[:-1] + [r[-1][:4] + (False,) + r[-1][5:]], "ece_ok": lambda r: [x[:5] + (0.5,) + x[6:] for x in r],
        "latency_ok": lambda r: [x[:6] + ((900.0,) if i % 10 == 0 else (150.0,)) + x[7:] for i, x in enumerate(r)],
    }
    schema = "language string, abstained boolean, should_abstain boolean, fully_supported boolean, calibrated boolean, confidence double, latency_ms double, baseline_latency_ms double"
    one = evaluation.gates(spark.createDataFrame(good, schema), "language").first()
    assert one.passed and all(one[k] for k in spoil)
    for gate, f in spoil.items():
        r = evaluation.gates(spark.createDataFrame(f(good), schema), "language").first()
        assert not r[gate] and not r.passed, gate


def test_correction_effect_hand_case(spark):
    rows = [("a", 0.5, 0.2, False, 0.8, 0.4), ("a", 0.5, 0.6, True, 0.8, 0.4), ("a", None, 0.1, True, 1.0, 1.0), ("b", 0.0, 0.0, None, None, None)]
    got = {r.s: r for r in evaluation.correction_effect(spark.createDataFrame(rows, "s string, before double, after double, regressed boolean, relevance_before double, relevance_after double"), ["s"]).collect()}
    a, b = got["a"], got["b"]
    assert (a.n, a.improvement_rate, a.regression_rate, a.net_improvement) == (2, 0.5, 0.5, 0.0) and a.relative_reduction == pytest.approx(0.2) and a.relevance_retention == pytest.approx(0.5)
    assert (b.n, b.relative_reduction, b.relevance_retention) == (1, 0.0, 1.0)


def test_feature_rows_keep_absent_apart_from_zero(spark):
    r = spark.range(1).select(*confidence.feature_row({"s1_n_chunks": F.lit(0), "answer_tokens": F.lit(3)})).first()
    assert len(r) == 17 and r.s1_n_chunks == 0.0 and r.answer_tokens == 3.0 and r.s3_mean_logprob is None and r.s2_n_claims is None
    with pytest.raises(ValueError):
        confidence.feature_row({"odd": F.lit(1)})


def test_paired_takes_the_last_run(spark):
    rows = [("base", "q", 0.5, 1), ("base", "q", 0.3, 2), ("new", "q", 0.9, 1), ("new", "other", 0.9, 1)]
    got = evaluation.paired(spark.createDataFrame(rows, "s string, k string, v double, o int"), ["k"], "s", "v", "base", "o").collect()
    assert [(r.s, r.k, round(r.difference, 6)) for r in got] == [("new", "q", 0.6)]


# ---- ranking

def test_places_and_totals_do_not_depend_on_partitions(spark):
    df = spark.range(500).withColumn("g", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") == 7, None).otherwise("cold"))
    got = [sorted(map(tuple, ranking.hash_place(df.repartition(n), ["g"], F.xxhash64("id"), "p", ["id"]).select("id", "p").collect())) for n in (1, 5)]
    assert got[0] == got[1]
    hot = [p for i, p in got[0] if i % 3 == 0]
    assert sorted(hot) == list(range(len(hot)))
    t = ranking.running_total(df.select("id", F.lit(2).alias("v")), "id", "v", "t", parts=6).collect()
    assert {r.id: r.t for r in t} == {i: 2 * (i + 1) for i in range(500)}
    order = {r.id: (r.h, r.p) for r in ranking.hash_place(df, ["g"], F.xxhash64("id"), "p", ["id"]).withColumn("h", F.xxhash64("id")).where("g = 'hot'").collect()}
    assert [p for _, p in sorted(order.values())] == list(range(len(order)))


def test_running_totals_of_millions_with_a_payload(spark):
    """Also by group, one of them with a third of all rows; ties share a total."""
    df = spark.range(1_500_000).select((F.col("id") * 7919 % 1_400_017).cast("double").alias("p"), (F.col("id") % 5 + 1).alias("c"), F.md5(F.col("id").cast("string")).alias("payload"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("g"))
    for by in (None, ["g"]):
        got = ranking.running_total(df, "p", "c", "t", by).select("p", "c", "g", "t").toPandas()
        each = got.groupby([*(by or []), "p"], as_index=False).agg(c=("c", "sum"), lo=("t", "min"), hi=("t", "max")).sort_values("p")
        want = each.groupby(by[0]).c.cumsum() if by else each.c.cumsum()
        assert len(got) == 1_500_000 and (each.lo == want).all() and (each.hi == want).all()


def test_nearest_ranks_against_sorting(spark):
    rng = random.Random(2)
    rows = [(g, rng.randrange(40) / 4) for g, n in (("hot", 3000), ("a", 1), ("b", 20), (None, 7)) for _ in range(n)] + [("c", None)]
    got = {r.g: (r.p50, r.p95) for r in ranking.nearest_ranks(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    want = {}
    for g in {g for g, v in rows if v is not None}:
        vs = sorted(v for k, v in rows if k == g)
        want[g] = tuple(vs[max(0, math.ceil(len(vs) * q) - 1)] for q in (0.5, 0.95))
    assert got == want


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_are_the_intended_ones(spark, data):
    from attestra.plans import queries as Q

    assert "WindowGroupLimit" in plan_of(Q.bm25_topk(spark, data)) and "WindowGroupLimit" in plan_of(Q.rrf_fuse(spark, data))
    p = plan_of(Q.abstention_metrics(spark, data))
    assert "PushedFilters: [IsNotNull(abstained)" in p and "answer" not in p.split("ReadSchema")[1]
    assert "Python" not in plan_of(Q.retrieval_metrics(spark, data)) and "Python" not in plan_of(Q.validate_questions(spark, data))
    for name in ("validate_questions", "paired_systems", "evidence_context", "verify_claims"):
        assert "CartesianProduct" not in plan_of(Q.QUERIES[name](spark, data))


def test_hash_sample_is_bounded_and_fixed(spark):
    df = spark.range(20000)
    got = [{r.id for r in ranking.hash_sample(df.repartition(n), F.xxhash64("id"), 1000).collect()} for n in (2, 7)]
    assert got[0] == got[1] and 850 < len(got[0]) < 1150
    assert ranking.hash_sample(df, F.xxhash64("id"), 50000).count() == 20000 and ranking.hash_sample(df.where("false"), F.xxhash64("id"), 5).count() == 0


# ---- review

def test_final_labels_and_sample(spark):
    ev = [(1, "item", "i1", None, None), (2, "annotation", "i1", "supported", "llm"), (3, "annotation", "i1", "CONTRADICTED", "human"), (4, "annotation", "i1", "UNVERIFIABLE", "human"), (5, "item", "i2", None, None), (6, "annotation", "i2", "SUPPORTED", "llm"), (7, "annotation", "i2", "odd", "human"), (8, "item", "i3", None, None)]
    df = spark.createDataFrame(ev, "seq long, event_type string, item_id string, label string, source string")
    assert {r.item_id: (r.label, r.label_source) for r in review.final_labels(df).collect()} == {"i1": ("UNVERIFIABLE", "human"), "i2": ("SUPPORTED", "llm"), "i3": (None, None)}
    assert [r.item_id for r in review.disagreements(df).collect()] == ["i1"] and {r.item_id for r in review.needs_human(df).collect()} == {"i2", "i3"}
    items = spark.range(100).selectExpr("id", "CASE WHEN id < 95 THEN 'x' WHEN id < 98 THEN 'y' END AS s")
    n = {r.s: r["count"] for r in review.stratified(items, "id", ["s"]).groupBy("s").count().collect()}
    assert n == {"x": 28, "y": 3, None: 2}


def test_anchors_skip_overlaps(spark):
    df = spark.createDataFrame([("The limit is 30 days. Then it ends.", ["the limit is 30 days.", "limit is 30", "then it ends!", "zzz zzz zzz", "30"])], "a string, c array<string>")
    got = df.select(review.anchors(F.col("a"), F.col("c")).alias("x")).first().x
    assert [(r.start, r.end, r.claim_no) for r in got] == [(0, 20, 0), (22, 34, 2)]


def test_evidence_difference(spark):
    df = spark.createDataFrame([("Nothing here. Claims are not paid within 30 days.", "Claims are paid within 15 days"), ("abc", "xyz uvw")], "p string, c string")
    a, b = [r.x for r in review.evidence_difference(df, "p", "c").collect()]
    assert a.sentence == "Claims are not paid within 30 days." and list(a.extra) == ["not", "30"] and b is None


def test_question_rules(spark, data):
    q = spark.read.parquet(f"{data}/questions.parquet")
    issues = {r.issue for r in review.question_issues(q, spark.read.parquet(f"{data}/chunks.parquet")).collect()}
    assert issues and review.question_issues(q.where("false")).count() == 0
