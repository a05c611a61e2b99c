"""Further operators: replies of judges and decomposers, gates, variants, reviewed rows, admission on streams."""

import pytest
from pyspark.sql import functions as F

from attestra.functions import text as X
from attestra.operators import claims, confidence, retrieval, review
from attestra.streaming import limits


def test_claim_lines(spark):
    answer = "The limit is thirty days for every member of the plan and it ends then."
    rows = [("1. The limit is thirty days.\n- It ends then, always.\n\n* ok", answer), ("NO_CLAIMS", answer), ("ok", answer), ("\n".join(f"claim number {i}" for i in range(25)), answer), ("A far longer claim than the answer itself. " * 3, "30 days, yes.")]
    got = [r.c if r.c is None else list(r.c) for r in spark.createDataFrame(rows, "r string, a string").select(claims.claim_lines(F.col("r"), F.col("a")).alias("c")).collect()]
    assert got == [["The limit is thirty days.", "It ends then, always."], [], None, None, None]


def test_whole_answer_and_label_scores(spark):
    df = spark.createDataFrame([("abc", " supported"), (" ", "odd"), ("x", None)], "a string, l string")
    got = df.select(claims.whole_answer(F.col("a")).alias("w"), claims.label_scores(F.col("l")).alias("s")).collect()
    assert [len(r.w) for r in got] == [1, 0, 1] and (got[0].w[0].start, got[0].w[0].end) == (0, 3)
    assert got[0].s.entailment == pytest.approx(0.9) and tuple(got[1].s) == (0.0, 0.0, 1.0) == tuple(got[2].s)


@pytest.mark.parametrize("n,s,ev,whole,cov,own,want", [
    (2, 2, True, "SUPPORTED", "FULL", False, (None, False, False)), (2, 2, True, "SUPPORTED", "PARTIAL", False, (None, True, False)), (2, 2, True, "SUPPORTED", "PARTIAL", True, (None, False, True)),
    (2, 2, True, "UNVERIFIABLE", "PARTIAL", None, (None, True, False)), (2, 2, True, "UNVERIFIABLE", None, None, ("UNVERIFIABLE", False, False)), (2, 2, True, "CONTRADICTED", "PARTIAL", None, ("CONTRADICTED", False, False)),
    (2, 1, True, "CONTRADICTED", None, None, (None, False, False)), (2, 2, False, "CONTRADICTED", None, None, (None, False, False)),
])
def test_answer_gate(spark, n, s, ev, whole, cov, own, want):
    lit = lambda v, t: F.lit(v).cast(t)
    x = claims.answer_gate(lit(n, "int"), lit(s, "int"), lit(ev, "boolean"), lit(whole, "string"), lit(cov, "string"), lit(own, "boolean"))
    assert tuple(spark.range(1).select(x.alias("x")).first().x) == want


def test_variants_route_and_acceptance(spark):
    rows = spark.createDataFrame([("q", 0, "a", 0.5, 0), ("q", 0, "b", 0.4, 1), ("q", 1, "b", 0.9, 0)], "query_id string, variant int, chunk_id string, score double, place int")
    asked = spark.createDataFrame([("q", 0), ("q", 1), ("q", 2)], "query_id string, variant int")
    got = [(r.chunk_id, r.score, round(r.fused, 6)) for r in retrieval.fuse_variants(rows, asked).orderBy("place").collect()]
    assert got == [("b", 0.9, round((1 / 61 + 1 / 62) / (3 / 61), 6)), ("a", 0.5, round(1 / 3, 6))]
    df = spark.createDataFrame([("hi", None), ("de", None), ("hi", "ta")], "l string, w string")
    assert [r.x for r in df.select(retrieval.route(F.col("l"), F.col("w"), ["en", "hi", "ta"]).alias("x")).collect()] == ["hi", "en", "ta"]
    with pytest.raises(Exception, match="no index"):
        df.select(retrieval.route(F.col("l"), F.col("w"), ["ta"]).alias("x")).collect()
    v = spark.createDataFrame([("नियम", "hi"), ("niyam", "hi"), ("விதி", "ta"), ("rule", "en"), (None, "en")], "v string, l string")
    assert [r.x for r in v.select(retrieval.accepted_variant(F.col("v"), F.col("l"), F.lit("q")).alias("x")).collect()] == [True, False, True, True, False]


def test_unit_interval(spark):
    df = spark.createDataFrame([("a", 0.2), ("a", 1.0), ("b", 0.0), ("b", 3.0)], "g string, s double")
    got = sorted((r.g, round(r.u, 4)) for r in df.select("g", retrieval.unit_interval(F.col("s"), ["g"]).alias("u")).collect())
    assert got == [("a", 0.2), ("a", 1.0), ("b", 0.5), ("b", 0.9526)]


def test_judges(spark):
    rows = [("a", ["c"], "I say: supported.", 0.7), ("b", [], "SUPPORTED", 0.9), ("c", None, None, None), ("d", ["c"], "SUPPORTED or CONTRADICTED", 0.9), ("e", ["c"], "UNSUPPORTED", 0.9)]
    got = {r.item_id: (r.label, r.confidence) for r in review.proposed_labels(spark.createDataFrame(rows, "item_id string, evidence array<string>, reply string, reply_confidence double")).collect()}
    assert got == {"a": ("SUPPORTED", 0.7), "b": ("UNVERIFIABLE", 1.0), "c": ("UNVERIFIABLE", 1.0), "d": ("UNVERIFIABLE", 0.0), "e": ("UNVERIFIABLE", 0.0)}
    review.check_judge("x", "y")
    with pytest.raises(ValueError):
        review.check_judge("x", "x")


def test_retry_and_names(spark):
    df = spark.createDataFrame([("Please retry in 1h2m3.5s.",), ('{"retryDelay": "56s"}',), ("no",), (None,)], "t string")
    assert [r.x for r in df.select(X.retry_seconds(F.col("t")).alias("x")).collect()] == [3723.5, 56.0, None, None]
    n = spark.createDataFrame([("../../etc/a b.pdf",), ("C:\\x\\நியமம்?.txt",), ("/",)], "t string")
    assert [r.x for r in n.select(X.safe_name(F.col("t")).alias("x")).collect()] == ["a b.pdf", "நியமம்.txt", None]


def reviews(spark, n=30, spoil=None):
    rows = []
    for split in ("train", "dev"):
        for i in range(n):
            good = i % 2 == 0
            rows.append([f"{split}{i}", f"p{split}{i}", f"Question {split} {i}", "en", split, True, "r", good, {"s2_supported_ratio": 0.9 if good else 0.2, "s1_top_score": 0.5 + i / 100}])
    if spoil:
        spoil(rows)
    return spark.createDataFrame(rows, "qid string, parallel_id string, question string, language string, split string, human_reviewed boolean, reviewer string, fully_supported boolean, features map<string,double>")


def test_reviewed_rows_are_fitted(spark):
    model, report = confidence.fit_reviews(reviews(spark), ["s1_top_score", "s2_supported_ratio", "s3_mean_logprob"])
    assert model["features"] == ["s1_top_score", "s2_supported_ratio"] and report["importance"][0][0] == "s2_supported_ratio" and report["dev"] == 30 and report["ece"] < 0.1


@pytest.mark.parametrize("spoil,problem", [
    (lambda r: r[0].__setitem__(4, "test"), "split"), (lambda r: r[0].__setitem__(6, " "), "not attributed"), (lambda r: r[0].__setitem__(0, r[40][0]), "qid twice"), (lambda r: r[0].__setitem__(2, r[40][2].upper() + " "), "question twice"),
    (lambda r: r[0].__setitem__(8, {"odd": 1.0}), "unknown"), (lambda r: r[0].__setitem__(8, {"s1_top_score": float("inf")}), "not finite"), (lambda r: r.__delitem__(slice(0, 15)), "too few train"), (lambda r: [x.__setitem__(7, True) for x in r], "one label only"),
])
def test_spoilt_reviews_are_refused(spark, spoil, problem):
    with pytest.raises(ValueError, match=problem):
        confidence.fit_reviews(reviews(spark, spoil=spoil), ["s1_top_score", "s2_supported_ratio"])


def test_admission_on_a_stream_equals_the_batch(spark, data, tmp_path):
    ev = limits.timed(spark.read.parquet(f"{data}/events.parquet"))
    folder, sink = str(tmp_path / "in"), str(tmp_path / "out")
    ev.coalesce(1).write.parquet(folder)
    limits.run_available(limits.admitted_stream(limits.stream(spark, folder, ev.schema), 2, 3600), "append", str(tmp_path / "c"), sink)
    got = {r.event_id: r.admitted for r in spark.read.parquet(sink).collect()}
    assert got == {r.event_id: r.admitted for r in limits.admitted(ev, 2, 3600).collect()} and False in got.values()
