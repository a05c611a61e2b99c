"""Results over all rows, hot groups included."""

import datetime as dt

from attestra.plans import queries as Q


def test_verdict_profiles_keep_the_probe(spark, tmp_path):
    t = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
    hours = [0, 0.1, 0.2, 5, 5, 90, 90.5, 91]  # several runs in an hour, empty hours, equal times
    rows = [(k * 100 + i, q, s, t + dt.timedelta(hours=h), (i * 7) % 4, (i * 5) % 3, i % 2) for k, (q, s) in enumerate([("en-ins-000000-probe", "a"), ("en-ins-000000-probe", "b"), ("en-ins-000001", "a")]) for i, h in enumerate(hours)]
    rows += [(900, "en-ins-000000-probe", "a", t, None, 0, 0), (901, "en-ins-000002", "a", t, 1, 1, 1)]
    spark.createDataFrame(rows, "record_id long, qid string, system_name string, started_at timestamp, supported long, contradicted long, unverifiable long").write.parquet(f"{tmp_path}/records.parquet")
    want, last = {}, {}
    for r, q, s, at, ok, c, u in sorted(rows, key=lambda x: (x[3], x[0])):
        if ok is not None:
            mine, before = (c, u, -ok), last.get((q, s))
            if before:
                want[r] = (mine < before, before < mine)
            last[q, s] = mine
    got = [(r.record_id, (r.better, r.worse)) for r in Q.verdict_profiles(spark, str(tmp_path)).collect()]
    assert len(got) == len(want) == 21 and dict(got) == want


def test_reference_answers_lend_and_abstain_in_every_group(spark, tmp_path):
    rows = [
        (1, "ins-000000", "en-ins-000000", "en", "Yes.", False), (2, "ins-000000", "hi-ins-000000", "hi", None, False), (3, "ins-000000", "ta-ins-000000", "ta", " ", True),
        (4, "ins-000007", "hi-ins-000007", "hi", None, None), (5, "ins-000007", "ta-ins-000007", "ta", "Own.", True), (6, None, None, "hi", "", False), (7, "ins-000008", "en-ins-000008", "en", None, True),
    ]
    spark.createDataFrame(rows, "row_id long, parallel_id string, qid string, language string, gold_answer string, should_abstain boolean").write.parquet(f"{tmp_path}/questions.parquet")
    got = {r.row_id: r.reference for r in Q.reference_answers(spark, str(tmp_path)).collect()}
    assert got == {1: "Yes.", 2: "(en reference) Yes.", 3: "(en reference) Yes.", 4: "(should abstain)", 5: "Own.", 6: "(should abstain)", 7: "(should abstain)"}
