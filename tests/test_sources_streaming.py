"""Round trips of files, and streams against their batch twins."""

import json
import os

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from attestra.sources import files
from attestra.streaming import limits


def test_documents_from_folders(spark, tmp_path):
    for lang, name, body in (("en", "a.md", b"\xef\xbb\xbfone\r\ntwo"), ("hi", "b.txt", "नियम".encode()), ("en", "c.bin", b"x"), ("en", "big.txt", b"y" * 50), ("en", "nul.txt", b"a\x00b")):
        (tmp_path / lang).mkdir(exist_ok=True)
        (tmp_path / lang / name).write_bytes(body)
    got = {r.path: r for r in files.documents(spark, str(tmp_path), max_file_bytes=40).collect()}
    assert set(got) == {"en/a.md", "hi/b.txt"} and got["en/a.md"].text == "one\ntwo" and got["hi/b.txt"].language == "hi"
    assert got["en/a.md"].doc_id == "en/a.md@" + got["en/a.md"].sha256[:12]
    assert {(r.path, r.reason) for r in files.rejected_documents(spark, str(tmp_path), max_file_bytes=40).collect()} == {("en/big.txt", "too large"), ("en/nul.txt", "not text")}
    assert files.file_manifest(spark, str(tmp_path)).count() == 5


def test_json_lines_and_log(spark, tmp_path):
    p = tmp_path / "q.jsonl"
    p.write_text('{"qid": "a", "gold_chunk_ids": ["x"]}\n\nnot json\n{"qid": "b"}\n')
    rows, bad = files.json_lines(spark, str(p), files.QUESTION)
    assert [r.qid for r in rows.orderBy("qid").collect()] == ["a", "b"] and [r.line for r in bad.collect()] == ["not json"]
    with pytest.raises(Exception):
        files.questions(spark, str(p)).collect()
    log = str(tmp_path / "log")
    for k in range(2):
        files.append_events(spark.createDataFrame([(k, "annotation", f"i{k}")], "seq long, event_type string, item_id string"), log)
    assert files.annotation_log(spark, log).count() == 2


def test_review_sheet(spark, tmp_path):
    p = str(tmp_path / "sheet")
    files.write_review_sheet(spark.createDataFrame([("a", " Correct"), ("b", "partial"), ("c", "incorrect"), ("d", "")], "item_id string, mark string"), p)
    assert {r.item_id: r.score for r in files.read_review_sheet(spark, p).collect()} == {"a": 1.0, "b": 0.5, "c": 0.0}
    files.write_review_sheet(spark.createDataFrame([("a", "maybe")], "item_id string, mark string"), p)
    with pytest.raises(Exception, match="invalid mark"):
        files.read_review_sheet(spark, p).collect()


def test_cache_model_and_manifest(spark, tmp_path):
    req = files.cache_keys(spark.createDataFrame([("m", "p1"), ("m", "p2")], "model string, prompt string"), ["prompt", "model"])
    assert {r.key for r in req.collect()} == {r.key for r in files.cache_keys(spark.createDataFrame([("m", "p2"), ("m", "p1")], "model string, prompt string"), ["model", "prompt"]).collect()}
    path = str(tmp_path / "cache")
    files.cache_store(req.where("prompt = 'p1'").withColumn("response", F.lit("r")), path)
    files.cache_store(req.where("prompt = 'p1'").withColumn("response", F.lit("r")), path)
    hits, misses = files.cache_lookup(req, path)
    assert [r.prompt for r in hits.collect()] == ["p1"] and [r.prompt for r in misses.collect()] == ["p2"]
    assert files.cache_statistics(spark, path).agg(F.sum("entries")).first()[0] == 1
    model = {"features": ["a"], "weights": [1.0], "bias": 0.0, "mean": [0.0], "std": [1.0], "temperature": 1.0}
    files.save_model(spark, model, str(tmp_path / "model"))
    assert files.load_model(spark, str(tmp_path / "model"), ["a"]) == model
    with pytest.raises(ValueError):
        files.load_model(spark, str(tmp_path / "model"), ["b"])
    for n in (1, 3):
        files.write_experiment(spark.range(10).repartition(n), str(tmp_path / f"run{n}"), {"k": 1})
    one, two = (json.loads(next(open(os.path.join(r, f)).read() for r, _, fs in os.walk(tmp_path / f"run{n}" / "manifest") for f in fs if f.endswith(".json"))) for n in (1, 3))
    assert one["checksum"] == two["checksum"] and one["rows"] == 10


def test_evidence_must_be_complete(spark):
    corpus = spark.createDataFrame([("a", "A"), ("b", "B")], "chunk_id string, text string")
    items = spark.createDataFrame([("i", ["b", "a"])], "item_id string, evidence array<string>")
    assert list(files.complete_evidence(items, corpus).first().passages) == ["B", "A"]
    with pytest.raises(Exception, match="not in corpus"):
        files.complete_evidence(spark.createDataFrame([("i", ["z"])], "item_id string, evidence array<string>"), corpus).collect()


def test_streams_agree_with_batches(spark, data, tmp_path):
    ev = spark.read.parquet(f"{data}/events.parquet")
    folder = str(tmp_path / "in")
    ev.repartition(3).write.parquet(folder)
    got = str(tmp_path / "metrics")
    limits.run_available(limits.request_metrics(limits.stream(spark, folder, ev.schema)), "complete", str(tmp_path / "c1"), got)
    assert sorted(map(tuple, spark.read.parquet(got).collect())) == sorted(map(tuple, limits.request_metrics(ev).collect()))
    closed = str(tmp_path / "sessions")
    limits.run_available(limits.closed_sessions(limits.stream(spark, folder, ev.schema)), "append", str(tmp_path / "c2"), closed)
    batch = {(r.user_id, r.session_start, r.n) for r in limits.sessions(limits.timed(ev)).collect()}
    out = {(r.user_id, r.session_start, r.n) for r in spark.read.parquet(closed).collect()}
    assert out and out <= batch


def test_admission_counts_admitted_only(spark):
    rows = [(i, 1, f"2025-01-01 00:00:{s:02d}") for i, s in enumerate([0, 10, 20, 40, 59])] + [(10, 1, "2025-01-01 00:01:00"), (11, 1, "2025-01-01 00:01:10"), (12, 2, "2025-01-01 00:00:00"), (13, 2, None)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = {r.event_id: r.admitted for r in limits.admitted(df, 2, 60).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: False, 10: True, 11: True, 12: True, 13: False}


def test_windows_and_days(spark):
    df = spark.createDataFrame([(i, i % 2, f"2025-01-0{1 + i // 6} 10:{i:02d}:00") for i in range(12)], "event_id long, user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert {r.event_id: r.place for r in limits.daily_places(df.repartition(4)).collect()} == {i: i % 6 + 1 for i in range(12)}
    assert {r.in_window for r in limits.sliding_counts(df, seconds=120).where("event_id = 4").collect()} == {2}


def test_a_visitor_with_a_third_of_all_events(spark):
    """Sessions, sliding counts and admissions of a hot visitor against plain Python."""
    rng = random.Random(6)
    at = dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(i, 0 if i % 3 == 0 else rng.randrange(1, 40), at + dt.timedelta(seconds=rng.choice([rng.random() * 9e5, round(rng.random() * 9e5)])), rng.random()) for i in range(6000)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, value double").withColumn("_t", F.lit("kept"))
    got = {r.event_id: (r.in_window, round(r.sum_in_window, 6)) for r in limits.sliding_counts(df.drop("_t"), seconds=600, value="value").collect()}
    by = {}
    for r in sorted(rows, key=lambda r: r[2]):
        by.setdefault(r[1], []).append(r)
    for rs in by.values():
        for r in rs:
            inside = [x for x in rs if r[2] - dt.timedelta(seconds=600) <= x[2] <= r[2]]
            assert got[r[0]] == (len(inside), round(sum(x[3] for x in inside), 6))
    want = []
    for u, rs in by.items():
        for a, b in zip([None, *rs], rs):
            if a is None or b[2] - a[2] >= dt.timedelta(minutes=30):
                want.append([u, b[2], b[2], 0])
            want[-1][2:] = [b[2], want[-1][3] + 1]
    mine = limits.sessions(df).collect()
    assert sorted((r.user_id, r.session_start.timestamp(), r.session_end.timestamp(), r.n) for r in mine) == sorted((u, a.timestamp(), z.timestamp() + 1800, n) for u, a, z, n in want)
    used, last, day, passed = 0, {}, None, set()
    for i, u, t, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        used, day = (used if t.date() == day else 0), t.date()
        mine_ = last[u] = [x for x in last.get(u, []) if x > t - dt.timedelta(seconds=600)]
        if used < 200 and len(mine_) < 2:
            mine_.append(t)
            used += 1
            passed.add(i)
    assert {r.event_id for r in limits.admitted_with_budget(df, 2, 600, 200).where("admitted").collect()} == passed


def test_every_query_runs_and_survives_empty_tables(spark, data, tmp_path):
    from attestra.plans import queries as Q

    empty = str(tmp_path / "empty")
    for name in ("questions", "records", "annotation_events", "chunks", "documents", "embeddings", "events"):
        spark.read.parquet(f"{data}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    for name, f in Q.QUERIES.items():
        if name == "fitted_confidence":
            with pytest.raises(ValueError):
                f(spark, empty)
        else:
            assert f(spark, empty).count() <= 10, name
    assert set(Q.SQL) <= set(Q.QUERIES)
