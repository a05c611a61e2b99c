"""Word counts, n-gram counts and thresholds of problem 8 cover all documents, however small the sample of the trees."""

from collections import Counter

import numpy as np
import pytest

personal = pytest.importorskip("attestra.llm.personal")


def test_counts_cover_all_documents(spark, data):
    docs, names = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/name_parts.parquet")
    finder = personal.train(docs, names, sample_docs=10)
    texts = [r.text for r in docs.select("text").collect() if r.text]
    seen = Counter(w for t in texts for w in {x.lower() for x in personal._WORD.findall(t)})
    assert {w: finder.names.common.get(w) for w in seen} == dict(seen)
    whole = personal.fit(texts, [(r.name_part, r.part_kind) for r in names.collect()])
    assert finder.names.odds == whole.names.odds and finder.names.floor == whole.names.floor


def test_thresholds_count_all_labelled_candidates(spark):
    rows = [(i, [("email", 0, 1, 0.9 if i < 30 else 0.2, int(i < 30)), ("phone", 0, 1, 0.5, None)]) for i in range(90)]
    got, curve = personal.calibration(spark.createDataFrame(rows, f"id long, judged {personal.JUDGED}"))
    assert got["email"] == pytest.approx(0.55) and got["phone"] == 0.5
    assert curve["email"][1].tolist() == [0.0, 1.0] and personal.Finder(None, None, got, curve).chance("email", 0.95) == 1.0


def test_probabilities_are_calibrated():
    rng = np.random.default_rng(1)
    p = rng.random(5000)
    y = (rng.random(5000) < p**2).astype(float)
    scores, chances = personal.isotonic(p, y, np.ones(5000))
    finder = personal.Finder(None, None, {}, {"phone": (scores, chances)})
    assert (np.diff(chances) >= 0).all() and all(abs(finder.chance("phone", x) - x**2) < 0.1 for x in (0.2, 0.5, 0.8, 0.95))
