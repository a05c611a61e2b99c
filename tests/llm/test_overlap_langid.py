import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.llm import langid
from attestra.llm import split_overlap as S
from attestra.llm.common import written

BASE = [
    "Can the tenant still claim the firewall exception at the {p}nagar review board once {n} days have passed since the discharge on plan BBNI-{c}?",
    "Which steps must the trainee finish at the {p}puram network lab before the coupon is approved when plan BBTE-{c} lists the surgery and {n} open items?",
    "योजना BBZI-{c} में {n} रुपये की स्थानांतरण के बाद व्यापारी को {p}पुरम कर्मचारी पोर्टल में अपील पत्र कितने दिन में देना होगा?",
]


def place(rng):
    return "".join(rng.choice(["ka", "mi", "ru", "lo", "ve", "ta", "ni", "so"]) for _ in range(4))


def altered(text, rng, kind):
    ws = text.split()
    if kind == 0:
        return "Please tell me, " + text
    if kind == 1:
        return text.upper().rstrip("?") + " thank you"
    if kind == 2:
        k = rng.randrange(3, len(ws) - 3)
        while any(c.isdigit() for c in ws[k]) or ws[k].endswith(("nagar", "puram", "पुरम")):
            k = rng.randrange(3, len(ws) - 3)
        return " ".join(ws[:k] + ws[k + 1 :])
    if kind == 3:
        half = len(ws) // 2
        return " ".join(ws[half:] + ws[:half])
    if kind == 4:
        return re.sub(r"\S+(nagar|puram|पुरम)", lambda m: f"{place(rng)}{m[1]}", text)
    if kind == 5:
        return text.replace("-1", "-7", 1)
    return text


def rows_(seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        t = rng.choice(BASE).format(n=100 + i, c=1000 + i, p=place(rng))
        rows.append((len(rows), t, "train", "s"))
        for k in rng.sample(range(7), 2):
            rows.append((len(rows), altered(t, rng, k), rng.choice(["dev", "Test", "train", None]), "s"))
    return rows + [(900, None, "dev", "s"), (901, "", "test", "s"), (902, "???", "test", "s"), (903, "word " * 30000, "test", None), (904, "word " * 30000, "train", None)]


def test_pairs_equal_brute_force(spark):
    rows = rows_()
    df = spark.createDataFrame(rows, "row_id long, question string, split string, source string").selectExpr("*", "'x' AS words", "1 AS key")
    got = {tuple(r) for r in S.overlap_pairs(df.repartition(5)).collect()}
    side = lambda s: None if s is None else "t" if s == "train" else "e"
    holders = {}
    for r in rows:
        if r[1] and r[2]:
            numbers, ws = S.parts(r[1])
            for w in ws:
                holders.setdefault(w, set()).add(numbers)
    want = set()
    for x in rows:
        for y in rows:
            if x[0] < y[0] and x[1] and y[1] and {side(x[2]), side(y[2])} == {"t", "e"}:
                (na, wa), (nb, wb) = S.parts(x[1]), S.parts(y[1])
                if wa and na == nb:
                    ok, a, b = S.compare(wa, wb)
                    names = lambda ws: any(len(holders[w]) <= 1 for w in ws)
                    if ok > 0 and not (names(a) and names(b)):
                        want.add((x[0], y[0]))
    assert got == want and (903, 904) in got
    assert S.overlap_pairs(df.where("false")).count() == 0
    report = S.overlap_report(df).collect()
    assert sum(r.n_pairs for r in report) == len(got)
    held = {r[0] for r in rows if side(r[2]) == "e"}
    assert sum(r.n_eval_rows for r in report) == len({k for p in got for k in p if k in held})


def test_candidates_lose_almost_nothing(spark):
    df = spark.createDataFrame(rows_(8), "row_id long, question string, split string, source string")
    rows = written(S.prepared(df))
    cls = rows.groupBy("copy").agg(F.first("numbers").alias("numbers"), F.first("words").alias("words"), F.first("core").alias("core"), F.first("short").alias("short"))
    bands = {}
    for r in S.with_bands(cls).collect():
        bands.setdefault(r.copy, set()).add(r.band)
    info = {r.copy: (r.numbers, set(r.words)) for r in cls.collect()}
    pairs = [(a, b) for a in info for b in info if a < b and info[a][0] == info[b][0] and len(info[a][1] & info[b][1]) / len(info[a][1] | info[b][1]) >= 0.6]
    assert pairs and sum(bool(bands[a] & bands[b]) for a, b in pairs) >= 0.98 * len(pairs)


def test_short_questions_meet_exactly(spark):
    """Questions of few words, two of them replaced, dropped or added, some with a courtesy phrase: every pair of brute force is found."""
    rng = random.Random(3)
    vocabulary = ["claim", "pay", "cover", "rent", "visa", "leave", "bonus", "card", "limit", "late", "form", "fee", "loan", "tax", "desk", "wage"]
    rows = []
    for i in range(60):
        ws = rng.sample(vocabulary, rng.randint(3, 8))
        other = list(ws)
        for _ in range(2):
            other[rng.randrange(len(other))] = rng.choice(vocabulary)
        rng.shuffle(other)
        rows += [(len(rows), " ".join(ws), "train", "s"), (len(rows) + 1, rng.choice(["", "please tell us quickly ", "hello there all "]) + " ".join(other) + rng.choice(["", " thank you so much"]), "dev", "s")]
    df = spark.createDataFrame(rows, "row_id long, question string, split string, source string")
    got = {tuple(r) for r in S.overlap_pairs(df).collect()}
    rare = lambda ws: bool(ws)  # noqa: E731  (none has numbers, so all are one question and all words are its own)
    want = set()
    for x in rows[::2]:
        for y in rows[1::2]:
            ok, a, b = S.compare(S.parts(x[1])[1], S.parts(y[1])[1])
            if (ok > 0 or sorted(S.parts(x[1])[1]) == sorted(S.parts(y[1])[1])) and not (rare(a) and rare(b)):
                want.add((min(x[0], y[0]), max(x[0], y[0])))
    assert got == want and len(want) > 20


def test_only_courtesy_is_forgiven_at_an_end():
    same = lambda a, b: S.compare(a.split(), b.split())[0] > 0
    assert not same("is a waiver of premium covered", "is a waiver of premium covered under the old plan")
    assert same("is a waiver of premium covered", "hello team is a waiver of premium covered thank you very much")


@pytest.mark.parametrize("a,b,near", [("approved", "apprved", True), ("abc", "acb", True), ("abc", "abcd", True), ("abc", "axc", True), ("kaminagar", "rudunagar", False), ("ab", "ab", True)])
def test_close(a, b, near):
    assert S.close(a, b) is near


@pytest.fixture(scope="module")
def model(spark, data):
    d = data.replace("sf0.001", "sf0.01")
    q = spark.read.parquet(f"{d}/questions.parquet")
    return langid.train(q, "question", "language", "row_id"), q


def test_held_out_accuracy(model):
    m, q = model
    rows = [r for r in q.where("question IS NOT NULL AND script = 'native' AND language IN ('hi', 'ta')").select("question", "language").collect()]
    post = m.posteriors([langid.letters(r.question) for r in rows])
    own = {"hi": (0x900, 0x97F), "ta": (0xB80, 0xBFF)}
    judged = [(langid.LANGUAGES[p.argmax()], lang) for p, r in zip(post, rows) for lang, (a, b) in own.items() if sum(a <= ord(c) <= b for c in r.question) > 0.5 * len(r.question)]
    assert np.mean([x == y for x, y in judged]) > 0.99


def test_roman_text_and_mixed_rows(spark, model):
    m, _ = model
    rows = [
        (1, "kyaa yojanaa BBHA-1 sthaanaantaran se pahale karmachaaree se adhik lagaatee hai?", "hi"), (2, "thiddam BBHA-1 il oyvu nadanthaal mukavar kku uthavi kidaikkaathaa?", "hi"),
        (3, "Can the tenant still claim the dental cover at the branch office? योजना में कितने दिन मिलते हैं और कौन निर्णय करता है?", "en"), (4, "Which steps must the trainee finish before the appeal letter is approved?", " EN-in"),
        (5, None, None), (6, "", ""), (7, "12 34 ?", None), (8, "Which steps must the trainee finish before the surgery?", "und"), (9, "Is the plan open? " * 5000, "ta"),
    ]
    df = spark.createDataFrame(rows, "row_id long, question string, language string").selectExpr("*", "1 AS detected2")
    got = sorted(map(tuple, langid.wrong_labels(df, m).collect()))
    assert got == [(2, "ta"), (3, "en"), (3, "hi"), (8, "en"), (9, "en")]
    assert langid.wrong_labels(df.where("false"), m).count() == 0


def test_untrained_model_says_nothing_for_sure(spark):
    m = langid.fit([], [])
    assert m.posteriors(["abc"]).tolist() == [[1 / 3] * 3]
