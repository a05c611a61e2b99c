"""Text functions against hand-made cases and plain Python."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from attestra.functions import lexicon as L
from attestra.functions import text as X


def one(spark, expr, value, kind="string", **more):
    row = spark.createDataFrame([(value, *more.values())], f"t {kind}" + "".join(f", {k} string" for k in more))
    return row.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("raw,want", [("  a​ b \n c ", "a b c"), ("é", "é"), ("", ""), (None, None), ("போ", unicodedata.normalize("NFC", "போ"))])
def test_normalize(spark, raw, want):
    assert one(spark, X.normalize(F.col("t")), raw) == want


def test_punctuation_keeps_hyphen_and_apostrophe(spark):
    assert one(spark, X.strip_punctuation(F.col("t")), "well-known, isn't (it)?") == "well-known isn't it"


@pytest.mark.parametrize("text,script", [("अस्पताल", "native"), ("hospital", "roman"), ("अस्पताल hospital", "mixed"), ("अस्पताल में भर्ती होने के बाद a", "native"), ("123", "roman"), ("", "roman")])
def test_script(spark, text, script):
    assert one(spark, X.detect_script(F.col("t")), text) == script


@pytest.mark.parametrize("text,language,confidence", [("यह नियम है", "hi", 0.99), ("இது விதி", "ta", 0.99), ("mera claim kab milta hai kya", "hi", 0.8), ("ok fine", "en", 0.25), ("please send me the form", "en", 0.85), ("", "en", 0.0)])
def test_language(spark, text, language, confidence):
    got = one(spark, X.detect_language(F.col("t")), text)
    assert got["language"] == language and got["confidence"] == pytest.approx(confidence, abs=1e-9)


@pytest.mark.parametrize("n,language,want", [(0, "en", 1), (100, "en", 28), (10, "hi", 8), (2, "xx", 1), (5, None, 2), (7, None, 4)])
def test_token_estimate_is_half_even(spark, n, language, want):
    assert one(spark, X.estimate_tokens(F.col("t"), F.col("l")), "x" * n, l=language) == want


@pytest.mark.parametrize("text,want", [
    ("He paid Rs. 500. Then left.", ["He paid Rs. 500.", "Then left."]), ("See Dr. Rao. Ok!", ["See Dr. Rao.", "Ok!"]), ("यह है। वह है।", ["यह है।", "वह है।"]),
    ("End.Next", ["End.", "Next"]), ("Plan A. B follows.", ["Plan A. B follows."]), ("", []),
])
def test_sentences(spark, text, want):
    assert list(one(spark, X.sentences(X.normalize(F.col("t"))), text)) == want


@pytest.mark.parametrize("text,language,want", [
    ("The claims were submitted", "en", ["claims", "claim", "submitted", "submit"]), ("policies of 30 days", "en", ["policies", "polic", "30", "days"]), ("x-ray's", "en", ["x-ray's", "x-ray'"]),
    ("यह नियम है।", "hi", ["नियम"]), ("அறிவிப்பு", "ta", ["அறிவிப்பு", *["அறிவிப்பு"[i:i + 4] for i in range(6)]]), ("größe", "de", ["gr", "e"]), ("", "en", []),
])
def test_tokens(spark, text, language, want):
    assert list(one(spark, X.tokens(X.nfc(F.col("t")), F.col("l")), text, l=language)) == want


def test_stem_takes_first_fitting_suffix(spark):
    want = {"running": "runn", "submitted": "submit", "repeatedly": "repeat", "policies": "polic", "claims": "claim", "cats": None, "bus": None, "2024s": "2024", "12345": None}
    df = spark.createDataFrame([(w,) for w in want], "w string").select("w", X.stem(F.col("w")).alias("s"))
    assert {r.w: r.s for r in df.collect()} == want


def test_tidy_and_as_sentence(spark):
    assert one(spark, X.tidy(F.col("t")), "5 books , and . Rest") == "5 books. Rest"
    assert one(spark, X.as_sentence(F.col("t")), " यह है ") == "यह है।"
    assert one(spark, X.as_sentence(F.col("t")), "Done!") == "Done!"


@pytest.mark.parametrize("samples,want", [(["a b", "a b"], 1.0), (["a b", "b c"], 1 / 3), (["a"], 0.0), (["", ""], 1.0), (["a", "b", "a"], 1 / 3)])
def test_self_consistency(spark, samples, want):
    assert one(spark, X.self_consistency(F.col("t")), samples, "array<string>") == pytest.approx(want)


def test_word_lists_hold_what_they_must():
    assert (len(L.STOP_WORDS["en"]), len(L.STOP_WORDS["hi"]), len(L.STOP_WORDS["ta"]), len(L.NEGATIONS), len(L.ABBREVIATIONS)) == (21, 18, 8, 13, 27)


def test_foreign_scripts_by_language(spark):
    cases = [
        ("Write पॉolicy in हिंदी", "hi", {"MIXED_WORD": 1}), ("Write हिंदी here", "en", {"DEVANAGARI": 5}), ("நிதி மற்றும் हिंदी", "ta", {"DEVANAGARI": 5}), ("Library-ன் விதி", "ta", {}), ("한국 text", "hi", {"HANGUL": 2}), ("рay Ａ ٣ 5%", "de", {"CYRILLIC": 1, "FULLWIDTH": 1}),
        ("नiroki और नि-a", "hi", {"MIXED_WORD": 1}), ("plain", None, {}), ("", "hi", {}),
    ]
    df = spark.createDataFrame([(i, t, l) for i, (t, l, _) in enumerate(cases)] + [(99, None, "hi")], "i int, t string, l string")
    got = {r.i: None if r.x is None else {y.script: y.n for y in r.x} for r in df.select("i", X.foreign_scripts(F.col("t"), F.col("l")).alias("x")).collect()}
    assert got == {**{i: w for i, (_, _, w) in enumerate(cases)}, 99: None}


def test_daily_quota_and_samples(spark):
    df = spark.createDataFrame([("quota exceeded",), ("Quota per minute exceeded",), ("requests PER DAY exhausted",), ("per minute and daily",), ("bad request",)], "b string")
    assert [r.x for r in df.select(X.is_daily_quota(F.col("b")).alias("x")).collect()] == [True, False, True, True, False]
    s = spark.createDataFrame([("a b c d", ["a b c d", "a b c d"]), ("no", ["no", "no"]), ("a b c d", [])], "a string, s array<string>")
    got = s.select(*[c.alias(k) for k, c in X.consistency_signals(F.col("a"), F.col("s")).items()], X.degenerate(F.col("a"), F.col("s")).alias("same")).collect()
    assert [(r.s4_self_consistency, r.s4_n_samples, r.s4_reliable, r.same) for r in got] == [(1.0, 2, 1, True), (1.0, 2, 0, True), (0.0, 0, 0, False)]


def test_credentials_of_all_four_kinds(spark):
    long = "0123456789abcdefghijKLM"
    df = spark.createDataFrame([(f"x AIza{long}",), (f"gsk_{long}",), (f"ghp_{long}",), (f"sk-{long}",), ("sk-short",)], "t string")
    assert [list(r.x) for r in df.select(X.secrets(F.col("t")).alias("x")).collect()] == [["google"], ["groq"], ["github"], ["openai_style"], []]
