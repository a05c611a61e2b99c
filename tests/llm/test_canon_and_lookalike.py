import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attestra.llm import canon, lookalike
from attestra.llm.lookalike import canonical_forms, same_look_pairs

SCHEMA = "row_id long, question string, gold_answer string, canonical string"


@pytest.mark.parametrize("a,b", [
    ("Ｐlan ＢＢ-1", "Plan BB-1"), ("résumé", "résumé"), ("pa​per", "paper"), ("a b　c", "a b c"), ("ВВМА", "BBMA"), ("νalue", "value"), ("ﬁle", "file"), ("so­ft", "soft"), ("அணுகல்​ சீட்டு", "அணுகல் சீட்டு"), ("போ", "போ"), ("का‎ल", "काल"),
])
def test_same_look(a, b):
    assert canon.visible(a) == canon.visible(b) and canon.canonical(a) == canon.canonical(b)


@pytest.mark.parametrize("a,b", [("Plan", "plan"), ("resume", "résumé"), ("a,b", "a b"), ("x²", "x2"), ("①", "1"), ("क्‍ष", "क्ष"), ("end?", "end")])
def test_different_look(a, b):
    assert canon.visible(a) != canon.visible(b)


def test_case_folds_fully():
    assert canon.canonical("STRASSE") == canon.canonical("straße") and canon.visible("ß") != canon.visible("ss")


@given(st.text(max_size=40))
@settings(max_examples=200, deadline=None)
def test_forms_are_stable(t):
    assert canon.canonical(canon.canonical(t)) == canon.canonical(t)
    assert canon.visible(canon.visible(t)) == canon.visible(t)
    assert canon.visible(unicodedata.normalize("NFD", t)) == canon.visible(unicodedata.normalize("NFC", t))


def brute(rows):
    out = set()
    for f, k in (("question", 1), ("gold_answer", 2)):
        for x in rows:
            for y in rows:
                if x[0] < y[0] and x[k] and y[k] and x[k].strip() and y[k].strip() and x[k] != y[k] and canon.visible(x[k]) == canon.visible(y[k]):
                    out.add((x[0], y[0], f))
    return out


def test_pairs_equal_brute_force(spark):
    base = ["Plan one", "Plan two", "योजना एक"]
    rows = [(i, v(base[i % 3]), None if i % 4 else v(base[i % 2]), "clash") for i, v in enumerate([str, lambda s: s.replace(" ", " "), lambda s: "﻿" + s, str, str.upper] * 6)]
    rows += [(100, None, "", "x"), (101, "", None, "x"), (102, " ", " ", "x"), (103, "long " * 20000, "long " * 20000, "x"), (104, "long " * 20000, None, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    for n in (1, 5):
        got = [tuple(r) for r in same_look_pairs(df.repartition(n)).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert same_look_pairs(df.where("false")).count() == 0 and canonical_forms(df.where("false")).count() == 0


@given(st.text(alphabet="abcXYZ АБВабвнтмкеос ΑΒΓαβγορικ ո ԁ", max_size=30))
@settings(max_examples=300, deadline=None)
def test_case_makes_no_difference_in_any_script(t):
    assert canon.canonical(t.upper()) == canon.canonical(t) == canon.canonical(t.lower())
    assert canon.words(t.upper()) == canon.words(t)


@pytest.mark.parametrize("a,b", [("ТЕКСТ", "текст"), ("МОСКВА", "Москва"), ("ΝΕΑ", "νεα"), ("рау the bill", "pay the bill"), ("FIΝE", "fine"), ("the саt", "THE CAT"), ("ՈԱԹ", "ոաթ"), ("ɡold", "gold")])
def test_equal_looking_texts_have_one_form(a, b):
    assert canon.canonical(a) == canon.canonical(b)


def test_text_in_another_script_stays_in_it():
    assert canon.canonical("Да, Москва") == "да, москва" and canon.words("Нет, я в Москве") == ["нет", "я", "в", "москве"] and canon.canonical("see «Мир и сон» in рaris") == "see «мир и сон» in paris"


def test_classes_count_what_pairs_list(spark):
    rows = [(1, "pay"), (2, "рay"), (3, "pay"), (4, "Pay"), (5, None), (6, ""), (7, "p\u200bay")] + [(10 + i, "hot words") for i in range(50)] + [(90, "hot\u00a0words")]
    df = spark.createDataFrame(rows, "row_id long, question string").selectExpr("*", "CAST(NULL AS STRING) gold_answer", "1 look")
    pairs = lookalike.same_look_pairs(df).collect()
    want = {}
    for r in pairs:
        for k in (r.row_id_a, r.row_id_b):
            want[k] = want.get(k, 0) + 1
    got = lookalike.same_look_classes(df).collect()
    assert {r.row_id: r.n_links for r in got} == want and len(got) == len(want) and want[90] == 50
