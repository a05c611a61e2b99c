"""A language that is rare in its script stays a class of its own, and wrong labels make none."""

import random

import pytest

langid = pytest.importorskip("attestra.llm.langid")

WORDS = {
    "en": "the policy covers every claim that was sent with original papers before end month when member has paid this amount".split(),
    "hi": "yojanaa men kyaa daavaa ke lie kaagaz bhejne honge agar sadasya ne raashi kaa bhugataan pahale kiyaa hai aur naheen".split(),
    "ta": "thiddam padi urimaikoral seluththa entha aavanangal anuppa vendum uruppinar thokai munpe seluththinaal enna mudiyum illai".split(),
}


def test_rare_romanised_languages_are_kept():
    rng = random.Random(1)
    say = lambda l: " ".join(rng.choices(WORDS[l], k=14)).capitalize() + "?"
    rows = [(say("en"), "hi" if i % 50 == 0 else "ta" if i % 50 == 1 else "en") for i in range(2000)] + [(say(l), l) for l in ("hi", "ta") for _ in range(60)]
    model = langid.fit([t for t, _ in rows], [l for _, l in rows])
    assert set(model.classes) == {(l, "latn") for l in WORDS}
    for l in WORDS:
        best = model.posteriors([langid.letters(say(l)) for _ in range(100)]).argmax(1)
        assert (best == langid.LANGUAGES.index(l)).mean() > 0.97, l


def test_wrong_labels_alone_make_no_class():
    rng = random.Random(2)
    rows = [(" ".join(rng.choices(WORDS["en"], k=14)), "hi" if i % 40 == 0 else "en") for i in range(2000)]
    assert langid.fit([t for t, _ in rows], [l for _, l in rows]).classes == [("en", "latn")]


def test_sentence_may_end_with_a_vowel_sign():
    assert langid.segments("योजना में दावा कैसे करना है तो बताए। यह दावा यहाँ होता होगा. Send the papers to the office.") == ["योजना में दावा कैसे करना है तो बताए।", "यह दावा यहाँ होता होगा.", "Send the papers to the office."]
