"""Text functions as Column expressions. NULL in, NULL out unless said otherwise; only Unicode composition needs Arrow."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L


def _composed(text: str | None) -> str | None:
    return text if text is None or text.isascii() or unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def nfc(text: Column) -> Column:
    """Unicode composition (NFC) in Arrow batches; Arrow's own kernel leaves two-part Tamil vowel signs apart, so it is not used."""

    @F.arrow_udf("string")
    def compose(texts: pa.Array) -> pa.Array:
        return pa.array([_composed(t) for t in texts.to_pylist()], pa.string())

    return compose(text)


def normalize(text: Column) -> Column:
    """Composed, without zero-width characters, every run of blanks as one space, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(nfc(text), L.ZERO_WIDTH, ""), L.BLANK + "+", " "))


def strip_punctuation(text: Column) -> Column:
    """Without Unicode punctuation but hyphen and apostrophe."""
    return F.regexp_replace(text, r"(?![-'])\p{P}", "")


def script_counts(text: Column) -> dict[str, Column]:
    return {n: F.regexp_count(text, F.lit(p)) for n, p in (("devanagari", L.DEVANAGARI), ("tamil", L.TAMIL), ("latin", L.LATIN), ("other_indic", L.OTHER_INDIC))}


def detect_script(text: Column) -> Column:
    """native, roman or mixed: mixed where both Indic and Latin letters occur and the rarer kind is above 15 %."""
    c = script_counts(text)
    indic, latin = c["devanagari"] + c["tamil"], c["latin"]
    both = F.when(F.least(indic, latin) / (indic + latin) > 0.15, "mixed").when(indic >= latin, "native").otherwise("roman")
    return F.when((indic > 0) & (latin > 0), both).when(indic > 0, "native").otherwise("roman")


def _hits(words: Column, markers: list[str]) -> Column:
    known = F.array(*[F.lit(m) for m in sorted(markers)])
    return F.size(F.filter(words, lambda w: F.array_contains(known, w)))


def detect_language(text: Column) -> Column:
    """struct(language, confidence, script) of a normalised text; a blank one is en with confidence 0.

    Native script decides by counting letters, Latin script by Romanised function words.
    """
    c = script_counts(text)
    indic = c["devanagari"] + c["tamil"]
    script = detect_script(text)
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), 1)
    n, hi, ta = F.size(words), _hits(words, L.ROMAN_HINDI), _hits(words, L.ROMAN_TAMIL)
    best, ratio = F.greatest(hi, ta), F.greatest(hi, ta) / F.greatest(n, F.lit(1))
    native = F.least(F.lit(0.99), 0.75 + 0.24 * (F.greatest(c["devanagari"], c["tamil"]) / F.greatest(indic, F.lit(1)))) * F.when(script == "mixed", 0.9).otherwise(1.0)
    roman = (best >= 2) & (ratio >= 0.15)
    language = F.when(F.length(text) == 0, "en").when((indic > 0) & (c["tamil"] > c["devanagari"]), "ta").when(indic > 0, "hi").when(n < 3, "en").when(roman & (hi >= ta), "hi").when(roman, "ta").otherwise("en")
    confidence = F.when(F.length(text) == 0, 0.0).when(indic > 0, native).when(n < 3, 0.25).when(roman, F.least(F.lit(0.8), 0.45 + ratio)).when(n >= 5, 0.85).otherwise(0.6)
    return F.when(text.isNotNull(), F.struct(language.alias("language"), confidence.alias("confidence"), F.when(F.length(text) == 0, "roman").otherwise(script).alias("script")))


def per_language(language: Column, values: dict, other) -> Column:
    out = F
    for k, v in values.items():
        out = out.when(language == k, v)
    return out.otherwise(other)


def estimate_tokens(text: Column, language: Column) -> Column:
    """Sub-word tokens by the script's rate, half to even, 1 at least."""
    rate = per_language(language, {k: F.lit(v) for k, v in L.TOKENS_PER_CHAR.items()}, F.lit(L.OTHER_TOKENS_PER_CHAR))
    return F.greatest(F.lit(1), F.rint(F.length(text) * rate).cast("int"))


def sentences(text: Column) -> Column:
    """Sentences of a normalised text; a full stop after an abbreviation or a single letter ends none."""
    ends = r"(?<=[.!?।॥])\s+|(?<=[.!?])(?=[A-Zऀ-ॿ஀-௿])"
    parts = F.filter(F.transform(F.split(text, ends), lambda p: F.trim(p)), lambda p: p != "")
    short = F.array(*[F.lit(a) for a in L.ABBREVIATIONS])

    def closed(p: Column) -> Column:
        last = F.regexp_extract(F.lower(p), r"(?:^|[\s(])([^\s(]*)\.$", 1)
        return F.when(p.endswith(".") & (F.array_contains(short, last) | last.rlike(r"^\p{L}$")), F.concat(p, F.lit(" "))).otherwise(F.concat(p, F.lit("\u0001")))

    joined = F.rtrim(F.array_join(F.transform(parts, closed), ""))
    return F.filter(F.transform(F.split(joined, "\u0001"), lambda p: F.trim(p)), lambda p: p != "")


def stop_words(language: Column) -> Column:
    return per_language(language, {k: F.array(*[F.lit(w) for w in v]) for k, v in L.STOP_WORDS.items()}, F.array().cast("array<string>"))


def stem(w: Column) -> Column:
    """A Latin word without one common suffix, NULL where none can go."""
    out = F.when((F.length(w) <= L.MIN_STEM) | w.rlike(r"^[0-9]+$"), None)
    for s in L.SUFFIXES:
        cut = F.substring(w, F.lit(1), F.length(w) - len(s))
        doubled = (F.length(cut) > L.MIN_STEM) & (F.substring(cut, -1, 1) == F.substring(cut, -2, 1))
        out = out.when(w.endswith(s) & (F.length(w) - len(s) >= L.MIN_STEM), F.when(doubled, F.substring(cut, F.lit(1), F.length(cut) - 1)).otherwise(cut))
    return out


def tokens(composed: Column, language: Column) -> Column:
    """Terms of a composed text for lexical matching, repeated as often as they occur.

    Indic runs with their 4-grams first, then Latin words with their stems; stop-words of the language give nothing.
    """
    low, stops = F.lower(composed), stop_words(language)
    kept = lambda words: F.filter(words, lambda w: ~F.array_contains(stops, w))
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - (L.NGRAM - 1)), lambda i: F.substring(w, i, F.lit(L.NGRAM)))
    indic = F.transform(kept(F.regexp_extract_all(low, F.lit(f"({L.INDIC_RUN})"), 1)), lambda w: F.when(F.length(w) >= L.MIN_NGRAM_WORD, F.concat(F.array(w), grams(w))).otherwise(F.array(w)))
    latin = F.transform(kept(F.regexp_extract_all(F.regexp_replace(low, L.INDIC_RUN, " "), F.lit(f"({L.LATIN_WORD})"), 1)), lambda w: F.array_compact(F.array(w, stem(w))))
    return F.concat(F.flatten(indic), F.flatten(latin))


def overlap_words(text: Column) -> Column:
    """Distinct words for the overlap measure."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({L.OVERLAP_WORD})"), 1))


def share_of(a: Column, b: Column) -> Column:
    """Share of b's words that a has, 0 where b has none; both are arrays of distinct words."""
    return F.when(F.size(b) > 0, F.size(F.array_intersect(a, b)) / F.size(b)).otherwise(0.0)


def _script(ch: str) -> str | None:
    """The first word of the Unicode name of a letter or mark, which is its script; None for anything else."""
    kind = unicodedata.category(ch)
    return unicodedata.name(ch, " ").split(" ", 1)[0] or None if kind[0] == "L" or kind in ("Mn", "Mc") else None


class _Scripts(dict):
    def __missing__(self, ch: str) -> str | None:
        self[ch] = out = _script(ch)
        return out


def _foreign(text: str, language: str | None, known: _Scripts) -> dict[str, int]:
    own = L.OWN_SCRIPT.get(language, "LATIN")
    if text.isascii():
        return {}
    found: Counter = Counter()
    for ch, n in Counter(text).items():
        script = known[ch]
        if script not in (None, "LATIN", "COMBINING", own):
            found[script] += n
    if own != "LATIN":
        kinds = ({known[c] for c in w} for w in re.split(L.WORD_PARTS, text))
        mixed = sum(own in k and "LATIN" in k for k in kinds)
        if mixed:
            found["MIXED_WORD"] = mixed
    return dict(sorted(found.items()))


def foreign_scripts(text: Column, language: Column) -> Column:
    """Letters and marks by script that a text of a language should not hold, as array<struct<script, n>>; NULL for NULL.

    Latin and the language's own script are allowed; a word that mixes the two counts under MIXED_WORD. Unknown languages
    allow Latin only. Scripts are known by Unicode names, which no expression gives, hence Arrow.
    """

    @F.arrow_udf("array<struct<script: string, n: int>>")
    def count(texts: pa.Array, languages: pa.Array) -> pa.Array:
        known = _Scripts()
        rows = [None if t is None else [{"script": k, "n": n} for k, n in _foreign(t, l, known).items()] for t, l in zip(texts.to_pylist(), languages.to_pylist())]
        return pa.array(rows, pa.list_(pa.struct([("script", pa.string()), ("n", pa.int32())])))

    return count(text, language)


def is_script_clean(text: Column, language: Column) -> Column:
    return F.size(foreign_scripts(text, language)) == 0


def needs_review(detected: Column) -> Column:
    """Whether a detected language is too unsure to be used unseen: below 0.6, or Romanised Hindi or Tamil, or two scripts mixed."""
    return (detected["confidence"] < 0.6) | ((detected["script"] == "roman") & detected["language"].isin("hi", "ta")) | (detected["script"] == "mixed")


def script_profile(text: Column) -> Column:
    """'hi/native conf=0.98 dev=142 tam=0 lat=3', and '[review]' where needed."""
    d, c = detect_language(text), script_counts(text)
    return F.concat(F.format_string("%s/%s conf=%.2f dev=%d tam=%d lat=%d", d["language"], d["script"], d["confidence"], c["devanagari"], c["tamil"], c["latin"]), F.when(needs_review(d), " [review]").otherwise(""))


def stub_words(text: Column) -> Column:
    """Lower case, punctuation as blanks, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\sऀ-ॿ஀-௿]", " "), r"\s+", " "))


def is_abstention(text: Column) -> Column:
    return F.upper(text).contains(L.ABSTAIN_MARKERS[0])


def as_sentence(text: Column) -> Column:
    """Trimmed, closed by the full stop of its script unless it ends in a sentence mark."""
    t = F.trim(text)
    return F.when((t == "") | t.rlike(r"[.!?।]$"), t).otherwise(F.concat(t, F.when(t.rlike(L.DEVANAGARI), "।").otherwise(".")))


def tidy(text: Column) -> Column:
    """A text out of which passages were cut: single blanks, no blank or comma before a mark, no dangling connective, single full stops."""
    t = F.regexp_replace(text, r"\s+", " ")
    t = F.regexp_replace(t, r"\s+([.,;:!?।])", "$1")
    t = F.regexp_replace(t, rf"(?i)[,;]?\s+(?:{L.DANGLING})\s*([.!?।]|$)", "$1")
    t = F.regexp_replace(t, r"[,;:]+\s*([.!?।]|$)", "$1")
    return F.trim(F.regexp_replace(t, r"([.।])\s*\1+", "$1"))


def self_consistency(samples: Column) -> Column:
    """Mean Jaccard similarity of the word sets of all pairs of a row's few samples; 0 below two; two empty sets are equal."""
    sets = F.transform(samples, lambda s: F.array_distinct(F.filter(F.split(F.lower(s), r"\s+"), lambda w: w != "")))
    pairs = F.flatten(
        F.transform(sets, lambda a, i: F.transform(F.slice(sets, i + 2, F.greatest(F.size(sets) - i - 1, F.lit(0))), lambda b: F.when(F.size(F.array_union(a, b)) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(1.0)))
    )
    return F.when(F.size(samples) < 2, 0.0).otherwise(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / F.size(pairs))


def consistency_signals(answer: Column, samples: Column) -> dict[str, Column]:
    """The signals of an answer and its further samples: mean similarity, dispersion, number of samples, whether they can be relied on, words of the answer."""
    all_ = F.concat(F.array(answer), samples)
    one, words = self_consistency(all_), F.size(F.filter(F.split(answer, r"\s+"), lambda w: w != ""))
    reliable = (words >= L.SHORT_ANSWER_TOKENS) & (F.size(samples) >= 2)
    return {"s4_self_consistency": one, "s4_dispersion": 1 - one, "s4_n_samples": F.size(samples), "s4_reliable": reliable.cast("int"), "answer_tokens": words}


def degenerate(answer: Column, samples: Column) -> Column:
    """Whether all samples are the answer itself, so that their agreement says nothing."""
    return (F.size(samples) > 0) & (F.size(F.array_distinct(F.concat(F.array(answer), samples))) == 1)


def fingerprint(*parts: Column) -> Column:
    """Content address of a request."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def secrets(text: Column) -> Column:
    """Names of the credential patterns that a text holds."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in L.SECRETS.items()]))


def retry_seconds(body: Column) -> Column:
    """Seconds after which a provider's refusal says to try again ('retry in 1h2m3.5s', '"retryDelay": "56s"'), NULL where it does not."""
    text = F.regexp_extract(body, r"(?i)retry in\s+((?:\d+h)?(?:\d+m)?(?:[\d.]+s)?)", 1)
    part = lambda unit: F.coalesce(F.nullif(F.regexp_extract(text, rf"([\d.]+){unit}", 1), F.lit("")).try_cast("double"), F.lit(0.0))
    delay = F.nullif(F.regexp_extract(body, r'"retryDelay"\s*:\s*"([\d.]+)s"', 1), F.lit("")).try_cast("double")
    return F.when(text != "", F.nullif(part("h") * 3600 + part("m") * 60 + part("s"), F.lit(0.0))).otherwise(delay)


def is_daily_quota(body: Column) -> Column:
    """Whether a refusal says that the day's allowance is spent; a named period decides, a bare quota counts as the day's."""
    low = F.lower(body)
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: low.contains(w))
    return has(L.DAILY_MARKERS) | (~has(L.SHORT_PERIOD_MARKERS) & (low.contains("quota") | low.contains("exhausted")))


def safe_name(name: Column) -> Column:
    """A file name without folders, of letters, digits, blank and ._- only; NULL if nothing is left."""
    last = F.element_at(F.split(name, r"[/\\\\]"), -1)
    return F.nullif(F.trim(F.regexp_replace(last, r"[^\p{L}\p{M}\p{N} ._-]", "")), F.lit(""))
