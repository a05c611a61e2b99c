"""The text functions in DuckDB SQL, for the side-by-side check."""

from __future__ import annotations

import re

from . import lexicon as L


def _uni(p: str) -> str:
    r"""A pattern with \uXXXX escapes as the characters themselves, as RE2 wants them."""
    return re.sub(r"\\u([0-9a-f]{4})", lambda m: chr(int(m[1], 16)), p).replace("'", "''")


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def count(t: str, pattern: str) -> str:
    return f"(length({t}) - length(regexp_replace({t}, '{_uni(pattern)}', '', 'g')))"


def normalize(t: str) -> str:
    return f"trim(regexp_replace(regexp_replace(nfc_normalize({t}), '{_uni(L.ZERO_WIDTH)}', '', 'g'), '{_uni(L.BLANK)}+', ' ', 'g'))"


DEVA, TAML, LATN, OTHER = L.DEVANAGARI, L.TAMIL, L.LATIN, L.OTHER_INDIC


def detect_script(d: str, t: str, l: str) -> str:
    """From columns that hold the counts."""
    return f"CASE WHEN {d}+{t} > 0 AND {l} > 0 THEN CASE WHEN least({d}+{t}, {l})::DOUBLE / ({d}+{t}+{l}) > 0.15 THEN 'mixed' WHEN {d}+{t} >= {l} THEN 'native' ELSE 'roman' END WHEN {d}+{t} > 0 THEN 'native' ELSE 'roman' END"


def per_language(lang: str, values: dict[str, str], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {lang} = '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {other} END"


def estimate_tokens(t: str, lang: str) -> str:
    rate = per_language(lang, {k: f"{v}::DOUBLE" for k, v in L.TOKENS_PER_CHAR.items()}, f"{L.OTHER_TOKENS_PER_CHAR}::DOUBLE")
    return f"greatest(1, round_even(length({t}) * {rate}, 0)::INT)"


def stop_words(lang: str) -> str:
    return per_language(lang, {k: _list(v) for k, v in L.STOP_WORDS.items()}, "[]::VARCHAR[]")


def stem(w: str) -> str:
    out = f"CASE WHEN length({w}) <= {L.MIN_STEM} OR regexp_full_match({w}, '[0-9]+') THEN NULL"
    for s in L.SUFFIXES:
        cut = f"{w}[1:length({w}) - {len(s)}]"
        fine = f"CASE WHEN length({cut}) > {L.MIN_STEM} AND {w}[length({w}) - {len(s)}] = {w}[length({w}) - {len(s)} - 1] THEN {w}[1:length({w}) - {len(s) + 1}] ELSE {cut} END"
        out += f" WHEN ends_with({w}, '{s}') AND length({w}) - {len(s)} >= {L.MIN_STEM} THEN {fine}"
    return out + " END"


def tokens(t: str, lang: str) -> str:
    low, stops = f"lower({t})", stop_words(lang)
    run = _uni(L.INDIC_RUN)
    indic = f"flatten(list_transform(list_filter(regexp_extract_all({low}, '{run}'), lambda w: NOT list_contains({stops}, w)), lambda w: CASE WHEN length(w) >= {L.MIN_NGRAM_WORD} THEN list_concat([w], list_transform(range(1, length(w) - {L.NGRAM - 2}), lambda i: substring(w, i, {L.NGRAM}))) ELSE [w] END))"
    latin = f"flatten(list_transform(list_filter(regexp_extract_all(regexp_replace({low}, '{run}', ' ', 'g'), '{_uni(L.LATIN_WORD)}'), lambda w: NOT list_contains({stops}, w)), lambda w: list_filter([w, {stem('w')}], lambda x: x IS NOT NULL)))"
    return f"list_concat({indic}, {latin})"


def sentences(t: str) -> str:
    marked = f"regexp_replace(regexp_replace({t}, '([.!?।॥])\\s+', '\\1' || chr(1), 'g'), '([.!?])([A-Z{chr(0x900)}-{chr(0x97f)}{chr(0xb80)}-{chr(0xbff)}])', '\\1' || chr(1) || '\\2', 'g')"
    parts = f"list_filter(list_transform(string_split({marked}, chr(1)), lambda p: trim(p)), lambda p: p <> '')"
    last = "regexp_extract(lower(p), '(?:^|[\\s(])([^\\s(]*)\\.$', 1)"
    closed = f"CASE WHEN ends_with(p, '.') AND (list_contains({_list(L.ABBREVIATIONS)}, {last}) OR regexp_full_match({last}, '\\p{{L}}')) THEN p || ' ' ELSE p || chr(1) END"
    joined = f"rtrim(array_to_string(list_transform({parts}, lambda p: {closed}), ''))"
    return f"list_filter(list_transform(string_split({joined}, chr(1)), lambda p: trim(p)), lambda p: p <> '')"


def overlap_words(t: str) -> str:
    return f"list_distinct(regexp_extract_all({t}, '{_uni(L.OVERLAP_WORD)}'))"


def share_of(a: str, b: str) -> str:
    return f"CASE WHEN len({b}) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / len({b}) ELSE 0.0 END"


def label(c: str) -> str:
    return f"nullif(regexp_replace(lower(trim(translate({c}, 'ＡＢＣＤａｂｃｄ{chr(0x3000)}', 'ABCDabcd '))), '[\\s_-]+', '_', 'g'), '')"


def language_label(c: str) -> str:
    code = f"split_part({label(c)}, '_', 1)"
    return f"CASE WHEN {code} NOT IN ('und', 'none', 'null', 'unknown', 'unk', 'na', 'n/a', 'xx', 'zxx', 'mis', '?') THEN nullif({code}, '') END"


def answerability_label(c: str) -> str:
    return f"upper(regexp_replace({label(c)}, '^class_', ''))"


def split_label(c: str) -> str:
    return f"CASE WHEN {label(c)} IN ('train', 'training') THEN 'train' WHEN {label(c)} IN ('dev', 'valid', 'validation', 'val') THEN 'dev' WHEN {label(c)} IN ('test', 'testing') THEN 'test' END"


def group_id(p: str, q: str) -> str:
    return f"coalesce(replace({label(p)}, '_', '-'), nullif(regexp_extract(lower(trim({q})), '^[a-z]+-([a-z]+-[0-9]+)', 1), ''))"
