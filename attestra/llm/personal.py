"""Problem 8: personal information in free text, found and replaced by typed placeholders.

Generators propose overlapping spans with high recall; boosted trees judge each by its format and its context; thresholds
calibrated on all documents that grow no tree decide, and of overlapping spans the most probable stays. There are no
labelled rows, so the trees learn from spans whose context says plainly what they are; name scores come from the words of all
documents and the given list of name parts, each name scored by the half of the list that it is not in, as the list is known
to be incomplete.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boosting import Boosted, boost
from .common import fill_cores, table, written

KINDS = ("person", "email", "phone", "identity", "address")
SAMPLE_DOCS = 4_000  # bound of the sample that the trees are fitted on
BEFORE, AFTER = 34, 26  # characters of context

# Words that say what a number, name or place beside them is, in English, Hindi and Tamil.
CUES = {
    "other": "claim|ticket|transaction|order|invoice|plan|policy number|desk line|toll-free|reference|build|version|balance|amount|दावा|टिकट|लेनदेन|ऑर्डर|आदेश|चालान|बिल संख्या|योजना|टोल-फ़्री|संदर्भ|உரிமைகோரல்|சீட்டு|பரிவர்த்தனை|ஆணை|ஆர்டர்|விலைப்பட்டியல்|திட்டம்|கட்டணமில்லா|குறிப்பு",
    "phone": "mobile|phone|call|reachable|reach|sms|caller|try|dial|ring|whatsapp|tel|contact number|फ़ोन|मोबाइल|कॉल|கைபேசி|தொலைபேசி|அழை",
    "identity": "identity|id proof|passport|tax number|card shows|proof of identity|read out|licence|license|पहचान|पासपोर्ट|அடையாள|கடவுச்சீட்டு",
    "address": "address|lives at|moved|papers to|send|घर का पता|पता|कागज़|முகவரி|ஆவணங்களை",
}
# Words after a number that say what it is.
CUES_AFTER = {
    "phone": "rings|weekdays|phone|mobile|call|पर फ़ोन|पर कॉल|இல் அழை",
    "identity": "proof|passport|identity|संलग्न|पहचान|இணைக்கப்பட்டது|அடையாள",
    "other": "settled|merged|closed|installed|cancelled|refunded|paid|पूरा हुआ|जोड़ा गया|बंद है|நிறைவு|இணைந்தது|முடிந்தது",
}
# Words of a street, of a house, and words that make a name before them a place or product.
STREET = "street|lane|road|avenue|cross|marg|nagar|drive|boulevard|highway|square|sector|block|colony|layout|मार्ग|गली|सड़क|रोड|தெரு|சாலை|வீதி|சந்து"
HOUSE = r"H\.\s?No\.|No\.|Flat|House|Door|Plot|Apartment|मकान|फ़्लैट|फ्लैट|घर|எண்|கதவு|வீடு"
PLACE_AFTER = r"lane|street|road|avenue|gold|silver|cross|मार्ग|गली|தெரு|சாலை"
TITLES = {"mr", "mrs", "ms", "dr", "shri", "smt", "sri", "prof", "श्री", "श्रीमती", "डॉ", "திரு", "திருமதி", "டாக்டர்"}  # fixed values

_CUE = {k: re.compile(v, re.I) for k, v in CUES.items()}
_AFTER = {k: re.compile(v, re.I) for k, v in CUES_AFTER.items()}
_STREET, _PLACE = re.compile(rf"(?:{STREET})(?![^\W\d_])", re.I), re.compile(rf" (?:{PLACE_AFTER})(?![^\W\d_])", re.I)
_WORD = re.compile(r"[A-Za-zÀ-ɏऀ-ॣॱ-ॿஂ-்]+")
_MAIL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._+-]*[A-Za-z0-9])?\s?(?:@|\[at\]|\(at\))\s?[A-Za-z0-9-]+(?:(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?)[A-Za-z0-9-]+)*", re.I)
#: A run of nine digits and more; what stands before it is checked where it is used, as a pattern is searched faster without.
_DIGITS = re.compile(r"[+(]?\d(?:(?:[ \n.\-]|\)[ \n]?|[ \n][+(])?\d){8,}(?!\w)")
_ENDS = re.compile(r"^[^\w]+|[^\w\u0900-\u097f\u0b80-\u0bff]+$")
_GROUP = re.compile(r"\d+")
_LONG_NUMBER = re.compile(r"\d{5,}")
_LONG_GROUP = re.compile(r"\d{4,}")
_IDENT = re.compile(r"(?<![\w-])(?:[A-Za-z]\d{7,8}|[A-Za-z]{2}\d{6,7}[A-Za-z]?|[A-Za-z]{5}\d{4}[A-Za-z])(?![\w-])")
_LETTERS_BEFORE = re.compile(r"[A-Za-z]{1,5}\Z")
_POSTAL = re.compile(r"\d{3}[ \n]?\d{3}(?![ -]?\d)")
_DIGIT_BEFORE = re.compile(r"\d[ -]?\Z")
_HOUSE = re.compile(rf"(?:(?<!\w)(?P<word>{HOUSE})\s*)?(?<![\w/.-])(?P<number>\d{{1,4}}(?:[A-Za-z]|/\d{{1,3}})?)(?=[,\s])")
#: A word, or up to four letters and a full stop, and one blank before the place where a family name starts.
_PAIR = re.compile(_WORD.pattern + r"(?:\s|(?<![A-Za-zÀ-ɏऀ-ॣॱ-ॿஂ-்]{5})\.\s?)\Z")
NEAR = 48  # characters before a family name that are searched first
SHORT_NAME = 3  # letters; words as short are family names only where they are written or known as names
LEAST_SHARE = 1e-4  # of all documents; words of fewer count as of so many
_STOP = re.compile(r"[.!?।]\s|\n\s*\n")
_LINE_OF_NUMBER = re.compile(r"\d\n")
#: The end of a sentence before a number: a stop after a word that is no abbreviation of a house or street.
_BREAK_NUMBER = re.compile(r"[^\W\d]{3}[.!?।]\s+(?=\d)")
_BREAK = re.compile(r"[.!?।](?<!No\.)\s+(?=[^\s\d])|\n\s*\n")


# ---------------------------------------------------------------- names


def _ends(word: str) -> list[str]:
    w = f"^{word}$"
    return [f"{w[-n:]}#" for n in (3, 4, 5)]


def _grams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)] + _ends(word)


def _words(text: str) -> set[str]:
    return {w.lower() for w in set(_WORD.findall(text))}


def _hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little", signed=True)


@dataclass
class Holders:
    """The share of all documents that hold a word.

    Only words of LEAST_SHARE of the documents are listed, 12 bytes each: as a document has some hundred different words,
    there are at most some hundred times 1 / LEAST_SHARE of them, however large the corpus is. Any other word counts as one
    of that share, or of one document where there are fewer documents than that.
    """

    hashes: np.ndarray  # sorted
    counts: np.ndarray
    total: int  # documents

    @staticmethod
    def of_pairs(hashes: np.ndarray, counts: np.ndarray, total: int) -> Holders:
        order = np.argsort(hashes, kind="stable")
        return Holders(hashes[order].astype(np.int64), counts[order].astype(np.int32), total)

    def get(self, word: str) -> int:
        h = _hash(word)
        i = int(np.searchsorted(self.hashes, h))
        return int(self.counts[i]) if i < len(self.hashes) and self.hashes[i] == h else 1

    def log_share(self, word: str) -> float:
        return math.log(max(self.get(word) / max(1, self.total), LEAST_SHARE))


def name_sets(names: list[tuple[str, str]]) -> dict[str, set[str]]:
    parts: dict[str, set[str]] = {"given": set(), "family": set()}
    for n, kind in names:
        if n and kind in parts:
            parts[kind].add(n.strip().lower())
    return parts


@dataclass
class NameScores:
    """How much a word looks like a given or a family name: the mean log odds of its letter n-grams against other words of the corpus."""

    fold: dict[str, int]
    odds: dict[tuple[str, int], dict[str, float]]
    common: Holders
    given: set[str]
    family: set[str]
    floor: dict[str, float] = field(default_factory=dict)
    memo: dict[str, tuple[float, ...]] = field(default_factory=dict)
    ends: dict[str, bool] = field(default_factory=dict)

    @staticmethod
    def fit(parts: dict[str, set[str]], common: Holders, other: dict[str, int]) -> NameScores:
        """other: how many words of the corpus that are no listed name have an n-gram, for those of the names, and at "" the sum over all n-grams."""
        fold = {n: sum(map(ord, n)) % 2 for kind in parts for n in parts[kind]}
        odds = {}
        n_other = other.get("", 0) + 1
        for kind, ns in parts.items():
            for k in (0, 1):
                mine = Counter(g for n in ns if fold[n] == k for g in _grams(n))
                total = sum(mine.values()) + 1
                odds[kind, k] = {g: math.log((mine[g] + 0.05) / total) - math.log((other.get(g, 0) + 0.5) / n_other) for g in mine}
        out = NameScores(fold, odds, common, parts["given"], parts["family"])
        # no known name, scored without itself, ends less like a name than this
        for i, kind in enumerate(("given", "family")):
            out.floor[kind] = min((out.of(n)[3 + i] for n in parts[kind]), default=math.inf)
        return out

    def may_end(self, word: str) -> bool:
        """Whether a word could be a family name by its end; lets through more than any known name needs."""
        if len(self.ends) > 500_000:
            self.ends.clear()
        w = word.lower()
        use = (1 - self.fold[w],) if w in self.fold else (0, 1)
        # the last of the scores of of(), alone, as most words are asked for nothing else
        may = sum(self.odds["family", k].get(g, -3.0) for k in use for g in _ends(w)) / (3 * len(use)) >= self.floor["family"] - 0.7
        if len(word) <= SHORT_NAME:
            # too short for its end to say much: a listed name, or a word with a capital that few documents hold
            low = word.lower()
            may = low in self.family or (len(word) > 1 and word[0].isupper() and word[1:].islower() and self.common.log_share(low) <= math.log(0.02))
        self.ends[word] = may
        return may

    def of(self, word: str) -> tuple[float, ...]:
        """(given, family, log of the share of documents that hold the word, given and family by the end of the word alone)."""
        w = word.lower()
        got = self.memo.get(w)
        if got is None:
            if len(self.memo) > 500_000:
                self.memo.clear()
            gs = _grams(w)
            use = (1 - self.fold[w],) if w in self.fold else (0, 1)
            s = [sum(self.odds[kind, k].get(g, -3.0) for k in use for g in part) / (len(use) * len(part)) for part in (gs, gs[-3:]) for kind in ("given", "family")]
            got = self.memo[w] = (s[0], s[1], self.common.log_share(w), s[2], s[3])
        return got


def _other_grams(words: Iterator[str], known: set[str], grams: set[str]) -> Counter:
    out: Counter = Counter()
    for w in words:
        if w not in known:
            gs = _grams(w)
            out[""] += len(gs)
            out.update(g for g in gs if g in grams)
    return out


def name_scores(docs: DataFrame, names: list[tuple[str, str]], text: str) -> NameScores:
    """Scores from the words of all documents: a batch counts its own, Spark adds them up. The driver gets the n-grams of the list and the holders of words."""
    parts = name_sets(names)
    known = parts["given"] | parts["family"]
    grams = {g for n in known for g in _grams(n)}

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for pdf in batches:
            for t in pdf["t"]:
                seen.update(_words(t))
            if len(seen) > 500_000:
                yield pd.DataFrame({"word": list(seen.keys()), "n": list(seen.values())})
                seen.clear()
        yield pd.DataFrame({"word": list(seen.keys()), "n": list(seen.values())})

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for pdf in batches:
            seen.update(_other_grams(pdf["word"], known, grams))
        yield pd.DataFrame({"g": list(seen.keys()), "n": list(seen.values())})

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"h": [_hash(w) for w in pdf["word"]], "n": pdf["n"]})

    total = docs.where(F.length(text) > 0).count()
    counted = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("t")).mapInPandas(words, "word string, n long")
    counted = written(counted.groupBy("word").agg(F.sum("n").alias("n")))
    other = counted.mapInPandas(others, "g string, n long").groupBy("g").agg(F.sum("n").alias("n"))
    held = counted.where((F.col("n") > 1) & (F.col("n") >= LEAST_SHARE * total)).mapInPandas(hashed, "h long, n long").select("h", F.least("n", F.lit(2**31 - 1)).cast("int").alias("n")).toPandas()
    return NameScores.fit(parts, Holders.of_pairs(held["h"].to_numpy(), held["n"].to_numpy(), total), {r.g: r.n for r in other.toLocalIterator()})


# ---------------------------------------------------------------- candidates

Span = tuple[str, int, int]  # kind, start, end


def candidates(text: str, names: NameScores) -> list[Span]:
    """Spans that may be personal, many of them overlapping; each kind has its own generator."""
    out: list[Span] = []
    ends: list[int] | None = None  # of sentences and paragraphs, which no address crosses
    if "@" in text or "(at)" in text.lower() or "[at]" in text.lower():
        out += [("email", *m.span()) for m in _MAIL.finditer(text)]
    for m in _LONG_GROUP.finditer(text):
        if 4 <= m.end() - m.start() <= 8:
            lead = _LETTERS_BEFORE.search(text, max(0, m.start() - 5), m.start())
            found = lead and _IDENT.match(text, lead.start())
            if found:
                out.append(("identity", *found.span()))
    for m in _DIGITS.finditer(text):
        groups = [g.span() for g in _GROUP.finditer(text, *m.span())]
        if m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] in "-_"):
            groups = groups[1:]  # the first belongs to a word or code
        for i in range(len(groups)):
            digits = 0
            for j in range(i, len(groups)):
                digits += groups[j][1] - groups[j][0]
                if digits > 15 or j > i and "+" in text[groups[j - 1][1] : groups[j][0]]:
                    break
                if digits >= 9:
                    a, b = groups[i][0], groups[j][1]
                    if a and text[a - 1] in "+(":
                        a -= 1
                    out += [("phone", a, b), ("identity", a, b)] if digits in (9, 12) else [("phone", a, b)]
    for m in _POSTAL.finditer(text):
        if _DIGIT_BEFORE.search(text, max(0, m.start() - 2), m.start()):
            continue
        ends = ends if ends is not None else sorted(x.end() for pattern in (_BREAK, _BREAK_NUMBER) for x in pattern.finditer(text))
        at = bisect_right(ends, m.start())
        lo = ends[at - 1] if at else 0
        if not _STREET.search(text, lo, m.start()):
            continue
        for h in _HOUSE.finditer(text, lo, m.start()):
            out.append(("address", h.start(), m.end()))
            if h["word"]:
                out.append(("address", h.start("number"), m.end()))
    known, hot = names.ends, []
    for w in dict.fromkeys(_WORD.findall(text)):
        may = known.get(w)
        if may or may is None and names.may_end(w):
            hot.append(w)
    for w in hot:
        at = text.find(w)
        while at >= 0:
            m = _PAIR.search(text, max(0, at - NEAR), at)
            if m and m.start() == at - NEAR:  # the word before may reach further back
                m = _PAIR.search(text, _pair_start(text, at), at)
            if m and len(w) <= SHORT_NAME and text[m.start() : at].rstrip().endswith(".") and len(_WORD.match(text, m.start())[0]) > 1:
                m = None  # a short word after a full stop begins a sentence, unless an initial stands before it
            if m and not _WORD.match(text, at + len(w)):
                out.append(("person", m.start(), at + len(w)))
            at = text.find(w, at + 1)
    return out


def _pair_start(text: str, at: int) -> int:
    """Where the word before a place starts, of any length."""
    i = at - 1
    while i > 0 and (text[i - 1].isspace() or text[i - 1] == ".") and at - i < 3:
        i -= 1
    while i > 0 and _WORD.match(text[i - 1]):
        i -= 1
    return max(0, i - 1)


def context(text: str, start: int, end: int) -> tuple[str, str]:
    """What stands before and after a span, within its sentence or the line before it."""
    before, after = text[max(0, start - BEFORE) : start], text[end : end + AFTER]
    cut = [m.end() for m in _BREAK.finditer(before)] + [m.end() for m in _LINE_OF_NUMBER.finditer(before)]
    cut.sort()
    return before[cut[-1] :] if cut else before, (_BREAK.split(after, maxsplit=1) or [after])[0]


def goes_on(text: str, span: Span) -> bool:
    """Whether a number was complete before its line ended: such a span comes after the one that ends there."""
    head, line, _ = text[span[1] : span[2]].partition("\n")
    return span[0] in ("phone", "identity") and bool(line) and sum(c.isdigit() for c in head) >= 9


def features(text: str, span: Span, names: NameScores, near: tuple[str, str] | None = None) -> list[float]:
    kind, a, b = span
    s = text[a:b]
    before, after = near or context(text, a, b)
    x = [float(kind == k) for k in KINDS]
    groups = [g.group() for g in _GROUP.finditer(s)]
    seps = {c for c in s if c in " \n-.()"}
    left, right = text[max(0, a - 2) : a], text[b : b + 2]
    digits, numeric = "".join(groups), kind in ("phone", "identity")
    x += [len(digits), len(groups), *[len(g) for g in (groups + ["", "", "", ""])[:4]], s.startswith("+"), "(" in s, (" " in seps or "\n" in seps) + 2 * ("-" in seps) + 4 * ("." in seps)]
    x += [int(digits[0]) if digits else -1, numeric and bool(re.search(r"\d[ .\-(]?\Z|\+\Z", left)), numeric and bool(re.match(r"[ .\-]?\d", right)), sum(c.isalpha() for c in s), b - a]
    x += [goes_on(text, span), digits.startswith("00"), "." in s.rpartition("@")[2] or "dot" in s.lower()]
    if kind == "person":
        ws = _WORD.findall(s)
        first, last = ws[0], ws[-1]
        initial = is_initial(s, first.lower())
        g, f = ((0.0,) * 5 if initial else names.of(first)), names.of(last)
        upper = sum(w[0].isupper() or ord(w[0]) > 0x900 for w in ws)
        x += [g[0], f[1], g[3], f[4], f[3] - f[4], g[2], f[2], initial, first.lower() in TITLES, upper, bool(_PLACE.match(after)), "\n" in s]
    else:
        x += [0.0] * 12
    if kind == "address":
        inside = s[: -len(groups[-1])] if groups else s
        x += [len(_STREET.findall(s)), bool(re.match(HOUSE, s)), bool(re.search(rf"(?:{HOUSE})\s*\Z", text[max(0, a - 8) : a])), len(_STOP.findall(re.sub(r"H\.\s?No\.|No\.", "", s))), s.count(","), len([g for g in groups if len(g) > 2]), bool(re.match(r"\d+(st|nd|rd|th)", s)), len(re.findall(r"(?<![\w/])\d+(?![\w/])", inside)), bool(_CUE["address"].search(s))]
    else:
        x += [0.0] * 9
    for k in ("other", "phone", "identity", "address"):
        at = [m.end() for m in _CUE[k].finditer(before)]
        x += [len(before) - at[-1] if at else 99]
    x += [bool(_AFTER[k].search(after)) for k in ("phone", "identity", "other")]
    return [float(v) for v in x]


# ---------------------------------------------------------------- training


def weak_label(text: str, span: Span, names: NameScores, near: tuple[str, str] | None = None) -> int | None:
    """1 or 0 where the span's context or make-up says plainly what it is, None where it does not."""
    kind, a, b = span
    s = text[a:b]
    before, after = near or context(text, a, b)
    whole = not re.search(r"\d[ .\-]?\Z|\+\Z", text[max(0, a - 2) : a]) and not re.match(r"[ .\-]?\d", text[b : b + 2])
    if kind == "email":
        return int(bool(re.search(r"(?:@|\[at\]|\(at\))\s?[\w-]+\s?(?:\.|\[dot\]|\(dot\))\s?\w{2,}$", s, re.I)))
    if kind in ("phone", "identity"):
        if not whole:
            return 0
        if "\n" in s:
            return 0 if goes_on(text, span) else None
        if s[0] in "+(":
            return int(kind == "phone")
        near = {k: max((m.end() for m in _CUE[k].finditer(before)), default=0) for k in ("other", "phone", "identity")}
        beside = {k for k in near if near[k] and len(before) - near[k] <= 3}  # "ID proof: " right before a number says more than any word after it
        told = beside if len(beside) == 1 else {k for k in near if near[k]} | {k for k in _AFTER if _AFTER[k].search(after)}
        if "other" in told and not told & {"phone", "identity"}:
            return 0
        if len(told) != 1:
            return None
        mine = next(iter(told))
        if kind == "phone" and len(re.sub(r"\D", "", s)) == 12 and "+" not in s and not s.startswith("00"):
            return 0 if mine == "identity" else None
        return int(mine == kind)
    if kind == "address":
        inner = re.sub(r"H\.\s?No\.|No\.", "", s)
        if _STOP.search(inner) or re.search(rf"(?:{HOUSE})\s*\Z", text[max(0, a - 8) : a]) or not _STREET.search(s) or _LONG_NUMBER.search(s[:-7]) or _CUE["address"].search(s):
            return 0
        starts = [h.start() for h in _HOUSE.finditer(text, a, b - 6)]
        earlier = [h for h in _HOUSE.finditer(text, max(0, a - 14), a) if not _STOP.search(text[h.start() : a].replace("No.", ""))]
        return int(bool(starts) and starts[0] == a and not earlier)
    ws = [w.lower() for w in _WORD.findall(s)]
    given, family = ws[0] in names.given, ws[-1] in names.family
    if _PLACE.match(after) or ws[0] in TITLES:
        return 0
    if family and (given or is_initial(s, ws[0])):
        return 1
    if names.of(ws[-1])[4] < names.floor["family"]:
        return 0
    return 0 if not is_initial(s, ws[0]) and names.of(ws[0])[3] < names.floor["given"] else None


def is_initial(span: str, first: str) -> bool:
    """One letter, with its vowel sign in an Indic script, and a full stop."""
    return span[len(first) : len(first) + 1] == "." and first not in TITLES and sum(unicodedata.category(c)[0] == "L" for c in first) <= 2 and len(first) <= (1 if first.isascii() else 4)


Judged = tuple[str, int, int, float, int | None]  # kind, start, end, probability, weak label


@dataclass
class Finder:
    names: NameScores
    trees: Boosted
    threshold: dict[str, float]
    curve: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def chance(self, kind: str, p: float) -> float:
        """The calibrated probability behind a score of the trees; the score itself where nothing calibrates its kind."""
        scores, chances = self.curve.get(kind, ((), ()))
        return float(chances[max(0, int(np.searchsorted(scores, p, side="right")) - 1)]) if len(scores) else p

    def judged(self, texts: list[str], labelled: list[bool]) -> list[list[Judged]]:
        """All candidates of each text with their probability, and their weak label where it is asked for; those of a batch are judged at once."""
        found = [list(dict.fromkeys(candidates(t, self.names))) for t in texts]
        rows, labels = [], []
        for t, ss, asked in zip(texts, found, labelled):
            for s in ss:
                near = context(t, s[1], s[2])
                rows.append(features(t, s, self.names, near))
                labels.append(weak_label(t, s, self.names, near) if asked else None)
        p = self.trees.probability(np.array(rows)) if rows else np.zeros(0)
        out, at = [], 0
        for ss in found:
            out.append([(*s, float(p[at + i]), labels[at + i]) for i, s in enumerate(ss)])
            at += len(ss)
        return out

    def chosen(self, text: str, judged: list[Judged]) -> list[tuple[str, int, int, float]]:
        """The accepted spans of a text, in order, none overlapping another."""
        sure = [x[:4] for x in judged if x[3] >= self.threshold[x[0]]]
        kept: list[tuple[str, int, int, float]] = []
        for kind, a, b, p in sorted(sure, key=lambda x: (goes_on(text, x[:3]), -round(x[3], 6), x[1] - x[2], x[:3])):
            if all(b <= x or a >= y for _, x, y, _ in kept):
                kept.append((kind, a, b, p))
        return sorted(kept, key=lambda k: k[1])

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int, float]]]:
        return [self.chosen(t, x) for t, x in zip(texts, self.judged(texts, [False] * len(texts)))]


def grow(texts: list[str], scores: NameScores) -> Finder:
    """Trees from a bounded sample of texts; the thresholds are still to be set."""
    x: list[list[float]] = []
    y: list[int] = []
    for t in texts:
        for s in dict.fromkeys(candidates(t, scores)):
            label = weak_label(t, s, scores)
            if label is not None:
                x.append(features(t, s, scores))
                y.append(label)
    if not x or len(set(y)) < 2:
        return Finder(scores, Boosted(-9.0, np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)), 1), dict.fromkeys(KINDS, 0.5))
    return Finder(scores, boost(np.array(x), np.array(y, float)), dict.fromkeys(KINDS, 0.5))


def fit(texts: list[str], names: list[tuple[str, str]]) -> Finder:
    """What train() makes, of texts in memory: every third text sets the thresholds, the others grow the trees."""
    parts, seen = name_sets(names), Counter(w for t in texts for w in _words(t))
    known = parts["given"] | parts["family"]
    held = Holders.of_pairs(np.array([_hash(w) for w in seen], np.int64), np.array([*seen.values()], np.int32), len(texts))
    finder = grow([t for i, t in enumerate(texts) if i % 3], NameScores.fit(parts, held, _other_grams(iter(seen), known, {g for n in known for g in _grams(n)})))
    rest = [t for i, t in enumerate(texts) if not i % 3]
    rows = [x for xs in finder.judged(rest, [True] * len(rest)) for x in xs if x[4] is not None]
    for k in KINDS:
        mine = [x for x in rows if x[0] == k]
        p, y = np.array([x[3] for x in mine]), np.array([x[4] for x in mine])
        finder.threshold[k] = calibrated(p, y, np.ones(len(mine)))
        if mine:
            finder.curve[k] = isotonic(p, y, np.ones(len(mine)))
    return finder


def isotonic(p: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, chances): the share of true rows as a rising step function of the score, by pooling neighbours that fall."""
    order = np.argsort(p, kind="stable")
    blocks: list[list[float]] = []
    for s, hit, m in zip(p[order], (y * n)[order], n[order]):
        blocks.append([s, float(hit), float(m)])
        while len(blocks) > 1 and (blocks[-2][0] == blocks[-1][0] or blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]):
            last = blocks.pop()
            blocks[-1] = [last[0], blocks[-1][1] + last[1], blocks[-1][2] + last[2]]
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def calibrated(p: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """The threshold with the best F1 on rows that grew no tree, each standing for n; midway in the gap where several are equal, one half where there are no positives."""
    if not len(y) or not (y * n).sum():
        return 0.5
    order = np.argsort(-p, kind="stable")
    p, y, n = p[order], y[order], n[order]
    hit = (y * n).cumsum()
    f1 = 2 * hit / (n.cumsum() + (y * n).sum())
    last = np.append(p[1:] < p[:-1], True)
    k = int(np.argmax(np.where(last, f1, -1)))
    return float((p[k] + (p[k + 1] if k + 1 < len(p) else 0.0)) / 2)


def _grows(docs: DataFrame, text: str, key: str, n: int) -> Column:
    """Whether a document grows the trees: two thirds of about n documents (of all, if there are fewer), by a hash of the key."""
    total = docs.where(F.length(text) > 0).count()
    sampled = F.lit(True) if total <= n else F.xxhash64(key).bitwiseAND(F.lit(2**63 - 1)) < F.lit(int((n / total) * 2**63))
    return F.coalesce(sampled & (F.length(text) > 0) & (F.pmod(F.xxhash64(key, F.lit(1)), F.lit(3)) != 0), F.lit(False))


JUDGED = "array<struct<kind: string, start: int, end: int, probability: double, label: int>>"


def judge(docs: DataFrame, finder: Finder, grows: Column, text: str = "text") -> DataFrame:
    """docs with `judged`: all candidates of a text, with weak labels where it grows no tree."""
    shared = docs.sparkSession.sparkContext.broadcast(finder)

    @F.pandas_udf(JUDGED)  # marked below: a filter on its result must not run it a second time
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        f = shared.value
        for s, g in batches:
            yield pd.Series([[dict(zip(("kind", "start", "end", "probability", "label"), x)) for x in xs] for xs in f.judged(s.fillna("").tolist(), (~g.astype(bool)).tolist())], dtype=object)

    return docs.withColumn("judged", run.asNondeterministic()(F.col(text), grows))


def calibration(judged: DataFrame) -> tuple[dict[str, float], dict[str, tuple[np.ndarray, np.ndarray]]]:
    """(thresholds, curves) by kind, from the labelled candidates of all documents. Scores are counted in steps of 1/10,000, so the driver gets a table of bounded size."""
    rows = judged.select(F.explode("judged").alias("x")).where("x.label IS NOT NULL").groupBy(F.col("x.kind").alias("kind"), F.round("x.probability", 4).alias("p"), F.col("x.label").alias("y")).agg(F.count("*").alias("n")).toPandas()
    rows = rows.sort_values(["kind", "p", "y"])
    each = {k: [rows[rows["kind"] == k][c].to_numpy(float) for c in ("p", "y", "n")] for k in KINDS}
    return {k: calibrated(*x) for k, x in each.items()}, {k: isotonic(*x) for k, x in each.items() if len(x[0])}


def _grown(docs: DataFrame, name_parts: DataFrame, text: str, key: str, sample_docs: int) -> tuple[Finder, Column]:
    grows = _grows(docs, text, key, sample_docs)
    names = [(r[0], r[1]) for r in name_parts.select("name_part", "part_kind").distinct().orderBy("name_part", "part_kind").toLocalIterator()]
    scores = name_scores(docs, names, text)
    rows = docs.where(grows).select(F.col(key).alias("k"), F.col(text).alias("t")).toPandas().sort_values(["k", "t"])
    return grow(rows["t"].tolist(), scores), grows


def train(docs: DataFrame, name_parts: DataFrame, text: str = "text", key: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> Finder:
    """A finder: words counted and thresholds set over all documents, trees grown on about sample_docs at most, taken by a hash of the key."""
    finder, grows = _grown(docs, name_parts, text, key, sample_docs)
    finder.threshold, finder.curve = calibration(judge(docs, finder, grows, text))
    return finder


SCHEMA = "spans array<struct<kind: string, start: int, end: int, found_text: string, probability: double>>, redacted string"


def _written_out(text: str, spans: list[tuple[str, int, int, float]], finder: Finder) -> tuple[list[tuple], str]:
    out, at = [], 0
    for kind, a, b, _ in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return [(k, a, b, _ENDS.sub("", text[a:b]), finder.chance(k, p)) for k, a, b, p in spans], "".join([*out, text[at:]])


def find(docs: DataFrame, finder: Finder, text: str = "text") -> DataFrame:
    """docs with `personal`: the spans found (offsets in code points) and the text with each replaced by its kind in brackets.

    A NULL text has NULL, an empty one no span. Texts are taken whole. The finder goes to the workers once; the texts are
    read once and not moved.
    """
    shared = docs.sparkSession.sparkContext.broadcast(finder)

    @F.pandas_udf(SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        f = shared.value
        for s in batches:
            texts = s.fillna("").tolist()
            yield pd.DataFrame([_written_out(t, spans, f) for t, spans in zip(texts, f.spans(texts))], columns=["spans", "redacted"])

    out = docs.withColumn("_text", F.col(text))
    return out.withColumn("personal", F.when(F.col(text).isNotNull(), run(F.col("_text")))).drop("_text")


def choose(judged: DataFrame, finder: Finder, text: str = "text") -> DataFrame:
    """What find() gives, from candidates that are judged already."""
    limit, curve = finder.threshold, finder.curve
    sure = F.filter("judged", lambda x: F.coalesce(*[F.when(x["kind"] == k, x["probability"] >= limit[k]) for k in KINDS]))

    @F.pandas_udf(SCHEMA)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        f = Finder(None, None, limit, curve)
        for s, xs in batches:
            rows = [(t, f.chosen(t, [(x["kind"], x["start"], x["end"], x["probability"], None) for x in found])) for t, found in zip(s.fillna("").tolist(), xs)]
            yield pd.DataFrame([_written_out(*r, f) for r in rows], columns=["spans", "redacted"])

    # texts without any sure span stay as they are and need no worker
    kind = T.StructType.fromDDL(SCHEMA)
    rows = judged.withColumn("_text", F.col(text)).withColumn("_sure", sure).drop("judged")
    some = F.coalesce(F.size("_sure") > 0, F.lit(False)) & F.col(text).isNotNull()
    hit = rows.where(some).withColumn("personal", run(F.col("_text"), F.col("_sure")))
    whole = F.struct(F.array().cast(kind["spans"].dataType).alias("spans"), F.col(text).alias("redacted"))
    rest = rows.where(~some).withColumn("personal", F.when(F.col(text).isNotNull(), whole).cast(kind))
    return hit.unionByName(rest).drop("_text", "_sure")


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    finder, grows = _grown(docs, table(spark, sf_dir, "name_parts"), "text", "doc_id", SAMPLE_DOCS)
    judged = written(judge(fill_cores(docs), finder, grows))  # the costly part, needed for the thresholds and for the spans
    finder.threshold, finder.curve = calibration(judged)
    return choose(judged, finder)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = F.array_distinct(F.transform("personal.spans", lambda x: F.struct(x["kind"].alias("kind"), x["found_text"].alias("found_text"))))
    return _found(spark, sf_dir).select("doc_id", F.explode(cases).alias("x")).select("doc_id", "x.kind", "x.found_text")


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("doc_id", F.col("personal.redacted").alias("redacted_text"), F.size("personal.spans").alias("n_found"))


QUERIES = {"p8_found": p8_found, "p8_redacted": p8_redacted}
SQL: dict[str, str] = {}
