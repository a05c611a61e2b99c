"""One consistent form for text that looks the same but is encoded differently.

Compatibility normalisation (composed), look-alike letters, blanks mapped to one space, default-ignorable
characters removed, full case folding. The kernel works on the distinct values of an Arrow batch.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Cyrillic, Greek, Armenian, Cherokee and phonetic letters that are drawn like a Latin letter.
LOOK_ALIKE = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ѕ": "S", "Ј": "J", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ɡ": "g", "ɑ": "a",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
}

# Ranges of characters with the Default_Ignorable_Code_Point property.
IGNORABLE = [
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E),
    (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
]

#: The same by folded letters: a letter whose capital or small form is a look-alike stands for that one's small letter. A Greek nu is drawn like v or, as a capital, like N: beside Latin letters its case tells, in a word without them it is v.
FOLDED = {**{k.casefold(): v.casefold() for k, v in LOOK_ALIKE.items() if k.casefold() != k}, **{k.casefold(): v for k, v in LOOK_ALIKE.items() if k.casefold() == k}}
_MASKS = re.compile("[" + "".join(sorted({*LOOK_ALIKE, *FOLDED, *(k.upper() for k in FOLDED if len(k.upper()) == 1)})) + "]")
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]")
_MASKING = re.compile("[\u0370-\u058f\u13a0-\u13ff\uab70-\uabbf]")
_WORD_RUN = re.compile(r"\S+")

#: Compatibility forms a reader tells apart from the plain character.
SEEN_APART = ("<super>", "<sub>", "<circle>", "<square>", "<fraction>", "<font>")
JOINERS = "\u200c\u200d"
#: A joiner after a virama of an Indic script and before a letter; private characters stand for it during the folding.
CONJUNCT = re.compile("([\u094d\u09cd\u0a4d\u0acd\u0b4d\u0bcd\u0c4d\u0ccd\u0d4d])([\u200c\u200d])(?=[\u0900-\u0d7f])")
KEPT = {"\u200c": "\ue000", "\u200d": "\ue001"}
BACK = {0xE000: "\u200c", 0xE001: "\u200d"}


def ignorable(cp: int) -> bool:
    return any(a <= cp <= b for a, b in IGNORABLE)


class Folding(dict):
    """A translate() table that is filled as characters occur.

    looks: keep what a reader can tell apart (superscripts, circled digits), and show look-alike letters as what they look like.
    words: punctuation and symbols become blanks and decimal digits of any script become ASCII.
    """

    def __init__(self, looks: bool = False, words: bool = False):
        super().__init__()
        self.looks, self.words = looks, words

    def __missing__(self, cp: int) -> str:
        ch = chr(cp)
        if ignorable(cp):
            out = ""
        elif ch.isspace() or unicodedata.category(ch) in ("Zs", "Cc"):
            out = " "
        elif self.looks and unicodedata.decomposition(ch).startswith(SEEN_APART):
            out = ch
        else:
            out = unicodedata.normalize("NFKC", ch)
            if self.looks:
                out = "".join(LOOK_ALIKE.get(x, x) for x in out)
            if self.words:
                out = "".join(self.word(x) for x in out)
        self[cp] = out
        return out

    @staticmethod
    def word(ch: str) -> str:
        kind = unicodedata.category(ch)
        return str(unicodedata.digit(ch)) if kind == "Nd" else " " if kind[0] in "PSZ" else ch


_FULL, _LOOKS, _WORDS = Folding(), Folding(looks=True), Folding(words=True)


def unmasked(text: str) -> str:
    """A text with its look-alike letters read as Latin ones, and folded, where they stand in for them: in words that hold Latin letters too, and in all words of a text whose letters of those scripts are look-alikes only. Words of a text that is written in such a script stay what they are."""
    if text.isascii() or not _MASKS.search(text):
        return text
    native = any(c not in FOLDED for c in _MASKING.findall(text.casefold()))

    def read(m: re.Match) -> str:
        word = m[0]
        if not _MASKS.search(word):
            return word
        if not _LATIN.search(word):
            return word if native else "".join(FOLDED.get(c, c) for c in word.casefold())
        return "".join(FOLDED.get(c, c) for c in "".join(LOOK_ALIKE.get(c, c) for c in word).casefold())

    return _WORD_RUN.sub(read, text)


def canonical(text: str) -> str:
    """The comparison form: composed, without ignorables, case-folded, single blanks, look-alike letters read as Latin where they stand in for it."""
    return " ".join(unicodedata.normalize("NFKC", unmasked(text.translate(_FULL)).casefold()).split())


def visible(text: str) -> str:
    """What a reader sees: as canonical(), but case, accents, punctuation and raised or circled characters stay.

    A joiner between a virama and a letter changes the drawn conjunct in Indic scripts, so it stays too.
    """
    if any(j in text for j in JOINERS):
        text = CONJUNCT.sub(lambda m: f"{m[1]}{KEPT[m[2]]}", text)
        shown = " ".join(unicodedata.normalize("NFC", text.translate(_LOOKS)).split())
        return shown.translate(BACK)
    return " ".join(unicodedata.normalize("NFC", text.translate(_LOOKS)).split())


def words(text: str) -> list[str]:
    """Case-folded words of a text; punctuation, kinds of blank, width, ignorables and look-alikes make no difference."""
    if text.isascii():
        return text.casefold().translate(_WORDS).split()
    return unicodedata.normalize("NFKC", unmasked(text.translate(_WORDS)).casefold()).split()


def over_distinct(column: pa.ChunkedArray | pa.Array, fn) -> tuple[list, pa.Array]:
    """fn over the distinct values of a column, and for each row the place of its value (NULL stays NULL)."""
    coded = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    coded = pc.dictionary_encode(coded)
    return [fn(x) for x in coded.dictionary.to_pylist()], coded.indices


def add_canonical(df: DataFrame, column: str, canonical_name: str = "canonical", visible_name: str = "visible_form") -> DataFrame:
    """df with the canonical and the visible form of a text column; NULL gives NULL, a blank text gives ''.

    Each distinct value of an Arrow batch is normalised once. No shuffle. The new names must not be in df.
    """
    for name in (canonical_name, visible_name):
        if name in df.columns:
            raise ValueError(f"column {name} is there already")
    schema = T.StructType([*df.schema.fields, T.StructField(canonical_name, T.StringType()), T.StructField(visible_name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(b.schema.get_field_index(column))
            values, at = over_distinct(col, lambda t: (canonical(t), visible(t)))
            ends = [pa.array([v[k] for v in values], pa.string()).take(at) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns, *ends], names=[*b.schema.names, canonical_name, visible_name])

    return df.mapInArrow(run, schema)
