"""Problem 5: a language with a confidence for each document and each segment of a mixed one.

Multinomial naive Bayes over hashed character n-grams. The classes are pairs of language and script, learned from
labelled rows whose labels may be wrong; the script of a text only picks the class it trains, never its language.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .canon import canonical
from .common import fill_cores, hash_sample, language_label, table

LANGUAGES = ("en", "hi", "ta")  # of this project's data; a parameter of train()
SAMPLE_ROWS = 20_000  # bound of the labelled sample that the model is fitted on
BITS = 16
ORDERS = (1, 2, 3, 4)
CHUNK = 200_000  # characters scored at once
MIN_LETTERS = 6  # a shorter piece is a word or a name and no sentence
LEAST_TEXTS = 5  # segments; fewer say too little to fit a class
ROUNDS = 8  # at most so many fits sort out wrong labels
_CODE = re.compile(r"\S*\d\S*")
_NOT_LETTERS = re.compile(r"[^\wऀ-෿]+|_")
#: Sentence ends; "Rs. 5" and initials do not end one. Vowel signs and other marks count as letters.
_END = re.compile(r"(?<=[?!।॥？！])\s+|(?<=(?:[^\W\d]|(?!\d)[ऀ-෿]){3}[.。．])\s+(?=\D)|[ \t]*[\n\r]+\s*|\s+/\s+")
_SCRIPTS = [("deva", 0x0900, 0x097F), ("taml", 0x0B80, 0x0BFF), ("latn", 0x41, 0x24F)]


def letters(text: str) -> str:
    """The text as the model sees it: canonical form without codes, digits and punctuation, single blanks."""
    return _NOT_LETTERS.sub(" ", _CODE.sub(" ", canonical(text))).strip()


def script_of(text: str) -> str:
    counts = {name: sum(a <= ord(c) <= b for c in text) for name, a, b in _SCRIPTS}
    best = max(counts, key=counts.get)
    return best if counts[best] else "none"


def parted(text: str) -> list[tuple[str, str]]:
    """(segment, its letters): sentences and lines of a text, as they stand; a piece without MIN_LETTERS letters joins the one before or after it."""
    out: list[tuple[str, str]] = []
    for p in _END.split(text):
        if not p or not p.strip():
            continue
        seen = letters(p)
        if out and (len(seen) < MIN_LETTERS or len(out[-1][1]) < MIN_LETTERS):
            out[-1] = f"{out[-1][0]} {p}", f"{out[-1][1]} {seen}".strip()
        else:
            out.append((p, seen))
    return out


def segments(text: str) -> list[str]:
    return [p for p, _ in parted(text)]


def ngram_cells(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash cell, text number) of every character n-gram of the texts, words padded with a blank; all in numpy."""
    joined = "".join(f" {t} \0\0\0" for t in texts)
    cp = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 5 for t in texts])
    cells, owners = [], []
    for n in ORDERS:
        if len(cp) < n:
            continue
        m = len(cp) - n + 1
        h = np.full(m, n, dtype=np.uint64)
        ok = np.ones(m, dtype=bool)
        for k in range(n):
            part = cp[k : k + m]
            h = h * np.uint64(0x100000001B3) + part
            ok &= part != 0
            if 0 < k < n - 1:
                ok &= part != 32
        if n == 1:
            ok &= cp != 32
        h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
        cells.append(h[ok].astype(np.int64))
        owners.append(owner[:m][ok])
    return np.concatenate(cells), np.concatenate(owners)


@dataclass
class Model:
    classes: list[tuple[str, str]]
    logp: np.ndarray  # cell x class; its size is fixed by BITS and the number of classes
    prior: np.ndarray  # log share of each class among the segments
    languages: tuple[str, ...] = LANGUAGES

    def posteriors(self, texts: list[str]) -> np.ndarray:
        """Probability of each of the languages for each text; n-grams of one place count as one observation. No letters: all equal."""
        out = np.full((len(texts), len(self.languages)), 1 / len(self.languages))
        if not self.classes:
            return out
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (size < CHUNK or end == start):
                size += len(texts[end])
                end += 1
            self._score(out[start:end], *ngram_cells(texts[start:end]))
            start = end
        return out

    def scored(self, parts: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
        """posteriors() of n texts whose n-grams are at hand, in parts of 2,000 texts."""
        out = np.full((n, len(self.languages)), 1 / len(self.languages))
        for i, part in enumerate(parts):
            self._score(out[2000 * i : 2000 * (i + 1)], *part)
        return out

    def _score(self, out: np.ndarray, cells: np.ndarray, owner: np.ndarray) -> None:
        n = len(out)
        score = np.stack([np.bincount(owner, weights=self.logp[cells, c], minlength=n) for c in range(len(self.classes))], 1)
        score = np.maximum(score / len(ORDERS), -1e6) + self.prior
        seen = np.bincount(owner, minlength=n) > 0
        p = np.exp(score - score.max(1, keepdims=True))
        by = np.stack([p[:, [i for i, (l, _) in enumerate(self.classes) if l == lang]].sum(1) for lang in self.languages], 1)
        out[seen] = (by / by.sum(1, keepdims=True))[seen]


def fit(texts: list[str], labels: list[str], languages: tuple[str, ...] = LANGUAGES) -> Model:
    """A model from labelled texts, by segments, as a text may be mixed. Segments whose label is contradicted by a model of the other half of the texts are left out of the next fits, until none is.

    A class, however small its share of a script, stays as long as such models confirm segments of it; one of wrong labels
    has the n-grams of the right class, which knows them better.
    """
    rows = [(x, l, zlib.crc32(t.encode()) & 1) for t, l in zip(texts, labels) for _, x in parted(t)]
    texts, labels = [x[0] for x in rows], [x[1] for x in rows]
    scripts = [script_of(t) for t in texts]
    names = sorted({c for c in zip(labels, scripts) if c[1] != "none"})
    at = {c: k for k, c in enumerate(names)}
    of = np.array([at.get(c, -1) for c in zip(labels, scripts)], np.int64)
    half = np.array([x[2] for x in rows], np.int64)  # equal texts are in one half
    parts = [ngram_cells(texts[i : i + 2000]) for i in range(0, len(texts), 2000)]
    keep = of >= 0
    for _ in range(ROUNDS):
        by = [_counts(parts, np.where(keep & (half == h), of, -1), len(names)) for h in (0, 1)]
        sizes = np.bincount(of[keep], minlength=len(names))
        new = keep.copy()
        for h in (0, 1):
            model = _model(names, by[1 - h], sizes, languages)
            if model.classes:
                new &= (half != h) | (model.scored(parts, len(texts)).argmax(1) == [languages.index(x) for x in labels])
        if (new == keep).all():
            break
        keep = new
    return _model(names, _counts(parts, np.where(keep, of, -1), len(names)), np.bincount(of[keep], minlength=len(names)), languages)


def _counts(parts: list[tuple[np.ndarray, np.ndarray]], of: np.ndarray, n: int) -> np.ndarray:
    """cell x class: n-grams of the texts of each class (-1: of none)."""
    out = np.zeros((1 << BITS, n))
    for i, (cells, owner) in enumerate(parts):
        mine = of[owner + 2000 * i]
        for k in range(n):
            out[:, k] += np.bincount(cells[mine == k], minlength=1 << BITS)
    return out


def _model(names: list[tuple[str, str]], counts: np.ndarray, sizes: np.ndarray, languages: tuple[str, ...] = LANGUAGES) -> Model:
    """Of the classes that have segments enough and stand in the counts."""
    use = [k for k in range(len(names)) if sizes[k] >= LEAST_TEXTS and counts[:, k].any()]
    smooth = counts[:, use] + 0.05
    return Model([names[k] for k in use], np.log(smooth / smooth.sum(0)), np.log(sizes[use] / max(1, sizes[use].sum())), languages)


def train(df: DataFrame, text: str, language: str, key: str, sample_rows: int = SAMPLE_ROWS, languages: tuple[str, ...] = LANGUAGES) -> Model:
    """A model of the languages fitted on about `sample_rows` labelled rows at most, taken by a hash of the key. Rows with other labels are not learned from."""
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"), language_label(F.col(language)).alias("l"))
    rows = hash_sample(rows.where(F.col("l").isin(*languages) & (F.trim("t") != "")), F.xxhash64("k"), sample_rows).toPandas().sort_values(["k", "t"])
    return fit(rows["t"].tolist(), rows["l"].tolist(), languages)


SCHEMA = "language string, confidence double, segments array<struct<segment: string, language: string, confidence: double>>"


def identify(df: DataFrame, model: Model, text: str = "question") -> DataFrame:
    """df with `detected`: language and confidence of the whole text, and of each of its segments.

    A text without letters has language NULL and confidence 0; a NULL text has NULL. The model, a matrix of fixed size,
    goes to the workers once.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(SCHEMA)  # marked below: a filter on its result must not run it a second time
    def detect(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for s in batches:
            texts = s.fillna("").tolist()
            parts = [parted(t) for t in texts]
            # a text of one segment is scored once
            flat = [" ".join(x for _, x in p if x) for p in parts] + [x for p in parts if len(p) > 1 for _, x in p]
            post = m.posteriors(flat)
            named = [(m.languages[b], float(p[b])) if t else (None, 0.0) for t, p, b in zip(flat, post, post.argmax(1))]
            at, rows = len(texts), []
            for i, p in enumerate(parts):
                own = [named[i]] if len(p) == 1 else named[at : at + len(p)]
                rows.append((*named[i], [(x, *n) for (x, _), n in zip(p, own)]))
                at += len(p) if len(p) > 1 else 0
            yield pd.DataFrame(rows, columns=["language", "confidence", "segments"])

    once = detect.asNondeterministic()
    out = df.withColumn("_text", F.col(text)).withColumn("_found", once(F.col("_text")))
    return out.withColumn("detected", F.when(F.col(text).isNotNull(), F.col("_found"))).drop("_text", "_found")


def text_languages(detected: str = "detected", least: float = 0.9):
    """The languages a text is written in: those of its segments that are sure by `least`; if none is, that of the whole text."""
    sure = F.filter(F.col(f"{detected}.segments"), lambda x: x["confidence"] >= least)
    found = F.array_distinct(F.transform(sure, lambda x: x["language"]))
    return F.when(F.size(found) > 0, F.array_compact(found)).otherwise(F.array_compact(F.array(F.col(f"{detected}.language"))))


def wrong_labels(df: DataFrame, model: Model, key: str = "row_id", text: str = "question", language: str = "language") -> DataFrame:
    """(key, language): one row per language of each text whose label is missing or names another one, or that is mixed."""
    rows = fill_cores(df.select(key, text, language)).where(F.trim(text) != "").select(key, text, language_label(F.col(language)).alias("_label"))
    rows = identify(rows, model, text).withColumn("_in", text_languages())
    wrong = F.col("_label").isNull() | ~F.array_contains("_in", F.col("_label")) | (F.size("_in") > 1)
    return rows.where(wrong).select(key, F.explode_outer("_in").alias("language")).where("language IS NOT NULL")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "questions")
    return wrong_labels(q, train(q, "question", "language", "row_id"))


def p5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of every question with its language and confidence, beside those of the whole question."""
    q = table(spark, sf_dir, "questions")
    rows = identify(fill_cores(q.select("row_id", "question")), train(q, "question", "language", "row_id"))
    rows = rows.where("question IS NOT NULL").select("row_id", F.col("detected.language").alias("question_language"), F.round("detected.confidence", 6).alias("question_confidence"), F.posexplode_outer("detected.segments"))
    return rows.select("row_id", "question_language", "question_confidence", F.col("pos").alias("segment_no"), F.col("col.language").alias("segment_language"), F.round("col.confidence", 6).alias("segment_confidence"))


QUERIES = {"p5_found": p5_found, "p5_segments": p5_segments}
SQL: dict[str, str] = {}
