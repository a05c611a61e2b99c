"""Problem 4: evaluation rows that stand, word for word or nearly so, also in the training split.

Minwise hashes of word shingles in banded buckets propose pairs across the splits; the exact Jaccard similarity of their
words confirms them. TESTDATA.md defines a case by words, not by five-word shingles: clauses may change places and two
words may differ, so a shingle here is one word together with all numbers of its question, and the similarity that a pair
needs follows from its length: m words of which two are replaced leave (m - 2) / (m + 2). Questions with different numbers
share no shingle, as they are never the same. Short questions, which may fall below what the bands find surely, also meet
by keys of what is left of them without any two words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .canon import over_distinct, words
from .common import split_label, table, written

BANDS, ROWS = 16, 2
MAX_WORDS = 2
SHORT = 10  # words up to which a question also has keys without any two of them
COURTESY_WORDS = 6  # of a courtesy phrase at most
#: Words that mark a courtesy phrase, in English, Hindi, Tamil and the last two in Latin letters.
COURTESY = frozenset(
    "please kindly hello hi hey dear greetings thanks thank regards sorry excuse pardon question grateful appreciate cheers "
    "कृपया नमस्ते नमस्कार प्रणाम धन्यवाद शुक्रिया आभार सवाल प्रश्न मेहरबानी kripaya kripayaa kripya krpayaa namaste namaskar namaskaar dhanyavad dhanyavaad dhanyavaada shukriya shukriyaa aabhaar sawal sawaal savaal prashn meherbani "
    "தயவுசெய்து தயவு வணக்கம் நன்றி கேள்வி பதில் thayavuseythu thayavuseidhu dhayavuseidhu thayavu vanakkam nandri nanri kelvi pathil bathil".split()
)
RARE_SHARE = 0.0025  # a word of no more than this share of all questions (told apart by their numbers), or of one question only, may be a name
_DIGITS = re.compile(r"\d+")


def parts(text: str) -> tuple[str, list[str]]:
    """(numbers in rising order, the other words in text order)."""
    found = words(text)
    numbers = sorted(n for w in found for n in _DIGITS.findall(w))
    return " ".join(numbers), [x for w in found for x in _DIGITS.sub(" ", w).split()]


def core(found: list[str], courtesy: frozenset[str] = COURTESY) -> list[str]:
    """The words without what stands before and after, up to a courtesy word near the end; all of them if nothing would be left."""
    a = max((i + 1 for i, w in enumerate(found[:COURTESY_WORDS]) if w in courtesy), default=0)
    e = min((i for i in range(max(a, len(found) - COURTESY_WORDS), len(found)) if found[i] in courtesy), default=len(found))
    return found[a:e] or found


def short_keys(found: list[str], courtesy: frozenset[str] = COURTESY) -> list[str]:
    """What is left of a short question without any of its words, any one and any two, in sorted order; also without each courtesy phrase that it may open or close with. Nothing for longer ones."""
    starts = [0, *([] if courtesy.isdisjoint(found[:COURTESY_WORDS]) else range(min(i for i, w in enumerate(found) if w in courtesy) + 1, min(COURTESY_WORDS, len(found)) + 1))]
    back = found[::-1]
    ends = [0, *([] if courtesy.isdisjoint(back[:COURTESY_WORDS]) else range(min(i for i, w in enumerate(back) if w in courtesy) + 1, min(COURTESY_WORDS, len(found)) + 1))]
    out = set()
    for a in starts:
        for e in ends:
            ws = sorted(found[a : len(found) - e])
            if 0 < len(ws) <= SHORT:
                for n in range(min(MAX_WORDS, len(ws) - 1) + 1):
                    out.update(" ".join(c) for c in combinations(ws, len(ws) - n))
    return sorted(out)


def prepared(df: DataFrame, key: str = "row_id", text: str = "question", split: str = "split", source: str = "source") -> DataFrame:
    """(key, side, split, source, numbers, words, core, copy): rows with text and split; `copy` is equal for rows that hold the same words and numbers."""
    rows = df.select(F.col(key).alias("key"), split_label(F.col(split)).alias("split"), F.col(source).alias("source"), F.col(text).alias("text"))
    rows = rows.where(F.col("split").isNotNull() & (F.trim("text") != ""))
    schema = "key long, split string, source string, numbers string, words array<string>, core array<string>, short array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, at = over_distinct(b.column(3), parts)
            cores = [core(v[1]) for v in values]
            keys = [short_keys(v[1]) if len(c) <= SHORT else [] for v, c in zip(values, cores)]
            numbers = pa.array([v[0] for v in values], pa.string()).take(at)
            lists = [pa.array(x, pa.list_(pa.string())).take(at) for x in ([v[1] for v in values], cores, keys)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), b.column(2), numbers, *lists], names=["key", "split", "source", "numbers", "words", "core", "short"])

    copy = F.md5(F.concat_ws("\u0001", "numbers", F.array_join(F.array_sort("words"), " ")))
    return rows.mapInArrow(run, schema).where(F.size("words") > 0).withColumn("side", F.when(F.col("split") == "train", "train").otherwise("eval")).withColumn("copy", copy)


def with_bands(classes: DataFrame) -> DataFrame:
    """(copy, band) rows: BANDS buckets of each class from the minima of BANDS * ROWS hash functions over its shingles, in numpy by batch."""
    rng = np.random.default_rng(5)
    mult = rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            ends = lists.offsets.to_numpy()
            if not len(lists):
                continue
            flat = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)[ends[0] : ends[-1]]
            starts = (ends - ends[0])[:-1]
            sig = []
            for m, c in zip(mult, add):
                h = (flat ^ c) * m
                h ^= h >> np.uint64(31)
                sig.append(np.minimum.reduceat(h * np.uint64(0x9E3779B97F4A7C15), starts))
            buckets = []
            for k in range(BANDS):
                h = np.full(len(lists), k + 1, dtype=np.uint64)
                for r in range(ROWS):
                    h = (h ^ sig[k * ROWS + r]) * np.uint64(0x100000001B3)
                    h ^= h >> np.uint64(29)
                buckets.append(h.view(np.int64))
            keys = b.column(0).take(pa.array(np.repeat(np.arange(len(lists)), BANDS)))
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.stack(buckets, 1).ravel())], names=["copy", "band"])

    shingles = F.transform(F.array_distinct("core"), lambda w: F.xxhash64("numbers", w))
    bands = classes.select("copy", shingles.alias("shingles")).mapInArrow(run, "copy string, band long")
    left = classes.where(F.size("short") > 0).select("copy", F.explode("short").alias("k"), "numbers").select("copy", F.xxhash64("numbers", "k").alias("band"))
    return bands.unionByName(left)


def close(a: str, b: str) -> bool:
    """One letter dropped, added, replaced, or two neighbours exchanged."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y or x == y[1:] or x[1:] == y[1:] or (len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])


def excess(a: list[str], b: list[str]) -> list[bool]:
    """Which words of a are more than b has; of several equal ones, those nearest to an end."""
    over = Counter(a) - Counter(b)
    out = [False] * len(a)
    for i in sorted(range(len(a)), key=lambda i: min(i, len(a) - 1 - i)):
        if over[a[i]] > 0:
            over[a[i]] -= 1
            out[i] = True
    return out


def differing(a: list[str], b: list[str]) -> tuple[list[str], list[str]]:
    """The words that only one of two texts has, courtesy phrases at either end left out, misspelt ones as well (they count in `edits`)."""
    ea, eb = excess(a, b), excess(b, a)
    for e, o, ws in ((ea, eb, a), (eb, ea, b)):
        for step in (1, -1):
            run = 0
            while run < len(e) and e[::step][run]:
                run += 1
            if 0 < run <= COURTESY_WORDS and not (o and o[::step][0]) and not COURTESY.isdisjoint(ws[::step][:run]):
                for i in range(run):
                    e[i if step == 1 else len(e) - 1 - i] = False
    return [w for w, x in zip(a, ea) if x], [w for w, x in zip(b, eb) if x]


def compare(a: list[str], b: list[str]) -> tuple[float, list[str], list[str]]:
    """(similarity, replaced words of a, of b without the misspelt ones): the exact Jaccard similarity of the words, courtesy phrases left out, as far as it reaches what two replaced words leave at this length; else 0."""
    xa, xb = differing(a, b)
    if max(len(xa), len(xb)) > MAX_WORDS:
        return 0.0, [], []
    same = sum((Counter(a) & Counter(b)).values())
    similarity = same / max(1, same + len(xa) + len(xb))
    for w in list(xa):
        other = next((v for v in xb if close(w, v)), None)
        if other is not None:
            xa.remove(w)
            xb.remove(other)
    return similarity, xa, xb


def same_questions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes of copies, confirmed pairs (a, b) of different classes) from prepared() rows."""
    classes = rows.groupBy("copy").agg(F.first("numbers").alias("numbers"), F.min_by(F.struct("words", "core", "short"), "key").alias("x"), F.max(F.col("side") == "train").alias("train"), F.max(F.col("side") == "eval").alias("eval"))
    classes = written(classes.select("copy", "numbers", "x.words", "x.core", "x.short", "train", "eval"))
    bands = with_bands(classes).join(classes.select("copy", "train", "eval"), "copy")
    left, right = bands.where("train").select("band", F.col("copy").alias("x")), bands.where("eval").select("band", F.col("copy").alias("y"))
    met = left.join(right, "band").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    side = lambda n: classes.select(F.col("copy").alias(n), F.col("numbers").alias(f"numbers_{n}"), F.col("words").alias(f"words_{n}"))
    pairs = met.join(side("a"), "a").join(side("b"), "b").where("numbers_a = numbers_b")

    @F.pandas_udf("similarity double, only_a array<string>, only_b array<string>")
    def compared(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([compare(list(x), list(y)) for x, y in zip(a, b)], columns=["similarity", "only_a", "only_b"])

    near = written(pairs.withColumn("c", compared.asNondeterministic()("words_a", "words_b")).where("c.similarity > 0").select("a", "b", "c.*"))
    # a rare word that gave way to another rare word is a name: the question is about another place
    doubtful = near.where(F.size("only_a") * F.size("only_b") > 0)
    asked = doubtful.select(F.explode(F.concat("only_a", "only_b")).alias("word")).distinct()
    # counted by the numbers of a question, as its near copies are no other questions
    counts = classes.select("numbers", F.explode("words").alias("word")).join(asked, "word", "left_semi").distinct().groupBy("word").agg(F.count("*").alias("df"))
    least = F.greatest(F.lit(1.0), F.lit(RARE_SHARE) * F.col("n"))
    both = doubtful.select("a", "b", F.explode(F.array(F.struct(F.lit("a").alias("of"), F.col("only_a").alias("w")), F.struct(F.lit("b").alias("of"), F.col("only_b").alias("w")))).alias("x"))
    words_ = both.select("a", "b", "x.of", F.explode("x.w").alias("word")).join(counts, "word").join(F.broadcast(classes.agg(F.count_distinct("numbers").alias("n"))))
    names = words_.where(F.col("df") <= least).groupBy("a", "b").agg(F.count_distinct("of").alias("sides")).where("sides = 2")
    return classes, near.join(names, ["a", "b"], "left_anti")


def overlap_pairs(df: DataFrame, key: str = "row_id") -> DataFrame:
    """(key_a < key_b): one row in train, the other in dev or test, asking the same.

    Rows without text or split make no pair, nor do texts without any letter. Exact copies are compared once, as a class,
    and only the row pairs across the splits are written out.
    """
    rows = written(prepared(df, key))
    _, pairs = same_questions(rows)
    met = pairs.select("a", "b").union(pairs.select("b", "a")).union(rows.select("copy", "copy").distinct().toDF("a", "b"))
    train = rows.where("side = 'train'").select(F.col("copy").alias("a"), F.col("key").alias("k1"))
    held = rows.where("side = 'eval'").select(F.col("copy").alias("b"), F.col("key").alias("k2"))
    return met.join(train, "a").join(held, "b").select(F.least("k1", "k2").alias(f"{key}_a"), F.greatest("k1", "k2").alias(f"{key}_b"))


def overlap_report(df: DataFrame, key: str = "row_id") -> DataFrame:
    """(eval_split, eval_source, train_source, n_pairs, n_eval_rows): confirmed overlaps by split and source, counted by class and never written out as row pairs."""
    rows = written(prepared(df, key))
    _, pairs = same_questions(rows)
    met = pairs.select("a", "b").union(pairs.select("b", "a")).union(rows.select("copy", "copy").distinct().toDF("a", "b"))
    train = rows.where("side = 'train'").groupBy(F.col("copy").alias("a"), F.col("source").alias("train_source")).agg(F.count("*").alias("n1"))
    held = rows.where("side = 'eval'").groupBy(F.col("copy").alias("b"), F.col("split").alias("eval_split"), F.col("source").alias("eval_source")).agg(F.count("*").alias("n2"))
    each = met.join(train, "a").join(held, "b").groupBy("b", "eval_split", "eval_source", "train_source").agg(F.sum(F.col("n1") * F.col("n2")).alias("n_pairs"), F.first("n2").alias("n_eval"))
    return each.groupBy("eval_split", "eval_source", "train_source").agg(F.sum("n_pairs").alias("n_pairs"), F.sum("n_eval").alias("n_eval_rows"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_pairs(table(spark, sf_dir, "questions"))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_report(table(spark, sf_dir, "questions"))


QUERIES = {"p4_found": p4_found, "p4_report": p4_report}
SQL: dict[str, str] = {}
