"""Problem 7: passages of held-out items inside the documents of a corpus.

A prefix-filtered set join of word shingles. TESTDATA.md counts a stretch of twelve words with one word in eight changed,
which always leaves five words in a row untouched, so shingles of five words find every case; their overlap need not be
0.8. One pass over the corpus gathers, by document, the stretches that hold shingles of the items, told by a bitmap of
fixed size, and in how many documents each of these shingles stands. The shingles of each window of an item are then
ordered by rarity; only the rarest, as many as a match must hit, meet the stretches by equi-join and propose pairs; length
and position bounds thin them out and an exact word alignment confirms them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .canon import words
from .common import fill_cores, spread, table, written

K = 5  # words of a shingle
LEAST_WORDS, ONE_IN = 12, 8
BITS = 26  # the bitmap of the items' shingles has 2^BITS places, 8 MB, however many items there are
MEMO = 500_000
_HASHED: dict[str, int] = {}


def tokens(text: str) -> tuple[list[str], list[int]]:
    """(words without punctuation, number of the blank-separated word that each comes from): 'QSE-7 a' gives [qse, 7, a], [0, 0, 1].

    Words that punctuation splits are compared piece by piece and counted as one.
    """
    found, owner = [], []
    for i, w in enumerate(" ".join(text.split()).split(" ")):
        pieces = [w.casefold()] if w.isascii() and w.isalpha() else words(w)
        found += pieces
        owner += [i] * len(pieces)
    return found, owner


def _word_hash(word: str) -> int:
    h = _HASHED[word] = xxhash.xxh64_intdigest(word)
    return h


def shingles(found: list[str]) -> np.ndarray:
    """A 64-bit hash of every K words in a row, from the hashes of the words, which each worker remembers."""
    if len(found) < K:
        return np.zeros(0, np.int64)
    if len(_HASHED) > MEMO:
        _HASHED.clear()
    get = _HASHED.get
    h = np.array([get(w) or _word_hash(w) for w in found], dtype=np.uint64)
    n = len(h) - K + 1
    out = np.zeros(n, dtype=np.uint64)
    for k in range(K):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return (out ^ (out >> np.uint64(32))).view(np.int64)


def needed(owner: list[int], marks: list[int], n: list[int]) -> list[int]:
    """Positions of the shingles of an item that a match must hit: of each window of 12 words (one edit), 16 (two), 24 (three) and so on the S - T + 1 rarest.

    n: documents that hold each shingle. S is the window's number of shingles and T how many of them the allowed edits leave.
    """
    out: set[int] = set()
    first = [owner.index(w) for w in sorted(set(owner))]
    n_words = len(first)
    for size in [LEAST_WORDS, *range(2 * ONE_IN, n_words + 1, ONE_IN)]:
        edits = size // ONE_IN
        for w in range(n_words - size + 1):
            a, b = first[w], (first[w + size] if w + size < n_words else len(owner)) - K + 1
            at = sorted(range(a, b), key=lambda i: (n[i], marks[i], i))
            least = size - K * edits - K + 1
            out.update(at[: max(0, len(at) - least + 1)])
    return sorted(out)


def item_table(items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """(item, words, owner, marks) of the items that have twelve words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parted = [tokens(t) for t in b.column(1).to_pylist()]
            cols = [b.column(0), pa.array([f for f, _ in parted], pa.list_(pa.string())), pa.array([o for _, o in parted], pa.list_(pa.int64())), pa.array([shingles(f) for f, _ in parted], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["item", "words", "owner", "marks"])

    rows = items.where(F.length(item_text) > 0).select(F.col(item_key).cast("long"), item_text).distinct()
    return rows.mapInArrow(run, "item long, words array<string>, owner array<long>, marks array<long>").where(F.size("words") >= LEAST_WORDS)


def _listed(marks: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The positions of the shingles whose two places in the bitmap are both set."""
    n = len(bits).bit_length() + 5
    u = marks.view(np.uint64)
    at = np.arange(len(u))
    for place in (lambda x: x & np.uint64((1 << n) - 1), lambda x: x >> np.uint64(64 - n)):
        p = place(u[at])
        at = at[((bits[(p >> np.uint64(6)).view(np.int64)] >> (p & np.uint64(63))) & np.uint64(1)).view(np.int64) == 1]
    return at


def bitmap(listed: DataFrame, n: int = BITS) -> np.ndarray:
    """Two of 2^n places for each shingle of the items, as 64-bit words. What comes to the driver is at most 2^n / 64 rows."""
    mark = F.explode("marks")
    at = listed.select(mark.alias("m")).select(F.explode(F.array(F.col("m").bitwiseAND(F.lit((1 << n) - 1)), F.shiftrightunsigned("m", 64 - n))).alias("p"))
    cells = at.groupBy(F.shiftright("p", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("bits")).toPandas()
    out = np.zeros(1 << (n - 6), dtype=np.uint64)
    out[cells["cell"].to_numpy(np.int64)] = cells["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def gathered(docs: DataFrame, bits: np.ndarray, reach: int, key: str, text: str) -> DataFrame:
    """One pass over the corpus: rows (key, first, words, owner, at, marks) for stretches with at least two shingles that may be an item's within the reach of an item's length, and rows (mark, n) with document counts by batch."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            rows, seen = [], defaultdict(int)
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found, owner = tokens(t)
                marks = shingles(found)
                at = _listed(marks, bits)
                if not len(at):
                    continue
                for m in set(marks[at].tolist()):
                    seen[m] += 1
                # runs of hits no further apart than the reach; neighbours whose surroundings meet are one stretch
                cuts = np.flatnonzero(np.diff(at) > 2 * reach + K) + 1
                for hit in np.split(at, cuts):
                    if len(hit) < 2 or (np.diff(hit) > reach).all():
                        continue
                    a, e = max(0, int(hit[0]) - reach), min(len(found), int(hit[-1]) + K + reach)
                    rows.append((d, a, found[a:e], owner[a:e], (hit - a).tolist(), marks[hit].tolist(), None, None))
            rows += [(None, None, None, None, None, None, m, n) for m, n in seen.items()]
            cols = list(zip(*rows)) if rows else [()] * 8
            types = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["key", "first", "words", "owner", "at", "marks", "mark", "n"])

    schema = "key long, first long, words array<string>, owner array<long>, at array<long>, marks array<long>, mark long, n long"
    return docs.where(F.length(text) > 0).select(F.col(key).cast("long"), text).mapInArrow(run, schema)


def runs(a: list[str], b: list[str]) -> list[tuple[int, int, int]]:
    """Stretches (start in a, start in b, length) that cannot be made longer, of two words at least, or of one word between longer ones."""
    at = defaultdict(list)
    for j, w in enumerate(b):
        at[w].append(j)
    out = []
    for i, w in enumerate(a):
        for j in at.get(w, ()):
            if i and j and a[i - 1] == b[j - 1]:
                continue
            n = 1
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            out.append((i, j, n))
    long = [(i, j) for i, j, n in out if n >= K]
    return [(i, j, n) for i, j, n in out if n > 1 or any(abs((i - x) - (j - y)) <= 4 for x, y in long)]


def contains(item: list[str], item_owner: list[int], found: list[str], owner: list[int]) -> int:
    """Words of the longest stretch of the item, of LEAST_WORDS at least, that stands in `found` with at most one word in ONE_IN replaced, dropped or added; 0 if none does."""
    rs = sorted(runs(item, found))
    best = 0
    for s, (i0, j0, n0) in enumerate(rs):
        # least edits on a chain of runs from rs[s] to each later one
        edits = {s: 0}
        for x in range(s, len(rs)):
            if x not in edits:
                continue
            i1, j1, n1 = rs[x]
            covered = item_owner[i1 + n1 - 1] - item_owner[i0] + 1
            if covered >= LEAST_WORDS and edits[x] * ONE_IN <= covered:
                best = max(best, covered)
            for y in range(x + 1, len(rs)):
                i2, j2, n2 = rs[y]
                cut = max(0, i1 + n1 - i2, j1 + n1 - j2)
                if cut >= n2 or i2 + cut <= i1:
                    continue
                gap_i = _between(item_owner, i1 + n1, i2 + cut)
                gap_j = _between(owner, j1 + n1, j2 + cut)
                cost = edits[x] + max(gap_i, gap_j)
                if cost <= 1 + len(item) // ONE_IN and cost < edits.get(y, 1 << 30):
                    edits[y] = cost
    return best


def _between(owner: list[int], a: int, b: int) -> int:
    """Blank-separated words that the tokens from a to b belong to."""
    return owner[b - 1] - owner[a] + 1 if b > a else 0


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", bits: int = BITS) -> DataFrame:
    """(key, item_key, words): each document with each item that leaked into it, and the length of the longest leaked stretch.

    NULL and empty texts, and items of fewer than twelve words, give no row. Items and documents are tables that meet by
    equi-join; the driver sees the bitmap of fixed size and the length of the longest item.
    """
    listed = written(item_table(items, item_key, item_text))
    longest = listed.agg(F.max(F.size("words"))).first()[0] or 0
    seen = written(gathered(fill_cores(docs.select(key, text)), bitmap(listed, bits), longest + longest // ONE_IN + 2, key, text))

    @F.pandas_udf("array<int>")
    def must_hit(owners: pd.Series, marks: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([needed(list(o), list(m), list(n)) for o, m, n in zip(owners, marks, ns)])

    counts = seen.where("mark IS NOT NULL").groupBy("mark").agg(F.sum("n").alias("n"))
    each = listed.select("item", F.posexplode("marks").alias("pos", "mark")).join(counts, "mark", "left")
    ns = each.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("n", F.lit(0)).alias("n")))), lambda x: x["n"]).alias("ns"))
    prefix = listed.join(ns, "item").select("item", "marks", F.explode(must_hit("owner", "marks", "ns")).alias("pos")).select("item", F.col("pos").cast("long").alias("pos"), F.element_at("marks", F.col("pos") + 1).alias("mark"))

    stretches = seen.where("key IS NOT NULL")
    hits = stretches.select("key", "first", F.explode(F.arrays_zip("at", "marks")).alias("x")).select("key", "first", F.col("x.at").alias("at"), F.col("x.marks").alias("mark"))
    offset = F.col("at") - F.col("pos")
    pairs = hits.join(prefix, "mark").groupBy("key", "first", "item").agg(F.min(offset).alias("lo"), F.max(offset).alias("hi"))
    # position bound: a stretch reaches no further before the first and after the last hit than the item itself does
    known = listed.select("item", F.col("words").alias("item_words"), F.col("owner").alias("item_owner"))
    both = spread(pairs, "key", "first").join(stretches.select("key", "first", "words", "owner"), ["key", "first"]).join(known, "item")
    slack = F.floor(F.size("item_words") / ONE_IN) + 1
    a = F.greatest(F.lit(0).cast("long"), F.col("lo") - slack)
    e = F.least(F.size("words").cast("long"), F.col("hi") + F.size("item_words") + slack)
    both = both.withColumn("a", a.cast("int")).withColumn("size", (e - a).cast("int")).where(F.col("size") >= LEAST_WORDS - LEAST_WORDS // ONE_IN)
    part = lambda c: F.slice(c, F.col("a") + 1, F.col("size"))

    @F.pandas_udf("int")
    def verified(iw: pd.Series, io: pd.Series, fw: pd.Series, fo: pd.Series) -> pd.Series:
        return pd.Series([contains(list(a), list(b), list(c), list(d)) for a, b, c, d in zip(iw, io, fw, fo)], dtype="int32")

    found = both.select("key", "item", verified.asNondeterministic()("item_words", "item_owner", part("words"), part("owner")).alias("words")).where("words > 0")
    return found.groupBy("key", "item").agg(F.max("words").alias("words")).select(F.col("key").alias(key), F.col("item").alias(item_key), "words")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_items")).select("doc_id", "item_id")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by the number of documents that they leaked into."""
    out = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_items"))
    return out.groupBy("item_id").agg(F.count("*").alias("n_documents"), F.max("words").alias("longest_words"))


QUERIES = {"p7_found": p7_found, "p7_report": p7_report}
SQL: dict[str, str] = {}
