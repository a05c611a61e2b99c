"""Problem 6: fixed-capacity containers filled with whole documents, sizes in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fill_cores, table, written

#: Vocabulary file of a byte-level BPE as ranks, and the pattern it is used with; both are parameters.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHARD_ITEMS = 30_000  # items packed together by one task
MEMO = 500_000
_LOADED: dict[str, tuple] = {}


def _tokenizer(path: str) -> tuple:
    """The tokenizer and its memo of word lengths, once per worker."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = (tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), {})
    return _LOADED[path]


def count_tokens(text: str, path: str = TOKENIZER) -> int:
    """Exact number of tokens. The pattern always starts a new piece at a single blank before a non-blank, so counts of such words add up."""
    encoding, memo = _tokenizer(path)
    if "  " in text:
        return len(encoding.encode_ordinary(text))
    if len(memo) > MEMO:
        memo.clear()
    total, first = 0, True
    for word in text.split(" "):
        piece = word if first else " " + word
        first = False
        n = memo.get(piece)
        if n is None:
            n = memo[piece] = len(encoding.encode_ordinary(piece))
        total += n
    return total


def sized(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """(key, tokens) of every row with text; NULL and empty texts need no room and give no row."""

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: count_tokens(t, path)).astype("int64")

    return df.where(F.length(text) > 0).select(key, tokens(F.col(text)).alias("tokens"))


def items(sizes: DataFrame, containers: DataFrame, key: str = "doc_id") -> DataFrame:
    """(container_kind, capacity, key, part_no, n_parts, size): one row per item; only a document above the capacity is split, into full parts and a rest."""
    # the kinds are a plan of a few rows, written into the plan of the query as literals
    kinds = containers.where("capacity_tokens > 0").select("container_kind", "capacity_tokens").distinct().collect()
    none = F.array().cast("array<struct<container_kind:string,capacity:bigint>>")
    each_kind = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("bigint").alias("capacity")) for k, c in sorted(kinds)]) if kinds else none
    each = sizes.select(key, "tokens", F.explode(each_kind).alias("k")).select(key, "tokens", "k.*")
    n = F.ceil(F.col("tokens") / F.col("capacity"))
    parts = each.withColumn("n_parts", n).withColumn("part_no", F.explode(F.sequence(F.lit(1).cast("long"), "n_parts")))
    return parts.select("container_kind", "capacity", key, "part_no", "n_parts", F.when(F.col("part_no") < F.col("n_parts"), F.col("capacity")).otherwise(F.col("tokens") - (F.col("n_parts") - 1) * F.col("capacity")).alias("size"))


class Pool:
    """Items by size: the sizes that still have items, in rising order, and the items of each."""

    def __init__(self, sizes: list[int]) -> None:
        self.items: dict[int, list[int]] = {}
        for k in range(len(sizes) - 1, -1, -1):
            self.items.setdefault(sizes[k], []).append(k)
        self.sizes = sorted(self.items)

    def take(self, size: int) -> int:
        k = self.items[size].pop()
        if not self.items[size]:
            self.sizes.pop(bisect_left(self.sizes, size))
        return k

    def put(self, size: int, k: int) -> None:
        if not self.items[size]:
            insort(self.sizes, size)
        self.items[size].append(k)

    def smallest(self, n: int, above: int = -1) -> list[int]:
        """The n smallest sizes above a bound, repeated as often as they have items; fewer if there are no more."""
        out: list[int] = []
        for s in self.sizes[bisect_left(self.sizes, above + 1) :]:
            out += [s] * min(n - len(out), len(self.items[s]))
            if len(out) == n:
                break
        return out

    def largest(self, room: int) -> int:
        """The largest size that fits into room, 0 if none does."""
        at = bisect_left(self.sizes, room + 1)
        return self.sizes[at - 1] if at else 0

    def pair(self, room: int) -> int:
        """The largest sum of two items that fit into room together, 0 if none do."""
        lo, hi, best = 0, bisect_left(self.sizes, room + 1) - 1, 0
        while lo <= hi and best < room:
            s = self.sizes[lo] + self.sizes[hi]
            if s > room:
                hi -= 1
            elif lo == hi:
                return max(best, s if len(self.items[self.sizes[lo]]) > 1 else 0)
            else:
                best, lo = max(best, s), lo + 1
        return best


def dominating(pool: Pool, room: int) -> list[int] | None:
    """The sizes beside an item that leaves `room` free which dominate every other choice from the pool; None if no such choice is proved.

    One choice dominates another if the items of the other can be parted among its own so that no part is larger than the
    item it stands for; then some best packing uses it. Proved are: nothing where nothing fits; the largest item that fits
    where it fills the room or no two fit; where at most two fit, the largest item if it is no smaller than any two that do,
    or the largest item with one beside it, if no better pair fits and no pair of two items larger than the second fits.
    """
    best = pool.largest(room)
    if not best:
        return []
    if best == room or sum(pool.smallest(2)) > room or len(pool.smallest(2)) < 2:
        return [best]
    three = pool.smallest(3)
    if len(three) == 3 and sum(three) <= room:
        return None
    pair = pool.pair(room)
    if best >= pair:
        return [best]
    k = pool.take(best)
    second = pool.largest(room - best)
    pool.put(best, k)
    larger = pool.smallest(2, second)
    if second and best + second == pair and (len(larger) < 2 or sum(larger) > room):
        return [best, second]
    return None


def reduced(sizes: list[int], capacity: int) -> tuple[list[list[int]], list[int]]:
    """(containers fixed by dominance, the other items in falling size): items are looked at in falling size, partners are all items not fixed yet."""
    pool = Pool(sizes)
    fixed: list[list[int]] = []
    size = pool.sizes[-1] if pool.sizes else 0
    while size:
        j = pool.take(size)
        found = dominating(pool, capacity - size)
        if found is None:
            pool.put(size, j)
        else:
            fixed.append([j, *(pool.take(s) for s in found)])
        if found is None or not pool.items[size]:
            size = pool.largest(size - 1)
    return fixed, [k for s in reversed(pool.sizes) for k in reversed(pool.items[s])]


def pack(sizes: list[int], capacity: int) -> list[int]:
    """The container number of each item: dominance reduction first, then best fit of what it leaves, in falling size."""
    fixed, rest = reduced(sizes, capacity)
    where = [-1] * len(sizes)
    for b, members in enumerate(fixed):
        for k in members:
            where[k] = b
    n_bins = len(fixed)
    gaps: list[tuple[int, int]] = []
    for j in rest:
        at = bisect_left(gaps, (sizes[j], -1))
        if at < len(gaps):
            gap, b = gaps.pop(at)
        else:
            gap, b = capacity, n_bins
            n_bins += 1
        where[j] = b
        if gap > sizes[j]:
            insort(gaps, (gap - sizes[j], b))
    return where


def packed(all_items: DataFrame, n_items: int, n_kinds: int = 1, key: str = "doc_id", shard_items: int = SHARD_ITEMS) -> DataFrame:
    """all_items with `container`: items are dealt by hash to shards of about shard_items, each packed by one task.

    A shard wastes at most what its last containers leave open. A task sees ids and sizes only, never texts.
    """
    shards = max(1, -(-n_items // shard_items))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in all_items.schema.fields) + ", shard int, container string"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([key, "part_no"], ignore_index=True)
        capacity, kind, shard = int(pdf["capacity"].iloc[0]), pdf["container_kind"].iloc[0], pdf["shard"].iloc[0]
        where = pack(pdf["size"].astype(int).tolist(), capacity)
        return pdf.assign(container=[f"{kind}/{shard}/{b}" for b in where])

    rows = all_items.withColumn("shard", F.pmod(F.xxhash64(key, "part_no"), F.lit(shards)).cast("int"))
    # as many parts as there are shards to pack, so that no task packs several
    dealt = rows.repartition(shards * max(1, n_kinds), "container_kind", "shard")
    return dealt.groupBy("container_kind", "shard").applyInPandas(run, schema)


def pack_documents(df: DataFrame, containers: DataFrame, key: str = "doc_id", text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """(container_kind, capacity, key, part_no, n_parts, size, shard, container) of every item. Token counts are made once and kept in the shared folder.

    NULL and empty texts are no items; equal documents are separate items; no container kind, or none above 0, gives no row.
    """
    sizes = written(sized(fill_cores(df.select(key, text)), key, text, path))
    parts = items(sizes, containers, key)
    # the number of items of the kind that has most: that of the smallest capacity
    smallest = containers.where("capacity_tokens > 0").agg(F.min("capacity_tokens")).first()[0]
    n = sizes.agg(F.sum(F.ceil(F.col("tokens") / F.lit(smallest or 1)))).first()[0] or 0
    return packed(parts, int(n), containers.where("capacity_tokens > 0").select("container_kind").distinct().count(), key)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "containers"))
    return out.where("container_kind = 'window_m' AND n_parts > 1").select("doc_id").distinct()


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "containers"))
    return out.select("container_kind", "container", "doc_id", "part_no", "n_parts", "size")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used by kind against the least number that the tokens need."""
    out = pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "containers"))
    by = out.groupBy("container_kind", "capacity").agg(F.count_distinct("container").alias("containers"), F.count("*").alias("items"), F.sum("size").alias("tokens"))
    least = F.ceil(F.col("tokens") / F.col("capacity"))
    return by.select("container_kind", "capacity", "items", "tokens", "containers", least.alias("least_containers"), F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("unused_share"))


QUERIES = {"p6_found": p6_found, "p6_packing": p6_packing, "p6_report": p6_report}
SQL: dict[str, str] = {}
