"""Lexical and vector retrieval, fusion of rankings, signals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import lexicon as L
from ..functions import text as X
from ..session import written
from .ranking import spread, top_k


def postings(chunks: DataFrame, key: str = "chunk_id", text: str = "text", language: str = "language") -> DataFrame:
    """(language, key, term, tf, length): one row per term of a chunk. The outer explode keeps Catalyst from repeating the tokenizer in a filter before it."""
    terms = chunks.select(F.col(language), F.col(key), X.tokens(X.nfc(F.col(text)), F.col(language)).alias("terms"))
    rows = terms.select(language, key, F.size("terms").alias("length"), F.explode_outer("terms").alias("term")).where("term IS NOT NULL")
    # one partitioning by term serves the count of a term in a chunk, document frequencies and the search
    return spread(rows, language, "term").groupBy(language, key, "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def term_statistics(post: DataFrame, language: str = "language") -> DataFrame:
    """(language, term, df, idf) with n chunks that hold a term."""
    n = chunk_statistics(post, language)
    df = post.groupBy(language, "term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.lit(0.0), F.log((F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))
    return df.join(F.broadcast(n), language).select(language, "term", "df", idf.alias("idf"))


def chunk_statistics(post: DataFrame, language: str = "language") -> DataFrame:
    """(language, n_chunks, avg_length): a few rows, one per language."""
    each = post.groupBy(language, "chunk_id").agg(F.first("length").alias("length"))
    return each.groupBy(language).agg(F.count("*").alias("n_chunks"), F.avg("length").alias("avg_length"))


def same_language(chunks: DataFrame, language: str, column: str = "language") -> DataFrame:
    """chunks, refused when they are read if one of them is not of the index's language; unlabelled ones are."""
    wrong = F.coalesce(F.col(column) != language, F.lit(True))
    return chunks.withColumn(column, F.when(wrong, F.raise_error(F.concat(F.lit(f"index of {language} was given "), F.coalesce(column, F.lit("NULL"))))).otherwise(F.col(column)))


def bm25_terms(queries: DataFrame, post: DataFrame, query: str = "query_id", language: str = "language", k1: float = L.BM25_K1, b: float = L.BM25_B) -> DataFrame:
    """(query, chunk_id, term, contribution): what each distinct query term adds to a chunk's score; queries meet chunks of their language only.

    queries has (query, language, terms ARRAY). The join is on (language, term): a term of many chunks is spread over
    tasks by AQE's skew split of the postings side.
    """
    wanted = queries.select(query, language, F.explode_outer(F.array_distinct("terms")).alias("term")).where("term IS NOT NULL")
    stats = chunk_statistics(post, language)
    # weights meet the few query terms before those meet the many postings
    weighted = wanted.join(term_statistics(post, language), [language, "term"]).join(F.broadcast(stats), language)
    hits = weighted.join(post, [language, "term"])
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avg_length")))
    return hits.select(query, "chunk_id", "term", part.alias("contribution")).where("contribution > 0")


def bm25_weights(post: DataFrame, language: str = "language", k1: float = L.BM25_K1, b: float = L.BM25_B) -> DataFrame:
    """(language, term, chunk_id, w): what a term adds to a chunk's score, above 0."""
    rows = post.join(F.broadcast(chunk_statistics(post, language)), language).join(term_statistics(post, language), [language, "term"])
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avg_length")))
    return rows.select(language, "term", "chunk_id", part.alias("w")).where("w > 0")


def _dealt(left: DataFrame, left_key: str, right: DataFrame, right_key: str, left_rows: int, right_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with block numbers `qb` and `vb`, so that every row meets every row of the other side in one pair of blocks: rows are dealt by hash into blocks of about the given sizes and copied once for each block of the other side."""
    n_left, n_right = left.count(), right.count()
    lefts, rights = max(1, -(-n_left // left_rows)), max(1, -(-n_right // right_rows), min(left.sparkSession.sparkContext.defaultParallelism, n_right // 256))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    left = left.select("*", block(left_key, lefts).alias("qb"), numbers(rights).alias("vb"))
    right = right.select("*", numbers(lefts).alias("qb"), block(right_key, rights).alias("vb"))
    return spread(left, "qb", "vb"), spread(right, "qb", "vb")


def bm25_top(queries: DataFrame, post: DataFrame, k: int = 5, query: str = "query_id", language: str = "language", query_block: int = 2048, chunk_block: int = 8192) -> DataFrame:
    """(query, chunk_id, score, place): the k best chunks, equal scores (to 8 places) in the order of their ids.

    Every query is scored against every chunk of its language. Queries and chunks meet in pairs of blocks, a chunk with its
    terms as one row; a task adds up a query's terms over a block of chunks in numpy and keeps k of them, so the pairs of
    query terms and postings are never rows and only k chunks a query and block are shuffled. Terms meet by 64-bit hashes.
    """
    term = lambda t: F.xxhash64(F.col(language), t)
    weights = bm25_weights(post, language).groupBy("chunk_id").agg(F.collect_list(F.struct(term(F.col("term")).alias("h"), "w")).alias("t"))
    chunks = written(weights.select("chunk_id", F.transform("t", lambda x: x["h"]).alias("hs"), F.transform("t", lambda x: x["w"]).alias("ws")))
    asked = queries.where(F.size("terms") > 0).select(F.col(query).alias("_q"), F.transform(F.array_distinct("terms"), term).alias("qs"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            right = right.sort_values("chunk_id")
            ids, sizes = right["chunk_id"].to_numpy(), right["hs"].map(len).to_numpy()
            h, w, c = np.concatenate(right["hs"].to_list()), np.concatenate(right["ws"].to_list()), np.repeat(np.arange(len(ids)), sizes)
            order = np.argsort(h, kind="stable")
            known, start = np.unique(h[order], return_index=True)
            w, c, end = w[order], c[order], np.append(start[1:], len(h))
            for q, terms in zip(left["_q"], left["qs"]):
                at = np.searchsorted(known, terms)
                at = at[(at < len(known)) & (known[np.minimum(at, len(known) - 1)] == terms)]
                if not len(at):
                    continue
                rows = np.concatenate([np.arange(start[i], end[i]) for i in at])
                s = np.round(np.bincount(c[rows], weights=w[rows], minlength=len(ids)), 8)
                least = max(np.partition(s, len(s) - min(k, len(s)))[len(s) - min(k, len(s))], 1e-8)
                best = np.flatnonzero(s >= least)
                best = best[np.lexsort((best, -s[best]))][:k]
                out.append(pd.DataFrame({query: q, "chunk_id": ids[best], "score": s[best]}))
        return pd.concat(out) if out else pd.DataFrame({query: [], "chunk_id": [], "score": []})

    left, right = _dealt(asked, "_q", chunks, "chunk_id", query_block, chunk_block)
    met = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInPandas(search, f"{query} {dict(queries.dtypes)[query]}, chunk_id string, score double")
    return top_k(met, [query], [F.desc("score"), F.col("chunk_id")], k)


def bm25_parts(queries: DataFrame, post: DataFrame, pairs: DataFrame, query: str = "query_id", language: str = "language") -> DataFrame:
    """(query, chunk_id, term, contribution): what each term of a query adds to the score of the chunks that it is paired with; only their postings are read."""
    asked = queries.select(query, language, F.explode_outer(F.array_distinct("terms")).alias("term")).where("term IS NOT NULL").join(pairs.select(query, "chunk_id"), query)
    near = post.join(pairs.select("chunk_id").distinct(), "chunk_id", "left_semi")
    weights = near.join(F.broadcast(chunk_statistics(post, language)), language).join(term_statistics(post, language), [language, "term"])
    part = F.col("idf") * F.col("tf") * (L.BM25_K1 + 1) / (F.col("tf") + L.BM25_K1 * (1 - L.BM25_B + L.BM25_B * F.col("length") / F.col("avg_length")))
    rows = weights.select(language, "term", "chunk_id", part.alias("contribution")).where("contribution > 0")
    return asked.join(rows, [language, "term", "chunk_id"]).select(query, "chunk_id", "term", "contribution")


def dense_top(queries: DataFrame, vectors: DataFrame, k: int = 5, threshold: float | None = 0.30, query: str = "query_id", key: str = "vec_id", vector: str = "embedding", block: int = 8192) -> DataFrame:
    """(query, key, score, place): the k nearest vectors by inner product, then those below the threshold dropped.

    Every query is compared with every vector. Both sides are dealt by hash into blocks of about `block` rows and each pair of
    blocks meets by equi-join in one task, which multiplies them and keeps k per query; the partial lists are merged by a
    group limit. So a row is copied once for each block of the other side, and nothing passes through the driver. NULL
    vectors are left out; vectors of different lengths or with numbers that are not finite are an error.
    """
    q = queries.where(F.col(vector).isNotNull()).select(F.col(query).alias("_q"), F.col(vector).alias("_x"))
    v = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("_v"), F.col(vector).alias("_y"))
    q, v = _dealt(q, "_q", v, "_v", block, block)

    def matrix(column: pd.Series) -> np.ndarray:
        rows = column.to_list()
        if len({len(r) for r in rows}) > 1:
            raise ValueError("vectors of different lengths")
        m = np.array(rows, dtype=np.float64)
        if not np.isfinite(m).all():
            raise ValueError("vectors must be finite")
        return m

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            x, y, ids, keys = matrix(left["_x"]), matrix(right["_y"]), left["_q"].to_numpy(), right["_v"].to_numpy()
            if x.shape[1] != y.shape[1]:
                raise ValueError("vectors of different lengths")
            kk = min(k, len(keys))
            for a in range(0, len(x), 256):
                s = np.round(x[a : a + 256] @ y.T, 6)
                least = np.partition(s, len(keys) - kk, axis=1)[:, len(keys) - kk]
                row, col = np.nonzero(s >= least[:, None])
                score = s[row, col]
                order = np.lexsort((keys[col], -score, row))
                row, col, score = row[order], col[order], score[order]
                kept = np.arange(len(row)) - np.searchsorted(row, row) < kk
                out.append(pd.DataFrame({query: ids[a + row[kept]], key: keys[col[kept]], "score": score[kept]}))
        return pd.concat(out) if out else pd.DataFrame({query: [], key: [], "score": []})

    schema = f"{query} {dict(queries.dtypes)[query]}, {key} {dict(vectors.dtypes)[key]}, score double"
    met = q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInPandas(search, schema)
    best = top_k(met, [query], [F.desc("score"), F.col(key)], k)
    return best if threshold is None else best.where(F.col("score") >= threshold)


def term_vectors(rows: DataFrame, key: str, terms: str, vector: str = "embedding", dims: int = 64) -> DataFrame:
    """(key, vector): the terms of a row counted in `dims` cells by a signed hash, as a vector of length 1; rows without terms give none.

    Stands in for an embedding model where there is none: any table (key, vector) does as well in dense_top().
    """
    digest = F.md5("_t")
    cell = F.conv(F.substring(digest, 1, 6), 16, 10).cast("long") % dims
    sign = F.when(F.substring(digest, 7, 1) < "8", 1).otherwise(-1)
    cells = rows.select(key, F.explode(terms).alias("_t")).groupBy(key, cell.alias("_cell")).agg(F.sum(sign).alias("_n"))
    by = cells.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_cell", F.col("_n").cast("double")))).alias("_m"), F.sqrt(F.sum(F.col("_n") * F.col("_n"))).alias("_len"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("_m", i.cast("long")), F.lit(0.0)) / F.col("_len"))
    return by.where("_len > 0").select(key, filled.alias(vector))


def fuse(rankings: DataFrame, query: str = "query_id", item: str = "chunk_id", k: int = L.RRF_K, lists: str = "list_no", place: str = "place", weight: str | None = None, top: int | None = None) -> DataFrame:
    """(query, item, fused, place), the `top` best or all: reciprocal rank fusion, scaled so that first place in every list gives 1.

    rankings has one row per entry of a list, places from 0. Equal scores stay in the order of first appearance: list,
    then place. Only lists with entries count. Sums are combined map-side, so a query with very many lists is no hot task.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    sums = rankings.groupBy(query, item).agg(F.sum(w / (k + 1 + F.col(place))).alias("_sum"), F.min(F.struct(lists, place)).alias("_seen"))
    most = rankings.groupBy(query, lists).agg(F.first(w).alias("_w")).groupBy(query).agg((F.sum("_w") / (k + 1)).alias("_most"))
    scored = sums.join(most, query).withColumn("fused", F.round(F.col("_sum") / F.col("_most"), 10))
    order = [F.desc("fused"), F.col("_seen"), F.col(item)]
    if top is not None:
        return top_k(scored, [query], order, top).select(query, item, "fused", "place")
    return scored.withColumn("place", F.row_number().over(W.partitionBy(query).orderBy(*order)) - 1).select(query, item, "fused", "place")


def hybrid(lexical: DataFrame, dense: DataFrame, k: int = 5, query: str = "query_id", item: str = "chunk_id", weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(query, item, lexical, dense, fused, place): the vector list and the lexical list fused, in this order, the k best kept with the score each list gave (0 where it gave none).

    weights: of the vector and of the lexical list. A list without entries for a query takes its weight out of the scale.
    """
    side = lambda df, no: df.select(query, item, F.lit(no).alias("list_no"), "place", "score", F.lit(float(weights[no])).alias("_weight"))
    both = written(side(dense, 0).unionByName(side(lexical, 1)))
    given = both.groupBy(query, item).agg(F.coalesce(F.max(F.when(F.col("list_no") == 1, F.col("score"))), F.lit(0.0)).alias("lexical"), F.coalesce(F.max(F.when(F.col("list_no") == 0, F.col("score"))), F.lit(0.0)).alias("dense"))
    return fuse(both, query, item, weight="_weight", top=k).join(given, [query, item])


def rerank(ranked: DataFrame, scores: DataFrame, query: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """ranked with `rerank` and new places by it; items without a score keep their fused one, equal scores their order."""
    both = ranked.join(scores.select(query, item, "rerank"), [query, item], "left").withColumn("_score", F.coalesce("rerank", "fused"))
    return both.withColumn("place", F.row_number().over(W.partitionBy(query).orderBy(F.desc("_score"), "place")) - 1).drop("_score")


def signals(ranked: DataFrame, query: str = "query_id", score: str = "score") -> DataFrame:
    """(query, top, margin, mean, n) of a ranking; the margin of a single entry is 0."""
    first, second = F.max(F.when(F.col("place") == 0, F.col(score))), F.max(F.when(F.col("place") == 1, F.col(score)))
    return ranked.groupBy(query).agg(first.alias("s1_top_score"), F.coalesce(first - second, F.lit(0.0)).alias("s1_score_margin"), F.avg(score).alias("s1_mean_score"), F.count("*").alias("s1_n_chunks"))


def unit_interval(score: Column, batch: list[str]) -> Column:
    """Scores of a batch as they are if all lie in [0, 1], else all through the logistic function."""
    w = W.partitionBy(*batch)
    inside = (F.min(score).over(w) >= 0) & (F.max(score).over(w) <= 1)
    return F.when(inside, score).otherwise(1 / (1 + F.exp(-score)))


def fuse_variants(results: DataFrame, variants: DataFrame, k: int = 5, query: str = "query_id", item: str = "chunk_id", c: int = L.RRF_K) -> DataFrame:
    """(query, item, fused, score, place) of the results of several variants of a query.

    results: (query, variant, item, score, place); variants: (query, variant), also those that found nothing, as they count
    in the scale. Each item keeps its best score over the variants; equal sums stay in the order of first appearance.
    """
    n = variants.groupBy(query).agg(F.count_distinct("variant").alias("_n"))
    sums = results.groupBy(query, item).agg(F.sum(1.0 / (c + 1 + F.col("place"))).alias("_s"), F.max("score").alias("score"), F.min(F.struct("variant", "place")).alias("_seen"))
    scored = sums.join(n, query).withColumn("fused", F.round(F.col("_s") / (F.col("_n") / (c + 1)), 10))
    return top_k(scored, [query], [F.desc("fused"), F.col("_seen"), F.col(item)], k).select(query, item, "fused", "score", "place")


def route(language: Column, wanted: Column, available: list[str], fallback: str = "en") -> Column:
    """The index that a query goes to: the wanted one, else that of its language, else the fallback; an error if none is there."""
    to = F.coalesce(wanted, language)
    other = F.lit(fallback) if fallback in available else F.raise_error(F.concat(F.lit("no index for "), F.coalesce(to, F.lit("NULL")))).cast("string")
    return F.when(to.isin(*available), to).otherwise(other)


def needs_native_variant(language: Column, script: Column) -> Column:
    return language.isin("hi", "ta") & (script == "roman")


def accepted_variant(variant: Column, language: Column, query: Column, translated: bool = False) -> Column:
    """Whether a transliterated or translated query counts: in the script of its language, of 500 characters at most, a translation no longer than twice the query and 200."""
    own = F.when(language == "hi", variant.rlike(L.DEVANAGARI) & ~variant.rlike(L.TAMIL)).when(language == "ta", variant.rlike(L.TAMIL) & ~variant.rlike(L.DEVANAGARI)).otherwise(~variant.rlike(L.DEVANAGARI) & ~variant.rlike(L.TAMIL))
    short = F.length(variant) <= (2 * F.length(query) + 200 if translated else 500)
    return F.coalesce((F.trim(variant) != "") & own & short, F.lit(False))
