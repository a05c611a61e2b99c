"""The registered queries of the core and their SQL counterparts. Each reads whole tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import labels as B
from ..functions import lexicon as L
from ..functions import sql as S
from ..functions import text as X
from ..operators import chunking, claims, confidence, correction, evaluation, retrieval, review
from ..operators.ranking import fill_cores, nearest_ranks, spread, top_k
from ..session import written

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table whose texts the query works hard on."""
    return fill_cores(read(spark, sf_dir, name).select(*columns))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, text, language): each chunk once, re-delivered rows collapsed; the language is that of the label, else of the id."""
    rows = spread(read(spark, sf_dir, "chunks").where("chunk_id IS NOT NULL AND trim(text) <> ''").select("chunk_id", "text", "language"), "chunk_id")
    named = F.coalesce(F.max(B.language_label(F.col("language"))), F.split("chunk_id", "/")[0])
    return rows.groupBy("chunk_id").agg(F.min("text").alias("text"), named.alias("language"))



CORPUS = f"corpus AS (SELECT chunk_id, min(text) AS text, coalesce(max({S.language_label('language')}), split_part(chunk_id, '/', 1)) AS language FROM chunks WHERE chunk_id IS NOT NULL AND trim(coalesce(text, '')) <> '' GROUP BY chunk_id)"


def corpus_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of the corpus, written once for the several reads of a search."""
    return written(retrieval.postings(corpus(spark, sf_dir)))


QUERY_SET = 20  # searches take every row whose id is divisible by this as a query


# ---------------------------------------------------------------- text functions

@query(f"SELECT doc_id, md5({S.normalize('text')}) AS text_md5, length({S.normalize('text')}) AS n_chars FROM documents WHERE text IS NOT NULL")
def text_normalize(spark, d):
    t = X.normalize(F.col("text"))
    return texts(spark, d, "documents", "doc_id", "text").where("text IS NOT NULL").select("doc_id", t.alias("t")).select("doc_id", F.md5("t").alias("text_md5"), F.length("t").cast("long").alias("n_chars"))


@query("SELECT row_id, md5(regexp_replace(question, '[^\\P{P}''-]', '', 'g')) AS text_md5 FROM questions WHERE question IS NOT NULL")
def punctuation_stripped(spark, d):
    return read(spark, d, "questions").where("question IS NOT NULL").select("row_id", F.md5(X.strip_punctuation(F.col("question"))).alias("text_md5"))


@query(f"""
WITH c AS (SELECT doc_id, {S.count('text', S.DEVA)} AS devanagari, {S.count('text', S.TAML)} AS tamil, {S.count('text', S.LATN)} AS latin, {S.count('text', S.OTHER)} AS other_indic FROM documents WHERE text IS NOT NULL)
SELECT *, {S.detect_script('devanagari', 'tamil', 'latin')} AS script FROM c""")
def script_counts(spark, d):
    counts = [c.cast("long").alias(n) for n, c in X.script_counts(F.col("text")).items()]
    return texts(spark, d, "documents", "doc_id", "text").where("text IS NOT NULL").select("doc_id", *counts, X.detect_script(F.col("text")).alias("script"))


def _detect_sql(table: str, key: str, col: str) -> str:
    hi, ta = S._list(sorted(L.ROMAN_HINDI)), S._list(sorted(L.ROMAN_TAMIL))
    return f"""
WITH t AS (SELECT {key}, {S.normalize(col)} AS x FROM {table} WHERE {col} IS NOT NULL),
c AS (SELECT {key}, x, {S.count('x', S.DEVA)} AS d, {S.count('x', S.TAML)} AS m, {S.count('x', S.LATN)} AS l, regexp_extract_all(lower(x), '[a-z]+') AS w FROM t),
h AS (SELECT *, {S.detect_script('d', 'm', 'l')} AS script, len(w) AS n, len(list_filter(w, lambda v: list_contains({hi}, v))) AS hi, len(list_filter(w, lambda v: list_contains({ta}, v))) AS ta FROM c),
r AS (SELECT *, greatest(hi, ta)::DOUBLE / greatest(n, 1) AS ratio, greatest(hi, ta) >= 2 AND greatest(hi, ta)::DOUBLE / greatest(n, 1) >= 0.15 AS roman FROM h)
SELECT {key}, CASE WHEN x = '' THEN 'en' WHEN d + m > 0 AND m > d THEN 'ta' WHEN d + m > 0 THEN 'hi' WHEN n < 3 THEN 'en' WHEN roman AND hi >= ta THEN 'hi' WHEN roman THEN 'ta' ELSE 'en' END AS language,
round(CASE WHEN x = '' THEN 0 WHEN d + m > 0 THEN least(0.99::DOUBLE, 0.75::DOUBLE + 0.24::DOUBLE * (greatest(d, m)::DOUBLE / (d + m))) * CASE WHEN script = 'mixed' THEN 0.9::DOUBLE ELSE 1 END WHEN n < 3 THEN 0.25 WHEN roman THEN least(0.8::DOUBLE, 0.45::DOUBLE + ratio) WHEN n >= 5 THEN 0.85 ELSE 0.6 END::DOUBLE, 6) AS confidence,
CASE WHEN x = '' THEN 'roman' ELSE script END AS script FROM r"""


@query(_detect_sql("questions", "row_id", "question"))
def detect_language(spark, d):
    rows = texts(spark, d, "questions", "row_id", "question").where("question IS NOT NULL").select("row_id", X.normalize(F.col("question")).alias("t"))
    rows = rows.select("row_id", X.detect_language(F.col("t")).alias("x"))
    return rows.select("row_id", "x.language", F.round("x.confidence", 6).alias("confidence"), "x.script")


@query(f"SELECT doc_id, {S.estimate_tokens('text', 'lang')} AS est_tokens FROM documents WHERE text IS NOT NULL")
def estimate_tokens(spark, d):
    return read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", X.estimate_tokens(F.col("text"), F.col("lang")).alias("est_tokens"))


_QLANG = S.language_label("language")


@query(f"""
WITH q AS (SELECT row_id, nfc_normalize(question) AS t, {_QLANG} AS lang FROM questions WHERE question IS NOT NULL), k AS (SELECT row_id, {S.tokens('t', 'lang')} AS toks FROM q)
SELECT row_id, len(toks) AS n_tokens, md5(array_to_string(toks, ' ')) AS tokens_md5 FROM k""")
def tokenize_terms(spark, d):
    rows = texts(spark, d, "questions", "row_id", "question", "language").where("question IS NOT NULL").select("row_id", X.tokens(X.nfc(F.col("question")), B.language_label(F.col("language"))).alias("t"))
    return rows.select("row_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query(f"""
WITH s AS (SELECT doc_id, {S.sentences(S.normalize('text'))} AS s FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(s) AS n_sentences, md5(array_to_string(s, chr(10))) AS sentences_md5 FROM s""")
def sentence_split(spark, d):
    rows = texts(spark, d, "documents", "doc_id", "text").where("text IS NOT NULL").select("doc_id", X.normalize(F.col("text")).alias("t")).select("doc_id", X.sentences(F.col("t")).alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "\n")).alias("sentences_md5"))


def _foreign_sql(table: str, key: str, col: str) -> str:
    """By Unicode ranges instead of names: what stands for letters and marks of each script in the test tables."""
    kinds = {"DEVANAGARI": "\u0900-\u0963\u0971-\u097f", "TAMIL": "\u0b80-\u0be5", "CYRILLIC": "\u0400-\u0481\u0483-\u0487\u048a-\u052f", "GREEK": "\u0370-\u0373\u0376\u0377\u037b-\u037d\u037f\u0386\u0388-\u03ff", "FULLWIDTH": "\uff21-\uff3a\uff41-\uff5a"}
    own = "CASE lang WHEN 'hi' THEN 'DEVANAGARI' WHEN 'ta' THEN 'TAMIL' ELSE 'LATIN' END"
    counts = " UNION ALL ".join(f"SELECT {key}, own, '{k}' AS script, length({col}) - length(regexp_replace({col}, '[{r}]', '', 'g')) AS n FROM r" for k, r in kinds.items())
    latin = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
    parts = "[\\s\\p{Z}\\x85\\-\u2010\u2011\u2013\u2014/(),.;:!?\u0964\"''\u2018\u2019\u201c\u201d]+"
    mixed = " UNION ALL ".join(f"SELECT {key}, own, 'MIXED_WORD' AS script, len(list_filter(regexp_split_to_array({col}, '{parts}'), lambda w: regexp_matches(w, '[{kinds[k]}]') AND regexp_matches(w, '[{latin}]'))) AS n FROM r WHERE own = '{k}'" for k in ("DEVANAGARI", "TAMIL"))
    return f"WITH r AS (SELECT {key}, {col}, {own} AS own FROM (SELECT {key}, {col}, {S.language_label('language')} AS lang FROM {table} WHERE {col} IS NOT NULL)), c AS ({counts} UNION ALL {mixed}) SELECT {key}, script, n FROM c WHERE n > 0 AND script <> own"


def _foreign(spark, d, table: str, key: str, col: str) -> DataFrame:
    rows = texts(spark, d, table, key, col, "language").where(F.col(col).isNotNull())
    found = X.foreign_scripts(F.col(col), B.language_label(F.col("language")))
    return rows.select(key, F.explode_outer(found).alias("x")).where("x IS NOT NULL").select(key, "x.script", F.col("x.n").cast("long").alias("n"))


@query(_foreign_sql("questions", "row_id", "question"))
def foreign_scripts(spark, d):
    """Letters of each question by script that its language does not use, and its words of two scripts."""
    return _foreign(spark, d, "questions", "row_id", "question")


@query(_foreign_sql("records", "record_id", "answer"))
def foreign_answers(spark, d):
    """The same of answers, which are to be in the language asked for."""
    return _foreign(spark, d, "records", "record_id", "answer")


@query("SELECT row_id, sha256('{\"q\":\"' || qid || '\",\"v\":' || row_id::VARCHAR || '}') AS fingerprint FROM questions WHERE qid IS NOT NULL")
def fingerprint(spark, d):
    return read(spark, d, "questions").where("qid IS NOT NULL").select("row_id", X.fingerprint(F.col("qid").alias("q"), F.col("row_id").alias("v")).alias("fingerprint"))


@query("""
WITH p AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), hit AS (
""" + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS pattern FROM p WHERE regexp_matches(text, '{p}')" for n, p in L.SECRETS.items()) + """)
SELECT (SELECT count(*) FROM p) AS documents_scanned, (SELECT count(DISTINCT doc_id) FROM hit) AS documents_with_secrets, (SELECT count(*) FROM hit) AS findings""")
def secret_scan(spark, d):
    """Credential patterns over all documents."""
    rows = read(spark, d, "documents").where("text IS NOT NULL").select(F.size(X.secrets(F.col("text"))).alias("n"))
    return rows.agg(F.count("*").alias("documents_scanned"), F.count_if(F.col("n") > 0).alias("documents_with_secrets"), F.coalesce(F.sum(F.col("n").cast("long")), F.lit(0)).alias("findings"))


@query("""
WITH t AS (SELECT r.record_id, list_distinct(list_filter(regexp_split_to_array(lower(r.answer), '\\s+'), lambda w: w <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(q.gold), '\\s+'), lambda w: w <> '')) AS b
 FROM records r JOIN (SELECT qid, max(gold_answer) AS gold FROM questions WHERE trim(coalesce(gold_answer, '')) <> '' GROUP BY qid) q USING (qid) WHERE r.answer IS NOT NULL)
SELECT record_id, round(CASE WHEN len(list_distinct(list_concat(a, b))) > 0 THEN len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) ELSE 1 END, 6) AS consistency FROM t""")
def answer_consistency(spark, d):
    """Self-consistency of an answer and the reference answer as two samples."""
    gold = read(spark, d, "questions").where("trim(gold_answer) <> ''").groupBy("qid").agg(F.max("gold_answer").alias("gold"))
    rows = texts(spark, d, "records", "record_id", "qid", "answer").where("answer IS NOT NULL").join(gold, "qid")
    return rows.select("record_id", F.round(X.self_consistency(F.array("answer", "gold")), 6).alias("consistency"))


# ---------------------------------------------------------------- chunks and retrieval

@query()
def chunk_documents(spark, d):
    out = chunking.chunk_documents(texts(spark, d, "documents", "doc_id", "text", "lang"))
    return out.select("chunk_id", "doc_id", "chunk_index", "n_chunks", "est_tokens", F.md5("text").alias("text_md5"))


@query()
def chunk_stats(spark, d):
    out = chunking.chunk_documents(texts(spark, d, "documents", "doc_id", "text", "lang"))
    return out.groupBy("language").agg(F.count("*").alias("chunks"), F.avg("est_tokens").alias("mean_tokens"), F.max("est_tokens").alias("most_tokens"), F.count_if(F.col("est_tokens") < 25).alias("small"))


@query(f"""
WITH {CORPUS}, e AS (SELECT language, {S.estimate_tokens('text', 'language')} AS est FROM corpus) SELECT language, count(*) AS chunks, round(avg(est), 6) AS mean_tokens, max(est) AS most_tokens, count(*) FILTER (est < 25) AS small FROM e GROUP BY language""")
def corpus_stats(spark, d):
    """Sizes of the given chunks by language."""
    rows = corpus(spark, d).select("language", X.estimate_tokens(F.col("text"), F.col("language")).alias("est"))
    return rows.groupBy("language").agg(F.count("*").alias("chunks"), F.round(F.avg("est"), 6).alias("mean_tokens"), F.max("est").alias("most_tokens"), F.count_if(F.col("est") < 25).alias("small"))


_POST = f"""{CORPUS}, tk AS (SELECT chunk_id, language, {S.tokens('nfc_normalize(text)', 'language')} AS toks FROM corpus),
post AS (SELECT language, chunk_id, term, count(*) AS tf, any_value(length) AS length FROM (SELECT language, chunk_id, len(toks) AS length, unnest(toks) AS term FROM tk) GROUP BY ALL),
cs AS (SELECT language, count(*) AS n, avg(length) AS avg_length FROM (SELECT DISTINCT language, chunk_id, length FROM post) GROUP BY language),
idf AS (SELECT language, term, count(*) AS df, greatest(0, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1)) AS idf FROM post JOIN cs USING (language) GROUP BY ALL)"""


@query(f"WITH {_POST} SELECT language, term, df, round(idf, 6) AS idf FROM idf")
def idf_table(spark, d):
    post = corpus_postings(spark, d)
    return retrieval.term_statistics(post).select("language", "term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_POST} SELECT language, n AS n_chunks, round(avg_length, 6) AS avg_length, (SELECT count(*) FROM idf i WHERE i.language = cs.language) AS terms FROM cs")
def index_stats(spark, d):
    post = corpus_postings(spark, d)
    terms = post.groupBy("language").agg(F.count_distinct("term").alias("terms"))
    return retrieval.chunk_statistics(post).join(terms, "language").select("language", "n_chunks", F.round("avg_length", 6).alias("avg_length"), "terms")


def question_queries(spark, d) -> DataFrame:
    """(query_id, language, terms) of the query set: questions routed to the index of their language, English where none is named."""
    rows = read(spark, d, "questions").where(f"row_id % {QUERY_SET} = 0 AND question IS NOT NULL")
    lang = B.language_label(F.col("language"))
    lang = F.when(lang.isin("en", "hi", "ta"), lang).otherwise("en")
    return spread(rows.select(F.col("row_id").alias("query_id"), lang.alias("language"), F.col("question")), "query_id").withColumn("terms", X.tokens(X.nfc(F.col("question")), F.col("language"))).drop("question")


def _bm25_sql(extra: str = "") -> str:
    lang = f"CASE WHEN {_QLANG} IN ('en', 'hi', 'ta') THEN {_QLANG} ELSE 'en' END"
    return f"""WITH {_POST}, q AS (SELECT row_id AS query_id, language, unnest(list_distinct({S.tokens('t', 'language')})) AS term FROM (SELECT row_id, nfc_normalize(question) AS t, {lang} AS language FROM questions WHERE row_id % {QUERY_SET} = 0 AND question IS NOT NULL)),
part AS (SELECT query_id, chunk_id, term, idf * tf * {L.BM25_K1 + 1} / (tf + {L.BM25_K1}::DOUBLE * (1 - {L.BM25_B}::DOUBLE + {L.BM25_B}::DOUBLE * length / avg_length)) AS contribution FROM q JOIN post USING (language, term) JOIN idf USING (language, term) JOIN cs USING (language)),
sc AS (SELECT query_id, chunk_id, round(sum(contribution), 8) AS score FROM part WHERE contribution > 0 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS place FROM sc), top AS (SELECT * FROM ranked WHERE place < 5){extra}"""


@query(_bm25_sql() + " SELECT query_id, chunk_id, score, place FROM top")
def bm25_topk(spark, d):
    out = retrieval.bm25_top(question_queries(spark, d), corpus_postings(spark, d))
    return out.select("query_id", "chunk_id", "score", F.col("place").cast("long").alias("place"))


@query(_bm25_sql() + " SELECT query_id, chunk_id, term, round(contribution, 6) AS contribution FROM part JOIN top USING (query_id, chunk_id) WHERE place = 0")
def bm25_explain(spark, d):
    """What each term adds to the best chunk of a query."""
    q, post = question_queries(spark, d), corpus_postings(spark, d)
    best = retrieval.bm25_top(q, post, 1).select("query_id", "chunk_id")
    return retrieval.bm25_parts(q, post, written(best)).select("query_id", "chunk_id", "term", F.round("contribution", 6).alias("contribution"))


@query(_bm25_sql() + """ SELECT query_id, max(CASE WHEN place = 0 THEN score END) AS s1_top_score, round(coalesce(max(CASE WHEN place = 0 THEN score END) - max(CASE WHEN place = 1 THEN score END), 0), 8) AS s1_score_margin,
round(avg(score), 6) AS s1_mean_score, count(*) AS s1_n_chunks FROM top GROUP BY query_id""")
def s1_signals(spark, d):
    out = retrieval.signals(retrieval.bm25_top(question_queries(spark, d), corpus_postings(spark, d)))
    return out.select("query_id", "s1_top_score", F.round("s1_score_margin", 8).alias("s1_score_margin"), F.round("s1_mean_score", 6).alias("s1_mean_score"), "s1_n_chunks")


_DENSE = f"""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % {QUERY_SET} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS place FROM s)"""


@query(_DENSE + " SELECT query_id, vec_id, score, place FROM r WHERE place < 5 AND score >= 0.30")
def dense_topk(spark, d):
    v = read(spark, d, "embeddings").select("vec_id", "embedding")
    q = v.where(f"vec_id % {QUERY_SET} = 0").withColumnRenamed("vec_id", "query_id")
    return retrieval.dense_top(q, v).select("query_id", "vec_id", "score", F.col("place").cast("long").alias("place"))


_LISTS = """WITH l AS (SELECT qid AS query_id, record_id AS list_no, unnest(retrieved_chunk_ids) AS chunk_id, generate_subscripts(retrieved_chunk_ids, 1) - 1 AS place FROM records WHERE qid IS NOT NULL AND error_text IS NULL),
m AS (SELECT query_id, count(DISTINCT list_no) / 61.0::DOUBLE AS most FROM l GROUP BY query_id),
f AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (61 + place)) / any_value(most), 10) AS fused, min({'a': list_no, 'b': place}) AS seen FROM l JOIN m USING (query_id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, seen, chunk_id) - 1 AS place FROM f)"""


def record_rankings(spark, d) -> DataFrame:
    rows = read(spark, d, "records").where("qid IS NOT NULL AND error_text IS NULL")
    return rows.select(F.col("qid").alias("query_id"), F.col("record_id").alias("list_no"), F.posexplode("retrieved_chunk_ids").alias("place", "chunk_id"))


@query(_LISTS + " SELECT query_id, chunk_id, fused, place FROM r WHERE place < 5")
def rrf_fuse(spark, d):
    """The rankings that all runs of a question retrieved, fused."""
    return retrieval.fuse(record_rankings(spark, d), top=5).select("query_id", "chunk_id", "fused", F.col("place").cast("long").alias("place"))


def _variants(spark, d) -> tuple[DataFrame, DataFrame]:
    post = corpus_postings(spark, d)
    q = question_queries(spark, d)
    rows = read(spark, d, "questions").where(f"row_id % {QUERY_SET} = 0 AND trim(gold_answer) <> ''")
    lang = B.language_label(F.col("language"))
    v = spread(rows.select(F.col("row_id").alias("query_id"), F.when(lang.isin("en", "hi", "ta"), lang).otherwise("en").alias("language"), "gold_answer"), "query_id").withColumn("terms", X.tokens(X.nfc(F.col("gold_answer")), F.col("language"))).drop("gold_answer")
    return retrieval.bm25_top(q, post, 20), retrieval.bm25_top(v, post, 20)


def _variant_sql() -> str:
    one = _bm25_sql().replace("place < 5", "place < 20")
    lang = f"CASE WHEN {_QLANG} IN ('en', 'hi', 'ta') THEN {_QLANG} ELSE 'en' END"
    return one + f""", q2 AS (SELECT row_id AS query_id, language, unnest(list_distinct({S.tokens('t', 'language')})) AS term FROM (SELECT row_id, nfc_normalize(gold_answer) AS t, {lang} AS language FROM questions WHERE row_id % {QUERY_SET} = 0 AND trim(coalesce(gold_answer, '')) <> '')),
sc2 AS (SELECT query_id, chunk_id, round(sum(idf * tf * {L.BM25_K1 + 1} / (tf + {L.BM25_K1}::DOUBLE * (1 - {L.BM25_B}::DOUBLE + {L.BM25_B}::DOUBLE * length / avg_length))), 8) AS score FROM q2 JOIN post USING (language, term) JOIN idf USING (language, term) JOIN cs USING (language) WHERE idf > 0 GROUP BY ALL),
top2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS place FROM sc2) WHERE place < 20),
l AS (SELECT query_id, chunk_id, 0 AS list_no, place, score FROM top UNION ALL SELECT query_id, chunk_id, 1, place, score FROM top2),
m AS (SELECT query_id, count(DISTINCT list_no) / 61.0::DOUBLE AS most FROM l GROUP BY query_id),
f AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (61 + place)) / any_value(most), 10) AS fused, min({{'a': list_no, 'b': place}}) AS seen, coalesce(max(CASE WHEN list_no = 0 THEN score END), 0) AS lexical, coalesce(max(CASE WHEN list_no = 1 THEN score END), 0) AS dense FROM l JOIN m USING (query_id) GROUP BY ALL)
SELECT query_id, chunk_id, fused, lexical, dense AS variant, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, seen, chunk_id) - 1 AS place FROM f) WHERE place < 5"""


@query(_variant_sql())
def hybrid_topk(spark, d):
    """Two candidate lists of 20, of the question and of its reference answer as a variant, fused to five with both component scores."""
    a, b = _variants(spark, d)
    return retrieval.hybrid(b, a).select("query_id", "chunk_id", "fused", F.col("dense").alias("lexical"), F.col("lexical").alias("variant"), F.col("place").cast("long").alias("place"))


def _vectors_sql(table: str, key: str) -> str:
    cell = "CAST('0x' || substr(md5(t), 1, 6) AS BIGINT) % 64"
    return f"""{table}_c AS (SELECT {key} AS id, {cell} AS cell, sum(CASE WHEN substr(md5(t), 7, 1) < '8' THEN 1 ELSE -1 END) AS n FROM (SELECT {key}, unnest({table}_t) AS t FROM {table}_terms) GROUP BY ALL),
{table}_v AS (SELECT id, list_transform(range(0, 64), lambda i: coalesce(m[i], 0)::DOUBLE / len) AS v FROM (SELECT id, map_from_entries(list((cell, n))) AS m, sqrt(sum(n * n)::DOUBLE) AS len FROM {table}_c GROUP BY id) WHERE len > 0)"""


def _hybrid_sql() -> str:
    lang = f"CASE WHEN {_QLANG} IN ('en', 'hi', 'ta') THEN {_QLANG} ELSE 'en' END"
    return _bm25_sql().replace("place < 5", "place < 20") + f""", ch_terms AS (SELECT chunk_id, toks AS ch_t FROM tk), qu_terms AS (SELECT row_id AS query_id, {S.tokens('t', 'language')} AS qu_t FROM (SELECT row_id, nfc_normalize(question) AS t, {lang} AS language FROM questions WHERE row_id % {QUERY_SET} = 0 AND question IS NOT NULL)),
{_vectors_sql('ch', 'chunk_id')}, {_vectors_sql('qu', 'query_id')},
ds AS (SELECT qu_v.id AS query_id, ch_v.id AS chunk_id, round(list_inner_product(qu_v.v, ch_v.v), 6) AS score FROM qu_v, ch_v), dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS place FROM ds QUALIFY place < 20),
l AS (SELECT query_id, chunk_id, 0 AS list_no, place, score, 2.0::DOUBLE AS w FROM dr UNION ALL SELECT query_id, chunk_id, 1, place, score, 1.0::DOUBLE FROM top),
m AS (SELECT query_id, sum(w) / 61.0::DOUBLE AS most FROM (SELECT DISTINCT query_id, list_no, w FROM l) GROUP BY query_id),
f AS (SELECT query_id, chunk_id, round(sum(w / (61 + place)) / any_value(most), 10) AS fused, min({{'a': list_no, 'b': place}}) AS seen, coalesce(max(CASE WHEN list_no = 0 THEN score END), 0) AS dense, coalesce(max(CASE WHEN list_no = 1 THEN score END), 0) AS lexical FROM l JOIN m USING (query_id) GROUP BY ALL)
SELECT query_id, chunk_id, fused, dense, lexical, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, seen, chunk_id) - 1 AS place FROM f) WHERE place < 5"""


@query(_hybrid_sql())
def hybrid_search(spark, d):
    """Candidates of 20 by vectors (terms hashed into 64 cells) and of 20 by BM25, fused with the vectors at twice the weight; vectors know no language, BM25 stays in the query's own."""
    q = question_queries(spark, d)
    chunks = corpus(spark, d).select("chunk_id", X.tokens(X.nfc(F.col("text")), F.col("language")).alias("terms"))
    asked = retrieval.term_vectors(q, "query_id", "terms")
    dense = retrieval.dense_top(asked, written(retrieval.term_vectors(chunks, "chunk_id", "terms")), 20, None, key="chunk_id")
    out = retrieval.hybrid(retrieval.bm25_top(q, corpus_postings(spark, d), 20), dense, weights=(2.0, 1.0))
    return out.select("query_id", "chunk_id", "fused", "dense", "lexical", F.col("place").cast("long").alias("place"))


@query("""
WITH l AS (SELECT qid AS query_id, record_id AS list_no, unnest(retrieved_chunk_ids) AS chunk_id, generate_subscripts(retrieved_chunk_ids, 1) - 1 AS place FROM records WHERE qid IS NOT NULL AND error_text IS NULL),
m AS (SELECT query_id, count(DISTINCT list_no) / 61.0::DOUBLE AS most FROM l GROUP BY query_id),
f AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (61 + place)) / any_value(most), 10) AS fused, min({'a': list_no, 'b': place}) AS seen FROM l JOIN m USING (query_id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, seen, chunk_id) - 1 AS old FROM f QUALIFY old < 20),
g AS (SELECT qid AS query_id, chunk_id, count(*)::DOUBLE AS named FROM (SELECT qid, unnest(gold_chunk_ids) AS chunk_id FROM records WHERE qid IS NOT NULL) GROUP BY ALL)
SELECT query_id, chunk_id, fused, named AS rerank, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(named, fused) DESC, old) - 1 AS place FROM r LEFT JOIN g USING (query_id, chunk_id)""")
def reranked(spark, d):
    """The fused candidates of each question ranked anew by how many of its runs name a chunk as right; chunks that nobody names keep their fused score."""
    fused = retrieval.fuse(record_rankings(spark, d), top=20)
    named = read(spark, d, "records").where("qid IS NOT NULL").select(F.col("qid").alias("query_id"), F.explode("gold_chunk_ids").alias("chunk_id")).groupBy("query_id", "chunk_id").agg(F.count("*").cast("double").alias("rerank"))
    return retrieval.rerank(fused, named).select("query_id", "chunk_id", "fused", "rerank", F.col("place").cast("long").alias("place"))


@query(f"""
WITH q AS (SELECT row_id, {_QLANG} AS lang, nfc_normalize(question) AS question, gold_answer AS v FROM questions WHERE question IS NOT NULL),
c AS (SELECT *, regexp_matches(v, '[{chr(0x900)}-{chr(0x97f)}]') AS dev, regexp_matches(v, '[{chr(0xb80)}-{chr(0xbff)}]') AS tam FROM q)
SELECT row_id, CASE WHEN lang IN ('en', 'hi') THEN lang ELSE 'en' END AS index_name, coalesce(trim(v) <> '' AND CASE WHEN lang = 'hi' THEN dev AND NOT tam WHEN lang = 'ta' THEN tam AND NOT dev ELSE NOT dev AND NOT tam END AND length(v) <= 500, false) AS variant_accepted FROM c""")
def routed_variants(spark, d):
    """Where each question goes if only the English and Hindi indexes are there, and whether its reference answer could stand as a variant of it."""
    rows = texts(spark, d, "questions", "row_id", "language", "question", "gold_answer").where("question IS NOT NULL")
    lang = B.language_label(F.col("language"))
    return rows.select("row_id", retrieval.route(lang, F.lit(None).cast("string"), ["en", "hi"]).alias("index_name"), retrieval.accepted_variant(F.col("gold_answer"), lang, F.col("question")).alias("variant_accepted"))


@query("""
WITH b AS (SELECT qid, record_id, latency_ms, min(latency_ms) OVER (PARTITION BY qid) AS lo, max(latency_ms) OVER (PARTITION BY qid) AS hi FROM records WHERE qid IS NOT NULL AND latency_ms IS NOT NULL)
SELECT record_id, round(CASE WHEN lo >= 0 AND hi <= 1 THEN latency_ms ELSE 1 / (1 + exp(-latency_ms / 1000)) END, 6) AS unit_score FROM (SELECT qid, record_id, latency_ms, lo / 1000 AS lo, hi / 1000 AS hi FROM b) WHERE NOT (lo >= 0 AND hi <= 1)
UNION ALL SELECT record_id, round(latency_ms / 1000, 6) FROM b WHERE lo / 1000 >= 0 AND hi / 1000 <= 1""")
def unit_scores(spark, d):
    """Raw scores of a batch (here seconds of a question's runs) brought into the unit interval. Bounds per batch are aggregated map-side and joined, so a hot batch is never one window."""
    rows = read(spark, d, "records").where("qid IS NOT NULL AND latency_ms IS NOT NULL").select("qid", "record_id", (F.col("latency_ms") / 1000).alias("s"))
    bounds = rows.groupBy("qid").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    out = F.when((F.col("lo") >= 0) & (F.col("hi") <= 1), F.col("s")).otherwise(1 / (1 + F.exp(-F.col("s"))))
    return rows.join(bounds, "qid").select("record_id", F.round(out, 6).alias("unit_score"))


@query(f"""
WITH {CORPUS}, l AS (SELECT record_id, unnest(retrieved_chunk_ids) AS chunk_id, generate_subscripts(retrieved_chunk_ids, 1) - 1 AS place FROM records)
SELECT record_id, md5(string_agg(coalesce(text, l.chunk_id), chr(10) ORDER BY place)) AS context_md5, count(text) AS resolved, count(*) AS cited FROM l LEFT JOIN corpus USING (chunk_id) GROUP BY record_id""")
def evidence_context(spark, d):
    """The texts a run retrieved, in order; an id that the corpus lacks stands for itself."""
    rows = read(spark, d, "records").select("record_id", F.posexplode("retrieved_chunk_ids").alias("place", "chunk_id")).join(corpus(spark, d), "chunk_id", "left")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", F.coalesce("text", "chunk_id").alias("t")))), lambda x: x["t"])
    return rows.groupBy("record_id").agg(F.md5(F.array_join(parts, "\n")).alias("context_md5"), F.count("text").alias("resolved"), F.count("*").alias("cited"))


# ---------------------------------------------------------------- claims and verdicts

def answers(spark, d) -> DataFrame:
    return spread(read(spark, d, "records").where("answer IS NOT NULL").select("record_id", "answer", B.language_label(F.col("language")).alias("language")), "record_id")


def _claims_sql() -> str:
    cut = "CASE language " + " ".join(f"WHEN '{k}' THEN regexp_split_to_array(s, '{S._uni(v)}')" for k, v in L.CONNECTIVES.items()) + " ELSE [s] END"
    said = "length(trim({0})) >= 8 AND regexp_matches({0}, '[\\p{{L}}\\p{{N}}]')"
    marks = " OR ".join(f"contains(upper(answer), '{m}')" for m in L.ABSTAIN_MARKERS)
    return f"""ans AS (SELECT record_id, answer, {S.language_label('language')} AS language FROM records WHERE answer IS NOT NULL),
sent AS (SELECT record_id, language, {S.sentences(S.normalize('answer'))} AS ss FROM ans WHERE length(answer) >= 12 AND NOT ({marks})),
sx AS (SELECT record_id, language, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM sent),
cx AS (SELECT record_id, language, i, s, list_transform({cut}, lambda p: trim(p)) AS parts FROM sx),
cy AS (SELECT record_id, language, i, CASE WHEN len(parts) > 1 AND len(list_filter(parts, lambda p: NOT ({said.format('p')}))) = 0 THEN parts ELSE [s] END AS parts FROM cx),
cz AS (SELECT record_id, language, i, unnest(parts) AS claim, generate_subscripts(parts, 1) AS j FROM cy),
claim AS (SELECT record_id, language, claim, row_number() OVER (PARTITION BY record_id ORDER BY i, j) - 1 AS claim_ord FROM cz WHERE {said.format('claim')})"""


@query(f"WITH {_claims_sql()} SELECT record_id, claim_ord, claim FROM claim")
def decompose_claims(spark, d):
    return claims.claim_rows(answers(spark, d), "record_id", "answer", "language").select("record_id", F.col("claim_ord").cast("long").alias("claim_ord"), "claim")


def verdicts(spark, d, policy: str = "support") -> DataFrame:
    said = claims.claim_rows(answers(spark, d), "record_id", "answer", "language")
    shown = read(spark, d, "records").select("record_id", F.posexplode("retrieved_chunk_ids").alias("place", "chunk_id"))
    told = claims.evidence_sentences(corpus(spark, d).select("chunk_id", "text"))
    return claims.verify(said, shown, told, "record_id", policy)


def _verdict_sql(policy: str) -> str:
    neg = lambda t: "(" + " OR ".join(f"contains({t}, '{n}')" for n in L.NEGATIONS) + ")"
    nums = lambda t: f"list_distinct(regexp_extract_all({t}, '{L.NUMBER}'))"
    e = S.per_language("language", {k: str(v[0]) for k, v in L.THRESHOLDS.items()}, str(L.OTHER_THRESHOLDS[0]))
    c = S.per_language("language", {k: str(v[1]) for k, v in L.THRESHOLDS.items()}, str(L.OTHER_THRESHOLDS[1]))
    first, second = ("'CONTRADICTED'", "'SUPPORTED'") if policy == "contradiction" else ("'SUPPORTED'", "'CONTRADICTED'")
    share = lambda a, b: S.share_of(a, b)
    return f"""WITH {CORPUS}, {_claims_sql()},
cl AS (SELECT *, {S.overlap_words('lower(claim)')} AS w, list_distinct({S.tokens('lower(claim)', 'language')}) AS tp, {nums('lower(claim)')} AS nm, {neg('lower(claim)')} AS ng FROM claim),
ev AS (SELECT record_id, unnest(retrieved_chunk_ids) AS chunk_id, generate_subscripts(retrieved_chunk_ids, 1) - 1 AS place FROM records),
cs0 AS (SELECT chunk_id, lower(text) AS low, list_filter(string_split(regexp_replace(lower(text), '([.!?।॥])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '') AS ss FROM corpus),
cs1 AS (SELECT chunk_id, unnest(CASE WHEN len(ss) <= 1 THEN [low] ELSE ss END) AS s, generate_subscripts(CASE WHEN len(ss) <= 1 THEN [low] ELSE ss END, 1) AS i FROM cs0),
cs2 AS (SELECT chunk_id, s, i, {S.overlap_words('s')} AS sw, {nums('s')} AS sn, {neg('s')} AS sg FROM cs1),
pr AS (SELECT cl.*, ev.place, ev.chunk_id, s, i, sw, sn, sg, {share('sw', 'w')} AS ov FROM cl JOIN ev USING (record_id) JOIN cs2 USING (chunk_id) WHERE place < 5 AND claim_ord < 50),
fo AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY record_id, claim_ord, place ORDER BY ov DESC, i) = 1),
sc AS (SELECT *, list_distinct({S.tokens('s', 'language')}) AS st FROM fo),
kw AS (SELECT *, CASE WHEN (len(nm) > 0 AND len(sn) > 0 AND len(list_filter(nm, lambda x: NOT list_contains(sn, x))) > 0 AND greatest({share('st', 'tp')}, ov) >= 0.3) OR (ov >= 0.5 AND sg <> ng) THEN [0.05, 0.85, 0.10] WHEN ov >= 0.6 THEN [0.85, 0.05, 0.10] WHEN ov >= 0.3 THEN [0.45, 0.10, 0.45] ELSE [0.10, 0.05, 0.85] END AS p FROM sc),
vd AS (SELECT *, CASE WHEN p[2] >= {c} THEN 'CONTRADICTED' WHEN p[1] >= {e} THEN 'SUPPORTED' ELSE 'UNVERIFIABLE' END AS v FROM kw),
ag AS (SELECT record_id, claim_ord, CASE WHEN bool_or(v = {first}) THEN {first} WHEN bool_or(v = {second}) THEN {second} ELSE 'UNVERIFIABLE' END AS verdict FROM vd GROUP BY ALL),
cz2 AS (SELECT record_id, claim_ord, any_value(verdict) AS verdict, arg_max(p, {{'p': CASE v WHEN 'SUPPORTED' THEN p[1] WHEN 'CONTRADICTED' THEN p[2] ELSE p[3] END, 'at': -place}}) AS p, string_agg(chunk_id, ',' ORDER BY place) AS cited FROM vd JOIN ag USING (record_id, claim_ord) WHERE v = verdict GROUP BY ALL),
res AS (SELECT claim.record_id, claim.language, claim.claim_ord, coalesce(verdict, 'UNVERIFIABLE') AS verdict, coalesce(p[1], 0)::DOUBLE AS entailment, coalesce(p[2], 0)::DOUBLE AS contradiction, coalesce(p[3], 1)::DOUBLE AS neutral, CASE WHEN verdict IN ('SUPPORTED', 'CONTRADICTED') THEN cited ELSE '' END AS citations FROM claim LEFT JOIN cz2 USING (record_id, claim_ord))"""


@query(_verdict_sql("support") + " SELECT record_id, claim_ord, verdict, entailment, contradiction, neutral, citations FROM res")
def verify_claims(spark, d):
    out = verdicts(spark, d)
    return out.select("record_id", F.col("claim_ord").cast("long").alias("claim_ord"), "verdict", "entailment", "contradiction", "neutral", F.array_join("citations", ",").alias("citations"))


@query(_verdict_sql("support") + f""", res2 AS (SELECT record_id, claim_ord, verdict AS v1 FROM res)
SELECT v1 AS support_policy, count(*) AS claims FROM res2 GROUP BY v1""")
def verdict_counts(spark, d):
    return verdicts(spark, d).groupBy(F.col("verdict").alias("support_policy")).agg(F.count("*").alias("claims"))


@query(_verdict_sql("contradiction") + " SELECT language, verdict AS strict_policy, count(*) AS claims FROM res GROUP BY ALL")
def conflict_policy(spark, d):
    """Verdicts where any contradiction wins."""
    return verdicts(spark, d, "contradiction").groupBy("language", F.col("verdict").alias("strict_policy")).agg(F.count("*").alias("claims"))


_DET = """, det AS (SELECT record_id, count(*) AS n, count(*) FILTER (verdict = 'SUPPORTED') AS s, count(*) FILTER (verdict = 'CONTRADICTED') AS c, count(*) FILTER (verdict = 'UNVERIFIABLE') AS u, avg(mg) AS mm, min(mg) AS mn
FROM (SELECT *, list_sort([entailment, contradiction, neutral], 'DESC')[1] - list_sort([entailment, contradiction, neutral], 'DESC')[2] AS mg FROM res) GROUP BY record_id)"""


@query(_verdict_sql("support") + _DET + " SELECT record_id, n AS n_claims, s AS supported, c AS contradicted, u AS unverifiable, round(s::DOUBLE / n, 6) AS supported_ratio, round(mm, 6) AS mean_margin, round(mn, 6) AS min_margin FROM det")
def verdict_ratios(spark, d):
    out = claims.detection(verdicts(spark, d), "record_id")
    return out.select("record_id", "n_claims", "supported", "contradicted", "unverifiable", F.round("supported_ratio", 6).alias("supported_ratio"), F.round("mean_margin", 6).alias("mean_margin"), F.round("min_margin", 6).alias("min_margin"))


def audited(spark, d) -> DataFrame:
    """Every answer with its verdict counts, heuristic confidence, band and the action that the policy takes."""
    det = claims.detection(verdicts(spark, d), "record_id")
    rows = read(spark, d, "records").where("answer IS NOT NULL").select("record_id", "system_name", B.language_label(F.col("language")).alias("language"), F.size("retrieved_chunk_ids").alias("n_chunks"), "iterations")
    out = rows.join(det, "record_id", "left").fillna(0, ["n_claims", "supported", "contradicted", "unverifiable", "supported_ratio", "contradicted_ratio", "unverifiable_ratio"])
    none = F.lit(None).cast("double")
    top = F.when(F.col("n_chunks") > 0, F.lit(1.0)).otherwise(0.0)  # first place of a single fused list
    score = F.round(confidence.heuristic(F.col("supported_ratio"), F.col("mean_margin"), top, none, F.lit(False), F.col("contradicted_ratio")), 6)
    out = out.withColumn("score", score).withColumn("band", confidence.band(F.col("score")))
    act = correction.decide(F.col("n_claims"), F.col("supported"), F.col("contradicted"), F.col("unverifiable"), F.col("score"), F.col("band"), top, F.coalesce("iterations", F.lit(0)) >= correction.ITERATIONS)
    return out.withColumn("action", act)


_AUDIT = _DET + """, a0 AS (SELECT r.record_id, r.system_name, CASE WHEN len(r.retrieved_chunk_ids) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS top, coalesce(iterations, 0) >= 2 AS ex, coalesce(n, 0) AS n, coalesce(s, 0) AS s, coalesce(c, 0) AS c, coalesce(u, 0) AS u, coalesce(mm, 0) AS mm FROM records r LEFT JOIN det USING (record_id) WHERE r.answer IS NOT NULL),
a1 AS (SELECT *, coalesce(s::DOUBLE / nullif(n, 0), 0) AS sr, coalesce(c::DOUBLE / nullif(n, 0), 0) AS cr FROM a0),
a2 AS (SELECT *, round(greatest(0, least(1, 0.55::DOUBLE * sr + 0.20::DOUBLE * mm + 0.15::DOUBLE * least(1, 2 * top) + 0.10::DOUBLE * sr - 0.35::DOUBLE * cr)), 6) AS score FROM a1),
a3 AS (SELECT *, CASE WHEN score >= 0.75 THEN 'HIGH' WHEN score >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM a2),
aud AS (SELECT *, CASE WHEN n = 0 THEN 'ACCEPT' WHEN c = 0 AND u = 0 AND band <> 'LOW' THEN 'ACCEPT' WHEN c > 0 AND top >= 0.15 AND NOT ex THEN 'REGENERATE' WHEN u > 0 AND top < 0.15 AND NOT ex THEN 'RE_RETRIEVE' WHEN score < 0.30 OR s = 0 THEN 'ABSTAIN' WHEN ex THEN 'ABSTAIN' WHEN (c + u)::DOUBLE / n <= 0.5 THEN 'PRUNE' WHEN c > 0 THEN 'REGENERATE' ELSE 'ABSTAIN' END AS action FROM a3)"""


@query(_verdict_sql("support") + _AUDIT + " SELECT record_id, n AS n_claims, s AS supported, c AS contradicted, u AS unverifiable, score, band, action FROM aud")
def audit_answers(spark, d):
    """The flagship: every answer of a log audited against what it retrieved."""
    return audited(spark, d).select("record_id", "n_claims", "supported", "contradicted", "unverifiable", "score", "band", "action")


@query(_verdict_sql("support") + _AUDIT + " SELECT system_name, action, band, count(*) AS answers FROM aud GROUP BY ALL")
def policy_decisions(spark, d):
    return audited(spark, d).groupBy("system_name", "action", "band").agg(F.count("*").alias("answers"))


@query("""
WITH r AS (SELECT record_id, supported AS s, contradicted AS c, unverifiable AS u, lag({'c': contradicted, 'u': unverifiable, 's': -supported}) OVER (PARTITION BY qid, system_name ORDER BY started_at, record_id) AS p FROM records WHERE supported IS NOT NULL AND contradicted IS NOT NULL AND unverifiable IS NOT NULL AND qid IS NOT NULL)
SELECT record_id, ({'c': c, 'u': u, 's': -s} < p) AS better, (p < {'c': c, 'u': u, 's': -s}) AS worse FROM r WHERE p IS NOT NULL""")
def verdict_profiles(spark, d):
    """Each run of a question by a system against the run before it, compared by verdict profile.

    A question may hold a third of all runs, so no task sorts all runs of one: the run before is looked for inside the
    hour, and the first run of an hour gets the last one of the hour before it that has any.
    """
    rows = read(spark, d, "records").where("supported IS NOT NULL AND contradicted IS NOT NULL AND unverifiable IS NOT NULL AND qid IS NOT NULL")
    rows = rows.select("record_id", "qid", "system_name", "started_at", F.date_trunc("hour", F.col("started_at")).alias("slot"), correction.profile(F.col("supported"), F.col("contradicted"), F.col("unverifiable")).alias("p"))
    inside = rows.withColumn("q", F.lag("p").over(W.partitionBy("qid", "system_name", "slot").orderBy("started_at", "record_id"))).where("q IS NOT NULL").select("record_id", "p", "q")
    order, run = F.struct("started_at", "record_id"), F.struct("record_id", "p")
    slots = rows.groupBy("qid", "system_name", "slot").agg(F.min_by(run, order).alias("first"), F.max_by("p", order).alias("last"))
    slots = slots.withColumn("q", F.lag("last").over(W.partitionBy("qid", "system_name").orderBy(F.col("slot").asc_nulls_last()))).where("q IS NOT NULL")
    rows = inside.unionByName(slots.select("first.record_id", "first.p", "q"))
    return rows.select("record_id", (F.col("p") < F.col("q")).alias("better"), (F.col("q") < F.col("p")).alias("worse"))


@query("""
SELECT system_name, coalesce(sum(correction_attempts), 0)::BIGINT AS attempts, coalesce(sum(correction_regressions), 0)::BIGINT AS regressions, count(*) FILTER (correction_attempts > 0) AS runs_corrected,
round(CASE WHEN coalesce(sum(correction_attempts), 0) > 0 THEN coalesce(sum(correction_regressions), 0)::DOUBLE / sum(correction_attempts) ELSE 0 END, 6) AS regression_rate FROM records GROUP BY system_name""")
def correction_tracker(spark, d):
    out = correction.tracker(read(spark, d, "records"), ["system_name"])
    return out.withColumn("regression_rate", F.round("regression_rate", 6))


@query()
def pruned_answers(spark, d):
    """Answers whose flagged claims are cut out, for the records that the policy prunes."""
    said = answers(spark, d).withColumn("claims", claims.decompose(F.col("answer"), F.col("language")))
    placed = claims.claim_spans(said, "answer", "claims").select("record_id", "answer", "claims", "spans")
    v = verdicts(spark, d).groupBy("record_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("claim_ord", "verdict"))), lambda x: x["verdict"] != "SUPPORTED").alias("flags"))
    rows = placed.join(v, "record_id")
    parts = F.transform(F.sequence(F.lit(1), F.size("claims")), lambda i: F.struct(F.element_at("claims", i).alias("claim"), F.element_at("spans", i)["start"].alias("start"), F.element_at("spans", i)["end"].alias("end"), F.element_at("flags", i).alias("flagged")))
    some = rows.where(F.exists("flags", lambda f: f) & F.exists("flags", lambda f: ~f))
    return some.select("record_id", correction.prune(F.col("answer"), parts).alias("pruned"))


# ---------------------------------------------------------------- calibration

_SCORED = "s AS (SELECT system_name, confidence AS p, CASE WHEN contradicted = 0 AND unverifiable = 0 AND supported > 0 THEN 1 ELSE 0 END AS y FROM records WHERE confidence IS NOT NULL AND supported IS NOT NULL)"


def scored(spark, d) -> DataFrame:
    rows = read(spark, d, "records").where("confidence IS NOT NULL AND supported IS NOT NULL")
    return rows.select("system_name", F.col("confidence").alias("p"), F.when((F.col("contradicted") == 0) & (F.col("unverifiable") == 0) & (F.col("supported") > 0), 1).otherwise(0).alias("y"))


_BIN = "CASE " + " ".join(f"WHEN p {'>' if i else '>='} {lo}::DOUBLE AND p <= {hi}::DOUBLE THEN {i}" for i, lo, hi in confidence.bins()) + " END"


@query(f"""
WITH {_SCORED}, b AS (SELECT *, {_BIN} AS bin FROM s), e AS (SELECT range AS bin FROM range(10))
SELECT e.bin::INT AS bin, count(b.p) AS n, round(coalesce(avg(p), 0), 6) AS mean_p, round(coalesce(avg(y), 0), 6) AS accuracy FROM e LEFT JOIN b ON e.bin = b.bin GROUP BY e.bin""")
def reliability_bins(spark, d):
    return confidence.reliability(scored(spark, d)).select("bin", "n", F.round("mean_p", 6).alias("mean_p"), F.round("accuracy", 6).alias("accuracy"))


@query(f"""
WITH {_SCORED}, b AS (SELECT system_name, {_BIN} AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS acc, sum((p - y) ** 2) AS sq FROM s GROUP BY ALL)
SELECT system_name, sum(n)::BIGINT AS n, round(coalesce(sum(CASE WHEN bin IS NOT NULL THEN n * abs(mp - acc) END), 0) / sum(n), 6) AS ece, round(sum(sq) / sum(n), 6) AS brier FROM b GROUP BY system_name""")
def calibration_error(spark, d):
    out = confidence.expected_error(scored(spark, d), ["system_name"])
    return out.select("system_name", "n", F.round("ece", 6).alias("ece"), F.round("brier", 6).alias("brier"))


@query(f"""
WITH RECURSIVE {_SCORED}, t AS (SELECT p, count(*) AS c, sum(y) AS sy FROM s GROUP BY p), u AS (SELECT *, sum(c) OVER (ORDER BY p) AS upto FROM t), n AS (SELECT sum(c) AS n FROM t),
e(g, past) AS (SELECT 0, 0::HUGEINT UNION ALL SELECT g + 1, (SELECT min(upto) FROM u, n WHERE upto >= past + n.n / 10.0::DOUBLE) FROM e, n WHERE past IS NOT NULL AND past < n.n),
k AS (SELECT past FROM e, n WHERE past > 0 AND past < n.n), g AS (SELECT (SELECT count(*) FROM k WHERE u.upto > k.past) AS g, c, p, sy FROM u), h AS (SELECT g, sum(c) AS c, sum(p * c) AS sp, sum(sy) AS sy FROM g GROUP BY g)
SELECT sum(c)::BIGINT AS n, count(*) AS groups, round(sum(abs(sp - sy)) / sum(c), 6) AS ace FROM h""")
def adaptive_calibration(spark, d):
    return confidence.adaptive_error(scored(spark, d)).select("n", "groups", F.round("ace", 6).alias("ace"))


@query(f"""
WITH {_SCORED}, q AS (SELECT greatest(1e-6, least(1 - 1e-6, p)) AS q, y, count(*) AS c FROM s GROUP BY ALL), g AS (SELECT i, i * 5.0::DOUBLE / 200 AS t FROM range(1, 201) r(i)),
z AS (SELECT t, y, c, greatest(1e-9, least(1 - 1e-9, 1 / (1 + exp(-ln(q / (1 - q)) / t)))) AS z FROM q, g), l AS (SELECT t, round(sum(-(y * ln(z) + (1 - y) * ln(1 - z)) * c) / sum(c), 9) AS nll FROM z GROUP BY t)
SELECT arg_min(t, {{'nll': nll, 't': t}}) AS temperature, round(min(nll), 6) AS nll FROM l""")
def temperature_fit(spark, d):
    return confidence.best_temperature(confidence.temperature_grid(scored(spark, d))).select(F.col("t").alias("temperature"), F.round("nll", 6).alias("nll"))


@query()
def fitted_confidence(spark, d):
    """A logistic model fitted on runs of the training questions and its error on those of the dev questions."""
    split = read(spark, d, "questions").groupBy("qid").agg(F.max(B.split_label(F.col("split"))).alias("split"))
    rows = read(spark, d, "records").where("error_text IS NULL AND n_claims > 0 AND confidence IS NOT NULL").join(split, "qid")
    rows = rows.select("split", (F.col("supported") / F.col("n_claims")).alias("s2_supported_ratio"), (F.col("contradicted") / F.col("n_claims")).alias("s2_contradicted_ratio"), F.col("n_claims").cast("double").alias("s2_n_claims"), F.size("retrieved_chunk_ids").cast("double").alias("s1_n_chunks"), F.col("confidence").alias("p0"), (F.col("hallucination_rate") == 0).cast("int").alias("y"))
    names = ["s2_supported_ratio", "s2_contradicted_ratio", "s2_n_claims", "s1_n_chunks"]
    model = confidence.check_model(confidence.fit_logistic(rows.where("split = 'train'"), names, "y"), names)
    dev = rows.where("split = 'dev'").select(confidence.model_score(model, F.col("p0")).alias("p"), "y", F.lit("dev").alias("part"))
    return confidence.expected_error(dev, ["part"])


# ---------------------------------------------------------------- metrics

@query(f"""
WITH l AS (SELECT item_id, arg_max(upper(trim(label)), CASE WHEN source = 'llm' THEN seq END) AS llm, arg_max(upper(trim(label)), CASE WHEN source = 'human' THEN seq END) AS human FROM annotation_events WHERE event_type = 'annotation' AND upper(trim(label)) IN ('SUPPORTED', 'CONTRADICTED', 'UNVERIFIABLE') AND item_id IS NOT NULL GROUP BY item_id),
c AS (SELECT human AS g, llm AS p, count(*) AS n FROM l WHERE human IS NOT NULL AND llm IS NOT NULL GROUP BY ALL), x AS (SELECT g AS label FROM c UNION SELECT p FROM c),
m AS (SELECT label, (SELECT coalesce(sum(n), 0) FROM c WHERE g = label) AS gold, (SELECT coalesce(sum(n), 0) FROM c WHERE p = label) AS pred, (SELECT coalesce(sum(n), 0) FROM c WHERE g = label AND p = label) AS hit FROM x),
f AS (SELECT label, gold, CASE WHEN pred > 0 THEN hit::DOUBLE / pred ELSE 0 END AS pr, CASE WHEN gold > 0 THEN hit::DOUBLE / gold ELSE 0 END AS rc, hit FROM m), g AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END AS f1 FROM f)
SELECT label, gold::BIGINT AS support, round(pr, 6) AS precision, round(rc, 6) AS recall, round(f1, 6) AS f1, round(avg(f1) OVER (), 6) AS macro_f1, round(sum(hit) OVER () / sum(gold) OVER (), 6) AS accuracy FROM g""")
def classification_report(spark, d):
    """The llm's labels judged by the human ones."""
    out = evaluation.classification(evaluation.confusion(review.latest_labels(read(spark, d, "annotation_events")), "human", "llm"))
    return out.select("label", F.col("support").cast("long").alias("support"), *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "macro_f1", "accuracy")])


_LATEST = "l AS (SELECT item_id, arg_max(upper(trim(label)), CASE WHEN source = 'llm' THEN seq END) AS llm, arg_max(upper(trim(label)), CASE WHEN source = 'human' THEN seq END) AS human, arg_max(upper(trim(label)), CASE WHEN source = 'adjudicated' THEN seq END) AS adjudicated FROM annotation_events WHERE event_type = 'annotation' AND upper(trim(label)) IN ('SUPPORTED', 'CONTRADICTED', 'UNVERIFIABLE') AND item_id IS NOT NULL GROUP BY item_id)"


@query(f"WITH {_LATEST} SELECT human AS gold, count(*) FILTER (llm = 'SUPPORTED') AS SUPPORTED, count(*) FILTER (llm = 'CONTRADICTED') AS CONTRADICTED, count(*) FILTER (llm = 'UNVERIFIABLE') AS UNVERIFIABLE FROM l WHERE human IS NOT NULL AND llm IS NOT NULL GROUP BY human")
def confusion_pivot(spark, d):
    counts = evaluation.confusion(review.latest_labels(read(spark, d, "annotation_events")), "human", "llm")
    return counts.groupBy("gold").pivot("pred", review.VERDICTS).agg(F.sum("n")).fillna(0)


@query(f"""
WITH {_LATEST}, i AS (SELECT item_id, max({S.language_label('language')}) AS lang FROM annotation_events WHERE event_type = 'item' GROUP BY item_id),
p AS (SELECT coalesce(lang, 'none') AS language, human AS g, llm AS p FROM l JOIN i USING (item_id) WHERE human IS NOT NULL AND llm IS NOT NULL), a AS (SELECT * FROM p UNION ALL SELECT 'all', g, p FROM p),
t AS (SELECT language, count(*) AS n, avg((g = p)::INT) AS po, sum((g = 'SUPPORTED')::INT)::DOUBLE / count(*) * sum((p = 'SUPPORTED')::INT) / count(*) + sum((g = 'CONTRADICTED')::INT)::DOUBLE / count(*) * sum((p = 'CONTRADICTED')::INT) / count(*) + sum((g = 'UNVERIFIABLE')::INT)::DOUBLE / count(*) * sum((p = 'UNVERIFIABLE')::INT) / count(*) AS pe FROM a GROUP BY language)
SELECT language, n, round(po, 6) AS agreement, round(CASE WHEN pe >= 1 THEN 1 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM t""")
def cohen_kappa(spark, d):
    """Agreement of llm and human labels, overall and by language."""
    ev = read(spark, d, "annotation_events")
    lang = ev.where("event_type = 'item'").groupBy("item_id").agg(F.max(B.language_label(F.col("language"))).alias("lang"))
    pairs = review.latest_labels(ev).join(lang, "item_id").withColumn("language", F.explode(F.array(F.coalesce("lang", F.lit("none")), F.lit("all"))))
    out = evaluation.kappa(evaluation.confusion(pairs, "human", "llm", ["language"]), ["language"], review.VERDICTS)
    return out.select("language", "n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


@query(f"WITH {_LATEST}, i AS (SELECT DISTINCT item_id FROM annotation_events WHERE event_type = 'item' AND item_id IS NOT NULL) SELECT item_id, coalesce(adjudicated, human, llm) AS label, CASE WHEN adjudicated IS NOT NULL THEN 'adjudicated' WHEN human IS NOT NULL THEN 'human' WHEN llm IS NOT NULL THEN 'llm' END AS label_source, llm AS llm_label FROM i LEFT JOIN l USING (item_id)")
def final_label(spark, d):
    return review.final_labels(read(spark, d, "annotation_events"))


@query(f"WITH {_LATEST} SELECT item_id, llm, human FROM l WHERE llm <> human AND adjudicated IS NULL")
def disagreements(spark, d):
    return review.disagreements(read(spark, d, "annotation_events"))


@query(f"WITH {_LATEST}, i AS (SELECT DISTINCT item_id FROM annotation_events WHERE event_type = 'item' AND item_id IS NOT NULL) SELECT item_id FROM i LEFT JOIN l USING (item_id) WHERE adjudicated IS NULL AND human IS NULL")
def needs_human(spark, d):
    return review.needs_human(read(spark, d, "annotation_events"))


@query(f"""
WITH {_LATEST}, i AS (SELECT item_id, max({S.language_label('language')}) AS language FROM annotation_events WHERE event_type = 'item' AND item_id IS NOT NULL GROUP BY item_id), s AS (SELECT item_id, language, coalesce(adjudicated, human, llm) AS label FROM i LEFT JOIN l USING (item_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY language, label ORDER BY ('0x' || substr(md5('42#' || item_id), 1, 15))::BIGINT, item_id) - 1 AS place, count(*) OVER (PARTITION BY language, label) AS n FROM s) SELECT item_id, language, label FROM r WHERE place < greatest(5, round_even(0.3::DOUBLE * n, 0))""")
def stratified_sample(spark, d):
    """Items for human review: three tenths of each language and label, five at least."""
    ev = read(spark, d, "annotation_events")
    lang = ev.where("event_type = 'item' AND item_id IS NOT NULL").groupBy("item_id").agg(F.max(B.language_label(F.col("language"))).alias("language"))
    return review.stratified(lang.join(review.final_labels(ev).select("item_id", "label"), "item_id"), "item_id", ["language", "label"])


@query("""
WITH r AS (SELECT system_name, record_id, coalesce(retrieved_chunk_ids, [])[1:5] AS got, list_distinct(coalesce(gold_chunk_ids, [])) AS want FROM records),
o AS (SELECT system_name, len(got) = 0 AS empty, len(want) > 0 AS judged, len(list_intersect(got, want))::DOUBLE / greatest(len(want), 1) AS recall, list_filter(list_transform(got, lambda c, i: CASE WHEN list_contains(want, c) THEN i END), lambda i: i IS NOT NULL) AS pl, len(want) AS w FROM r),
m AS (SELECT system_name, empty, judged, recall, coalesce(list_sum(list_transform(pl, lambda i: 1 / log2(i + 1))), 0) / nullif(list_sum(list_transform(range(1, least(w, 5) + 1), lambda i: 1 / log2(i + 1))), 0) AS ndcg, CASE WHEN len(pl) > 0 THEN 1.0 / pl[1] ELSE 0 END AS rr FROM o)
SELECT system_name, count(*) AS n, round(coalesce(avg(CASE WHEN judged THEN recall END), 0), 6) AS recall, round(coalesce(avg(CASE WHEN judged THEN ndcg END), 0), 6) AS ndcg, round(coalesce(avg(CASE WHEN judged THEN rr END), 0), 6) AS mrr, round(avg(empty::INT), 6) AS empty_rate FROM m GROUP BY system_name""")
def retrieval_metrics(spark, d):
    out = evaluation.retrieval_quality(read(spark, d, "records"), ["system_name"], "record_id", "retrieved_chunk_ids", "gold_chunk_ids")
    return out.select("system_name", "n", *[F.round(c, 6).alias(c) for c in ("recall", "ndcg", "mrr", "empty_rate")])


@query(f"""
WITH r AS (SELECT system_name, {S.language_label('language')} AS language, abstained AS a, should_abstain AS s FROM records WHERE abstained IS NOT NULL AND should_abstain IS NOT NULL), c AS (SELECT system_name, language, count(*) AS n, count(*) FILTER (a) AS said, count(*) FILTER (s) AS should, count(*) FILTER (a AND s) AS tp, count(*) FILTER (a AND NOT s) AS fp FROM r GROUP BY ALL)
SELECT system_name, language, n, round(said::DOUBLE / n, 6) AS abstention_rate, round(CASE WHEN said > 0 THEN tp::DOUBLE / said ELSE 0 END, 6) AS abstention_precision, round(CASE WHEN should > 0 THEN tp::DOUBLE / should ELSE 0 END, 6) AS abstention_recall, round(CASE WHEN n - should > 0 THEN fp::DOUBLE / (n - should) ELSE 0 END, 6) AS over_abstention_rate FROM c""")
def abstention_metrics(spark, d):
    rows = read(spark, d, "records").select("system_name", B.language_label(F.col("language")).alias("language"), "abstained", "should_abstain")
    out = evaluation.abstention(rows, ["system_name", "language"])
    return out.select("system_name", "language", "n", *[F.round(c, 6).alias(c) for c in ("abstention_rate", "abstention_precision", "abstention_recall", "over_abstention_rate")])


@query()
def bootstrap_intervals(spark, d):
    """Hallucination rate of each system's answered runs with its interval."""
    rows = read(spark, d, "records").where("error_text IS NULL AND NOT coalesce(abstained, false)").select("system_name", "hallucination_rate")
    return evaluation.bootstrap_mean(rows, ["system_name"], "hallucination_rate")


@query()
def paired_bootstrap(spark, d):
    """Difference of each system to the plain one on the same question and language, with interval and two-sided p."""
    rows = read(spark, d, "records").where("error_text IS NULL").select("system_name", B.group_id(F.col("parallel_id"), F.col("qid")).alias("gid"), B.language_label(F.col("language")).alias("language"), "hallucination_rate", F.struct("started_at", "record_id").alias("order"))
    return evaluation.bootstrap_mean(evaluation.paired(rows, ["gid", "language"], "system_name", "hallucination_rate", "vanilla", "order"), ["system_name"], "difference")


@query(f"""
WITH r AS (SELECT system_name, {S.group_id('parallel_id', 'qid')} AS gid, {S.language_label('language')} AS language, arg_max(hallucination_rate, {{'a': started_at, 'b': record_id}}) AS v FROM records WHERE error_text IS NULL AND hallucination_rate IS NOT NULL GROUP BY ALL)
SELECT a.system_name, count(*) AS pairs, round(avg(a.v - b.v), 6) AS mean_difference FROM r a JOIN r b ON a.gid = b.gid AND a.language = b.language WHERE b.system_name = 'vanilla' AND a.system_name <> 'vanilla' GROUP BY a.system_name""")
def paired_systems(spark, d):
    rows = read(spark, d, "records").where("error_text IS NULL").select("system_name", B.group_id(F.col("parallel_id"), F.col("qid")).alias("gid"), B.language_label(F.col("language")).alias("language"), "hallucination_rate", F.struct("started_at", "record_id").alias("order"))
    out = evaluation.paired(rows, ["gid", "language"], "system_name", "hallucination_rate", "vanilla", "order")
    return out.groupBy("system_name").agg(F.count("*").alias("pairs"), F.round(F.avg("difference"), 6).alias("mean_difference"))


_PVALUES = f"t AS (SELECT system_name, {S.language_label('language')} AS language, round(least(1, 2 * exp(-2 * count(*) * (avg(hallucination_rate) - 0.25) ** 2)), 9) AS p FROM records WHERE hallucination_rate IS NOT NULL AND {S.language_label('language')} IN ('en', 'hi', 'ta') GROUP BY ALL)"


@query(f"""
WITH {_PVALUES}, r AS (SELECT *, row_number() OVER (ORDER BY p, system_name, language) AS rank, count(*) OVER () AS m FROM t)
SELECT system_name, language, p, rank, min((p <= 0.05::DOUBLE / (m - rank + 1))::INT) OVER (ORDER BY rank) = 1 AS significant FROM r""")
def holm_bonferroni(spark, d):
    """Step-down correction over the systems and languages of a bound on the chance that a mean rate of a quarter gives what is seen."""
    rows = read(spark, d, "records").where("hallucination_rate IS NOT NULL").select("system_name", B.language_label(F.col("language")).alias("language"), "hallucination_rate").where("language IN ('en', 'hi', 'ta')")
    p = F.round(F.least(F.lit(1.0), 2 * F.exp(-2 * F.count("*") * (F.avg("hallucination_rate") - 0.25) ** 2)), 9)
    out = evaluation.holm(rows.groupBy("system_name", "language").agg(p.alias("p")))
    return out.select("system_name", "language", "p", F.col("rank").cast("long").alias("rank"), "significant")


@query()
def holm_paired(spark, d):
    """The differences of paired_bootstrap corrected for their number."""
    out = evaluation.holm(paired_bootstrap(spark, d).select("system_name", "mean", "p_value"), "p_value")
    return out.select("system_name", "mean", "p_value", F.col("rank").cast("long").alias("rank"), "significant")


@query(f"""
WITH v AS (SELECT system_name, {S.language_label('language')} AS language, avg(hallucination_rate) AS rate FROM records WHERE hallucination_rate IS NOT NULL AND {S.language_label('language')} IN ('en', 'hi', 'ta') GROUP BY ALL)
SELECT a.system_name, a.language, round(a.rate, 6) AS rate, round(CASE WHEN coalesce(b.rate, 0) = 0 THEN 0 ELSE -(a.rate - b.rate) / abs(b.rate) END, 6) AS gap FROM v a LEFT JOIN v b ON a.system_name = b.system_name AND b.language = 'en'""")
def language_gap(spark, d):
    rows = read(spark, d, "records").where("hallucination_rate IS NOT NULL").select("system_name", B.language_label(F.col("language")).alias("language"), "hallucination_rate").where("language IN ('en', 'hi', 'ta')")
    out = evaluation.gaps(rows.groupBy("system_name", "language").agg(F.avg("hallucination_rate").alias("rate")), ["system_name"], "language", "rate", "en", higher_is_better=False)
    return out.select("system_name", "language", F.round("rate", 6).alias("rate"), F.round("gap", 6).alias("gap"))


@query(f"""
WITH r AS (SELECT *, {S.language_label('language')} AS lg, error_text IS NULL AS ok FROM records)
SELECT system_name, lg AS language, count(*) AS n, count(*) FILTER (NOT ok) AS failures, count(*) FILTER (ok) = 0 AS all_failed, count(*) FILTER (ok AND NOT coalesce(abstained, false)) AS answered, round(avg(hallucination_rate) FILTER (ok AND NOT coalesce(abstained, false)), 6) AS answered_hallucination_rate, round(avg(confidence) FILTER (ok), 6) AS mean_confidence,
round(CASE WHEN count(*) FILTER (ok) > 0 THEN count(*) FILTER (ok AND abstained)::DOUBLE / count(*) FILTER (ok) ELSE 0 END, 6) AS abstention_rate, round(CASE WHEN coalesce(sum(correction_attempts) FILTER (ok), 0) > 0 THEN (sum(correction_regressions) FILTER (ok))::DOUBLE / sum(correction_attempts) FILTER (ok) ELSE 0 END, 6) AS regression_rate, round(avg(latency_ms) FILTER (ok), 3) AS mean_latency_ms FROM r GROUP BY system_name, lg""")
def experiment_table(spark, d):
    rows = read(spark, d, "records").withColumn("language", B.language_label(F.col("language")))
    return evaluation.experiment(rows, ["system_name", "language"])


@query(f"""
WITH r AS (SELECT {S.answerability_label('answerability')} AS answerability, system_name, {S.language_label('language')} AS language, error_text IS NULL AS ok, coalesce(abstained, false) AS ab, n_claims, supported, contradicted, latency_ms, coalesce(should_abstain, false) AS sh FROM records)
SELECT answerability, system_name, language, count(*) AS runs, count(*) FILTER (NOT ok) AS errors, round(coalesce(count(*) FILTER (ok AND NOT sh AND NOT ab)::DOUBLE / nullif(count(*) FILTER (ok AND NOT sh), 0), 0), 6) AS answered_when_answerable, round(coalesce(count(*) FILTER (ok AND sh AND ab)::DOUBLE / nullif(count(*) FILTER (ok AND sh), 0), 0), 6) AS abstained_when_unanswerable,
round(coalesce(count(*) FILTER (ok AND NOT ab AND n_claims > 0 AND supported = n_claims)::DOUBLE / nullif(count(*) FILTER (ok AND NOT ab AND n_claims > 0), 0), 0), 6) AS released_all_supported, round(coalesce(count(*) FILTER (ok AND NOT ab AND n_claims > 0 AND contradicted > 0)::DOUBLE / nullif(count(*) FILTER (ok AND NOT ab AND n_claims > 0), 0), 0), 6) AS released_contradicted, round(avg(latency_ms) FILTER (ok), 3) AS mean_latency_ms
FROM r GROUP BY GROUPING SETS ((answerability), (system_name, language))""")
def crosslingual_sets(spark, d):
    rows = read(spark, d, "records").withColumn("language", B.language_label(F.col("language"))).withColumn("answerability", B.answerability_label(F.col("answerability")))
    return evaluation.grouping_sets(rows)


@query("SELECT system_name, percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_ms) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms) AS p95 FROM records WHERE latency_ms IS NOT NULL GROUP BY system_name")
def nearest_rank_latency(spark, d):
    """Exact percentiles; equal values are counted before they meet."""
    return nearest_ranks(read(spark, d, "records"), ["system_name"], "latency_ms", {"p50": 0.5, "p95": 0.95})


_LAST = "arg_max({'ab': coalesce(abstained, false), 'sh': coalesce(should_abstain, false), 'fs': coalesce(hallucination_rate = 0, false), 'p': confidence, 'ms': latency_ms}, {'a': started_at, 'b': record_id})"


@query(f"""
WITH r AS (SELECT system_name, qid, {S.language_label('language')} AS language, {_LAST} AS x FROM records WHERE error_text IS NULL AND qid IS NOT NULL AND latency_ms IS NOT NULL AND {S.language_label('language')} IN ('en', 'hi', 'ta') GROUP BY ALL),
f AS (SELECT r.language, r.x.ab AS ab, r.x.sh AS sh, r.x.fs AS fs, r.x.p AS p, coalesce(r.x.p BETWEEN 0 AND 1, false) AS cal, r.x.ms / b.x.ms AS ratio FROM r JOIN r b USING (qid, language) WHERE r.system_name = 'engine_full' AND b.system_name = 'vanilla' AND b.x.ms > 0),
e AS (SELECT language, sum(abs(gap)) / sum(n) AS ece FROM (SELECT language, ceil(round(p * 10, 9)) AS bin, sum(p - fs::INT) AS gap, count(*) AS n FROM (SELECT language, greatest(p, 1e-12) AS p, fs FROM f WHERE NOT ab AND p IS NOT NULL) GROUP BY ALL) GROUP BY language),
g AS (SELECT language, count(*) >= 50 AS enough_reviewed, count(*) FILTER (NOT ab) >= 20 AS enough_answered, bool_or(sh) AND bool_or(NOT sh) AS both_kinds, coalesce(count(*) FILTER (NOT ab AND NOT fs)::DOUBLE / nullif(count(*) FILTER (NOT ab), 0) <= 0.05, false) AS unsupported_ok,
coalesce(count(*) FILTER (ab AND NOT sh)::DOUBLE / nullif(count(*) FILTER (NOT sh), 0), 0) <= 0.20 AS over_abstention_ok, coalesce(count(*) FILTER (ab AND sh)::DOUBLE / nullif(count(*) FILTER (sh), 0), 0) >= 0.90 AS recall_ok, count(*) FILTER (NOT ab) > 0 AND count(*) FILTER (NOT ab AND NOT cal) = 0 AS calibrated_ok, percentile_disc(0.95) WITHIN GROUP (ORDER BY ratio) <= 2.0 AS latency_ok FROM f GROUP BY language)
SELECT language, enough_reviewed, enough_answered, both_kinds, unsupported_ok, over_abstention_ok, recall_ok, calibrated_ok, coalesce(ece <= 0.10, false) AS ece_ok, coalesce(latency_ok, false) AS latency_ok,
enough_reviewed AND enough_answered AND both_kinds AND unsupported_ok AND over_abstention_ok AND recall_ok AND calibrated_ok AND coalesce(ece <= 0.10, false) AND coalesce(latency_ok, false) AS passed FROM g LEFT JOIN e USING (language)""")
def pilot_gates(spark, d):
    """The acceptance gates of the full system by language, over the last run of each question that the plain system answered too; a confidence in [0, 1] counts as calibrated."""
    rows = read(spark, d, "records").where("error_text IS NULL AND qid IS NOT NULL AND latency_ms IS NOT NULL").withColumn("language", B.language_label(F.col("language"))).where("language IN ('en', 'hi', 'ta')")
    last = F.struct(F.coalesce("abstained", F.lit(False)).alias("abstained"), F.coalesce("should_abstain", F.lit(False)).alias("should_abstain"), F.coalesce(F.col("hallucination_rate") == 0, F.lit(False)).alias("fully_supported"), "confidence", "latency_ms")
    runs = rows.where("system_name IN ('engine_full', 'vanilla')").groupBy("system_name", "qid", "language").agg(F.max_by(last, F.struct("started_at", "record_id")).alias("x"))
    base = runs.where("system_name = 'vanilla' AND x.latency_ms > 0").select("qid", "language", F.col("x.latency_ms").alias("baseline_latency_ms"))
    full = runs.where("system_name = 'engine_full'").select("qid", "language", "x.*").join(base, ["qid", "language"])
    return evaluation.gates(full.withColumn("calibrated", F.coalesce(F.col("confidence").between(0, 1), F.lit(False))), "language")


_PAIRS = f"r AS (SELECT system_name, {S.group_id('parallel_id', 'qid')} AS gid, {S.language_label('language')} AS language, arg_max({{'v': hallucination_rate, 'c': confidence, 'g': regressed}}, {{'a': started_at, 'b': record_id}}) AS x FROM records WHERE error_text IS NULL AND hallucination_rate IS NOT NULL GROUP BY ALL)"


@query(f"""
WITH {_PAIRS}, p AS (SELECT a.system_name, b.x.v AS before, a.x.v AS after, coalesce(a.x.g, false) AS worse, b.x.c AS cb, a.x.c AS ca FROM r a JOIN r b ON a.gid = b.gid AND a.language = b.language WHERE b.system_name = 'vanilla' AND a.system_name <> 'vanilla')
SELECT system_name, count(*) AS n, round(avg(before), 6) AS before, round(avg(after), 6) AS after, round(CASE WHEN avg(before) <> 0 THEN (avg(before) - avg(after)) / avg(before) ELSE 0 END, 6) AS relative_reduction, round(avg((after < before)::INT), 6) AS improvement_rate, round(avg(worse::INT), 6) AS regression_rate,
round(avg((after < before)::INT) - avg(worse::INT), 6) AS net_improvement, round(coalesce(CASE WHEN avg(cb) <> 0 THEN avg(ca) / avg(cb) END, 1), 6) AS relevance_retention FROM p GROUP BY system_name""")
def correction_effect(spark, d):
    """What each system changes against the plain one on the same question and language, with confidence as the measure that is to be kept."""
    rows = read(spark, d, "records").where("error_text IS NULL AND hallucination_rate IS NOT NULL").select("system_name", B.group_id(F.col("parallel_id"), F.col("qid")).alias("gid"), B.language_label(F.col("language")).alias("language"), "hallucination_rate", "confidence", "regressed", "started_at", "record_id")
    last = rows.groupBy("system_name", "gid", "language").agg(F.max_by(F.struct("hallucination_rate", "confidence", "regressed"), F.struct("started_at", "record_id")).alias("x"))
    base = last.where("system_name = 'vanilla'").select("gid", "language", F.col("x.hallucination_rate").alias("before"), F.col("x.confidence").alias("relevance_before"))
    pairs = last.where("system_name <> 'vanilla'").select("system_name", "gid", "language", F.col("x.hallucination_rate").alias("after"), F.col("x.confidence").alias("relevance_after"), F.col("x.regressed").alias("regressed")).join(base, ["gid", "language"])
    out = evaluation.correction_effect(pairs, ["system_name"])
    return out.select("system_name", "n", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


@query("""
WITH o AS (SELECT system_name, unnest(actions) AS action, coalesce(regressed, false) AS worse, coalesce(hallucination_rate = 0, false) AS better FROM records), c AS (SELECT * FROM o WHERE action NOT IN ('ACCEPT', 'ABSTAIN') OR action IS NULL)
SELECT system_name, count(*) AS attempts, count(*) FILTER (better AND NOT worse) AS improved, count(*) FILTER (worse) AS regressed, count(*) FILTER (NOT better AND NOT worse) AS unchanged, round(count(*) FILTER (better AND NOT worse)::DOUBLE / count(*), 6) AS improvement_rate, round(count(*) FILTER (worse)::DOUBLE / count(*), 6) AS regression_rate FROM c GROUP BY system_name""")
def correction_outcomes(spark, d):
    """Corrections by what became of them: an action of a run without any doubtful claim left counts as accepted."""
    rows = read(spark, d, "records").select("system_name", F.explode("actions").alias("action"), F.coalesce(F.col("hallucination_rate") == 0, F.lit(False)).alias("accepted"), "regressed")
    out = correction.effects(rows, ["system_name"])
    return out.select("system_name", "attempts", "improved", "regressed", "unchanged", F.round("improvement_rate", 6).alias("improvement_rate"), F.round("regression_rate", 6).alias("regression_rate"))


@query("""
WITH r AS (SELECT qid, system_name, row_number() OVER (PARTITION BY qid, system_name ORDER BY started_at, record_id) - 1 AS round, supported AS s, contradicted AS c, unverifiable AS u FROM records WHERE supported IS NOT NULL AND contradicted IS NOT NULL AND unverifiable IS NOT NULL AND qid IS NOT NULL QUALIFY round < 3),
a AS (SELECT qid, system_name, 0 AS kept, s, c, u, 1 AS n FROM r WHERE round = 0),
b AS (SELECT a.qid, a.system_name, a.n + (r.s IS NOT NULL)::INT AS n, CASE WHEN r.s + r.c + r.u > 0 AND {'c': r.c, 'u': r.u, 's': -r.s} < {'c': a.c, 'u': a.u, 's': -a.s} AND r.s >= a.s THEN {'k': 1, 's': r.s, 'c': r.c, 'u': r.u} ELSE {'k': a.kept, 's': a.s, 'c': a.c, 'u': a.u} END AS x FROM a LEFT JOIN r ON r.qid = a.qid AND r.system_name = a.system_name AND r.round = 1),
e AS (SELECT b.qid, b.system_name, b.n + (r.s IS NOT NULL)::INT AS n, CASE WHEN r.s + r.c + r.u > 0 AND {'c': r.c, 'u': r.u, 's': -r.s} < {'c': x.c, 'u': x.u, 's': -x.s} AND r.s >= x.s THEN {'k': 2, 's': r.s, 'c': r.c, 'u': r.u} ELSE x END AS y FROM b LEFT JOIN r ON r.qid = b.qid AND r.system_name = b.system_name AND r.round = 2)
SELECT qid, system_name, y.k::BIGINT AS kept_round, y.s AS supported, y.c AS contradicted, y.u AS unverifiable, n::BIGINT AS n_rounds FROM e""")
def correction_rounds(spark, d):
    """The first three runs of a question by a system taken as rounds of correction: which one is kept."""
    rows = read(spark, d, "records").where("supported IS NOT NULL AND contradicted IS NOT NULL AND unverifiable IS NOT NULL AND qid IS NOT NULL").select("qid", "system_name", "started_at", "record_id", "supported", "contradicted", "unverifiable")
    first = top_k(rows, ["qid", "system_name"], [F.col("started_at"), F.col("record_id")], 3, "round").withColumn("run", F.struct("qid", "system_name"))
    out = correction.rounds(first, "run")
    return out.select("run.qid", "run.system_name", F.col("kept_round").cast("long").alias("kept_round"), "supported", "contradicted", "unverifiable", F.col("n_rounds").cast("long").alias("n_rounds"))


@query()
def calibration_interval(spark, d):
    """Calibration error of each system with its bootstrap interval."""
    return evaluation.calibration_interval(scored(spark, d), ["system_name"])


@query()
def experiment_intervals(spark, d):
    """Hallucination rate of answered runs by system and language with its interval."""
    rows = read(spark, d, "records").where("error_text IS NULL AND NOT coalesce(abstained, false)").select("system_name", B.language_label(F.col("language")).alias("language"), "hallucination_rate")
    return evaluation.bootstrap_mean(rows, ["system_name", "language"], "hallucination_rate")


# ---------------------------------------------------------------- question sets

def _issue_sql() -> str:
    blank = lambda c: f"trim(coalesce({c}::VARCHAR, '')) = ''"
    missing = "concat_ws(',', " + ", ".join(f"CASE WHEN {blank(c)} THEN '{c}' END" for c in review.REQUIRED) + ")"
    rules = [
        ("language NOT IN ('en', 'hi', 'ta')", "unknown language"), ("answerability NOT IN ('A', 'B', 'C', 'D')", "unknown answerability"), ("split NOT IN ('train', 'dev', 'test')", "unknown split"),
        ("provenance NOT IN ('human_authored', 'mt_verified', 'mt_raw')", "unknown provenance"), ("coalesce(script, 'native') NOT IN ('native', 'roman')", "unknown script"), ("script = 'roman' AND language = 'en'", "english cannot be romanised"),
        ("should_abstain IS NOT NULL AND should_abstain <> (answerability IN ('C', 'D'))", "should_abstain contradicts answerability"), ("answerability IN ('A', 'B') AND len(coalesce(gold_chunk_ids, [])) = 0", "answerable without gold chunks"),
        ("answerability = 'C' AND len(coalesce(gold_chunk_ids, [])) > 0", "out of scope with gold chunks"), (f"answerability IN ('A', 'B') AND {blank('gold_answer')}", "no gold answer"), ("provenance = 'mt_raw' AND split = 'test'", "unverified translation in test"),
        ("provenance <> 'human_authored' AND NOT coalesce(qc.human_reviewed, false)", "translation without review"), (blank("dataset_version"), "no dataset version"),
    ]
    own = " UNION ALL ".join(f"SELECT row_id, '{m}' AS issue FROM q WHERE missing = '' AND ({c})" for c, m in rules)
    return f"""WITH q AS (SELECT *, {missing} AS missing FROM questions), i AS (SELECT row_id, 'missing ' || missing AS issue FROM q WHERE missing <> '' UNION ALL {own}
UNION ALL SELECT row_id, 'duplicate qid' FROM (SELECT row_id, min(row_id) OVER (PARTITION BY qid) AS f FROM q WHERE missing = '') WHERE row_id > f
UNION ALL SELECT DISTINCT row_id, 'gold chunk not in corpus' FROM (SELECT row_id, unnest(gold_chunk_ids) AS c FROM questions) WHERE c NOT IN (SELECT chunk_id FROM chunks WHERE chunk_id IS NOT NULL))"""


@query(_issue_sql() + " SELECT row_id, issue FROM i")
def validate_questions(spark, d):
    return review.question_issues(read(spark, d, "questions"), read(spark, d, "chunks").where("chunk_id IS NOT NULL"))


@query("SELECT DISTINCT row_id, c AS chunk_id FROM (SELECT row_id, unnest(gold_chunk_ids) AS c FROM questions) WHERE c NOT IN (SELECT chunk_id FROM chunks WHERE chunk_id IS NOT NULL)")
def dangling_gold(spark, d):
    return review.dangling_gold(read(spark, d, "questions"), read(spark, d, "chunks").where("chunk_id IS NOT NULL"))


@query(f"""
WITH r AS (SELECT {S.group_id('parallel_id', 'qid')} AS g, {S.split_label('split')} AS s, {S.answerability_label('answerability')} AS a, {S.label('question_type')} AS k, domain AS d, {S.language_label('language')} AS l, coalesce(script, 'native') = 'native' AS nat, qid FROM questions),
a AS (SELECT g, count(DISTINCT s) AS ns, count(DISTINCT a) AS na, count(DISTINCT k) AS nk, count(DISTINCT d) AS nd, count(DISTINCT qid) FILTER (nat AND l = 'en') AS e, count(DISTINCT qid) FILTER (nat AND l = 'hi') AS h, count(DISTINCT qid) FILTER (nat AND l = 'ta') AS t FROM r WHERE g IS NOT NULL GROUP BY g)
SELECT g AS parallel_id, 'split differs' AS issue FROM a WHERE ns > 1 UNION ALL SELECT g, 'answerability differs' FROM a WHERE na > 1 UNION ALL SELECT g, 'question_type differs' FROM a WHERE nk > 1 UNION ALL SELECT g, 'domain differs' FROM a WHERE nd > 1
UNION ALL SELECT g, 'several native rows of a language' FROM a WHERE e > 1 OR h > 1 OR t > 1 UNION ALL SELECT g, 'no native row for ' || concat_ws(',', CASE WHEN e = 0 THEN 'en' END, CASE WHEN h = 0 THEN 'hi' END, CASE WHEN t = 0 THEN 'ta' END) FROM a WHERE e = 0 OR h = 0 OR t = 0""")
def group_consistency(spark, d):
    return review.group_issues(read(spark, d, "questions"))


_PLAN = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in L.ANSWERABILITY_SHARE.items())


@query(f"""
WITH c AS (SELECT {S.answerability_label('answerability')} AS category, count(*) AS n FROM questions GROUP BY 1), p(category, planned) AS (VALUES {_PLAN})
SELECT p.category, planned, round(coalesce(n, 0)::DOUBLE / (SELECT sum(n) FROM c WHERE category IS NOT NULL), 6) AS share, abs(coalesce(n, 0)::DOUBLE / (SELECT sum(n) FROM c WHERE category IS NOT NULL) - planned) > 0.1 AS off_plan FROM p LEFT JOIN c USING (category)""")
def balance_check(spark, d):
    return review.balance(read(spark, d, "questions"), B.answerability_label(F.col("answerability")), L.ANSWERABILITY_SHARE)


@query(f"""
WITH q AS (SELECT row_id, qid, {S.group_id('parallel_id', 'qid')} AS group_key, lower(question) AS question_key, {S.split_label('split')} AS s FROM questions), t AS (SELECT * FROM q WHERE s = 'train'), e AS (SELECT * FROM q WHERE s = 'dev')
SELECT 'qid' AS key_name, count(*) AS n FROM e WHERE qid IN (SELECT qid FROM t WHERE qid IS NOT NULL) UNION ALL SELECT 'group_key', count(*) FROM e WHERE group_key IN (SELECT group_key FROM t WHERE group_key IS NOT NULL) UNION ALL SELECT 'question_key', count(*) FROM e WHERE question_key IN (SELECT question_key FROM t WHERE question_key IS NOT NULL)""")
def split_leakage(spark, d):
    q = read(spark, d, "questions").select("qid", B.group_id(F.col("parallel_id"), F.col("qid")).alias("group_key"), F.lower("question").alias("question_key"), B.split_label(F.col("split")).alias("s"))
    return review.leaks_between(q.where("s = 'train'"), q.where("s = 'dev'"), ["qid", "group_key", "question_key"])


@query(f"""
WITH q AS (SELECT row_id, {S.group_id('parallel_id', 'qid')} AS g, {S.language_label('language')} AS l, nullif(trim(gold_answer), '') AS gold, should_abstain FROM questions), e AS (SELECT g, min(gold) AS gold FROM q WHERE l = 'en' AND gold IS NOT NULL GROUP BY g)
SELECT row_id, CASE WHEN q.gold IS NOT NULL THEN q.gold WHEN e.gold IS NOT NULL THEN '(en reference) ' || e.gold ELSE '(should abstain)' END AS reference FROM q LEFT JOIN e USING (g)""")
def reference_answers(spark, d):
    """The answer to mark against: the own one, else that of the English row of the group, else that the system should abstain."""
    q = read(spark, d, "questions").select("row_id", B.group_id(F.col("parallel_id"), F.col("qid")).alias("g"), B.language_label(F.col("language")).alias("l"), F.nullif(F.trim("gold_answer"), F.lit("")).alias("gold"))
    en = q.where("l = 'en' AND gold IS NOT NULL").groupBy("g").agg(F.min("gold").alias("en_gold"))
    own = q.where("gold IS NOT NULL").select("row_id", F.col("gold").alias("reference"))
    # Only rows without an answer of their own meet the groups, dealt out so that no task has all rows of a large one.
    lent = F.coalesce(F.concat(F.lit("(en reference) "), F.col("en_gold")), F.lit("(should abstain)"))
    salts = 8
    need = q.where("gold IS NULL").select("row_id", "g", F.pmod(F.xxhash64("row_id"), F.lit(salts)).alias("salt"))
    en = en.join(need.select("g").distinct(), "g", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return own.unionByName(need.join(en, ["g", "salt"], "left").select("row_id", lent.alias("reference")))


@query("SELECT record_id, qid FROM records r WHERE NOT EXISTS (SELECT 1 FROM annotation_events a WHERE a.qid = r.qid)")
def cache_antijoin(spark, d):
    """Runs whose question has no entry in the log yet: what a resumed job still has to do."""
    done = read(spark, d, "annotation_events").select("qid").where("qid IS NOT NULL").distinct()
    return read(spark, d, "records").select("record_id", "qid").join(done, "qid", "left_anti").select("record_id", "qid")


@query(f"""
WITH {CORPUS}, i AS (SELECT item_id, min(seq) AS seq FROM annotation_events WHERE event_type = 'item' GROUP BY item_id), e AS (SELECT item_id, unnest(evidence) AS chunk_id FROM annotation_events JOIN i USING (item_id, seq))
SELECT item_id, count(*) AS cited, count(*) FILTER (corpus.chunk_id IS NULL) AS missing FROM e LEFT JOIN corpus USING (chunk_id) GROUP BY item_id""")
def review_packet(spark, d):
    """Evidence of each annotation item resolved against the corpus, with the ids that cannot be."""
    ev = read(spark, d, "annotation_events").where("event_type = 'item'").select("item_id", "seq", "evidence")
    first = ev.groupBy("item_id").agg(F.min_by("evidence", "seq").alias("evidence"))
    ids = corpus(spark, d).select("chunk_id", F.lit(True).alias("there"))
    rows = first.select("item_id", F.explode("evidence").alias("chunk_id")).join(ids, "chunk_id", "left")
    return rows.groupBy("item_id").agg(F.count("*").alias("cited"), F.count_if(F.col("there").isNull()).alias("missing"))


# ---------------------------------------------------------------- evidence views

@query(f"""
WITH RECURSIVE {_claims_sql()}, n AS (SELECT a.record_id, claim_ord, lower(answer) AS low, lower(regexp_replace(trim(claim), '[.।!?]+$', '')) AS n FROM ans a JOIN claim USING (record_id) WHERE length(lower(answer)) = length(answer)),
p AS (SELECT record_id, claim_ord, strpos(low, n) - 1 AS a, strpos(low, n) - 1 + length(n) AS e, length(n) >= 6 AND strpos(low, n) > 0 AS usable FROM n),
r AS (SELECT record_id, claim_ord, CASE WHEN usable THEN [{{'a': a, 'e': e, 'c': claim_ord}}] ELSE [] END AS acc FROM p WHERE claim_ord = 0
UNION ALL SELECT p.record_id, p.claim_ord, CASE WHEN p.usable AND len(list_filter(r.acc, lambda x: p.a < x.e AND p.e > x.a)) = 0 THEN list_append(r.acc, {{'a': p.a, 'e': p.e, 'c': p.claim_ord}}) ELSE r.acc END FROM r JOIN p ON p.record_id = r.record_id AND p.claim_ord = r.claim_ord + 1),
last AS (SELECT record_id, arg_max(acc, claim_ord) AS acc FROM r GROUP BY record_id)
SELECT record_id, x.c AS claim_no, x.a AS start, x.e AS "end" FROM (SELECT record_id, unnest(acc) AS x FROM last)""")
def anchor_claims(spark, d):
    """Where each claim stands in its answer."""
    rows = answers(spark, d).select("record_id", "answer", claims.decompose(F.col("answer"), F.col("language")).alias("c"))
    return rows.select("record_id", F.explode_outer(review.anchors(F.col("answer"), F.col("c"))).alias("a")).where("a IS NOT NULL").select("record_id", "a.claim_no", "a.start", "a.end")


@query(_verdict_sql("support") + """, c AS (SELECT record_id, claim_ord, unnest(string_split(citations, ',')) AS chunk_id FROM res WHERE citations <> '')
SELECT chunk_id, count(*) AS claims_citing, count(DISTINCT record_id) AS answers_citing FROM c GROUP BY chunk_id""")
def inverse_citations(spark, d):
    """For each chunk how many claims and answers cite it."""
    rows = verdicts(spark, d).select("record_id", "claim_ord", F.explode("citations").alias("chunk_id"))
    return rows.groupBy("chunk_id").agg(F.count("*").alias("claims_citing"), F.count_distinct("record_id").alias("answers_citing"))


def _evidence_sql() -> str:
    words = lambda t: f"regexp_extract_all({t}, '[\\p{{L}}\\p{{M}}\\p{{N}}]+')"
    kept = lambda t: f"list_filter({words(t)}, lambda w: regexp_matches(w, '\\p{{N}}') OR (length(w) >= 3 AND NOT list_contains({S._list(L.EVIDENCE_STOP)}, w)))"
    return _verdict_sql("support") + f""", c AS (SELECT res.record_id, res.claim_ord, claim.claim, string_split(citations, ',')[1] AS chunk_id FROM res JOIN claim USING (record_id, claim_ord) WHERE verdict = 'CONTRADICTED'),
s AS (SELECT c.*, list_filter(string_split(regexp_replace(text, '([.!?।॥])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS ss, list_distinct({kept('lower(claim)')}) AS mine, {words('lower(claim)')} AS said FROM c JOIN corpus USING (chunk_id)),
u AS (SELECT *, unnest(ss) AS sentence, generate_subscripts(ss, 1) AS i FROM s), h AS (SELECT *, len(list_filter({kept('lower(sentence)')}, lambda w: list_contains(mine, w))) AS hits, {words('lower(sentence)')} AS ws FROM u),
b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY record_id, claim_ord ORDER BY hits DESC, i) = 1)
SELECT record_id, claim_ord, chunk_id, sentence, hits, array_to_string(list_filter(odd, lambda x, k: list_position(odd, x) = k), ' ') AS extra FROM (SELECT *, list_filter(ws, lambda w: (regexp_full_match(w, '\\p{{N}}+') OR list_contains({S._list(L.EVIDENCE_NEGATIONS)}, w)) AND NOT list_contains(said, w)) AS odd FROM b WHERE hits > 0)"""


@query(_evidence_sql())
def evidence_diff(spark, d):
    """For every contradicted claim the sentence it is judged by and what that has and the claim lacks."""
    v = verdicts(spark, d).where("verdict = 'CONTRADICTED'").select("record_id", "claim_ord", "claim", F.element_at("citations", 1).alias("chunk_id"))
    rows = review.evidence_difference(v.join(corpus(spark, d).select("chunk_id", "text"), "chunk_id"), "text", "claim")
    return rows.where("x IS NOT NULL").select("record_id", "claim_ord", "chunk_id", "x.sentence", "x.hits", F.array_join("x.extra", " ").alias("extra"))


@query("""
SELECT record_id, CASE WHEN system_name = 'vanilla' AND flagged > 0 THEN 'audit_flagged' WHEN system_name = 'vanilla' THEN 'audit_clear' WHEN ab THEN 'withheld' WHEN n_claims > 0 AND flagged = 0 THEN 'supported' ELSE 'needs_review' END AS outcome
FROM (SELECT record_id, system_name, coalesce(abstained, false) AS ab, coalesce(n_claims, 0) AS n_claims, coalesce(contradicted, 0) + coalesce(unverifiable, 0) AS flagged FROM records)""")
def answer_outcome(spark, d):
    rows = read(spark, d, "records").fillna(0, ["n_claims", "contradicted", "unverifiable"])
    return rows.select("record_id", review.outcome(F.col("system_name") == "vanilla", F.coalesce("abstained", F.lit(False)), F.col("n_claims"), F.col("contradicted") + F.col("unverifiable")).alias("outcome"))


# ---------------------------------------------------------------- events

from ..streaming import limits  # noqa: E402


@query("""
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start, count(*) AS n FROM s GROUP BY user_id, no""")
def sessions_30m(spark, d):
    out = limits.sessions(limits.timed(read(spark, d, "events")))
    return out.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("session_start"), "n")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS in_window FROM events")
def visitor_window_60s(spark, d):
    return limits.sliding_counts(read(spark, d, "events")).select("event_id", "in_window")


@query("SELECT event_id, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS place FROM events")
def daily_budget(spark, d):
    return limits.daily_places(read(spark, d, "events")).select("event_id", F.col("place").cast("long").alias("place"))


@query("SELECT coalesce(event_type, 'other') AS event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def request_metrics(spark, d):
    return limits.request_metrics(read(spark, d, "events"))


@query("""
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT event_id, user_id, k, [t] AS last, true AS admitted FROM e WHERE k = 1
UNION ALL SELECT event_id, user_id, k, CASE WHEN len(f) < 2 THEN list_append(f, t) ELSE f END, len(f) < 2 FROM (SELECT e.event_id, e.user_id, e.k, e.t, list_filter(r.last, lambda x: x > e.t - 600000000) AS f FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1))
SELECT event_id, user_id, admitted FROM r""")
def admitted_requests(spark, d):
    """At most two requests of a visitor in ten minutes; refused ones do not count."""
    return limits.admitted(read(spark, d, "events"), 2, 600).select("event_id", "user_id", "admitted")


# ---------------------------------------------------------------- further views of questions, runs and labels

_CASES = f"q AS (SELECT row_id, {S.answerability_label('answerability')} AS cls, evidence_languages AS el FROM questions), l(document_language) AS (VALUES ('en'), ('hi'), ('ta'))"


@query(f"""
WITH {_CASES} SELECT row_id, document_language, CASE WHEN NOT coalesce(CASE WHEN el IS NULL THEN cls IN ('A', 'B') ELSE list_contains(el, document_language) END, false) THEN 'abstain' WHEN cls = 'B' THEN 'partial' ELSE 'answer' END AS expected FROM q, l""")
def crosslingual_cases(spark, d):
    """Every question against documents of each language, with what a right system does."""
    rows = read(spark, d, "questions").select("row_id", B.answerability_label(F.col("answerability")).alias("cls"), "evidence_languages", F.explode(F.array(*[F.lit(x) for x in ("en", "hi", "ta")])).alias("document_language"))
    return rows.select("row_id", "document_language", review.expected_behaviour(F.col("cls"), F.col("evidence_languages"), F.col("document_language")).alias("expected"))


@query(f"""
WITH q AS (SELECT row_id, {S.group_id('parallel_id', 'qid')} AS g FROM questions), f AS (SELECT g, min(row_id) AS o FROM q WHERE g IS NOT NULL GROUP BY g ORDER BY o, g LIMIT 20) SELECT row_id, g AS parallel_id FROM q WHERE g IN (SELECT g FROM f)""")
def group_head(spark, d):
    """All rows of the first twenty groups."""
    rows = read(spark, d, "questions").select("row_id", B.group_id(F.col("parallel_id"), F.col("qid")).alias("parallel_id"))
    return review.group_head(rows, "parallel_id", "row_id", 20).select("row_id", "parallel_id")


@query(f"SELECT row_id, language, place FROM (SELECT row_id, {_QLANG} AS language, row_number() OVER (PARTITION BY {_QLANG} ORDER BY row_id) - 1 AS place FROM questions) WHERE place < 10")
def language_head(spark, d):
    """The first ten rows of each language."""
    rows = read(spark, d, "questions").select("row_id", B.language_label(F.col("language")).alias("language"))
    return top_k(rows, ["language"], [F.col("row_id")], 10).select("row_id", "language", F.col("place").cast("long").alias("place"))


@query("""
SELECT seq, CASE WHEN l = 'SUPPORTED' THEN 0.9 WHEN l IN ('CONTRADICTED', 'UNVERIFIABLE') THEN 0.05 ELSE 0 END::DOUBLE AS entailment, CASE WHEN l = 'CONTRADICTED' THEN 0.9 WHEN l IN ('SUPPORTED', 'UNVERIFIABLE') THEN 0.05 ELSE 0 END::DOUBLE AS contradiction,
CASE WHEN l = 'UNVERIFIABLE' THEN 0.9 WHEN l IN ('SUPPORTED', 'CONTRADICTED') THEN 0.05 ELSE 1 END::DOUBLE AS neutral FROM (SELECT seq, upper(trim(label)) AS l FROM annotation_events WHERE event_type = 'annotation')""")
def label_scores(spark, d):
    """The labels of judges as scores."""
    rows = read(spark, d, "annotation_events").where("event_type = 'annotation'").select("seq", claims.label_scores(F.col("label")).alias("s"))
    return rows.select("seq", *[F.round(f"s.{c}", 6).alias(c) for c in ("entailment", "contradiction", "neutral")])


@query("""
WITH r AS (SELECT record_id, coalesce(abstained, false) AS ab, coalesce(should_abstain, false) AS sh, n_claims, supported, contradicted, coalesce(gold_chunk_ids, []) AS g, coalesce(retrieved_chunk_ids, []) AS t FROM records WHERE error_text IS NULL)
SELECT record_id, 'unanswerable_question_answered' AS failure FROM r WHERE sh AND NOT ab UNION ALL SELECT record_id, 'answerable_question_not_answered' FROM r WHERE NOT sh AND ab UNION ALL SELECT record_id, 'answer_not_fully_supported' FROM r WHERE NOT ab AND n_claims > 0 AND supported < n_claims
UNION ALL SELECT record_id, 'contradiction_released' FROM r WHERE NOT ab AND contradicted > 0 UNION ALL SELECT record_id, 'gold_evidence_not_retrieved' FROM r WHERE NOT ab AND len(list_filter(g, lambda x: NOT list_contains(t, x))) > 0 UNION ALL SELECT record_id, 'nothing_retrieved' FROM r WHERE len(t) = 0""")
def run_failures(spark, d):
    r = read(spark, d, "records").where("error_text IS NULL")
    none = F.array().cast("array<string>")
    flags = review.run_failures(F.coalesce("abstained", F.lit(False)), F.coalesce("should_abstain", F.lit(False)), F.col("n_claims"), F.col("supported"), F.col("contradicted"), F.coalesce("gold_chunk_ids", none), F.coalesce("retrieved_chunk_ids", none))
    return r.select("record_id", F.explode_outer(flags).alias("failure")).where("failure IS NOT NULL")


@query(_variant_sql().split("l AS (SELECT query_id, chunk_id, 0 AS list_no")[0] + f"""l AS (SELECT query_id, chunk_id, 0 AS v, place, score FROM top UNION ALL SELECT query_id, chunk_id, 1, place, score FROM top2),
n AS (SELECT row_id AS query_id, 1 + (trim(coalesce(gold_answer, '')) <> '')::INT AS n FROM questions WHERE row_id % {QUERY_SET} = 0 AND question IS NOT NULL),
f AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (61 + place)) / (any_value(n) / 61.0::DOUBLE), 10) AS fused, max(score) AS score, min({{'a': v, 'b': place}}) AS seen FROM l JOIN n USING (query_id) GROUP BY ALL)
SELECT query_id, chunk_id, fused, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, seen, chunk_id) - 1 AS place FROM f) WHERE place < 5""")
def fuse_variants(spark, d):
    """The results of a question and of its reference answer as variants of one query, empty results counted in the scale."""
    a, b = _variants(spark, d)
    both = a.withColumn("variant", F.lit(0)).unionByName(b.withColumn("variant", F.lit(1))).persist()
    rows = read(spark, d, "questions").where(f"row_id % {QUERY_SET} = 0 AND question IS NOT NULL")
    asked = F.array_compact(F.array(F.lit(0), F.when(F.trim("gold_answer") != "", 1)))
    out = retrieval.fuse_variants(both, rows.select(F.col("row_id").alias("query_id"), F.explode(asked).alias("variant")))
    return out.select("query_id", "chunk_id", "fused", "score", F.col("place").cast("long").alias("place"))


_N_PAIR = 2


@query("""
WITH r AS (SELECT item_id, list(upper(trim(label)) ORDER BY seq) AS ls FROM annotation_events WHERE event_type = 'annotation' AND item_id IS NOT NULL AND label IS NOT NULL GROUP BY item_id)
SELECT item_id, len(ls) = 2 AND len(list_filter(ls, lambda x: x NOT IN ('SUPPORTED', 'CONTRADICTED', 'UNVERIFIABLE'))) = 0 AS readable, CASE WHEN len(ls) = 2 AND len(list_filter(ls, lambda x: x NOT IN ('SUPPORTED', 'CONTRADICTED', 'UNVERIFIABLE'))) = 0 THEN array_to_string(ls, ',') END AS labels FROM r""")
def batch_replies(spark, d):
    """The labels of an item as one numbered reply to two questions: read whole or not at all."""
    rows = read(spark, d, "annotation_events").where("event_type = 'annotation' AND item_id IS NOT NULL AND label IS NOT NULL")
    said = rows.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "label"))), lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), F.trim(x["label"]))).alias("lines"))
    got = said.select("item_id", claims.batch_labels(F.array_join("lines", "\n"), _N_PAIR, review.VERDICTS).alias("l"))
    return got.select("item_id", F.col("l").isNotNull().alias("readable"), F.array_join("l", ",").alias("labels"))


@query("""
WITH i AS (SELECT item_id, arg_min(evidence, seq) AS evidence FROM annotation_events WHERE event_type = 'item' AND item_id IS NOT NULL GROUP BY item_id),
a AS (SELECT item_id, arg_max(label, seq) AS reply, arg_max(CASE WHEN confidence IS NOT NULL THEN confidence ELSE 0 END, CASE WHEN label IS NOT NULL THEN seq END) AS sure FROM annotation_events WHERE event_type = 'annotation' AND source = 'llm' GROUP BY item_id),
x AS (SELECT item_id, coalesce(len(evidence), 0) = 0 AS bare, list_distinct(regexp_extract_all(upper(coalesce(reply, '')), '\\b(SUPPORTED|CONTRADICTED|UNVERIFIABLE)\\b')) AS named, sure FROM i LEFT JOIN a USING (item_id))
SELECT item_id, CASE WHEN bare OR len(named) <> 1 THEN 'UNVERIFIABLE' ELSE named[1] END AS label, CASE WHEN bare THEN 1 WHEN len(named) <> 1 THEN 0 ELSE coalesce(sure, 0) END::DOUBLE AS confidence FROM x""")
def proposed_labels(spark, d):
    """The label that a judge's last reply proposes for each item."""
    ev = read(spark, d, "annotation_events")
    items = ev.where("event_type = 'item' AND item_id IS NOT NULL").groupBy("item_id").agg(F.min_by("evidence", "seq").alias("evidence"))
    said = ev.where("event_type = 'annotation' AND source = 'llm' AND label IS NOT NULL").groupBy("item_id").agg(F.max_by(F.struct(F.col("label").alias("reply"), F.coalesce("confidence", F.lit(0.0)).alias("reply_confidence")), "seq").alias("r"))
    return review.proposed_labels(items.join(said, "item_id", "left").select("item_id", "evidence", "r.reply", "r.reply_confidence"))


@query("""
WITH l AS (SELECT doc_id, text, list_filter(list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda x: trim(regexp_replace(x, '^[ \t\n\v\f\r]*(?:[-*•]|[0-9]+[.)])[ \t\n\v\f\r]*', ''))), lambda c: length(c) >= 8 AND regexp_matches(c, '[\\p{L}\\p{N}]')) AS k FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, k, contains(upper(text), 'NO_CLAIMS') AS none, list_sum(list_transform(k, lambda c: length(c))) > greatest(60, 2 * length(text)) AS big FROM l)
SELECT doc_id, CASE WHEN none THEN 0 WHEN len(k) = 0 OR len(k) >= 20 OR coalesce(big, false) THEN NULL ELSE len(k) END::BIGINT AS n_claims, CASE WHEN none THEN md5('') WHEN len(k) = 0 OR len(k) >= 20 OR coalesce(big, false) THEN NULL ELSE md5(array_to_string(k, chr(10))) END AS claims_md5 FROM m""")
def claim_lines(spark, d):
    """Documents read as a decomposer's replies, one claim a line; NULL where the reply asks for the rule-based way."""
    rows = texts(spark, d, "documents", "doc_id", "text").where("text IS NOT NULL").select("doc_id", claims.claim_lines(F.col("text"), F.col("text")).alias("c"))
    return rows.select("doc_id", F.when(F.col("c").isNotNull(), F.size("c")).cast("long").alias("n_claims"), F.md5(F.array_join("c", "\n")).alias("claims_md5"))


@query("""
WITH e AS (SELECT event_id, event_type, value, ts, count(*) OVER w AS n, sum(value) OVER w AS v, row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS p FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW))
SELECT event_id, n <= 28 AS minute_ok, round(v, 6) <= 950 AS amount_ok, p <= 950 AS day_ok FROM e""")
def provider_limits(spark, d):
    """Each event type taken as a provider with 30 requests and an amount of 1,000 a minute and 1,000 requests a day, less five per cent."""
    return limits.within_limits(read(spark, d, "events"), 30, 1000, 1000, "event_type", "value").select("event_id", "minute_ok", "amount_ok", "day_ok")


@query("""
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, CAST(ts AS DATE) AS d, row_number() OVER (ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT event_id, user_id, k, d, 1 AS used, [{'u': user_id, 't': t}] AS last, true AS admitted FROM e WHERE k = 1
UNION ALL SELECT event_id, user_id, k, d, used + ok::INT, CASE WHEN ok THEN list_append(f, {'u': user_id, 't': t}) ELSE f END, ok FROM (SELECT *, used < 300 AND len(list_filter(f, lambda x: x.u = user_id)) < 2 AS ok
 FROM (SELECT e.event_id, e.user_id, e.k, e.d, e.t, CASE WHEN e.d = r.d THEN r.used ELSE 0 END AS used, list_filter(r.last, lambda x: x.t > e.t - 600000000) AS f FROM r JOIN e ON e.k = r.k + 1)))
SELECT event_id, user_id, admitted FROM r""")
def shared_budget(spark, d):
    """At most two requests of a visitor in ten minutes and 300 of all visitors in a day."""
    return limits.admitted_with_budget(read(spark, d, "events"), 2, 600, 300).select("event_id", "user_id", "admitted")


def _feature_sql() -> str:
    bag = lambda t: f"list_distinct(list_filter(regexp_split_to_array(lower({t}), '\\s+'), lambda w: w <> ''))"
    jac = lambda a, b: f"CASE WHEN len(list_distinct(list_concat({a}, {b}))) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) ELSE 1 END"
    return _verdict_sql("support") + _DET + f""", g AS (SELECT qid, min(gold_answer) AS g1, max(gold_answer) AS g2 FROM questions WHERE trim(coalesce(gold_answer, '')) <> '' GROUP BY qid),
w AS (SELECT r.record_id, len(coalesce(retrieved_chunk_ids, [])) AS k, g1 IS NOT NULL AS two, {bag('answer')} AS a, {bag('g1')} AS b, {bag('g2')} AS c, len(list_filter(regexp_split_to_array(answer, '\\s+'), lambda w: w <> '')) AS n_words FROM records r LEFT JOIN g USING (qid) WHERE answer IS NOT NULL),
x AS (SELECT *, CASE WHEN two THEN ({jac('a', 'b')} + {jac('a', 'c')} + {jac('b', 'c')}) / 3 ELSE 0 END AS sc, list_sum(list_transform(range(1, k + 1), lambda i: 61.0::DOUBLE / (60 + i))) AS total FROM w)
SELECT record_id, CASE WHEN k > 0 THEN 1 ELSE 0 END::DOUBLE AS s1_top_score, round(CASE WHEN k > 1 THEN 1 - 61.0::DOUBLE / 62 ELSE 0 END, 6) AS s1_score_margin, round(coalesce(total / nullif(k, 0), 0), 6) AS s1_mean_score, k::DOUBLE AS s1_n_chunks,
round(coalesce(s::DOUBLE / n, 0), 6) AS s2_supported_ratio, round(coalesce(det.c::DOUBLE / n, 0), 6) AS s2_contradicted_ratio, round(coalesce(u::DOUBLE / n, 0), 6) AS s2_unverifiable_ratio, round(coalesce(mm, 0), 6) AS s2_mean_margin, round(coalesce(mn, 0), 6) AS s2_min_margin, coalesce(n, 0)::DOUBLE AS s2_n_claims,
NULL::DOUBLE AS s3_mean_logprob, NULL::DOUBLE AS s3_perplexity, round(sc, 6) AS s4_self_consistency, round(1 - sc, 6) AS s4_dispersion, CASE WHEN two THEN 2 ELSE 0 END::DOUBLE AS s4_n_samples, (two AND n_words >= 4)::INT::DOUBLE AS s4_reliable, n_words::DOUBLE AS answer_tokens FROM x LEFT JOIN det USING (record_id)"""


@query(_feature_sql())
def feature_rows(spark, d):
    """The 17 signals of every answer in their fixed order: what was retrieved, the verdicts, no log-probabilities, and the reference answers as further samples. NULL is absent, which is not 0."""
    rows = read(spark, d, "records").where("answer IS NOT NULL").select("record_id", "qid", "answer", F.size("retrieved_chunk_ids").alias("k"))
    gold = read(spark, d, "questions").where("trim(gold_answer) <> ''").groupBy("qid").agg(F.array(F.min("gold_answer"), F.max("gold_answer")).alias("samples"))
    rows = rows.join(claims.detection(verdicts(spark, d), "record_id"), "record_id", "left").join(gold, "qid", "left")
    k = F.greatest("k", F.lit(0))
    places = F.transform(F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>")), lambda i: (L.RRF_K + 1) / (L.RRF_K + i))
    s1 = {"s1_top_score": F.when(k > 0, 1.0).otherwise(0.0), "s1_score_margin": F.when(k > 1, 1 - places[1]).otherwise(0.0), "s1_mean_score": F.when(k > 0, F.aggregate(places, F.lit(0.0), lambda a, b: a + b) / k).otherwise(0.0), "s1_n_chunks": k}
    s2 = {f"s2_{n}": F.coalesce(n, F.lit(0.0)) for n in ("supported_ratio", "contradicted_ratio", "unverifiable_ratio", "mean_margin", "min_margin")} | {"s2_n_claims": F.coalesce("n_claims", F.lit(0))}
    s4 = X.consistency_signals(F.col("answer"), F.coalesce("samples", F.array().cast("array<string>")))
    return rows.select("record_id", *[F.round(c, 6).alias(n) for c, n in zip(confidence.feature_row(s1 | s2 | s4), confidence.SIGNALS)])
