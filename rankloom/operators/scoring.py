"""Relational TF-IDF and BM25: fits are aggregates over exploded terms, scores are term joins.

For BM25 documents are tokenised once, into a term table in the shared folder that statistics and scores are read from;
for TF-IDF twice, once for the vocabulary and once for weights within it, as a table of all runs of words would be
larger than the texts. Term tables are cut to the terms that can matter before pairs are formed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom import shared
from rankloom.functions import order, text

K1, B = 1.5, 0.75
#: A short list; pass the full one of your choice as a parameter.
STOP_WORDS = tuple(
    "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down "
    "during each few for from further had has have having he her here hers him his how i if in into is it its itself me more most my no nor not of off on "
    "once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until "
    "up very was we were what when where which while who whom why will with would you your".split()
)


def _runs(k: int):
    """All runs of k of the words in _w, repeats included."""
    n = F.size("_w")
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.array_join(F.slice("_w", i, k), " "))).otherwise(F.array().cast("array<string>"))


def terms(docs: DataFrame, ident: str, ngrams: int = 1, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """ident, term, tf of each document; n-grams are formed after stop words are dropped."""
    found = text.tokens(F.col("text"))
    if stop_words:
        found = F.filter(found, lambda w: ~w.isin(*stop_words))
    words = docs.select(ident, (text.once(found) if ngrams > 1 else found).alias("_w"))
    if ngrams > 1:
        words = words.select(ident, F.concat("_w", *(_runs(k) for k in range(2, ngrams + 1))).alias("_w"))
    return words.select(ident, F.explode("_w").alias("term")).groupBy(ident, "term").agg(F.count("*").alias("tf"))


def term_table(docs: DataFrame, ident: str) -> DataFrame:
    """ident, size (tokens of the document), term, tf, written once: all that BM25 needs of the documents."""
    words = docs.select(ident, text.once(text.tokens(F.col("text"))).alias("_w")).select(ident, F.size("_w").alias("size"), F.explode("_w").alias("term"))
    return shared.kept(words.groupBy(ident, "size", "term").agg(F.count("*").alias("tf")), "terms")


def bm25_statistics(docs: DataFrame, ident: str, table: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(term, df, idf) and one row (n, avgdl) of distinct documents; negative idf becomes a quarter of the mean."""
    found = term_table(docs, ident) if table is None else table
    size = docs.select(F.count("*").alias("n")).crossJoin(F.broadcast(found.agg(F.sum("tf").alias("_t")))).select("n", (F.col("_t") / F.col("n")).alias("avgdl"))
    df = shared.kept(found.groupBy("term").agg(F.count("*").alias("df")), "document_counts")
    raw = df.crossJoin(F.broadcast(size)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("_mean"))  # one row
    idf = raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, 0.25 * F.col("_mean")).otherwise(F.col("raw")).alias("idf"))
    return idf, size


def bm25(pairs: DataFrame, queries: DataFrame, docs: DataFrame, fit_on: DataFrame | None = None, dense: bool = False) -> DataFrame:
    """query_id, doc_id, score of every pair; queries and docs: id and text; repeats of a query term count.

    Statistics come from fit_on (docs by default), so a document outside of it can be scored. dense says that pairs
    are most of all: terms then meet first and pairs are picked from the scores, instead of terms being sought for
    each pair.
    """
    table = term_table(docs, "doc_id")
    idf, size = bm25_statistics(docs, "doc_id", table) if fit_on is None else bm25_statistics(fit_on, "doc_id")
    wanted = pairs.select("query_id", "doc_id").distinct()
    q = terms(queries.join(wanted.select("query_id").distinct(), "query_id", "left_semi"), "query_id").withColumnRenamed("tf", "qtf").join(idf.select("term", "idf"), "term")
    q = shared.kept(q, "query_terms")
    d = table.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").join(q.select("term").distinct(), "term", "left_semi")
    weight = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("avgdl")))
    # Pairs carry the query's few terms to the document's, never all terms of both.
    joined = q.join(d, "term") if dense else wanted.join(q, "query_id").join(d, ["doc_id", "term"])
    scores = joined.crossJoin(F.broadcast(size)).groupBy("query_id", "doc_id").agg(F.sum(weight).alias("score"))
    return wanted.join(scores, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"))


def tfidf_vocabulary(docs: DataFrame, ident: str, most: int = 5000, min_df: int = 2, max_df: float = 0.8, ngrams: int = 2, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """term, df, idf: terms within the document-frequency bounds, the most frequent by corpus count, ties by term."""
    found = terms(docs, ident, ngrams, stop_words).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("_cf"))
    n = docs.select(F.count("*").alias("_n"))
    kept = found.crossJoin(F.broadcast(n)).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("_n")))
    top = kept.orderBy(F.desc("_cf"), "term").limit(most)
    return top.select("term", "df", (F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf_weights(docs: DataFrame, ident: str, vocabulary: DataFrame, ngrams: int = 2, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """ident, term, w: unit-length weights over the vocabulary."""
    raw = terms(docs, ident, ngrams, stop_words).join(vocabulary.select("term", "idf"), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(ident)))
    return raw.select(ident, "term", (F.col("w") / norm).alias("w"))


def tfidf_cosine(pairs: DataFrame, queries: DataFrame, docs: DataFrame, vocabulary: DataFrame, ngrams: int = 2, stop_words: tuple[str, ...] = STOP_WORDS, dense: bool = False) -> DataFrame:
    """query_id, doc_id, score: the dot product of unit vectors, 0 if either is empty; dense as for bm25."""
    wanted = pairs.select("query_id", "doc_id").distinct()
    vocabulary = shared.kept(vocabulary.select("term", "idf"), "vocabulary")
    q = shared.kept(tfidf_weights(queries, "query_id", vocabulary, ngrams, stop_words).withColumnRenamed("w", "qw"), "query_weights")
    d = tfidf_weights(docs.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id", vocabulary, ngrams, stop_words)
    d = d.join(q.select("term").distinct(), "term", "left_semi")
    joined = q.join(d, "term") if dense else wanted.join(q, "query_id").join(d, ["doc_id", "term"])
    scores = joined.groupBy("query_id", "doc_id").agg(F.sum(F.col("qw") * F.col("w")).alias("score"))
    return wanted.join(scores, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"))


def random_scores(pairs: DataFrame, seed: int) -> DataFrame:
    """A floor: a number in [0, 1) from the hash of each pair."""
    drawn = order.hash_int(8, seed, F.col("query_id"), F.col("doc_id")).cast("double") / float(1 << 32)
    return pairs.select("query_id", "doc_id").distinct().select("query_id", "doc_id", F.round(drawn, 6).alias("score"))


def local_tfidf(candidates: DataFrame) -> DataFrame:
    """query_id, doc_id, score: cosine in a space fitted for each query on its own candidates and itself.

    candidates: query_id, query_text, doc_id, text.
    """
    docs = candidates.select("query_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("d"), "text")
    both = docs.unionByName(candidates.select("query_id", F.lit("q").alias("d"), F.col("query_text").alias("text")).distinct())
    keyed = both.select(F.struct("query_id", "d").alias("key"), "text")
    found = terms(keyed, "key").select("key.query_id", "key.d", "term", "tf")
    n = both.groupBy("query_id").agg(F.count("*").alias("n"))
    df = found.groupBy("query_id", "term").agg(F.count("*").alias("df"))
    raw = found.join(df, ["query_id", "term"]).join(n, "query_id").withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    unit = raw.select("query_id", "d", "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("query_id", "d")))).alias("w"))
    query = unit.filter("d = 'q'").select("query_id", "term", F.col("w").alias("qw"))
    scores = unit.filter("d <> 'q'").join(query, ["query_id", "term"]).groupBy("query_id", "d").agg(F.sum(F.col("w") * F.col("qw")).alias("score"))
    out = candidates.select("query_id", "doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("d")).join(scores, ["query_id", "d"], "left")
    return out.select("query_id", "doc_id", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"))
