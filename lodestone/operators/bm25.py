"""BM25 index and search.

The index is two tables: ``postings(term, chunk_id, tf, dl)`` and ``terms(term, df)``, with one row of
corpus totals. The document length is stored with each posting, so a search does not join for it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestone.functions.text import tokens
from lodestone.operators.checks import require_nonempty
from lodestone.operators.ranking import latest
from lodestone.session import BROADCAST_ROWS, fits

# BM25 parameters.
K1, B = 1.5, 0.75
# Term buckets of a stored index, and files a bucket is spread over; a search reads only the buckets of
# its terms. Large corpora need more of both.
BUCKETS, SPREAD = 64, 8
# A term's postings are spread over this many tasks when the query terms are too many to broadcast.
SALTS = 32
# Pairs of a query and a chunk that a task sums at once, when the query terms are broadcast.
PAIRS = 2_000_000


@dataclass
class Index:
    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame
    buckets: int | None = None


def build(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> Index:
    """Term frequencies per chunk, document frequencies and corpus totals."""
    require_nonempty(chunks, "no chunks were found")
    counted = chunks.select(F.col(id_col).alias("chunk_id"), tokens(F.col(text_col)).alias("_tokens"))
    counted = counted.withColumn("dl", F.size("_tokens"))
    # All tokens of a chunk are in one task, so equal terms meet before the shuffle. The outer form is
    # used because a plain explode would tokenise twice, once to test for emptiness.
    postings = (
        counted.select("chunk_id", "dl", F.explode_outer("_tokens").alias("term"))
        .filter("term IS NOT NULL")
        .groupBy("chunk_id", "dl", "term")
        .agg(F.count("*").alias("tf"))
        .select("term", "chunk_id", "tf", "dl")
    )
    terms = postings.groupBy("term").agg(F.count("*").alias("df"))
    corpus = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    return Index(postings, terms, corpus)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def write(index: Index, path: str, buckets: int = BUCKETS, spread: int = SPREAD) -> None:
    """Postings are stored by term bucket and sorted by term, so row groups of other terms are skipped.

    A frequent term is spread over ``spread`` tasks and files of its bucket.
    """
    part = F.pmod(F.xxhash64("chunk_id"), F.lit(spread))
    index.postings.withColumn("bucket", _bucket(buckets)).repartition("bucket", part).sortWithinPartitions(
        "bucket", "term"
    ).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    stored = index.postings.sparkSession.read.parquet(f"{path}/postings")
    stored.groupBy("term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{path}/terms")
    index.corpus.withColumn("buckets", F.lit(buckets)).write.mode("overwrite").parquet(f"{path}/corpus")


def read(spark: SparkSession, path: str) -> Index:
    postings, terms, corpus = (spark.read.parquet(f"{path}/{name}") for name in ("postings", "terms", "corpus"))
    return Index(postings, terms, corpus, corpus.first()["buckets"])


def idf(n: Column, df: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


def weight(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * dl / avgdl))


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
    return (
        queries.select(F.col(id_col).alias("query_id"), F.explode(tokens(F.col(text_col))).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count("*").alias("qf"))
    )


def search(
    index: Index, queries: DataFrame, k: int = 5, k1: float = K1, b: float = B, id_col: str = "query_id",
    text_col: str = "text", digits: int | None = None, max_broadcast: int = BROADCAST_ROWS,
) -> DataFrame:
    """The ``k`` best chunks per query; a query without known terms has no rows.

    With few query terms the matching postings move once, by chunk, before they are multiplied by the
    queries; scores are then summed and cut to ``k`` per task without another wide shuffle. ``digits``
    rounds scores before ranking, ties go to the smaller chunk id.
    """
    asked = query_terms(queries, id_col, text_col)
    n_chunks, length = index.corpus.select("n", "avgdl").first()
    n, avgdl = F.lit(n_chunks), F.lit(length)
    weights = asked.join(index.terms, "term").select(
        "query_id", "term", (F.col("qf") * idf(n, F.col("df"))).alias("_w")
    )
    if fits(asked, max_broadcast):
        postings = index.postings
        if index.buckets:
            # A handful of small integers: lets the reader skip the other folders.
            wanted = [r[0] for r in asked.select(_bucket(index.buckets)).distinct().collect()]
            postings = postings.filter(F.col("bucket").isin(wanted))
        vocabulary = asked.select("term").distinct()
        # A chunk may share words with every query: tasks are as many as these pairs need, whatever the postings' size.
        pairs = n_chunks * asked.agg(F.count_distinct("query_id")).first()[0]
        tasks = max(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(pairs / PAIRS))
        by_chunk = postings.join(F.broadcast(vocabulary), "term", "left_semi").repartition(tasks, "chunk_id")
        matched = by_chunk.join(F.broadcast(weights), "term")
    else:
        salt = F.pmod(F.xxhash64("chunk_id"), F.lit(SALTS)).cast("int")
        spread = weights.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        matched = index.postings.withColumn("_salt", salt).join(spread, ["term", "_salt"])
    part = F.col("_w") * weight(F.col("tf"), F.col("dl"), avgdl, k1, b)
    scores = matched.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))
    if digits is not None:
        scores = scores.withColumn("score", F.round("score", digits))
    return latest(scores, ["query_id"], [F.col("score").desc(), F.col("chunk_id").asc()], k, "rank")
