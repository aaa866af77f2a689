"""How distinctive a term is for a record.

`residual_idf` is the method named for this problem: the observed inverse document frequency
minus the one a Poisson process with the term's collection frequency would give. A term that is
spread like chance scores near zero however rare it is; one that crowds into few records scores
high. `top_terms` is the plain weighting (1 + ln tf) * ln(1 + N / df) that the stored slots use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.records import occurrences, records
from corpusloom.session import cut

#: A term is hot when it holds more than this part of all (record, term) pairs; there are then at
#: most HOT_PARTS hot terms, which bounds what is broadcast for them.
HOT_PARTS = 2000


#: Frequency tables up to this many bytes are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def with_frequency(pairs: DataFrame, min_df: int = 1, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Pairs (key, term, tf) with their term's df and cf, for terms in at least min_df records.

    df and cf come from a map-side combined aggregation. Its result is measured: up to
    broadcast_bytes it is broadcast and no pair moves. Beyond that the pairs of hot terms still
    meet a broadcast of at most HOT_PARTS rows, and only the pairs of other terms are shuffled,
    of which none holds more than a HOT_PARTS-th of all pairs."""
    freq = cut(pairs.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")), "term-frequency")
    useful = freq.where(F.col("df") >= min_df)
    weight, n_pairs = useful.agg(F.sum(F.octet_length("term") + 48), F.sum("df")).first()
    if (weight or 0) <= broadcast_bytes:
        return pairs.join(F.broadcast(useful), "term")
    limit = n_pairs / HOT_PARTS
    hot = F.broadcast(useful.where(F.col("df") > limit))
    cold = pairs.join(F.broadcast(freq.where(F.col("df") > limit).select("term")), "term", "left_anti")
    return cold.join(useful.where(F.col("df") <= limit).hint("shuffle_hash"), "term").unionByName(pairs.join(hot, "term"))


def tf_idf(tf: Column, df: Column, n: int) -> Column:
    """(1 + ln tf) * ln(1 + N / df), rounded to 6 decimals."""
    return F.round((1 + F.log(tf.cast("double"))) * F.log(1 + F.lit(float(n)) / df), 6)


def residual_idf(tf: Column, df: Column, cf: Column, n: int) -> Column:
    """tf * (idf - expected idf). idf is log2(N / df); under a Poisson law with mean cf / N the
    share of records with the term is 1 - exp(-cf / N), whose log2 is subtracted."""
    mean = cf / F.lit(float(n))
    return F.round(tf * (F.log2(F.lit(float(n)) / df) + F.log2(-F.expm1(-mean))), 6)


def best(scored: DataFrame) -> DataFrame:
    """(key, term, score): the highest score of each record, of equals the first term in code
    point order (Spark compares strings by their UTF-8 bytes, which is that order)."""
    top = F.min(F.struct((-F.col("score")).alias("neg"), "term"))
    return scored.groupBy("key").agg(top.alias("b")).select("key", "b.term", (-F.col("b.neg")).alias("score"))


def _scored(df: DataFrame, key: str, text: str, min_df: int, score, broadcast_bytes: int) -> DataFrame:
    n = df.where(F.col(text).isNotNull()).agg(F.count_distinct(key)).first()[0]
    pairs = cut(occurrences(records(df, key, text)), "term-pairs")
    rows = with_frequency(pairs, min_df, broadcast_bytes)
    return rows.select("key", "term", "tf", "df", "cf", score(F.col("tf"), F.col("df"), F.col("cf"), n).alias("score"))


def term_scores(df: DataFrame, key: str = "chunk_id", text: str = "text", min_df: int = 1, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(key, term, tf, df, cf, score): residual idf of every term of every record. Records
    without terms have no row; null texts and keys are dropped; an empty table gives none."""
    return _scored(df, key, text, min_df, residual_idf, broadcast_bytes)


def top_terms(df: DataFrame, key: str = "chunk_id", text: str = "text", min_df: int = 3, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(key, term, score): each record's most characteristic term by tf_idf among terms in at
    least min_df records. Same rules for nulls as term_scores."""
    return best(_scored(df, key, text, min_df, lambda tf, d, cf, n: tf_idf(tf, d, n), broadcast_bytes))


def top_residual_terms(df: DataFrame, key: str = "chunk_id", text: str = "text", min_df: int = 3, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(key, term, score): each record's highest residual idf, by the same rules."""
    return best(_scored(df, key, text, min_df, residual_idf, broadcast_bytes))
