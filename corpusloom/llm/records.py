"""Records and their terms, shared by the frequency and distinctiveness operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Maximal runs of letters or digits. Java's \\p{L} and \\p{Nd} are Unicode's categories.
TERM = r"[\p{L}\p{N}]+"


def records(df: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, text): one row a key with non-null text. Repeated rows and re-deliveries of a key
    count once; should their texts differ, the greatest text stands. Null keys are dropped."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).dropna()
    return rows.groupBy("key").agg(F.max("text").alias("text"))


def occurrences(recs: DataFrame) -> DataFrame:
    """(key, term, tf): terms of the lower-cased text with their number of occurrences, counted
    inside the record's own row, so that no shuffle is needed. A text without terms has no row.

    The terms are sorted, and an element starts a run where it differs from its predecessor; a
    run's length is the distance to the next start."""
    terms = F.array_sort(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))
    runs = F.expr(
        "filter(transform(terms, (t, i) -> struct(t AS term, i AS at)), x -> x.at = 0 OR terms[x.at - 1] <> x.term)"
    )
    tf = F.expr("transform(runs, (r, i) -> struct(r.term AS term, coalesce(get(runs, i + 1).at, size(terms)) - r.at AS tf))")
    rows = recs.select("key", terms.alias("terms")).where("size(terms) > 0")
    rows = rows.withColumn("runs", runs).select("key", F.explode(tf).alias("x"))
    return rows.select("key", "x.term", "x.tf")
