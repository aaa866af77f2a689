"""Most similar vectors for every vector, through the hash-prefix forest.

Candidates come from the forest with byte vectors: in every tree the rows that share a prefix with
a row, all trees ascending in step until they offer enough. The exact cosine follows from the
stored vectors, which are fetched only for ids that occur in a candidate pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.llm.forest import CELL_MEMBERS, PAIRS, Forest, across_borders, cell_members, prefix_counts, prefix_pairs, range_candidates, rows_by_dim, sorted_trees, usable_vectors
from corpusloom.session import cut

#: Ids of candidates up to this number are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("va").to_pylist(), batch.column("vb").to_pylist()
        cos = [float(np.frombuffer(x, np.float32).astype(np.float64) @ np.frombuffer(y, np.float32).astype(np.float64)) if len(x) == len(y) else None for x, y in zip(a, b, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(cos, pa.float64())], ["a", "b", "cosine"])


def exact_cosines(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a, b, cosine) of candidate pairs; pairs of different dimensions have no row."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "candidate-ids")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    needed = vectors.select("id", "vec").join(ids, "id", "left_semi")
    left = pairs.join(needed.select(F.col("id").alias("a"), F.col("vec").alias("va")), "a")
    both = left.join(needed.select(F.col("id").alias("b"), F.col("vec").alias("vb")), "b")
    return both.select("a", "b", "va", "vb").mapInArrow(_cosines, "a long, b long, cosine double").where("cosine IS NOT NULL")


def without_surplus_copies(vectors: DataFrame, keep: int) -> DataFrame:
    """Vectors less the copies that cannot matter: of more than `keep` equal vectors the `keep`
    with the smallest ids stay. A further copy has `keep` - 1 or more equal vectors with smaller
    ids ahead of it in every other vector's list. The group limit runs before the shuffle, so a
    vector that a third of all rows share sends `keep` rows a task."""
    same = vectors.groupBy("dim", F.xxhash64("vec").alias("same")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > keep).select("dim", "same")
    crowded = cut(same, "crowded")
    if crowded.isEmpty():
        return vectors
    tagged = vectors.withColumn("same", F.xxhash64("vec"))
    order = F.row_number().over(W.partitionBy("dim", "same").orderBy("id"))
    first = tagged.join(crowded, ["dim", "same"], "left_semi").withColumn("rn", order).where(F.col("rn") <= keep)
    return tagged.join(crowded, ["dim", "same"], "left_anti").select("id", "dim", "vec").unionByName(first.select("id", "dim", "vec"))


def mutual_neighbours(vectors: DataFrame, k: int = 5, bar: float = 0.93, trees: int = 9, window: int = 96, seed: int = 11) -> DataFrame:
    """(a, b, cosine), a < b: pairs with a cosine of at least `bar` each of which is among the
    other's k most similar. Equal cosines are ordered by the smaller id. `vectors` is
    (id, dim, vec). Every neighbour that could push a pair out of a list is itself above the bar,
    so lists of pairs above the bar decide. An empty table has no rows.

    A row's range in a tree are the rows of the level at which the trees together offer eight
    windows each, of those the `window` on either side with the longest common prefixes. Rows
    at the ends of a cell meet those of the next one."""
    few = without_surplus_copies(vectors, k + 1)
    counts = rows_by_dim(few)
    forest = Forest.fit(few, trees, seed, counts=counts)
    held = prefix_counts(few, forest)
    # Byte vectors are off by some thousandths; the margin keeps pairs at the bar.
    near = cut(sorted_trees(few, forest, counts=held, enough=8.0 * window * trees).mapInArrow(prefix_pairs(window, bar - 0.015), PAIRS), "prefix-pairs")
    borders = near.where("border IS NOT NULL").select("border", "after", "key", "id", "level", "code").repartition("border").sortWithinPartitions("border", "key", "id")
    over = borders.mapInArrow(across_borders(window, bar - 0.015), "a long, b long")
    found = near.where("a IS NOT NULL").select("a", "b").unionByName(over).distinct()
    pairs = exact_cosines(cut(found, "near-pairs"), few).where(F.col("cosine") >= bar)
    ends = pairs.select("a", "b", "cosine", F.explode(F.array(F.struct(F.col("a").alias("me"), F.col("b").alias("you")), F.struct(F.col("b").alias("me"), F.col("a").alias("you")))).alias("e"))
    order = W.partitionBy("e.me").orderBy(F.round("cosine", 6).desc(), "e.you")
    listed = ends.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return listed.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.first("cosine").alias("cosine")).where("n = 2").select("a", "b", "cosine")


def nearest(vectors: DataFrame, k: int = 5, divisor: int = 50, trees: int = 8, share: float = 0.4, least: int = 32_768, seed: int = 11) -> DataFrame:
    """(id, rank, neighbour, cosine): the k most similar vectors of every vector whose id is
    divisible by `divisor`, searched among all. The trees are ascended in step until together they
    have offered `share` of the collection, and at least `least` rows (all of a collection
    whose trees hold fewer): without structure in the data that share, not a fixed number,
    decides the recall. Which rows are compared depends on the data alone, not on partitions.
    Equal cosines are ordered by the smaller id; of equal vectors those with the smallest ids
    can be neighbours of others."""
    few = without_surplus_copies(vectors, k + 1)
    counts = rows_by_dim(few)
    forest = Forest.fit(few, trees, seed, counts=counts)
    held = prefix_counts(few, forest)
    enough = {d: max(float(least), share * n) for d, n in counts.items()}
    asked = vectors.where(F.col("id") % divisor == 0)
    members = [df.select("id", "dim", "vec").mapInArrow(cell_members(forest, held, enough, q), CELL_MEMBERS) for df, q in ((asked, True), (few, False))]
    rows = members[0].unionByName(members[1]).repartition("cell", "salt").sortWithinPartitions("cell", "salt", "kind")
    found = rows.mapInArrow(range_candidates(2 * k), "q long, other long")
    pairs = cut(found.select(F.col("q").alias("a"), F.col("other").alias("b")).distinct(), "query-candidates")
    scored = exact_cosines(pairs, vectors)
    order = W.partitionBy("a").orderBy(F.round("cosine", 6).desc(), "b")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("a").alias("id"), "rank", F.col("b").alias("neighbour"), "cosine")


def current_vectors(vectors: DataFrame, meta: DataFrame) -> DataFrame:
    """usable_vectors as a table of their own, since several passes read them."""
    return cut(usable_vectors(vectors, meta), "vectors")
