"""Boruvka's minimum spanning forest, in Spark and for graphs that fit one task.

Edges are (a, b, w). In every round each component picks its lightest edge (ties by the ends, so
that all components agree), the picked edges join components, and edges inside a component
disappear. Components at least halve in number each round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component, by min-label hooking and pointer jumping."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        if np.array_equal(la, lb):
            return label
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            jump = label[label]
            if np.array_equal(jump, label):
                break
            label = jump


def spanning_forest(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Indices of the edges of a minimum spanning forest; ties go to the edge that comes first."""
    rank = np.empty(len(w), np.int64)
    rank[np.argsort(w, kind="stable")] = np.arange(len(w))
    by_rank = np.argsort(rank)
    label, live, chosen = np.arange(n), np.arange(len(w)), []
    while len(live):
        la, lb = label[a[live]], label[b[live]]
        keep = la != lb
        live, la, lb = live[keep], la[keep], lb[keep]
        if not len(live):
            break
        best = np.full(n, len(w))
        np.minimum.at(best, la, rank[live])
        np.minimum.at(best, lb, rank[live])
        pick = by_rank[np.unique(best[best < len(w)])]
        chosen.append(pick)
        label = components(n, label[a[pick]], label[b[pick]])[label]
    return np.unique(np.concatenate(chosen)) if chosen else np.zeros(0, np.int64)


def spanning_tree(edges: DataFrame, label: str = "tree") -> DataFrame:
    """The edges (a, b, w) of a minimum spanning forest of (a, b, w), one row each, with the ends as
    given. Rounds run in the cluster until no component has an edge to another; each is cut from
    its lineage. An edge that leads out of no component any more is dropped, so a round reads
    what the last one left."""
    left = cut(_lightest_of(edges.select("a", "b", F.struct("w", "a", "b").alias("e"))), label)
    found: DataFrame | None = None
    while not left.isEmpty():
        ends = left.select(F.col("a").alias("node"), "e", "a", "b").unionByName(left.select(F.col("b").alias("node"), "e", "a", "b"))
        picks = ends.groupBy("node").agg(F.min(F.struct("e", "a", "b")).alias("x"))
        picks = cut(picks.select("node", F.col("x.e").alias("e"), F.when(F.col("x.a") == F.col("node"), F.col("x.b")).otherwise(F.col("x.a")).alias("root")), f"{label}-picks")
        chosen = picks.select("e.*")
        found = chosen if found is None else found.unionByName(chosen)
        parent = cut(_rooted(picks.select("node", "root")), f"{label}-parent")
        left = cut(_lightest_of(_renamed(left, parent)), label)
    if found is None:
        return edges.select("a", "b", "w").limit(0)
    return cut(found.select("a", "b", "w").distinct(), f"{label}-edges")


def _lightest_of(edges: DataFrame) -> DataFrame:
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    return edges.where("a <> b").select(low, high, "e").groupBy("a", "b").agg(F.min("e").alias("e"))


def contracted(edges: DataFrame, limit: float, label: str = "contract") -> tuple[DataFrame, DataFrame]:
    """(member, edges): components of the edges with w <= limit as (node, root), for nodes that
    moved, and the lightest remaining edge of every pair of components, in terms of roots. Rounds
    run in the cluster until no edge within the limit is left; each is cut from its lineage."""
    edges = cut(_lightest(edges), label)
    spark = edges.sparkSession
    members: DataFrame | None = None
    while True:
        inside = edges.where(F.col("w") <= limit)
        if inside.isEmpty():
            return (members if members is not None else spark.createDataFrame([], "node long, root long")), edges
        ends = inside.select(F.col("a").alias("node"), "w", "a", "b").unionByName(inside.select(F.col("b").alias("node"), "w", "a", "b"))
        picks = ends.groupBy("node").agg(F.min(F.struct("w", "a", "b")).alias("e"))
        parent = picks.select("node", F.when(F.col("e.a") == F.col("node"), F.col("e.b")).otherwise(F.col("e.a")).alias("root"))
        parent = cut(_rooted(parent), f"{label}-parent")
        edges = cut(_lightest(_renamed(edges, parent)), label)
        if members is None:
            members = parent
        else:
            moved = members.join(parent.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left")
            moved = moved.select("node", F.coalesce("next", "root").alias("root"))
            fresh = parent.join(members.select("node"), "node", "left_anti")
            members = cut(moved.unionByName(fresh), f"{label}-members")


def _lightest(edges: DataFrame) -> DataFrame:
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    return edges.where("a <> b").select(low, high, "w").groupBy("a", "b").agg(F.min("w").alias("w"))


def _renamed(edges: DataFrame, parent: DataFrame) -> DataFrame:
    for end in ("a", "b"):
        to = parent.select(F.col("node").alias(end), F.col("root").alias("to"))
        edges = edges.join(to, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    return edges


def _rooted(parent: DataFrame, jumps: int = 4) -> DataFrame:
    """Pointer jumping over the picked edges. The two nodes that picked each other form the root,
    the smaller of them; after `jumps` doublings a longer path keeps an inner node as its root,
    which the next round joins, so the result is a contraction in any case."""
    back = parent.select(F.col("node").alias("root"), F.col("root").alias("back"))
    tied = parent.join(back, "root", "left")
    parent = tied.select("node", F.when((F.col("back") == F.col("node")) & (F.col("node") < F.col("root")), F.col("node")).otherwise(F.col("root")).alias("root"))
    for _ in range(jumps):
        up = parent.select(F.col("node").alias("root"), F.col("root").alias("up"))
        parent = parent.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return parent.where("node <> root")
