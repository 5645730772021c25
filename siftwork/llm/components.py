"""Connected components of link tables that no single machine could hold."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of the component of each of n points under the links (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        live = root[a] != root[b]
        a, b = a[live], b[live]
    return root


def components(links: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) of every id in the links (a, b), by alternating large and small stars.

    In a large star the larger neighbours of an id are tied to the smallest neighbour; in a small star the smaller ones are. Smallest
    neighbours come from grouped minima, which combine before the shuffle, so that an id with very many links is no hot spot.
    Links of an id with itself only name it. Links that are stars of smallest ids already take no round. Null ends are ignored.
    """
    links = links.where("a is not null and b is not null").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    names = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
    # A tie always points from the larger end to the smaller one.
    ties = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct().checkpoint()
    # Done when all ties are those of stars: nothing is tied to two, or tied and tied to.
    while True:
        state = ties.agg(F.count("*").alias("n"), F.count_distinct("a").alias("ends")).first()
        if state["n"] == state["ends"] and not ties.select("a").join(ties.select("b"), F.col("a") == F.col("b"), "left_semi").limit(1).count():
            break
        both = ties.union(ties.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        tied = large.join(low, "a")
        ties = tied.select(F.col("b").alias("a"), F.col("low").alias("b")).union(low).where("a <> b").distinct().checkpoint()
    return names.join(ties.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
