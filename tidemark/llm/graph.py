"""Connected components of a link table, in rounds of joins; nothing but a count comes to the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links (a[i], b[i]) and the smallest node that each reaches through them."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], least)
        np.minimum.at(new, root[y], least)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every node of links (a, b): component is the smallest id reachable. Nodes without links aren't listed.

    Rounds of large and small stars: each node hands its larger neighbours, then all its smaller ones, to the smallest
    neighbour. A hub's smallest neighbour is an aggregate with partial sums; it is stored, so that the hub's links meet it in a
    join of two plain tables, whose hot keys Spark can split.
    """
    u, v = F.col("u"), F.col("v")
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(v.alias("u"), u.alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).where("u <> v")
        large = stored(large, "large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        pairs = F.explode(F.array(F.struct(u, F.col("m").alias("v")), F.struct(v.alias("u"), F.col("m").alias("v")))).alias("p")
        edges = stored(large.join(least, "u").select(pairs).select("p.u", "p.v").where("u <> v").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(u.alias("id"), v.alias("component")).unionByName(edges.select(v.alias("id"), v.alias("component")).distinct())
