"""Connected components of a graph given as a table of edges, without collecting it:
alternating large-star and small-star steps, each a grouping by the smallest neighbour."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import materialize


def forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node that its links lead to) for the nodes of some links in memory."""
    nodes, place = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = place[: len(left)], place[len(left) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _spread(edges: DataFrame, larger: bool) -> DataFrame:
    """Ties neighbours of every node to the smallest of them (itself included): its larger
    neighbours, or its smaller ones and itself. ``edges`` holds (u, v) with u > v."""
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    around = edges.unionByName(back) if larger else edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if larger:  # where u itself is the smallest its edges stay, so only the others need its m
        moved = around.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def components(edges: DataFrame, u: str = "a", v: str = "b") -> DataFrame:
    """(node, component) for every node of the edges; the component is its smallest node.

    Self-loops, repeated and null edges are ignored; no edges give an empty table."""
    both = edges.select(F.col(u).alias("x"), F.col(v).alias("y")).filter("x is not null and y is not null and x <> y")
    now = both.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()
    now = materialize(now, "edges")
    state = None
    while True:
        total = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (total["n"], total["h"]) == state or not total["n"]:
            break
        state = (total["n"], total["h"])
        now = materialize(_spread(_spread(now, True), False), "edges")
    # all edges lead to the smallest node of their component now
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
