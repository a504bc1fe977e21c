"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from haulscope.llm import common


def components(links: DataFrame) -> DataFrame:
    """Nodes of ``links`` (a, b) with the smallest node each can reach: node, component.

    Each round hangs every node's larger neighbours, then its smaller ones, on the smallest. The
    rounds needed grow with the logarithm of the longest chain. A round is two joins with minima
    that are combined inside tasks, so a node with very many links is no single group; its result
    is written to the shared folder, which cuts the lineage.
    """
    edges = common.written(_tidy(links.select("a", "b")), "links")
    state = _state(edges)
    while True:
        edges = common.written(_small_star(_large_star(edges)), "links")
        known, state = state, _state(edges)
        if state == known:
            # Every link now leads from a node to its component's smallest.
            ends = edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
            others = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return others.unionByName(ends).distinct()


def _tidy(edges: DataFrame) -> DataFrame:
    """Each link once, from the larger node (a) to the smaller (b)."""
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    return edges.where(F.col("a") != F.col("b")).select(a, b).distinct()


def _state(edges: DataFrame) -> tuple:
    mix = F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
    return tuple(edges.agg(F.count("*"), mix).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    larger = both.where(F.col("b") > F.col("a"))
    return _tidy(larger.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hung = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return _tidy(hung.unionByName(own))
