"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlattice.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Connects each node's larger (or not larger) neighbours to the least node of its neighbourhood.

    The least neighbour is a map-side combined aggregate, and the join back has one row per node on
    one side, so that a node with very many edges is split by the skew join.
    """
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.join(least, "u").where("v > u")
    else:
        down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(least, "u").select("m", "v").union(least.select("m", F.col("u").alias("v")))
    return out.select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()


def _hooked(edges: DataFrame) -> DataFrame:
    """(u, m) for every node: the least of itself and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
    return both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _by_stars(edges: DataFrame) -> DataFrame:
    now, mark = edges, None
    while True:
        now = materialize(_star(_star(now, large=True), large=False), "edges")
        was, mark = mark, now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == was:
            break
    return now.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): the least node that links reach from it.

    Nodes without an edge are absent. Loops and repeated edges do no harm; an empty table gives an
    empty one. A first round hooks each node to its least neighbour and contracts the edges, which ends most graphs of
    small groups; what is left, a small part of the edges, goes through star steps until nothing changes, which takes about the logarithm of the longest chain.
    Each round is written to the shared folder, so lineage stays short.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    hooks = materialize(_hooked(edges), "hooks")
    # Edges are contracted along hooks; since a hook is an edge itself, a node and what it hooked to stay connected.
    one, two = hooks.select(F.col("u").alias("a"), F.col("m").alias("ma")), hooks.select(F.col("u").alias("b"), F.col("m").alias("mb"))
    left = edges.join(one, "a").join(two, "b").select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).where("a <> b")
    left = materialize(left.distinct(), "left")
    if left.isEmpty():
        return hooks.select(F.col("u").alias("node"), F.col("m").alias("component"))
    roots = _by_stars(left).toDF("r", "root")
    return hooks.join(roots, hooks["m"] == roots["r"], "left").select(F.col("u").alias("node"), F.coalesce("root", "m").alias("component"))
