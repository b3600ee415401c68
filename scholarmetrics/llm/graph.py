"""Connected components of a link table, by randomised contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) of an undirected link table (a, b) of long ids; the component is its
    smallest node. Each round every node moves to the neighbour (or itself) that comes first:
    by id in even rounds, which contracts the stars around small ids at once, and in a fresh
    random order in odd rounds, which shrinks long chains by a constant factor, so rounds grow
    with the logarithm of the largest component at most. Links and mappings stay in
    written tables; the driver sees only whether any link is left."""
    edges = materialize(links.select("a", "b").filter(F.col("a") != F.col("b")).distinct(), "links")
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    place = both(edges).select(F.col("a").alias("node")).distinct().withColumn("at", F.col("node"))
    step = 0
    while not edges.isEmpty():
        order = (lambda c: F.col(c)) if step % 2 == 0 else (lambda c: F.xxhash64(F.col(c), F.lit(step)))
        first = lambda c: F.struct(order(c).alias("p"), F.col(c).alias("v"))
        near = both(edges).groupBy("a").agg(F.min(first("b")).alias("n"))
        move = materialize(near.select("a", F.least(F.col("n"), first("a"))["v"].alias("to")), f"move_{step}")
        place = materialize(
            place.join(move, place["at"] == move["a"], "left")
            .select("node", F.coalesce("to", "at").alias("at")), f"place_{step}")
        to_a, to_b = move.toDF("a", "x"), move.toDF("b", "y")
        edges = materialize(
            edges.join(to_a, "a").join(to_b, "b").filter("x != y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"links_{step}")
        step += 1
    root = place.groupBy("at").agg(F.min("node").alias("component"))
    return materialize(place.join(root, "at").select("node", "component"), "components")


def extended(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components (node, component) after further links: only the graph of components that the
    new links join is contracted."""
    if labels is None:
        return components(links)
    a, b = labels.toDF("a", "ca"), labels.toDF("b", "cb")
    new = materialize(
        links.select("a", "b").join(a, "a", "left").join(b, "b", "left")
        .select("a", "b", F.coalesce("ca", "a").alias("x"), F.coalesce("cb", "b").alias("y")), "new_links")
    joined = components(new.select(F.col("x").alias("a"), F.col("y").alias("b"))).toDF("old", "new")
    nodes = labels.unionByName(
        new.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("x").alias("component")),
                                     F.struct(F.col("b").alias("node"), F.col("y").alias("component")))).alias("n"))
        .select("n.*")).distinct()
    return materialize(
        nodes.join(joined, nodes["component"] == joined["old"], "left")
        .select("node", F.coalesce("new", "component").alias("component")), "extended")
