"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygraph.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, component) of each node of ``links`` (a, b); the component is its smallest node.

    Each round takes the smallest label next to each node and then the label's own label, so the number of
    rounds grows with the logarithm of a component's width. Labels are written between rounds.
    """
    both = scratch.save(links.select("a", "b").where("a <> b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct())
    label = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")))
    for _ in range(most_rounds):
        near = both.join(label, both["b"] == label["node"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = label.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        up = label.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = scratch.save(lower.join(up, "component").select("node", F.least("component", "up").alias("component"), "was"))
        scratch.drop(label)
        label, done = new.select("node", "component"), new.where("component <> was").isEmpty()
        label._scratch_path = new._scratch_path
        if done:
            scratch.drop(both)
            return label
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")


def merged(label: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """The labels (node, component) after further ``links`` (a, b): only the components that these join are labelled anew."""
    at = {x: label.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}")) for x in "ab"}
    joined = links.select("a", "b").join(at["a"], "a", "left").join(at["b"], "b", "left")
    joined = scratch.save(joined.select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b")).where("a <> b").distinct())
    if joined.isEmpty():
        return label
    step = components(joined, scratch)
    moved = label.join(step.select(F.col("node").alias("component"), F.col("component").alias("up")), "component", "left").select("node", F.coalesce("up", "component").alias("component"))
    out = scratch.save(moved.unionByName(step.join(label, "node", "left_anti").select("node", "component")))
    scratch.drop(joined, step, label)
    return out
