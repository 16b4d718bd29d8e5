"""Connected components by tables of labels, each step written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import dropped, written


def joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (v, label), a written table, after the links of edges (a, b) between vertices: linked vertices get one label.

    Each round hooks a label to the least of its neighbours' and follows the hooks twice, until no link is left between
    labels. The tables hold labels and links only, never all pairs of a component; those replaced are deleted.
    """
    of = lambda side, name: labels.select(F.col("v").alias(side), F.col("label").alias(name))
    links = edges.join(of("a", "x"), "a").join(of("b", "y"), "b").where("x <> y").select("x", "y").distinct()
    links = written(links, "links")
    while not links.isEmpty():
        both = links.union(links.select("y", "x"))
        hooks = both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("to"))
        for _ in range(2):
            onward = hooks.select(F.col("x").alias("to"), F.col("to").alias("further"))
            hooks = hooks.join(onward, "to", "left").select("x", F.coalesce("further", "to").alias("to"))
        hooks = written(hooks, "hooks")
        to = lambda side, name, hooks=hooks: hooks.select(F.col("x").alias(side), F.col("to").alias(name))
        moved = written(labels.join(to("label", "new"), "label", "left").select("v", F.coalesce("new", "label").alias("label")), "labels")
        left = written(links.join(to("x", "p"), "x").join(to("y", "q"), "y").where("p <> q").select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).distinct(), "links")
        dropped(labels, links, hooks)
        labels, links = moved, left
    dropped(links)
    return labels
