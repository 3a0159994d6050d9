"""Connected components of a table of links, without collecting them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabvet.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``links`` (a, b): label is the smallest
    node of the component.

    Each round hooks every component to its smallest neighbour, follows the
    hooks to their ends by doubling, and keeps the links that still join two
    components; their number falls at least by half a round.
    """
    edges = stored(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
                   .filter("a <> b").distinct(), "links")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = stored(both.groupBy("a").agg(F.min("b").alias("m"))
                       .select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "hooks")
        while True:
            ahead = hooks.select(F.col("node").alias("label"), F.col("label").alias("next"))
            jumped = stored(hooks.join(ahead, "label")
                            .select("node", F.col("next").alias("label"), (F.col("next") != F.col("label")).alias("moved")),
                            "hooks")
            hooks = jumped.select("node", "label")
            if jumped.filter("moved").isEmpty():
                break
        if labels is None:
            labels = hooks
        else:
            now = hooks.select(F.col("node").alias("label"), F.col("label").alias("next"))
            labels = stored(labels.join(now, "label", "left")
                            .select("node", F.coalesce("next", "label").alias("label")), "labels")
        a, b = (hooks.select(F.col("node").alias(c), F.col("label").alias("l" + c)) for c in "ab")
        edges = stored(edges.join(a, "a").join(b, "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
                       .filter("a <> b").distinct(), "links")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
