"""Connected components of a table of links, by contraction to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amortia.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` -> ``(node, label)`` for every linked node; label is the smallest node of its
    component. Every round hooks each root to its smallest neighbour, shortens all paths by doubling and
    drops links inside a component, so roots at least halve; tables are written between rounds. A node
    with very many links costs only partial minima. Self links and repeated links change nothing."""
    current = staged(links.where("a <> b").select("a", "b").distinct(), "links")
    forest = None
    while True:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select(
            "node", F.least("node", "low").alias("label"))
        if forest is None:
            forest = staged(hook, "forest")
        else:  # labels that are roots move to what their root was hooked to
            moved = hook.select(F.col("node").alias("root"), F.col("label").alias("to"))
            forest = staged(forest.join(moved, forest["label"] == moved["root"], "left")
                            .select("node", F.coalesce("to", "label").alias("label")), "forest")
        forest = _shorten(forest)
        x, y = (forest.select(F.col("node").alias(n), F.col("label").alias(f"l{n}")) for n in "ab")
        current = staged(current.join(x, "a").join(y, "b").where("la <> lb")
                         .select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "links")
        if current.isEmpty():
            return forest


def _shorten(forest: DataFrame) -> DataFrame:
    """Path doubling: label(v) = label(label(v)) until nothing changes."""
    while True:
        up = forest.select(F.col("node").alias("mid"), F.col("label").alias("top"))
        step = staged(forest.join(up, forest["label"] == up["mid"], "left").select(
            "node", F.coalesce("top", "label").alias("label"),
            (F.coalesce("top", "label") != F.col("label")).alias("moved")), "forest")
        if step.where("moved").isEmpty():
            return step.select("node", "label")
        forest = step.select("node", "label")
