"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glasspane.llm.rows import Scratch, discard


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, root`` for every id of ``links(a, b)``, written to ``scratch``; root is one id of the component.

    Every round sends each id to the least of itself and its neighbours and
    keeps the links between what is left. Ids should be hashes: along a path in
    random order a constant share of the ids goes in each round. ``links`` is
    read in the first round as it is, so it should be a table that is written.
    Only counts come to the driver.
    """
    edges, roots, held = links.where(F.col("a") != F.col("b")).select("a", "b"), None, None
    while True:
        ends = F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("to")), F.struct(F.col("b").alias("id"), F.col("a").alias("to"))))
        least = edges.select(ends.alias("e")).select("e.id", "e.to").groupBy("id").agg(F.min("to").alias("to"))
        least = scratch.save(least.select("id", F.least("id", "to").alias("to")), "least")
        a, b = (least.select(F.col("id").alias(x), F.col("to").alias(f"{x}_to")) for x in "ab")
        left = edges.join(a, "a").join(b, "b").where(F.col("a_to") != F.col("b_to"))
        left = scratch.save(left.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "edges")
        if roots is None:  # the first round meets every id
            moved, held = least.withColumnRenamed("to", "root"), least
        else:
            moved = roots.join(least.select(F.col("id").alias("root"), "to"), "root", "left")
            moved = scratch.save(moved.select("id", F.coalesce("to", "root").alias("root")), "roots")
            for done in (edges, least, held):
                discard(done)
            held = moved
        edges, roots = left, moved
        if edges.isEmpty():
            discard(edges)
            return roots
