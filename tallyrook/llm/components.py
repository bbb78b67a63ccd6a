"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(nid, root) for each end of edges (u, v): root is the component's smallest end.

    The large star hangs a node's larger neighbours on the smallest, the small star the smaller
    ones; the number of rounds follows the logarithm of the longest path. A node of many
    neighbours is never gathered: its minimum is aggregated and joined back. Each round is
    written, so lineage stays short. Loops and repeated edges do no harm, edges with a null end are
    left out, and no edges give no rows.
    """
    e = scratch.write(edges.where("u <> v").select(F.greatest("u", "v").alias("c"), F.least("u", "v").alias("p")).distinct())
    before = None
    while True:
        now = scratch.read(e)
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("c", "p") % 1_000_003).alias("s"), F.max(F.col("c")).alias("m")).first()
        if mark["n"] == 0 or mark == before:
            break
        before = mark
        both = now.select(F.col("c").alias("x"), F.col("p").alias("y")).union(now.select(F.col("p").alias("x"), F.col("c").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.join(least, "x").where("y > x and y <> m").select(F.col("y").alias("c"), F.col("m").alias("p")).distinct()
        low = large.groupBy("c").agg(F.min("p").alias("m"))
        small = large.join(low, "c").where("p <> m").select(F.col("p").alias("c"), F.col("m").alias("p")).union(low.select("c", F.col("m").alias("p"))).distinct()
        old, e = e, scratch.write(small)
        scratch.drop(old)
    stars = scratch.read(e)
    out = scratch.save(stars.select(F.col("c").alias("nid"), F.col("p").alias("root")).union(stars.select(F.col("p").alias("nid"), F.col("p").alias("root"))).distinct())
    scratch.drop(e)
    return out
