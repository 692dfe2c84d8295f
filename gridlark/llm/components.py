"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import Scratch, table


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """(v, c): each vertex of ``edges`` (longs) and the smallest vertex it reaches.

    Each round maps a vertex to its smallest neighbour, and on to the smallest
    neighbour of that, and replaces the edges by those between different
    images. All but local minima merge, so that vertices at least halve and
    the rows joined shrink from round to round. The maps are composed from the
    last to the first. All tables are in the shared folder; only whether edges
    are left reaches the driver. Hub vertices are pre-aggregated before the
    shuffle. Edges with a null, self-loops and repeated edges do no harm; a
    vertex without an edge to another is not listed. Tables go to ``scratch`` if given.
    """
    write = scratch.table if scratch else table
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    e = write(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    maps = []
    while e.limit(1).count():
        near = e.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("least")).select("v", F.least("v", "least").alias("c"))
        near = write(near, "cc-near")
        ahead = near.select(F.col("v").alias("c"), F.col("c").alias("next"))
        step = write(near.join(ahead, "c").select("v", F.col("next").alias("c")), "cc-map")
        maps.append(step)
        image = e.join(step.select(F.col("v").alias("a"), F.col("c").alias("ca")), "a").join(step.select(F.col("v").alias("b"), F.col("c").alias("cb")), "b")
        e = write(image.select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b").distinct(), "cc-edges")
    if not maps:
        return e.select(F.col("a").alias("v"), F.col("b").alias("c"))
    labels = maps.pop()
    while maps:
        last = labels.select(F.col("v").alias("c"), F.col("c").alias("end"))
        labels = maps.pop().join(last, "c", "left").select("v", F.coalesce("end", "c").alias("c"))
    return write(labels, "cc-labels")
