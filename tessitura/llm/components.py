"""Connected components of an edge table by repeated hooking to the smallest neighbour and pointer jumping, on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of bigint ids -> (node, comp) for each node of an edge; comp is the smallest node that it reaches.

    A round takes the smallest label among neighbours and then that label's own label, so a path of n nodes takes about log n rounds. Sums and
    minima are taken map-side; a node of very many edges is split by adaptive execution. An empty table gives an empty one.
    """
    both = stored(edges.where("a != b").selectExpr("inline(array(struct(a AS a, b AS b), struct(b AS a, a AS b)))").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp")).select("node", F.least("node", "comp").alias("comp")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        hooked = labels.join(seen, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        # labels point at nodes, so the label's label is one lookup away
        after = stored(hooked.join(jump, "comp").select("node", F.least("comp", "further").alias("comp"), "old"), "labels")
        changed = not after.where("comp != old").isEmpty()
        discard(labels)
        labels = after.select("node", "comp")
        if not changed:
            discard(both)
            return labels


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (id, comp) after the components of both ends of each edge (a, b) have become one; a graph of components alone is walked."""
    a, b = labels.select(F.col("id").alias("a"), F.col("comp").alias("x")), labels.select(F.col("id").alias("b"), F.col("comp").alias("y"))
    found = components(edges.join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    after = stored(labels.join(found.select(F.col("node").alias("comp"), F.col("comp").alias("least")), "comp", "left").select("id", F.coalesce("least", "comp").alias("comp")), "labels")
    discard(labels, found)
    return after
