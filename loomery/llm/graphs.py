"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm.workdir import written


def components(edges: DataFrame) -> DataFrame:
    """(v, c): the smallest vertex that each vertex of the edges (a, b) reaches.

    Labels go over edges and then jump to the label of their label; every round is a written table. The number of
    rounds follows the logarithm of the longest path; nothing is gathered on the driver.
    """
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("w"))
    both = written(both.unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w"))).distinct(), "edges")
    labels = written(both.groupBy("v").agg(F.min("w").alias("m")).select("v", F.least("v", "m").alias("c")), "labels")
    while True:
        by_w = labels.select(F.col("v").alias("w"), F.col("c").alias("wc"))
        near = both.join(by_w, "w").groupBy("v").agg(F.min("wc").alias("m"))
        step = labels.join(near, "v").select("v", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        step = written(step, "labels")
        jump = step.select(F.col("v").alias("c"), F.col("c").alias("cc"))
        new = written(step.join(jump, "c").select("v", "old", F.col("cc").alias("c")), "labels")
        labels = new.select("v", "c")
        if new.filter("c <> old").isEmpty():
            return labels
