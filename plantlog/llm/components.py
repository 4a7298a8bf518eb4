"""Connected components of an edge table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plantlog.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``label``) for the ends of ``edges`` (``a``, ``b``); ``label`` is the smallest node
    of the component. Each round moves every label to the smallest among its neighbours, then to its
    label's label, so distances at least halve; the driver sees one number per round."""
    both = saved(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(
        edges.select("b", "a")).distinct(), "cc-edges")
    labels = saved(both.groupBy("node").agg(F.min("other").alias("low")).select(
        "node", F.least("node", "low").alias("label")), "cc-labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(
            F.min("label").alias("low"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "low").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        moved = saved(step.join(jump, "new").select("node", "label", "far"), "cc-labels")
        changed = moved.where("label != far").limit(1).count()
        labels = moved.select("node", F.col("far").alias("label"))
        if not changed:
            return labels
