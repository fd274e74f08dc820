"""Connected components over links in DataFrames, without collecting any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import drop_stored, stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the least node it reaches.

    Each round takes the least label among the neighbours of a node, then the
    label of that label, so the rounds grow with the logarithm of a component's
    diameter. Every round is written to the shared folder, which cuts lineage.
    An empty table gives no rows; self-links and repeated links do no harm.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    label = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "labels")
    while True:
        heard = both.join(label, F.col("a") == F.col("node")).select(F.col("b").alias("node"), "root")
        least = label.union(heard).groupBy("node").agg(F.min("root").alias("root"))
        jump = label.select(F.col("node").alias("via"), F.col("root").alias("further"))
        after = least.join(jump, F.col("root") == F.col("via"), "left").select("node", F.least("root", "further").alias("root"))
        after = stored(after, "labels")
        changed = after.join(label.withColumnRenamed("root", "before"), "node").where("root <> before").limit(1).count()
        drop_stored(label)
        label = after
        if not changed:
            drop_stored(both)
            return label
