"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakescope.session import cut_lineage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every linked node; a component is named by its smallest node.

    Each round takes the smallest label among neighbours and then the label of that label,
    so long chains shrink by doubling. Both steps are aggregations with a map-side combine,
    and a hub only makes a skewed join. The rounds end when no label changes.
    """
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    both = cut_lineage(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("component")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        hopped = cut_lineage(labels.join(near, labels["node"] == near["a"]).select("node", "component", F.least("component", "near").alias("next")))
        ahead = hopped.select(F.col("node").alias("at"), F.col("next").alias("ahead"))
        moved = cut_lineage(hopped.join(ahead, hopped["next"] == ahead["at"]).select("node", "component", F.least("next", "ahead").alias("next")))
        labels = moved.select("node", F.col("next").alias("component"))
        if moved.filter("component <> next").isEmpty():
            return labels
