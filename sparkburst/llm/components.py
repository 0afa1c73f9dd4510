"""Connected components of a link table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected(links: DataFrame) -> DataFrame:
    """(v, comp) for every node of the links (a, b) of longs: the least node that can be reached.

    Each round takes the least label among neighbours, then the label of that label, so
    chains halve. Labels stay in the shared folder; only one sum a round reaches the driver.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = materialise(both)
    labels = materialise(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.min("a")).alias("comp")))
    if labels.isEmpty():
        return labels
    total = F.sum(F.col("comp").cast("decimal(38,0)"))
    before = labels.agg(total).first()[0]
    while True:
        around = both.join(labels.select(F.col("v").alias("b"), "comp"), "b").groupBy(F.col("a").alias("v")).agg(F.min("comp").alias("_near"))
        nearer = materialise(labels.join(around, "v").select("v", F.least("comp", "_near").alias("comp")))
        jump = nearer.select(F.col("v").alias("comp"), F.col("comp").alias("_to"))
        labels = materialise(nearer.join(jump, "comp").select("v", F.col("_to").alias("comp")))
        now = labels.agg(total).first()[0]
        if now == before:
            return labels
        before = now
