"""Connected components of an edge table by least labels with pointer jumping.

Every round each node takes the least label among itself and its neighbours and then the label of its label, so the
number of rounds grows with the logarithm of the longest path. Rounds are written to the shared folder; the driver sees
only how many labels changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosescan.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """edges: a long, b long. Returns node, label for each node that has an edge; label: the least node of its component."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = written(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "labels")
        ahead = hooked.select(F.col("node").alias("label"), F.col("label").alias("ahead"))
        labels = written(hooked.join(ahead, "label").select("node", "old", F.least("label", "ahead").alias("label")), "labels")
        if labels.where("old <> label").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
