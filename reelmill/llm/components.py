"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmill.session import store


def components(links: DataFrame) -> DataFrame:
    """node and the least node that it is connected with, for every node in ``links`` (a, b); stored.

    Each round a node takes the least label of its neighbours, then its label's own label, so that
    long chains shrink fast. Rounds are stored; labels and links never leave the executors.
    """
    size = 2 * links.count()
    both = links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct()
    both = store(both, "links", size)
    labels = store(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels", size)
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "b"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        stepped = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        of = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        stepped = stepped.join(of, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label"))
        stepped = store(stepped, "labels", size)
        labels = stepped.select("node", "label")
        if stepped.where("label <> old").isEmpty():
            return labels
