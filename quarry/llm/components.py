"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources.files import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b): the smallest node that it can reach.

    Each round takes the smallest label among the neighbours, then the label of
    the label, so long chains fold in a logarithmic number of rounds. Rounds are
    written to the shared folder, which cuts the lineage; the driver sees counts.
    """
    pairs = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(pairs.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")))
    while True:
        near = pairs.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")) \
            .agg(F.min("comp").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        new = materialize(lower.join(jump, "comp").select("node", "was", F.least("comp", "further").alias("comp")))
        labels = new.select("node", "comp")
        if new.where("comp != was").isEmpty():
            return labels
