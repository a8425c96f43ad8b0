"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertone.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every linked node; the component is its least node.

    ``links`` has the columns ``a`` and ``b``. Each round hooks the roots of
    linked nodes together and halves the paths, until nothing changes, however
    many rounds that takes. Rounds are checkpointed; hubs cost one row per link.
    """
    both = cut_lineage(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .filter("a != b").distinct()
    )
    labels = cut_lineage(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        .select("node", F.least("node", "least").alias("component"))
    )
    while True:
        offers = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "component")
        # The root of a node is offered what the node sees, so whole trees move at once.
        seen = offers.groupBy("node").agg(F.min("component").alias("offer"))
        lowered = labels.join(seen, "node").select("node", "component", F.least("component", "offer").alias("offer"))
        hooks = lowered.groupBy(F.col("component").alias("root")).agg(F.min("offer").alias("to"))
        stepped = cut_lineage(
            lowered.join(hooks, F.col("offer") == F.col("root"), "left").select(
                "node",
                F.col("component").alias("before"),
                F.least("offer", F.coalesce("to", "offer")).alias("component"),
            )
        )
        if stepped.filter("before != component").isEmpty():
            return stepped.select("node", "component")
        labels = stepped.select("node", "component")
