"""Connected components of a link table, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Saved


def components(links: DataFrame) -> Saved:
    """(node, label): each node of `links` (a, b) with the smallest node it is linked to, directly or not.

    Labels spread to neighbours and then jump to their label's label, so rounds grow with the logarithm of a
    chain's length. Each round is written to the shared folder; nothing but a count reaches the driver. No links give no rows.
    """
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = Saved(ends.unionByName(ends.select(F.col("other").alias("node"), F.col("node").alias("other"))).filter("node <> other").distinct(), "links")
    now = Saved(both.df.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), "labels")
    while True:
        near = both.df.join(now.df.withColumnsRenamed({"node": "other", "label": "seen"}), "other").groupBy("node").agg(F.min("seen").alias("seen"))
        spread = now.df.join(near, "node").select("node", "label", F.least("label", "seen").alias("next"))
        target = now.df.select(F.col("node").alias("next"), F.col("label").alias("jumped"))
        after = Saved(spread.join(target, "next", "left").select("node", F.least("next", "jumped").alias("label"), (F.least("next", "jumped") < F.col("label")).alias("moved")), "labels")
        moved = after.df.filter("moved").limit(1).count()
        now.drop()
        if not moved:
            both.drop()
            after.df = after.df.select("node", "label")
            return after
        after.df = after.df.select("node", "label")
        now = after
