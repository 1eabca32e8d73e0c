"""Connected components of links, on the cluster.

Repeated links and links of a node to itself change nothing; no links give no
rows; links with a null end are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.store import dropped, saved


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, comp): the smallest node reachable by the links (a, b).

    Each round gives every node the smallest label among its neighbours, then
    the label of its label.  Labels only fall, and a round that changes none is
    the last; nothing but its count of changes reaches the driver.  The minimum
    over a hub's neighbours is a partial aggregate.
    """
    links = links.filter("a IS NOT NULL AND b IS NOT NULL")
    both = saved(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("c")), "b").groupBy(F.col("a").alias("n")).agg(F.min("c").alias("c"))
        met = labels.join(near, labels["node"] == near["n"]).select("node", F.col("comp").alias("old"), F.least("comp", "c").alias("comp"))
        up = labels.select(F.col("node").alias("n"), F.col("comp").alias("c"))
        new = saved(met.join(up, met["comp"] == up["n"]).select("node", "old", F.least("comp", "c").alias("comp")), "labels")
        changed = new.filter("comp != old").limit(1).count()
        dropped(labels)
        path, labels = new.scratch_path, new.select("node", "comp")
        labels.scratch_path = path
        if not changed:
            dropped(both)
            return labels
    raise RuntimeError(f"no end after {most_rounds} rounds")
