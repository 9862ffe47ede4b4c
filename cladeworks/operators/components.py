"""Connected components of link tables, labels spreading and jumping by turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeworks.session import cut


def components(links: DataFrame, a: str, b: str, within: tuple[str, ...] = ()) -> DataFrame:
    """(within..., node, label) of all ends of the links, label being the smallest node of the connected component.

    Nodes are told apart within the columns ``within``. Labels spread to neighbours and jump along labels by turns, each
    round cut from its lineage; nothing is collected but whether a round changed anything. Null ends are no nodes.
    """
    w = list(within)
    sound = links.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    both = cut(
        sound.select(*w, F.col(a).alias("x"), F.col(b).alias("y")).unionByName(sound.select(*w, F.col(b).alias("x"), F.col(a).alias("y"))).distinct()
    )
    labels = cut(both.groupBy(*w, "x").agg(F.min("y").alias("m")).select(*w, F.col("x").alias("node"), F.least("x", "m").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "y"), [*w, "y"]).groupBy(*w, "x").agg(F.min("label").alias("near"))
        spread = labels.join(near.withColumnRenamed("x", "node"), [*w, "node"]).select(
            *w, "node", F.least("label", "near").alias("l2"), F.col("label").alias("old")
        )
        far = spread.select(*w, F.col("node").alias("l2"), F.col("l2").alias("l3"))
        after = cut(spread.join(far, [*w, "l2"], "left").select(*w, "node", F.least("l2", F.coalesce("l3", "l2")).alias("label"), "old"))
        changed = after.where("label <> old").limit(1).count()
        labels = after.select(*w, "node", "label")
        if not changed:
            return labels
