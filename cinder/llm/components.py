"""Connected components of a link table, by hooking and shortcutting.

Every step is a join or a combinable aggregate over tables of the size of the
links; the number of rounds is logarithmic in the longest path.  Each round is
written to the shared folder, so lineage stays short and a lost executor costs
at most the running round.  The joins are merge joins: the tables are longs that
pack well, so one that looks small enough to broadcast is many times that in the
driver's memory, and a round would hold four of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinder.session import materialise


def connected_components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` of longs -> ``(node, label)``, label = smallest node reachable.

    Nulls on either side are no link; self links and repeated links change
    nothing; an empty table gives an empty result.
    """
    links = links.where("a is not null and b is not null and a <> b")
    both = materialise(
        links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "cc-links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label"))
    labels = materialise(labels, "cc-labels")
    while True:
        seen = (both.join(labels.hint("merge"), both.b == labels.node)
                .groupBy(both.a.alias("at")).agg(F.min("label").alias("near")))
        pulled = (labels.join(seen.hint("merge"), labels.node == seen.at)
                  .select("node", "label", F.least("label", "near").alias("low")))
        hooks = pulled.groupBy(F.col("label").alias("root")).agg(F.min("low").alias("hook"))
        hooked = (pulled.join(hooks.hint("merge"), pulled.label == hooks.root)
                  .select("node", "label", F.least("low", "hook").alias("mid")))
        parents = hooked.select(F.col("node").alias("parent"), F.col("mid").alias("up"))
        step = materialise(
            hooked.join(parents.hint("merge"), hooked.mid == parents.parent)
            .select("node", F.col("label").alias("old"), F.least("mid", "up").alias("label")), "cc-labels")
        labels = step.select("node", "label")
        if step.where("old <> label").isEmpty():
            return labels
