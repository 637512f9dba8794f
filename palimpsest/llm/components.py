"""Connected components of a table of links, without gathering any group.

Labels pass along links and jump to the labels of labels, each round in joins and sums
that combine before they shuffle; the number of rounds grows with the logarithm of the
longest path.  Every round is a written table, and replaces the last.

A hub of very many links is a hot key of a round's joins.  One side has a single row for each
key there, so the other can be split (as adaptive execution does), and up to ``BROADCAST_LABELS``
labels are broadcast for the jump, so that the rows of a large component stay where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, table

#: Labels that may be broadcast; more are joined.
BROADCAST_LABELS = 1_000_000


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every end of the links (a, b): comp is the least node reachable; a written table."""
    both = table(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    nodes = both.count()  # no fewer than there are nodes, as each has a link
    labels = table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("comp")), "labels", nodes)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        low = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("low"))
        low = table(low, "low", nodes)
        used = labels.join(low.select(F.col("low").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("low"), F.col("comp").alias("far"))
        jump = low.join(F.broadcast(used) if used.count() <= BROADCAST_LABELS else used, "low")
        after = table(jump.select("node", F.least("low", "far").alias("comp"), (F.col("was") != F.least("low", "far")).alias("moved")), "labels", nodes)
        changed = after.where("moved").limit(1).count()
        drop(labels, low)
        labels = after
        if not changed:
            drop(both)
            return labels.drop("moved")
