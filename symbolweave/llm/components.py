"""Connected components of a table of links, by contraction.

In each round every node points at its smallest neighbour, if that is smaller than itself;
pointers are followed to their roots, and links between roots are the next round's, without
repeats.  Every node that has a smaller neighbour goes away, so rounds shrink fast: a star
takes one round.  What a round makes is written to the shared folder.  Counts combine on
the map side, and a hub's rows lie on the side of a join that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolweave.lineage import Cut, cut


def _roots(pointers: Cut) -> DataFrame:
    """Each ``node`` with the end of its chain of ``label``s; nodes that are roots may be missing."""
    while True:
        up = pointers.df.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = cut(pointers.df.join(up, "label", "left").select(
            "node", F.coalesce("up", "label").alias("label"), F.col("up").isNotNull().alias("moved")), "roots")
        if not jumped.df.filter("moved").limit(1).count():
            return jumped.df.select("node", "label")
        pointers = Cut(jumped.df.select("node", "label"), jumped.rows)


def relabelled(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct links between the labels of what ``links`` link, smaller end first."""
    a, b = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(
        F.col("node").alias("b"), F.col("label").alias("lb"))
    ends = links.join(a, "a", "left").join(b, "b", "left").select(
        F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    return ends.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def composed(labels: DataFrame, later: DataFrame) -> DataFrame:
    """Labels followed by the labels that ``later`` gives to them; both may leave out their roots."""
    further = later.select(F.col("node").alias("label"), F.col("label").alias("top"))
    old = labels.join(further, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    return old.unionByName(later.join(labels, "node", "left_anti"))


def components(links: DataFrame) -> DataFrame:
    """(``node``, ``label``): the smallest node reachable over links (``a``, ``b``), for every node that is not it."""
    left = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct(), "links")
    labels = left.df.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0)
    while left.rows:
        pointers = cut(left.df.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label")), "pointers")
        roots = _roots(pointers)
        labels = cut(composed(labels, roots), "labels").df
        left = cut(relabelled(left.df, roots), "links")
    return labels
