"""Connected components of a table of links, by contraction.

In each round every vertex hooks to its smallest neighbour, the trees of hooks
are flattened by pointer doubling, and the links are rewritten to the roots; a
star collapses in one round.  Rounds end when no link is left.  Links and
labels stay in tables of the shared folder; the driver only learns whether a
table is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import saved


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) of any ordered type; returns (v, root), one row for
    each vertex with a link to another, root the smallest of its component.
    Links of a vertex to itself and repeated links change nothing."""
    links = saved(links.select("a", "b").where("a != b").distinct())
    label = None
    while label is None or not links.isEmpty():
        ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = _flat(saved(ends.groupBy("a").agg(F.min("b").alias("m"))
                           .select(F.col("a").alias("v"), F.least("a", "m").alias("root"))))
        label = hook if label is None else saved(_raised(label, hook).select("v", "root"))
        left = hook.select(F.col("v").alias("a"), F.col("root").alias("ra"))
        right = hook.select(F.col("v").alias("b"), F.col("root").alias("rb"))
        links = saved(links.join(left, "a").join(right, "b").where("ra != rb")
                      .select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    return label


def _raised(label: DataFrame, by: DataFrame) -> DataFrame:
    """``label`` with each root replaced by its root in ``by``; old roots in ``old``."""
    up = by.select(F.col("v").alias("old"), F.col("root").alias("higher"))
    return label.select("v", F.col("root").alias("old")).join(up, "old", "left").select(
        "v", "old", F.coalesce("higher", "old").alias("root"))


def _flat(label: DataFrame) -> DataFrame:
    """Follow roots that have a root themselves, until none has."""
    while True:
        step = saved(_raised(label, label))
        label = step.select("v", "root")
        if step.where("old != root").isEmpty():
            return label
