"""Connected components by label propagation with pointer jumping, for any graph size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def components(edges: DataFrame, workspace: Workspace) -> DataFrame:
    """edges (a, b) to (id, label): the least id that each id of an edge can reach.

    A round gives each node the least label among its neighbours, then the label of its
    label; it ends when no label changes. Each round is a table in the workspace.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = workspace.save(both, "links")
    labels = workspace.save(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(seen, "id").select("id", F.least("label", "near").alias("next"), F.col("label").alias("old"))
        step = workspace.save(step, "step")
        jump = step.select(F.col("id").alias("next"), F.col("next").alias("top"))
        after = step.join(jump, "next", "left").select("id", F.coalesce("top", "next").alias("label"), "old")
        after = workspace.save(after, "labels")
        changed = after.filter("label <> old").limit(1).count()
        labels = after.drop("old")
        if not changed:
            return labels
