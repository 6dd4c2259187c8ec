"""Roots and depths of a hierarchy given as (child, parent) rows.

Every node looks up its ancestor's ancestor, so the distance doubles with each join: a hierarchy of
depth d takes about log2(d) rounds instead of the d a recursive query needs. A round is a join of two
checkpointed tables on a unique key; a parent of very many nodes is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def descend(df: DataFrame, child: str, parent: str) -> DataFrame:
    """(node, root, depth) for every ``child``. A node whose parent is null, itself or not a child
    anywhere is a root of depth 0. Children must be unique; a cycle raises ``ValueError``."""
    nodes = df.select(F.col(child).alias("node"), F.col(parent).alias("up")).where("node IS NOT NULL")
    known = nodes.select(F.col("node").alias("known"))
    start = nodes.join(known, F.col("up") == F.col("known"), "left")
    below = F.col("known").isNotNull() & (F.col("up") != F.col("node"))
    state = start.select("node", F.when(below, F.col("up")).otherwise(F.col("node")).alias("root"), F.when(below, 1).otherwise(0).cast("long").alias("depth"))
    state = state.checkpoint(eager=True)
    total = state.count()
    while True:
        ups = state.select(F.col("node").alias("_n"), F.col("root").alias("_r"), F.col("depth").alias("_d"))
        state = (state.join(ups, F.col("root") == F.col("_n"))
                 .select("node", F.col("_r").alias("root"), (F.col("depth") + F.col("_d")).alias("depth"), F.col("_d").alias("_gained"))).checkpoint(eager=True)
        gained, deepest = state.agg(F.max("_gained"), F.max("depth")).first()
        state = state.drop("_gained")
        if not gained:
            return state
        if deepest >= total:        # no path is longer than there are nodes
            raise ValueError(f"{parent} leads back to a {child}: the rows hold a cycle")
